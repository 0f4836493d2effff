"""Rows, columns and grids of leaves."""

from screenspark.operators import layout as L


def test_a_grid_of_buttons(spark):
    """Three by two buttons, a list below them, and a row that is no part of a grid."""
    rows = [(1, 0, 1 + r * 3 + c, 50 + 90 * c, 50 + 50 * r, 120 + 90 * c, 80 + 50 * r) for r in range(2) for c in range(3)]
    rows += [(1, 7, 10 + k, 50, 200 + 40 * k, 120, 220 + 40 * k) for k in range(3)]
    rows += [(2, 0, 20, 0, 0, 10, 10), (2, 0, 21, 50, 0, 60, 10), (2, 0, 22, 0, 100, 10, 110), (2, 0, 23, 200, 100, 210, 110), (3, 0, 30, 0, 0, 9, 9)]
    df = spark.createDataFrame(rows, "state_id int, parent_id int, elem_id int, x1 int, y1 int, x2 int, y2 int")
    got = sorted((r.state_id, r.parent_id, r.kind, r.n, tuple(r.members)) for r in L.groups(df, ["state_id", "parent_id"]).collect())
    assert got == [
        (1, 0, "column", 2, (1, 4)), (1, 0, "column", 2, (2, 5)), (1, 0, "column", 2, (3, 6)), (1, 0, "grid", 6, (1, 2, 3, 4, 5, 6)), (1, 0, "row", 3, (1, 2, 3)), (1, 0, "row", 3, (4, 5, 6)),
        (1, 7, "column", 3, (10, 11, 12)), (2, 0, "column", 2, (20, 22)), (2, 0, "row", 2, (20, 21)), (2, 0, "row", 2, (22, 23)),
    ]
    assert L.groups(df.where("false"), ["state_id", "parent_id"]).collect() == []


def test_two_leaves_in_one_cell_are_no_grid(spark):
    rows = [(1, 1, 0, 0, 10, 10), (1, 2, 2, 2, 12, 12), (1, 3, 50, 0, 60, 10), (1, 4, 0, 40, 10, 50), (1, 5, 50, 40, 60, 50)]
    df = spark.createDataFrame(rows, "state_id int, elem_id int, x1 int, y1 int, x2 int, y2 int")
    assert {r.kind for r in L.groups(df, ["state_id"]).collect()} == {"row", "column"}


def test_tree_order_joins_once_and_keeps_columns(spark):
    """Places come from one pass over each screen, not from rounds that are joined again."""
    from screenspark.operators import layout

    rows = [(1, 1, 0, 0, 90, 90), (1, 2, 5, 60, 20, 80), (1, 3, 40, 5, 80, 20), (1, 4, 0, 200, 9, 209), (2, 1, 0, 0, 9, 9)]
    df = spark.createDataFrame(rows, "state_id int, elem_id int, x1 int, y1 int, x2 int, y2 int")
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "state_id int, elem_id int, parent_id int")
    got = layout.tree_order(df, edges)
    assert got.columns == [*df.columns, "reading_pos"]
    assert {(r.state_id, r.elem_id): r.reading_pos for r in got.collect()} == {(1, 1): 0, (1, 3): 1, (1, 2): 2, (1, 4): 3, (2, 1): 0}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
