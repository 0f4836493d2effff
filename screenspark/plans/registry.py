"""Where the query modules register what the entry module offers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import BOXES, CAPTIONS, TRUTH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_VIEWS = {"boxes": BOXES, "gt": TRUTH, "captions": CAPTIONS.replace("STRING", "VARCHAR")}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


def over(sql: str, *names: str, recursive: bool = False) -> str:
    """A checking query with the derived views in front; ``sql`` may start with more
    ``, name AS (...)``."""
    need = ["boxes", *(n for n in names if n != "boxes")]
    head = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in need)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {sql.strip()}"


# --- SQL pieces of the checking queries ---------------------------------------------------


def area(a: str) -> str:
    return f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1))"


def inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"


def iou(a: str, b: str) -> str:
    return f"(CAST({inter(a, b)} AS DOUBLE)/({area(a)}+{area(b)}-{inter(a, b)}))"


def contained(inner: str, outer: str) -> str:
    return f"(CAST({inter(inner, outer)} AS DOUBLE)/{area(inner)})"


def strictly(c: str, p: str) -> str:
    return f"({area(p)} > {area(c)} AND {c}.x1 >= {p}.x1+5 AND {c}.y1 >= {p}.y1+5 AND {c}.x2 <= {p}.x2-5 AND {c}.y2 <= {p}.y2-5)"


def fold_sql(source: str, by: str, order: str, clash: str, columns: str, where: str = "") -> str:
    """Recursive rows that carry the kept boxes of a group in a list: the checking form of a
    greedy fold.  ``clash`` compares a kept ``k`` with the candidate ``n``."""
    fields = [c.strip() for c in columns.split(",")]
    pack = "{" + ", ".join(f"{c}: n.{c}" for c in fields) + "}"
    on = " AND ".join(f"n.{c.strip()} = f.{c.strip()}" for c in by.split(","))
    nby = ", ".join(f"n.{c.strip()}" for c in by.split(","))
    return f"""
    , ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {source} {where}),
    folded AS (
      SELECT {nby}, n.rn, [{pack}] AS kept FROM ranked n WHERE n.rn = 1
      UNION ALL
      SELECT {nby}, n.rn, CASE WHEN len(list_filter(f.kept, lambda k: {clash})) > 0 THEN f.kept ELSE list_append(f.kept, {pack}) END
      FROM folded f JOIN ranked n ON {on} AND n.rn = f.rn + 1),
    final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY rn DESC) AS back FROM folded) WHERE back = 1)"""
