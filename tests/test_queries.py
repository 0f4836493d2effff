"""Every registered query against its SQL, on the smallest tables."""

import difflib
import importlib.util
import os
import re
import sys

import duckdb
import pandas as pd
import pytest

from screenspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def checker():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(df):
    """Rows with columns by name and numbers as numbers, in order."""

    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(value, row))) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, checker, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = checker.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got) > 0


def entry_module():
    spec = importlib.util.spec_from_file_location("entry_module", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("missing", ["screenspark.llm", "zstandard"])
def test_entry_module_without_the_corpus_operators(spark, monkeypatch, missing):
    """Neither a missing package nor a missing library of its takes the other queries along."""
    for name in [n for n in sys.modules if n.split(".")[:2] == ["screenspark", "llm"] or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    module = entry_module()
    assert set(module.queries()) == set(catalog.QUERIES) and set(module.oracle_sql()) == set(catalog.ORACLE_SQL)
    assert module.entry(spark).count() > 0


def words_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_word_errors_on_whole_texts(spark):
    """Every sentence against the one before, by the plain table."""
    got = {r.doc_id: (r.words, r.word_edits) for r in catalog.QUERIES["word_errors"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        s = [re.findall(r"[^ \t\n\x0b\f\r]+", x) for x in re.findall(r"[^.!?\n]+", r.text or "")]
        if len(s) > 1:
            want[r.doc_id] = (sum(map(len, s[1:])), sum(words_apart(a, b) for a, b in zip(s, s[1:])))
    assert got == want


@pytest.mark.parametrize("name", ["text_similarity", "edit_script_counts"])
def test_text_pairs_are_whole_texts_of_all_languages(spark, tmp_path, name):
    texts = {1: ("en", "The cat sat on the mat. " * 9 + "zq"), 2: ("de", "Größe, Maß und Übung; " * 5), 3: (None, "short"), 4: ("fr", "x")}
    spark.createDataFrame([(i, *t) for i, t in texts.items()], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    want = {}
    for i, (_, t) in texts.items():
        if name == "text_similarity":
            score = difflib.SequenceMatcher(None, t[1:].lower(), t.lower()).ratio()
            want |= {i: (round(score, 6),)} if score >= 0.6 else {}
        else:
            want[i] = (0, 1, 0)
    assert got == want and len(want) >= 3
