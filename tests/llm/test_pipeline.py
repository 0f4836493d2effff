"""The pipeline stage by stage against brute force, each on what the stage before kept."""

import re

import test_neardup
import test_substring

import corpus_pipeline as P
from screenspark.llm import classifiers as C
from screenspark.llm.common import checkpoint, fold, table
from screenspark.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def kept_words(rows, width=35):
    """Words that stay of each text, by counting all windows."""
    from collections import Counter

    docs = [test_substring.WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[s : s + width]) for w in docs for s in range(len(w) - width + 1))
    out = {}
    for (i, _), w in zip(rows, docs):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = [True] * width
        out[i] = [x for x, g in zip(w, gone) if not g]
    return out


def test_stages_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    results = []
    for _, stage in P.STAGES:
        docs = checkpoint(stage(spark, docs, SF))
        results.append(docs)
    start = table(spark, SF, "documents")
    good, single, clean, safe, packed = results
    assert all(r.columns == start.columns for r in results[:-1])
    score = C.quality(start, table(spark, SF, "labels"), fold("doc_id", 4) != 2).where("score >= 0.7")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in score.collect())
    names = {i: c for i, _, c in test_neardup.brute(rows_of(good))}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(names.values()))
    want = kept_words(rows_of(single))
    assert {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows_of(clean)} == want
    items = [re.sub(r"\s+", " ", r.text.lower()).strip() for r in table(spark, SF, "benchmark").collect()]
    exact = {i for i, t in rows_of(clean) if any(x in re.sub(r"\s+", " ", (t or "").lower()) for x in items)}
    left = {r.doc_id for r in safe.collect()}
    assert not exact & left and len(left) >= clean.count() - len(exact) - 2
    from screenspark.llm.packing import encoder

    encode = encoder(tokenizer_file("byte_bpe_50k.json"))[1]
    sizes = {i: len(encode(t or "")) + 1 for i, t in rows_of(safe)}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()} == sizes
    assert len({r.sequence_id for r in P.run(spark, SF).collect()}) == len({r.sequence_id for r in packed.collect()})


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, and columns with the operators' own names."""
    base = table(spark, SF, "documents").orderBy("doc_id").limit(40).collect()
    leak = table(spark, SF, "benchmark").first().text
    rows = [(r.doc_id, r.text, r.lang, 1, 2, 3) for r in base]
    rows += [(None, base[3].text, None, 4, 4, 4), (None, None, None, 5, 5, 5), (900, "", "en", 6, 6, 6), (None, leak, "en", 7, 7, 7), (900, "", "en", 6, 6, 6), rows[0], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, doc_key int, __id int, score int").repartition(3)
    for name, stage in P.STAGES:
        out = checkpoint(stage(spark, docs, SF))
        assert stage(spark, docs.where("false"), SF).collect() == []
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r[0] for r in rows}
            continue
        assert out.columns == docs.columns
        got = out.collect()
        odd = sorted(r.doc_key for r in got if r.doc_key > 1)
        if name == "n-gram Jaccard join":  # the null id goes where its text has another, wordless rows stay
            names = {i: c for i, _, c in test_neardup.brute([(r[0], r[1]) for r in rows if r[0] is not None])}
            assert sorted(r.doc_id for r in got if r.doc_key == 1) == sorted({c for i, c in names.items() if i != 900}) and odd == [5, 6, 6, 7]
        elif name == "substring dedup":
            assert len(got) == len(rows)
        elif name == "benchmark decontamination":
            assert odd == [4, 5, 6, 6]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
