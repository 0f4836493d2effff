"""Streams against the batch form: rows out of order, behind the watermark, and after a restart."""

import random

from pyspark.sql import functions as F

from screenspark.streaming import stateful as S
from screenspark.streaming import wait as W

KIND = "id long, user string, ts timestamp, kind string, value double"


def made(rng, n=400):
    """Rows of a day in order of time, written in portions that are each a little mixed up."""
    rows = [(i, f"u{rng.randrange(12)}", i * 60, rng.choice(["change", "move", "none", "element", "screen"]), rng.choice([None, float(i)])) for i in range(n)]
    return rows


def write(spark, rows, path, k):
    df = spark.createDataFrame([(i, u, None if t is None else t, k_, v) for i, u, t, k_, v in rows], "id long, user string, s long, kind string, value double")
    df.select("id", "user", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "kind", "value").coalesce(1).write.parquet(f"{path}/part={k}")


def stream(spark, path):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def end(spark, path, k):
    """A row far ahead, after which the watermark has passed all others."""
    write(spark, [(10**6, "end", 10**7, "none", None)], path, k)


def test_guarded_reads_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = made(rng)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    reads = lambda: S.guarded_reads_stream(stream(spark, path), "user", "ts", "id", F.col("kind"), F.col("value"), delay="90 minutes")
    for k in range(4):
        own = rows[k * 100 : (k + 1) * 100]
        rng.shuffle(own)
        # Some rows come with the next portion, still within the delay.
        write(spark, own, path, k)
        if k == 1:
            S.run_to_end(reads(), out)
    # Behind the watermark, which lies 90 minutes before the last row: dropped.
    late = [(5000, "u1", 60, "screen", None), (5001, "u1", 61, "move", 9.0)]
    S.run_to_end(reads(), out)
    write(spark, late, path, 4)
    end(spark, path, 5)
    got = S.run_to_end(reads(), out)
    batch = S.guarded_reads(spark.read.schema(KIND).option("recursiveFileLookup", True).parquet(path).where("id < 5000"), "user", "ts", "id", F.col("kind"), F.col("value"))
    assert sorted(map(str, got.where("id < 5000").collect())) == sorted(map(str, batch.collect())) and batch.count() > 100
    assert got.where("id between 5000 and 5001").isEmpty()
    assert {r.source for r in batch.collect()} == {"read", "element", "screen"}


def test_waits_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    rows = made(rng)
    path, out = str(tmp_path / "in"), {g: str(tmp_path / f"out{g}") for g in (False, True)}
    fits = F.col("kind") == "move"
    run = lambda g: S.run_to_end(S.waits(stream(spark, path), "user", "ts", fits, 1800, delay="90 minutes", keep_seconds=10**6, gone=g, x=F.col("id")), out[g])
    for k in range(4):
        own = rows[k * 100 : (k + 1) * 100]
        rng.shuffle(own)
        write(spark, own, path, k)
        if k == 2:
            run(False), run(True)
    end(spark, path, 5)
    batch = spark.read.schema(KIND).option("recursiveFileLookup", True).parquet(path).where("id < 5000")
    for g, first in ((False, W.first_match), (True, W.first_gone)):
        want = {(r.user, r.outcome, r.us) for r in first(batch, "user", "ts", fits, 1800).select("user", "outcome", F.unix_micros("at").alias("us")).collect()}
        got = [(r.key, r.outcome, r.at_us) for r in run(g).where("key <> 'end'").collect()]
        assert len(got) == len(want) and set(got) == want
    found = run(False).where("outcome = 'found'").collect()
    assert found and all(r.x is not None for r in found) and {r.outcome for r in run(False).collect()} == {"found", "timeout"}


def test_a_forgotten_key_waits_again(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: S.run_to_end(S.waits(stream(spark, path), "user", "ts", F.col("kind") == "move", 10, delay="0 seconds", keep_seconds=100), out)
    write(spark, [(1, "a", 0, "none", None), (2, "b", 0, "none", None)], path, 0)
    write(spark, [(3, "a", 50, "move", None), (4, "b", 60, "none", None)], path, 1)  # decided, not yet forgotten
    write(spark, [(5, "x", 500, "none", None)], path, 2)
    write(spark, [(9, "x", 510, "none", None)], path, 3)  # timers run after the rows of their batch
    write(spark, [(6, "a", 600, "move", None)], path, 4)
    write(spark, [(7, "x", 5000, "none", None)], path, 5)
    write(spark, [(8, "x", 5001, "none", None)], path, 6)
    got = sorted((r.key, r.outcome, r.at_us // 1_000_000 - 1_700_000_000) for r in run().where("key <> 'x'").collect())
    assert got == [("a", "found", 600), ("a", "timeout", 10), ("b", "timeout", 10)]
    assert spark.conf.get(S._STORE) != S._ROCKS


def test_rows_that_are_no_polls(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.createDataFrame([(1, None, 5, "move", 1.0), (2, "a", None, "move", 1.0), (3, "a", 5, None, 1.0)], "id long, user string, s long, kind string, value double")
    df.select("id", "user", F.timestamp_seconds("s").alias("ts"), "kind", "value").coalesce(1).write.parquet(f"{path}/part=0")
    assert S.guarded_reads(spark.read.schema(KIND).parquet(path), "user", "ts", "id", F.col("kind"), F.col("value")).collect() == []
    assert S.run_to_end(S.guarded_reads_stream(stream(spark, path), "user", "ts", "id", F.col("kind"), F.col("value")), str(tmp_path / "o")).collect() == []
