"""Session, table and label helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import checkpoint

__all__ = ["checkpoint", "fold", "integer_ids", "labelled_sample", "map_batches", "sampled_features", "table", "union"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integer_ids(docs: DataFrame) -> None:
    """Refuses a table whose doc_id is no integer column; the operators order and hash it as one."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"doc_id must be an integer column, not {kind.simpleString()}")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids have fold -1."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % parts, F.lit(-1)).cast("int")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are skipped."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, those with the least hash
    of doc_id.  The ids are few by that bound, so they may be broadcast.  Of several labels of
    an id the largest counts, of several texts the least."""
    integer_ids(docs)
    kept = (
        labels.select("doc_id", F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & use)
        .groupBy("doc_id")
        .agg(F.max("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def sampled_features(sample: DataFrame, features: Callable[[pa.Array], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, ordered by doc_id so that fits repeat."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column("text")).astype(np.float64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))],
            ["doc_id", "y", "x"],
        )

    got = map_batches(sample, one, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got.x.tolist(), float).reshape(-1, width)
    return x, got.y.to_numpy(float)


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
