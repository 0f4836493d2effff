"""Contracts for detectors, text readers and captioners over image bytes.

A backend is a function of a batch; it runs inside tasks over the ``binaryFile`` source.
Backends are registered by name, so a query names the one it wants; none is built in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

DETECTION = "x1 int, y1 int, x2 int, y2 int, visual_type string, confidence double, text string, source string"
Detector = Callable[[bytes], list[tuple]]

_DETECTORS: dict[str, Callable[..., Detector]] = {}


def register(name: str, factory: Callable[..., Detector]) -> None:
    """The factory is called once in each task, so that it can load a model there."""
    _DETECTORS[name] = factory


def available() -> list[str]:
    return sorted(_DETECTORS)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(path).selectExpr("regexp_extract(path, '([^/]+?)[.][a-zA-Z]+$', 1) AS state_id", "content")


def detect(images: DataFrame, backend: str, **options) -> DataFrame:
    """(state_id, elem_id, ...) of what a backend finds on each image; an image on which it
    fails raises, so that a run never misses screens silently."""
    if backend not in _DETECTORS:
        raise KeyError(f"no detector named {backend!r}; there are {available()}")
    factory = _DETECTORS[backend]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory(**options)
        for frame in frames:
            rows = [(s, k + 1, *row) for s, c in zip(frame["state_id"], frame["content"], strict=True) for k, row in enumerate(detector(bytes(c)))]
            yield pd.DataFrame(rows, columns=["state_id", "elem_id", "x1", "y1", "x2", "y2", "visual_type", "confidence", "text", "source"])

    return images.mapInPandas(run, f"state_id string, elem_id int, {DETECTION}")
