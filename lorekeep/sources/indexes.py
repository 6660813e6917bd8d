"""Indexes that are built once for a data directory and read by every search after that.

They lie in the shared folder. An index belongs to the input files it was built from: other files, another index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.session import scratch

_BUILT: dict[tuple, object] = {}


def built(spark: SparkSession, name: str, tables: list[DataFrame], build: Callable[[str], object]) -> object:
    """What ``build`` made of the files of ``tables`` in a folder of its own, from this application's store or anew."""
    files = tuple(tuple(sorted(t.inputFiles())) for t in tables)
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _BUILT:
        _BUILT[key] = build(scratch(spark))
    return _BUILT[key]
