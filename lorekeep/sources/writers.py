"""Sinks: exports, snapshots and versioned tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_VERSION = 1


def export_current(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, and a text file for each topic."""
    rows.write.mode("overwrite").json(f"{path}/memories")
    topics = rows.select(F.explode("tags").alias("topic"), F.concat(F.lit("- "), F.col("content")).alias("line"))
    topics.write.mode("overwrite").partitionBy("topic").text(f"{path}/topics")


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """A full export: each table as JSON lines, and a manifest with counts and schemas."""
    counts, schemas = {}, {}
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        counts[name] = spark.read.schema(df.schema).json(f"{path}/{name}").count()
        schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    line = json.dumps({"format": "snapshot", "version": SNAPSHOT_VERSION, "schema_version": 1, "tables": counts, "schemas": schemas})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
    return counts


def next_version(rows: DataFrame, path: str, version: int) -> str:
    """Write the next version of a table beside the older ones, which readers may still hold."""
    out = f"{path}/v{version:08d}"
    rows.write.mode("errorifexists").parquet(out)
    return out


def bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table bucketed and sorted by its join keys, so that joins on them need no exchange."""
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def append_events(rows: DataFrame, path: str, enabled: bool = True) -> None:
    """Add rows to a log; nothing where logging is off. Appends of several writers never rewrite each other's files."""
    if enabled:
        rows.write.mode("append").parquet(path)
