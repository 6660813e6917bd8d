"""Numbering all rows of a table in one order without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import stored


def numbered(rows: DataFrame, *order: Column | str, name: str = "nth", by: str | None = None) -> DataFrame:
    """Every row with its number from 1 in ``order``, which must tell rows apart; with ``by``, among the rows of the same value.

    Rows are dealt by range and numbered inside it; each range is moved on by the rows of the ranges before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, *([by] if by else []), *order).withColumn("_range", F.spark_partition_id()))
    if by:
        return _numbered_by(ranged, order, name, by)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def _numbered_by(ranged: DataFrame, order: tuple, name: str, by: str) -> DataFrame:
    """The numbers of each value of ``by``, whose rows lie in ranges that follow each other."""
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range and value
    sizes = ranged.groupBy("_range", by).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(F.col("_range").alias("_at"), F.col(by).alias("_by"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range", by).orderBy(*order))
    met = ranged.withColumn("_own", own).join(offsets, (F.col("_range") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")))
    return met.withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before", "_at", "_by")
