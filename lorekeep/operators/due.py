"""Due checks of recurring runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_INTERVAL_HOURS = 6


def due(runs: DataFrame, now: Column, hours: float = MIN_INTERVAL_HOURS) -> DataFrame:
    """name and ``due``: no run (name, finished_at) has finished, or the last one longer ago than the interval."""
    last = runs.groupBy("name").agg(F.max("finished_at").alias("last"))
    over = F.unix_micros("last") + F.lit(int(hours * 3600e6)) < F.unix_micros(now)
    return last.select("name", F.coalesce(over, F.lit(True)).alias("due"))
