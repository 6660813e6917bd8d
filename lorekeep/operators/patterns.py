"""Patterns learned from clusters: one stored plan, several tables written from it, each batch once.

A pattern stands for its cluster: its importance is the members' mean and a boost by their number, at most 1; it trusts as the least trusted member does.
Edges lead from it to its members, and a member's importance falls by a factor. The rows of a batch go to a folder of the
batch in each table, which a retry writes again as it was, so tables agree whatever failed in between; a reader sees batches that are
whole in all tables, as the marker is written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.scoring import TRUST_ORDER, by_key
from lorekeep.session import stored

CONFIDENCE, FADED, BOOST, MOST = 0.9, 0.7, 0.05, 1.0
TABLES = ("patterns", "edges", "members")


def planned(clusters: DataFrame, memories: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table from clusters (scope, seed, member) and memories (id, trust_tier, importance)."""
    rows = stored(clusters.join(memories.select(F.col("id").alias("member"), "trust_tier", "importance").hint("merge"), "member"))
    rank = by_key(F.col("trust_tier"), {t: i for i, t in enumerate(TRUST_ORDER)}, len(TRUST_ORDER))
    patterns = rows.groupBy("seed").agg(
        F.max("scope").alias("scope"),
        F.count(F.lit(1)).alias("n"),
        F.least(F.lit(MOST), F.round(F.avg("importance") + BOOST * F.count(F.lit(1)), 9)).alias("importance"),
        F.max_by("trust_tier", rank).alias("trust_tier"),
    )
    name = F.concat(F.lit("P"), F.col("seed").cast("string"))
    return {
        "patterns": patterns.select(name.alias("uid"), "scope", "n", "importance", "trust_tier"),
        "edges": rows.select(name.alias("src"), F.col("member").alias("dst"), F.lit("derived_from").alias("edge_type"), F.lit(CONFIDENCE).alias("confidence")),
        "members": rows.select(F.col("member").alias("id"), F.round(F.col("importance") * FADED, 9).alias("importance")),
    }


def written(plan: dict[str, DataFrame], path: str, batch: int, fail_after: str | None = None) -> None:
    """Write a batch to all tables; ``fail_after`` stops after one of them, as a lost driver would."""
    for name in TABLES:
        plan[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        if name == fail_after:
            raise RuntimeError(f"stopped after {name}")
    spark = plan["patterns"].sparkSession
    spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/done/part={batch}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of the batches that are whole."""
    done = [r.batch for r in spark.read.parquet(f"{path}/done").select("batch").distinct().collect()]  # one for each batch
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/batch={b}" for b in sorted(done)])
