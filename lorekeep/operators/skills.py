"""Skill files: proposals become files first and a status last; revisions, usage and flat configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import skill_slug


def forged(proposals: DataFrame) -> DataFrame:
    """name, document and whether a proposal (name, description, steps) can be a skill; of one slug only the first is."""
    doc = F.concat(F.lit("---\nname: "), F.col("slug"), F.lit("\ndescription: "), F.col("description"), F.lit("\n---\n\n## Steps\n"), F.array_join(F.transform("steps", lambda s: F.concat(F.lit("- "), s)), "\n"))
    rows = proposals.withColumn("slug", skill_slug(F.col("name"))).where("slug <> '' and size(steps) > 0")
    first = rows.groupBy("slug").agg(F.min_by(F.struct("description", "steps"), "name").alias("r"))
    return first.select("slug", "r.*").select(F.col("slug").alias("name"), doc.alias("document"))


def promoted(spark: SparkSession, skills: DataFrame, path: str) -> DataFrame:
    """Write a folder for each skill, and only then say which are promoted: those whose file reads back as written."""
    skills.select("name", F.col("document").alias("value")).write.partitionBy("name").option("lineSep", "\x00").text(path)
    found = spark.read.option("lineSep", "\x00").text(path).select(F.col("name").cast("string").alias("name"), F.col("value").alias("stored"))
    both = skills.join(found, "name", "left")
    return both.select("name", F.when(F.col("stored") == F.col("document"), "promoted").otherwise("proposed").alias("status"))


def merged_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Usage records (name, uses, failures, last_used) of two writers: counts add up, the later use stands."""
    return old.unionByName(new).groupBy("name").agg(F.sum("uses").alias("uses"), F.sum("failures").alias("failures"), F.max("last_used").alias("last_used"))
