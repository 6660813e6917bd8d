"""URL filters: a sort-merge range join of canonical keys with prefix rules, DataFrame functions only.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with the
rule's path. A canonical key is the pair (path prefix, host labels reversed). Among the keys of one
path prefix the urls that a rule fits form one interval that starts at the rule's own key, and any two
intervals are nested or apart. Urls become one probe for each length that a rule's path has and theirs
reaches; probes and rules are sorted together by range and swept. The sweep keeps a stack of active rules
with a place for each number of host labels that rules have: a rule that begins takes its place from the
rule before it there. At a probe a place's rule is active if its interval still holds the probe's key;
if a rule of so many labels fits at all, it is the one in the place, as no other can begin between its key and the
probe's. A range of the sort takes the stack it starts with from the ranges before.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule. Null or
repeated ids and repeated rows are kept, one result for each row. Rules with a null host or path are
ignored; of equal rules the smallest action stands. Of the rules that fit, the one with the longest
``host + path`` wins, ties go to the smaller string. Only the named columns are read, so others may
have any name. Urls and rule paths may have any length: a url has at most as many probes as its path has
characters and rules have lengths.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffles, written

OPEN = "struct<prefix:string,key:string,rule:string,action:string>"

#: The rules of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty where it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``, so that a domain is a prefix of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def distinct_rules(rules: DataFrame) -> DataFrame:
    """Each distinct rule with its key, its number of host labels and what the stack holds of it."""
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("prefix"))
        .agg(F.min("action").alias("action"))
        .withColumn("key", reversed_host(F.col("host")))
        .withColumn("labels", F.size(F.split("key", r"\.")) - 1)
        .withColumn("rule", F.concat("host", "prefix"))
        .select("prefix", "key", "labels", F.struct("prefix", "key", "rule", "action").alias("open"))
    )


def judge_urls(
    urls: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row for each row of ``urls``: id, host, path, the rule that decides (null: none), verdict."""
    spark = urls.sparkSession
    host, path = url_parts(F.col("url"))
    begun = distinct_rules(rules)
    shapes = begun.agg(F.collect_set("labels"), F.collect_set(F.length("prefix"))).first()  # one number for each label count and length
    places, lengths = sorted(shapes[0]), sorted(shapes[1])
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths or [0]]), lambda n: n <= F.length("path"))
    probes = (
        urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
        .select("id", "url", host.alias("host"), path.alias("path"))
        .withColumn("cuts", F.when(F.size(cuts) > 0, cuts).otherwise(F.array(F.lit(0))))
        .withColumn("n_cuts", F.size("cuts"))
        .withColumn("cut", F.explode("cuts"))
        .withColumn("prefix", F.expr("substring(path, 1, cut)"))
        .withColumn("key", reversed_host(F.col("host")))
        .withColumn("is_probe", F.lit(1))
    )
    columns = ["prefix", "key", "is_probe", "id", "url", "host", "path", "n_cuts"]
    both = probes.select(*columns, F.lit(None).cast("int").alias("labels"), F.lit(None).cast(OPEN).alias("open")).unionByName(
        begun.withColumn("is_probe", F.lit(0)), allowMissingColumns=True
    )
    order = ["prefix", "key", "is_probe", "id", "url"]
    n = shuffles(spark)
    ranged = both.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "url-ranges")
    bounds = spark.range(n).select(F.col("id").cast("int").alias("range"))

    def stack(of) -> Column:
        """The places of the stack, each filled by ``of`` its number of labels."""
        return F.array(*[of(p) for p in places]) if places else F.array().cast(f"array<{OPEN}>")

    held = lambda p: F.when(F.col("labels") == p, F.col("open"))
    last = ranged.where("is_probe = 0").groupBy("range").agg(
        stack(lambda p: F.max_by(held(p), F.when(held(p).isNotNull(), F.struct("prefix", "key")))).alias("last")
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = bounds.join(last, "range", "left").select(
        "range", stack(lambda p: F.last(F.col("last")[places.index(p)], ignorenulls=True).over(earlier)).alias("carried")
    )
    sweep = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        ranged.withColumn("stack", stack(lambda p: F.last(held(p), ignorenulls=True).over(sweep)))
        .where("is_probe = 1")
        .join(F.broadcast(carried), "range", "left")  # one row for each range
        .withColumn("began", F.zip_with("stack", "carried", lambda here, before: F.coalesce(here, before)))
    )
    fits = F.transform(
        F.filter("began", lambda o: o.isNotNull() & (o["prefix"] == F.col("prefix")) & F.col("key").startswith(o["key"])),
        lambda o: F.struct((-F.length(o["rule"])).alias("shorter"), o["rule"].alias("rule"), o["action"].alias("action")),
    )
    judged = (
        swept.withColumn("best", F.array_min(fits))
        .groupBy("id", "url")
        .agg(
            F.first("host").alias("host"),
            F.first("path").alias("path"),
            F.min("best").alias("best"),
            (F.count(F.lit(1)) / F.first("n_cuts")).cast("int").alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    )
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
