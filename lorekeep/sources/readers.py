"""Sources: logs and stores with schema drift, delimited text, JSON lines, archives and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorekeep.functions.text import tag_list

MAX_LINKS = 8


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``, cast; those that ``df`` lacks are null, others are dropped."""
    own = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def federated(spark: SparkSession, links: dict[str, str], table: str, schema: StructType) -> DataFrame:
    """One table of several sibling stores, with their ``profile``; stores that can't be read are left out."""
    if len(links) > MAX_LINKS:
        raise ValueError(f"{len(links)} links are more than {MAX_LINKS}")
    out = spark.createDataFrame([], schema).withColumn("profile", F.lit(""))
    for profile, path in sorted(links.items()):
        try:
            rows = conform(spark.read.parquet(f"{path}/{table}.parquet"), schema)
        except Exception as error:  # a missing sibling is no failure of the query
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        out = out.unionByName(rows.withColumn("profile", F.lit(profile)))
    return out


def validate_link(spark: SparkSession, own: str, target: str, version: int) -> str:
    """The reason why a store can't be linked, or an empty string."""
    if own.rstrip("/") == target.rstrip("/"):
        return "a store can't link to itself"
    try:
        found = spark.read.json(f"{target}/manifest.json").select("schema_version").first()
    except Exception:
        return "no store there"
    return "its schema is newer" if found and found[0] > version else ""


def delimited_entries(spark: SparkSession, path: str, delimiter: str = "\n§\n") -> DataFrame:
    """position, entry of text files cut at ``delimiter``, stripped, each distinct entry once; positions rise along a file.

    The reader cuts the files itself, so no file is ever one row."""
    rows = spark.read.text(path, lineSep=delimiter).withColumn("position", F.monotonically_increasing_id())
    entries = rows.select("position", F.regexp_replace("value", r"^\s+|\s+$", "").alias("entry")).where("entry <> ''")
    return entries.groupBy("entry").agg(F.min("position").alias("position")).select("position", "entry")


#: Adapters of foreign stores by provider.
PROVIDERS = ("jsonl", "facts", "predecessor")


def import_provider(provider: str, rows: DataFrame, existing: DataFrame, write=None, kinds: dict[str, str] | None = None) -> dict[str, int]:
    """Rows of a foreign store that are new to ``existing`` (by content hash): how many were read and how many are new.

    Without ``write`` it is a dry run that writes nothing; with it, it is given the new rows."""
    from lorekeep.functions.text import content_hash

    if provider not in PROVIDERS:
        raise ValueError(f"{provider} is not supported, only {', '.join(PROVIDERS)}")
    own = {"jsonl": lambda: rows.where("not malformed"), "facts": lambda: provider_facts(rows, kinds or {}), "predecessor": lambda: predecessor_rows(rows)}[provider]()
    hashed = own.withColumn("content_hash", content_hash(F.col("content")))
    new = import_new(existing.select("content_hash"), hashed, ["content_hash"])
    if write:
        write(new)
    return {"read": rows.count(), "new": new.count()}


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """content, kind, tags, created_at, pinned of JSON lines with alias columns; ``malformed`` marks bad lines."""
    schema = "content string, text string, memory string, kind string, tags string, created_at string, timestamp string, pinned boolean, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    content = F.coalesce("content", "text", "memory")
    return rows.select(
        content.alias("content"),
        F.coalesce("kind", F.lit("fact")).alias("kind"),
        tag_list(F.col("tags")).alias("tags"),
        F.try_to_timestamp(F.coalesce("created_at", "timestamp")).alias("created_at"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"),
        (F.col("_bad").isNotNull() | content.isNull()).alias("malformed"),
    )


def provider_facts(rows: DataFrame, kinds: dict[str, str], pin_from: float = 0.9) -> DataFrame:
    """A foreign fact table as memories: categories become kinds, high trust becomes a pin."""
    kind = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in kinds.items()], F.lit("fact"))
    return rows.select(
        "content", kind.alias("kind"), tag_list(F.col("tags")).alias("tags"), (F.col("trust_score") >= pin_from).alias("pinned"), "created_at"
    )


def predecessor_rows(rows: DataFrame) -> DataFrame:
    """A predecessor's memories: archived ones are skipped, a rationale follows the content."""
    said = F.concat_ws("\n\n", "content", F.when(F.trim("rationale") != "", F.col("rationale")))
    return rows.where(~F.coalesce(F.col("archived"), F.lit(False))).select("id", said.alias("content"), F.coalesce("category", F.lit("fact")).alias("kind"))


def archived(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last line of each key in a compressed JSON archive, in order of file and line."""
    rows = spark.read.json(path).withColumn("at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    columns = [c for c in rows.columns if c not in (key, "at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "at").alias("r")).select(key, "r.*")


def hardened(rows: DataFrame) -> DataFrame:
    """Imported rows are never owner-trusted or pinned, and instruction-shaped ones are quarantined."""
    from lorekeep.functions.text import instruction_shaped

    return rows.withColumns(
        {
            "trust_tier": F.when(F.col("trust_tier").isin("owner", "agent"), "known_user").otherwise(F.col("trust_tier")),
            "pinned": F.lit(False),
            "status": F.when(instruction_shaped(F.col("content"), imported=True), "quarantined").otherwise(F.col("status")),
        }
    )


def import_new(existing: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose identity isn't in the store yet, null-safe on every column, one for each identity."""
    nth = Window.partitionBy(*on).orderBy(*[c for c in rows.columns if c not in on][:1] or on)
    first = rows.withColumn("nth", F.row_number().over(nth)).where("nth = 1").drop("nth")
    have = existing.select(*[F.col(c).alias(f"have_{c}") for c in on]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"have_{c}")) for c in on]
    return first.join(have, same, "left_anti")


def sample_sources(memories: DataFrame, episodes: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """A seeded random sample of texts that are long enough: memories first, filled up with episodes."""
    own = memories.where(F.length("content") >= 80).select(F.lit(0).alias("part"), "content")
    rest = episodes.where(F.length("content") >= 200).select(F.lit(1).alias("part"), "content")
    return own.unionByName(rest).orderBy("part", F.md5(F.concat(F.lit(str(seed)), F.col("content"))), "content").limit(limit)


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a full export; missing or short tables are refused."""
    manifest = spark.read.json(f"{path}/manifest.json").first()
    out = {}
    for name, n in manifest.tables.asDict().items():
        out[name] = spark.read.schema(manifest.schemas[name]).json(f"{path}/{name}")
        if out[name].count() != n:
            raise ValueError(f"{name} does not have the {n} rows that its manifest names")
    return out
