"""Sync of change events over a relay: sealed envelopes in an append-only log for each namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.cdc import applied_once
from lorekeep.operators.ranking import numbered

#: Fixed bounds of a relay.
MAX_BLOBS, MAX_BLOB_CHARS, DEFAULT_LIMIT, MAX_LIMIT = 10_000, 4 * 1024 * 1024, 500, 5_000


def sealed(payload: Column, key: bytes, namespace: Column) -> Column:
    """An opaque envelope: the payload under AES-GCM, bound to its namespace."""
    return F.base64(F.aes_encrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.encode(namespace, "UTF-8")))


def opened(blob: Column, key: bytes, namespace: Column) -> Column:
    """What an envelope holds; null if it was sealed under another key or namespace, or is no envelope."""
    return F.decode(F.try_aes_decrypt(F.unbase64(blob), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.encode(namespace, "UTF-8")), "UTF-8")


def appended(log: DataFrame, blobs: DataFrame, *order: str) -> DataFrame:
    """The log (namespace, seq, blob) with new (namespace, blob) rows behind its last number, in ``order``.

    The new rows are sealed and numbered once, in ranges, so a large namespace is no single task."""
    high = log.groupBy("namespace").agg(F.max("seq").alias("high"))
    checked = blobs.withColumn("blob", F.when(F.length("blob") <= MAX_BLOB_CHARS, F.col("blob")).otherwise(F.raise_error(F.lit("an envelope is too long"))))
    new = numbered(checked, *order, by="namespace").join(high, "namespace", "left")
    return log.unionByName(new.select("namespace", (F.coalesce("high", F.lit(0)) + F.col("nth")).cast("long").alias("seq"), "blob"))


def since(log: DataFrame, namespace: str, cursor: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The next envelopes of a namespace after the cursor; pages neither overlap nor skip."""
    size = min(limit if limit > 0 else DEFAULT_LIMIT, MAX_LIMIT)
    low = max(cursor, 0)
    return log.where((F.col("namespace") == namespace) & (F.col("seq") > low) & (F.col("seq") <= low + size))


def paged(log: DataFrame, namespace: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """All envelopes of a namespace with the ``page`` (from 0) that ``since`` gives each in, page after page, by one read of the log."""
    size = min(limit if limit > 0 else DEFAULT_LIMIT, MAX_LIMIT)
    own = log.where((F.col("namespace") == namespace) & (F.col("seq") > 0))
    return own.withColumn("page", F.floor((F.col("seq") - 1) / size))


def pushed(events: DataFrame, key: bytes, namespace: str) -> DataFrame:
    """Envelopes (namespace, blob, ts, event_id) of the events that aren't synced yet."""
    own = events.where("synced_at is null").withColumn("namespace", F.lit(namespace))
    payload = F.to_json(F.struct("event_id", "uid", "op", F.unix_micros("ts").alias("at")))
    return own.select("namespace", sealed(payload, key, F.col("namespace")).alias("blob"), "ts", "event_id")


def pulled(page: DataFrame, key: bytes, seen: DataFrame) -> DataFrame:
    """Events of a page that aren't applied yet; envelopes that can't be opened are left out."""
    plain = F.from_json(opened(F.col("blob"), key, F.col("namespace")), "event_id long, uid string, op string, at long")
    found = page.select(plain.alias("e")).where("e is not null and e.event_id is not null")
    return applied_once(found.select("e.event_id", "e.uid", "e.op", F.timestamp_micros("e.at").alias("ts")), seen)
