"""Delta against an index, upsert, deletion of orphans, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key by ``order``; the maximum is taken map-side, so a hot key costs one row per task."""
    cols = [c for c in df.columns if c not in order]
    best = df.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(*order, *cols)).alias("r"))
    return best.select("r.*").select(*df.columns)


def delta(incoming: DataFrame, existing: DataFrame, key: str = "chunk_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Incoming rows whose key isn't indexed with the same fingerprint; a null key or fingerprint always counts as new."""
    known = existing.select(key, fingerprint).distinct()
    return incoming.join(known, [key, fingerprint], "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Index after the upsert: incoming rows replace those of the same key; rows without key are appended as they are."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(*existing.columns))


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Store a new version of the index beside the old ones; readers switch by the returned path."""
    path = f"{root.rstrip('/')}/version-{version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def orphans(existing: DataFrame, incoming: DataFrame, url: str, key: str) -> DataFrame:
    """Indexed rows of crawled urls whose key the new crawl no longer has."""
    crawled = existing.join(incoming.select(url).distinct(), url, "left_semi")
    return crawled.join(incoming.select(key).distinct(), key, "left_anti")


def versions(df: DataFrame, key: str, order: str, fingerprint: str) -> DataFrame:
    """Type-2 history: one row per change of ``fingerprint`` of a key, with valid_from, valid_to and version."""
    w = Window.partitionBy(key).orderBy(order)
    changed = df.withColumn("_before", F.lag(fingerprint).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    changed = changed.where(F.col("_first") | ~F.col(fingerprint).eqNullSafe(F.col("_before")))
    return changed.select(key, fingerprint, F.col(order).alias("valid_from"), F.lead(order).over(w).alias("valid_to"), F.row_number().over(w).alias("version"))
