"""Normalising mixed timestamp text to UTC instants through a persisted dictionary.

Raw strings repeat, so rows are first reduced to distinct (text, zone, date
order) entries.  Each entry is parsed once, kept in a growing Parquet
dictionary and joined back to its rows; a later call parses only entries the
dictionary has not seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timestamps import with_instants
from ..session import free_name

ENTRY = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("tz", T.StringType()),
        T.StructField("date_order", T.StringType()),
        T.StructField("utc_us", T.LongType()),
    ]
)


#: Parts a raw text's rows are spread over when they meet the dictionary.
SALTS = 8


class TimestampDictionary:
    """Distinct timestamp texts with their instants, stored below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.parts: list[str] = self._existing()

    def _existing(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory()]
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p for p in done if fs.exists(jpath(p, "_SUCCESS")))

    def entries(self) -> DataFrame:
        """The dictionary so far."""
        if not self.parts:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*self.parts)

    def resolve(self, df: DataFrame, raw: str, tz: str | None = None, order: str | None = None, out: str = "utc_us") -> DataFrame:
        """``df`` with the instant of column ``raw`` as ``out`` (bigint, microseconds, null if none).

        Null and blank texts get null without entering the dictionary.  Rows
        are kept one to one, in any number, with all their columns; ``out``
        must be a new name.  An empty ``df`` gives an empty result.
        """
        names = {k: free_name(df, f"_td_{k}") for k in ("raw", "tz", "date_order")}
        blank = F.lit("")
        keyed = df.withColumns(
            {
                # texts without a digit denote nothing; they are spread by partition instead of meeting in one task
                names["raw"]: F.when(F.col(raw).rlike(r"\d"), F.col(raw)).otherwise(F.concat(F.lit("\0"), F.spark_partition_id().cast("string"))),
                names["tz"]: F.coalesce(F.col(tz), blank) if tz else blank,
                names["date_order"]: F.coalesce(F.col(order), blank) if order else blank,
            }
        )
        keys = keyed.select(*[F.col(v).alias(k) for k, v in names.items()]).where(~F.col("raw").startswith("\0")).distinct()
        if self.parts:
            keys = keys.join(self.entries().select("raw", "tz", "date_order"), ["raw", "tz", "date_order"], "left_anti")
        # parts have names of their own, so two writers never overwrite each other; what both parsed is met once below
        part = f"{self.root.rstrip('/')}/part-{len(self.parts):06d}-{uuid.uuid4().hex[:8]}"
        cores = self.spark.sparkContext.defaultParallelism
        fresh, seen = keys.select("raw", "tz", "date_order").repartition(cores), Observation()
        with_instants(fresh, "raw", "tz", "date_order").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(part)
        if seen.get["n"]:
            self.parts.append(part)
        else:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(part)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        book = self.entries().groupBy("raw", "tz", "date_order").agg(F.min("utc_us").alias("utc_us"))
        # a text held by many rows is spread over salts, and so are the dictionary's entries
        salt = free_name(df, "_td_salt")
        book = book.select(*[F.col(k).alias(v) for k, v in names.items()], F.col("utc_us").alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        keyed = keyed.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        return keyed.join(book, [*names.values(), salt], "left").drop(*names.values(), salt)


def with_profile(df: DataFrame, profiles: DataFrame, tab: str, scope: str) -> DataFrame:
    """``df`` with ``tz_name`` and ``date_order`` of its row in ``profiles`` (null scope meets null scope)."""
    known = (
        profiles.groupBy(F.col("tab").alias(tab), F.col("scope").alias("_scope"))
        .agg(F.min("tz_name").alias("tz_name"), F.min("date_order").alias("date_order"))
    )
    same = df[tab].eqNullSafe(known[tab]) & df[scope].eqNullSafe(known["_scope"])
    return df.join(known, same, "left").drop(known[tab]).drop("_scope")


def url_host(url: F.Column) -> F.Column:
    """Lower-case host of a URL, without user, port and ``www.``; null if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.|\.$", ""), F.lit(""))


def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``published_at`` of the four content tables: tab, rec_id, published_at, tz_name, date_order."""
    scopes = {
        "azure_updates": ("update_id", F.lit(None).cast("string")),
        "techcommunity_posts": ("post_id", F.col("blog_section")),
        "videos": ("video_row", F.col("channel_id")),
        "blog_posts": ("blog_id", url_host(F.col("url"))),
    }
    parts = [
        spark.read.parquet(f"{sf_dir}/{tab}.parquet").select(F.lit(tab).alias("tab"), F.col(key).alias("rec_id"), "published_at", scope.alias("scope"))
        for tab, (key, scope) in scopes.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return with_profile(rows, spark.read.parquet(f"{sf_dir}/source_profiles.parquet"), "tab", "scope").drop("scope")
