"""Selecting the records that the last successful run of a crawler does not cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, table
from .instants import TimestampDictionary, with_profile
from .ledger import WorkLedger


def content_key(*columns: str) -> F.Column:
    """One digest of several nullable texts; null differs from the empty text."""
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]))


def first_rows(df: DataFrame, key: str, same: list[str], keep: list[str]) -> DataFrame:
    """Of the rows equal in ``same`` (nulls equal) the one with the smallest ``key``; rows without key are left out.

    The minimum is taken map-side, so a text held by a third of all rows costs one row per task.
    """
    best = (
        df.where(F.col(key).isNotNull())
        .groupBy(content_key(*same).alias("_same"))
        .agg(F.min(F.struct(key, *keep)).alias("_first"))
    )
    return best.select("_first.*")


def last_state(checkpoints: DataFrame, crawler: str) -> DataFrame:
    """The succeeded row of ``crawler`` with the greatest ``last_run`` (none: empty)."""
    rows = checkpoints.where((F.col("crawler") == crawler) & (F.col("run_status") == "succeeded") & F.col("last_run").isNotNull())
    return rows.groupBy().agg(F.max_by(F.struct("last_run", "last_seen_published_at", "last_seen_per_section"), F.struct("last_run", "run_id")).alias("s")).where("s is not null").select("s.*")


def uncovered(
    spark: SparkSession,
    updates: DataFrame,
    posts: DataFrame,
    videos: DataFrame,
    crawls: DataFrame,
    video_runs: DataFrame,
    profiles: DataFrame,
    dictionary: TimestampDictionary,
) -> DataFrame:
    """(tab, rec_id) of every record that the last successful state does not cover.

    Updates and posts count by a publication instant after the mark or a crawl
    after the run; posts of a section without a mark always count; videos count
    if no succeeded run lists them.  Later copies of a record never count.
    """
    text = F.lit(None).cast("string")
    u = first_rows(updates, "update_id", ["url", "title", "summary"], ["published_at", "crawled_at"])
    p = first_rows(posts, "post_id", ["url", "title", "body_text"], ["published_at", "crawled_at", "blog_section"])
    rows = u.select(F.lit("azure_updates").alias("tab"), F.col("update_id").alias("rec_id"), "published_at", "crawled_at", text.alias("scope")).unionByName(
        p.select(F.lit("techcommunity_posts").alias("tab"), F.col("post_id").alias("rec_id"), "published_at", "crawled_at", F.col("blog_section").alias("scope"))
    )
    # the two states are one row each
    feed = last_state(crawls, "azure-updates").select("last_run", "last_seen_published_at").head()
    sections = last_state(crawls, "techcommunity").select("last_run").head()
    runs = {"azure_updates": feed and feed["last_run"], "techcommunity_posts": sections and sections["last_run"]}
    none = F.lit(None).cast("timestamp")
    last_run = F.when(F.col("tab") == "azure_updates", F.lit(runs["azure_updates"]).cast("timestamp") if runs["azure_updates"] else none)
    last_run = last_run.otherwise(F.lit(runs["techcommunity_posts"]).cast("timestamp") if runs["techcommunity_posts"] else none)
    marks = last_state(crawls, "techcommunity").select(F.lit("techcommunity_posts").alias("tab"), F.explode("last_seen_per_section").alias("scope", "mark"))
    marks = last_state(crawls, "azure-updates").select(F.lit("azure_updates").alias("tab"), text.alias("scope"), F.col("last_seen_published_at").alias("mark")).unionByName(marks)
    marks = dictionary.resolve(marks, "mark", out="mark_us").select(F.col("tab").alias("m_tab"), F.col("scope").alias("m_scope"), "mark_us", F.lit(True).alias("marked"))
    rows = dictionary.resolve(with_profile(rows, profiles, "tab", "scope"), "published_at", "tz_name", "date_order", "pub_us")
    rows = rows.join(marks, (rows["tab"] == marks["m_tab"]) & rows["scope"].eqNullSafe(marks["m_scope"]), "left")
    after = (
        (F.col("pub_us") > F.col("mark_us"))
        | (F.col("crawled_at") > last_run)
        | ((F.col("tab") == "techcommunity_posts") & F.col("marked").isNull())
    )
    seen = video_runs.where(F.col("run_status") == "succeeded").select(F.explode("processed_video_ids").alias("video_id")).distinct()
    first = videos.where(F.col("video_row").isNotNull()).groupBy("video_id").agg(F.min("video_row").alias("rec_id"))
    new = first.join(seen, "video_id", "left_anti").select(F.lit("videos").alias("tab"), "rec_id")
    return rows.where(after).select("tab", "rec_id").unionByName(new)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records the crawlers still have to take, delivered once each through the work ledger."""
    get = lambda name: table(spark, sf_dir, name)
    root = fresh_dir(spark, "p1")
    open_rows = uncovered(
        spark, get("azure_updates"), get("techcommunity_posts"), get("videos"), get("crawl_checkpoints"),
        get("video_checkpoints"), get("source_profiles"), TimestampDictionary(spark, f"{root}/dictionary"),
    )
    ledger = WorkLedger(spark, f"{root}/ledger")
    ledger.enqueue(open_rows, ["tab", "rec_id"], "run-1")
    while lease := ledger.lease("p1"):
        ledger.run(lease, lambda items: items.select("tab", "rec_id"))
    done = ledger.results()
    return done if done is not None else spark.createDataFrame([], "tab string, rec_id bigint")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of all ``published_at`` texts not yet in the one normal form."""
    from .instants import published_rows

    rows = published_rows(spark, sf_dir).where(~F.col("published_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"))
    book = TimestampDictionary(spark, fresh_dir(spark, "p3"))
    return book.resolve(rows, "published_at", "tz_name", "date_order").where("utc_us is not null").select("tab", "rec_id", "utc_us")
