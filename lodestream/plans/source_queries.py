"""Queries of sources and their records, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import table
from ..sources import records
from .catalog import LABELS, NAMES, contains_any, query

PREFIXES = {"docs": ["/ms-learn/", "/docs"], "design": ["/architecture"], "news": ["/azure-update", "/blog"]}
_BARE = "regexp_replace(lower(trim({0})), '[-_ ]', '', 'g')"
_TYPES = f"t AS (SELECT {_BARE.format('a')} AS a, min(source_type) AS t FROM (SELECT unnest(list_append(coalesce(aliases, []), source_type)) AS a, source_type FROM chunk_config) GROUP BY 1)"


@query(f"WITH {_TYPES} SELECT doc_id, t.t AS canonical, CASE WHEN t.t = 'azure-update' THEN 'whole' WHEN t.t = 'video-transcript' THEN 'transcript' ELSE 'document' END AS strategy FROM documents LEFT JOIN t ON t.a = {_BARE.format('source_type')}")
def source_types(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical source type of every document, and how its text is cut."""
    rows = table(spark, sf, "documents").select("doc_id", records.resolve_type(F.col("source_type"), table(spark, sf, "chunk_config")).alias("canonical"))
    return rows.withColumn("strategy", records.strategy(F.col("canonical")))


_FEED = "SELECT update_id, url, coalesce(title, '') AS title, coalesce(trim(regexp_replace(summary, '<[^>]+>', ' ', 'g')), '') AS summary, categories FROM azure_updates"


@query(
    f"WITH f AS ({_FEED}), h AS (SELECT *, lower(title || ' ' || summary) AS hay FROM f), l AS (SELECT *, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {contains_any('hay', s)} THEN '{k}' END" for k, s in LABELS.items())
    + "], lambda x: x IS NOT NULL), ',') AS ls, regexp_extract_all(title || ' ' || summary, '" + "|".join(NAMES) + "') AS m FROM h) "
    "SELECT url, title, summary, array_to_string(list_filter(coalesce(categories, []), lambda x: x IS NOT NULL), ',') AS categories, sha256(coalesce(url, '') || ':' || title || ':' || summary) AS fingerprint, CASE WHEN ls = '' THEN 'general' ELSE ls END AS labels, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS names FROM l"
)
def feed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Feed entries as records with bare summary, labels, names and fingerprint."""
    rows = records.feed_records(table(spark, sf, "azure_updates").withColumnRenamed("url", "link"), LABELS, NAMES)
    lists = {c: F.array_join(c, ",") for c in ("categories", "labels", "names")}
    return rows.withColumns(lists).drop("published_at")


@query(
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY blog_id) AS r FROM blog_posts WHERE url IS NOT NULL AND published_at > '2021' AND url NOT IN (SELECT url FROM blog_posts WHERE blog_id % 5 = 0 AND url IS NOT NULL))
SELECT blog_id, url, title, published_at, coalesce(body_text, summary, '') AS body, substr(coalesce(summary, ''), 1, 500) AS summary FROM p WHERE r = 1"""
)
def blog_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of blogs after a mark, without those seen."""
    b = table(spark, sf, "blog_posts").select("blog_id", "url", "title", "body_text", "summary", "published_at")
    return records.blog_scan(b, "blog_id", "url", "published_at", "2021", b.where("blog_id % 5 = 0 and url is not null").select("url"))


_PATH = r"lower(regexp_extract(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/]*)?(/[^?#]*)', 1))"
_PREFIXED = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"starts_with(path, '{p}')" for p in ps) + f" THEN '{k}' END" for k, ps in PREFIXES.items()) + "], lambda x: x IS NOT NULL)"
_SIGNALS = "list_filter([" + ", ".join(f"CASE WHEN {contains_any('low', s)} THEN '{k}' END" for k, s in LABELS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string(list_sort(CASE WHEN len(p) > 0 THEN p ELSE s END), ',') AS labels FROM (SELECT doc_id, {_PREFIXED} AS p, {_SIGNALS} AS s FROM (SELECT doc_id, {_PATH} AS path, lower(coalesce(text, '')) AS low FROM documents))")
def page_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of pages by the prefix of their address, else by their text."""
    labels = records.prefix_labels(F.col("url"), F.col("text"), PREFIXES, LABELS)
    return table(spark, sf, "documents").select("doc_id", F.array_join(labels, ",").alias("labels"))


@query(f"SELECT blog_id, array_to_string(list_sort({_SIGNALS}), ',') AS labels FROM (SELECT blog_id, lower(coalesce(title, '') || ' ' || coalesce(body_text, '')) AS low FROM blog_posts)")
def blog_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted labels of blog posts, none where no signal occurs."""
    hay = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit("")))
    return table(spark, sf, "blog_posts").select("blog_id", F.array_join(F.array_sort(X.labels(hay, LABELS)), ",").alias("labels"))


@query(
    """WITH s AS (SELECT DISTINCT unnest(processed_video_ids) AS v FROM video_checkpoints WHERE run_status = 'succeeded'),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY video_row) AS r FROM videos WHERE video_id IS NOT NULL AND video_id NOT IN (SELECT v FROM s WHERE v IS NOT NULL))
SELECT video_row, video_id, CASE WHEN starts_with(video_id, 'http') THEN video_id ELSE 'https://www.youtube.com/watch?v=' || video_id END AS url, coalesce(duration_iso, 'PT0S') AS duration_iso, CASE WHEN view_count > 0 THEN view_count ELSE 0 END AS view_count,
CASE WHEN coalesce(transcript_text, '') <> '' THEN coalesce(transcript_language, 'unknown') ELSE 'unknown' END AS transcript_language, length(coalesce(transcript_text, '')) AS n_chars, coalesce(len(transcript_segments), 0)::INTEGER AS n_segments FROM o WHERE r = 1"""
)
def video_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Videos not yet handled, with details and transcript or their defaults."""
    rows = records.video_catalog(table(spark, sf, "videos"), table(spark, sf, "video_checkpoints"))
    return rows.select("video_row", "video_id", "url", "duration_iso", "view_count", "transcript_language", F.length("transcript_text").cast("bigint").alias("n_chars"), "n_segments")


@query("SELECT update_id, coalesce(nullif(source_type, ''), '') AS types, array_to_string(list_filter(coalesce(categories, []), lambda x: x IS NOT NULL), ',') AS categories FROM azure_updates")
def string_collections(spark: SparkSession, sf: str) -> DataFrame:
    """Single texts and arrays as lists of texts."""
    u = table(spark, sf, "azure_updates")
    return u.select("update_id", F.array_join(X.one_or_none(F.col("source_type")), ",").alias("types"), F.array_join(X.string_list(F.col("categories")), ",").alias("categories"))
