"""Queries of limits, caches, measurements and upkeep of an index, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..session import table
from ..streaming import rates
from .catalog import query

RULES = [("c", 2), ("v", 1)]
TIERS = {"click": 3600.0, "view": 604800.0, "error": 86400.0}


@query(
    """WITH RECURSIVE b AS (SELECT event_id, user_id, epoch_us(ts) AS us, ts, CASE WHEN starts_with(event_type, 'c') THEN 'c' WHEN starts_with(event_type, 'v') THEN 'v' END AS rule FROM events WHERE ts IS NOT NULL),
e AS (SELECT *, CASE WHEN rule = 'c' THEN 2 ELSE 1 END AS lim, row_number() OVER (PARTITION BY user_id, rule ORDER BY ts, event_id) AS i FROM b WHERE rule IS NOT NULL),
r AS (SELECT event_id, user_id, rule, i, true AS allowed, us AS last, NULL::BIGINT AS before FROM e WHERE i = 1
UNION ALL SELECT event_id, user_id, rule, i, ok, CASE WHEN ok THEN us ELSE last END, CASE WHEN ok THEN last ELSE before END
  FROM (SELECT e.*, r.last, r.before, r.last <= e.us - 7200000000 OR (lim = 2 AND coalesce(r.before <= e.us - 7200000000, true)) AS ok FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.rule = r.rule AND e.i = r.i + 1))
SELECT event_id, rule, CASE WHEN allowed THEN 200 ELSE 429 END AS status FROM r UNION ALL SELECT event_id, NULL, 200 FROM b WHERE rule IS NULL"""
)
def rate_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every event under the first rule its path falls under."""
    e = table(spark, sf, "events").where("ts is not null").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return rates.rate_rules(e, ["user_id"], "event_type", RULES, "ts", "event_id", 7200.0).select("event_id", "rule", "status")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CASE event_type WHEN 'click' THEN 3600000000 WHEN 'view' THEN 604800000000 ELSE 86400000000 END AS life,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL AND event_type IN ('click', 'view', 'error')),
r AS (SELECT event_id, user_id, event_type, i, false AS hit, us AS since FROM e WHERE i = 1
UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.i, e.us < r.since + e.life, CASE WHEN e.us < r.since + e.life THEN r.since ELSE e.us END
  FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.event_type = r.event_type AND e.i = r.i + 1)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM r GROUP BY 1"""
)
def cache_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a cache whose lifetime depends on the kind of entry."""
    e = table(spark, sf, "events").where(F.col("ts").isNotNull() & F.col("event_type").isin(list(TIERS))).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows = rates.cached_by_tier(e, ["user_id", "event_type"], "event_type", TIERS, "ts", "event_id")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles per kind of event (counts per value are merged, so a hot kind is pre-aggregated)."""
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 4)
    return table(spark, sf, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query(
    """SELECT update_id, round(least(0.95::DOUBLE, greatest(0.1::DOUBLE, CASE WHEN lower(source_type) = 'azure-update' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END
+ 0.3::DOUBLE * CASE WHEN date_diff('day', crawled_at, TIMESTAMPTZ '2025-07-01 00:00:00+00') >= 0 AND date_diff('day', crawled_at, TIMESTAMPTZ '2025-07-01 00:00:00+00') < 90
  THEN 1.5::DOUBLE - 0.5::DOUBLE * date_diff('day', crawled_at, TIMESTAMPTZ '2025-07-01 00:00:00+00') / 90.0::DOUBLE ELSE 1.0::DOUBLE END
- CASE WHEN contains(lower(coalesce(title, '')), 'retire') THEN 0.4::DOUBLE ELSE 0 END)), 6) AS trust FROM azure_updates"""
)
def source_trust(spark: SparkSession, sf: str) -> DataFrame:
    """Trust in a source by authority, age and status (as of a fixed day)."""
    age = F.datediff(F.lit("2025-07-01 00:00:00+00:00").cast("timestamp"), F.col("crawled_at"))
    base = F.when(F.lower("source_type") == "azure-update", 0.5).otherwise(0.3)
    gone = F.when(F.lower(F.coalesce("title", F.lit(""))).contains("retire"), 0.4).otherwise(0.0)
    return table(spark, sf, "azure_updates").select("update_id", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.1), base + 0.3 * search.freshness(age) - gone)), 6).alias("trust"))


@query(
    """WITH g AS (SELECT DISTINCT unnest(azure_services) AS s FROM azure_updates WHERE contains(lower(coalesce(title, '')), 'retire'))
SELECT update_id, list_has_any(list_filter(coalesce(azure_services, []), lambda x: x IS NOT NULL), (SELECT list(s) FROM g WHERE s IS NOT NULL)) AS deprecated FROM azure_updates"""
)
def deprecation_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Updates tagged anew where any of their services is told to retire."""
    u = table(spark, sf, "azure_updates")
    gone = u.where(F.lower(F.coalesce("title", F.lit(""))).contains("retire")).select(F.explode("azure_services").alias("s")).where("s is not null").distinct()
    hit = u.select("update_id", F.explode("azure_services").alias("s")).join(gone, "s", "left_semi").select("update_id").distinct().withColumn("hit", F.lit(True))
    return u.join(hit, "update_id", "left").select("update_id", F.coalesce("hit", F.lit(False)).alias("deprecated"))
