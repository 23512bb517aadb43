"""Queries of search, upload and roll-ups, with their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval, search, sink
from ..session import cut, fresh_dir, table
from .catalog import ROUTES, TERMS, contains_any, query

LAYERS, TYPES = ["work_iq", "fabric_iq"], ["azure-update", "update"]
_HELD = "list_has_any(iq_layers, ['work_iq', 'fabric_iq']) AND lower(source_type) IN ('azure-update', 'update')"
_SCORED = f"""
WITH q AS (SELECT doc_id AS q, unnest(list_distinct({TERMS.format("title")})) AS term FROM documents WHERE doc_id % 100 = 0),
d AS (SELECT update_id AS d, {TERMS.format("summary")} AS t FROM azure_updates WHERE {_HELD}),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM d WHERE len(t) > 0),
p AS (SELECT d, len(t) AS l, unnest(t) AS term FROM d),
tf AS (SELECT term, d, l, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
h AS (SELECT q.q, tf.d, round(sum(ln(1 + (s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.l / s.mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2),
r AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INTEGER AS rank FROM h QUALIFY rank <= 10)
"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth document's title against the updates of two layers and two types: doc_id, update_id, score, rank."""
    u = table(spark, sf, "azure_updates")
    held = u.where(search.facets(any_layers=(F.col("iq_layers"), LAYERS), types=(F.col("source_type"), TYPES)))
    questions = table(spark, sf, "documents").where("doc_id % 100 = 0").select("doc_id", "title")
    return retrieval.bm25(held, "update_id", "summary", questions, "doc_id", "title")


@query(_SCORED + "SELECT q AS doc_id, d AS update_id, score, rank FROM r")
def search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Full-text search within a filter on layers and types."""
    return _hits(spark, sf)


@query(_SCORED + "SELECT q AS doc_id, rank, title, substr(summary, 1, 600) AS content, url, score, array_to_string(list_filter(coalesce(iq_layers, []), lambda x: x IS NOT NULL), ',') AS layers FROM r JOIN azure_updates ON update_id = d")
def search_tool(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as a tool returns them: title, 600 characters, url, score, layers."""
    u = table(spark, sf, "azure_updates").select("update_id", "title", F.substring("summary", 1, 600).alias("content"), "url", F.array_join(X.string_list(F.col("iq_layers")), ",").alias("layers"))
    return _hits(spark, sf).join(u, "update_id").select("doc_id", "rank", "title", "content", "url", "score", "layers")


@query(
    _SCORED
    + f""", c AS (SELECT r.q, r.d, r.rank, r.score, u.url, u.title, u.source_type, u.iq_layers, coalesce(u.summary, '') AS body, {TERMS.format("b.title")} AS qt FROM r JOIN azure_updates u ON update_id = r.d JOIN documents b ON doc_id = r.q),
s2 AS (SELECT *, list_filter(string_split_regex(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS pieces FROM c),
m AS (SELECT *, list_transform(pieces, lambda x, i: {{'n': len(list_intersect(list_distinct({TERMS.format("x")}), qt)), 'at': -i, 's': x}}) AS marked FROM s2),
e AS (SELECT *, list_sort(marked, 'DESC')[1] AS best FROM m)
SELECT q AS doc_id, rank, url, title, score, array_to_string(list_filter(coalesce(iq_layers, []), lambda x: x IS NOT NULL), ', ') AS layers, substr(CASE WHEN best.n > 0 THEN best.s ELSE body END, 1, 300) AS caption FROM e"""
)
def search_api(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as the search endpoint returns them: the best sentence as caption, else the head of the text."""
    u = table(spark, sf, "azure_updates").select("update_id", "url", "title", "summary", F.array_join(X.string_list(F.col("iq_layers")), ", ").alias("layers"))
    q = table(spark, sf, "documents").select("doc_id", retrieval.terms(F.col("title")).alias("terms"))
    rows = _hits(spark, sf).join(u, "update_id").join(q, "doc_id")
    return rows.select("doc_id", "rank", "url", "title", "score", "layers", search.caption(F.col("summary"), F.col("terms")).alias("caption"))


_SHARE = "len(list_intersect(qt, list_distinct({0})))::DOUBLE / greatest(len(qt), 1)"


@query(
    _SCORED
    + f""", c AS (SELECT r.q, r.d, r.rank, list_distinct({TERMS.format("b.title")}) AS qt, {TERMS.format("u.title")} AS t, {TERMS.format("array_to_string(u.azure_services, ' ')")} AS n, {TERMS.format("u.summary")} AS s FROM r JOIN azure_updates u ON update_id = r.d JOIN documents b ON doc_id = r.q),
e AS (SELECT q, d, rank, round(2.5::DOUBLE * ({_SHARE.format("t")}) + 1.5::DOUBLE * ({_SHARE.format("n")}) + {_SHARE.format("s")}, 6) AS rerank_score FROM c)
SELECT q AS doc_id, d AS update_id, rerank_score, row_number() OVER (PARTITION BY q ORDER BY rerank_score DESC, rank, d)::INTEGER AS new_rank FROM e"""
)
def search_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Hits by the weighted share of the question's terms in title, names and body."""
    u = table(spark, sf, "azure_updates").select("update_id", "title", "azure_services", "summary")
    q = table(spark, sf, "documents").select("doc_id", F.array_distinct(retrieval.terms(F.col("title"))).alias("terms"))
    rows = search.rerank(_hits(spark, sf).join(u, "update_id").join(q, "doc_id"), "doc_id", "terms", "title", "azure_services", "summary", "update_id")
    return rows.select("doc_id", "update_id", "rerank_score", "new_rank")


@query("SELECT update_id, title, url FROM azure_updates WHERE crawled_at >= TIMESTAMPTZ '2025-06-30 00:00:00+00' - INTERVAL 90 DAY AND crawled_at <= TIMESTAMPTZ '2025-06-30 00:00:00+00' AND lower(source_type) IN ('azure-update', 'rss') AND list_has_any(iq_layers, ['work_iq', 'fabric_iq']) ORDER BY crawled_at DESC, update_id LIMIT 20")
def recent_updates(spark: SparkSession, sf: str) -> DataFrame:
    """All updates of the last 90 days of two layers and two types, the latest twenty (a top-k report)."""
    rows = search.recent(table(spark, sf, "azure_updates"), "crawled_at", "2025-06-30 00:00:00+00:00", 90)
    held = rows.where(search.facets(types=(F.col("source_type"), ["azure-update", "rss"]), any_layers=(F.col("iq_layers"), LAYERS)))
    return held.orderBy(F.desc("crawled_at"), "update_id").limit(20).select("update_id", "title", "url")


@query(
    r"""WITH x AS (SELECT update_id, summary, iq_layers, url, unnest(list_distinct(azure_services)) AS name FROM azure_updates),
r AS (SELECT * FROM x WHERE name IS NOT NULL),
b AS (SELECT name, count(*) AS n, arg_min(summary, update_id) FILTER (WHERE regexp_matches(summary, '\S')) AS description FROM r GROUP BY 1),
l AS (SELECT name, array_to_string(list_sort(list(DISTINCT l)), ',') AS labels FROM (SELECT name, unnest(iq_layers) AS l FROM r) WHERE l IS NOT NULL GROUP BY 1),
f AS (SELECT name, url, min(update_id) AS k FROM r WHERE url IS NOT NULL GROUP BY 1, 2),
g AS (SELECT name, url, row_number() OVER (PARTITION BY name ORDER BY k, url) AS i FROM f QUALIFY i <= 3),
h AS (SELECT name, string_agg(url, ' ' ORDER BY i) AS urls FROM g GROUP BY 1)
SELECT name, n, description, coalesce(labels, '') AS labels, coalesce(urls, '') AS urls FROM b LEFT JOIN l USING (name) LEFT JOIN h USING (name)"""
)
def service_details(spark: SparkSession, sf: str) -> DataFrame:
    """Per service the rows, first description, labels and first three sources."""
    return search.details(table(spark, sf, "azure_updates"), "azure_services", "update_id", "summary", "iq_layers", "url")


@query("SELECT source_type, n, sum(n) OVER ()::BIGINT AS total FROM (SELECT coalesce(lower(source_type), 'unknown') AS source_type, count(*) AS n FROM documents GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, source_type) <= 50")
def facet_top(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty commonest source types with the total of all rows (a top-k report)."""
    counts = table(spark, sf, "documents").groupBy(F.coalesce(F.lower("source_type"), F.lit("unknown")).alias("source_type")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).head()["total"]  # one number
    return counts.orderBy(F.desc("n"), "source_type").limit(50).withColumn("total", F.lit(total).cast("bigint"))


_RULES = "list_filter([" + ", ".join(f"CASE WHEN {contains_any('t', k)} THEN '{n}' END" for n, k in ROUTES) + ", 'design', CASE WHEN content_type = 'announcement' THEN 'news' ELSE 'guide' END], lambda x: x IS NOT NULL)"


@query(f"SELECT update_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS targets FROM (SELECT update_id, {_RULES} AS m FROM (SELECT update_id, lower(coalesce(title, '')) AS t, content_type FROM azure_updates))")
def target_union(spark: SparkSession, sf: str) -> DataFrame:
    """All targets of a question: those of the rules, the default, a supplement; each once, first ones first."""
    low = F.lower(F.coalesce("title", F.lit("")))
    rules = F.array(*[F.when(X.any_of(low, k), F.lit(n)) for n, k in ROUTES])
    more = F.array(F.when(F.col("content_type") == "announcement", "news").otherwise("guide"))
    return table(spark, sf, "azure_updates").select("update_id", F.array_join(search.first_wins(rules, F.array(F.lit("design")), more), ",").alias("targets"))


@query("SELECT update_id, array_to_string(list_sort(list_distinct(list_filter(coalesce(azure_services, []), lambda x: x IS NOT NULL AND x NOT IN ('Tupel Batch', 'Raeli Cache')))), ',') AS unknown FROM azure_updates")
def unknown_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names asked for that nothing is known of."""
    asked = X.string_list(F.col("azure_services"))
    return table(spark, sf, "azure_updates").select("update_id", F.array_join(F.array_sort(search.unknown_names(asked, ["Tupel Batch", "Raeli Cache"])), ",").alias("unknown"))


@query("WITH u AS (SELECT url, min(update_id) AS first, 0 AS branch FROM azure_updates WHERE url IS NOT NULL GROUP BY 1 UNION ALL SELECT url, min(post_id), 1 FROM techcommunity_posts WHERE url IS NOT NULL GROUP BY 1) SELECT url, branch, row_number() OVER (ORDER BY branch, first, url)::INTEGER AS n FROM u QUALIFY n <= 50")
def citation_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of one branch behind those of another, numbered through, the first fifty (a top-k report)."""
    parts = [table(spark, sf, t).where("url is not null").groupBy("url").agg(F.min(k).alias("first")).withColumn("branch", F.lit(i)) for i, (t, k) in enumerate((("azure_updates", "update_id"), ("techcommunity_posts", "post_id")))]
    head = parts[0].unionByName(parts[1]).orderBy("branch", "first", "url").limit(50)
    return head.withColumn("n", F.row_number().over(Window.orderBy("branch", "first", "url"))).select("url", "branch", "n")


@query("SELECT c.rec_id FROM chunk_fingerprints c WHERE c.batch_no > 0 AND c.fingerprint IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunk_fingerprints e WHERE e.batch_no = 0 AND e.fingerprint = c.fingerprint)")
def new_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Later chunks whose fingerprint, under whatever id, isn't known."""
    rows = table(spark, sf, "chunk_fingerprints")
    old = rows.where("batch_no = 0").select("fingerprint").distinct()
    return rows.where("batch_no > 0 and fingerprint is not null").join(old, "fingerprint", "left_anti").select("rec_id")


def _post(rows: list[dict]) -> tuple[int, str]:
    """A service that refuses every thirteenth document, and every seventh when it is sent with others."""
    ok = lambda r: r["rec_id"] % 13 != 0 and (r["rec_id"] % 7 != 0 or len(rows) == 1 or r.get("again"))
    return 207, json.dumps({"value": [{"key": str(r["rec_id"]), "status": 201 if ok(r) else 503, "errorMessage": None if ok(r) else "busy"} for r in rows]})


@query("SELECT CASE WHEN rec_id % 13 = 0 THEN 503 ELSE 201 END AS status, count(*) AS n FROM chunk_fingerprints WHERE rec_id % 7 <> 0 GROUP BY 1")
def upload_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Documents uploaded in batches, the failed ones once more; counts by final status."""
    docs = table(spark, sf, "chunk_fingerprints").where("rec_id % 7 <> 0").select("rec_id", "content")
    return cut(sink.upload(docs, "rec_id", _post, 500)).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT rec_id, chunk_id FROM chunk_fingerprints WHERE rec_id % 7 <> 0 AND rec_id % 13 = 0")
def upload_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """The documents whose upload failed for good."""
    docs = table(spark, sf, "chunk_fingerprints").where("rec_id % 7 <> 0").select("rec_id", "chunk_id", "content")
    statuses = cut(sink.upload(docs.select("rec_id", "content"), "rec_id", _post, 500))
    return sink.dead_letters(docs, statuses, "rec_id").select("rec_id", "chunk_id")


@query("SELECT 3 AS version, count(*) AS n FROM chunk_fingerprints WHERE batch_no <= 2")
def index_versions(spark: SparkSession, sf: str) -> DataFrame:
    """An index written in three versions of one folder: the number readers see and its rows."""
    rows = table(spark, sf, "chunk_fingerprints").select("rec_id", "chunk_id", "fingerprint", "batch_no")
    store = sink.IndexStore(spark, fresh_dir(spark, "index"))
    store.write(rows.where("batch_no = 0"))
    for b in (1, 2):
        version = store.write(store.current().unionByName(rows.where(F.col("batch_no") == b)))
    return store.current().agg(F.lit(version).alias("version"), F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT 'r' || run_id AS job, started_at AS t, unnest(CASE WHEN chunks_failed > 0 THEN ['started', 'running', 'failed'] ELSE ['started', 'running', 'completed'] END) AS s FROM pipeline_runs WHERE run_id IS NOT NULL)
SELECT job, CASE WHEN bool_or(s = 'failed') AND NOT bool_or(s = 'completed') THEN 'failed' ELSE 'completed' END AS state, CASE WHEN bool_or(s = 'failed') AND NOT bool_or(s = 'completed') THEN -1 ELSE 100 END::INTEGER AS progress, true AS valid FROM e GROUP BY 1"""
)
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    """State and progress of every job from its log (a run logged twice counts once)."""
    runs = table(spark, sf, "pipeline_runs").where("run_id is not null").groupBy("run_id").agg(F.min("started_at").alias("t"), F.min(F.coalesce(F.col("chunks_failed") > 0, F.lit(False))).alias("bad"))
    last = F.when(F.col("bad"), F.lit("failed")).otherwise(F.lit("completed"))
    steps = runs.select(F.concat(F.lit("r"), F.col("run_id").cast("string")).alias("job"), "t", F.posexplode(F.array(F.lit("started"), F.lit("running"), last)).alias("i", "s"))
    events = steps.select("job", (F.coalesce("t", F.lit("2000-01-01").cast("timestamp")) + F.make_dt_interval(secs=F.col("i").cast("decimal(18,6)"))).alias("t"), "s")
    return sink.job_states(events, "job", "t", "s")


@query("SELECT count(*) AS n, count(embedding) AS made, count(*) - count(embedding) AS failed FROM embeddings")
def vector_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors made and failed."""
    return table(spark, sf, "embeddings").agg(F.count("*").alias("n"), F.count("embedding").alias("made"), F.count_if(F.col("embedding").isNull()).alias("failed"))


@query()
def answer_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth title as a question, routed, answered from the documents and judged."""
    questions = table(spark, sf, "azure_updates").where("update_id % 100 = 0").select("update_id", "title")
    complete = lambda p: p.select("cache_key", F.substring("prompt", 1, 400).alias("answer"))
    return search.answers(questions, "update_id", "title", table(spark, sf, "documents"), "doc_id", "title", "url", "text", ROUTES, "design", complete)


@query()
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every hundredth vector by the inverted file of centroids."""
    v = table(spark, sf, "embeddings")
    index = retrieval.VectorIndex(spark, fresh_dir(spark, "vectors")).build(v, "vec_id", "embedding")
    return index.search(v.where("vec_id % 100 = 0"), "vec_id", "embedding")
