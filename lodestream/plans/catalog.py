"""Query catalogue of the core: name -> callable, and the matching DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, index, retrieval
from ..operators.increments import p1_found, p3_found
from ..session import table
from ..streaming import rates

# Neutral vocabularies of the example queries; the operators take any.
LABELS = {
    "data": ["lakehouse", "dataset", "partition", "table", "catalog"],
    "models": ["embedding", "vector", "classifier", "inference", "tokenizer"],
    "work": ["calendar", "mailbox", "notebook", "workspace"],
}
NAMES = ["Tupel Batch", "Raeli Cache", "Oripi Notebook", "Phavo Batch", "Midol Ledger", "Basstra Lake", "Yorkel Batch", "Tasra Cache", "Pelama Vault"]
ROUTES = [("news", ["preview", "retire", "release"]), ("compare", [" vs ", "versus", "compare"]), ("guide", ["how we", "how to", "limits", "support"]), ("design", ["inside", "pattern", "architecture"])]

Q: dict = {"p1_found": p1_found, "p3_found": p3_found}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def contains_any(column: str, signals: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{s}')" for s in signals) + ")"


WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[ \t\n\r\f]+'), lambda w: w <> '')"
TOKENS = "(len({0}) * 13 // 10)::INTEGER"
TRIM = r"regexp_replace({0}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
_BLOCKS = f"""
WITH w AS (SELECT doc_id, source_type, {WORDS.format("text")} AS w FROM documents),
b AS (SELECT doc_id, source_type, w, unnest(range(0, (len(w) + 511) // 512)) AS i, (len(w) + 511) // 512 AS total FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, source_type, i, total,
  CASE WHEN i = 0 THEN array_to_string(w[1:512], ' ')
  ELSE array_to_string(w[i * 512 - 127 : i * 512], ' ') || chr(10) || chr(10) || array_to_string(w[i * 512 + 1 : i * 512 + 512], ' ') END AS content,
  CASE WHEN i = 0 THEN least(len(w), 512) ELSE 128 + least(len(w) - i * 512, 512) END AS nw FROM b)
"""


# -- chunking -----------------------------------------------------------------
@query(_BLOCKS + "SELECT doc_id::VARCHAR AS source_url, i::INTEGER AS chunk_index, total::INTEGER AS total_chunks, content, (nw * 13 // 10)::INTEGER AS token_count, sha256(doc_id || ':' || i) AS chunk_id, sha256(content) AS fingerprint FROM c")
def chunk_word_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as exact word blocks with overlap, ids and fingerprints."""
    return chunking.chunk_word_blocks(table(spark, sf, "documents"), "doc_id", "text")


@query(
    _BLOCKS
    + """SELECT coalesce(lower(source_type), 'unknown') AS source_type, count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks, sum(nw * 13 // 10)::BIGINT AS n_tokens FROM c GROUP BY 1"""
)
def chunk_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: documents to chunks to facet counts by source type."""
    docs = table(spark, sf, "documents").withColumn("source_type", F.coalesce(F.lower("source_type"), F.lit("unknown")))
    chunks = chunking.chunk_word_blocks(docs, "doc_id", "text", keep=["source_type"])
    return chunks.groupBy("source_type").agg(F.count_if(F.col("chunk_index") == 0).alias("n_documents"), F.count("*").alias("n_chunks"), F.sum("token_count").cast("bigint").alias("n_tokens"))


@query(f"WITH c AS (SELECT url AS source_url, {TRIM.format('summary')} AS content FROM azure_updates) SELECT source_url, content, {TOKENS.format(WORDS.format('content'))} AS token_count, sha256(coalesce(source_url, '') || ':0') AS chunk_id, sha256(content) AS fingerprint FROM c WHERE content <> ''")
def chunk_atomic(spark: SparkSession, sf: str) -> DataFrame:
    """Updates, one chunk each."""
    return chunking.chunk_whole(table(spark, sf, "azure_updates"), "url", "summary")


@query(
    f"""WITH w AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), b AS (SELECT doc_id, w, unnest(range(0, (len(w) + 255) // 256)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, (i // 4)::INTEGER AS parent_no, (i % 4)::INTEGER AS child_no, array_to_string(w[i * 256 + 1 : i * 256 + 256], ' ') AS content FROM b"""
)
def chunk_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels of blocks: small ones to search, large ones to read."""
    return chunking.parents_and_children(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT count(*) FILTER (WHERE regexp_full_match(chunk_id, 'a.*')) AS dropped, count(*) FILTER (WHERE NOT regexp_full_match(chunk_id, 'a.*')) AS kept FROM chunk_fingerprints")
def cache_invalidate(spark: SparkSession, sf: str) -> DataFrame:
    """Entries a pattern drops and keeps."""
    hit = X.matches_glob(F.col("chunk_id"), "a*")
    return table(spark, sf, "chunk_fingerprints").agg(F.count_if(hit).alias("dropped"), F.count_if(~hit).alias("kept"))


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Post bodies by heading, paragraph and sentence."""
    return chunking.chunk_documents(table(spark, sf, "techcommunity_posts"), "url", "body_text")


@query()
def chunk_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts by silence and size, with time header."""
    return chunking.group_transcripts(table(spark, sf, "videos"), "video_row", "title", "transcript_segments")


_SEGMENTS = f"""
WITH r AS (SELECT video_row, unnest(range(0, len(transcript_segments))) AS raw_pos, unnest(transcript_segments) AS s FROM videos),
seg AS (SELECT video_row, raw_pos::INTEGER AS raw_pos, {TRIM.format('s.text')} AS text, s.start AS start_time, coalesce(s.end_time, s.start + s.duration, s.start) AS end_time
  FROM r WHERE regexp_matches(s.text, '[^ \\t\\n\\r\\f]'))
"""


@query(_SEGMENTS + "SELECT * FROM seg")
def transcript_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with one notion of their end, blank ones dropped."""
    return chunking.transcript_segments(table(spark, sf, "videos"), "video_row", "transcript_segments")


@query(
    _SEGMENTS
    + """, l AS (SELECT *, CASE WHEN start_time - lag(end_time) OVER (PARTITION BY video_row ORDER BY raw_pos) > 30.0 THEN 1 ELSE 0 END AS f FROM seg),
g AS (SELECT *, sum(f) OVER (PARTITION BY video_row ORDER BY raw_pos ROWS UNBOUNDED PRECEDING) AS group_no FROM l)
SELECT video_row, group_no::BIGINT AS group_no, count(*) AS n_segments, arg_min(start_time, raw_pos) AS start_time, arg_max(end_time, raw_pos) AS end_time FROM g GROUP BY 1, 2"""
)
def transcript_gap_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Topic groups by silence alone."""
    seg = chunking.transcript_segments(table(spark, sf, "videos"), "video_row", "transcript_segments")
    grouped = chunking.gap_groups(seg, "video_row", 30.0).groupBy("video_row", "group_no")
    return grouped.agg(F.count("*").alias("n_segments"), F.min_by("start_time", "raw_pos").alias("start_time"), F.max_by("end_time", "raw_pos").alias("end_time"))


# -- hashing and text ----------------------------------------------------------
@query(
    """SELECT 'update' AS kind, update_id AS id, sha256(coalesce(url,'')||':'||coalesce(title,'')||':'||coalesce(summary,'')) AS fp FROM azure_updates
UNION ALL SELECT 'post', post_id, sha256(coalesce(url,'')||':'||coalesce(title,'')||':'||coalesce(substr(body_text,1,2048),'')) FROM techcommunity_posts
UNION ALL SELECT 'blog', blog_id, sha256(coalesce(url,'')||'|'||coalesce(title,'')||'|'||coalesce(substr(body_text,1,2048),'')) FROM blog_posts
UNION ALL SELECT 'video', video_row, sha256(coalesce(video_id,'')||':'||coalesce(transcript_text,'')) FROM videos
UNION ALL SELECT 'document', doc_id, sha256(coalesce(url,'')||':'||coalesce(text,'')) FROM documents"""
)
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of every record by the rule of its kind."""
    c = F.col
    head = F.substring("body_text", 1, 2048)
    kinds = [
        ("update", "azure_updates", "update_id", X.sha_of(c("url"), c("title"), c("summary"))),
        ("post", "techcommunity_posts", "post_id", X.sha_of(c("url"), c("title"), head)),
        ("blog", "blog_posts", "blog_id", X.sha_of(c("url"), c("title"), head, sep="|")),
        ("video", "videos", "video_row", X.sha_of(c("video_id"), c("transcript_text"))),
        ("document", "documents", "doc_id", X.sha_of(c("url"), c("text"))),
    ]
    parts = [table(spark, sf, t).select(F.lit(k).alias("kind"), c(i).alias("id"), fp.alias("fp")) for k, t, i, fp in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT sha256({TRIM.format('text')}) AS fp, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal documents."""
    rows = table(spark, sf, "documents").where("text is not null").groupBy(F.sha2(F.regexp_replace("text", f"^{X.SPACE}|{X.SPACE}$", ""), 256).alias("fp"))
    return rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    r"""WITH q AS (SELECT update_id, regexp_replace(regexp_replace(lower(title), '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g') AS question, source_type FROM azure_updates)
SELECT update_id, question, sha256(coalesce(question,'') || '|default|{"source_type": "' || coalesce(source_type, 'any') || '"}') AS cache_key FROM q"""
)
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised questions and their cache keys."""
    rows = table(spark, sf, "azure_updates")
    key = X.cache_key(F.col("title"), F.lit("default"), {"source_type": F.coalesce("source_type", F.lit("any"))})
    return rows.select("update_id", X.normal_query(F.col("title")).alias("question"), key.alias("cache_key"))


@query(
    r"""SELECT update_id, trim(regexp_replace(summary, '<[^>]+>', ' ', 'g')) AS bare,
regexp_replace(regexp_replace(regexp_replace(summary, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS tidy,
substr(regexp_replace(title, '[^a-zA-Z0-9_ -]', '', 'g'), 1, 64) AS filter_value, regexp_replace(source_type, '[^a-zA-Z0-9_-]', '_', 'g') AS safe_key, substr(summary, 1, 300) AS caption FROM azure_updates"""
)
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Tag stripping, white space, filter values, safe keys and captions."""
    s, c = F.col("summary"), F.col
    return table(spark, sf, "azure_updates").select(
        "update_id", X.strip_tags(s).alias("bare"), X.tidy(s).alias("tidy"), X.filter_value(c("title")).alias("filter_value"), X.safe_key(c("source_type")).alias("safe_key"), F.substring(s, 1, 300).alias("caption")
    )


@query(
    r"""WITH b AS (SELECT blog_id, regexp_replace(url, '[?#].*$', '') AS bare FROM blog_posts),
p AS (SELECT blog_id, regexp_extract(bare, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme, regexp_extract(bare, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/]*)', 1) AS host,
 regexp_replace(regexp_replace(bare, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/]*', ''), '/+$', '') AS path0 FROM b),
n AS (SELECT *, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path FROM p)
SELECT blog_id, coalesce(nullif(scheme, ''), 'https') || '://' || coalesce(nullif(host, ''), 'localhost') || CASE WHEN starts_with(path, '/en-us') THEN path ELSE '/en-us' || path END AS url FROM n"""
)
def url_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """One spelling per URL."""
    return table(spark, sf, "blog_posts").select("blog_id", X.normal_url(F.col("url")).alias("url"))


@query(
    """SELECT video_row, video_link, clock FROM (SELECT video_row,
CASE WHEN starts_with(video_id, 'http') THEN video_id ELSE 'https://www.youtube.com/watch?v=' || video_id END || coalesce('&t=' || floor(s)::INTEGER, '') AS video_link,
CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', floor(s)::INTEGER // 3600, floor(s)::INTEGER % 3600 // 60, floor(s)::INTEGER % 60) ELSE printf('%d:%02d', floor(s)::INTEGER // 60, floor(s)::INTEGER % 60) END AS clock
FROM (SELECT video_row, video_id, list_max(list_transform(transcript_segments, lambda x: x.start)) AS s FROM videos))"""
)
def video_links(spark: SparkSession, sf: str) -> DataFrame:
    """Deep links to the last segment and its clock time."""
    start = F.array_max(F.transform("transcript_segments", lambda x: x["start"]))
    rows = table(spark, sf, "videos").select("video_row", "video_id", start.alias("s"))
    return rows.select("video_row", X.video_link(F.col("video_id"), F.col("s")).alias("video_link"), F.when(F.col("s").isNotNull(), X.clock(F.col("s"))).alias("clock"))


@query("SELECT update_id, array_to_string(list_filter(coalesce(categories, []), lambda x: x IS NOT NULL), ',') AS categories, len(list_filter(coalesce(azure_services, []), lambda x: x IS NOT NULL))::INTEGER AS n_services FROM azure_updates")
def string_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Null arrays to empty ones, null elements dropped."""
    lists = table(spark, sf, "azure_updates")
    return lists.select("update_id", F.array_join(X.string_list(F.col("categories")), ",").alias("categories"), F.size(X.string_list(F.col("azure_services"))).alias("n_services"))


@query("SELECT run_id, least(pow(2.0, run_id % 9), 60.0) AS wait_seconds FROM pipeline_runs")
def backoff_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting time before retry n."""
    return table(spark, sf, "pipeline_runs").select("run_id", X.backoff(F.col("run_id") % 9).alias("wait_seconds"))


@query("SELECT doc_id, length(text) > 32764 AS truncated, sha256(substr(text, 1, 32764)) AS fp FROM documents WHERE text IS NOT NULL")
def token_budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut to what one embedding call takes, with a flag (a feature of the call, not of the corpus)."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", (F.length("text") > 32764).alias("truncated"), F.sha2(F.substring("text", 1, 32764), 256).alias("fp"))


# -- tagging and routing ---------------------------------------------------------
_HAY = "lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(array_to_string(categories, ' '), ''))"


@query(
    f"WITH h AS (SELECT update_id, {_HAY} AS hay FROM azure_updates), l AS (SELECT update_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {contains_any('hay', s)} THEN '{k}' END" for k, s in LABELS.items())
    + "], lambda x: x IS NOT NULL), ',') AS labels FROM h) SELECT update_id, CASE WHEN labels = '' THEN 'general' ELSE labels END AS labels FROM l"
)
def tag_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by signal substrings over title, summary and categories."""
    rows = table(spark, sf, "azure_updates")
    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce(F.array_join("categories", " "), F.lit("")))
    return rows.select("update_id", F.array_join(X.labels(hay, LABELS, "general"), ",").alias("labels"))


@query("SELECT update_id, array_to_string(list_distinct_in_order, ',') AS names FROM (SELECT update_id, list_filter(m, lambda x, i: list_position(m, x) = i) AS list_distinct_in_order FROM (SELECT update_id, regexp_extract_all(coalesce(summary, ''), '" + "|".join(NAMES) + "') AS m FROM azure_updates))")
def tag_names(spark: SparkSession, sf: str) -> DataFrame:
    """Known names in canonical spelling, in order of first mention."""
    return table(spark, sf, "azure_updates").select("update_id", F.array_join(X.mentioned(F.col("summary"), NAMES), ",").alias("names"))


@query(
    "SELECT update_id, CASE "
    + " ".join(f"WHEN {contains_any('t', k)} THEN '{n}'" for n, k in ROUTES)
    + " ELSE 'design' END AS target FROM (SELECT update_id, lower(coalesce(title, '')) AS t FROM azure_updates)"
)
def route_questions(spark: SparkSession, sf: str) -> DataFrame:
    """First rule whose keyword occurs."""
    return table(spark, sf, "azure_updates").select("update_id", X.route(F.col("title"), ROUTES, "design").alias("target"))


# -- delta and upsert --------------------------------------------------------------
@query(
    """SELECT coalesce(lower(source_type), 'unknown') AS source_type, count(*) AS n_new FROM chunk_fingerprints c WHERE batch_no > 0
AND NOT EXISTS (SELECT 1 FROM chunk_fingerprints e WHERE e.batch_no = 0 AND e.chunk_id = c.chunk_id AND e.fingerprint = c.fingerprint) GROUP BY 1"""
)
def upsert_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Later chunks that the history doesn't hold with the same fingerprint, per source type."""
    rows = table(spark, sf, "chunk_fingerprints")
    new = index.delta(rows.where("batch_no > 0"), rows.where("batch_no = 0"))
    return new.groupBy(F.coalesce(F.lower("source_type"), F.lit("unknown")).alias("source_type")).agg(F.count("*").alias("n_new"))


@query(
    """WITH i AS (SELECT chunk_id, max(rec_id) AS rec_id FROM chunk_fingerprints WHERE batch_no > 0 AND chunk_id IS NOT NULL GROUP BY 1)
SELECT rec_id, chunk_id FROM i UNION ALL
SELECT rec_id, chunk_id FROM (SELECT chunk_id, max(rec_id) AS rec_id FROM chunk_fingerprints WHERE batch_no = 0 AND chunk_id IS NOT NULL GROUP BY 1) e WHERE chunk_id NOT IN (SELECT chunk_id FROM i)"""
)
def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The index after all batches: the latest row of every chunk id."""
    rows = table(spark, sf, "chunk_fingerprints").where("chunk_id is not null").select("rec_id", "chunk_id", "batch_no")
    old, new = (index.latest(rows.where(c).drop("batch_no"), "chunk_id", ["rec_id"]) for c in ("batch_no = 0", "batch_no > 0"))
    return index.upsert(old, new, "chunk_id")


@query(
    """SELECT e.rec_id, e.chunk_id FROM chunk_fingerprints e WHERE e.batch_no = 0 AND e.source_url IN (SELECT source_url FROM chunk_fingerprints WHERE batch_no > 0)
AND NOT EXISTS (SELECT 1 FROM chunk_fingerprints n WHERE n.batch_no > 0 AND n.chunk_id = e.chunk_id)"""
)
def index_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed chunks of crawled urls that the later batches no longer have."""
    rows = table(spark, sf, "chunk_fingerprints")
    return index.orphans(rows.where("batch_no = 0"), rows.where("batch_no > 0"), "source_url", "chunk_id").select("rec_id", "chunk_id")


@query(
    """WITH l AS (SELECT chunk_id, fingerprint, rec_id, lag(fingerprint) OVER w AS b, row_number() OVER w AS r FROM chunk_fingerprints WHERE chunk_id IS NOT NULL WINDOW w AS (PARTITION BY chunk_id ORDER BY rec_id)),
c AS (SELECT * FROM l WHERE r = 1 OR fingerprint IS DISTINCT FROM b)
SELECT chunk_id, fingerprint, rec_id AS valid_from, coalesce(lead(rec_id) OVER (PARTITION BY chunk_id ORDER BY rec_id), -1) AS valid_to, row_number() OVER (PARTITION BY chunk_id ORDER BY rec_id)::INTEGER AS version FROM c"""
)
def chunk_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Validity ranges of every chunk's versions (-1: still valid)."""
    rows = index.versions(table(spark, sf, "chunk_fingerprints").where("chunk_id is not null").select("chunk_id", "fingerprint", "rec_id"), "chunk_id", "rec_id", "fingerprint")
    return rows.withColumn("valid_to", F.coalesce("valid_to", F.lit(-1)))


@query("SELECT v.video_row, coalesce(d.n, 0) AS n_crawls, coalesce(v.duration_iso, 'PT0S') AS duration FROM videos v LEFT JOIN (SELECT video_id, count(*) AS n FROM videos GROUP BY 1) d ON v.video_id = d.video_id")
def detail_join(spark: SparkSession, sf: str) -> DataFrame:
    """Details looked up by id, with defaults."""
    v = table(spark, sf, "videos")
    d = v.groupBy("video_id").agg(F.count("*").alias("n"))
    return v.join(d, "video_id", "left").select("video_row", F.coalesce("n", F.lit(0)).alias("n_crawls"), F.coalesce("duration_iso", F.lit("PT0S")).alias("duration"))


# -- aggregates ----------------------------------------------------------------------
@query(
    """WITH f AS (SELECT lower(source_type) AS source_type, count(*) AS n, sum(coalesce(length(text), 0)) AS chars, count(DISTINCT url) AS urls FROM documents WHERE source_type IS NOT NULL GROUP BY 1)
SELECT c.source_type, coalesce(f.n, 0)::BIGINT AS n_chunks, coalesce(f.urls, 0)::BIGINT AS n_documents, coalesce(f.chars // nullif(f.n, 0), 0)::BIGINT AS mean_chars FROM chunk_config c LEFT JOIN f ON f.source_type = c.source_type
UNION ALL SELECT source_type, n, urls, (chars // n)::BIGINT FROM f WHERE source_type NOT IN (SELECT source_type FROM chunk_config)"""
)
def facet_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per source type; configured types without documents count zero."""
    docs = table(spark, sf, "documents").where("source_type is not null")
    f = docs.groupBy(F.lower("source_type").alias("source_type")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.countDistinct("url").alias("urls"))
    rows = table(spark, sf, "chunk_config").select("source_type").join(f, "source_type", "full")
    mean = F.when(F.col("n") > 0, F.floor(F.col("chars") / F.col("n"))).otherwise(0).cast("bigint")
    return rows.select("source_type", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("urls", F.lit(0)).alias("n_documents"), mean.alias("mean_chars"))


@query(
    """WITH r AS (SELECT DISTINCT ON (run_id) * FROM pipeline_runs ORDER BY run_id, started_at)
SELECT count(*) AS n_runs, sum(total_documents)::BIGINT AS documents, sum(chunks_new)::BIGINT AS chunks_new, sum(chunks_failed)::BIGINT AS failed, sum(CASE WHEN embedding_tokens > 0 THEN embedding_tokens END)::BIGINT AS tokens,
round(sum(CASE WHEN embedding_tokens > 0 THEN embedding_tokens END) / 1000.0 * 0.00013::DOUBLE, 6) AS cost, count(*) FILTER (WHERE embedding_tokens > 0) AS with_tokens FROM r"""
)
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over the runs, each run once."""
    runs = table(spark, sf, "pipeline_runs").groupBy("run_id").agg(*[F.min(c).alias(c) for c in ("total_documents", "chunks_new", "chunks_failed", "embedding_tokens")])
    good = F.when(F.col("embedding_tokens") > 0, F.col("embedding_tokens"))
    return runs.agg(
        F.count("*").alias("n_runs"), F.sum("total_documents").alias("documents"), F.sum("chunks_new").alias("chunks_new"), F.sum("chunks_failed").alias("failed"), F.sum(good).alias("tokens"),
        F.round(F.sum(good) / 1000.0 * F.lit(0.00013), 6).alias("cost"), F.count(good).alias("with_tokens"),
    )


@query("SELECT content_type, array_to_string(list_sort(list(DISTINCT s)), ',') AS services FROM (SELECT content_type, unnest(azure_services) AS s FROM azure_updates) WHERE s IS NOT NULL GROUP BY 1")
def label_union(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted union of label arrays per content type; labels are made distinct before they are gathered."""
    rows = table(spark, sf, "azure_updates").select("content_type", F.explode("azure_services").alias("s")).where("s is not null").distinct()
    return rows.groupBy("content_type").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("services"))


@query("SELECT s AS service, count(*) AS n_updates, min(update_id) AS first_update, coalesce(array_to_string(list_sort(list(DISTINCT content_type)), ','), '') AS content_types FROM (SELECT update_id, content_type, unnest(list_distinct(azure_services)) AS s FROM azure_updates) WHERE s IS NOT NULL GROUP BY 1")
def service_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Per service the number of updates, the first one and the content types."""
    rows = table(spark, sf, "azure_updates").select("update_id", "content_type", F.explode(F.array_distinct("azure_services")).alias("service")).where("service is not null")
    return rows.groupBy("service").agg(F.count("*").alias("n_updates"), F.min("update_id").alias("first_update"), F.array_join(F.array_sort(F.collect_set("content_type")), ",").alias("content_types"))


@query("SELECT event_type, count(*) AS n, round(min(value), 4) AS lowest, round(max(value), 4) AS highest, count(*) FILTER (WHERE value > 10) AS over_ten, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Counters and range per kind of event."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 4).alias("lowest"), F.round(F.max("value"), 4).alias("highest"), F.count_if(F.col("value") > 10).alias("over_ten"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON property as a typed column."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "event_type")


# -- sets -----------------------------------------------------------------------------
@query("SELECT tab, count(*) AS n FROM (SELECT 'updates' AS tab FROM azure_updates UNION ALL SELECT 'posts' FROM techcommunity_posts UNION ALL SELECT 'blogs' FROM blog_posts UNION ALL SELECT 'videos' FROM videos) GROUP BY 1")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All sources in one table, missing columns as nulls."""
    tabs = {"updates": "azure_updates", "posts": "techcommunity_posts", "blogs": "blog_posts", "videos": "videos"}
    rows = None
    for name, t in tabs.items():
        part = table(spark, sf, t).select("title", "published_at", *(["url"] if t != "videos" else [])).withColumn("tab", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy("tab").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source_url AS url, 'chunks only' AS side FROM chunk_fingerprints WHERE source_url IS NOT NULL EXCEPT SELECT url, 'chunks only' FROM techcommunity_posts UNION ALL (SELECT source_url, 'both' FROM chunk_fingerprints INTERSECT SELECT url, 'both' FROM techcommunity_posts)")
def url_sets(spark: SparkSession, sf: str) -> DataFrame:
    """URLs of chunks without a post, and of both."""
    c = table(spark, sf, "chunk_fingerprints").where("source_url is not null").select(F.col("source_url").alias("url"))
    p = table(spark, sf, "techcommunity_posts").select("url")
    return c.subtract(p).withColumn("side", F.lit("chunks only")).unionByName(c.intersect(p).withColumn("side", F.lit("both")))


# -- filters, top-k ----------------------------------------------------------------------
@query("SELECT update_id FROM azure_updates WHERE list_has_any(azure_services, (SELECT list(s) FROM (SELECT s FROM (SELECT unnest(azure_services) AS s FROM azure_updates) WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 2))) AND lower(source_type) IN ('azure-update', 'rss')")
def facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Any of the two commonest services and one of two source types."""
    u = table(spark, sf, "azure_updates")
    common = u.select(F.explode("azure_services").alias("s")).where("s is not null").groupBy("s").count().orderBy(F.desc("count"), "s").limit(2)
    names = F.array(*[F.lit(r["s"]) for r in common.collect()]) if not u.isEmpty() else F.array().cast("array<string>")  # two rows
    return u.where(F.arrays_overlap("azure_services", names) & F.lower("source_type").isin("azure-update", "rss")).select("update_id")


@query("SELECT update_id, title, substr(summary, 1, 400) AS summary FROM azure_updates WHERE crawled_at >= TIMESTAMPTZ '2025-05-01 00:00:00+00' AND crawled_at < TIMESTAMPTZ '2025-06-01 00:00:00+00' ORDER BY crawled_at DESC, update_id LIMIT 20")
def latest_updates(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty latest updates of a month (a top-k report)."""
    day = lambda s: F.lit(s).cast("timestamp")
    u = table(spark, sf, "azure_updates").where((F.col("crawled_at") >= day("2025-05-01 00:00:00+00:00")) & (F.col("crawled_at") < day("2025-06-01 00:00:00+00:00")))
    return u.orderBy(F.desc("crawled_at"), "update_id").limit(20).select("update_id", "title", F.substring("summary", 1, 400).alias("summary"))


@query("SELECT event_type, count(*) AS n, max(ts) AS mark FROM events WHERE ts > TIMESTAMP '2024-01-15' GROUP BY 1")
def incremental_mark(spark: SparkSession, sf: str) -> DataFrame:
    """Events after a high-water mark and the next mark."""
    e = table(spark, sf, "events")
    return e.where(F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("mark"))


# -- retrieval ------------------------------------------------------------------------------
TERMS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_BM25 = f"""
WITH q AS (SELECT update_id AS q, unnest(list_distinct({TERMS.format("title")})) AS term FROM azure_updates WHERE update_id % 100 = 0),
d AS (SELECT doc_id AS d, {TERMS.format("text")} AS t FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM d WHERE len(t) > 0),
p AS (SELECT d, len(t) AS l, unnest(t) AS term FROM d),
tf AS (SELECT term, d, l, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
h AS (SELECT q.q, tf.d, round(sum(ln(1 + (s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.l / s.mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2)
"""


def _updates_as_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "azure_updates").where("update_id % 100 = 0").select("update_id", "title")


@query(_BM25 + "SELECT q AS update_id, d AS doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INTEGER AS rank FROM h QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth update's title against all documents."""
    return retrieval.bm25(table(spark, sf, "documents"), "doc_id", "text", _updates_as_questions(spark, sf), "update_id", "title")


_KNN = """
WITH k AS (SELECT a.vec_id AS q, b.vec_id AS d, a.label AS ql, b.label AS dl,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INTEGER AS rank FROM k QUALIFY rank <= 10)
"""


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return retrieval.nearest(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"))


@query(_KNN + "SELECT q, d, score, rank FROM r")
def knn_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact neighbours of every hundredth vector."""
    return _neighbours(spark, sf)


@query(
    _KNN
    + """, g AS (SELECT q, max((ql = dl)::INTEGER)::DOUBLE AS hit, coalesce(1.0::DOUBLE / min(CASE WHEN ql = dl THEN rank END), 0) AS rr, sum((ql = dl)::INTEGER / log2(rank + 1)) AS dcg, sum((ql = dl)::INTEGER)::INTEGER AS n FROM r GROUP BY 1),
i AS (SELECT *, CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda x: 1.0::DOUBLE / log2(x + 1))) ELSE 0 END AS nd FROM g)
SELECT round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(nd), 6) AS ndcg, count(*) AS n_queries FROM i"""
)
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rate, reciprocal rank and NDCG with equal label as relevance."""
    label = table(spark, sf, "embeddings").select("vec_id", "label")
    rows = _neighbours(spark, sf).join(label.toDF("q", "ql"), "q").join(label.toDF("d", "dl"), "d")
    return retrieval.metrics(rows.withColumn("relevant", F.coalesce(F.col("ql") == F.col("dl"), F.lit(False))), "relevant", 10)


@query(
    _BM25
    + """, b AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM h QUALIFY rank <= 10),
v AS (SELECT a.vec_id AS q, b.vec_id AS d, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
w AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM v QUALIFY rank <= 10),
f AS (SELECT q, d, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT q, d, rank FROM b UNION ALL SELECT q, d, rank FROM w) GROUP BY 1, 2)
SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INTEGER AS rank FROM f QUALIFY rank <= 10"""
)
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Full-text and vector ranks fused by reciprocal rank."""
    text = bm25_topk(spark, sf).withColumnsRenamed({"update_id": "q", "doc_id": "d"})
    return retrieval.fuse(text, _neighbours(spark, sf))


@query(
    """WITH h AS (SELECT source_url AS url, rec_id AS position, length(content) / 500.0::DOUBLE AS score FROM chunk_fingerprints WHERE source_url IS NOT NULL AND content IS NOT NULL)
SELECT url, position, score, round(least(score, 1.0::DOUBLE), 3) AS relevance FROM h QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, position) = 1"""
)
def citations_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best hit of every url with clamped relevance."""
    hits = table(spark, sf, "chunk_fingerprints").where("source_url is not null and content is not null").select(F.col("source_url").alias("url"), F.col("rec_id").alias("position"), (F.length("content") / F.lit(500.0)).alias("score"))
    return retrieval.best_per_url(hits, "url", "score", "position").drop("_seen")


@query(
    f"""WITH a AS (SELECT update_id, coalesce(len(categories), 0) AS n, least(1.0::DOUBLE, length(title) / 100.0::DOUBLE) AS s, summary FROM azure_updates WHERE summary IS NOT NULL AND title IS NOT NULL)
SELECT update_id, round(CASE WHEN n <= 0 THEN 0.3::DOUBLE ELSE least(greatest(s * 0.4::DOUBLE + least(n / 5.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + least(length(summary) / 200.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE + 0.15::DOUBLE
 - CASE WHEN {" OR ".join("contains(lower(summary), '" + h.replace("'", "''") + "')" for h in X.HEDGES)} THEN 0.3::DOUBLE ELSE 0 END, 0.1::DOUBLE), 0.95::DOUBLE) END, 6) AS confidence FROM a"""
)
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence with updates as answers and their categories as citations."""
    a = table(spark, sf, "azure_updates").where("summary is not null and title is not null")
    score = X.confidence(F.coalesce(F.size("categories"), F.lit(0)), F.least(F.lit(1.0), F.length("title") / F.lit(100.0)), F.col("summary"))
    return a.select("update_id", F.round(score, 6).alias("confidence"))


@query(
    _BM25.replace(" WHERE update_id % 100 = 0", "")
    + """, r AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM h QUALIFY rank <= 3)
SELECT r.q AS update_id, string_agg('[' || rank || '] ' || coalesce(title, '') || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || coalesce(substr(text, 1, 300), ''), chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents ON d = doc_id GROUP BY 1"""
)
def grounded_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered context of every update's title."""
    hits = retrieval.bm25(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "azure_updates").select("update_id", "title"), "update_id", "title", 3)
    docs = table(spark, sf, "documents").select("doc_id", "title", "url", F.substring("text", 1, 300).alias("snippet"))
    return retrieval.prompt(hits.join(docs, "doc_id"), "update_id", "rank", "title", "url", "snippet")


# -- windows and state ---------------------------------------------------------------------
@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT user_id, min(ts) AS \"start\", max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n_events FROM s GROUP BY user_id, g")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of every user with half an hour's gap."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rates.sessions(e, "user_id", "ts").withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("SELECT date_trunc('hour', ts) AS \"start\", event_type, count(*) AS n_events FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and type."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rates.tumbling(e, "ts", "1 hour", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
r AS (SELECT event_id, user_id, i, true AS allowed, us AS last, NULL::BIGINT AS before FROM e WHERE i = 1
UNION ALL SELECT e.event_id, e.user_id, e.i, ok, CASE WHEN ok THEN us ELSE last END, CASE WHEN ok THEN last ELSE before END
  FROM (SELECT e.*, r.last, r.before, coalesce(r.before <= e.us - 3600000000, true) OR r.last <= e.us - 3600000000 AS ok FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.i = r.i + 1) e)
SELECT event_id, allowed FROM r"""
)
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each event passes a limit of two an hour per user; denied events don't count."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return rates.rate_limited(e, ["user_id"], "ts", "event_id", 2, 3600.0).select("event_id", "allowed")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
r AS (SELECT event_id, user_id, event_type, i, false AS hit, us AS since FROM e WHERE i = 1
UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.i, e.us < r.since + 21600000000, CASE WHEN e.us < r.since + 21600000000 THEN r.since ELSE e.us END
  FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.event_type IS NOT DISTINCT FROM r.event_type AND e.i = r.i + 1)
SELECT event_id, hit FROM r"""
)
def ttl_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and misses of a cache per user and type with a lifetime of six hours."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return rates.cached(e, ["user_id", "event_type"], "ts", "event_id", 21600.0).select("event_id", "hit")


@query(
    """SELECT update_id, round(least(3.0::DOUBLE, CASE WHEN crawled_at IS NULL THEN 0.2::DOUBLE ELSE 1.0::DOUBLE / (1 + date_diff('day', crawled_at, TIMESTAMPTZ '2025-07-01 00:00:00+00') / 90.0::DOUBLE) END
+ CASE WHEN lower(source_type) = 'azure-update' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + (CASE WHEN title <> '' THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN summary <> '' THEN 0.5::DOUBLE ELSE 0 END)), 6) AS quality FROM azure_updates"""
)
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    """Recency, authority and completeness of every update, at most 3 (as of a fixed day)."""
    day = F.lit("2025-07-01 00:00:00+00:00").cast("timestamp")
    recency = F.coalesce(1.0 / (1 + F.datediff(day, "crawled_at") / F.lit(90.0)), F.lit(0.2))
    authority = F.when(F.lower("source_type") == "azure-update", 1.0).otherwise(0.5)
    complete = F.when(F.col("title") != "", 0.5).otherwise(0.0) + F.when(F.col("summary") != "", 0.5).otherwise(0.0)
    return table(spark, sf, "azure_updates").select("update_id", F.round(F.least(F.lit(3.0), recency + authority + complete), 6).alias("quality"))


@query()
def ingest_run(spark: SparkSession, sf: str) -> DataFrame:
    """One run of the whole pipeline over all sources: counters by source type."""
    from ..session import fresh_dir
    from . import pipeline

    return pipeline.ingest(spark, pipeline.sources(spark, sf), fresh_dir(spark, "ingest")).counters


# -- extensions on the star schema (not part of the reference) ------------------------------
@query("SELECT coalesce(source, '(all)') AS source, coalesce(lang, '(all)') AS lang, count(*) AS n, grouping(source)::TINYINT AS g1, grouping(lang)::TINYINT AS g2 FROM documents GROUP BY ROLLUP (source, lang)")
def ext_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by source and language with subtotals."""
    r = table(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.grouping("source").alias("g1"), F.grouping("lang").alias("g2"))
    return r.withColumns({"source": F.coalesce("source", F.lit("(all)")), "lang": F.coalesce("lang", F.lit("(all)"))})


@query(
    """SELECT n_name, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1"""
)
def ext_revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """A star join with partial aggregation below it."""
    o = table(spark, sf, "orders").where((F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1996-01-01")).select("o_orderkey", "o_custkey")
    items = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    rows = items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("r"), 2).alias("revenue"))


def _more() -> None:
    from . import search_queries, source_queries, state_queries  # noqa: F401


def queries() -> dict:
    _more()
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(SQL)
