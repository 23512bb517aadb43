"""The ingestion run: sources to canonical documents, chunks, delta, vectors and index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, index
from ..operators.sink import IndexStore
from ..session import cut, table
from ..sources import providers

#: How texts of a source type are cut; unknown types go as documents.
STRATEGY = {"azure-update": "whole", "video-transcript": "transcript"}


@dataclass
class Run:
    counters: DataFrame
    index: DataFrame


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical documents of all sources: url, source_type, title, content (blank ones left out)."""
    c, get = F.col, lambda name: table(spark, sf_dir, name)
    updates = get("azure_updates").select("url", F.lit("azure-update").alias("source_type"), "title", c("summary").alias("content"))
    posts = get("techcommunity_posts").select("url", F.lit("tech-community").alias("source_type"), "title", c("body_text").alias("content"))
    blogs = get("blog_posts").select("url", F.lit("blog-post").alias("source_type"), "title", F.coalesce("body_text", "summary").alias("content"))
    videos = get("videos").select(X.video_link(c("video_id"), F.lit(None).cast("double")).alias("url"), F.lit("video-transcript").alias("source_type"), "title", c("transcript_text").alias("content"), "transcript_segments")
    rows = updates
    for part in (posts, blogs, videos):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.where(F.col("content").rlike("[^ \t\n\r\f]") | (F.size("transcript_segments") > 0))


def chunk(documents: DataFrame) -> DataFrame:
    """Chunks of all documents by the strategy of their type: source_url, source_type, content, chunk_index, chunk_id, fingerprint.

    Transcripts with segments go by silence and size, those without by
    paragraph, led by their title.  A document that can't be cut stops no
    other.  The source type travels inside the url column, so that chunkers
    need not know it.
    """
    pick = F.create_map(*[F.lit(x) for pair in STRATEGY.items() for x in pair])
    how = F.coalesce(F.try_element_at(pick, F.col("source_type")), F.lit("document"))
    timed = (how == "transcript") & F.coalesce(F.size("transcript_segments") > 0, F.lit(False))
    tagged = documents.withColumn("_u", F.concat_ws("\0", F.coalesce("source_type", F.lit("")), F.coalesce("url", F.lit(""))))
    whole = chunking.chunk_whole(tagged.where(how == "whole"), "_u", "content").withColumn("chunk_index", F.lit(0))
    cut_up = chunking.chunk_documents(tagged.where(how == "document"), "_u", "content")
    plain = chunking.chunk_plain_transcripts(tagged.where((how == "transcript") & ~timed), "_u", "title", "content")
    spoken = chunking.group_transcripts(tagged.where(timed), "_u", "title", "transcript_segments").withColumnRenamed("_u", "source_url")
    rows = None
    for part in (whole, cut_up, plain, spoken):
        part = part.select("source_url", "content", F.col("chunk_index").cast("int").alias("chunk_index"))
        rows = part if rows is None else rows.unionByName(part)
    url, kind = F.substring_index("source_url", "\0", -1), F.substring_index("source_url", "\0", 1)
    rows = rows.select(url.alias("source_url"), kind.alias("source_type"), "content", "chunk_index")
    return rows.withColumns({"chunk_id": X.chunk_id(F.col("source_url"), F.col("chunk_index")), "fingerprint": F.sha2("content", 256)})


def ingest(spark: SparkSession, documents: DataFrame, root: str, existing: DataFrame | None = None, provider=providers.hashing_embedder) -> Run:  # noqa: ANN001
    """One run: chunks, those new or changed against ``existing`` (default: the index below ``root``), their vectors, the index after the upsert, and counters per source type.

    The index is written as the next version below ``root`` and readers are
    pointed to it last, so runs on one root follow one another and a failed
    one changes nothing.  The delta comes before the vectors, so unchanged chunks cost none; of
    chunks with one id the one with the greatest fingerprint is indexed.  A
    second run over the same documents indexes nothing.
    """
    store = IndexStore(spark, f"{root}/index")
    existing = store.current() if existing is None else existing
    chunks = cut(chunk(documents))
    once = index.latest(chunks, "chunk_id", ["fingerprint"])
    new = cut(index.delta(once, existing) if existing is not None else once)
    cache = existing.select(F.sha2("content", 256).alias("content_hash"), "embedding").where("embedding is not null").dropDuplicates(["content_hash"]) if existing is not None else None
    vectors = providers.embed_new(new, cache, "content", provider)
    made = vectors.select("chunk_id", "source_url", "source_type", "chunk_index", "content", "fingerprint", "embedding")
    after = index.upsert(existing, made, "chunk_id") if existing is not None else made
    store.write(after)
    counts = chunks.groupBy("source_type").agg(F.count("*").alias("n_chunks"), F.countDistinct("source_url").alias("n_documents"))
    fresh = new.groupBy("source_type").agg(F.count("*").alias("n_indexed"))
    counters = counts.join(fresh, "source_type", "left").select("source_type", "n_documents", "n_chunks", F.coalesce("n_indexed", F.lit(0)).alias("n_indexed"))
    return Run(counters, store.current())
