"""Content-type-aware chunking: documents by heading, paragraph and sentence; transcripts by silence and size; updates whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "e.g i.e etc vs dr mr mrs ms prof sr jr no fig approx dept est inc ltd corp "
    "jan feb mar apr jun jul aug sep oct nov dec st ave blvd"
).split()
_END = re.compile(r"""(?<=[.?!])\s+(?=[A-Z"'(\[])""")
_SHORT = re.compile(rf"\b(?:{'|'.join(map(re.escape, ABBREVIATIONS))})\.$", re.I)
_FENCED = re.compile(r"```.*?```|~~~.*?~~~", re.S)
_HEADING = re.compile(r"(#{1,6})\s+(.+)")


def n_tokens(text: str) -> int:
    """Words x 1.3, rounded down."""
    return len(text.split()) * 13 // 10


def sentences(text: str) -> list[str]:
    """Sentences; a stop belonging to an abbreviation ends none, letter case is kept."""
    out, start = [], 0
    for m in _END.finditer(text):
        if not _SHORT.search(text[start : m.start()]):
            out.append(text[start : m.start()].strip())
            start = m.end()
    out.append(text[start:].strip())
    return [s for s in out if s] or [text.strip()]


def sections(text: str) -> list[tuple[str, str]]:
    """(heading path, body) of every section; headings in fences are text; an empty section before the first heading is left out."""
    out: list[tuple[str, str]] = []
    path: list[tuple[int, str]] = []
    body: list[str] = []
    fence = ""

    def label() -> str:
        return " > ".join(f"{'#' * level} {name}" for level, name in path)

    for line in text.splitlines():
        mark = line.strip()[:3]
        heading = None if fence else _HEADING.fullmatch(line)
        if fence and mark == fence:
            fence = ""
        elif not fence and mark in ("```", "~~~"):
            fence = mark
        if not heading:
            body.append(line)
            continue
        done = "\n".join(body).strip()
        if done or out:
            out.append((label(), done))
        level = len(heading[1])
        path = [p for p in path if p[0] < level] + [(level, heading[2].strip())]
        body = []
    if rest := "\n".join(body).strip():
        out.append((label(), rest))
    return out


class _Filler:
    """Collects pieces up to a size and closes a group when the next one doesn't fit."""

    def __init__(self, most: int, glue: str):
        self.most, self.glue, self.parts, self.size, self.groups = most, glue, [], 0, []

    def add(self, piece: str, size: int) -> None:
        if self.parts and self.size + size > self.most:
            self.close()
        self.parts.append(piece)
        self.size += size

    def close(self) -> None:
        if whole := self.glue.join(self.parts).strip():
            self.groups.append(whole)
        self.parts, self.size = [], 0


def word_blocks(text: str, most: int) -> list[str]:
    """Blocks of ``most`` words (a single word counts one token)."""
    w = text.split()
    return [" ".join(w[i : i + most]) for i in range(0, len(w), most)]


def by_sentence(text: str, most: int) -> list[str]:
    fill = _Filler(most, " ")
    for s in sentences(text):
        size = n_tokens(s)
        if size > most:
            fill.close()
            fill.groups += word_blocks(s, most)
        else:
            fill.add(s, size)
    fill.close()
    return fill.groups


def by_block(text: str, most: int) -> list[str]:
    """Groups of paragraphs and fenced blocks; a fence is never cut, an oversized paragraph goes by sentences."""
    fill, at = _Filler(most, "\n\n"), 0
    spans = [m.span() for m in _FENCED.finditer(text)]
    for start, end in [*spans, (len(text), len(text))]:
        for para in re.split(r"\n\n+", text[at:start]):
            if para := para.strip():
                size = n_tokens(para)
                if size > most:
                    fill.close()
                    fill.groups += by_sentence(para, most)
                else:
                    fill.add(para, size)
        if end > start:
            fill.add(text[start:end], n_tokens(text[start:end]))
        at = end
    fill.close()
    return fill.groups or [text.strip()]


def with_overlap(groups: list[tuple[str, str]], overlap: int) -> list[tuple[str, str]]:
    """Each chunk after the first begins with the last ``overlap`` words of the one before (as it was without overlap)."""
    if overlap <= 0:
        return groups
    tails = ["", *[" ".join(t.split()[-overlap:]) for _, t in groups[:-1]]]
    return [(h, f"{tail}\n\n{t}" if tail else t) for tail, (h, t) in zip(tails, groups)]


def document_chunks(text: str, most: int, overlap: int) -> list[tuple[str, str]]:
    """(heading path, content) of a document's chunks; none for a blank one."""
    if not text or not text.strip():
        return []
    groups = [(path, g) for path, body in sections(text) for g in (by_block(body, most) if body else [])]
    return [(h, t.strip()) for h, t in with_overlap(groups, overlap)]


def chunk_documents(df: DataFrame, url: str, text: str, most: int = 512, overlap: int = 128, errors: bool = False, cutter=document_chunks) -> DataFrame:  # noqa: ANN001
    """One row per chunk: source_url, chunk_index, total_chunks, heading_path, content, token_count, chunk_id, fingerprint.

    Null and blank texts have no chunks; a repeated row repeats its chunks; a
    null url counts as empty in the id.  A document that ``cutter`` fails on
    stops no other: with ``errors`` it gives one row of index -1 whose
    ``error`` tells why (null in all other rows), else it gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for u, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    cut = cutter(body or "", most, overlap)
                    rows += [(u, i, len(cut), h, t, None) for i, (h, t) in enumerate(cut)]
                except Exception as e:  # noqa: BLE001
                    rows.append((u, -1, 0, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source_url", "chunk_index", "total_chunks", "heading_path", "content", "error"])

    made = df.select(F.col(url).cast("string"), text).mapInArrow(run, "source_url string, chunk_index int, total_chunks int, heading_path string, content string, error string")
    made = made if errors else made.where("error is null").drop("error")
    return made.withColumns({"token_count": X.token_count(F.col("content")), "chunk_id": X.chunk_id(F.col("source_url"), F.col("chunk_index")), "fingerprint": F.sha2("content", 256)})


def chunk_word_blocks(df: DataFrame, url: str, text: str, most: int = 512, overlap: int = 128, keep: list[str] | None = None) -> DataFrame:
    """Chunks of unstructured text as exact blocks of ``most`` words, each after the first led by the overlap; no Python involved.  ``keep`` names columns carried along."""
    keep = keep or []
    w = df.select(F.col(url).cast("string").alias("source_url"), *keep, X.words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    blocks = w.withColumn("_n", F.ceil(F.size("_w") / F.lit(most)).cast("int"))
    at = blocks.select("source_url", *keep, "_w", F.col("_n").alias("total_chunks"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk_index"))
    body = F.array_join(F.slice("_w", F.col("chunk_index") * most + 1, F.lit(most)), " ")
    lead = F.array_join(F.slice("_w", F.col("chunk_index") * most + 1 - overlap, F.lit(overlap)), " ")
    made = at.select("source_url", *keep, "chunk_index", "total_chunks", F.when(F.col("chunk_index") == 0, body).otherwise(F.concat(lead, F.lit("\n\n"), body)).alias("content"))
    return made.withColumns({"token_count": X.token_count(F.col("content")), "chunk_id": X.chunk_id(F.col("source_url"), F.col("chunk_index")), "fingerprint": F.sha2("content", 256)})


def chunk_whole(df: DataFrame, url: str, text: str) -> DataFrame:
    """One chunk per row with text (updates are never cut)."""
    body = F.regexp_replace(F.col(text), f"^{X.SPACE}|{X.SPACE}$", "")
    made = df.select(F.col(url).alias("source_url"), body.alias("content")).where("content <> ''")
    return made.withColumns({"token_count": X.token_count(F.col("content")), "chunk_id": X.chunk_id(F.col("source_url"), F.lit(0)), "fingerprint": F.sha2("content", 256)})


def transcript_segments(df: DataFrame, key: str, segments: str) -> DataFrame:
    """(key, pos, text, start_time, end_time): segments with text in stored order, from 0; an end is end_time, start + duration or the start."""
    s = F.col("s")
    rows = df.select(key, F.posexplode(segments).alias("raw_pos", "s")).where(s["text"].rlike("[^ \t\n\r\f]"))
    return rows.select(
        key, "raw_pos", F.regexp_replace(s["text"], f"^{X.SPACE}|{X.SPACE}$", "").alias("text"), s["start"].alias("start_time"),
        F.coalesce(s["end_time"], s["start"] + s["duration"], s["start"]).alias("end_time"),
    )


def gap_groups(segments: DataFrame, key: str, gap: float) -> DataFrame:
    """Segments with ``group_no``: a silence of more than ``gap`` seconds between end and next start begins a group."""
    w = Window.partitionBy(key).orderBy("raw_pos")
    fresh = F.when(F.col("start_time") - F.lag("end_time").over(w) > gap, 1).otherwise(0)
    return segments.withColumn("_new", fresh).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def group_transcripts(df: DataFrame, key: str, title: str, segments: str, most: int = 512, gap: float = 30.0) -> DataFrame:
    """One row per topic group within ``most`` tokens: key, chunk_index, start_time, end_time, content.

    Group breaks are found by folding over the row's own segments (integer
    sizes only), so no shuffle is needed.  Rows without text have no chunks.
    """
    kept = F.filter(segments, lambda s: s["text"].rlike("[^ \t\n\r\f]"))
    timed = F.transform(
        kept,
        lambda s: F.struct(
            F.regexp_replace(s["text"], f"^{X.SPACE}|{X.SPACE}$", "").alias("text"), s["start"].alias("s"), F.coalesce(s["end_time"], s["start"] + s["duration"], s["start"]).alias("e"), X.token_count(s["text"]).alias("n")
        ),
    )
    start = F.struct(F.lit(None).cast("double").alias("e"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("g"))

    def fold(a: F.Column, s: F.Column) -> F.Column:
        last = F.coalesce(F.try_element_at(a["g"], F.lit(-1)), F.lit(0))
        fresh = (F.size(a["g"]) > 0) & (F.coalesce(s["s"] - a["e"] > gap, F.lit(False)) | (a["n"] + s["n"] > most))
        return F.struct(s["e"].alias("e"), F.when(fresh, s["n"]).otherwise(a["n"] + s["n"]).alias("n"), F.concat(a["g"], F.array(last + fresh.cast("int"))).alias("g"))

    rows = df.select(key, title, timed.alias("_s")).withColumn("_g", F.aggregate("_s", start, fold)["g"])
    rows = rows.select(key, title, F.inline(F.arrays_zip(F.col("_s"), F.col("_g"), F.sequence(F.lit(1), F.size("_s"))))).toDF(key, title, "s", "g", "pos")
    grouped = rows.where("s is not null").groupBy(key, title, "g").agg(F.min_by("s", "pos").alias("first"), F.max_by("s", "pos").alias("last"), F.array_sort(F.collect_list(F.struct("pos", F.col("s.text").alias("text")))).alias("parts"))
    head = F.concat(F.col(title), F.lit(" | "), X.clock(F.col("first.s")), F.lit(" – "), X.clock(F.col("last.e")), F.lit("\n\n"))
    return grouped.select(key, F.col("g").alias("chunk_index"), F.col("first.s").alias("start_time"), F.col("last.e").alias("end_time"), F.concat(head, F.array_join(F.col("parts.text"), " ")).alias("content"))


def plain_transcript(text: str, most: int = 512, overlap: int = 0) -> list[tuple[str, str]]:
    """("", content) of the chunks of a transcript without segments: paragraphs up to the size, longer ones by sentence."""
    fill = _Filler(most, "\n\n")
    for para in (text or "").split("\n\n"):
        if para := para.strip():
            size = n_tokens(para)
            if size > most:
                fill.close()
                fill.groups += by_sentence(para, most)
            else:
                fill.add(para, size)
    fill.close()
    return [("", g) for g in fill.groups]


def chunk_plain_transcripts(df: DataFrame, url: str, title: str, text: str, most: int = 512, errors: bool = False) -> DataFrame:
    """Chunks of transcripts without segments, each led by the title (a null title counts as empty); otherwise as ``chunk_documents``."""
    key = F.to_json(F.struct(F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"), F.coalesce(F.col(title), F.lit("")).alias("t")))
    made = chunk_documents(df.select(key.alias("k"), F.col(text).alias("x")), "k", "x", most, 0, errors, plain_transcript)
    told = F.from_json("source_url", "u string, t string")
    made = made.withColumns({"source_url": told["u"], "content": F.concat(told["t"], F.lit("\n\n"), F.col("content"))})
    return made.withColumns({"token_count": X.token_count(F.col("content")), "chunk_id": X.chunk_id(F.col("source_url"), F.col("chunk_index")), "fingerprint": F.sha2("content", 256)})


def parents_and_children(df: DataFrame, key: str, text: str, parent: int = 1024, child: int = 256) -> DataFrame:
    """(key, parent_no, child_no, content): blocks of ``child`` words, numbered within their parent of ``parent`` words (a multiple)."""
    w = df.select(F.col(key), X.words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    at = w.select(key, "_w", F.explode(F.sequence(F.lit(0), F.ceil(F.size("_w") / F.lit(child)).cast("int") - 1)).alias("_i"))
    per = parent // child
    return at.select(key, F.floor(F.col("_i") / per).cast("int").alias("parent_no"), (F.col("_i") % per).alias("child_no"), F.array_join(F.slice("_w", F.col("_i") * child + 1, F.lit(child)), " ").alias("content"))
