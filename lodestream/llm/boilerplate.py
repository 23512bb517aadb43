"""Separating the body of a page from what surrounds it, by tag-path ratios learned from the corpus itself.

Pages come as lines, so the path of a line is made of what pages give: its
section (the last line that speaks another language than prose does), its shape
(sentence or not) and as leaf its foreign words, those that the long lines
and titles of the corpus hardly ever use.  Per path over all pages, the text ratio of its
lines (length and punctuation, discounted by the share of foreign words) is
averaged, smoothed with the ratio of the lines that follow it on its pages, and
both are fused.  A threshold between the two modes of the paths' scores parts
furniture from content: a menu entry or notice is followed by more of its kind,
a heading by prose.  Links below a furniture line belong to it where links are
what mostly follows that line.  No phrase, menu word or language is listed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .common import spread

#: Lines of more characters are prose, whose words the others are measured by.
LONG = 160
#: Prose words are kept as bits of a map of this fixed size; a word counts if it stands on so many pages.
SLOTS, WORD_PAGES = 1 << 24, 2
#: A leaf has its own ratio if it stands on so many pages and on this share of all pages (so there are few); others take that of their shape.
LEAF_PAGES, LEAF_SHARE = 3, 0.0005
#: Weights of a path's own ratio and of the ratio of what follows it.
OWN, NEXT = 0.25, 0.75
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.?!:…][\"'”’»)\]]*$")
_FENCE = re.compile(r"^\s*(```|~~~)")
_LIST = re.compile(r"^\* +\S")
_COMMAS = re.compile(r"[\w-]+(?:, [\w-]+)+")
#: Kinds: code, heading by mark, title, line with foreign words, line of prose words that ends a sentence or is long, other line.
CODE, HEADING, TITLE, FOREIGN, PROSE, SHORT, TAGS, STAR = range(8)


def slot(word: str) -> int:
    return zlib.crc32(word.encode()) & (SLOTS - 1)


def text_ratio(line: str, foreign: float, sentence: bool) -> float:
    """0..1: grows with length and punctuation, shrinks with the share of foreign words."""
    length = min(1.0, np.log1p(len(line)) / np.log1p(LONG))
    return float((1 - foreign) * length * (1.0 if sentence or len(line) > 100 else 0.25))


def nodes(body: str, title: str | None, known: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(line_no, kind, leaf, shape, ratio) of every non-blank line; ``known`` are the bits of the words of prose."""
    own = title.strip().lower() if title else None
    out, fence = [], ""
    for number, raw in enumerate(body.split("\n")):
        s = raw.strip()
        if not s:
            continue
        mark = _FENCE.match(s)
        if fence or mark:
            out.append((number, CODE, 0, 0, 1.0))
            if not fence:
                fence = mark[1]
            elif mark and mark[1] == fence:
                fence = ""
            continue
        low = s.lower()
        sentence = bool(_END.search(s))
        if s.startswith("#") or low == own:
            out.append((number, HEADING if s.startswith("#") else TITLE, 0, 0, 0.5))
            continue
        w = _WORD.findall(low)
        strange = sorted({x for x in w if not known[slot(x)]})
        share = sum(not known[slot(x)] for x in w) / max(1, len(w))
        prose = sentence or len(s) > 100
        ratio = text_ratio(s, share, sentence)
        tags = bool(_COMMAS.fullmatch(s))
        if strange and not tags and (share >= 0.25 or not prose):
            leaf = zlib.crc32(" ".join(strange).encode()) << 8 | min(len(strange), 255)
            out.append((number, FOREIGN, leaf, 1 + (share >= 0.5) + 2 * prose, ratio))
        elif prose or s.startswith("|"):
            out.append((number, PROSE, 0, 0, ratio))
        else:
            out.append((number, TAGS if tags else STAR if _LIST.match(s) else SHORT, 0, 0, ratio))
    return out


def valley(score: np.ndarray, weight: np.ndarray, steps: int = 64) -> float:
    """The threshold between the two modes of scores in 0..1: the one that leaves least variance within the sides (Otsu)."""
    if not len(score):
        return 0.0
    best, at = -1.0, 0.0
    for t in np.linspace(0, 1, steps + 1)[1:-1]:
        low = score < t
        a, b = weight[low].sum(), weight[~low].sum()
        if a and b:
            between = a * b * (np.average(score[low], weights=weight[low]) - np.average(score[~low], weights=weight[~low])) ** 2
            if between > best:
                best, at = between, float(t)
    return at


class Paths:
    """Scores of leaves and shapes, which of them links follow, and the threshold."""

    def __init__(self, rows: list[tuple[int, int, int, float, float, float]], least: float):
        """``rows``: (shape, leaf, pages, own ratio, ratio of the next line, share of next lines that are short) per leaf, and with leaf 0 per shape; leaf and shape 0 is prose, which speaks for itself."""
        self.score = {(s, k): OWN * own + NEXT * (after if s else own) for s, k, n, own, after, _ in rows if not k or n >= least}
        self.links = {(s, k): short for s, k, n, _, _, short in rows if not k or n >= least}
        kept = [(self.score[s, k], n) for s, k, n, *_ in rows if (s, k) in self.score]
        score, weight = np.array([x for x, _ in kept]), np.array([float(n) for _, n in kept])
        self.threshold = valley(score, weight) if len(kept) else 0.0

    def of(self, shape: int, leaf: int) -> tuple[float, float]:
        at = (shape, leaf) if (shape, leaf) in self.score else (shape, 0)
        return self.score.get(at, 1.0), self.links.get(at, 0.0)


def furniture(rows: list[tuple[int, int, int, int, float]], paths: Paths) -> list[int]:
    """Line numbers of the nodes that belong to the page around the content."""
    out: list[int] = []
    linked = False
    for number, kind, leaf, shape, _ in rows:
        if kind == FOREIGN:
            score, links = paths.of(shape, leaf)
            linked = False
            if score < paths.threshold:
                out.append(number)
                linked = links > 0.5
        elif kind in (SHORT, TAGS) and linked:
            out.append(number)
            linked = kind != TAGS  # a list of tags stands for itself
        else:
            linked = False
    # a short line among furniture, or between it and an end of the page, is smoothed away with it
    around, n = set(out), len(rows)
    for i, (number, kind, *_) in enumerate(rows):
        near = [rows[j][0] in around for j in (i - 1, i + 1) if 0 <= j < n]
        if kind == SHORT and number not in around and near and all(near):
            out.append(number)
    return out


NODES = "array<struct<line_no:int,kind:int,leaf:bigint,shape:int,ratio:double>>"
_FIELDS = ("line_no", "kind", "leaf", "shape", "ratio")


def prose_words(df: DataFrame, body: str, title: str) -> DataFrame:
    """Words of the long lines and the titles of WORD_PAGES pages or more; a body met again counts once."""
    lines = F.filter(F.split(F.lower(F.col(body)), "\n"), lambda s: F.length(F.trim(s)) > LONG)
    found = df.select(F.array_distinct(F.regexp_extract_all(F.concat(F.array_join(lines, "\n"), F.lit("\n"), F.lower(F.coalesce(title, F.lit("")))), F.lit(r"\p{L}+"), F.lit(0))).alias("w"), F.xxhash64(body).alias("p"))
    counted = found.select(F.explode("w").alias("word"), "p").groupBy("word").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n"))
    return counted.where((F.col("n") >= WORD_PAGES) & (F.col("a") != F.col("b"))).select("word")


def page_nodes(df: DataFrame, body: str, title: str, keys: list[str]) -> DataFrame:
    """``keys``, a number of the page by its title (its body, where it has none), and the nodes of every page; null and blank bodies have none."""
    places = prose_words(df, body, title).select(F.crc32(F.col("word").cast("binary")).bitwiseAND(SLOTS - 1).cast("int").alias("s")).distinct()
    bits = np.zeros(SLOTS, bool)
    bits[places.toArrow().column(0).to_numpy()] = True  # SLOTS numbers at most
    known = df.sparkSession.sparkContext.broadcast(np.packbits(bits))
    rows = spread(df.select(*keys, body, title))
    names = [*keys, "_page", "nodes"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)]) + f", _page bigint, nodes {NODES}"
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.int32()), ("leaf", pa.int64()), ("shape", pa.int32()), ("ratio", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.unpackbits(known.value).view(bool)
        for b in batches:
            n = len(keys)
            texts, titles = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            found = [[dict(zip(_FIELDS, x)) for x in nodes(t, h, words)] if t else [] for t, h in zip(texts, titles)]
            page = [zlib.crc32((h or t or "").encode()) for t, h in zip(texts, titles)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(page, pa.int64()), pa.array(found, kind)], names=names)

    return rows.mapInArrow(run, schema)


def path_ratios(pages: DataFrame) -> Paths:
    """Per path over all pages: its own mean ratio, that of the lines after it, and how often a short line follows."""
    after = F.transform("nodes", lambda x, i: F.struct(x["kind"].alias("kind"), x["leaf"].alias("leaf"), x["shape"].alias("shape"), x["ratio"].alias("own"), F.get("nodes", i + 1).alias("next")))
    lines = pages.select("_page", F.inline(after)).where(F.col("kind").isin(FOREIGN, PROSE))
    measured = lines.select("_page", "shape", "leaf", "own", F.coalesce("next.ratio", F.lit(0.0)).alias("after"), F.coalesce(F.col("next.kind").isin(SHORT, TAGS), F.lit(False)).cast("double").alias("short"))
    stats = [F.avg("own").alias("own"), F.avg("after").alias("after"), F.avg("short").alias("short")]
    n_pages = pages.agg(F.approx_count_distinct("_page")).head()[0]
    least = max(LEAF_PAGES, LEAF_SHARE * n_pages)
    by_leaf = measured.where("leaf <> 0").groupBy("shape", "leaf").agg(F.count("*").alias("lines"), F.approx_count_distinct("_page", 0.02).alias("n"), *stats)
    # the leaves that stand for themselves are few; all others are summed up by shape
    own = by_leaf.where(F.col("n") >= least).select("shape", "leaf", "n", "own", "after", "short")
    mean = lambda c: (F.sum(F.col(c) * F.col("lines")) / F.sum("lines")).alias(c)
    rest = by_leaf.where(F.col("n") < least).groupBy("shape").agg(F.sum("lines").alias("n"), mean("own"), mean("after"), mean("short")).select("shape", F.lit(0).cast("bigint").alias("leaf"), "n", "own", "after", "short")
    prose = measured.where("leaf = 0").groupBy("shape").agg(F.count("*").alias("n"), *stats).select("shape", F.lit(0).cast("bigint").alias("leaf"), "n", "own", "after", "short")
    return Paths([tuple(r) for r in reduce(DataFrame.unionByName, (own, rest, prose)).collect()], least)


def boilerplate_lines(df: DataFrame, body: str, title: str, keys: list[str]) -> DataFrame:
    """``keys`` and line_no (from 0, over the pieces between line feeds) of every line that isn't the page's own content.

    Blank lines never count.  Null or blank bodies give no rows; repeated rows
    are judged one by one.  What the corpus teaches is of bounded size: a map
    of SLOTS bits and the paths on at least a share LEAF_SHARE of all pages.
    """
    pages = cut(page_nodes(df, body, title, keys))
    paths = path_ratios(pages)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[: len(keys)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [furniture([tuple(r[f] for f in _FIELDS) for r in page], paths) for page in b.column(len(keys) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(lines, pa.list_(pa.int32()))], names=[*keys, "lines"])

    return pages.mapInArrow(judge, f"{fields}, lines array<int>").select(*keys, F.explode("lines").alias("line_no"))


def main_body(df: DataFrame, body: str, title: str, key: str) -> DataFrame:
    """(``key``, main_text) of every page: its body without the lines that belong to the page around it."""
    drop = boilerplate_lines(df, body, title, [key]).groupBy(key).agg(F.collect_set("line_no").alias("_drop"))
    rows = df.select(key, F.col(body).alias("_body")).join(drop, key, "left")
    kept = F.filter(F.split("_body", "\n"), lambda line, i: ~F.coalesce(F.array_contains("_drop", i), F.lit(False)))
    return rows.select(key, F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")).alias("main_text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of community and blog posts: tab, rec_id, body_text, title."""
    tabs = (("techcommunity_posts", "post_id"), ("blog_posts", "blog_id"))
    one, two = (table(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col(k).alias("rec_id"), "body_text", "title") for t, k in tabs)
    return one.unionByName(two)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of post bodies that belong to the page around the post."""
    return boilerplate_lines(pages(spark, sf_dir), "body_text", "title", ["tab", "rec_id"])
