"""Share of a text that repeats earlier parts of it, and adaptive cut-offs per language and source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table
from .bpe import _blocks
from .common import language, spread

_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x100000001B3)


def repeated_share(texts: list[str | None], run: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and how many lie in a run of ``run`` words that began earlier in the same text."""
    code: dict[str, int] = {}
    get = code.setdefault
    rows = [[get(w, len(code)) for w in _WORD.findall(t.lower())] if t else [] for t in texts]
    count = np.array([len(r) for r in rows], np.int64)
    repeated = np.zeros(len(rows), np.int64)
    words = np.array([c for r in rows for c in r], np.int64)
    if len(words) < run:
        return count, repeated
    doc = np.repeat(np.arange(len(rows)), count)
    n = len(words) - run + 1
    inside = np.flatnonzero(doc[:n] == doc[run - 1 :])
    key = doc[inside].astype(np.uint64) + np.uint64(0xCBF29CE484222325)
    for k in range(run):
        key = (key ^ words[inside + k].astype(np.uint64)) * _STEP
        key ^= key >> np.uint64(29)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    earlier = inside[first[back]]
    again = earlier < inside
    for k in range(run):  # equal keys of unequal runs don't count
        again &= words[earlier + k] == words[inside + k]
    again &= doc[earlier] == doc[inside]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, inside[again], 1)
    np.add.at(edge, inside[again] + run, -1)
    np.add.at(repeated, doc[np.cumsum(edge[:-1]) > 0], 1)
    return count, repeated


def measure(df: DataFrame, text: str, out: str = "repeated_share", run: int = 5) -> DataFrame:
    """``df`` without ``text``, with ``out`` (double): the share of words in runs that occurred before.

    Null, empty and shorter texts have share 0.  Rows are kept one to one;
    whole texts are read, of any length.
    """
    rest = [f for f in df.schema.fields if f.name != text]
    rows = spread(df.select(text, *[f.name for f in rest]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            count, repeated = repeated_share(b.column(0).to_pylist(), run)
            share = pa.array(repeated / np.maximum(count, 1), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], share], names=[*[f.name for f in rest], out])

    return rows.mapInArrow(work, T.StructType([*rest, T.StructField(out, T.DoubleType())]))


#: Texts that a group must hold, and that must lie above its gap, for the group to have a cut-off of its own; points read off a sketch.
GROUP, ABOVE, POINTS = 200, 20, 400


def thresholds(shares: DataFrame, by: list[str], value: str, default: float = 0.3, group: int = GROUP, above: int = ABOVE) -> DataFrame:
    """One cut-off per group: the middle of the widest gap that its distribution leaves above its median.

    The distributions are quantile sketches (KLL), merged from partial ones,
    of every group, of the groups merged over the last label, and so on up to
    all rows.  A group with fewer than ``group`` texts, or fewer than ``above``
    over its gap, takes the cut-off of the next larger one; ``default`` holds
    only where all rows together have no gap.
    """
    keyed = shares.select(value, *by)
    sketch = F.kll_sketch_agg_double(F.col(value)).alias("_sketch")
    levels = []
    fine = keyed.groupBy(*by).agg(sketch, F.count("*").alias("_n"))
    for k in range(len(by), -1, -1):
        some = fine.groupBy(*by[:k]).agg(F.kll_merge_agg_double("_sketch").alias("_sketch"), F.sum("_n").alias("_n")) if k < len(by) else fine
        points = F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(i / POINTS) for i in range(POINTS + 1)])))
        gaps = F.transform(
            F.slice("_points", POINTS // 2 + 1, POINTS // 2),
            lambda q, i: F.struct((F.get("_points", i + POINTS // 2 + 1) - q).alias("width"), (F.lit(POINTS // 2 - 1) - i).alias("over"), ((F.get("_points", i + POINTS // 2 + 1) + q) / 2).alias("middle")),
        )
        made = some.withColumn("_points", points).withColumn("_gap", F.array_max(gaps))
        enough = (F.col("_gap.width") > 0) & (F.col("_n") >= group) & ((F.col("_gap.over") + 1) * F.col("_n") / POINTS >= above)
        own = F.when(enough if k else F.col("_gap.width") > 0, F.col("_gap.middle")).alias(f"_cut{k}")
        levels.append((by[:k], made.select(*by[:k], own)))
    out = levels[0][1]
    for names, coarse in levels[1:-1]:
        out = out.join(coarse, names, "left")
    last = levels[-1][1].head()  # one number
    cuts = [F.col(f"_cut{k}") for k in range(len(by), 0, -1)]
    return out.select(*by, F.coalesce(*cuts, F.lit(last[0] if last and last[0] is not None else default)).alias("threshold"))


#: Groups up to which their cut-offs are broadcast.
FEW_GROUPS = 100_000


def repetitive(df: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """(``key``, lang, source, repeated_share, threshold, is_repetitive) of every row; the measured shares are stored once."""
    rows = df.select(F.col(key).alias(key), F.col(text).alias("_text"), language(F.col(lang)).alias("lang"), F.coalesce(F.lower(F.trim(F.col(source))), F.lit("")).alias("source"))
    shares = cut(measure(rows, "_text"))
    limits = cut(thresholds(shares, ["lang", "source"], "repeated_share"))
    if limits.count() <= FEW_GROUPS:
        limits = F.broadcast(limits)
    return shares.join(limits, ["lang", "source"]).withColumn("is_repetitive", F.col("repeated_share") >= F.col("threshold"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with much repetition."""
    return repetitive(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source").where("is_repetitive").select("doc_id")


def p10_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and repetitive rows per language and source, with the cut-off used."""
    rows = repetitive(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.count_if("is_repetitive").alias("n_repetitive"), F.max("threshold").alias("threshold"))


P10_FOUND_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, g) AS first FROM g) WHERE i > first),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS t(k) GROUP BY 1)
SELECT doc_id FROM c JOIN w USING (doc_id) WHERE n >= 0.3 * len(w)
"""
