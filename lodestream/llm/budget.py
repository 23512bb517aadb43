"""Exact token counts under byte_bpe_50k, totalled by source, language and domain.

The vocabulary is a trie whose nodes carry a failure link and, precomputed, the
longest token that ends there; every token knows the longest token that is a
proper end of it.  A piece is read once: at each byte the tokens that end there
are tried from the longest on, and the first that may follow the token chosen
where it begins is the last token of the merge encoding so far.  Whether one
token may follow another is told by the merge ranks alone (``Matcher.follows``)
and remembered.  So the longest match is exact for a vocabulary of merges, too.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.instants import url_host
from ..session import table
from .bpe import MEMORY, PIECES, _blocks, byte_symbols
from .common import language, spread, tokenizer_dir, type_names

_tries: dict[str, Matcher] = {}
#: Labelled texts (by hash of their key) that the language model is fitted on, its features, and the share of them a language must have.
LANGUAGE_ROWS, FEATURES, LANGUAGE_SHARE = 20_000, 1 << 13, 0.005


class Matcher:
    """Counting over a vocabulary of byte strings and its merges (pairs of places in it, by rank).

    ``merges`` has (left, right, made).  Every single byte must have a token.
    """

    def __init__(self, vocabulary: list[bytes], merges: list[tuple[int, int, int]]):
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        # how a token came about, by the first merge that makes it
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b, c) in enumerate(merges):
            self.parts.setdefault(c, (rank, a, b))
        # tokens that no encoding gives, as earlier merges get in their way, are left out
        usable = [len(t) == 1 for t in vocabulary]
        for c, (_, a, b) in self.parts.items():
            usable[c] = usable[a] and usable[b] and self._apart(a, b, made_by_merge=True)
        self.size = [len(t) for t in vocabulary]
        self.step: list[dict[int, int]] = [{}]
        token_at = [-1]
        for i, token in enumerate(vocabulary):
            if not usable[i]:
                continue
            node = 0
            for b in token:
                nxt = self.step[node].get(b)
                if nxt is None:
                    nxt = len(self.step)
                    self.step[node][b] = nxt
                    self.step.append({})
                    token_at.append(-1)
                node = nxt
            token_at[node] = i
        if missing := [b for b in range(256) if b not in self.step[0] or token_at[self.step[0][b]] < 0]:
            raise ValueError(f"bytes {missing[:3]} have no token of their own")
        # fail: the longest proper end of a node that is a node; ends: the longest token that ends there
        self.fail, self.ends, self.shorter = [0] * len(self.step), list(token_at), [-1] * len(vocabulary)
        queue = deque(self.step[0].values())
        while queue:
            u = queue.popleft()
            if self.ends[u] < 0:
                self.ends[u] = self.ends[self.fail[u]]
            elif self.fail[u]:
                self.shorter[token_at[u]] = self.ends[self.fail[u]]
            for b, v in self.step[u].items():
                at = self.fail[u]
                while at and b not in self.step[at]:
                    at = self.fail[at]
                self.fail[v] = self.step[at].get(b, 0)
                queue.append(v)
        self.cut = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether the merge encoding of the two tokens' bytes is just these two."""
        told = self.pairs.get((left, right))
        if told is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            told = self.pairs[left, right] = self._apart(left, right)
        return told

    def _apart(self, a: int, b: int, made_by_merge: bool = False) -> bool:
        """Whether no merge joins across the border before both tokens are finished (but for the one of the tokens themselves, if ``made_by_merge``).

        The tokens are taken apart from the last merge made; ``before`` is the
        rank that a joining merge would have to lie below to come first.  Of
        merges of one rank the one further left comes first.
        """
        before = len(self.made) + 1
        while True:
            joined = self.made.get((a, b))
            if joined and joined[0] < before and not made_by_merge:
                return False
            made_by_merge = False
            left, right = (self.parts[x][0] if x in self.parts else -1 for x in (a, b))
            if left < 0 and right < 0:
                return True
            if left > right:
                before, a = left, self.parts[a][2]
            else:
                before, b = right + 1, self.parts[b][1]

    def piece(self, data: bytes) -> int:
        """Number of tokens of one piece."""
        step, fail, ends, size, shorter = self.step, self.fail, self.ends, self.size, self.shorter
        node, last, count = 0, [-1], [0]
        for i, b in enumerate(data, 1):
            while node and b not in step[node]:
                node = fail[node]
            node = step[node][b]
            token = ends[node]
            while (start := i - size[token]) and not self.follows(last[start], token):
                token = shorter[token]
            last.append(token)
            count.append(count[start] + 1)
        return count[-1]

    def count(self, text: str | None) -> int:
        """Number of tokens of a text; 0 for null and empty ones."""
        if not text:
            return 0
        if len(self.known) > MEMORY:
            self.known.clear()
        known, total = self.known, 0
        for w in self.cut.findall(text):
            n = known.get(w)
            if n is None:
                n = known[w] = self.piece(w.encode("utf-8", "surrogatepass"))
            total += n
        return total


def vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """Byte strings and merges of a byte-level vocabulary file, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", [])}
    symbols, tokens = byte_symbols(), [t for t in data["model"]["vocab"] if t not in special]
    place = {t: i for i, t in enumerate(tokens)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    return [bytes(symbols[c] for c in t) for t in tokens], [(place[a], place[b], place[a + b]) for a, b in merges]


def matcher(path: str) -> Matcher:
    """The matcher of ``path``, built once per worker."""
    if path not in _tries:
        _tries[path] = Matcher(*vocabulary(path))
    return _tries[path]


def letters(text: str | None) -> np.ndarray:
    """How often each hashed run of three bytes of the text's letters occurs."""
    data = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text or ''} ".lower()).encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    runs = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761) >> np.uint32(19)
    return np.bincount(runs, minlength=FEATURES)


class Languages:
    """A naive Bayes model over runs of three bytes."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.weight = np.log(counts + 0.5) - np.log((counts + 0.5).sum(axis=1, keepdims=True)) if names else np.zeros((0, FEATURES))

    def guess(self, text: str | None) -> str:
        """The likeliest language; ``und`` for texts without letters or without a model."""
        if not self.names or not text or not re.search(r"[^\W\d_]", text):
            return "und"
        return self.names[int(np.argmax(self.weight @ letters(text)))]


def fit_languages(texts: DataFrame, key: str, text: str, lang: str, most: int = LANGUAGE_ROWS) -> Languages:
    """A model of the languages that labelled rows name, fitted on about ``most`` of them at most (a bounded sample by hash of ``key``); the texts are read whole."""
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("t"), language(F.col(lang)).alias("l")).where("t is not null and l not in ('und', 'un')")
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), "k"), F.lit(1 << 20)) < int(min(1.0, most / max(n, 1)) * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in batches:
            for t, name in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                sums[name] = sums.get(name, 0) + letters(t)
                seen[name] = seen.get(name, 0) + 1
        for name, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array([*at, -1], pa.int32()), pa.array([*v[at], seen[name]], pa.int64())], names=["l", "f", "n"])

    sums = sample.mapInArrow(run, "l string, f int, n bigint").groupBy("l", "f").agg(F.sum("n").alias("n"))
    enough = sums.where("f = -1").orderBy(F.desc("n"), "l").limit(64).collect()
    total = sum(r["n"] for r in enough)
    names = sorted(r["l"] for r in enough if r["n"] >= LANGUAGE_SHARE * total)
    counts = np.zeros((len(names), FEATURES))
    for r in sums.where(F.col("l").isin(names) & (F.col("f") >= 0)).collect() if names else []:  # 64 x FEATURES at most
        counts[names.index(r["l"]), r["f"]] = r["n"]
    return Languages(names, counts)


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", path: str | None = None, guess: Languages | None = None, lang: str = "lang") -> DataFrame:
    """``df`` without ``text``, with ``out`` (bigint): its tokens under byte_bpe_50k, as many as the merges give.

    Null and empty texts count 0; rows are kept one to one.  With ``guess`` a
    null, ``und`` or ``un`` in ``lang`` is replaced by the text's language.
    """
    path = path or f"{tokenizer_dir()}/byte_bpe_50k.json"
    rest = [f for f in df.schema.fields if f.name != text]
    rows = spread(df.select(text, *[f.name for f in rest]))
    names = [*[f.name for f in rest], out]
    at = names.index(lang) if guess else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(path)
        for b in _blocks(batches):
            texts, columns = b.column(0).to_pylist(), list(b.columns[1:])
            if guess:
                columns[at] = pa.array([guess.guess(t) if v in (None, "und", "un") else v for t, v in zip(texts, columns[at].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.fromiter(map(m.count, texts), np.int64, b.num_rows))], names=names)

    return rows.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.LongType())]))


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with one spelling of their labels: tab, source_type, lang, domain, text.

    Posts carry no language, and some labels are missing or unspecific: such
    texts have ``und`` here, which counting replaces; videos have no domain but
    their channel; source types that name nothing known stay in lower case,
    missing ones become ``unknown``.
    """
    get = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")
    documents = get("documents").select(F.lit("documents").alias("tab"), "source_type", F.col("lang"), F.col("source").alias("domain"), "text")
    posts = get("techcommunity_posts").select(F.lit("techcommunity_posts").alias("tab"), "source_type", none.alias("lang"), url_host(F.col("url")).alias("domain"), F.col("body_text").alias("text"))
    blogs = get("blog_posts").select(F.lit("blog_posts").alias("tab"), "source_type", none.alias("lang"), url_host(F.col("url")).alias("domain"), F.col("body_text").alias("text"))
    videos = get("videos").select(F.lit("videos").alias("tab"), "source_type", F.col("transcript_language").alias("lang"), F.col("channel_id").alias("domain"), F.col("transcript_text").alias("text"))
    rows = documents.unionByName(posts).unionByName(blogs).unionByName(videos)
    raw = F.lower(F.trim("source_type"))
    names = type_names(get("chunk_config")).withColumnRenamed("source_type", "_type")
    # names that differ from a known one in hyphens only
    loose = names.groupBy(F.regexp_replace("alias", "[-_ ]", "").alias("_loose")).agg(F.min("_type").alias("_type2"))
    rows = rows.withColumn("_raw", raw).join(names, F.col("_raw") == F.col("alias"), "left").drop("alias")
    rows = rows.join(loose, F.regexp_replace("_raw", "[-_ ]", "") == F.col("_loose"), "left")
    other = F.regexp_replace("_raw", "[-_ ]", "-")
    return rows.select("tab", F.coalesce("_type", "_type2", other, F.lit("unknown")).alias("source_type"), language(F.col("lang")).alias("lang"), F.coalesce(F.lower(F.trim("domain")), F.lit("unknown")).alias("domain"), "text")


def p6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and tokens per table, source type, language and domain."""
    guess = fit_languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    rows = count_tokens(labelled_texts(spark, sf_dir), "text", guess=guess)
    return rows.groupBy("tab", "source_type", "lang", "domain").agg(F.count("*").alias("n_texts"), F.count_if(F.col("n_tokens") > 0).alias("n_used"), F.sum("n_tokens").alias("n_tokens"))


def p6_against_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted tokens beside those the pipeline runs have logged (each run once, senseless figures left out)."""
    counted = p6_budget(spark, sf_dir).agg(F.sum("n_tokens").alias("counted_tokens"))
    runs = table(spark, sf_dir, "pipeline_runs").groupBy("run_id").agg(F.max("embedding_tokens").alias("t"))
    logged = runs.agg(F.sum(F.when(F.col("t") > 0, F.col("t"))).alias("logged_tokens"), F.count_if(F.col("t") > 0).alias("runs_with_tokens"))
    told = logged.head()  # one row
    return counted.select("*", F.lit(told["logged_tokens"]).cast("bigint").alias("logged_tokens"), F.lit(told["runs_with_tokens"]).cast("bigint").alias("runs_with_tokens"))
