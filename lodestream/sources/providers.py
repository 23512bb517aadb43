"""Outside services as injected providers: fetching, embedding, completion; offline stand-ins are deterministic."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fetch = Callable[[str], tuple[int, str, str | None]]  # url -> status, body, Retry-After


def fetch_with_retry(fetch: Fetch, url: str, retries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Body of a 200 answer; null for other 3xx/4xx; waits and repeats on 429, 5xx and timeouts, at most ``retries`` times."""
    for attempt in range(retries + 1):
        try:
            status, body, wait = fetch(url)
        except TimeoutError:
            status, body, wait = 599, "", None
        if status == 200:
            return body
        if status != 429 and status < 500:
            return None
        if attempt < retries:
            sleep(float(wait) if status == 429 and wait else base ** (attempt + 1 if status == 429 else attempt))
    return None


def fetch_pages(urls: DataFrame, url: str, provider: Callable[[], Fetch], retries: int = 3) -> DataFrame:
    """(url, html) of every reachable page; concurrency is the number of partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = provider()
        for b in batches:
            yield pd.DataFrame({"url": b[url], "html": [fetch_with_retry(fetch, u, retries) for u in b[url]]})

    return urls.select(url).mapInPandas(run, "url string, html string").where("html is not null")


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float] | None]]:
    """Offline embedding: signed hashed word counts, of unit length; no words give no vector."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


def embed_batch(embed: Callable, texts: list[str], attempts: int = 6, base: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """Vectors of one batch; a failed call is repeated after 1, 2, 4, ... seconds, and after the last attempt all are null."""
    for attempt in range(attempts):
        try:
            return list(embed(texts))
        except Exception:  # noqa: BLE001  a failed batch is null, not fatal
            if attempt + 1 < attempts:
                sleep(min(base * 2**attempt, most))
    return [None] * len(texts)


def averaged(parts: list, sizes: list[int]) -> list[float] | None:
    """Mean of the parts' vectors, weighted by their sizes, of unit length; null if a part has none."""
    if not parts or any(p is None for p in parts):
        return None
    v = np.average(np.array(parts, np.float64), axis=0, weights=sizes)
    n = np.linalg.norm(v)
    return (v / n).tolist() if n else None


def embed_new(chunks: DataFrame, cache: DataFrame | None, text: str, provider: Callable[[], Callable], batch: int = 16, budget: int = 8191 * 4, cut: bool = False, attempts: int = 1) -> DataFrame:
    """``chunks`` with ``content_hash``, ``embedding`` and ``truncated``; only contents the cache lacks are embedded, each once.

    Texts beyond ``budget`` characters are embedded in parts of that size, whose
    vectors are averaged; with ``cut`` only their first part is, and
    ``truncated`` tells it.  A batch that fails ``attempts`` times gives null
    vectors.  Null texts have no vector.
    """
    long = F.coalesce(F.length(text) > budget, F.lit(False))
    rows = chunks.withColumns({"content_hash": F.sha2(text, 256), "truncated": long & F.lit(cut)})
    todo = rows.where(F.col(text).isNotNull()).groupBy("content_hash").agg(F.min(F.substring(text, 1, budget) if cut else F.col(text)).alias("_t"))
    if cache is not None:
        todo = todo.join(cache.select("content_hash"), "content_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = provider()
        for b in batches:
            parts = [[t[i : i + budget] for i in range(0, max(len(t), 1), budget)] for t in b["_t"]]
            flat = [p for some in parts for p in some]
            made = [v for i in range(0, len(flat), batch) for v in embed_batch(embed, flat[i : i + batch], attempts)]
            out, at = [], 0
            for some in parts:
                own = made[at : at + len(some)]
                out.append(own[0] if len(some) == 1 else averaged(own, [len(p) for p in some]))
                at += len(some)
            yield pd.DataFrame({"content_hash": b["content_hash"], "embedding": out})

    made = todo.mapInPandas(run, "content_hash string, embedding array<float>")
    if cache is not None:
        made = made.unionByName(cache.select("content_hash", "embedding"))
    return rows.join(made, "content_hash", "left")


def complete(prompts: DataFrame, text: str, provider: Callable[[], Callable[[str], str]], out: str = "answer") -> DataFrame:
    """``prompts`` with the provider's answer; null where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider()
        for b in batches:
            answers = []
            for t in b[text]:
                try:
                    answers.append(ask(t))
                except Exception:  # noqa: BLE001
                    answers.append(None)
            yield b.assign(**{out: answers})

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField(out, T.StringType())]))
