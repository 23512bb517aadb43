"""Byte-pair encoding of a corpus in numpy.

Texts are cut by the vocabulary's pattern; every distinct piece of a task is
encoded once.  Pieces of similar length form a padded matrix of symbol ids; in
each round every row replaces its leftmost pair of minimum rank, found by a
hashed lookup of all adjacent pairs, closes the gap and leaves the matrix when
no pair is left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import spread, tokenizer_dir

# Fixed value: the pattern that goes with the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows longer than this are merged one by one, all places of the best pair at once.
LONG = 256
#: Distinct pieces a worker remembers before it starts afresh.
MEMORY = 400_000
_loaded: dict[str, Encoder] = {}


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stays, others follow 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encoder for one byte-level vocabulary file (JSON with ``vocab`` and ``merges``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = np.zeros(256, np.int32)
        for symbol, byte in byte_symbols().items():
            self.first[byte] = vocab[symbol]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self._build(pairs)
        self.cut = regex.compile(PIECES)
        self._reset()

    def _build(self, pairs: np.ndarray) -> None:
        """Open-addressing table: pair of ids -> rank and merged id."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.made = np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        keys = (pairs[:, 0] << 20) | pairs[:, 1]
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, one = np.unique(slot[free], return_index=True)  # one newcomer a slot
            take = free[one]
            self.keys[slot[take]] = keys[take]
            self.rank[slot[take]], self.made[slot[take]] = take, pairs[take, 2]
            left = np.setdiff1d(left, take)
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; rank _NONE where there is none."""
        key = (a.astype(np.int64) << 20) | b
        slot = self._slot(key)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            open_ = open_[(there != key[open_]) & (there != -1)]
        hit = self.keys[slot] == key
        return np.where(hit, self.rank[slot], _NONE), self.made[slot]

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _matrix(self, rows: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Encode padded rows of symbol ids (-1 behind their end)."""
        out: list[np.ndarray | None] = [None] * len(rows)
        who = np.arange(len(rows))
        while len(rows):
            width = int(size.max())
            rows = rows[:, :width]
            rank = np.full((len(rows), max(width - 1, 1)), _NONE, np.int32)
            made = np.zeros_like(rank)
            live = np.arange(max(width - 1, 1))[None, :] < (size - 1)[:, None]
            if width > 1:
                rank[live], made[live] = self._find(rows[:, :-1][live], rows[:, 1:][live])
            at = rank.argmin(axis=1)  # the leftmost of equal ranks
            all_rows = np.arange(len(rows))
            done = rank[all_rows, at] == _NONE
            for i in np.flatnonzero(done):
                out[who[i]] = rows[i, : size[i]]
            go = np.flatnonzero(~done)
            rows, at, size, who, made = rows[go], at[go], size[go], who[go], made[go]
            if not len(rows):
                break
            n = np.arange(len(rows))
            rows[n, at] = made[n, at]
            column = np.arange(width)[None, :]
            column = np.minimum(column + (column > at[:, None]), width - 1)
            rows = np.take_along_axis(rows, column, axis=1)
            size = size - 1
        return out  # type: ignore[return-value]

    def _long(self, row: np.ndarray) -> np.ndarray:
        """One long row: all places of the best pair are merged in one round, left to right (same result)."""
        while len(row) > 1:
            rank, made = self._find(row[:-1], row[1:])
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of touching places every second one counts
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[nth % 2 == 0]
            row = row.copy()
            row[at] = made[at]
            row = np.delete(row, at + 1)
        return row

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(b) for b in raw], np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        order = np.argsort(size, kind="stable")
        edge, low = 4, 0
        while low < len(order):
            top = int(np.searchsorted(size[order], edge, side="right")) if edge <= LONG else len(order)
            bucket = order[low:top]
            if edge > LONG:
                for i in bucket:
                    found[i] = self._long(self.first[np.frombuffer(raw[i], np.uint8)])
            elif len(bucket):
                for some in np.array_split(bucket, max(1, len(bucket) * edge // 2_000_000)):
                    rows = np.full((len(some), edge), -1, np.int32)
                    inside = np.arange(edge)[None, :] < size[some][:, None]
                    rows[inside] = self.first[np.frombuffer(b"".join(raw[i] for i in some), np.uint8)]
                    for i, ids in zip(some, self._matrix(rows, size[some])):
                        found[i] = ids
            low, edge = top, edge * 2 if edge < 16 else edge + edge // 2
        lengths = np.array([len(f) for f in found], np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.size = np.concatenate([self.size, lengths])
        self.flat = np.concatenate([self.flat, *found])

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece codes of all texts in one row, and the number of pieces of each text."""
        if len(self.code) > MEMORY:
            self._reset()
        before = len(self.code)
        code, find = self.code, self.cut.findall
        get = code.setdefault
        out: list[int] = []
        count = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                row = [get(w, len(code)) for w in find(t)]
                count[i] = len(row)
                out += row
        if len(code) > before:
            self._learn(list(code)[before:])
        return np.array(out, np.int64), count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one row, and where each text begins (one more entry than texts)."""
        codes, count = self.codes(texts)
        size = self.size[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[codes] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(count)])]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        codes, count = self.codes(texts)
        ends = np.concatenate([[0], np.cumsum(self.size[codes])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(count)])])


def load(path: str) -> Encoder:
    """The encoder of ``path``, once per worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their texts (second column) stay near ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * limit / max(batch.nbytes, limit)))
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(``key``, ids array<int>) of every row.

    Null and empty texts give an empty list, marker strings are ordinary text,
    no special tokens are added; repeated rows are kept one to one; other
    columns of ``df`` are not read.
    """
    path = vocabulary or f"{tokenizer_dir()}/byte_bpe_50k.json"
    rows = spread(df.select(key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for b in _blocks(batches):
            ids, starts = encoder.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def count_texts(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``out`` (bigint): the number of ids of ``text``, 0 for null and empty texts; ``text`` itself is dropped."""
    path = vocabulary or f"{tokenizer_dir()}/byte_bpe_50k.json"
    rest = [f for f in df.schema.fields if f.name != text]
    rows = spread(df.select(text, *[f.name for f in rest]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for b in _blocks(batches):
            n = pa.array(encoder.count(b.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n], names=[*[f.name for f in rest], out])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.LongType())]))
