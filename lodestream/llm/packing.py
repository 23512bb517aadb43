"""Filling containers of fixed capacity with texts, by histogram of their sizes.

The histogram of sizes (at most ``capacity`` entries) is solved on the driver.
All sizes go into classes, each known by its largest size; shallow combinations
of up to three classes, with repeats, that fill a window below the capacity get
repeat counts by non-negative least squares against the classes' counts, are
rounded, and are filled with the exact sizes of their classes.  This is done
again on what is left; the last residuals are packed greedily, always into the
fullest container that still has room.  The plan is in terms of sizes and
repeats, never of single texts.  Executors rank texts within their size and
read their place off the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, table
from .bpe import count_texts

Plan = list[tuple[tuple[int, ...], int]]  # sizes in one container, number of such containers
#: Classes of sizes, the part of the capacity that a combination may leave free, and how often the rest is solved again.
CLASSES, WINDOW, PASSES = 64, 32, 6


def nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with non-negative unknowns, by active sets; no more unknowns than rows are positive."""
    x, active = np.zeros(a.shape[1]), []
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * len(b)):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance:
            break
        active.append(best)
        while True:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[active] = z
                break
            old = x[active]
            falling = z <= 0
            step = np.min(old[falling] / np.maximum(old[falling] - z[falling], 1e-300))
            moved = old + step * (z - old)
            kept = [k for k, v in zip(active, moved) if v > 1e-12]
            x[:] = 0
            for k, v in zip(active, moved):
                if v > 1e-12:
                    x[k] = v
            if len(kept) == len(active) or not kept:  # no progress is left
                return x
            active = kept
    return x


def combinations(sizes: np.ndarray, capacity: int, window: int) -> list[dict[int, int]]:
    """Combinations {class: repeats} of at most three of ``sizes`` (ascending) that fill all but ``window`` of the capacity.

    The first of a combination is repeated by powers of two or as often as it
    fits, the second as often as it then fits, the third is the largest that
    fits the rest.
    """
    found: dict[tuple, dict[int, int]] = {}

    def add(parts: list[tuple[int, int]]) -> None:
        one: dict[int, int] = {}
        for i, k in parts:
            one[i] = one.get(i, 0) + k
        found.setdefault(tuple(sorted(one.items())), one)

    for i, a in enumerate(sizes.tolist()):
        times = {1 << p for p in range(int(capacity // a).bit_length()) if a << p <= capacity} | {capacity // a}
        for k in times:
            left = capacity - a * k
            if left <= window:
                add([(i, k)])
            for j in range(int(np.searchsorted(sizes, left, side="right"))):
                b = int(sizes[j])
                for m in {1, left // b}:
                    rest = left - b * m
                    if rest <= window:
                        add([(i, k), (j, m)])
                    elif rest >= sizes[0]:
                        c = int(np.searchsorted(sizes, rest, side="right")) - 1
                        if rest - int(sizes[c]) <= window:
                            add([(i, k), (j, m), (c, 1)])
    return list(found.values())


def solved(left: dict[int, int], capacity: int, classes: int = CLASSES) -> Plan:
    """Containers by least squares over all sizes of ``left``, from which what is placed is taken; one pass."""
    sizes = np.array(sorted(left))
    volume = np.cumsum(np.array([s * left[s] for s in sizes.tolist()], float))
    # classes of about equal volume; each ends with a size that occurs
    ends = np.unique(np.append(np.searchsorted(volume, np.linspace(0, volume[-1], min(classes, len(sizes)) + 1)[1:-1]), len(sizes) - 1))
    members = np.split(np.arange(len(sizes)), ends[:-1] + 1)
    combos = combinations(sizes[ends], capacity, max(1, capacity // WINDOW))
    if not combos:
        return []
    a = np.zeros((len(ends), len(combos)))
    for j, c in enumerate(combos):
        for i, k in c.items():
            a[i, j] = k
    counts = np.array([sum(left[int(s)] for s in sizes[m]) for m in members], float)
    repeats = nonnegative(a, counts)
    at = {int(s): i for i, m in enumerate(members) for s in sizes[m]}
    have, there, out = counts.astype(np.int64), sizes.tolist(), []
    for j in np.argsort(-repeats, kind="stable"):
        n = int(np.ceil(repeats[j] - 1e-6))
        slots = [i for i, k in sorted(combos[j].items(), reverse=True) for _ in range(k)]
        while n > 0 and all(have[i] >= k for i, k in combos[j].items()):
            # the largest sizes of the classes first; the last slot takes the largest size that fits, of whatever class
            need: dict[int, int] = {}
            free = capacity
            for i in slots[:-1]:
                size = next(s for s in reversed(sizes[members[i]].tolist()) if left[s] > need.get(s, 0))
                need[size] = need.get(size, 0) + 1
                free -= size
            k = bisect_left(there, free + 1) - 1
            while k >= 0 and left[there[k]] <= need.get(there[k], 0):
                if not left[there[k]]:
                    del there[k]
                k -= 1
            if k >= 0:
                need[there[k]] = need.get(there[k], 0) + 1
            run = min([n, *(left[s] // m for s, m in need.items())])
            out.append((tuple(s for s in sorted(need, reverse=True) for _ in range(need[s])), run))
            for s, m in need.items():
                left[s] -= m * run
                have[at[s]] -= m * run
            n -= run
    return out


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> tuple[Plan, int]:
    """Containers for all items of the histogram (sizes 1..capacity), every item exactly once, and how many items the least squares placed."""
    left = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    total, out = sum(left.values()), []
    for _ in range(PASSES):
        left = {s: n for s, n in left.items() if n}
        some = solved(left, capacity, classes) if left else []
        out += some
        if sum(len(items) * n for items, n in some) < 0.01 * total:
            break
    by_squares = sum(len(items) * n for items, n in out)
    # greedy: largest size first, into the open combination with the least room that suffices
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []

    def put(items: tuple[int, ...], n: int) -> None:
        free = capacity - sum(items)
        if free not in room:
            room[free] = []
            insort(order, free)
        room[free].append((items, n))

    for items, n in out:
        put(items, n)
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = bisect_left(order, size)
            if at < len(order):
                free = order[at]
                items, have = room[free].pop()
                if not room[free]:
                    del room[free], order[at]
                # as many of this size as fit into one, unless there are fewer
                each = min(free // size, n)
                take = min(have, n // each)
                if take < have:
                    put(items, have - take)
                put(items + (size,) * each, take)
                n -= take * each
            else:
                each = min(capacity // size, n)
                fresh = n // each
                put((size,) * each, fresh)
                n -= fresh * each
    return [x for free in order for x in room[free]], by_squares


def places(plans: dict[str, Plan]) -> pd.DataFrame:
    """Ranges of ranks of each size: container, size, first_rank, n_ranks, per_container, first_no, offset."""
    rows = []
    for name, made in plans.items():
        used: dict[int, int] = {}
        number = 0
        for items, n in made:
            offset = 0
            for size in sorted(set(items), reverse=True):
                each = items.count(size)
                first = used.get(size, 0)
                rows.append((name, size, first, n * each, each, number, offset))
                used[size] = first + n * each
                offset += each * size
            number += n
    return pd.DataFrame(rows, columns=["container", "size", "first_rank", "n_ranks", "per_container", "first_no", "offset"])


def pack(sizes: DataFrame, key: str, size: str, capacities: dict[str, int], buckets: int | None = None) -> DataFrame:
    """(container, container_no, ``key``, piece_no, from_token, n_tokens, at_token) of every piece of every text.

    A text is divided only if it alone exceeds the capacity: into full pieces
    and one rest.  Texts of no tokens or null size take no room and are not
    placed.  Pieces of one container follow one another from ``at_token``.
    Repeated keys are packed as separate texts.  Containers are numbered from 0.
    """
    buckets = buckets or max(64, 4 * int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in capacities.items()])
    rows = sizes.select(F.col(key).alias("key"), F.col(size).alias("total")).where("total > 0").select("key", "total", F.inline(names))
    pieces = rows.select("container", "capacity", "key", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / F.col("capacity")))).alias("piece_no"))
    pieces = pieces.select("container", "key", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("from_token"), F.least("capacity", F.col("total") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"))
    # ranks within a size without one task per size: a size is cut into buckets whose counts give the first rank
    pieces = cut(pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "piece_no"), F.lit(buckets))))
    counts = pieces.groupBy("container", "n_tokens", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("container", "n_tokens", "bucket", (F.sum("n").over(Window.partitionBy("container", "n_tokens").orderBy("bucket")) - F.col("n")).alias("start"))
    histogram: dict[str, dict[int, int]] = {n: {} for n in capacities}
    for r in counts.groupBy("container", "n_tokens").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        histogram[r["container"]][r["n_tokens"]] = r["n"]
    table_ = places({n: plan(histogram[n], c)[0] for n, c in capacities.items()}).sort_values(["container", "size", "first_rank"])
    ranked = pieces.withColumn("in_bucket", F.row_number().over(Window.partitionBy("container", "n_tokens", "bucket").orderBy("key", "piece_no")) - 1)
    ranked = ranked.join(starts, ["container", "n_tokens", "bucket"]).withColumn("rank", F.col("start") + F.col("in_bucket"))
    by_name = {n: g.reset_index(drop=True) for n, g in table_.groupby("container")}

    @F.pandas_udf("container_no long, at_token long")
    def find(container: pd.Series, n_tokens: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"container_no": np.zeros(len(rank), np.int64), "at_token": np.zeros(len(rank), np.int64)})
        for name, rows in by_name.items():
            mine = np.flatnonzero((container == name).to_numpy())
            if not len(mine):
                continue
            base = np.int64(1) << np.int64(40)
            starts = rows["size"].to_numpy(np.int64) * base + rows["first_rank"].to_numpy(np.int64)
            at = np.searchsorted(starts, n_tokens.to_numpy(np.int64)[mine] * base + rank.to_numpy(np.int64)[mine], side="right") - 1
            inside = rank.to_numpy(np.int64)[mine] - rows["first_rank"].to_numpy(np.int64)[at]
            each = rows["per_container"].to_numpy(np.int64)[at]
            out.loc[mine, "container_no"] = rows["first_no"].to_numpy(np.int64)[at] + inside // each
            out.loc[mine, "at_token"] = rows["offset"].to_numpy(np.int64)[at] + (inside % each) * n_tokens.to_numpy(np.int64)[mine]
        return out

    placed = ranked.withColumn("_p", find("container", "n_tokens", "rank"))
    return placed.select("container", F.col("_p.container_no").alias("container_no"), F.col("key").alias(key), "piece_no", "from_token", "n_tokens", F.col("_p.at_token").alias("at_token"))


def capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Containers by name; the table is fixed and tiny."""
    return {r["container"]: r["capacity_tokens"] for r in table(spark, sf_dir, "container_sizes").where("container is not null and capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").alias("capacity_tokens")).collect()}


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container and place."""
    sizes = cut(count_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text"))
    return pack(sizes, "doc_id", "n_tokens", capacities(spark, sf_dir))


def p9_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens placed and share of room used per kind of container."""
    room = capacities(spark, sf_dir)
    rows = p9_packing(spark, sf_dir).groupBy("container", "container_no").agg(F.sum("n_tokens").alias("used"))
    size = F.create_map(*[F.lit(x) for pair in room.items() for x in pair])
    done = rows.groupBy("container").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return done.withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.element_at(size, F.col("container"))))
