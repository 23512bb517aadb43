"""Rate windows, caches with a lifetime, sessions and high-water marks, batch and streaming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stretches(df: DataFrame, keys: list[str], ts: str, gap: float) -> DataFrame:
    """``df`` with ``stretch``: numbers runs of a key's events between which at least ``gap`` seconds pass without one.

    State of a window or lifetime of ``gap`` seconds never reaches across such
    a silence, so stretches can be worked on apart and a hot key is split.
    Time is cut into slots of ``gap``; an empty slot ends a run.  Only the
    distinct slots of a key are ordered, so what one key costs depends on the
    time it covers and not on its number of events.
    """
    width = int(gap * 1e6)
    rows = df.withColumn("_slot", F.floor(F.unix_micros(ts) / F.lit(width)))
    w = Window.partitionBy(*keys).orderBy("_slot")
    runs = rows.select(*keys, "_slot").distinct().withColumn("stretch", F.col("_slot") - F.row_number().over(w))
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    runs = runs.withColumnsRenamed(names).withColumnRenamed("_slot", "_slot2")
    same = F.col("_slot") == F.col("_slot2")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(runs, same).drop("_slot", "_slot2", *names.values())


def _sequential(df: DataFrame, keys: list[str], ts: str, order: str, step) -> DataFrame:  # noqa: ANN001
    """Runs ``step`` over the rows of every stretch in order; a task reads sorted rows and holds the state of one stretch."""
    group = [*keys, "stretch"]
    kept = [f for f in df.schema.fields if f.name != "stretch"]
    name = F.concat_ws("|", *[F.coalesce(F.concat(F.length(F.col(k).cast("string")), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in group])
    rows = df.withColumns({"_us": F.unix_micros(ts), "_key": name}).repartition(*group).sortWithinPartitions("_key", "_us", order)
    at = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for b in batches:
            flags = []
            for key, us in zip(b.column("_key").to_pylist(), b.column("_us").to_pylist()):
                if key != here:
                    here, state = key, deque()
                flags.append(step(state, us))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in at], pa.array(flags, pa.bool_())], names=[*at, "flag"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("flag", T.BooleanType())]))


def rate_limited(df: DataFrame, keys: list[str], ts: str, order: str, limit: int, window: float = 60.0) -> DataFrame:
    """``df`` with ``allowed``: fewer than ``limit`` allowed events lie within the last ``window`` seconds; denied ones don't count.

    Rows without time are left out; equal times go by ``order``.
    """
    span = int(window * 1e6)

    def step(state: deque, us: int) -> bool:
        while state and state[0] <= us - span:
            state.popleft()
        if len(state) >= limit:
            return False
        state.append(us)
        return True

    return _sequential(stretches(df.where(F.col(ts).isNotNull()), keys, ts, window), keys, ts, order, step).withColumnRenamed("flag", "allowed")


def cached(df: DataFrame, keys: list[str], ts: str, order: str, lifetime: float) -> DataFrame:
    """``df`` with ``hit``: the entry set by the last miss of its key is younger than ``lifetime`` seconds; only a miss sets it."""
    span = int(lifetime * 1e6)

    def step(state: deque, us: int) -> bool:
        if state and us < state[0] + span:
            return True
        state.clear()
        state.append(us)
        return False

    return _sequential(stretches(df.where(F.col(ts).isNotNull()), keys, ts, lifetime), keys, ts, order, step).withColumnRenamed("flag", "hit")


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions by start-to-start gap: key, session start and end, number of events; batch and streaming alike."""
    s = F.session_window(ts, gap)
    return df.groupBy(key, s.alias("s")).agg(F.count("*").alias("n_events")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events")


def new_events(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Each event once: repeats within ``delay`` are dropped, state is bounded by the watermark; works on batches too."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], delay: str | None = None) -> DataFrame:
    """Counts per window of ``width``; with ``delay`` as a stream with a watermark."""
    rows = df.withWatermark(ts, delay) if delay and df.isStreaming else df
    return rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("start"), *by, "n_events")


def upsert_batches(stream: DataFrame, root: str, key: str, order: list[str], checkpoint: str):  # noqa: ANN201
    """Writes a stream into a versioned Parquet index; a version is named by the batch, so a repeated batch overwrites its own."""
    from ..operators.index import latest, upsert, write_version

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        incoming = latest(batch, key, order)
        if number:
            incoming = upsert(spark.read.parquet(f"{root}/version-{number - 1:012d}"), incoming, key)
        write_version(incoming, root, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limited_stream(stream: DataFrame, key: str, ts: str, limit: int, window: float = 60.0) -> DataFrame:
    """Streaming twin of ``rate_limited``: (key, ts, allowed); the state of a key is its last allowed times and leaves once the watermark has passed the window."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = int(window * 1e6)
    kind = stream.schema[key].dataType.simpleString()

    def each(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        times = pd.concat(list(batches))[ts].sort_values()
        flags = []
        for t in times:
            us = int(t.value // 1000)
            while kept and kept[0] <= us - span:
                kept.popleft()
            flags.append(len(kept) < limit)
            if flags[-1]:
                kept.append(us)
        state.update((list(kept),))
        last = (kept[-1] if kept else int(times.max().value // 1000)) // 1000 + int(window * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]] * len(times), ts: times.to_numpy(), "allowed": flags})

    return stream.withWatermark(ts, f"{window} seconds").groupBy(key).applyInPandasWithState(each, f"{key} {kind}, {ts} timestamp, allowed boolean", "kept array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_rules(df: DataFrame, keys: list[str], path: str, rules: list[tuple[str, int]], ts: str, order: str, window: float = 60.0) -> DataFrame:
    """``df`` with ``rule``, ``allowed``, ``status`` and ``max_requests``: every event falls under the first rule whose prefix its path begins with.

    A rule limits the events of a key by themselves; events under no rule are
    allowed (rule and limit null).  Denied events have status 429, others 200.
    """
    picked = F.lit(None).cast("string")
    for prefix, _ in reversed(rules):
        picked = F.when(F.col(path).startswith(prefix), F.lit(prefix)).otherwise(picked)
    rows = df.withColumn("rule", picked)
    out = rows.where("rule is null").withColumns({"allowed": F.lit(True), "max_requests": F.lit(None).cast("int")})
    for prefix, limit in rules:
        some = rate_limited(rows.where(F.col("rule") == prefix), keys, ts, order, limit, window)
        out = out.unionByName(some.withColumn("max_requests", F.lit(limit)))
    return out.withColumn("status", F.when(F.col("allowed"), 200).otherwise(429))


def halved(limits: dict[str, int], fixed: dict[str, int] | None = None) -> dict[str, int]:
    """Limits of costly endpoints: half of the configured ones, one at least; ``fixed`` ones stay as they are."""
    return {k: max(1, v // 2) for k, v in limits.items()} | (fixed or {})


def cached_by_tier(df: DataFrame, keys: list[str], tier: str, lifetimes: dict[str, float], ts: str, order: str) -> DataFrame:
    """``cached`` with the lifetime of each row's tier; rows of other tiers are never hits."""
    out = df.where(~F.coalesce(F.col(tier).isin(list(lifetimes)), F.lit(False))).withColumn("hit", F.lit(False))
    for name, seconds in lifetimes.items():
        out = out.unionByName(cached(df.where(F.col(tier) == name), keys, ts, order, seconds))
    return out
