"""Writing to an index: versions with a pointer, uploads with a status per document, dead letters, job states."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUS = "status int, error string"


class IndexStore:
    """Versions of an index below ``root``; readers follow the newest pointer, which is written last.

    A version is written beside the others and never changed, so a reader or a
    failed writer harms nothing; versions without a pointer are left over from
    failed writes and their numbers aren't used again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, what: str = ""):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}{what}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, what: str) -> list[int]:
        fs, path = self._fs(what)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removeprefix("v-")) for n in names if n.startswith("v-"))

    def ensure(self, schema: T.StructType | str) -> None:
        """Create the index, empty, where there is none; called again it changes nothing."""
        if self.current() is None:
            self.write(self.spark.createDataFrame([], schema))

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        return self._numbers("/current")

    def current(self) -> DataFrame | None:
        """The newest finished version, or None."""
        done = self.versions()
        return self.spark.read.parquet(f"{self.root}/data/v-{done[-1]:012d}") if done else None

    def write(self, df: DataFrame) -> int:
        """Store ``df`` as the next version and point readers to it."""
        number = max([0, *self._numbers("/data"), *self.versions()]) + 1
        df.write.mode("error").parquet(f"{self.root}/data/v-{number:012d}")
        fs, path = self._fs(f"/current/v-{number:012d}")
        fs.create(path, False).close()  # fails where another writer has taken the number
        return number

    def keep(self, newest: int) -> list[int]:
        """Drop all finished versions but the ``newest``; pointers go first."""
        gone = self.versions()[: -max(1, newest)]
        for n in gone:
            for what in ("current", "data"):
                fs, path = self._fs(f"/{what}/v-{n:012d}")
                fs.delete(path, True)
        return gone

    def drop(self) -> None:
        """Delete the index with all versions; where there is none nothing happens."""
        fs, path = self._fs()
        fs.delete(path, True)


def _status(row: dict) -> tuple[int, str | None]:
    code = row.get("statusCode", row.get("status"))
    code = int(code) if isinstance(code, (int, float)) or isinstance(code, str) and code.isdigit() else 500
    return code, row.get("errorMessage") or row.get("error")


def parse_statuses(keys: list[str], answer: str | None, code: int) -> list[tuple[int, str | None]]:
    """Status and error of every key of a batch from the service's JSON answer.

    A failed call, an unreadable answer or a key the answer doesn't name counts
    as a failure of those documents; 2xx is a success.
    """
    if not 200 <= code < 300:
        return [(code, answer)] * len(keys)
    try:
        rows = json.loads(answer or "").get("value", [])
        told = {str(r["key"]): _status(r) for r in rows}
    except (ValueError, AttributeError, TypeError, KeyError):
        return [(500, "unreadable answer")] * len(keys)
    return [told.get(k, (500, "not named in the answer")) for k in keys]


def upload(df: DataFrame, key: str, post: Callable[[list[dict]], tuple[int, str]], batch: int = 1000) -> DataFrame:
    """(``key``, status, error, attempts): documents sent by ``post`` (a list of documents to HTTP code and JSON answer), the failed ones once more.

    Batches are sent by the tasks; an exception fails its batch and nothing
    else.  Rows are kept one to one.  The result is to be stored, since reading
    it again sends again.
    """
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def send(rows: list[dict]) -> list[tuple[int, str | None]]:
            keys = [str(r[key]) for r in rows]
            try:
                code, answer = post(rows)
            except Exception as e:  # noqa: BLE001
                return [(599, f"{type(e).__name__}: {e}")] * len(rows)
            return parse_statuses(keys, answer, code)

        for frame in frames:
            for i in range(0, len(frame), batch):
                rows = frame.iloc[i : i + batch].to_dict("records")
                told, tries = send(rows), [1] * len(rows)
                failed = [j for j, (code, _) in enumerate(told) if not 200 <= code < 300]
                if failed:
                    for j, again in zip(failed, send([rows[j] for j in failed])):
                        told[j], tries[j] = again, 2
                yield pd.DataFrame({key: [r[key] for r in rows], "status": [c for c, _ in told], "error": [e for _, e in told], "attempts": tries})

    kind = df.schema[key].dataType.simpleString()
    return df.select(*names).mapInPandas(run, f"`{key}` {kind}, {STATUS}, attempts int")


def dead_letters(documents: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """The documents whose upload failed, with status, error and attempts, to be sent again later."""
    failed = statuses.where("status < 200 or status >= 300")
    return documents.join(failed, key)


#: States of a job, the share done in them, and what may follow.
STATES = {"started": (0, ["running", "failed"]), "running": (10, ["completed", "failed"]), "completed": (100, []), "failed": (None, [])}


def job_states(events: DataFrame, job: str, at: str, state: str) -> DataFrame:
    """(``job``, state, progress, valid) per job: its latest state, the share done (-1 if it failed), and whether every step was one that may follow the step before."""
    order = F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(state).alias("s"))))
    rows = events.where(F.col(state).isin(list(STATES))).groupBy(job).agg(order.alias("o"))
    follows = F.create_map(*[x for s, (_, after) in STATES.items() for x in (F.lit(s), F.array(*[F.lit(a) for a in after]).cast("array<string>"))])
    steps = F.zip_with(F.slice("o", 1, F.size("o") - 1), F.slice("o", 2, F.size("o")), lambda a, b: (a["s"] == b["s"]) | F.coalesce(F.array_contains(F.element_at(follows, a["s"]), b["s"]), F.lit(True)))
    progress = F.create_map(*[x for s, (p, _) in STATES.items() if p is not None for x in (F.lit(s), F.lit(p))])
    last = F.element_at("o", -1)["s"]
    return rows.select(job, last.alias("state"), F.coalesce(F.try_element_at(progress, last), F.lit(-1)).alias("progress"), F.forall(F.filter(steps, lambda x: x.isNotNull()), lambda x: x).alias("valid"))
