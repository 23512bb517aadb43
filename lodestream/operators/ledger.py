"""Work-item ledger: pending, leased and done units with fencing tokens.

Items are written once, hashed into a bounded number of units.  State changes
are appended to a log of numbered JSON files; a number can be created only
once, so concurrent writers are serialised by the file system and the number
of a lease is its fencing token.  A lease that has expired counts as pending
again.  Output goes to a path named by unit batch and token, and readers see
only outputs named by an accepted ``done`` entry: a retry under the same token
overwrites its own path, a writer whose lease was taken over is rejected.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleLease(RuntimeError):
    """The token was superseded by a later lease of the same unit."""


@dataclass(frozen=True)
class Lease:
    token: int
    units: tuple[str, ...]
    worker: str
    until: float


class WorkLedger:
    """A ledger stored below ``root``; ``units`` bounds the units of one generation (else the shuffle partitions do)."""

    def __init__(self, spark: SparkSession, root: str, units: int | None = None, lease_seconds: float = 900.0, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.lease_seconds, self.clock = spark, root.rstrip("/"), lease_seconds, clock
        self.units = units or max(24, int(spark.conf.get("spark.sql.shuffle.partitions")))
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    # -- log ---------------------------------------------------------------
    def _log(self) -> list[dict]:
        folder = self._path(f"{self.root}/log")
        if not self._fs.exists(folder):
            return []
        out = []
        for status in sorted(self._fs.listStatus(folder), key=lambda s: s.getPath().getName()):
            stream = self._fs.open(status.getPath())
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text:
                out.append(json.loads(text) | {"n": int(status.getPath().getName().split(".")[0])})
        return out

    def _append(self, build: Callable[[list[dict], int], dict | None]) -> tuple[int, dict] | None:
        """Append the entry ``build`` makes of the log as it stands; starts over if another writer was faster."""
        while True:
            log = self._log()
            n = max((e["n"] for e in log), default=0) + 1
            entry = build(log, n)
            if entry is None:
                return None
            # written beside the log first, so that a crash leaves no half entry under the number
            draft = self._path(f"{self.root}/drafts/{n:012d}-{time.time_ns()}.json")
            stream = self._fs.create(draft, True)
            stream.write(bytearray(json.dumps(entry), "utf-8"))
            stream.close()
            target = self._path(f"{self.root}/log/{n:012d}.json")
            self._fs.mkdirs(target.getParent())
            if not self._fs.exists(target) and self._fs.rename(draft, target):
                return n, entry
            self._fs.delete(draft, False)

    @staticmethod
    def _fold(log: list[dict]) -> dict[str, dict]:
        state: dict[str, dict] = {}
        for e in log:
            for u in e.get("units", ()):
                if e["op"] == "enqueue":
                    state.setdefault(u, {"state": "pending", "token": 0, "until": 0.0})
                elif e["op"] == "lease":
                    state[u] = {"state": "leased", "token": e["n"], "until": e["until"]}
                elif e["op"] == "renew":
                    if state[u]["state"] == "leased" and state[u]["token"] == e["token"]:
                        state[u]["until"] = e["until"]
                elif e["op"] == "done":
                    state[u] = {"state": "done", "token": e["token"], "until": 0.0, "path": e["path"]}
        return state

    def states(self) -> dict[str, str]:
        """Unit -> pending, leased or done, as of now."""
        now = self.clock()
        return {u: "pending" if s["state"] == "leased" and s["until"] <= now else s["state"] for u, s in self._fold(self._log()).items()}

    # -- work --------------------------------------------------------------
    def enqueue(self, items: DataFrame, key: list[str], generation: str) -> None:
        """Store ``items`` as pending units of ``generation``; a repeated call for the same one changes nothing."""
        if any(e["op"] == "enqueue" and e["generation"] == generation for e in self._log()):
            return
        unit = F.concat(F.lit(f"{generation}-"), F.lpad(F.pmod(F.xxhash64(*key), F.lit(self.units)).cast("string"), 6, "0"))
        items.withColumn("unit", unit).repartition(F.col("unit")).write.mode("overwrite").partitionBy("unit").parquet(f"{self.root}/items/{generation}")
        folder = self._path(f"{self.root}/items/{generation}")
        names = [s.getPath().getName()[5:] for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("unit=")]

        def build(log: list[dict], n: int) -> dict | None:
            if any(e["op"] == "enqueue" and e["generation"] == generation for e in log):
                return None
            return {"op": "enqueue", "generation": generation, "units": sorted(names)}

        self._append(build)

    def lease(self, worker: str, most: int | None = None) -> Lease | None:
        """Lease up to ``most`` units that are pending or whose lease has run out; null if there are none."""

        def build(log: list[dict], n: int) -> dict | None:
            now = self.clock()
            free = sorted(u for u, s in self._fold(log).items() if s["state"] == "pending" or s["state"] == "leased" and s["until"] <= now)
            return {"op": "lease", "units": free[:most], "worker": worker, "until": now + self.lease_seconds} if free else None

        made = self._append(build)
        return Lease(made[0], tuple(made[1]["units"]), worker, made[1]["until"]) if made else None

    def renew(self, lease: Lease) -> Lease:
        """Prolong a lease from now on, for work that takes longer than it lasts; raises StaleLease if any unit was leased again or done."""

        def build(log: list[dict], n: int) -> dict | None:
            state = self._fold(log)
            late = [u for u in lease.units if state[u]["token"] != lease.token or state[u]["state"] != "leased"]
            if late:
                raise StaleLease(f"token {lease.token} no longer holds {late[0]}")
            return {"op": "renew", "units": list(lease.units), "token": lease.token, "until": self.clock() + self.lease_seconds}

        made = self._append(build)
        return Lease(lease.token, lease.units, lease.worker, made[1]["until"])

    def items(self, lease: Lease) -> DataFrame:
        """The items of the leased units, with their column ``unit``."""
        paths = [f"{self.root}/items/{u.rsplit('-', 1)[0]}" for u in lease.units]
        parts = [self.spark.read.option("basePath", p).parquet(*[f"{p}/unit={u}" for u, q in zip(lease.units, paths) if q == p]) for p in dict.fromkeys(paths)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def run(self, lease: Lease, work: Callable[[DataFrame], DataFrame]) -> None:
        """Apply ``work`` to the leased items, store the result and mark the units done."""
        path = f"{self.root}/out/token-{lease.token:012d}"
        work(self.items(lease)).write.mode("overwrite").parquet(path)
        self.complete(lease, path)

    def complete(self, lease: Lease, path: str) -> None:
        """Mark the units done; raises StaleLease if any was leased again or finished by another token."""

        def build(log: list[dict], n: int) -> dict | None:
            state = self._fold(log)
            if all(state[u]["state"] == "done" and state[u]["token"] == lease.token for u in lease.units):
                return None
            late = [u for u in lease.units if state[u]["token"] != lease.token or state[u]["state"] != "leased"]
            if late:
                raise StaleLease(f"token {lease.token} no longer holds {late[0]}")
            return {"op": "done", "units": list(lease.units), "token": lease.token, "path": path}

        self._append(build)

    def results(self) -> DataFrame | None:
        """Everything stored by accepted ``done`` entries, each unit once."""
        paths = sorted({s["path"] for s in self._fold(self._log()).values() if s["state"] == "done"})
        return self.spark.read.parquet(*paths) if paths else None
