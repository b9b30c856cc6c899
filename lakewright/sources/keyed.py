"""Tables under a stream of keyed changes: a base sorted by key, runs of changes over it, merged when read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewright.operators.windows import latest_per_key, match
from lakewright.sources.commits import CommitLog

#: A change that removes its key.
GONE, RUN = "_gone", "_run"


class KeyedTable:
    """One row per key (null equals null). A batch of changes writes a run of its own: bytes in proportion to the batch.

    Runs have levels. As soon as a level holds ``fanout`` runs they become one
    run of the next level, and when all runs together hold more than a
    ``fanout``-th of the base's rows they are merged into a new base. So a change is
    written again once per level, and a reader meets at most ``fanout`` runs a
    level. A version is a commit; files are never changed, so readers see one
    version, and a writer that comes second gets a Conflict.
    """

    def __init__(self, spark: SparkSession, base: str, keys: list[str], fanout: int = 4):
        self.spark = spark
        self.base = base.rstrip("/")
        self.keys = keys
        self.fanout = fanout
        self.log = CommitLog(spark, self.base)

    def _state(self) -> tuple[int, dict]:
        number = self.log.latest()
        if not number:
            raise LookupError(f"no version under {self.base}")
        return number, self.log.entry(number)

    def _write(self, df: DataFrame) -> tuple[str, int]:
        """Write rows sorted by key, so that a reader that filters keys skips most of each file."""
        name, seen = uuid.uuid4().hex, Observation()
        self.log.write(name, df.sortWithinPartitions(*self.keys).observe(seen, F.count(F.lit(1)).alias("rows")))
        return name, seen.get["rows"]

    def create(self, df: DataFrame) -> None:
        """Start with ``df``, which has one row per key."""
        name, rows = self._write(df.repartitionByRange(*self.keys))
        self.log.commit(self.log.latest(), {"schema": df.schema.jsonValue(), "base": name, "base_rows": rows, "runs": [], "batch": -1})

    def schema(self) -> StructType:
        return StructType.fromJson(self._state()[1]["schema"])

    def _base(self, state: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(state["schema"])).parquet(f"{self.base}/{state['base']}")

    def _runs(self, state: dict, runs: list[dict]) -> DataFrame:
        """One row per changed key: that of the newest of some runs."""
        schema = StructType.fromJson(state["schema"]).add(GONE, "boolean")
        frames = [self.spark.read.schema(schema).parquet(f"{self.base}/{r['path']}") for r in runs]
        if len(frames) == 1:
            return frames[0]
        every = None
        for k, f in enumerate(frames):
            f = f.withColumn(RUN, F.lit(k))
            every = f if every is None else every.unionByName(f)
        return latest_per_key(every, self.keys, [RUN]).drop(RUN)

    def _merged(self, state: dict) -> DataFrame:
        base = self._base(state)
        if not state["runs"]:
            return base
        changed = self._runs(state, state["runs"])
        return match(base, changed.select(*self.keys), self.keys, "left_anti").unionByName(changed.where(~F.col(GONE)).drop(GONE))

    def read(self) -> DataFrame:
        return self._merged(self._state()[1])

    def apply(self, changes: DataFrame, order: list[str], batch: int | None = None) -> int:
        """Apply changes: all columns, ``_gone`` (the key is removed) and the ``order`` columns; returns the changed keys.

        The last change of a key wins. A batch number that has been applied
        already changes nothing.
        """
        number, state = self._state()
        if batch is not None and batch <= state["batch"]:
            return 0
        columns = [*StructType.fromJson(state["schema"]).names, GONE]
        last = latest_per_key(changes.select(*columns, *[c for c in order if c not in columns]), self.keys, order).select(*columns)
        name, rows = self._write(last)
        runs = [*state["runs"], {"path": name, "level": 0, "rows": rows}] if rows else state["runs"]
        number = self.log.commit(number, {**state, "runs": runs, "batch": state["batch"] if batch is None else batch})
        if rows:
            self._compact(number, {**state, "runs": runs, "batch": state["batch"] if batch is None else batch})
        return rows

    def _compact(self, number: int, state: dict) -> None:
        """Merge full levels, lowest first, then all runs into the base if they have grown large beside it."""
        runs = state["runs"]
        if self.fanout * sum(r["rows"] for r in runs) > max(state["base_rows"], 1):
            # Small beside its runs: the next base.
            if len(runs) < self.fanout:
                return
            name, rows = self._write(self._merged(state).repartitionByRange(*self.keys))
            self.log.commit(number, {**state, "base": name, "base_rows": rows, "runs": []})
            return
        level, changed = 0, False
        while len(full := [r for r in runs if r["level"] == level]) >= self.fanout:
            name, rows = self._write(self._runs(state, full))
            # Runs stand from old to new, so those of a level stand together, higher levels before them.
            runs = [*[r for r in runs if r["level"] > level], {"path": name, "level": level + 1, "rows": rows}, *[r for r in runs if r["level"] < level]]
            level, changed = level + 1, True
        if changed:
            self.log.commit(number, {**state, "runs": runs})
