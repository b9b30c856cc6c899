"""Streams with state per key: gapless event versions, and alerts that fire when a condition has held."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegralType, LongType, MapType, StructField, StructType, TimestampType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Within it, streams that start keep their state in the store that keyed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


#: Buckets that the keys of a stream of versions are dealt into: one call and one state for all keys of a bucket.
STATE_BUCKETS = 4096


class _Versions(StatefulProcessor):
    """Holds the last versions of a bucket's keys and goes on from them."""

    def __init__(self, order: list[str], kind: str):
        self.order, self.kind = order, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", f"same {self.kind}, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last = {same: version for same, version in self.last.get()} if self.last.exists() else {}
        codes, found = pd.factorize(events["same"])
        found = found.tolist()
        before = np.array([last.get(same, 0) for same in found], np.int64)
        versions = before[codes] + events.groupby(codes).cumcount().to_numpy() + 1
        last.update(zip(found, (before + np.bincount(codes, minlength=len(found))).tolist()))
        self.last.put(list(last.items()))
        yield events.drop(columns=["bucket", "same"], errors="ignore").assign(event_version=versions)

    def close(self) -> None:
        pass


def _same(key: Column, kind: DataType) -> Column:
    """A whole number or a string that two keys share if and only if they are equal; null stays null."""
    if isinstance(kind, IntegralType):
        return key.cast("long")
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.when(key.isNotNull(), F.to_json(F.struct(key), {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}))
    return F.hex(key) if isinstance(kind, BinaryType) else key.cast("string")


def versioned(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A stream of events with ``event_version``, gapless from 1 for each key, also over restarts of the stream.

    Each batch goes on from the versions that the state holds, in ``order``
    within the batch; stored events are never read. Keys are dealt into
    ``STATE_BUCKETS`` buckets, null into one of its own, and state is one number
    per key, kept by bucket; rows of one bucket in one batch are ordered
    together, so the size of a batch (files per trigger) bounds them.
    """
    fields = events.schema.fields
    # By position, as rows reach the processor as tuples whose field names cannot be any name.
    at = {f.name: f"c{i}" for i, f in enumerate(fields)}
    # Whole numbers beside a null would become doubles on the way, so their nulls travel as flags.
    whole = [at[f.name] for f in fields if isinstance(f.dataType, IntegralType)]
    same = _same(F.col(at[key]), events.schema[key].dataType)
    kind = "long" if at[key] in whole else "string"
    rows = events.toDF(*at.values()).withColumn("same", F.coalesce(same, F.lit(0) if kind == "long" else F.lit("")))
    rows = rows.withColumn("bucket", F.when(F.col(at[key]).isNull(), -1).otherwise(F.pmod(F.xxhash64("same"), F.lit(STATE_BUCKETS))).cast("int"))
    rows = rows.withColumns({f"n{c}": F.col(c).isNull() for c in whole}).withColumns({c: F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)) for c in whole})
    by = [x for c in order for x in ([f"n{at[c]}", at[c]] if at[c] in whole else [at[c]])]
    schema = StructType([*[f for f in rows.schema.fields if f.name not in ("same", "bucket")], StructField("event_version", LongType())])
    numbered = rows.groupBy("bucket").transformWithStateInPandas(_Versions(by, kind), schema, "Append", "None")
    back = [F.when(~F.col(f"n{c}"), F.col(c)).alias(c) if c in whole else F.col(c) for c in at.values()]
    return numbered.select(*back, "event_version").toDF(*events.columns, "event_version")


class _Held(StatefulProcessor):
    """Holds since when the condition of a key is true, and a timer for the moment at which it has held."""

    def __init__(self, keys: list[str], ts: str, hold_ms: int, idle_ms: int | None):
        self.keys, self.ts, self.hold, self.idle = keys, ts, hold_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Since when, whether it has fired, and the sample it was last true at, in milliseconds.
        self.run = handle.getValueState("run", "since long, fired boolean, seen long")

    def _alert(self, key, since: int) -> dict:
        return {**dict(zip(self.keys, key)), "started": pd.Timestamp(since, unit="ms"), "fired": pd.Timestamp(since + self.hold, unit="ms")}

    def _frame(self, alerts: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(alerts, columns=[*self.keys, "started", "fired"])

    def _stop(self, since: int, seen: int) -> None:
        self.handle.deleteTimer(since + self.hold)
        if self.idle is not None:
            self.handle.deleteTimer(seen + self.idle)
        self.run.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples, alerts = pd.concat(list(rows)).sort_values(self.ts, kind="stable"), []
        state = self.run.get() if self.run.exists() else None
        for ts, on in zip((samples[self.ts].astype("datetime64[ms]").astype("int64")).tolist(), samples["on"].tolist()):
            if state is not None:
                since, fired, seen = state
                if not fired and ts >= since + self.hold:
                    # The next sample shows it as well as the timer would: the condition held until then.
                    alerts.append(self._alert(key, since))
                    state = since, True, seen
                if not on:
                    self._stop(since, seen)
                    state = None
                    continue
            if on:
                if state is None:
                    state = ts, False, ts
                    self.handle.registerTimer(ts + self.hold)
                if self.idle is not None:
                    self.handle.deleteTimer(state[2] + self.idle)
                    self.handle.registerTimer(ts + self.idle)
                state = state[0], state[1], ts
        if state is not None:
            self.run.update(state)
        if alerts:
            yield self._frame(alerts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        since, fired, seen = self.run.get()
        if at == since + self.hold and not fired:
            self.run.update((since, True, seen))
            yield self._frame([self._alert(key, since)])
        if self.idle is not None and at == seen + self.idle:
            self._stop(since, seen)

    def close(self) -> None:
        pass


def held_alerts(samples: DataFrame, keys: list[str], ts: str, condition: Column, hold_seconds: float, idle_seconds: float | None = None) -> DataFrame:
    """A stream of alerts (keys, started, fired): once per run in which ``condition`` has held for ``hold_seconds``.

    ``samples`` is a stream with a watermark on ``ts``. A run starts with the
    first sample for which the condition is true and ends with the first one
    for which it is not (null counts as not). It fires when the watermark has passed the
    hold time, also if no further sample of the key comes, or with the sample
    that shows it. A run may be forgotten ``idle_seconds`` after its last
    sample: the next one then starts anew. State is one row per running key.
    """
    names = [f"key{i}" for i in range(len(keys))]
    rows = samples.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(ts).alias("ts"), F.coalesce(condition, F.lit(False)).alias("on"))
    schema = StructType([*[StructField(n, samples.schema[k].dataType) for k, n in zip(keys, names)], StructField("started", TimestampType()),
                         StructField("fired", TimestampType())])
    processor = _Held(names, "ts", round(hold_seconds * 1000), None if idle_seconds is None else round(idle_seconds * 1000))
    return rows.groupBy(*names).transformWithStateInPandas(processor, schema, "Append", "EventTime").toDF(*keys, "started", "fired")
