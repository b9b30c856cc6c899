"""Tables kept as written parts and row masks, under a log of versions.

Written files are never changed. A version names the parts it consists of and
the masks that hide rows of them: an insert writes its rows, a delete the places
of the rows that go, an update both, so a change writes bytes in proportion to
the rows it touches. Readers see one whole version; a failed write leaves none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewright.operators.windows import latest_per_key, match
from lakewright.sources.commits import CommitLog, Conflict

#: Where a row is: its file under the table's data folder and its position in it.
FILE, ROW = "_masked_file", "_masked_row"
_PLACE = f"{FILE} string, {ROW} long"


class VersionedTable:
    """A stored table. Every change takes ``at``, the version it was decided from (the newest one without it),
    and raises ``Conflict`` if another writer has committed a version since."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self.log = CommitLog(spark, self.base)

    @classmethod
    def create(cls, spark: SparkSession, base: str) -> VersionedTable:
        """A new table under a path of its own, without a version yet."""
        return cls(spark, base)

    def version(self) -> int:
        """Number of the current version, 0 if there is none."""
        return self.log.latest()

    def _state(self, at: int | None) -> tuple[int, dict]:
        number = self.version() if at is None else at
        if not number:
            raise LookupError(f"no version under {self.base}")
        return number, self.log.entry(number)

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an earlier one."""
        _, state = self._state(version)
        return self._placed(state).drop(FILE, ROW)

    def _schema(self, state: dict) -> StructType:
        return StructType.fromJson(state["schema"])

    def _typed(self, state: dict, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns and types that are stored."""
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema(state).fields])

    def _part(self, state: dict, parts: list[str]) -> DataFrame:
        """Rows of some parts with their places."""
        schema = self._schema(state)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.base}/data/{p}" for p in parts])
        return rows.select(*[F.col(c) for c in schema.names], F.substring_index("_metadata.file_path", "/data/", -1).alias(FILE), F.col("_metadata.row_index").alias(ROW))

    def _placed(self, state: dict) -> DataFrame:
        """The rows of a version with their places. Only parts that a mask touches are joined to the masked places."""
        hidden = {p for m in state["masks"] for p in m["parts"]}
        open_ = [p for p in state["parts"] if p not in hidden]
        rows = self._part(state, open_) if open_ else None
        touched = [p for p in state["parts"] if p in hidden]
        if touched:
            masks = self.spark.read.schema(_PLACE).parquet(*[f"{self.base}/data/{m['path']}" for m in state["masks"]])
            left = self._part(state, touched).join(masks, [FILE, ROW], "left_anti")
            rows = left if rows is None else rows.unionByName(left)
        if rows is None:
            rows = self.spark.createDataFrame([], self._schema(state)).select("*", F.lit(None).cast("string").alias(FILE), F.lit(None).cast("long").alias(ROW))
        return rows

    def _commit(self, after: int, kind: str, state: dict, written: list[str]) -> int:
        try:
            return self.log.commit(after, {**state, "kind": kind})
        except Conflict:
            for name in written:
                self.log.remove(f"data/{name}")
            raise

    def _write(self, df: DataFrame, *facts: Column, partition_by: list[str] | None = None) -> tuple[str, dict]:
        """Write one part and return its name and observed facts."""
        name, seen = uuid.uuid4().hex, Observation()
        self.log.write(f"data/{name}", df.observe(seen, F.count(F.lit(1)).alias("rows"), *facts), partition_by)
        return name, seen.get

    def replace(self, df: DataFrame, partition_by: list[str] | None = None, at: int | None = None) -> int:
        """Write ``df`` as the next version and return its row count."""
        before = self.version() if at is None else at
        name, seen = self._write(df, partition_by=partition_by)
        state = {"schema": df.schema.jsonValue(), "parts": [name], "masks": [], "rows": seen["rows"], "masked": 0}
        self._commit(before, "replace", state, [name])
        return seen["rows"]

    def insert(self, rows: DataFrame, at: int | None = None) -> int:
        """Add rows and return their number; nothing that is stored is read or written again."""
        before, state = self._state(at)
        name, seen = self._write(self._typed(state, rows))
        self._commit(before, "insert", {**state, "parts": [*state["parts"], name], "rows": state["rows"] + seen["rows"]}, [name])
        return seen["rows"]

    def part_of_last_insert(self) -> DataFrame:
        """The rows of the newest part."""
        _, state = self._state(None)
        return self._part(state, state["parts"][-1:]).drop(FILE, ROW)

    def _masking(self, state: dict, name: str, seen: dict) -> dict:
        """``state`` with the places written under ``name`` hidden."""
        if not seen["rows"]:
            return state
        mask = {"path": name, "parts": sorted(seen["parts"])}
        return {**state, "masks": [*state["masks"], mask], "rows": state["rows"] - seen["rows"], "masked": state["masked"] + seen["rows"]}

    @staticmethod
    def _parts_seen() -> Column:
        return F.collect_set(F.substring_index(FILE, "/", 1)).alias("parts")

    def update(self, condition: Column, changes: dict[str, Column], at: int | None = None) -> int:
        """Set columns of the rows for which ``condition`` is true and return how many there are.

        The new rows are written with the places of the old ones, which one
        folder gives as part and as mask.
        """
        before, state = self._state(at)
        names = self._schema(state).names
        hit = self._placed(state).where(F.coalesce(condition, F.lit(False)))
        kinds = {f.name: f.dataType for f in self._schema(state).fields}
        after = hit.select(*[changes[c].cast(kinds[c]).alias(c) if c in changes else F.col(c) for c in names], FILE, ROW)
        name, seen = self._write(after, self._parts_seen())
        masked = self._masking(state, name, seen)
        parts = [*state["parts"], *([name] if seen["rows"] else [])]
        self._commit(before, "update", {**masked, "parts": parts, "rows": state["rows"]}, [name])
        return seen["rows"]

    def delete(self, condition: Column, at: int | None = None) -> int:
        """Hide the rows for which ``condition`` is true and return how many there are."""
        before, state = self._state(at)
        name, seen = self._write(self._placed(state).where(F.coalesce(condition, F.lit(False))).select(FILE, ROW), self._parts_seen())
        self._commit(before, "delete", self._masking(state, name, seen), [name])
        return seen["rows"]

    def truncate(self, at: int | None = None) -> int:
        """Leave no row and return how many there were, without a look at them."""
        before, state = self._state(at)
        self._commit(before, "truncate", {**state, "parts": [], "masks": [], "rows": 0, "masked": 0}, [])
        return state["rows"]

    def upsert(self, rows: DataFrame, keys: list[str], order: list[str] | None = None, at: int | None = None) -> int:
        """Rows over stored rows of the same key (see ``upsert``); returns the table's row count.

        Writes one row per given key and the places of the stored rows it
        replaces; of the stored rows only the keys are read.
        """
        before, state = self._state(at)
        one = _one_per_key(rows, self._schema(state).names, keys, order)
        part, given = self._write(self._typed(state, one))
        fresh = self.spark.read.schema(self._schema(state)).parquet(f"{self.base}/data/{part}").select(*keys)
        old = match(self._placed(state).select(*keys, FILE, ROW), fresh, keys, "left_semi")
        mask, seen = self._write(old.select(FILE, ROW), self._parts_seen())
        after = self._masking(state, mask, seen)
        after = {**after, "parts": [*state["parts"], part], "rows": after["rows"] + given["rows"]}
        self._commit(before, "upsert", after, [part, mask])
        return after["rows"]

    def compact(self, share: float = 0.0, at: int | None = None) -> bool:
        """Rewrite the parts that masks touch if more than ``share`` of the stored rows is masked; tells whether it did.

        Readers of earlier versions are not disturbed, as files stay.
        """
        before, state = self._state(at)
        if not state["masks"] or state["masked"] <= share * (state["rows"] + state["masked"]):
            return False
        hidden = {p for m in state["masks"] for p in m["parts"]}
        kept = [p for p in state["parts"] if p not in hidden]
        name, _ = self._write(self._placed({**state, "parts": [p for p in state["parts"] if p in hidden]}).drop(FILE, ROW))
        self._commit(before, "compact", {**state, "parts": [*kept, name], "masks": [], "masked": 0}, [name])
        return True

    def history(self) -> list[tuple[int, str, int]]:
        """(version, kind of change, rows) of every version."""
        return [(n, e["kind"], e["rows"]) for n in range(1, self.version() + 1) for e in [self.log.entry(n)]]


def _one_per_key(source: DataFrame, columns: list[str], keys: list[str], order: list[str] | None) -> DataFrame:
    """Of rows that share a key the greatest by ``order``; without one, the greatest by its values."""
    rows = source.select(*columns, *[c for c in order or [] if c not in columns])
    rest = order or [c for c in columns if c not in keys]
    return (latest_per_key(rows, keys, rest) if rest else rows.distinct()).select(*columns)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Source rows over target rows of the same key.

    Of source rows that share a key the greatest by ``order`` counts; without
    one, the greatest by its values, so the result has one row per source key.
    """
    one = _one_per_key(source, target.columns, keys, order)
    return match(target, one.select(*keys), keys, "left_anti").unionByName(one)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the source rows whose key is new."""
    return target.unionByName(match(source, target.select(*keys), keys, "left_anti").select(*target.columns))
