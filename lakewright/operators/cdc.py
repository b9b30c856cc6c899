"""Change logs: captured from two snapshots, decoded from connector messages, applied to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.functions.validators import identifier, identifier_ok
from lakewright.operators.windows import latest_per_key, match
from lakewright.sources.keyed import GONE
from lakewright.sources.versioned import upsert


def capture(before: DataFrame, after: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Change log from ``before`` to ``after``: operation I, U or D with row images as JSON.

    Both snapshots must be unique on the keys; unchanged rows leave no entry.
    """
    def side(df, name):
        return df.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct(*before.columns).alias(name))

    old, new = side(before, "old"), side(after.select(*before.columns), "new")
    same = None
    for k in keys:
        one = F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}"))
        same = one if same is None else same & one
    both = old.join(new, same, "full_outer")
    whole = {"ignoreNullFields": "false"}
    operation = (F.when(F.col("old").isNull(), "I").when(F.col("new").isNull(), "D")
                 .when(~F.col("old").eqNullSafe(F.col("new")), "U"))
    return (both.withColumn("operation", operation).where(F.col("operation").isNotNull())
            .select(F.lit(table).alias("table_name"), "operation",
                    *[F.coalesce(f"_new_{k}", f"_old_{k}").alias(k) for k in keys],
                    F.to_json("old", whole).alias("old_values"), F.to_json("new", whole).alias("new_values")))


#: Images of rows are JSON; time stamps in them have microseconds or none.
IMAGE = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def keyed_rows(log: DataFrame, schema: T.StructType, keys: list[str], order: list[str]) -> DataFrame:
    """The changes of a log as rows of a keyed table: its columns, ``_gone`` for D, and the order columns."""
    read = log.withColumn("_image", F.from_json("new_values", schema, IMAGE))
    rest = [c for c in order if c not in schema.names]
    return read.select(*[F.col(c) if c in keys else F.col("_image")[c].alias(c) for c in schema.names],
                       (F.col("operation") == "D").alias(GONE), *rest)


def apply(base: DataFrame, log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Table state after the log: the last change of each key wins and D removes the row.

    Applying the same log twice gives the same table.
    """
    last = latest_per_key(log.select(*keys, "operation", "new_values", *order), keys, order)
    rows = (last.where("operation <> 'D'")
            .select(F.from_json("new_values", base.schema, IMAGE).alias("r"))
            .select("r.*"))
    return match(base, last.select(*keys), keys, "left_anti").unionByName(rows)


def enable(config: DataFrame, requests: DataFrame) -> DataFrame:
    """Configuration with the requested tables (table_name, key_columns) registered.

    A table whose name is not a plain identifier is kept as not enabled.
    """
    rows = requests.withColumn("enabled", identifier_ok(F.col("table_name")))
    return upsert(config, rows, ["table_name"])


ENVELOPE = T.StructType([
    T.StructField("op", T.StringType()), T.StructField("before", T.StringType()),
    T.StructField("after", T.StringType()), T.StructField("ts_ms", T.LongType())])
# Connector operation codes; r is the first snapshot.
OPERATIONS = {"c": "I", "r": "I", "u": "U", "d": "D"}


def decode_envelope(messages: DataFrame, column: str, keys: dict[str, str]) -> DataFrame:
    """Change log from connector messages (op, before, after, ts_ms); ``keys`` maps key to type."""
    m = F.from_json(F.col(column), ENVELOPE)
    codes = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    decoded = messages.select(*[c for c in messages.columns if c != column], m.alias("m"))
    image = F.coalesce(F.col("m.after"), F.col("m.before"))
    return decoded.select(
        *[c for c in decoded.columns if c != "m"],
        *[F.get_json_object(image, f"$.{k}").cast(kind).alias(k) for k, kind in keys.items()],
        F.try_element_at(codes, F.col("m.op")).alias("operation"), F.col("m.before").alias("old_values"),
        F.col("m.after").alias("new_values"), F.col("m.ts_ms").alias("ts_ms"))


def connector_topic(connector: str, schema: str, table: str, topic: str | None = None) -> str:
    """The given topic, or connector.schema.table."""
    return topic or ".".join(identifier(x) for x in (connector, schema, table))


def connector_options(servers: Column, topic: Column) -> Column:
    """Reader options of a topic as a map."""
    return F.create_map(F.lit("kafka.bootstrap.servers"), servers, F.lit("subscribe"), topic,
                        F.lit("startingOffsets"), F.lit("earliest"))


def change_trail(log: DataFrame, keys: list[str]) -> DataFrame:
    """One audit entry per change: table, key, action and the names of the changed fields."""
    old, new = (F.from_json(F.col(c), "map<string,string>") for c in ("old_values", "new_values"))
    fields = F.array_union(F.coalesce(F.map_keys(old), F.array()), F.coalesce(F.map_keys(new), F.array()))
    # An entry or removal names every field, also one whose value is null.
    alone = old.isNull() | new.isNull()
    changed = F.filter(fields, lambda k: alone | ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))
    action = F.element_at(F.create_map(F.lit("I"), F.lit("INSERT"), F.lit("U"), F.lit("UPDATE"), F.lit("D"), F.lit("DELETE")),
                          F.col("operation"))
    return log.select("table_name", *keys, action.alias("action"), F.array_join(F.sort_array(changed), ",").alias("changed_fields"))
