"""JSON text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(doc: Column, key: str) -> Column:
    return F.get_json_object(doc, f"$.{key}")


def has_key(doc: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def extract_path(doc: Column, path: str) -> Column:
    """Value at a dotted path with 0-based array indexes; null if absent or not JSON."""
    return F.get_json_object(doc, f"$.{path}")


def parse_safe(doc: Column) -> Column:
    """Parsed value, or null where the text is not JSON."""
    return F.try_parse_json(doc)


def merge(a: Column, b: Column) -> Column:
    """Object concatenation in which the right side wins; values keep their JSON type."""
    left, right = (F.from_json(x, "map<string,variant>") for x in (a, b))
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.to_json(F.map_concat(kept, right))


def flatten(df: DataFrame, doc: str, prefix: str, keys: list[str]) -> DataFrame:
    """The object's keys as prefixed text columns."""
    parsed = F.from_json(F.col(doc), ", ".join(f"`{k}` string" for k in keys))
    out = df.withColumn("_j", parsed)
    return out.select(*df.columns, *[F.col("_j").getField(k).alias(f"{prefix}{k}") for k in keys])


def flatten_rows(df: DataFrame, doc: str) -> DataFrame:
    """One row per key and value of the object, for documents of open schema."""
    return df.select(*df.columns, F.explode(F.from_json(F.col(doc), "map<string,string>")).alias("key", "value"))


# The declared JSON types, and how the type of a parsed value is spelled.
TYPE_PATTERNS = {
    "integer": r"^BIGINT$", "number": r"^(BIGINT|DECIMAL\(.*\)|DOUBLE|FLOAT)$", "boolean": r"^BOOLEAN$", "string": r"^STRING$",
    "object": r"^OBJECT<.*>$", "array": r"^ARRAY<.*>$",
}


def matches_schema(doc: Column, required: dict[str, str]) -> Column:
    """True if the text is a JSON object holding every required key with its declared type."""
    parsed = F.try_parse_json(doc)
    ok = parsed.isNotNull() & F.json_object_keys(doc).isNotNull()
    for key, kind in required.items():
        found = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
        ok = ok & F.coalesce(found.rlike(TYPE_PATTERNS[kind]), F.lit(False))
    return F.coalesce(ok, F.lit(False))
