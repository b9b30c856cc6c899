"""Named queries over the given tables, each with its equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakewright.sources.tables import Tables


@dataclass(frozen=True)
class Plan:
    key: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return self.build(Tables(spark, folder))


PLANS: dict[str, Plan] = {}


def plan(key: str, sql: str | None = None):
    def register(build):
        if key in PLANS:
            raise ValueError(f"query {key} is registered twice")
        PLANS[key] = Plan(key, build, sql)
        return build

    return register
