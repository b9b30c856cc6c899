"""Exact percentiles of large groups without ordering, shuffling or writing a group's values.

A mergeable quantile sketch brackets each wanted rank. One further pass counts
what lies below and between the brackets and keeps only the values inside; the
counts tell exactly where each rank lies, so a sketch that was off costs a pass
and never a wrong result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.sources.tables import durable

#: Cut points within what is still crowded, per round.
_CUTS = 15


def _cell(value: Column, edges: list[Column]) -> Column:
    """Number of the cell of a value among sorted edges: even between two edges, odd on one."""
    as_double = value.cast("double")
    below = reduce(lambda a, b: a + b, [F.when(e < as_double, 1).otherwise(0) for e in edges])
    return (2 * below + F.when(reduce(lambda a, b: a | b, [e == as_double for e in edges]), 1).otherwise(0)).cast("int")


def _cells(counts: DataFrame, key: str) -> DataFrame:
    """Per cell the number of values in it and below it, and of different ones kept."""
    held = counts.groupBy(key, "_cell").agg(F.sum("_n").alias("_in"), F.count("_v").alias("_kinds"), F.bool_and("_kept").alias("_kept"))
    # A key has a few dozen cells at most.
    upto = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("_below", F.sum("_in").over(upto) - F.col("_in"))


def _hits(cells: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted ranks with their cell."""
    return wanted.join(cells, key).where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_in")))


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                discrete: bool = False, accuracy: int = 4096, crowd: int = 65536) -> DataFrame:
    """One row per group with one column per entry of ``probs``; null for a group without a value.

    Continuous percentiles interpolate between neighbours; discrete ones return
    the first value whose cumulative share reaches the probability, in the type
    of the column. ``df`` is read twice, so write it first if it is expensive.
    About four ``accuracy``-ths of a group's values stay inside a bracket; while
    more than ``crowd`` different ones do, sketched quantiles of these cut them
    again, which leaves about a tenth each time. Infinities are
    values like others. Without keys there is always one row.
    """
    accuracy, crowd = max(accuracy, 64), max(crowd, 64)
    # As one struct, keys that are null equal each other in joins.
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    rows = df.select(group.alias("_g"), F.col(value).alias("_v"))
    names = list(probs)
    margin = 2.0 / accuracy
    marks = [min(max(p + s * margin, 0.0), 1.0) for p in probs.values() for s in (-1, 1)]
    sketch = F.percentile_approx(F.col("_v").cast("double"), marks, F.lit(accuracy))
    groups = durable(rows.groupBy("_g").agg(F.count("_v").alias("_total"), sketch.alias("_marks")))
    if not keys:
        groups = df.sparkSession.range(1).select(group.alias("_g")).join(groups, "_g", "left")
    known = groups.where("_total > 0")
    bracket = known.select("_g", *[F.element_at("_marks", i + 1).alias(f"_m{i}") for i in range(len(marks))],
                           *[F.element_at(F.array_sort("_marks"), i + 1).alias(f"_e{i}") for i in range(len(marks))])
    position = (F.greatest(F.ceil(F.lit(0.0) + F.col("_p") * F.col("_total")) - 1, F.lit(0)).cast("double") if discrete
                else F.col("_p") * (F.col("_total") - 1))
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()]))
    sides = F.explode(F.array(F.struct(F.lit("lo").alias("side"), F.floor("_pos").alias("rank")), F.struct(F.lit("hi").alias("side"), F.ceil("_pos").alias("rank"))))
    wanted = (known.select("_g", "_total", entries.alias("_w")).select("_g", "_total", F.col("_w.name").alias("_name"), F.col("_w.p").alias("_p"))
              .withColumn("_pos", position).withColumn("_r", sides)
              .select("_g", "_name", F.col("_r.side").alias("_side"), F.col("_r.rank").alias("_rank"), (F.col("_pos") - F.floor("_pos")).alias("_frac")))
    joined = rows.where("_v is not null").join(bracket, "_g")
    near = [F.col("_v").cast("double").between(F.col(f"_m{i}"), F.col(f"_m{i + 1}")) for i in range(0, len(marks), 2)]
    inside = reduce(lambda a, b: a | b, near)
    celled = joined.select("_g", "_v", _cell(F.col("_v"), [F.col(f"_e{i}") for i in range(len(marks))]).alias("_cell"), inside.alias("_kept"))

    def counted(df: DataFrame) -> DataFrame:
        kept = F.when(F.col("_kept"), F.col("_v"))
        return durable(df.groupBy("_g", "_cell", "_kept", kept.alias("_v")).agg(F.count(F.lit(1)).alias("_n")))

    counts = counted(celled)
    hits = durable(_hits(_cells(counts, "_g"), wanted, "_g"))
    if not hits.where("not _kept").isEmpty():
        # The sketch was off for these ranks: their cells are read once more, whole.
        # At most two cells per entry of a group.
        missed = hits.where("not _kept").groupBy("_g").agg(F.collect_set("_cell").alias("_missed"))
        again = celled.join(missed, "_g", "left").withColumn("_kept", F.col("_kept") | F.coalesce(F.array_contains("_missed", F.col("_cell")), F.lit(False)))
        counts = counted(again.drop("_missed"))
        hits = durable(_hits(_cells(counts, "_g"), wanted, "_g"))
    # From here on each entry looks for one rank among the values of its cell.
    one = F.struct("_g", "_name", "_side").alias("_e")
    entry = hits.select(one, "_g", "_cell", "_frac", (F.col("_rank") - F.col("_below")).alias("_rank"), "_kinds")
    pool = counts.select("_g", "_cell", "_v", "_n").join(entry.drop("_kinds"), ["_g", "_cell"]).select("_e", "_frac", "_rank", "_v", "_n")
    most = entry.agg(F.max("_kinds")).first()[0] or 0
    while most > crowd:
        pool, most = _narrowed(durable(pool), accuracy, most)
    upto = Window.partitionBy("_e").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (pool.withColumn("_end", F.sum("_n").over(upto))
             .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n"))))

    def pick(name: str, side: str, column: str) -> Column:
        return F.max(F.when((F.col("_e._name") == name) & (F.col("_e._side") == side), F.col(column)))

    outputs = []
    for name in names:
        low, high = pick(name, "lo", "_v"), pick(name, "hi", "_v").cast("double")
        share = pick(name, "lo", "_frac")
        # Where nothing is to interpolate, infinite neighbours do not matter.
        between = F.when((share == 0) | (low.cast("double") == high), low.cast("double")).otherwise(low.cast("double") + (high - low.cast("double")) * share)
        outputs.append(low.alias(name) if discrete else between.alias(name))
    result = groups.select("_g").join(found.groupBy(F.col("_e._g").alias("_g")).agg(*outputs), "_g", "left")
    return result.select(*[F.col(f"_g.{k}").alias(k) for k in keys], *probs)


def _narrowed(pool: DataFrame, accuracy: int, before: int) -> tuple[DataFrame, int]:
    """``pool`` cut down to the cell of each entry's rank among sketched quantiles of its different values.

    A cell between two cut points holds at most one part in ``_CUTS`` of them and
    the sketch's error. Only values that are one and the same double are not cut
    further: whole numbers beyond 2**53, and decimals of many digits, that one
    task then orders. The second result is 0 if that is all that is left.
    """
    cuts = [(i + 1) / (_CUTS + 1) for i in range(_CUTS)]
    sketched = pool.groupBy("_e").agg(F.array_sort(F.percentile_approx(F.col("_v").cast("double"), cuts, F.lit(accuracy))).alias("_edges"))
    edges = sketched.select("_e", *[F.element_at("_edges", i + 1).alias(f"_e{i}") for i in range(_CUTS)])
    celled = durable(pool.join(edges, "_e").withColumn("_cell", _cell(F.col("_v"), [F.col(f"_e{i}") for i in range(_CUTS)]))
                     .select(*pool.columns, "_cell", F.lit(True).alias("_kept")))
    wanted = celled.select("_e", "_rank").distinct()
    hit = durable(_hits(_cells(celled, "_e"), wanted, "_e").select("_e", "_cell", "_below", "_kinds"))
    after = hit.agg(F.max("_kinds")).first()[0] or 0
    left = celled.drop("_kept").join(hit.drop("_kinds"), ["_e", "_cell"]).withColumn("_rank", F.col("_rank") - F.col("_below"))
    return left.select(*pool.columns), after if after < before else 0
