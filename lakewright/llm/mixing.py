"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import Steps, word_count
from lakewright.operators.windows import match, numbered, running_points

WEIGHTS = (5, 2, 1)


def source_targets(sources: DataFrame, share: float, repeats: int, weights: Sequence[int], steps: Steps) -> DataFrame:
    """Words to take per source: shares by weight, none above ``repeats`` times what the source has.

    ``sources`` holds one row (source, source_size) per source. Sources get their
    weights in code-point order, null last. What a full source cannot take goes
    to the others by weight; each round closes the sources that are full, so
    there are as many rounds as levels at which sources fill up.
    """
    ordered = numbered(sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    listed = steps.write("sources", ordered.select(
        "source", "source_size", "_null", weight.cast("long").alias("weight"), (F.col("source_size") * repeats).alias("cap")))
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    level, closed = 0.0, -1
    while True:
        full = F.col("cap").cast("double") <= F.lit(level) * F.col("weight")
        n, held, open_weight = listed.agg(
            F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == closed or not open_weight:
            break
        closed, level = n, (budget - (held or 0)) / open_weight
    full = F.col("cap").cast("double") <= F.lit(level) * F.col("weight")
    return listed.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight")))


def mix(documents: DataFrame, *, share: float = 1.5, repeats: int = 2, weights: Sequence[int] = WEIGHTS,
        seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words a mix takes of each document: (doc_id, source, size, source_size, target, taken).

    Every document stands in its source's queue once per repetition, shuffled by
    a seeded hash of its id. Its virtual finish time is the source's words up to
    and including it divided by the source's target. All queues are merged in
    the order of finish times and cut where the budget is used up, so a source
    has taken words close to its target when the cut comes.

    Result: one row per input row. Null text has size 0 and is never taken (0).
    A null source is a source of its own, last in order. Rows of one source with
    the same id share a place in the queue: they are taken together or not at all.
    No rows give no rows. Other columns of the input are ignored.
    """
    steps = Steps(documents.sparkSession, "mix")
    place = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))),
                     F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = steps.write("sizes", documents.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), place.alias("place")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, share, repeats, weights, steps)
    places = running_points(sized, ["source"], "place", {"upto": ("sum", "size")})
    rows = match(match(sized, places, ["source", "place"]), targets.select("source", "_null", "source_size", "target"), ["source"])
    queued = steps.write("queued", rows)
    finish = [((F.lit(k) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")) for k in range(repeats)]
    turns = [F.struct(finish[k].alias("finish"), F.col("_null").alias("nosource"), F.col("source").alias("source"),
                      F.col("place").alias("place")) for k in range(repeats)]
    entries = queued.where("size > 0 and target > 0").select("size", F.explode(F.array(*turns)).alias("turn"))
    budget = (queued.sparkSession.read.parquet(steps.paths["sources"]).agg(F.sum("source_size")).first()[0] or 0) * share
    merged = running_points(entries, [], "turn", {"words": ("sum", "size")})
    last = merged.where(F.col("words") > F.lit(float(budget))).agg(F.min("turn").alias("turn")).first()["turn"]
    if last is None:
        passed = [F.lit(1)] * repeats
    else:
        cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["nosource"]).alias("nosource"),
                       F.lit(last["source"]).cast("string").alias("source"), F.lit(last["place"]).alias("place"))
        passed = [F.when(turn < cut, 1).otherwise(0) for turn in turns]
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(passed[1:], passed[0])).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each input row as many times as it is taken, with all its columns."""
    taken = mix(documents, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("taken > 0").select(
        F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"),
        (F.col("taken") / F.col("size")).cast("int").alias("times")).distinct()
    # Columns go by position, so names cannot clash.
    held = documents.toDF(*[f"c{k}" for k in range(len(documents.columns))])
    at = {c: f"c{documents.columns.index(c)}" for c in (id_col, text_col, source_col)}
    joined = held.join(taken.hint("merge"), F.col(at[id_col]).eqNullSafe(F.col("t_id")) & F.col(at[source_col]).eqNullSafe(F.col("t_source"))
                       & (word_count(at[text_col]) == F.col("t_size")))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*held.columns).toDF(*documents.columns)
