"""Ordered window functions that survive one key holding most of the rows.

A plain window puts a whole key into one task. Here the rows are range
partitioned by (key, order), so a large key spans many chunks, each chunk is
windowed on its own, and what earlier chunks contribute is carried over. Only
keys that span several chunks need a carry. A chunk has at most two such keys
(the one it starts with and the one it ends with), so carry tables hold at most
two rows per range partition and are safe to broadcast at any table size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.sources.tables import durable

CHUNK = "_chunk"


def match(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same name in which null equals null."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    if not on:
        return left.join(renamed, F.lit(True), how)
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Rows with a ``_chunk`` number that grows along (keys, order).

    Written once, so that a lost executor cannot move a row to another chunk.
    """
    columns = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(chunks, *columns) if chunks else df.repartitionByRange(*columns)
    return durable(ranged.withColumn(CHUNK, F.spark_partition_id()))


def spanning_keys(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found in more than one chunk: at most one per chunk boundary."""
    span = chunked.groupBy(*keys).agg(F.min(CHUNK).alias("_first"), F.max(CHUNK).alias("_last"))
    return F.broadcast(span.where("_first < _last").select(*keys, F.lit(True).alias("_spans")))


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _chunk_totals(chunked: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    spanning = match(chunked, spanning_keys(chunked, keys), keys, "left_semi")
    return spanning.groupBy(*keys, CHUNK).agg(*aggs)


def _inside(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, chunks: int | None = None) -> DataFrame:
    """Row number per key; ``order`` must be unique within a key."""
    chunked = ordered_chunks(df, keys, order, chunks)
    totals = _chunk_totals(chunked, keys, F.count(F.lit(1)).alias("_n"))
    before = totals.select(*keys, CHUNK, F.sum("_n").over(_earlier(keys)).alias("_before"))
    local = chunked.withColumn("_local", F.row_number().over(_inside(keys, order)))
    return (match(local, F.broadcast(before), [*keys, CHUNK], "left")
            .withColumn(name, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long"))
            .drop("_local", "_before", CHUNK))


# How the values of earlier chunks and of the own chunk combine.
_COMBINE = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + b,
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}
_FN = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def running_points(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, str]],
                   chunks: int | None = None) -> DataFrame:
    """Running aggregates with one row per distinct (key, order) value.

    ``specs`` maps an output name to (sum, count, min, max or avg; column). Rows
    that tie on ``order`` share a value, as in the default window frame, and are
    combined before the shuffle.
    """
    parts: dict[str, tuple[str, str]] = {}
    for name, (fn, column) in specs.items():
        for step in (("sum", "count") if fn == "avg" else (fn,)):
            parts[f"_{step}_{name}"] = (step, column)
    points = df.groupBy(*keys, order).agg(*[_FN[f](c).alias(p) for p, (f, c) in parts.items()])
    merge = {p: ("sum" if f == "count" else f) for p, (f, _) in parts.items()}
    chunked = ordered_chunks(points, keys, [order], chunks)
    totals = _chunk_totals(chunked, keys, *[_FN[m](p).alias(p) for p, m in merge.items()])
    before = totals.select(*keys, CHUNK, *[_FN[m](p).over(_earlier(keys)).alias(f"_b{p}") for p, m in merge.items()])
    inside = _inside(keys, [order]).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.select(*keys, order, CHUNK, *[_FN[m](p).over(inside).alias(p) for p, m in merge.items()])
    joined = match(local, F.broadcast(before), [*keys, CHUNK], "left")
    whole = {p: _COMBINE[f](F.col(f"_b{p}"), F.col(p)) for p, (f, _) in parts.items()}
    outputs = []
    for name, (fn, _) in specs.items():
        if fn == "avg":
            n = whole[f"_count_{name}"]
            outputs.append((whole[f"_sum_{name}"].cast("double") / F.nullif(n, F.lit(0))).alias(name))
        else:
            outputs.append(whole[f"_{fn}_{name}"].alias(name))
    return joined.select(*keys, order, *outputs)


def running(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, str]],
            chunks: int | None = None) -> DataFrame:
    """Rows with running aggregates per key in the default frame (ties share a value)."""
    return match(df, running_points(df, keys, order, specs, chunks), [*keys, order], "left")


def ranked(df: DataFrame, keys: list[str], order: str, chunks: int | None = None) -> DataFrame:
    """Rows with ``rank`` and ``dense_rank`` by ascending ``order`` within the keys."""
    points = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_n"))
    chunked = ordered_chunks(points, keys, [order], chunks)
    totals = _chunk_totals(chunked, keys, F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    before = totals.select(*keys, CHUNK, F.sum("_n").over(_earlier(keys)).alias("_bn"),
                           F.sum("_d").over(_earlier(keys)).alias("_bd"))
    inside = _inside(keys, [order])
    upto = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    local = chunked.select(*keys, order, CHUNK, upto.alias("_ahead"), F.row_number().over(inside).alias("_d"))
    places = match(local, F.broadcast(before), [*keys, CHUNK], "left").select(
        *keys, order, (F.col("_ahead") + F.coalesce("_bn", F.lit(0)) + 1).alias("rank"),
        (F.col("_d") + F.coalesce("_bd", F.lit(0))).cast("long").alias("dense_rank"))
    return match(df, places, [*keys, order])


def with_halo(df: DataFrame, keys: list[str], order: list[str], rows: int, *, after: bool = False,
              only: Column | None = None, chunks: int | None = None) -> DataFrame:
    """Chunked rows plus, per chunk, the ``rows`` neighbours it needs from other chunks.

    Window functions partitioned by (keys, _chunk) then see their whole frame;
    drop the helpers afterwards with ``without_halo``. ``only`` restricts which
    rows count as neighbours, ``after`` looks forward instead of back.
    """
    chunked = ordered_chunks(df, keys, order, chunks)
    spanning = match(chunked, spanning_keys(chunked, keys), keys, "left_semi")
    if only is not None:
        spanning = spanning.where(only)
    toward = [F.col(c).asc() if after else F.col(c).desc() for c in order]
    edge = (spanning.withColumn("_e", F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*toward)))
            .where(F.col("_e") <= rows).drop("_e"))
    # At most ``rows`` rows per chunk are left. Each chunk that has some gets the nearest ``rows``
    # seen so far; every chunk then takes that list from the closest chunk that has one.
    held = edge.select(*keys, CHUNK, F.struct(*order).alias("_o"), F.struct(*df.columns).alias("_row"))
    per_chunk = held.groupBy(*keys, CHUNK).agg(
        F.sort_array(F.collect_list(F.struct("_o", "_row")), asc=after).alias("_rows"))
    near = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc() if after else F.col(CHUNK).asc())
    seen = F.collect_list("_rows").over(near.rowsBetween(1 - rows, 0))
    reach = per_chunk.select(*keys, CHUNK, F.slice(F.flatten(F.reverse(seen)), 1, rows).alias("_near"))
    every = match(chunked, spanning_keys(chunked, keys), keys, "left_semi").select(*keys, CHUNK).distinct()
    filled = match(every, reach, [*keys, CHUNK], "left").withColumn(
        "_near", F.last("_near", ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, -1)))
    halo = (filled.select(*keys, F.col(CHUNK).alias("_c"), F.explode("_near").alias("_h"))
            .select(F.col("_h._row").alias("_row"), "_c").select("_row.*", F.col("_c").alias(CHUNK), F.lit(True).alias("_halo")))
    return chunked.withColumn("_halo", F.lit(False)).unionByName(halo)


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_halo", CHUNK)


def rows_frame(df: DataFrame, keys: list[str], order: list[str], preceding: int, aggs: dict[str, Column],
               until: int = 0, chunks: int | None = None) -> DataFrame:
    """Aggregates over ROWS BETWEEN ``preceding`` PRECEDING AND ``until``, with ``order`` unique in a key."""
    frame = _inside(keys, order).rowsBetween(-preceding, until)
    wide = with_halo(df, keys, order, preceding, chunks=chunks)
    return without_halo(wide.withColumns({name: agg.over(frame) for name, agg in aggs.items()}))


def shifted(df: DataFrame, keys: list[str], order: list[str], column: str, offset: int, name: str, *,
            default=None, ignore_nulls: bool = False, chunks: int | None = None) -> DataFrame:
    """Lag (positive offset) or lead (negative offset), optionally skipping nulls."""
    reach = abs(offset)
    wide = with_halo(df, keys, order, reach, after=offset < 0, chunks=chunks,
                     only=F.col(column).isNotNull() if ignore_nulls else None)
    spec = f"{'lag' if offset > 0 else 'lead'}(`{column}`, {reach})" + (" IGNORE NULLS" if ignore_nulls else "")
    partition = ", ".join(f"`{c}`" for c in (*keys, CHUNK))
    ordering = ", ".join(f"`{c}`" for c in order)
    value = F.expr(f"{spec} OVER (PARTITION BY {partition} ORDER BY {ordering})")
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return without_halo(wide.withColumn(name, value))


def edge_value(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, *,
               last: bool = False, ignore_nulls: bool = False) -> DataFrame:
    """Rows with the first or last value of their key, found by a combining aggregate."""
    pick = F.max_by if last else F.min_by
    source = df.where(F.col(column).isNotNull()) if ignore_nulls else df
    ends = source.groupBy(*keys).agg(pick(F.struct(column), F.struct(*order)).getField(column).alias(name))
    return match(df, ends, keys, "left")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, without sorting the key's rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 32) -> DataFrame:
    """The first ``n`` rows of each key; each salt keeps its own first ``n`` before they meet."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    local = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    kept = local.where(F.col("_r") <= n).drop("_r", "_salt")
    final = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return final.where(F.col("_r") <= n).withColumnRenamed("_r", "rank")


def tiles(df: DataFrame, keys: list[str], order: list[str], n: int, name: str, chunks: int | None = None) -> DataFrame:
    """Rows with the number of their tile: ``n`` tiles per key, the first ones larger by a row if they do not divide."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    placed = match(numbered(df, keys, order, "_at", chunks), sizes, keys)
    small, more = F.floor(F.col("_size") / n), F.col("_size") % n
    wide = more * (small + 1)
    tile = F.when(F.col("_at") <= wide, F.floor((F.col("_at") - 1) / (small + 1))).otherwise(
        more + F.floor((F.col("_at") - 1 - wide) / F.greatest(small, F.lit(1))))
    return placed.withColumn(name, (tile + 1).cast("long")).drop("_at", "_size")


def rank_shares(df: DataFrame, keys: list[str], order: str, chunks: int | None = None) -> DataFrame:
    """Rows with ``percent_rank`` and ``cume_dist`` by ascending ``order`` within the keys."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    counted = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_same"))
    upto = running_points(counted, keys, order, {"_upto": ("sum", "_same")}, chunks)
    places = match(match(counted, upto, [*keys, order]), sizes, keys).select(
        *keys, order,
        F.when(F.col("_size") > 1, (F.col("_upto") - F.col("_same")) / F.nullif(F.col("_size") - 1, F.lit(0))).otherwise(0.0).alias("percent_rank"),
        (F.col("_upto") / F.col("_size")).alias("cume_dist"))
    return match(df, places, [*keys, order])


def time_frame(df: DataFrame, keys: list[str], ts: str, seconds: int, specs: dict[str, tuple[str, str]], chunks: int | None = None) -> DataFrame:
    """Aggregates over RANGE BETWEEN ``seconds`` PRECEDING AND CURRENT ROW by time, peers included.

    ``specs`` maps an output name to (count, sum, avg, min or max; column).
    Counts and sums are differences of running ones, looked up at the row and at
    the begin of its frame; sums are exact for whole numbers and decimals. For
    minimum and maximum time is cut into slots as long as the frame: a frame is
    the end of one slot and the begin of the next, so a running value back from
    the end and one from the begin cover it. The running values are taken in
    chunks, so neither a key nor a slot is gathered in one task, and the work
    does not grow with the length of the frame. Rows without time see each other.
    """
    size = seconds * 1_000_000
    marked = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_from", F.col("_at") - size)
    marked = marked.withColumn("_slot", F.floor(F.col("_at") / size)).withColumn("_before", F.col("_slot") - 1)
    columns = sorted({c for _, c in specs.values()})
    values = [F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]
    name_of = {c: f"_c{i}" for i, c in enumerate(columns)}
    held = durable(marked.select(*keys, "_at", "_from", "_slot", "_before", *values))

    def place(at: Column, side: int) -> Column:
        return F.struct(at.alias("at"), F.lit(side).alias("side"))

    def ends(at: Column, side: int, *more: Column) -> DataFrame:
        nothing = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in name_of.values()]
        return held.select(*keys, *more, place(at, side).alias("_place"), *nothing).distinct()

    out, found = marked, {}

    def look_up(running_: DataFrame, side: int, at: str, on: list[str], names: dict[str, str]) -> None:
        nonlocal out
        chosen = running_.where(F.col("_place.side") == side).select(
            *keys, *on[len(keys):-1], F.col("_place.at").alias(at), *[F.col(a).alias(b) for a, b in names.items()])
        out = match(out, chosen, on, "left")

    sums = sorted({(fn, name_of[c]) for f, c in specs.values() for fn in {"count": ("count",), "sum": ("count", "sum"), "avg": ("count", "sum")}.get(f, ())})
    if sums:
        # The begin of a frame stands before the rows of its time: what it counts is outside.
        rows = held.select(*keys, place(F.col("_at"), 1).alias("_place"), *name_of.values())
        upto = durable(running_points(rows.unionByName(ends(F.col("_from"), 0)), keys, "_place", {f"_{fn}{c}": (fn, c) for fn, c in sums}, chunks))
        look_up(upto, 1, "_at", [*keys, "_at"], {f"_{fn}{c}": f"_upto_{fn}{c}" for fn, c in sums})
        look_up(upto, 0, "_from", [*keys, "_from"], {f"_{fn}{c}": f"_less_{fn}{c}" for fn, c in sums})
        for fn, c in sums:
            found[fn, c] = F.coalesce(F.col(f"_upto_{fn}{c}"), F.lit(0)) - F.coalesce(F.col(f"_less_{fn}{c}"), F.lit(0))
    tops = sorted({(f, name_of[c]) for f, c in specs.values() if f in ("min", "max")})
    if tops:
        wanted = {f"_{fn}{c}": (fn, c) for fn, c in tops}
        rows = held.select(*keys, "_slot", place(F.col("_at"), 0).alias("_place"), *name_of.values())
        begin = durable(running_points(rows, [*keys, "_slot"], "_place", wanted, chunks))
        look_up(begin, 0, "_at", [*keys, "_slot", "_at"], {n: f"_own{n}" for n in wanted})
        # Backwards in time, the rows of a moment before the begin of a frame that lies on it.
        back = rows.withColumn("_place", place(-F.col("_place.at"), 0))
        edges = ends(-F.col("_from"), 1, F.col("_before").alias("_slot"))
        rest = durable(running_points(back.unionByName(edges), [*keys, "_slot"], "_place", wanted, chunks))
        rest = rest.withColumn("_place", place(-F.col("_place.at"), 1)).where(rest["_place.side"] == 1).withColumnRenamed("_slot", "_before")
        look_up(rest, 1, "_from", [*keys, "_before", "_from"], {n: f"_rest{n}" for n in wanted})
        for fn, c in tops:
            found[fn, c] = (F.least if fn == "min" else F.greatest)(F.col(f"_own_{fn}{c}"), F.col(f"_rest_{fn}{c}"))
    outputs = {}
    for name, (fn, column) in specs.items():
        c = name_of[column]
        if fn in ("sum", "avg"):
            n = found["count", c]
            total = F.when(n > 0, found["sum", c])
            outputs[name] = total if fn == "sum" else total.cast("double") / F.nullif(n, F.lit(0))
        else:
            outputs[name] = found[fn, c].cast("long") if fn == "count" else found[fn, c]
    return out.select(*df.columns, *[e.alias(n) for n, e in outputs.items()])


def affine_scan(df: DataFrame, keys: list[str], seq: str, value: str, q: float, name: str) -> DataFrame:
    """Solve y[n] = q * y[n-1] + value[n], y[0] = 0, along ``seq`` = 1, 2, ... per key.

    Rows are cut into blocks of fixed length, solved within the block in closed
    form, and the block ends form a shorter series of the same kind. The block
    length keeps powers of q within the range of a double.
    """
    if q == 0.0:
        return df.withColumn(name, F.col(value).cast("double"))
    length = 1024 if q >= 1 else max(2, min(1024, int(150 / -math.log10(q))))
    block = (F.floor((F.col(seq) - 1) / length)).cast("long")
    place = (F.col(seq) - 1) % length + 1
    blocks = df.withColumn("_block", block).withColumn("_at", place)
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    power = F.pow(F.lit(q), F.col("_at").cast("double"))
    local = blocks.withColumn("_y", power * F.sum(F.col(value) / power).over(inside))
    ends = local.where(F.col("_at") == length).select(
        *keys, (F.col("_block") + 1).alias("_bseq"), F.col("_y").alias("_end"))
    jump = q ** length
    if jump < 1e-30:
        carried = ends
    else:
        carried = affine_scan(ends, keys, "_bseq", "_end", jump, "_solved").drop("_end").withColumnRenamed("_solved", "_end")
    carried = carried.select(*keys, F.col("_bseq").alias("_block"), F.col("_end").alias("_carry"))
    return (match(local, carried, [*keys, "_block"], "left")
            .withColumn(name, F.col("_y") + power * F.coalesce("_carry", F.lit(0.0)))
            .drop("_block", "_at", "_y", "_carry"))
