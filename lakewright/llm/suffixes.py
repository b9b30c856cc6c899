"""Long repeated substrings over a whole corpus, by suffix arrays of shards that share anchors.

Equal strings of LENGTH bytes must meet in one shard. Each window of LENGTH
bytes is therefore keyed by its anchor, the k-gram with the least hash in it
(the leftmost of equals): equal windows have equal anchors at the same place.
Consecutive windows with one anchor form a run, and the bytes of a run a
segment. Anchors that occur once in the corpus have no repeated window; of the
others, equal segments need no further look, and different segments of one
anchor meet in a shard, whose suffix array and common prefixes tell which of
their windows are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import Steps, gram_hashes, span_hashes, text_step, utf8
from lakewright.llm.suffixarray import SEPARATOR, common_prefixes, suffix_array
from lakewright.operators.windows import match

LENGTH = 100
GRAM = 24
#: Bytes of the segments of one shard, and the most that one anchor may bring into it before it is split.
SHARD_BYTES = 1 << 20


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The runs of windows with one anchor, of every row.

    row, start (first window, in the row), n (windows), off (anchor minus first
    window), f (hash of the anchor), g (hash of the segment).
    """
    last = offsets[1:] - length
    some = np.flatnonzero(last >= offsets[:-1])
    empty = np.zeros(0, np.int64)
    if not len(some):
        return dict.fromkeys(("row", "start", "n", "off"), empty) | {"f": empty.copy(), "g": empty.copy()}
    grams = gram_hashes(data, gram)
    # High bits order the grams and positions break ties, so one minimum gives the leftmost least.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, length - gram + 1
    while width * 2 <= span:
        np.minimum(least[:-width], least[width:], out=least[:-width])
        least = least[:-width]
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    anchor = least.astype(np.uint32)  # the low bits, as positions of a step fit into them
    valid = np.zeros(len(anchor), bool)
    for a, b in zip(offsets[:-1][some].tolist(), last[some].tolist()):
        valid[a:b + 1] = True
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    # Rows that touch without an invalid window between them exist only if length is 1.
    begin = np.flatnonzero(first)
    stop = np.flatnonzero(valid & np.concatenate([first[1:] | ~valid[1:], [True]])) + 1
    row = np.searchsorted(offsets, begin, side="right") - 1
    return {"row": row, "start": begin - offsets[row], "n": stop - begin, "off": anchor[begin].astype(np.int64) - begin,
            "f": grams[anchor[begin]].view(np.int64), "g": span_hashes(data, begin, stop - 1 + length).view(np.int64)}


def _anchors(source: DataFrame, length: int, gram: int) -> DataFrame:
    """(f, g, d, start, n, off) of every run of every document."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = runs(*utf8(batch.column("text")), length, gram)
        return pa.RecordBatch.from_pydict({
            "f": pa.array(found["f"]), "g": pa.array(found["g"]), "d": batch.column("d").take(pa.array(found["row"])),
            "start": pa.array(found["start"], pa.int64()), "n": pa.array(found["n"], pa.int32()), "off": pa.array(found["off"], pa.int32())})

    return text_step(source, "text", work, f"f long, g long, d {dict(source.dtypes)['d']}, start long, n int, off int")


def _place(d: str = "d", start: str = "start") -> Column:
    return F.struct(F.col(d).isNull().alias("no_id"), F.col(d).alias("d"), F.col(start).alias("start"))


def _firsts_and_copies(found: DataFrame, keep: list[str], steps: Steps, name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (f, g, d, start, ...): those that come first in their (f, g), and the places of all others.

    The firsts are written, so that the join back to all rows can split a segment that is very common.
    """
    best = steps.write(name, found.groupBy("f", "g").agg(
        F.min(F.struct(_place().alias("p"), *keep)).alias("b"), F.count(F.lit(1)).alias("copies")))
    firsts = best.select("f", "g", F.col("b.p.d").alias("d"), F.col("b.p.start").alias("start"), *[F.col(f"b.{c}").alias(c) for c in keep], "copies")
    repeated = best.where("copies > 1").select("f", "g", F.col("b.p").alias("p"))
    copies = found.join(repeated, ["f", "g"]).where(~_place().eqNullSafe(F.col("p"))).select("d", "start", "n")
    return firsts, copies


def _various(firsts: DataFrame) -> DataFrame:
    """First segments of the anchors that have more than one segment."""
    several = firsts.groupBy("f").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("f")
    return firsts.join(several, "f", "left_semi")


def _with_segments(runs_: DataFrame, source: DataFrame, length: int) -> DataFrame:
    """Runs (f, d, start, n, off) with the bytes of their segments, cut in the documents."""
    listed = runs_.groupBy("d").agg(F.collect_list(F.struct("f", "start", "n", "off")).alias("runs"))
    joined = match(source, listed, ["d"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("runs")
        flat = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        cut = [raw[r][a:a + k - 1 + length] for r, a, k in zip(row.tolist(), start.tolist(), n.tolist())]
        return pa.RecordBatch.from_pydict({
            "f": flat.field("f"), "d": batch.column("d").take(pa.array(row)), "start": flat.field("start"), "n": flat.field("n"),
            "off": flat.field("off"), "segment": pa.array(cut, pa.binary())})

    kind = dict(source.dtypes)["d"]
    return text_step(joined.select("d", "text", "runs"), "text", work, f"f long, d {kind}, start long, n int, off int, segment binary")


def repeated_windows(order: np.ndarray, places: list, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray, length: int) -> list[np.ndarray]:
    """Per segment the windows that occur at an earlier place of the shard, given its suffix array.

    ``places`` are the documents' ranks; segment k holds sizes[k] bytes and begins at ``starts[k]`` of its document.
    """
    shared = common_prefixes(text, order)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    segment = np.repeat(np.arange(len(sizes)), sizes + 1)[order]
    inner = order - base[segment]
    window = inner <= sizes[segment] - length
    group = np.cumsum(shared[order] < length)[window]
    segment, inner = segment[window], inner[window]
    if not len(segment):
        return [segment, inner]
    place = np.asarray(places, np.int64)[segment] * (1 << 40) + starts[segment] + inner
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(place, begin)
    later = place > np.repeat(least, np.diff(np.append(begin, len(place))))
    return [segment[later], inner[later]]


def _shard(length: int) -> Callable[[pa.Table], pa.Table]:
    def work(table: pa.Table) -> pa.Table:
        # Documents in order of their ids, null last; keys are compared as Spark compares them.
        keys = table.column("d").to_pylist()
        some = {k for k in map(_frozen, keys) if k is not None}
        rank = {k: r for r, k in enumerate(sorted(some))}
        places = [rank.get(_frozen(k), len(rank)) for k in keys]
        pieces = table.column("segment").to_pylist()
        text = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        starts = table.column("start").to_numpy()
        found = repeated_windows(suffix_array(text), places, starts, sizes, text, length)
        if not len(found[0]):
            return pa.table({"d": table.column("d").slice(0, 0), "start": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})
        turn = np.lexsort((found[1], found[0]))
        segment, inner = found[0][turn], found[1][turn]
        first = np.concatenate([[True], (segment[1:] != segment[:-1]) | (inner[1:] != inner[:-1] + 1)])
        begin = np.flatnonzero(first)
        return pa.table({"d": table.column("d").take(pa.array(segment[begin])), "start": pa.array(starts[segment[begin]] + inner[begin], pa.int64()),
                         "n": pa.array(np.diff(np.append(begin, len(segment))), pa.int32())})

    return work


def _frozen(key):
    """Ids as Python can sort them: text by code point, which is the order of its UTF-8."""
    return tuple(key.values()) if isinstance(key, dict) else key


def _split(crowded: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of crowded anchors cut in two by the distance from window to anchor.

    All windows of a half share more bytes around the anchor than the gram; the
    hash of those becomes the half's anchor. ``low`` and ``high`` bound the distances.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = {c: batch.column(c).to_pylist() for c in ("f", "start", "n", "off", "low", "high", "segment")}
        out = {c: [] for c in ("row", "f", "g", "start", "n", "off", "low", "high", "segment")}
        for k in range(batch.num_rows):
            f, start, n, off, low, high, segment = (columns[c][k] for c in columns)
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle, high)):
                # Windows q = off - distance of this half.
                q, end = max(0, off - b + 1), min(n, off - a + 1)
                if q >= end:
                    continue
                own = segment[q:end - 1 + length]
                core = segment[off - a:off - b + 1 + length]
                key = hashlib.blake2b(core, digest_size=8, key=f"{f}:{a}:{b}".encode()).digest()
                mark = hashlib.blake2b(own, digest_size=8).digest()
                values = (k, int.from_bytes(key, "little", signed=True), int.from_bytes(mark, "little", signed=True),
                          start + q, end - q, off - q, a, b, own)
                for c, v in zip(out, values):
                    out[c].append(v)
        row = pa.array(out.pop("row"), pa.int64())
        kinds = {"f": pa.int64(), "g": pa.int64(), "start": pa.int64(), "n": pa.int32(), "off": pa.int32(), "low": pa.int32(),
                 "high": pa.int32(), "segment": pa.binary()}
        return pa.RecordBatch.from_pydict({"d": batch.column("d").take(row)} | {c: pa.array(out[c], kinds[c]) for c in out})

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield work(batch).select(["f", "g", "d", "start", "n", "off", "low", "high", "segment"])

    kind = dict(crowded.dtypes)["d"]
    return crowded.select("f", "d", "start", "n", "off", "low", "high", "segment").mapInArrow(
        run, f"f long, g long, d {kind}, start long, n int, off int, low int, high int, segment binary")


def _repeats(source: DataFrame, length: int, gram: int, shard_bytes: int, steps: Steps) -> DataFrame:
    """(d, start, n): runs of windows that occur at an earlier place of the corpus."""
    found = steps.write("anchors", _anchors(source, length, gram))
    often = steps.write("often", found.groupBy("f").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("f"))
    # Anchors of the corpus are many and each is listed once, so they are looked up by hash instead of sorted.
    again = steps.write("again", found.join(often.hint("shuffle_hash"), "f", "left_semi"))
    steps.drop("anchors", "often")
    firsts, copies = _firsts_and_copies(again, ["n", "off"], steps, "firsts-0")
    repeats = [steps.write("copies-0", copies)]
    various = steps.write("various", _various(firsts).select("f", "d", "start", "n", "off"))
    steps.drop("again")
    level = steps.write("segments-0", _with_segments(various, source, length).withColumn("low", F.lit(0)).withColumn(
        "high", F.lit(length - gram + 1)))
    steps.drop("various")
    shards = []
    for turn in range(1, 64):
        sizes = level.groupBy("f").agg(F.sum(F.length("segment") + 1).alias("bytes"))
        crowded = steps.write(f"crowded-{turn}", sizes.where(F.col("bytes") > shard_bytes).select("f"))
        if crowded.isEmpty():
            shards.append(level)
            break
        shards.append(level.join(crowded, "f", "left_anti"))
        # A half of one window has equal segments only, so it cannot be crowded again.
        halves = steps.write(f"halves-{turn}", _split(level.join(crowded, "f", "left_semi"), length, gram))
        firsts, copies = _firsts_and_copies(halves, ["n", "off", "low", "high", "segment"], steps, f"firsts-{turn}")
        repeats.append(steps.write(f"copies-{turn}", copies))
        level = steps.write(f"segments-{turn}", _various(firsts).select(*level.columns))
    for k, part in enumerate(shards):
        total = part.agg(F.sum(F.length("segment") + 1)).first()[0] or 0
        count = max(1, -(-total // shard_bytes))
        kind = dict(part.dtypes)["d"]
        sharded = part.select("d", "start", "segment", F.pmod(F.xxhash64("f"), F.lit(count)).alias("shard"))
        repeats.append(steps.write(f"shards-{k}", sharded.groupBy("shard").applyInArrow(_shard(length), f"d {kind}, start long, n int")))
    whole = repeats[0]
    for more in repeats[1:]:
        whole = whole.unionByName(more)
    return whole


def without_repeats(documents: DataFrame, *, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row.

    Every byte goes that is covered by a string of ``length`` bytes that also
    starts earlier in the input: in a document with a smaller id (null last), or
    before in the same document; overlaps count, and strings do not cross
    documents. ``kept`` holds the bytes that stay, ``n_spans`` counts the
    maximal runs removed. Null and empty texts have nothing to remove.

    If ids repeat, rows are told apart by id and text: of rows with one id, the
    order of a hash of the text decides which is earlier. Rows with the same id
    and text count as one document, and lose the same bytes. No rows give no
    rows; other columns are ignored. Anchors and segments are told apart by two
    64-bit hashes, of the gram and of the whole segment.
    """
    steps = Steps(documents.sparkSession, "suffixes")
    plain = documents.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    unique = plain.groupBy("doc_id").count().where("count > 1").isEmpty()
    key = F.col("doc_id") if unique else F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    source = plain.select(key.alias("d"), "text")
    repeats = _repeats(source.where(F.col("text").isNotNull()), length, gram, shard_bytes, steps)
    ranges = steps.write("ranges", repeats.groupBy("d").agg(F.collect_list(F.struct("start", "n")).alias("ranges")))
    steps.drop(*[s for s in list(steps.paths) if s != "ranges"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, removed, spans, sizes = [], [], [], []
        for text, listed in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            raw, parts, at, n = (text or "").encode(), [], 0, 0
            for a, b in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in listed or []):
                if a > at or (a == at == 0):
                    parts.append(raw[at:a])
                    n += 1
                at = max(at, b)
            parts.append(raw[at:])
            whole = b"".join(parts)
            kept.append(whole)
            removed.append(len(raw) - len(whole))
            spans.append(n)
            sizes.append(len(raw))
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])})

    joined = match(plain.select("doc_id", "text", key.alias("d")), ranges, ["d"], "left").select("doc_id", "text", "ranges")
    kind = dict(plain.dtypes)["doc_id"]
    return text_step(joined, "text", work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
