"""Ranked lexical search over a length-stratified index: postings by frequency within documents of one normaliser."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import _BATCH, BATCH_BYTES, Steps, text_step
from lakewright.operators.windows import running, running_points, top_per_key

#: Bytes that belong to a term: digits, letters and all of other alphabets; A-Z count as a-z.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
#: A piece of a stratum ends at so many documents or postings.
PIECE_DOCUMENTS, PIECE_POSTINGS = 2048, 1 << 18
#: Strata whose places are sent to every task, three numbers each; with more of them they are joined to the documents instead.
SENT_STRATA = 200_000
#: Items are looked up in blocks of about so many bytes of terms, as a block travels to every task.
BLOCK_BYTES = 4 << 20
SCALE, SATURATION, NORM = 10 ** 9, 1000, 12
_PIECE = "m long, docs array<{id}>, terms array<binary>, df array<int>, runs array<int>, tf array<long>, length array<int>, posting array<int>"


def term_counts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, times): of each row the number of terms, its different terms and how often each occurs."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, times, sizes, n = [], [], [0], []
        for text in batch.column("text").to_pylist():
            counts = Counter((text or "").encode().translate(_TERM).split())
            terms += counts.keys()
            times += counts.values()
            sizes.append(len(terms))
            n.append(counts.total())
        ends = pa.array(sizes, pa.int32())
        return pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "n": pa.array(n, pa.int64()), "terms": pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary())),
            "times": pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))})

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return text_step(rows, "text", work, f"id {dict(rows.dtypes)['id']}, n long, terms array<binary>, times array<long>")


def _normaliser(n: Column, documents: int, terms: int) -> Column:
    return F.lit(100 - 25) + F.call_function("div", (25 * n).cast("decimal(20,0)") * F.lit(documents), F.lit(terms))


def _piece(m: int, ids: pa.Array, terms: pa.ListArray, times: pa.ListArray) -> dict:
    """The postings of some documents of one stratum, by term and, within a term, by frequency."""
    held = terms.flatten().dictionary_encode()
    code, tf = held.indices.to_numpy().astype(np.int64), times.flatten().to_numpy()
    doc = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy())
    order = np.lexsort((tf, code))
    code, tf, doc = code[order], tf[order], doc[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])
    begin = np.flatnonzero(fresh)
    size = len(held.dictionary)
    return {"m": m, "docs": ids, "terms": held.dictionary, "df": np.bincount(code, minlength=size), "runs": np.bincount(code[begin], minlength=size),
            "tf": tf[begin], "length": np.diff(np.append(begin, len(code))), "posting": doc}


def _list(values: list, kind: pa.DataType) -> pa.ListArray:
    arrays = [v.cast(kind) if isinstance(v, pa.Array) else pa.array(v, kind) for v in values]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.concat_arrays(arrays))


def _batch(pieces: list[dict]) -> pa.RecordBatch:
    kinds = {"docs": pieces[0]["docs"].type, "terms": pa.binary(), "tf": pa.int64()}
    return pa.RecordBatch.from_pydict({"m": pa.array([p["m"] for p in pieces], pa.int64()), **{
        c: _list([p[c] for p in pieces], kinds.get(c, pa.int32())) for c in ("docs", "terms", "df", "runs", "tf", "length", "posting")}})


@dataclass(frozen=True)
class Index:
    """``pieces`` holds one row per piece of a stratum; documents with terms, and all their terms, are counted."""

    pieces: DataFrame
    documents: int
    terms: int


def build_index(documents: DataFrame, steps: Steps, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows that have a term, in pieces of bounded size.

    Strata in the order of their normaliser m are cut into slots of about as
    many postings as a piece has, so documents of a stratum lie together, a
    stratum of any size is split, and long documents crowd no task.
    """
    counted = steps.write("counted", term_counts(documents, id_col, text_col).where("n > 0"))
    n, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = dict(counted.dtypes)["id"]
    placed = counted.withColumn("m", _normaliser(F.col("n"), n, max(total, 1))).withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    sizes = steps.write("strata", placed.groupBy("m").agg(F.sum(F.size("terms")).alias("own")))
    ends = sizes.join(running_points(sizes, [], "m", {"upto": ("sum", "own")}), "m")
    if sizes.count() <= SENT_STRATA:
        ends = F.broadcast(ends)
    # Within a stratum the hash tells a document's slot.
    inside = F.pmod(F.col("place"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    slot = F.floor((F.col("upto") - F.col("own") + inside * F.col("own")) / PIECE_POSTINGS)
    strata = placed.join(ends, "m").withColumn("slot", slot).select("slot", "m", "place", "id", "terms", "times").repartition("slot").sortWithinPartitions(
        "slot", "m", "place").drop("slot")

    def cut(batches):
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def piece() -> dict:
            table = pa.Table.from_batches(held).combine_chunks()
            one = [table.column(c).chunk(0) for c in ("id", "terms", "times")]
            return _piece(held[0].column("m")[0].as_py(), *one)

        for batch in batches:
            m = batch.column("m").to_numpy()
            sizes = pc.list_value_length(batch.column("terms")).to_numpy()
            done, start = [], 0
            for k in range(batch.num_rows):
                other = m[k] != (m[k - 1] if k else held[0].column("m")[0].as_py() if held else m[k])
                if docs and (other or docs >= PIECE_DOCUMENTS or postings >= PIECE_POSTINGS):
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    done.append(piece())
                    held, docs, postings, start = [], 0, 0, k
                docs, postings = docs + 1, postings + int(sizes[k])
            if start < batch.num_rows:
                held.append(batch.slice(start))
            if done:
                yield _batch(done)
        if held:
            yield _batch([piece()])

    documents.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    pieces = steps.write("index", strata.mapInArrow(cut, _PIECE.format(id=kind)))
    steps.drop("counted", "strata")
    return Index(pieces, n, total)


class _Piece:
    """One piece, cut down to the terms of a block of items; impacts are computed once per frequency."""

    def __init__(self, row: dict, known: pa.Array, weight: np.ndarray):
        at = pc.index_in(known, value_set=row["terms"])
        #: Of each term of the block its own number here, or -1.
        self.local = np.full(len(known), -1, np.int64)
        found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        where = at.fill_null(0).to_numpy()[found]
        self.local[found] = np.arange(len(found))
        run_end, post_end = np.cumsum(row["runs"]), np.cumsum(row["length"])
        tf = row["tf"].astype(np.int64)
        impact = SCALE * tf // (SATURATION * tf + NORM * row["m"])
        last = run_end[where] - 1
        first = last - row["runs"][where] + 1
        #: The last run of a term has its largest frequency.
        self.most = weight[found] * impact[last]
        self.begin, self.end = post_end[first] - row["length"][first], post_end[last]
        self.value = np.repeat(impact, row["length"])
        self.posting, self.docs = row["posting"], row["docs"]
        self.weight = weight[found]

    def scores(self, terms: np.ndarray, times: np.ndarray, bound: int) -> np.ndarray:
        own = self.local[terms]
        here = own >= 0
        own, factor = own[here], times[here] * self.weight[self.local[terms[here]]]
        out = np.zeros(len(self.docs), np.int64)
        if not len(own):
            return out
        parts = [slice(a, b) for a, b in zip(self.begin[own].tolist(), self.end[own].tolist())]
        posting = np.concatenate([self.posting[p] for p in parts])
        value = np.concatenate([self.value[p] * f for p, f in zip(parts, factor.tolist())])
        if bound < 1 << 53:  # sums of doubles are exact up to there
            return np.bincount(posting, value, len(out)).astype(np.int64)
        np.add.at(out, posting, value)
        return out


@dataclass
class _Best:
    """The highest scores of one item so far; equal ones by ascending id, null last."""

    k: int
    rows: list[tuple] = field(default_factory=list)
    least: int = 1

    def add(self, scores: np.ndarray, docs: pa.Array) -> None:
        at = np.flatnonzero(scores >= self.least)
        if len(at) > self.k:
            # All that tie with the last of the best stay until ids decide.
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        if not len(at):
            return
        self.rows += zip((-scores[at]).tolist(), docs.take(pa.array(at)).to_pylist())
        self.rows.sort(key=lambda r: (r[0], r[1] is None, r[1]))
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def _frequencies(index: Index, known: list[bytes]) -> np.ndarray:
    """In how many documents each term of a block stands."""
    def count(batches):
        terms, total = pa.array(known, pa.binary()), np.zeros(len(known), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at = pc.index_in(terms, value_set=batch.column("terms")[row].values)
                found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                total[found] += batch.column("df")[row].values.to_numpy()[at.fill_null(0).to_numpy()[found]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some), "df": pa.array(total[some])})

    out = np.zeros(len(known), np.int64)
    for term, df in index.pieces.select("terms", "df").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def _found(index: Index, items: list, k: int) -> DataFrame:
    """(item, doc_id, score): for each item of a block the best of each task.

    A task visits the pieces of a batch, per item, by falling bound: the item's
    score if a document had each of its terms as often as any of the piece. It
    stops where the bound is below the last of the best found so far.
    """
    known = sorted({t for r in items for t in map(bytes, r["terms"])})
    number = {t: i for i, t in enumerate(known)}
    df = _frequencies(index, known)
    weight = np.floor(1000 * np.log((2 * index.documents + 2) / (2 * df + 1))).astype(np.int64)
    sought = [(r["item"], np.array([number[bytes(t)] for t in r["terms"]], np.int64), np.array(r["times"], np.int64)) for r in items]
    kind = dict(index.pieces.dtypes)["docs"][len("array<"):-1]

    def search(batches):
        terms, best = pa.array(known, pa.binary()), [_Best(k) for _ in sought]
        for batch in batches:
            pieces = [_Piece({"m": batch.column("m")[r].as_py(), **{
                c: batch.column(c)[r].values if c in ("docs", "terms") else batch.column(c)[r].values.to_numpy()
                for c in ("docs", "terms", "runs", "tf", "length", "posting")}}, terms, weight) for r in range(batch.num_rows)]
            # A term that a piece does not have adds the zero at the end.
            most = np.stack([np.append(p.most, 0)[p.local] for p in pieces])
            for (_, own, times), top in zip(sought, best):
                bounds = most[:, own] @ times
                for p in np.argsort(-bounds, kind="stable").tolist():
                    if bounds[p] < top.least:
                        break
                    top.add(pieces[p].scores(own, times, int(bounds[p])), pieces[p].docs)
        rows = [(item, doc, -score) for (item, _, _), top in zip(sought, best) for score, doc in top.rows]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, doc_type(batch)), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    def doc_type(batch: pa.RecordBatch) -> pa.DataType:
        return batch.column("docs").type.value_type

    return index.pieces.drop("df").mapInArrow(search, f"item long, doc_id {kind}, score long")


def search(documents: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, by whole numbers only.

    Terms are runs of ASCII letters and digits and of any characters beyond
    ASCII, A-Z as a-z. A document's normaliser m and a term's weight come from
    counts over all documents; a score sums weight * (10**9 tf div (1000 tf + 12 m))
    over the item's terms, repeats included, and must be above 0. Equal scores
    are ranked by ascending id, null last.

    A null or empty text has no terms: such a document is never found, such an
    item has no rows. Rows that repeat, or share an id, are documents (items)
    of their own. With no documents or items there are no rows; other columns
    are ignored. The index holds every document and does not depend on the
    items; these are taken in blocks of about ``BLOCK_BYTES``, each one pass over it.
    """
    steps = Steps(documents.sparkSession, "search")
    index = build_index(documents, steps, id_col=id_col, text_col=text_col)
    asked = steps.write("asked", term_counts(items, item_col, item_text_col).where("n > 0").withColumn("item", F.monotonically_increasing_id()))
    sized = asked.select("item", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 16).alias("bytes"))
    upto = running(sized, [], "item", {"upto": ("sum", "bytes")})
    blocks = steps.write("blocks", upto.select("item", F.expr(f"(upto - bytes) div {BLOCK_BYTES}").alias("block")))
    last = blocks.agg(F.max("block")).first()[0]
    documents.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    found = None
    for b in range(0 if last is None else last + 1):
        held = asked.join(blocks.where(F.col("block") == b), "item").select("item", "terms", "times").collect()
        if held:
            local = steps.write(f"found-{b}", _found(index, held, k))
            found = local if found is None else found.unionByName(local)
    if found is None:
        kind = dict(index.pieces.dtypes)["docs"][len("array<"):-1]
        found = documents.sparkSession.createDataFrame([], f"item long, doc_id {kind}, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    best = top_per_key(found, ["item"], order, k)
    steps.drop("index")
    return best.join(asked.select("item", F.col("id").alias("item_id")), "item").select("item_id", "rank", "doc_id", "score")
