"""Personal data by patterns, and terms that reveal it by what they stand beside in the corpus."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import _BATCH, BATCH_BYTES, Steps, lowered, mixed, span_hashes, step_ranges, text_step, utf8
from lakewright.operators.windows import match

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. The local part of an email is taken from its @ to the left, which finds the same matches.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # no match begins inside a run of digits
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Terms on each side of a mention that count as beside it.
REACH = 8
#: Different surroundings in which a term must stand beside an entity before it can reveal it.
LEAST_SUPPORT = 3
#: Share of an entity's information that a term may give away.
MOST_DISCLOSED = 0.9
#: Bytes of the shortest run of letters that is a long term.
LEAST_TERM = 4
#: Long and short runs of letters, and runs of letters and digits with a digit; of each kind REACH terms a side count.
LONG, EVERY = ("long",), ("long", "short", "mixed")
#: Revealing terms that are sent to every task; with more of them occurrences are joined to terms instead.
SENT_TERMS = 200_000
#: Bits of the table that tells which terms cannot be candidates: 16 for each of them, within these bounds (16 MB).
_FILTER_BITS = 1 << 20, 1 << 27
#: Different terms that a task counts before it gives counts out.
HELD_TERMS = 1 << 21


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def mentions(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def _entity(kind: str, text: str) -> int:
    """One number for an entity however it is written."""
    value = text.lower() if kind == "email" else _NOT_DIGIT.sub("." if kind == "ip" else "", text)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray, kind: str = "long") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte, hash and row of every term of a kind: a run of ASCII letters and non-ASCII characters, A-Z as a-z.

    Long terms have ``LEAST_TERM`` bytes or more, short ones fewer; mixed ones are runs with digits and at least one digit.
    """
    inside = _LETTER[data]
    if kind == "mixed":
        digit = (data >= 48) & (data <= 57)
        inside |= digit
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    cut = edges[inside[edges] & inside[edges - 1]]
    first[cut] = True
    last[cut - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if kind == "mixed":
        total = np.concatenate([[0], np.cumsum(digit)])
        chosen = total[ends] > total[starts]
    else:
        chosen = (ends - starts >= LEAST_TERM) == (kind == "long")
    starts, ends = starts[chosen], ends[chosen]
    hashes = span_hashes(lowered(data), starts, ends).view(np.int64)
    return starts, ends, hashes, np.searchsorted(offsets, starts, side="right") - 1


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def _merged(found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of a text that spans cover, in order and apart."""
    out: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in found):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    both = np.array(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _outside(covered: tuple[np.ndarray, np.ndarray], begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which ranges have no place in common with covered ones."""
    starts, ends = covered
    if not len(starts):
        return np.ones(len(begin), bool)
    last = np.searchsorted(starts, stop, side="left") - 1
    return (last < 0) | (ends[np.maximum(last, 0)] <= begin)


class _Filter:
    """A table of bounded size, sent to every task, that tells which terms cannot be among some terms."""

    def __init__(self, spark, found: DataFrame):
        n = found.count()
        self.bits = bits = min(max(1 << (16 * max(n, 1)).bit_length(), _FILTER_BITS[0]), _FILTER_BITS[1])

        def used(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"bit": pa.array(np.unique(_bit(batch.column(0).to_numpy(), bits)) + 1, pa.int64())})

        # The table comes to the driver packed, however many terms there are.
        packed = found.mapInArrow(used, "bit long").select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place"))
        table = np.zeros(bits, bool)
        for bucket, held in packed.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).collect():
            ones = np.unpackbits(np.frombuffer(bytes(held), np.uint8), bitorder="little")
            table[(bucket - 1) * len(ones) + np.flatnonzero(ones)] = True
        self.table = spark.sparkContext.broadcast(np.packbits(table))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = _bit(hashes, self.bits)
        return (self.table.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(hashes.view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _neighbourhoods(documents: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(entity, term, place, n) for every term beside a mention; ``place`` is a hash of all terms around the mention.

    An occurrence of a term counts once per entity, at the first mention that it
    stands beside, so ``n`` is 0 at others; rows without entity count
    occurrences beside any. Terms that share a byte with a mention are beside none.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = [mentions(t) for t in texts]
        rows = [k for k, f in enumerate(found) if f]
        if not rows:
            return None
        data, offsets = utf8(batch.column("text").take(pa.array(rows)))
        points = _points(data)
        listed = []
        for starts, ends, hashes, row in (terms(data, offsets, kind) for kind in kinds):
            listed.append((points[starts], points[ends], hashes, np.searchsorted(row, np.arange(len(rows) + 1)).tolist()))
        out: list[list] = [[], [], [], []]
        for n, k in enumerate(rows):
            base = points[offsets[n]]
            covered, around = _merged(found[k]), []
            for begin, stop, hashes, first in listed:
                own = slice(first[n], first[n + 1])
                free = _outside(covered, begin[own] - base, stop[own] - base)
                around.append((begin[own][free] - base, stop[own][free] - base, hashes[own][free]))
            counted: dict[int | None, set] = {None: set()}
            for kind, a, b in found[k]:
                near, names = [], []
                for of, (begin, stop, hashes) in enumerate(around):
                    i, j = np.searchsorted(stop, a, side="right"), np.searchsorted(begin, b, side="left")
                    at = [*range(max(0, i - REACH), i), *range(j, min(len(begin), j + REACH))]
                    near += [(of, x) for x in at]
                    names += hashes[at].tolist()
                place = int.from_bytes(hashlib.blake2b(np.array(names, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)
                entity = _entity(kind, texts[k][a:b])
                for who, where in ((entity, place), (None, None)):
                    seen = counted.setdefault(who, set())
                    fresh = [x not in seen for x in near]
                    seen.update(near)
                    out[0] += [who] * len(near)
                    out[1] += names
                    out[2] += [where] * len(near)
                    out[3] += fresh
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("entity", "term", "place"), out)} | {
            "n": pa.array(np.array(out[3], np.int64))})

    return text_step(documents.select("text"), "text", work, "entity long, term long, place long, n long")


def _term_counts(documents: DataFrame, kinds: tuple[str, ...], wanted: _Filter) -> DataFrame:
    """(term, n): occurrences of terms that may be wanted; without term, of all. A task adds up before it gives out."""
    documents.sparkSession.conf.set(_BATCH, BATCH_BYTES)

    def run(batches):
        total, keys, n, held, size = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def added():
            every = np.concatenate([keys, *[h for h, _ in held]])
            found, place = np.unique(every, return_inverse=True)
            return found, np.bincount(place, np.concatenate([n, *[m for _, m in held]]), len(found)).astype(np.int64)

        for batch in batches:
            text = batch.column("text")
            for a, b in step_ranges(np.diff(utf8(text)[1])):
                step = utf8(text.slice(a, b - a))
                hashes = np.concatenate([terms(*step, kind)[2] for kind in kinds])
                total += len(hashes)
                held.append(np.unique(hashes[wanted.may_hold(hashes)], return_counts=True))
                size += len(held[-1][0])
                if size > HELD_TERMS:
                    (keys, n), held, size = added(), [], 0
                    if len(keys) > HELD_TERMS:
                        yield pa.RecordBatch.from_pydict({"term": pa.array(keys), "n": pa.array(n)})
                        keys, n = keys[:0], n[:0]
        keys, n = added()
        yield pa.RecordBatch.from_pydict({"term": pa.array([None, *keys.tolist()], pa.int64()), "n": pa.array([total, *n.tolist()], pa.int64())})

    return documents.select("text").mapInArrow(run, "term long, n long")


def revealing_terms(documents: DataFrame, *, support: int = LEAST_SUPPORT, most: float = MOST_DISCLOSED, text_col: str = "text",
                    steps: Steps | None = None, kinds: tuple[str, ...] = LONG) -> DataFrame:
    """(entity, term, disclosure) of terms that reveal an entity, from the whole corpus.

    Probabilities are shares of term occurrences. An entity's information is
    -log2 of the share that stands beside it. A term discloses the pointwise
    mutual information of the two, as a share of the entity's information:
    1 - log2(P(entity | term)) / log2(P(entity)), which is 1 at most, as an
    occurrence counts once per entity. Terms seen beside the entity
    in fewer than ``support`` different surroundings show no association, so
    copies of one document do not make their words revealing.

    An occurrence beside any entity is an occurrence, and a corpus has fewer
    terms than bytes, so both bound the disclosure before the corpus is
    counted: only terms that can reach ``most`` are counted in it.
    """
    spark = documents.sparkSession
    steps = steps or Steps(spark, "private")
    source = documents.selectExpr(f"cast(`{text_col}` as string) as text").where("text is not null")
    places = steps.write("places", _neighbourhoods(source, kinds).groupBy("entity", "term", "place").agg(F.sum("n").alias("n")))
    near = places.where("entity is null").groupBy("term").agg(F.sum("n").alias("near"))
    pairs = places.where("entity is not null").groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("places"))
    beside = pairs.groupBy("entity").agg(F.sum("both").alias("beside"))
    octets = float(max(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 1))
    # The disclosure if the corpus had as many terms as bytes and no further occurrence of the term.
    least_prior = F.log2(F.col("beside") / octets)
    reachable = F.log2(F.col("both") / F.col("near")) >= (1 - most) * least_prior - 1e-9
    likely = steps.write("likely", pairs.where(F.col("places") >= support).join(beside, "entity").join(near, "term").where(reachable))
    wanted = _Filter(spark, steps.write("wanted", likely.select("term").distinct()))
    counts = steps.write("counts", _term_counts(source, kinds, wanted).groupBy("term").agg(F.sum("n").alias("n")))
    total = counts.where("term is null").agg(F.sum("n")).first()[0] or 0
    known = likely.join(counts.where("term is not null"), "term")
    # log2(P(entity)) is 0 where every term of the corpus stands beside the entity: nothing is left to disclose.
    prior = F.log2(F.col("beside") / F.lit(float(max(total, 1))))
    scored = known.withColumn("disclosure", F.when(prior < 0, 1 - F.log2(F.col("both") / F.col("n")) / prior).otherwise(0.0))
    return scored.where(F.col("disclosure") >= most).select("entity", "term", "disclosure")


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def private_spans(documents: DataFrame, *, support: int = LEAST_SUPPORT, most: float = MOST_DISCLOSED, id_col: str = "doc_id",
                  text_col: str = "text", sent_terms: int = SENT_TERMS, kinds: tuple[str, ...] = LONG) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) of every whole text.

    The base kinds come from their patterns, ``term`` spans are occurrences of
    revealing terms outside of base spans. ``spans`` lists kind:start:end by
    kind (terms last), then start, in code points with the end exclusive;
    ``base_sha256`` hashes that list of the base kinds. ``kinds`` tells what is
    a term: ``LONG`` runs of letters of 4 bytes or more, or ``EVERY`` run of
    letters and, besides, of letters and digits, whatever its length; a flagged
    run of letters inside a flagged one with digits is listed too. Null and empty texts
    have no spans. One row per input row, null ids and repeated rows included;
    no rows give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    steps = Steps(spark, "private")
    flagged = steps.write("flagged", revealing_terms(documents, support=support, most=most, text_col=text_col, steps=steps, kinds=kinds)
                          .select("term").distinct())
    steps.drop("places", "likely", "wanted", "counts")
    few = flagged.limit(sent_terms + 1).count() <= sent_terms
    if few:
        exact = spark.sparkContext.broadcast(np.sort(flagged.toPandas()["term"].to_numpy(np.int64)))
    else:
        rough = _Filter(spark, flagged)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = [mentions(t) for t in texts]
        hits: list[list] = [[] for _ in texts]
        if not few or len(exact.value):
            data, offsets = utf8(batch.column("text"))
            starts, ends, hashes, row = (np.concatenate(x) for x in zip(*(terms(data, offsets, kind) for kind in kinds)))
            if few:
                place = np.searchsorted(exact.value, hashes)
                hit = np.flatnonzero(exact.value[np.minimum(place, len(exact.value) - 1)] == hashes)
            else:
                hit = np.flatnonzero(rough.may_hold(hashes))
            points = _points(data)
            hit = hit[np.lexsort((ends[hit], starts[hit]))]
            base = points[offsets[row[hit]]]
            begin, stop = points[starts[hit]] - base, points[ends[hit]] - base
            first = np.searchsorted(row[hit], np.arange(len(texts) + 1))
            for r in np.flatnonzero(np.diff(first)).tolist():
                own = slice(first[r], first[r + 1])
                free = _outside(_merged(found[r]), begin[own], stop[own])
                hits[r] = [{"start": a, "end": b, "term": h} for a, b, h in zip(*(x[own][free].tolist() for x in (begin, stop, hashes[hit])))]
        spans = [_joined(f) for f in found]
        counts = {f"n_{k}": pa.array([sum(m[0] == k for m in f) for f in found], pa.int64()) for k in KINDS}
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), **counts,
            "base_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() for s in spans]), "base": pa.array(spans, pa.string()),
            "hits": pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.int64())])))})

    source = documents.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    kind = dict(source.dtypes)["doc_id"]
    schema = ", ".join([f"doc_id {kind}", *[f"n_{k} long" for k in KINDS], "base_sha256 string, base string, hits array<struct<start:long,end:long,term:long>>"])
    rows = text_step(source, "text", work, schema)
    if not few:
        rows = steps.write("rows", rows.withColumn("row", F.monotonically_increasing_id()))
        sure = (rows.select("row", F.explode("hits").alias("hit")).join(flagged, F.col("hit.term") == F.col("term"), "left_semi")
                .groupBy("row").agg(F.sort_array(F.collect_list("hit")).alias("hits")))
        rows = match(rows.drop("hits"), sure, ["row"], "left")
    listed = F.array_join(F.transform(F.coalesce("hits", F.array()), lambda h: F.concat_ws(
        ":", F.lit("term"), h["start"].cast("string"), h["end"].cast("string"))), ",")
    return rows.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_term"), "base_sha256",
        F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(listed, F.lit(""))).alias("spans"))


def sanitised(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text) with every span generalised to its kind in square brackets; null and empty texts are empty.

    Spans of different kinds that overlap become one, named after the first.
    Rows are joined to their spans by id and text, so rows that repeat an id
    each keep their own text.
    """
    key = F.sha2(F.coalesce(F.col("_text"), F.lit("")), 256)
    source = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_key", key)
    named = source.select(F.struct("_id", "_key").alias("doc"), "_text")
    spans = private_spans(named, id_col="doc", text_col="_text", **options).select("doc_id.*", "spans").distinct()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist()):
            text, at, parts = text or "", 0, []
            listed = [s.split(":") for s in spans.split(",") if s]
            for a, b, kind in sorted((int(a), int(b), kind) for kind, a, b in listed):
                if a >= at:
                    parts += [text[at:a], f"[{kind.upper()}]"]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("_id"), "text": pa.array(out, pa.string())})

    joined = match(source, spans, ["_id", "_key"])
    return text_step(joined.select("_id", "_text", "spans"), "_text", work, f"doc_id {dict(source.dtypes)['_id']}, text string")
