"""Repeated runs of lines: whole, by windows of two lines, or by content-defined line chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.chunks import DIGEST_BYTES, clashing, digest, distinct_batch
from lakewright.llm.common import SPACE_BYTES, Steps, mixed, text_step
from lakewright.operators.windows import match

#: A chunk ends behind a line whose hash, rolled over this many lines, is divisible by ``CUT``.
ROLLED, CUT = 2, 3
LEAST_LINES, MOST_LINES = 2, 16
_STEP = 8 << 20
#: What tells rows apart.
_ROW = ["doc_id", "text_hash"]


def _lines(text: bytes) -> list[bytes]:
    """The lines of a text, each with its line feed."""
    parts = text.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + [p for p in parts[-1:] if p]


def line_chunks(text: bytes) -> list[tuple[int, int, int]]:
    """(begin, end, lines) of the chunks of a text: bytes, each line with its line feed.

    A cut depends on the ``ROLLED`` lines before it alone, so a line put in or
    taken out moves the cuts near it and no others. Every chunk has at least
    two lines, if the text has; a lone last line joins the chunk before it.
    """
    lines = _lines(text)
    if not lines:
        return []
    # The line feed is no part of a line's hash: the last line of a text may lack it.
    own = np.array([xxhash.xxh3_64_intdigest(p.removesuffix(b"\n")) for p in lines], np.uint64)
    rolled = own.copy()
    with np.errstate(over="ignore"):
        for k in range(1, min(ROLLED, len(own))):
            rolled[k:] += own[:-k] * np.uint64(2 * k + 1)
    cut = (mixed(rolled) % np.uint64(CUT) == 0).tolist()
    chunks, begin, at, n = [], 0, 0, 0
    for line, here in zip(lines, cut):
        at += len(line)
        n += 1
        if n >= MOST_LINES or (here and n >= LEAST_LINES):
            chunks.append((begin, at, n))
            begin, n = at, 0
    if n == 1 and chunks:
        first, _, before = chunks.pop()
        chunks.append((first, at, before + 1))
    elif n:
        chunks.append((begin, at, n))
    return chunks


def _bodies(text: bytes, chunks: list[tuple[int, int, int]]) -> list[bytes]:
    """What is compared: the chunk without the line feed at its end, which a text's end may lack."""
    return [text[a:b].removesuffix(b"\n") for a, b, _ in chunks]


def _occurrences(documents: DataFrame, digest_bytes: int, with_bytes: bool) -> DataFrame:
    """(doc_id, text_hash, begin, end, lines, digest[, chunk]) of every chunk of two lines or more that has a word."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, spans, bodies = [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            raw = (text or "").encode()
            chunks = line_chunks(raw)
            for span, body in zip(chunks, _bodies(raw, chunks)):
                if span[2] >= LEAST_LINES and body.strip():
                    rows.append(k)
                    spans.append(span)
                    bodies.append(body)
        found = {c: batch.column(c).take(pa.array(rows, pa.int64())) for c in _ROW}
        found |= {name: pa.array([s[k] for s in spans], pa.int64()) for k, name in enumerate(("begin", "end", "lines"))}
        found["digest"] = pa.array([digest(b, digest_bytes) for b in bodies], pa.binary())
        if with_bytes:
            found["chunk"] = pa.array(bodies, pa.binary())
        return pa.RecordBatch.from_pydict(found)

    kind = dict(documents.dtypes)["doc_id"]
    return text_step(documents, "text", work, f"doc_id {kind}, text_hash binary, begin long, end long, lines long, digest binary"
                     + ", chunk binary" * with_bytes, _STEP)


def _distinct(documents: DataFrame, digest_bytes: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            chunks = line_chunks(raw)
            bodies += [b for (_, _, n), b in zip(chunks, _bodies(raw, chunks)) if n >= LEAST_LINES and b.strip()]
        return distinct_batch([digest(b, digest_bytes) for b in bodies], bodies)

    return text_step(documents.select("text"), "text", work, "digest binary, chunk binary", _STEP)


def repeated_chunks(documents: DataFrame, *, digest_bytes: int = DIGEST_BYTES, steps: Steps) -> DataFrame:
    """(doc_id, text_hash, begin, end, lines) of every multi-line chunk that stands earlier too, of rows (doc_id, text_hash, text).

    Earlier: in a smaller id (null last), of rows with one id in the smaller
    hash of the text, or before it in the same document.
    Equal digests count as equal chunks after their bytes have been compared;
    where bytes differ, the bytes themselves take the digest's place.
    """
    found = steps.write("occurrences", _occurrences(documents, digest_bytes, False))
    clashes = steps.write("clashes", clashing(_distinct(documents, digest_bytes)))
    keys = ["digest"]
    if not clashes.isEmpty():
        whole = _occurrences(documents, digest_bytes, True).join(clashes, "digest", "left_semi")
        sure = found.join(clashes, "digest", "left_anti").withColumn("chunk", F.lit(None).cast("binary"))
        found = steps.write("checked", sure.unionByName(whole.select(*sure.columns)))
        keys = ["digest", "chunk"]
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), *_ROW, "begin")
    firsts = found.groupBy(*keys).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    later = match(found, firsts, keys).where(~place.eqNullSafe(F.col("_first")))
    return later.select(*_ROW, "begin", "end", "lines")


def without_repeated_lines(documents: DataFrame, *, digest_bytes: int = DIGEST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_removed_lines, n_removed_chunks, kept_sha256) of every row.

    ``text`` is what stays after removal of the multi-line chunks that stand
    earlier too, ``kept_sha256`` the hash of its UTF-8. Only runs of two lines
    or more go; a single repeated line stays. Null and empty texts have no line
    and stay empty. Rows are told apart by id and text, of rows with one id or
    without the hash of the text decides which is earlier; of rows with the same
    id and text one is the first. No rows give no rows; other columns are ignored.
    """
    source = _hashed(documents, id_col, text_col)
    steps = Steps(documents.sparkSession, "lines")
    gone = steps.write("gone", repeated_chunks(source, digest_bytes=digest_bytes, steps=steps).distinct()
                       .groupBy(*_ROW).agg(F.sort_array(F.collect_list(F.struct("begin", "end", "lines"))).alias("gone")))
    steps.drop("occurrences", "clashes")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, counts, removed, chunks = [], [], [], []
        for text, ranges, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "gone", "copy"))):
            raw, ranges = (text or "").encode(), ranges or []
            if copy:
                ranges = [dict(zip(("begin", "end", "lines"), c)) for c in line_chunks(raw) if c[2] >= LEAST_LINES and raw[c[0]:c[1]].strip()]
            ends = [0, *[r["end"] for r in ranges]]
            kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*[r["begin"] for r in ranges], len(raw)])))
            counts.append(raw.count(b"\n") + bool(raw and not raw.endswith(b"\n")))
            removed.append(sum(r["lines"] for r in ranges))
            chunks.append(len(ranges))
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "text": pa.array([k.decode() for k in kept]), "n_lines": pa.array(counts, pa.int64()),
            "n_removed_lines": pa.array(removed, pa.int64()), "n_removed_chunks": pa.array(chunks, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])})

    # Texts meet their ranges in the same way at every size: the ranges of a large corpus fit no broadcast.
    joined = match(_numbered_copies(source), gone.hint("merge"), _ROW, "left")
    kind = dict(source.dtypes)["doc_id"]
    return text_step(joined.select("doc_id", "text", "gone", "copy"), "text", work, f"doc_id {kind}, text string, n_lines long, n_removed_lines long, n_removed_chunks long, kept_sha256 string")


def _own(line: bytes, digest_bytes: int | None) -> bytes:
    return hashlib.sha256(line).digest() if digest_bytes is None else digest(line, digest_bytes)


def line_windows(text: bytes, mark: Callable[[bytes], bytes]) -> tuple[list[tuple[int, int, bytes]], dict[bytes, bytes]]:
    """(first, last, key) of the least runs of lines that have a word, and what every digest in the keys stands for.

    A run of lines that has a word is covered by its windows of two lines, one
    of them with a word; and, where blank lines follow each other, by the runs
    from the line with a word before them, or to the one behind them. So a line
    stands in a run that is repeated if and only if it stands in one of these
    that is. ``last`` is exclusive. A key is the digests of its lines; a stretch
    of blank lines enters it as a chain of digests, which stays linear.
    """
    lines = [p.removesuffix(b"\n") for p in _lines(text)]
    own = [mark(p) for p in lines]
    stands = dict(zip(lines, own))
    worded = [bool(p.strip(SPACE_BYTES)) for p in lines]
    found = [(k, k + 2, own[k] + own[k + 1]) for k in range(len(lines) - 1) if worded[k] or worded[k + 1]]
    if len(found) < len(lines) - 1:
        for sign, order in ((b"<", range(len(lines))), (b">", range(len(lines) - 1, -1, -1))):
            chain, origin, before = None, None, None
            for k in order:
                if worded[k]:
                    chain, origin = own[k], k
                elif chain is not None:
                    # No line holds a line feed, so no line is taken for a chain.
                    whole = b"\n" + sign + chain + own[k]
                    if before != origin:
                        found.append((min(origin, k), max(origin, k) + 1, whole))
                    chain = stands[whole] = mark(whole)
                before = k
    return found, stands


def _line_digests(documents: DataFrame, digest_bytes: int | None) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        stands: dict[bytes, bytes] = {}
        for text in batch.column("text").to_pylist():
            stands |= line_windows((text or "").encode(), lambda p: _own(p, digest_bytes))[1]
        return distinct_batch(list(stands.values()), list(stands))

    return text_step(documents.select("text"), "text", work, "digest binary, chunk binary", _STEP)


def _windows(documents: DataFrame, digest_bytes: int | None) -> DataFrame:
    """(doc_id, text_hash, begin, end, key) of every window, in lines."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            own = line_windows((text or "").encode(), lambda p: _own(p, digest_bytes))[0]
            rows += [k] * len(own)
            found += own
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(at), "text_hash": batch.column("text_hash").take(at),
            "begin": pa.array([f[0] for f in found], pa.int64()), "end": pa.array([f[1] for f in found], pa.int64()),
            "key": pa.array([f[2] for f in found], pa.binary())})

    kind = dict(documents.dtypes)["doc_id"]
    return text_step(documents, "text", work, f"doc_id {kind}, text_hash binary, begin long, end long, key binary", _STEP)


def _numbered_copies(source: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, text) with ``copy``, which counts rows of the same id and text from 0 on."""
    keys = _ROW
    if source.groupBy("doc_id").count().where("count > 1").isEmpty():
        return source.withColumn("copy", F.lit(0).cast("long"))
    several = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    alone = match(source, several.select(*keys), keys, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    # Equal rows meet once per task before the shuffle and are counted out again, so many of them are no hot key.
    held = match(source, several, keys).groupBy(*keys).agg(F.first("text").alias("text"), F.max("_n").alias("_n"))
    return alone.unionByName(held.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n"))


def _hashed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text): the id and half of the text's SHA-256 tell rows apart."""
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.withColumn("text_hash", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def without_repeated_runs(documents: DataFrame, *, digest_bytes: int = DIGEST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_removed_lines, n_removed_chunks, kept_sha256) of every row.

    Every line goes that stands in a run of two lines or more, one of them with
    a word, that also starts earlier in the input: in a document with a smaller
    id (null last), or before in the same document. Overlaps count, so of a line
    that is repeated at once the first stays. No run is missed, wherever it
    begins and ends. The line feed of a text's last line may lack. ``text`` is
    what stays, ``kept_sha256`` the hash of its UTF-8, and ``n_removed_chunks``
    counts the maximal runs removed. Null and empty texts have no line and stay
    empty.

    Rows are told apart by id and text: of rows with one id, or without, the
    hash of the text decides which is earlier. Of rows with the same id and text
    one is the first, and the others are copies of it. Lines are equal if their
    digests are, after the bytes have been compared; should a digest stand for
    different bytes, all are taken again by SHA-256 and compared again. No rows
    give no rows; other columns are ignored.
    """
    source = _hashed(documents, id_col, text_col)
    steps = Steps(documents.sparkSession, "runs")
    width: int | None = digest_bytes
    if not steps.write("clashes", clashing(_line_digests(source, width))).isEmpty():
        width = None
        if not steps.write("clashes-again", clashing(_line_digests(source, width))).isEmpty():
            raise ValueError("different lines have one SHA-256")
    found = steps.write("windows", _windows(source, width))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "begin")
    firsts = found.groupBy("key").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    later = match(found, firsts, ["key"]).where(~place.eqNullSafe(F.col("_first")))
    gone = steps.write("gone", later.select("doc_id", "text_hash", "begin", "end").distinct().groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("gone")))
    steps.drop(*[s for s in list(steps.paths) if s != "gone"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, counts, removed, runs = [], [], [], []
        for text, ranges, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "gone", "copy"))):
            lines, parts, at, n, gone_ = _lines((text or "").encode()), [], 0, 0, 0
            if copy and len(lines) > 1 and text.encode().strip(SPACE_BYTES):
                ranges = [{"begin": 0, "end": len(lines)}]
            for r in ranges or []:
                if r["begin"] > at or not n:
                    parts += lines[at:r["begin"]]
                    n += 1
                    at = r["begin"]
                gone_ += max(0, r["end"] - at)
                at = max(at, r["end"])
            kept.append(b"".join([*parts, *lines[at:]]))
            counts.append(len(lines))
            removed.append(gone_)
            runs.append(n)
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "text": pa.array([k.decode() for k in kept], pa.string()), "n_lines": pa.array(counts, pa.int64()),
            "n_removed_lines": pa.array(removed, pa.int64()), "n_removed_chunks": pa.array(runs, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])})

    joined = match(_numbered_copies(source), gone.hint("merge"), ["doc_id", "text_hash"], "left")
    kind = dict(source.dtypes)["doc_id"]
    return text_step(joined.select("doc_id", "text", "gone", "copy"), "text", work,
                     f"doc_id {kind}, text string, n_lines long, n_removed_lines long, n_removed_chunks long, kept_sha256 string")
