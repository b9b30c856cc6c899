"""Sampled segmentations of texts into sentencepiece pieces, and back without loss.

A text is a path through the lattice of pieces that match it. Forward filtering
sums the weights of all paths to every position, backward sampling draws a path
from its end, each step in proportion to the weight of all paths through it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import WIDE_STEP_BYTES, mixed, process_store, span_hashes, text_step
from lakewright.llm.pieces import SPACE, Pieces, cut_parts, load_pieces, tokenizer_path

#: Parts up to this length share their filtered positions; longer ones are sampled on their own.
KEPT_LENGTH = 50
#: Filtered positions held by a process; beyond, it starts anew.
KEPT_POSITIONS = 2_500_000
#: A blank mark that a text itself contains; no text in UTF-8 contains this code point.
_LITERAL = "\udc81"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE, _CHAR = 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25
#: Sums below the first are lifted by the second. Within the longest piece this happens three times at most.
_TINY, _HUGE = 1e-100, 1e100


class Lattice:
    """Filtered positions of text parts under one model and temperature.

    The weight of a piece is (rank + 2) ** -power: rank models store no
    probabilities, and piece frequencies fall about as their ranks rise. A
    character without a piece is spelled in byte pieces. Positions of parts
    with a common beginning are shared, as sums go from left to right.
    """

    def __init__(self, pieces: Pieces, power: float):
        if not 0 <= power <= 1:
            raise ValueError("power must lie between 0 and 1")
        self.pieces = pieces
        worst = -min([s for s in pieces.score if s > -1e8], default=0.0)
        self.weight = [(-s + 2) ** -power for s in pieces.score]
        self.byte_weight = (worst + 2) ** -power
        self.longest = max(len(p) for p in pieces.text if p)
        # Pieces and their tails by a polynomial hash of their characters.
        known = sorted((self._hash(t), i) for t, i in pieces.ids.items())
        self.keys = np.array([h for h, _ in known], np.uint64)
        self.values = np.array([i for _, i in known], np.int64)
        self.weights = np.array(self.weight)
        spelled = {i: p.replace(SPACE, " ").encode() for i, p in enumerate(pieces.text) if p is not None}
        self.bytes = {**spelled, **{i: bytes([b]) for i, b in pieces.byte_of.items()}}
        self.clear()

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _BASE + (ord(c) + 1) * _CHAR) % (1 << 64)
        return h

    def clear(self) -> None:
        self.end_of: dict[int, int] = {}  # by the hash of the part
        # Position 0 is the beginning of every part. Edges of position p: first[p] to first[p + 1].
        self.positions, self.links = 1, 0
        self.first = np.zeros(1 << 16, np.int64)
        self.depth = np.zeros(1 << 16, np.int32)
        self.share = np.zeros(1 << 17, np.float32)
        self.piece = np.zeros(1 << 17, np.int32)
        self.back = np.zeros(1 << 17, np.int32)

    def _room(self, positions: int, links: int) -> None:
        for name, need in (("first", positions + 1), ("depth", positions), ("share", links), ("piece", links), ("back", links)):
            held = getattr(self, name)
            if need > len(held):
                wider = np.zeros(max(need, len(held) * 3 // 2), held.dtype)
                wider[:len(held)] = held
                setattr(self, name, wider)

    def edges(self, part: str, end: int, alpha: list[float]) -> tuple[list[float], list[int], list[int]]:
        """Running weights, pieces and beginnings of the pieces that end at ``end``, shortest first."""
        ids, weight = self.pieces.ids, self.weight
        start = end - 1
        piece = ids.get(part[start:end])
        total, sums, names, starts = 0.0, [], [], []
        if piece is None or piece < 0:
            raw = self.spelling(part[start])
            total = alpha[start] * self.byte_weight ** len(raw)
            # One byte is a piece; several stand for their character until they are written out.
            sums, names, starts = [total], [self.pieces.byte_id[raw[0]] if len(raw) == 1 else self.pieces.size + ord(part[start])], [start]
        while piece is not None:
            if piece >= 0:
                total += alpha[start] * weight[piece]
                sums.append(total)
                names.append(piece)
                starts.append(start)
            start -= 1
            piece = ids.get(part[start:end]) if start >= 0 else None
        return sums, names, starts

    @staticmethod
    def spelling(char: str) -> bytes:
        return SPACE.encode() if char == _LITERAL else char.encode()

    def rescale(self, alpha: list[float], end: int) -> bool:
        """Only ratios within the longest piece matter, so tiny sums are lifted together."""
        if alpha[end] >= _TINY:
            return False
        for k in range(max(0, end - self.longest), end + 1):
            alpha[k] *= _HUGE
        return True

    def learn(self, parts: list[str], hashes: list[int]) -> None:
        """Filter short parts that are new."""
        new = sorted(zip(parts, hashes))
        for some in ([p for p in new if len(p[0]) <= 18], [p for p in new if len(p[0]) > 18]):
            if some:
                self._filter([p for p, _ in some], [h for _, h in some])

    def _filter(self, parts: list[str], hashes: list[int]) -> None:
        """Forward filtering of sorted parts, all at once.

        Each part goes on where it leaves the one before: ``node`` holds the
        position of every prefix, new ones numbered on. Pieces that end at a new
        position are looked up by the hash of its last characters, one
        character more each time, for those positions where a piece can go on.
        """
        n, width = len(parts), max(map(len, parts))
        sizes = np.fromiter(map(len, parts), np.int64, n)
        chars = np.frombuffer("".join(p.ljust(width) for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width).astype(np.int64)
        inside = np.arange(width) < sizes[:, None]
        chars[~inside] = -1
        shared = np.zeros(n, np.int64)
        shared[1:] = (chars[1:] != chars[:-1]).argmax(axis=1)
        row, col = np.nonzero(inside & (np.arange(width) >= shared[:, None]))
        # Local numbers: 0 is the beginning, the new positions follow.
        node = np.zeros((n, width + 1), np.int64)
        node[row, col + 1] = np.arange(1, len(row) + 1)
        np.maximum.accumulate(node, axis=0, out=node)
        hashed = np.zeros((n, width + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                hashed[:, k + 1] = hashed[:, k] * np.uint64(_BASE) + (chars[:, k] + 1).astype(np.uint64) * np.uint64(_CHAR)
            own, names, backs, gains = [], [], [], []
            live, power = np.arange(len(row)), np.uint64(1)
            for length in range(1, self.longest + 1):
                live = live[col[live] + 1 >= length]
                if not len(live):
                    break
                power = power * np.uint64(_BASE)
                r, end = row[live], col[live] + 1
                key = hashed[r, end] - hashed[r, end - length] * power
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                piece = np.where(found, self.values[at], -1)
                hit = piece >= 0
                if length == 1 and not hit.all():
                    point = chars[r[~hit], end[~hit] - 1]
                    count = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
                    own.append(live[~hit] + 1)
                    names.append(np.where(count == 1, np.array(self.pieces.byte_id)[np.minimum(point, 127)], self.pieces.size + point))
                    backs.append(node[r[~hit], end[~hit] - 1])
                    gains.append(self.byte_weight ** count)
                own.append(live[hit] + 1)
                names.append(piece[hit])
                backs.append(node[r[hit], end[hit] - length])
                gains.append(self.weights[piece[hit]])
                live = live[found]
        own, names, backs, gains = (np.concatenate(x) for x in (own, names, backs, gains))
        order = np.argsort(own, kind="stable")
        own, names, backs, gains = own[order], names[order], backs[order], gains[order]
        stops = np.cumsum(np.bincount(own, minlength=len(row) + 1))
        # Sums in the order of depth, as a position needs those of its prefixes.
        alpha = np.zeros(len(row) + 1)
        alpha[0] = 1
        depth = np.concatenate([[0], col + 1])
        by_depth = np.argsort(depth[own], kind="stable")
        bounds = np.searchsorted(depth[own][by_depth], np.arange(1, width + 2))
        flow = np.empty(len(own))
        for a, b in zip(bounds[:-1], bounds[1:]):
            edges = by_depth[a:b]
            flow[edges] = alpha[backs[edges]] * gains[edges]
            ends, first = np.unique(own[edges], return_index=True)
            alpha[ends] = np.add.reduceat(flow[edges], first)
        # Shares are added up edge by edge, so that they do not depend on what else is filtered.
        share, sums = np.empty(len(own), np.float32), np.zeros(len(row))
        degree, begin = np.diff(stops), stops[:-1]
        held = np.arange(len(row))
        for k in range(int(degree.max(initial=0))):
            held = held[degree[held] > k]
            sums[held] += flow[begin[held] + k]
            share[begin[held] + k] = sums[held] / np.maximum(alpha[held + 1], 1e-300)
        share[stops[1:] - 1] = 2  # a draw never runs past the last edge
        start, links = self.positions - 1, self.links
        self._room(self.positions + len(row), links + len(own))
        self.depth[self.positions:self.positions + len(row)] = depth[1:]
        self.first[self.positions:self.positions + len(row)] = links + stops[:-1]
        self.first[self.positions + len(row)] = links + len(own)
        self.share[links:links + len(own)] = share
        self.piece[links:links + len(own)] = names
        self.back[links:links + len(own)] = np.where(backs > 0, backs + start, 0)
        self.positions, self.links = self.positions + len(row), links + len(own)
        last = node[np.arange(n), sizes]
        # Sums too small for a double: such a part is sampled on its own.
        tiny = np.zeros(len(row) + 1, bool)
        tiny[1:] = alpha[1:] < _TINY ** 2
        self.end_of.update(zip(hashes, np.where(tiny[last], 0, last + start).tolist()))

    def sample_long(self, part: str, seed: int, offset: int) -> list[int]:
        """One part on its own: the sums are kept, the edges found again on the way back."""
        alpha, level = [1.0] + [0.0] * len(part), [0] * (len(part) + 1)
        for end in range(1, len(part) + 1):
            low = max(0, end - self.longest)
            alpha[end] = self.edges(part[low:end], end - low, alpha[low:end])[0][-1]
            level[end] = level[end - 1]
            if self.rescale(alpha, end):
                level[low:end + 1] = [level[end] + 1] * (end + 1 - low)
        names, end = [], len(part)
        while end:
            low = max(0, end - self.longest)
            window = [alpha[k] * _HUGE ** (level[end - 1] - level[k]) for k in range(low, end)]
            sums, found, starts = self.edges(part[low:end], end - low, window)
            u = np.float32(uniform(np.array([seed], np.uint64), np.array([offset + end]))[0])
            k = next((k for k, s in enumerate(sums[:-1]) if np.float32(s / sums[-1]) > u), len(sums) - 1)
            names.append(found[k])
            end = low + starts[k]
        return names

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text, given its seed."""
        marked = [SPACE + t.replace(SPACE, _LITERAL).replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        begin, per_text = cut_parts(whole, np.fromiter(map(len, marked), np.int64, len(marked)), self.pieces)
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.append(begin[1:], len(whole))
        sizes = stops - begin
        text = np.repeat(np.arange(len(texts)), per_text)
        offset = begin - np.append(begin, len(whole))[np.cumsum(per_text) - per_text][text]
        if self.positions > KEPT_POSITIONS:
            self.clear()
        hashes, first, which = np.unique(span_hashes(chars, begin, stops), return_index=True, return_inverse=True)
        listed, short = hashes.tolist(), sizes[first] <= KEPT_LENGTH
        new = [k for k in np.flatnonzero(short).tolist() if listed[k] not in self.end_of]
        self.learn([whole[begin[first[k]]:stops[first[k]]] for k in new], [listed[k] for k in new])
        state = np.array([self.end_of.get(h, 0) for h in listed], np.int64)[which] if listed else np.zeros(0, np.int64)
        live, long = np.flatnonzero(state), np.flatnonzero(state == 0)
        taken = []
        count = np.zeros(len(begin), np.int64)
        longer = {int(k): self.sample_long(whole[begin[k]:stops[k]], int(seeds[text[k]]), int(offset[k])) for k in long}
        for k, names in longer.items():
            count[k] = len(names)
            taken.append((np.full(len(names), k), np.array(names), np.arange(len(names))))
        step = 0
        now = state[live]
        while len(live):
            u = uniform(seeds[text[live]], offset[live] + self.depth[now]).astype(np.float32)
            edge = self.first[now]
            late = np.flatnonzero(self.share[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[self.share[edge[late]] <= u[late]]
            taken.append((live, self.piece[edge], np.full(len(live), step)))
            now = self.back[edge].astype(np.int64)
            count[live] += 1
            live, now = live[now > 0], now[now > 0]
            step += 1
        stop = np.cumsum(count)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64)
        for where, names, steps in taken:
            out[stop[where] - 1 - steps] = names
        ends = np.concatenate([[0], stop])[np.cumsum(per_text)]
        return [self.written(x) for x in np.split(out, ends[:-1])] if texts else []

    def written(self, names: np.ndarray) -> np.ndarray:
        """Characters without a piece become their byte pieces."""
        if not len(names) or names.max() < self.pieces.size:
            return names.astype(np.int32)
        out = []
        for x in names.tolist():
            out += [x] if x < self.pieces.size else [self.pieces.byte_id[b] for b in self.spelling(chr(x - self.pieces.size))]
        return np.array(out, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the text; the blank put in front of every text goes."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


def uniform(seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on seed and place alone."""
    with np.errstate(over="ignore"):
        return (mixed(seeds ^ (places.astype(np.uint64) * _ODD)) >> np.uint64(11)) / float(1 << 53)


def _lattice(path: str, power: float) -> Lattice:
    store = process_store()
    key = ("lattice", path, power)
    if key not in store:
        store[key] = Lattice(load_pieces(path, store), power)
    return store[key]


def _seeds(keys: list, seed: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{k!r}".encode(), digest_size=8).digest(), "little") for k in keys], np.uint64)


def _encoded(lattice: Lattice, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
    """Sampled ids of each text; they decode to it, or it is sampled part by part without hashes."""
    found = lattice.sample(texts, seeds)
    for k, (ids, text) in enumerate(zip(found, texts)):
        if lattice.decode(ids.tolist()) != text.encode():
            marked = SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)
            found[k] = lattice.written(np.array(lattice.sample_long(marked, int(seeds[k]), 0)[::-1], np.int64))
    return found


def encode(documents: DataFrame, *, seed: str = "pieces", power: float = 1.0, model: str | None = None,
           id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, carried columns, ids, n_pieces, lossless): a sampled segmentation of each whole text.

    The draw depends on seed, id and text, not on how rows are spread; rows with
    the same id and text get the same segmentation. ``power`` sharpens the
    weights. ``lossless`` tells that the ids decode to the text byte by byte.
    Null and empty texts have no pieces. One row per input row, null ids kept;
    columns not in ``carry`` are ignored.
    """
    path = model or tokenizer_path()
    carried = [f"_c{k}" for k in range(len(carry or []))]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lattice = _lattice(path, power)
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        ids = _encoded(lattice, texts, _seeds(batch.column("_id").to_pylist(), seed))
        found = {c: batch.column(c) for c in ["_id", *carried]}
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()),
                                         pa.array(np.concatenate(ids) if ids else [], pa.int32()))
        found |= {"ids": lists, "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                  "lossless": pa.array([lattice.decode(x.tolist()) == t.encode() for x, t in zip(ids, texts)])}
        return pa.RecordBatch.from_pydict(found)

    source = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
                              *[F.col(c).alias(a) for a, c in zip(carried, carry or [])])
    kinds = dict(source.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ["_id", *carried]] + ["ids array<int>, n_pieces long, lossless boolean"])
    return text_step(source, "_text", work, schema, WIDE_STEP_BYTES).select(
        F.col("_id").alias("doc_id"), *[F.col(a).alias(c) for a, c in zip(carried, carry or [])], "ids", "n_pieces", "lossless")


def decode(encoded: DataFrame, *, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from piece ids; null or no ids give an empty text."""
    path = model or tokenizer_path()

    def work(batches):
        lattice = _lattice(path, 1.0)
        for batch in batches:
            texts = [lattice.decode(ids or []).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    source = encoded.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids")
    return source.mapInArrow(work, f"doc_id {dict(source.dtypes)['doc_id']}, text string")


def digests(documents: DataFrame, *, seed: str = "pieces", power: float = 1.0, model: str | None = None,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_sha256, lossless): ``encode`` with a hash in place of the ids.

    ``ids_sha256`` hashes the ids as little-endian 32-bit numbers.
    """
    path = model or tokenizer_path()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lattice = _lattice(path, power)
        raw = [t or "" for t in batch.column("text").to_pylist()]
        ids = _encoded(lattice, raw, _seeds(batch.column("doc_id").to_pylist(), seed))
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in raw], pa.int64()),
            "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
            "lossless": pa.array([lattice.decode(x.tolist()) == t.encode() for x, t in zip(ids, raw)])})

    source = documents.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    kind = dict(source.dtypes)["doc_id"]
    return text_step(source, "text", work, f"doc_id {kind}, n_bytes long, n_pieces long, ids_sha256 string, lossless boolean",
                     WIDE_STEP_BYTES)
