"""Exact token counts at every prefix of a text, by dynamic programming over merge-compatible pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakewright.llm.common import WIDE_STEP_BYTES, process_store, span_hashes, text_step, unequal
from lakewright.llm.pieces import SPACE, Pieces, cut_parts, load_pieces, tokenizer_path

#: The token counts of parts up to this length are kept.
KEPT_LENGTH = 60
#: Entries of one generation of kept part totals; two generations are held.
KEPT_PARTS = 500_000


class PrefixCounts:
    """Token counts of all prefixes of a part under byte-pair merging by rank.

    A segmentation is the one that merging produces exactly if every piece is
    produced from its own characters and every two neighbours stay apart when
    they are merged on their own: merges act on neighbours, and the order of
    merges within two neighbours does not depend on what stands around them.
    Hence the last piece of a prefix is the one piece ending there that is
    compatible with the last piece of the prefix before it, and
    count[end] = count[start] + 1.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.history: dict[int, tuple] = {}
        self.apart: dict[int, bool] = {}
        self.young: dict[str, int] = {}  # tokens of parts
        self.old: dict[str, int] = {}

    def _history(self, piece: int) -> tuple[bool, str, str, list[tuple[float, str, str]]]:
        """How merging makes a piece of its characters: best score first, leftmost among equals.

        Whether it ends in the one piece, the first and last character, and
        (score, first part, last part) after each merge.
        """
        known = self.history.get(piece)
        if known is None:
            ids, score = self.pieces.ids, self.pieces.score
            parts = list(self.pieces.text[piece])
            ends, merges = (parts[0], parts[-1]), []
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    i = ids.get(parts[k] + parts[k + 1], -1)
                    if i >= 0 and (best is None or score[i] > best):
                        best, at = score[i], k
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                merges.append((best, parts[0], parts[-1]))
            known = self.history[piece] = (len(parts) == 1, *ends, merges)
        return known

    def _fits(self, before: int, piece: int) -> bool:
        """Whether ``piece`` can follow ``before`` (or begin a part, if that is negative).

        The merges of both sides run side by side, the better score first, the
        left one among equals. They stay apart unless the parts that touch can
        be merged before the next merge of either side.
        """
        right = self._history(piece)
        if before < 0 or not right[0]:
            return right[0]
        left = self._history(before)
        ids, score = self.pieces.ids, self.pieces.score
        outer, inner = left[2], right[1]
        on_left, on_right = iter(left[3]), iter(right[3])
        none = (float("-inf"), "", "")
        a, b = next(on_left, none), next(on_right, none)
        while True:
            across = ids.get(outer + inner, -1)
            if across >= 0 and score[across] > a[0] and score[across] >= b[0]:
                return False
            if a is none and b is none:
                return True
            if a[0] >= b[0]:
                outer, a = a[2], next(on_left, none)
            else:
                inner, b = b[1], next(on_right, none)

    def _extend(self, part: str, begin: int, last: list[int], count: list[int]) -> None:
        """Fill last piece and count of the prefixes of ``part`` longer than ``begin``."""
        ids, apart = self.pieces.ids, self.apart
        for end in range(begin + 1, len(part) + 1):
            start = end - 1
            piece = ids.get(part[start:end], -1)
            if piece < 0 and not self._tail(part[start]):
                last[end], count[end] = -1, count[start] + len(part[start].encode())  # byte fallback; merges stop here
                continue
            while True:
                if piece >= 0:
                    before = last[start]
                    key = before * 0x1000000 + piece
                    fits = apart.get(key)
                    if fits is None:
                        fits = apart[key] = self._fits(before, piece)
                    if fits:
                        last[end], count[end] = piece, count[start] + 1
                        break
                start -= 1
                piece = ids.get(part[start:end]) if start >= 0 else None
                if piece is None:
                    raise ValueError(f"no segmentation of {part[:end]!r}")

    def prefixes(self, part: str) -> list[int]:
        """Counts of the prefixes of lengths 1 to len(part)."""
        last, count = [-1] * (len(part) + 1), [0] * (len(part) + 1)
        self._extend(part, 0, last, count)
        return count[1:]

    def _each(self, parts: list[str]) -> list[int]:
        """The token count of short parts in sorted order; each goes on where it leaves the one before."""
        last, count = [-1] * (KEPT_LENGTH + 1), [0] * (KEPT_LENGTH + 1)
        before, out = "", []
        for part in parts:
            shared = 0
            for x, y in zip(before, part):
                if x != y:
                    break
                shared += 1
            self._extend(part, shared, last, count)
            before = part
            out.append(count[len(part)])
        return out

    def _learned(self, parts: list[str]) -> list[int]:
        """The token count of parts."""
        young, old = self.young, self.old
        if len(young) >= KEPT_PARTS:
            old, young = self.old, self.young = young, {}
        new, found = [], []
        for k, part in enumerate(parts):
            n = young.get(part)
            if n is None:
                n = old.get(part)
                if n is None:
                    new.append(k)
                else:
                    young[part] = n
            found.append(n)
        texts = sorted((parts[k], k) for k in new)
        for (part, k), n in zip(texts, self._each([t for t, _ in texts])):
            found[k] = young[part] = n
        return found

    def _tail(self, char: str) -> bool:
        """Whether a character is a piece: pieces are built from pieces."""
        return self.pieces.ids.get(char, -1) >= 0

    def totals(self, texts: list[str]) -> list[int]:
        """The token count of each text. Equal parts are counted once per call: found by hash, then compared."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        begin, per_text = cut_parts(whole, np.fromiter(map(len, marked), np.int64, len(marked)), self.pieces)
        stops = np.append(begin[1:], len(whole))
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        hashes, first, which = np.unique(span_hashes(chars, begin, stops), return_index=True, return_inverse=True)
        sizes, others = stops - begin, begin[first][which] if len(first) else begin
        differs = sizes != sizes[first][which] if len(first) else np.zeros(0, bool)
        differs[~differs] = unequal(chars, begin[~differs], others[~differs], sizes[~differs])
        counts = np.zeros(len(hashes), np.int64)
        short = sizes[first] <= KEPT_LENGTH
        where = np.flatnonzero(short)
        counts[where] = self._learned([whole[a:b] for a, b in zip(begin[first[where]].tolist(), stops[first[where]].tolist())])
        for k in np.flatnonzero(~short):
            counts[k] = self.prefixes(whole[begin[first[k]]:stops[first[k]]])[-1]
        each = counts[which]
        for k in np.flatnonzero(differs):
            each[k] = self.prefixes(whole[begin[k]:stops[k]])[-1]
        upto = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(per_text)
        return (upto[ends] - upto[ends - per_text]).tolist()

    def total(self, text: str) -> int:
        return self.totals([text])[0]

    def parts(self, text: str) -> tuple[list[str], np.ndarray, list[list[int]]]:
        """The parts of a text, the token count of each, and the counts of their prefixes."""
        parts, known = self.pieces.chunks(text), {}
        rows = [known.get(p) or known.setdefault(p, self.prefixes(p)) for p in parts]
        return parts, np.array([r[-1] for r in rows], np.int64), rows

    def table(self, text: str) -> np.ndarray:
        """The token count of every prefix of ``text``, by number of characters from 0 on."""
        parts, totals, rows = self.parts(text)
        if not parts:
            return np.zeros(1, np.int64)
        base = np.cumsum(totals) - totals
        # Position 0 of the marked text is the blank that every text gets in front.
        counts = np.concatenate([b + np.array(r) for b, r in zip(base, rows)])
        counts[0] = 0
        return counts

    def cut(self, text: str, limit: int) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens."""
        parts, totals, rows = self.parts(text)
        ends = np.cumsum(totals)
        if not parts or ends[-1] <= limit:
            return len(text)
        # A prefix that ends inside a part has at least the tokens of the parts before it.
        at = int(np.searchsorted(ends, limit, side="right"))
        while at >= 0:
            base = int(ends[at] - totals[at])
            if base <= limit:
                fits = np.flatnonzero(np.array(rows[at]) + base <= limit)
                behind = sum(map(len, parts[:at]))
                if len(fits):
                    return max(0, behind + int(fits[-1]))
                if behind:
                    return behind - 1
            at -= 1
        return 0


def _counter(path: str) -> PrefixCounts:
    store = process_store()
    key = ("counts", path)
    if key not in store:
        store[key] = PrefixCounts(load_pieces(path, store))
    return store[key]


def token_counts(documents: DataFrame, *, limit: int = 4096, model: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_chars) of every text.

    ``n_tokens`` is what the library's encoder gives for the whole text, and
    ``cut_chars`` the length of the longest prefix with at most ``limit`` tokens.
    Null counts as empty: 0 bytes, 0 tokens. One row per input row, repeated
    rows included, null ids kept; no rows give no rows; other columns are ignored.
    """
    path = model or tokenizer_path()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counter(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        totals = counter.totals(texts)
        cuts = [len(t) if n <= limit else counter.cut(t, limit) for t, n in zip(texts, totals)]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
            "n_tokens": pa.array(totals, pa.int64()), "over_limit": pa.array([n > limit for n in totals], pa.bool_()),
            "cut_chars": pa.array(cuts, pa.int64())})

    source = documents.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    kind = dict(source.dtypes)["doc_id"]
    return text_step(source, "text", work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long",
                     WIDE_STEP_BYTES)


def prefix_tables(documents: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts): the token count of every prefix, element k + 1 for the first k characters.

    Answers budget questions without encoding again: ``element_at(counts, k + 1)``
    is the cost of the first k characters. Null and empty texts have the one count 0.
    """
    path = model or tokenizer_path()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counter(path)
        tables = [counter.table(t or "").astype(np.int32) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "counts": pa.array(tables, pa.list_(pa.int32()))})

    source = documents.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    return text_step(source, "text", work, f"doc_id {dict(source.dtypes)['doc_id']}, counts array<int>")
