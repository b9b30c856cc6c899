"""Quality rules: word counts of a document, and a conditional random field that labels its lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import _ODD, mixed, sample_by_hash, span_hashes, text_step, unequal, utf8, word_spans

#: Words of a window whose repetition within a text counts.
REPEAT_WORDS = 8
#: Fixed limits of the base rules: fewest words, and most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = b"#*$%&|<>"
#: The labelled sample that the field learns from: documents per quality, lines per document.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 1500, 64
#: Features of a line: shares of its code points or words, each split at these bounds into one-hot bins.
SHARE_BOUNDS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
SIZE_BOUNDS = (1, 2, 4, 8, 16, 32, 64, 128)
_SHARES = ("upper", "digits", "symbols", "marks", "repeated")
N_FEATURES = 1 + len(_SHARES) * (len(SHARE_BOUNDS) + 1) + 2 * (len(SIZE_BOUNDS) + 1) + 4


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _DIGIT, _UPPER = _members(SYMBOLS), _members(b"0123456789"), _members(bytes(range(65, 91)))
_MARK = _members(b"!?=_~^@/\\{}[]()+:;\"")
_END = _members(b".!?:;,\"')")


@dataclass
class Measured:
    """Counts of the rows of a step, and features of their lines that have a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_row: np.ndarray
    line_begin: np.ndarray
    line_end: np.ndarray
    line_words: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)


def _upto(mask: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def _later(keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which ranges equal an earlier one of their row: found by key, then compared by bytes."""
    order = np.argsort(keys, kind="stable")
    met = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    later, earlier = order[met + 1], order[met]
    found = np.zeros(len(keys), bool)
    found[later] = True
    wrong = (row[later] != row[earlier]) | (end[later] - begin[later] != end[earlier] - begin[earlier])
    wrong[~wrong] = unequal(data, begin[later[~wrong]], begin[earlier[~wrong]], (end - begin)[later[~wrong]])
    if wrong.any():
        # Different lines of one key: compare all lines as they are.
        seen: set[tuple[int, bytes]] = set()
        for k in range(len(keys)):
            line = int(row[k]), data[begin[k]:end[k]].tobytes()
            found[k] = line in seen
            seen.add(line)
    return found


def measure(texts: pa.Array) -> Measured:
    """Base counts of the texts and features of their lines; null counts as a text without words."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    starts, ends, first_word = word_spans(data, offsets)
    n_words = np.diff(first_word)
    row_of_word = np.repeat(np.arange(n), n_words)
    whole = (data & 0xC0) != 0x80
    points = _upto(whole)
    word_points = points[ends] - points[starts]
    word_chars = np.bincount(row_of_word, word_points, n).astype(np.int64)
    symbols = _upto(_SYMBOL[data])
    # Windows of words that occur twice in a text; a word is repeated if one of them covers it.
    covered = np.zeros(len(starts) + 1, np.int64)
    last = np.repeat(first_word[1:], n_words) - np.arange(len(starts))
    begin = np.flatnonzero(last >= REPEAT_WORDS)
    with np.errstate(over="ignore"):
        row_key = mixed(np.arange(n, dtype=np.uint64))
        if len(begin):
            words = span_hashes(data, starts, ends)
            key = row_key[row_of_word[begin]]
            for k in range(REPEAT_WORDS):
                key = (key ^ words[begin + k]) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(32)
            again = begin[_twice(key)]
            np.add.at(covered, again, 1)
            np.add.at(covered, again + REPEAT_WORDS, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    repeats = _upto(repeated)
    # Lines: between line feeds and row ends.
    feeds = np.flatnonzero(data == 10)
    row_of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    line_begin = np.concatenate([offsets[:-1], feeds + 1])
    line_end = np.concatenate([offsets[1:], feeds])
    line_row = np.concatenate([np.arange(n), row_of_feed])
    order = np.lexsort((line_begin, line_row))
    line_begin, line_row = line_begin[order], line_row[order]
    line_end = np.sort(line_end, kind="stable") if len(line_end) else line_end
    word_at = np.searchsorted(starts, line_begin), np.searchsorted(starts, line_end)
    used = word_at[1] > word_at[0]
    line_begin, line_end, line_row = line_begin[used], line_end[used], line_row[used]
    word_from, word_to = word_at[0][used], word_at[1][used]
    line_words = word_to - word_from
    with np.errstate(over="ignore"):
        line_key = span_hashes(data, line_begin, line_end) + row_key[line_row] * _ODD
    dup = _later(line_key, data, line_begin, line_end, line_row)
    # Features.
    chars = np.maximum(points[line_end] - points[line_begin], 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = _upto(mask)
        return (total[line_end] - total[line_begin]) / chars

    shares = [share(_UPPER[data]), share(_DIGIT[data]), (symbols[line_end] - symbols[line_begin]) / chars, share(_MARK[data]),
              (repeats[word_to] - repeats[word_from]) / np.maximum(line_words, 1)]
    lines = len(line_begin)
    features = np.zeros((lines, N_FEATURES), np.float32)
    features[:, 0] = 1
    at, every = 1, np.arange(lines)
    for values in shares:
        features[every, at + np.searchsorted(SHARE_BOUNDS, values, side="left")] = 1
        at += len(SHARE_BOUNDS) + 1
    for values in (line_words, chars / np.maximum(line_words, 1)):
        features[every, at + np.searchsorted(SIZE_BOUNDS, values, side="left")] = 1
        at += len(SIZE_BOUNDS) + 1
    if lines:
        final = data[ends[word_to - 1] - 1]
        features[:, at] = _END[final]
        features[:, at + 1] = _UPPER[data[starts[word_from]]]
        features[:, at + 2] = dup
        features[:, at + 3] = np.concatenate([[True], line_row[1:] != line_row[:-1]])
    return Measured(n_words, word_chars, symbols[offsets[1:]] - symbols[offsets[:-1]], np.bincount(line_row, dup, n).astype(np.int64),
                    np.bincount(row_of_word, repeated, n).astype(np.int64), line_row, line_begin, line_end, line_words, features)


@dataclass
class LineField:
    """A linear-chain field over two labels, 0 boilerplate and 1 content."""

    emit: np.ndarray  # (features, 2)
    move: np.ndarray  # (2, 2): from label, to label

    def label(self, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The best label sequence of each row's lines (Viterbi); content wins a tie.

        All rows go one line forward together; a row leaves when its lines end.
        """
        scores = (features @ self.emit).astype(np.float64)
        n = len(scores)
        if not n:
            return np.zeros(0, np.int8)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        length = np.diff(np.append(first, n))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        from_content = np.zeros((n, 2), bool)
        now = scores[first].copy()
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, side="left"))
            at = first[:live] + t
            low, high = now[:live, :1] + self.move[0], now[:live, 1:] + self.move[1]
            from_content[at] = high >= low
            now[:live] = np.maximum(low, high) + scores[at]
        labels = np.zeros(n, np.int8)
        state = (now[:, 1] >= now[:, 0]).astype(np.int8)
        labels[first + length - 1] = state
        for t in range(int(length[0]) - 1, 0, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            at = first[:live] + t
            state[:live] = from_content[at, labels[at]]
            labels[at - 1] = state[:live]
        return labels


def train(features: np.ndarray, labels: np.ndarray, used: np.ndarray, *, steps: int = 120, rate: float = 0.2,
          ridge: float = 1e-3) -> LineField:
    """Maximise the likelihood of label sequences: (documents, lines, features), (documents, lines), mask.

    The gradient is observed minus expected counts; expectations come from the
    forward and backward sums over all sequences.
    """
    d, n, _ = features.shape
    emit, move = np.zeros((features.shape[2], 2)), np.zeros((2, 2))
    flat = features.reshape(d * n, -1).astype(np.float64)
    one_hot = np.eye(2)[labels] * used[:, :, None]
    both = used[:, 1:] * used[:, :-1]
    seen_emit = flat.T @ one_hot.reshape(-1, 2)
    seen_move = np.einsum("dni,dnj,dn->ij", one_hot[:, :-1], one_hot[:, 1:], both)
    first, second = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    total = max(1.0, used.sum())
    for step in range(1, steps + 1):
        s = (flat @ emit).reshape(d, n, 2)
        ahead, behind = np.zeros((d, n, 2)), np.zeros((d, n, 2))
        ahead[:, 0] = s[:, 0]
        for t in range(1, n):
            nxt = np.logaddexp(ahead[:, t - 1, :1] + move[0], ahead[:, t - 1, 1:] + move[1]) + s[:, t]
            ahead[:, t] = np.where(used[:, t, None] > 0, nxt, ahead[:, t - 1])
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for t in range(n - 2, -1, -1):
            tail = s[:, t + 1] + behind[:, t + 1]
            back = np.logaddexp(tail[:, :1] + move[:, 0], tail[:, 1:] + move[:, 1])
            behind[:, t] = np.where(used[:, t + 1, None] > 0, back, 0.0)
        marginal = np.exp(ahead + behind - norm[:, None, None]) * used[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + move + (s + behind)[:, 1:, None, :] - norm[:, None, None, None])
        grads = [(seen_emit - flat.T @ marginal.reshape(-1, 2)) / total - ridge * emit,
                 (seen_move - np.einsum("dnij,dn->ij", pair, both)) / total - ridge * move]
        for w, g, m, v in zip((emit, move), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return LineField(emit, move)


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES) -> LineField | None:
    """Learn from at most ``per_class`` labelled documents of each quality, ``lines`` lines of each.

    The sample is chosen by a hash of the id and bounded, so it is broadcast to
    the documents, and only line features come back. A line takes the label of
    its document. None if there are not both kinds.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("quality")))
    sample = sample_by_hash(known.withColumn("place", F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))),
                            "quality", "place", per_class)
    texts = documents.where(F.col(text_col).isNotNull()).selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    chosen = texts.join(F.broadcast(sample.select("doc_id", "quality")), "doc_id").select("quality", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column("text"))
        places = np.searchsorted(m.line_row, np.arange(batch.num_rows + 1))
        held = [np.packbits(m.features[a:min(b, a + lines)].astype(bool), axis=1).tobytes() for a, b in zip(places[:-1], places[1:])]
        return pa.RecordBatch.from_pydict({"quality": batch.column("quality"), "held": pa.array(held, pa.binary())})

    rows = sorted((r["quality"], bytes(r["held"])) for r in text_step(chosen, "text", work, "quality int, held binary").collect())
    rows = [r for r in rows if r[1]]
    if len({q for q, _ in rows}) < 2:
        return None
    width = -(-N_FEATURES // 8)
    features, used = np.zeros((len(rows), lines, N_FEATURES), np.float32), np.zeros((len(rows), lines))
    for k, (_, held) in enumerate(rows):
        bits = np.unpackbits(np.frombuffer(held, np.uint8).reshape(-1, width), axis=1)[:, :N_FEATURES]
        features[k, :len(bits)], used[k, :len(bits)] = bits, 1
    return train(features, np.array([q for q, _ in rows])[:, None].repeat(lines, 1), used)


def _content(m: Measured, field: LineField | None) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the lines, and the share of a row's words that lie in content lines (1 without words)."""
    n = len(m.n_words)
    labels = field.label(m.features, m.line_row) if field else np.ones(len(m.line_row), np.int8)
    content = np.bincount(m.line_row, m.line_words * labels, n)
    return labels, np.where(m.n_words > 0, content / np.maximum(m.n_words, 1), 1.0)


COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, content_share double")


def assess(documents: DataFrame, field: LineField | None, *, least_share: float = 0.5, id_col: str = "doc_id",
           text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Base counts and verdict of every whole text: doc_id and the ``COLUMNS``.

    A document that fails a base rule is not kept; any other is kept if at least
    ``least_share`` of its words lie in lines labelled content (all do without a
    field). Null and empty texts have no words and fail. One row per input row,
    repeated ones included; ``carry`` names further input columns to hand on
    behind the id, the rest are ignored.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column("_text"))
        _, share = _content(m, field)
        failed = m.base_failed
        found = {c: batch.column(c) for c in ["_id", *carried]}
        found |= {k: pa.array(getattr(m, k), pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        found |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & (share >= least_share)), "content_share": pa.array(share)}
        return pa.RecordBatch.from_pydict(found)

    carried = [f"_c{k}" for k in range(len(carry or []))]
    source = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
                              *[F.col(c).alias(a) for a, c in zip(carried, carry or [])])
    kinds = dict(source.dtypes)
    found = text_step(source, "_text", work, ", ".join([f"{c} {kinds[c]}" for c in ["_id", *carried]] + [COLUMNS]))
    return found.select(F.col("_id").alias("doc_id"), *[F.col(a).alias(c) for a, c in zip(carried, carry or [])],
                        *[c.split()[0] for c in COLUMNS.split(", ")])


def good_documents(documents: DataFrame, field: LineField | None, *, least_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that ``assess`` keeps, with all their columns; names cannot clash, as columns go by position."""
    held = documents.toDF(*[f"c{k}" for k in range(len(documents.columns))])
    at = documents.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column(f"c{at}"))
        return batch.filter(pa.array(~m.base_failed & (_content(m, field)[1] >= least_share)))

    return text_step(held, f"c{at}", work, ", ".join(f"{c} {kind}" for c, kind in held.dtypes)).toDF(*documents.columns)


def label_lines(documents: DataFrame, field: LineField | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, begin, end, content) of each line that has a word; byte positions, end exclusive."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column("text"))
        labels, _ = _content(m, field)
        base = utf8(batch.column("text"))[1][:-1][m.line_row]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(m.line_row)), "begin": pa.array(m.line_begin - base, pa.int64()),
            "end": pa.array(m.line_end - base, pa.int64()), "content": pa.array(labels.astype(bool))})

    source = documents.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    return text_step(source, "text", work, f"doc_id {dict(source.dtypes)['doc_id']}, begin long, end long, content boolean")
