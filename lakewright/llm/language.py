"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import sample_by_hash, text_step, utf8

UNKNOWN = "und"
#: Bytes that the network reads at once. A longer text is read window after window.
WINDOW = 128
#: Documents per language and windows per document that the network learns from: the sample's bound.
SAMPLE_DOCUMENTS = 500
SAMPLE_WINDOWS = 4
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Recurrence:
    """One direction: gates update, reset and candidate of ``units`` each, side by side."""

    table: np.ndarray  # (256, 3 * units): what a byte adds to the gates, bias included
    loop: np.ndarray  # (units, 3 * units): what the state adds

    @classmethod
    def random(cls, units: int, rng: np.random.Generator) -> Recurrence:
        scale = 1 / np.sqrt(units)
        return cls(rng.normal(0, 0.3, (256, 3 * units)), rng.uniform(-scale, scale, (units, 3 * units)))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each of the rows of ``x`` (steps, batch), and what going back needs."""
        units = len(self.loop)
        h = np.zeros((x.shape[1], units))
        states, held = np.empty((*x.shape, units)), []
        for t in range(len(x)):
            a, g = self.table[x[t]], h @ self.loop
            z = _sigmoid(a[:, :units] + g[:, :units])
            r = _sigmoid(a[:, units:2 * units] + g[:, units:2 * units])
            gn = g[:, 2 * units:]
            n = np.tanh(a[:, 2 * units:] + r * gn)
            held.append((h, z, r, n, gn))
            h = n + z * (h - n)
            states[t] = h
        return states, held

    def backward(self, x: np.ndarray, held: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and loop, back through time; ``grad`` is that of the states."""
        units = len(self.loop)
        loop = np.zeros_like(self.loop)
        adds = np.empty((*x.shape, 3 * units))
        carried = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, gn = held[t]
            dh = grad[t] + carried
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            adds[t] = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            loop += h.T @ dg
            carried = dh * z + dg @ self.loop.T
        seen = np.zeros((x.size, 256), np.float32)
        seen[np.arange(x.size), x.ravel()] = 1
        return seen.T @ adds.reshape(x.size, -1).astype(np.float32), loop


@dataclass
class Network:
    """The trained network and its languages in code-point order."""

    languages: list[str]
    onward: Recurrence
    back: Recurrence
    out: np.ndarray  # (2 * units, languages)
    bias: np.ndarray

    def packed(self) -> dict[str, np.ndarray]:
        """Both directions as one recurrence of twice the units, in single precision.

        Sigmoids become tanh of half the argument, so the halves go into the weights.
        """
        u = len(self.onward.loop)
        half = np.repeat([0.5, 0.5, 1.0], u)
        tables, loop = [], np.zeros((2 * u, 6 * u))
        for k, one in enumerate((self.onward, self.back)):
            wide = np.zeros((256, 6 * u))
            for gate in range(3):
                to = slice(gate * 2 * u + k * u, gate * 2 * u + k * u + u)
                wide[:, to] = (one.table * half)[:, gate * u:(gate + 1) * u]
                loop[k * u:(k + 1) * u, to] = (one.loop * half)[:, gate * u:(gate + 1) * u]
            tables.append(np.ascontiguousarray(wide, np.float32))
        return {"onward": tables[0], "back": tables[1], "loop": loop.astype(np.float32),
                "out": self.out.astype(np.float32), "bias": self.bias.astype(np.float32)}


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: list[str], *, units: int = 8,
          steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """Learn from byte windows (rows, WINDOW) with their used lengths and language numbers.

    Every position of a window is to be labelled with the window's language;
    the mean cross entropy over positions goes back through time, Adam steps.
    """
    rng = np.random.default_rng(seed)
    n = len(languages)
    net = Network(languages, Recurrence.random(units, rng), Recurrence.random(units, rng),
                  rng.normal(0, 0.3, (2 * units, n)), np.zeros(n))
    weights = [net.onward.table, net.onward.loop, net.back.table, net.back.loop, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_language = [np.flatnonzero(labels == k) for k in range(n)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, max(1, batch // n)) for rows in by_language])
        x = windows[pick].T
        used = (np.arange(len(x))[:, None] < lengths[pick]).astype(float)
        onward, held_on = net.onward.forward(x)
        back, held_back = net.back.forward(x[::-1])
        both = np.concatenate([onward, back[::-1]], axis=2)
        logits = both @ net.out + net.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(pick)), labels[pick]] -= 1
        d = p * used[:, :, None] / used.sum()
        d_both = d @ net.out.T
        table_on, loop_on = net.onward.backward(x, held_on, d_both[:, :, :units])
        table_back, loop_back = net.back.backward(x[::-1], held_back, d_both[::-1, :, units:])
        grads = [table_on, loop_on, table_back, loop_back, np.einsum("tbu,tbk->uk", both, d), d.sum(axis=(0, 1))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes as windows (n, WINDOW), the used length of each, and the row of each."""
    sizes = np.diff(offsets)
    per_row = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begin = offsets[:-1][row] + nth * WINDOW
    length = np.minimum(offsets[1:][row] - begin, WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin] if len(row) else np.zeros((0, WINDOW), np.uint8)
    return np.where(np.arange(WINDOW) < length[:, None], windows, 0).astype(np.uint8), length, row


def position_probabilities(net: dict[str, np.ndarray], windows: np.ndarray, group: int = 1024) -> Iterator[tuple[slice, np.ndarray]]:
    """Probabilities (WINDOW, rows, languages) of every position, for groups of rows."""
    wide = len(net["loop"])
    for begin in range(0, len(windows), group):
        part = slice(begin, min(begin + group, len(windows)))
        x = np.ascontiguousarray(windows[part].T)
        rows = x.shape[1]
        h = np.zeros((rows, wide), np.float32)
        states = np.empty((WINDOW, rows, wide), np.float32)
        a, b, g = (np.empty((rows, 3 * wide), np.float32) for _ in range(3))
        gates, n = np.empty((rows, 2 * wide), np.float32), np.empty((rows, wide), np.float32)
        u = wide // 2
        for t in range(WINDOW):
            np.take(net["onward"], x[t], axis=0, out=a, mode="clip")
            np.take(net["back"], x[WINDOW - 1 - t], axis=0, out=b, mode="clip")
            a += b
            np.matmul(h, net["loop"], out=g)
            np.add(a[:, :2 * wide], g[:, :2 * wide], out=gates)
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            np.multiply(gates[:, wide:], g[:, 2 * wide:], out=n)
            n += a[:, 2 * wide:]
            np.tanh(n, out=n)
            h -= n
            h *= gates[:, :wide]
            h += n
            states[t, :, :u] = h[:, :u]
            states[WINDOW - 1 - t, :, u:] = h[:, u:]
        p = states.reshape(-1, wide) @ net["out"]
        p += net["bias"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        yield part, p.reshape(WINDOW, rows, -1)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 modulo 4 (null as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learning_sample(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    per_language: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> list:
    """Byte windows of at most ``per_language`` documents of each language, chosen by a hash of the id.

    Rows: (lang, windows). Only rows that are not held out, with language and text.
    """
    usable = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    raw = F.col(text_col).cast("binary")
    places = [F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(k)), F.greatest(F.length(raw) - WINDOW + 1, F.lit(1))) + 1
              for k in range(windows)]
    rows = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("place"),
                         F.array(*[F.substring(raw, p.cast("int"), F.lit(WINDOW)) for p in places]).alias("windows"))
    best = sample_by_hash(rows, "lang", "place", per_language)
    return best.select("lang", "windows").orderBy("lang", "place", "windows").collect()


def fit(documents: DataFrame, **options) -> Network | None:
    """A network learned from the sample of ``documents``; None if no row can be learned from."""
    columns = {k: options.pop(k) for k in list(options) if k.endswith("_col") or k in ("per_language", "windows")}
    rows = learning_sample(documents, **columns)
    texts = [(r["lang"], bytes(w)) for r in rows for w in r["windows"] if len(w)]
    if not texts:
        return None
    languages = sorted({lang for lang, _ in texts}, key=lambda s: s.encode())
    number = {lang: k for k, lang in enumerate(languages)}
    windows = np.zeros((len(texts), WINDOW), np.uint8)
    for k, (_, text) in enumerate(texts):
        windows[k, :len(text)] = np.frombuffer(text, np.uint8)
    return train(windows, np.array([len(w) for _, w in texts]), np.array([number[lang] for lang, _ in texts]), languages, **options)


def identify(documents: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, shares): language of each whole text.

    Every byte of a text is labelled with probabilities; a document's are their
    means. ``score`` is that of ``lang_pred`` and ``shares`` maps each language
    to the share of positions at which it is the likeliest. A null text or one
    without a letter is ``und`` with score 0 and no shares, and so is every text
    if there is no network. Of equal means the first language in code-point
    order wins. One row per input row; other columns are ignored.
    """
    packed = network.packed() if network else None
    languages = network.languages if network else []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        data, offsets = utf8(texts)
        n = batch.num_rows
        mean, votes = np.zeros((n, max(1, len(languages)))), np.zeros((n, max(1, len(languages))))
        if packed is not None:
            windows, length, row = cut_windows(data, offsets)
            for part, p in position_probabilities(packed, windows):
                used = (np.arange(WINDOW)[:, None] < length[part]).astype(np.float32)
                best = p.argmax(axis=2)
                for k in range(len(languages)):
                    mean[:, k] += np.bincount(row[part], np.einsum("tb,tb->b", p[:, :, k], used), n)
                    votes[:, k] += np.bincount(row[part], ((best == k) * used).sum(axis=0), n)
        size = np.maximum(np.diff(offsets), 1)[:, None]
        mean, votes = mean / size, votes / size
        best = mean.argmax(axis=1)
        known = [packed is not None and t is not None and bool(_LETTER.search(t)) for t in texts.to_pylist()]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "lang_pred": pa.array([languages[k] if ok else UNKNOWN for k, ok in zip(best, known)], pa.string()),
            "score": pa.array([min(1.0, float(m[k])) if ok else 0.0 for m, k, ok in zip(mean, best, known)], pa.float64()),
            "shares": pa.array([[(lang, float(x)) for lang, x in zip(languages, v)] if ok else [] for v, ok in zip(votes, known)],
                               pa.map_(pa.string(), pa.float64()))})

    source = documents.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    kind = dict(source.dtypes)["doc_id"]
    return text_step(source, "text", work, f"doc_id {kind}, lang_pred string, score double, shares map<string,double>", 1 << 20)
