"""Hashes of spans, and texts that a polynomial modulo 2**64 cannot tell apart."""

import numpy as np
import pyarrow as pa
import pytest

from lakewright.llm import common, counting, neardup, private, quality, suffixes
from tests.llm.helpers import by_id


def twins(doublings: int) -> tuple[str, str]:
    """The Thue-Morse word of 2**doublings letters and its complement."""
    a, b = "a", "b"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


A, B = twins(10)


def test_a_span_is_hashed_by_its_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 50000).astype(np.uint8)
    data[30000:30700] = data[100:800]
    starts, ends = np.array([100, 30000, 100, 0, 5]), np.array([800, 30700, 799, 0, 5])
    h = common.span_hashes(data, starts, ends)
    assert h[0] == h[1] != h[2] and h[3] == h[4]
    base = 2 + int.from_bytes(__import__("hashlib").sha256(common.HASH_SEED.encode()).digest()[:8], "little") % ((1 << 61) - 4)
    value = sum((int(c) + 1) * pow(base, k, (1 << 61) - 1) for k, c in enumerate(data[100:800])) % ((1 << 61) - 1)
    assert h[0] == common.mixed(np.array([(value + 700 * int(common._ODD)) % (1 << 64)], np.uint64))[0]


@pytest.mark.parametrize("kind", [np.uint8, np.uint32])
def test_long_spans_and_twins(kind, monkeypatch):
    a, b = twins(12)
    data = np.frombuffer((a + b + a).encode(), np.uint8).astype(kind)
    n = len(a)
    for limit in (1 << 11, 1 << 24):
        monkeypatch.setattr(common, "LONG_BYTES", limit)
        h = common.span_hashes(data, np.arange(3) * n, np.arange(1, 4) * n)
        assert h[0] == h[2] != h[1]
    assert common.unequal(data, np.array([0, 0, 3]), np.array([n, 2 * n, 9]), np.array([n, n, 0])).tolist() == [True, False, False]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_near_duplicates_tell_twins_apart(spark):
    rows = by_id(neardup.near_duplicates(frame(spark, [A, B, A])))
    assert [rows[k]["component_id"] for k in range(3)] == [0, 1, 0]


def test_token_counts_do_not_depend_on_the_batch():
    a, b = (" ".join([w, w]) for w in twins(11))
    path = counting.tokenizer_path()
    alone = [counting.PrefixCounts(counting.load_pieces(path, {})).total(t) for t in (a, b, "x " + A, "x " + B)]
    counter = counting.PrefixCounts(counting.load_pieces(path, {}))
    assert counter.totals([a, b, "x " + A, "x " + B, a]) == [*alone, alone[0]]
    assert [counter.total(t) for t in (b, a)] == [alone[1], alone[0]]


def test_equal_hashes_of_different_parts_and_lines(monkeypatch):
    texts = ["one two\nthree\none two\nfour\nthree", "a\nb\na"]
    counter = counting.PrefixCounts(counting.load_pieces(counting.tokenizer_path(), {}))
    want = counter.totals(texts), quality.measure(pa.array(texts)).n_dup_lines.tolist()
    nothing = lambda data, starts, ends: np.zeros(len(starts), np.uint64)
    monkeypatch.setattr(counting, "span_hashes", nothing)
    monkeypatch.setattr(quality, "span_hashes", nothing)
    again = counting.PrefixCounts(counting.load_pieces(counting.tokenizer_path(), {}))
    assert again.totals(texts) == want[0] and quality.measure(pa.array(texts)).n_dup_lines.tolist() == want[1] == [2, 1]


def test_quality_tells_twin_lines_apart():
    got = quality.measure(pa.array([f"{A}\n{B}", f"{A}\n{A}", f"{A}\n{B}\n{B}\n{A}"]))
    assert got.n_dup_lines.tolist() == [0, 1, 2]
    window = lambda w: " ".join([w] + list("1234567"))
    assert quality.measure(pa.array([window(A) + "\n0 " + window(B)])).n_repeat_words.tolist() == [0]


def test_twin_terms_have_hashes_of_their_own():
    data, offsets = common.utf8(pa.array([f"{A} {B} {A}"]))
    h = private.terms(data, offsets)[2].tolist()
    assert h[0] == h[2] != h[1]


def test_repeated_bytes_of_twins(spark):
    rows = by_id(suffixes.without_repeats(frame(spark, [A, B]), length=1024))
    assert [rows[k]["n_removed"] for k in range(2)] == [0, 0]
    rows = by_id(suffixes.without_repeats(frame(spark, [A, A, B]), length=1024))
    assert [rows[k]["n_removed"] for k in range(3)] == [0, 1024, 0]


def test_a_step_lets_go_of_the_tables_of_the_step_before(spark):
    def leaves(batch):
        common.process_store()["table"] = True
        return batch

    def finds(batch):
        return pa.RecordBatch.from_pydict({"found": pa.array(["table" in common.process_store()] * batch.num_rows)})

    rows = spark.range(64).selectExpr("cast(id as string) as text").repartition(16)
    assert common.text_step(rows, "text", leaves, "text string").count() == 64
    assert not any(r.found for r in common.text_step(rows, "text", finds, "found boolean").collect())
