"""Mixing sources."""

import collections

from lakewright.llm import mixing
from tests.llm.helpers import WORD, by_id, collected


def targets(sizes, share=1.5, repeats=2, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in full]
        level = (budget - sum(repeats * sizes[s] for s in full)) / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if repeats * sizes[s] <= level * weight[s]}
        if not more:
            return {s: repeats * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= more


def check(docs, rows):
    size = [len(WORD.findall(r.text or "")) for r in docs.collect()]
    sources = collections.Counter()
    for r, n in zip(docs.collect(), size):
        sources[r.source] += n
    want = targets(sources)
    taken = collections.Counter()
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sources[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= 1.5 * sum(sources.values())
    for s in sources:
        assert taken[s] <= 2 * sources[s]
        assert abs(taken[s] - want[s]) <= 2 * max((n for r, n in zip(docs.collect(), size) if r.source == s), default=0) + 1e-6


def test_documents(documents):
    rows = collected(mixing.mix(documents))
    check(documents, rows)
    again = by_id(mixing.mix(documents.repartition(5)))
    assert {r["doc_id"]: r["taken"] for r in rows} == {k: r["taken"] for k, r in again.items()}
    other = by_id(mixing.mix(documents, seed="other"))
    assert any(r["taken"] != other[r["doc_id"]]["taken"] for r in rows)


def test_the_mix_itself(documents):
    rows = by_id(mixing.mix(documents))
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    times = collections.Counter(r["doc_id"] for r in collected(out))
    assert all(times[k] * r["size"] == r["taken"] for k, r in rows.items())


def test_odd_rows(odd, nothing):
    rows = collected(mixing.mix(odd))
    assert len(rows) == odd.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() > 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_many_sources_in_order_of_code_points(spark):
    rows = [(k, "w " * (k % 7), s, 0) for k, s in enumerate(["b", "B", "é", "z", None, "aa", "a", "Z"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    check(docs, collected(mixing.mix(docs)))
