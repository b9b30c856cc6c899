"""Near duplicates."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lakewright.llm import neardup
from lakewright.llm.common import Steps
from lakewright.llm.components import components
from tests.llm.helpers import WORD, ascii_lower, by_id, collected, prose, roots


def shingles(text):
    words = WORD.findall(ascii_lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def plain(rows, percent=85):
    """(shingles, component) by id, from all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
              if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(ids, linked)
    return {i: (len(sets[i]), root[i]) for i in ids}


def check(docs, percent=85):
    want = plain([(r.doc_id, r.text) for r in docs.collect()], percent)
    rows = collected(neardup.near_duplicates(docs, percent=percent))
    assert len(rows) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def family(rng, n, words, most):
    """A text and copies with a few words changed."""
    base = prose(rng, words).split()
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(words)] = prose(rng, 1)
        out.append(" ".join(copy))
    return out


def test_documents(documents):
    check(documents)


@pytest.mark.parametrize("block,percent", [(neardup.BLOCK, 85), (6, 85), (neardup.BLOCK, 80)])
def test_families(spark, monkeypatch, block, percent):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(7)
    texts = family(rng, 90, 150, 6) + family(rng, 30, 400, 14) + family(rng, 25, 40, 2) + family(rng, 12, 3, 1)
    texts += [texts[0].upper(), texts[0].replace(" ", "\n"), prose(rng, 5000)]
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent)


def test_odd_rows(odd, nothing):
    rows = collected(neardup.near_duplicates(odd))
    want = plain([(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()])
    assert len(rows) == odd.count()
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None} == {(k, c) for k, (_, c) in want.items()}
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    out = neardup.without_near_duplicates(odd)
    assert out.columns == odd.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(kept, key=str) == sorted({r["doc_id"] for r in rows if r["kept"]}, key=str)
    assert neardup.near_duplicates(nothing).count() == 0 and neardup.without_near_duplicates(nothing).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(8)
    a, b = (np.unique(rng.integers(0, 2 ** 63, 900, dtype=np.uint64)) for _ in range(2))
    shared = np.unique(rng.integers(0, 2 ** 63, 4000, dtype=np.uint64))
    left, right = np.union1d(a, shared), np.union1d(b, shared)
    one, two, both = neardup.registers([left, right, np.union1d(left, right)])
    assert (np.maximum(one, two) == both).all()
    true = len(shared) / len(np.union1d(left, right))
    got = neardup.joint_similarity(one[None], two[None], np.array([float(len(left))]), np.array([float(len(right))]))[0]
    assert abs(got - true) < 0.1
    assert neardup.joint_similarity(one[None], one[None], np.array([9.0]), np.array([9.0]))[0] > 0.99


def test_estimates_keep_links():
    """The error of the estimate near the threshold is far below the slack."""
    rng, errors = np.random.default_rng(9), []
    for _ in range(60):
        shared, rest = rng.integers(0, 2 ** 63, 850, dtype=np.uint64), rng.integers(0, 2 ** 63, (2, 75), dtype=np.uint64)
        sets = [np.unique(np.concatenate([shared, r])) for r in rest]
        r = neardup.registers(sets)
        n = [np.array([float(len(s))]) for s in sets]
        errors.append(neardup.joint_similarity(r[:1], r[1:], *n)[0] - 0.85)
    assert np.std(errors) < neardup.Likeness().slack / 4 and abs(np.mean(errors)) < 0.02


def test_shingles_do_not_depend_on_the_batch(documents):
    texts = [r.text for r in documents.limit(50).collect()]
    together = neardup.shingle_sets(pa.array(texts))
    for text, got in zip(texts, together):
        assert (neardup.shingle_sets(pa.array([text]))[0] == got).all()
        assert len(got) == len(shingles(text))


def test_components(spark):
    rng = random.Random(10)
    links = [(k, k + 1) for k in range(200)] + [(500, k) for k in range(501, 700)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["root"] for r in collected(components(df, Steps(spark, "test")))}
    want = roots({x for ab in links for x in ab}, links)
    assert all(got.get(k, k) == v for k, v in want.items())
    assert collected(components(df.limit(0), Steps(spark, "test"))) == []


def near_misses(rng, n, changed, length=60):
    """Copies of one text with some words changed in each: links to the text itself, near misses of each other, or both."""
    base = prose(rng, length).split()
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(length), rng.choice(changed)):
            words[at] = "w" + str(rng.randrange(10 ** 9))
        out.append(" ".join(words))
    return [" ".join(base), *out]


@pytest.mark.parametrize("changed", [(1, 2), (2, 3), (2,), (0, 1, 2, 3, 4)])
def test_families_around_the_link(spark, monkeypatch, changed):
    """Members just above and just below the link, in families of more than two blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(sum(changed))
    texts = [t for k in range(3) for t in near_misses(rng, 60, changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = by_id(neardup.near_duplicates(docs))
    want = plain(list(enumerate(texts)))
    assert {k: r["component_id"] for k, r in rows.items()} == {k: w[1] for k, w in want.items()}


def test_candidates_are_never_listed_as_pairs(spark, monkeypatch):
    """Near misses of each other: rows stay in proportion to members."""
    rng = random.Random(3)
    texts = near_misses(rng, 150, (2, 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    keep = neardup.Steps.write

    def write(self, step, df):
        out = keep(self, step, df)
        seen[step] = out.count()
        return out

    monkeypatch.setattr(neardup.Steps, "write", write)
    neardup.near_duplicates(docs).count()
    assert seen["more"] <= len(texts) and seen["candidates"] <= 2 * seen["members"] and seen["first"] <= 3 * len(texts)


def test_steps_of_few_words(spark):
    rows = by_id(neardup.near_duplicates(spark.createDataFrame([(1, "one"), (2, "a b"), (3, "One")], "doc_id long, text string").coalesce(1)))
    assert [rows[k]["component_id"] for k in (1, 2, 3)] == [1, 2, 1]
