"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import pytest

from lakewright.llm import search
from lakewright.llm.common import Steps
from tests.llm.helpers import NAMES, ascii_lower, collected, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=20):
    """Sorted (item_id, rank, doc_id, score) by the definition."""
    counts = [(d, Counter(TERM.findall(ascii_lower(t or "")))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found, asked = [], Counter(TERM.findall(ascii_lower(text or "")))
        for d, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in asked.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def check(docs, items, **options):
    got = search.search(docs, items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.select("item_id", "text").collect()],
                 options.get("k", 20))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    return want


def test_given_documents(tables):
    assert check(tables.documents, tables.benchmark)


@pytest.fixture
def small(spark):
    rng = random.Random(4)
    words = prose(rng, 60).split()
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 3, 3, 8, 40])))) for k in range(900)]
    docs += [(None, docs[0][1]), (None, docs[0][1]), (5, docs[0][1]), (901, docs[0][1].upper() + "!"), (902, "Ünï-kö 日本 x"), (903, None), (904, ""), (905, " .;"),
             (906, " ".join(words) * 50)]
    items = [(1, docs[0][1]), (1, docs[0][1]), (2, " ".join(words[:30]) + " " + words[0] * 2), (3, None), (4, "?"), (5, "ünï ÜNÏ kö 日本 nowhere"), (None, words[3])]
    extra = ", ".join(f"`{c}` string" for c in (*NAMES, "m", "terms", "item", "score"))
    frame = lambda rows, first: spark.createDataFrame([(*r, *["x"] * (len(NAMES) + 4)) for r in rows], f"{first} long, text string, {extra}")
    return frame(docs, "doc_id").repartition(3), frame(items, "item_id")


def test_ties_nulls_repeats_and_names(small):
    assert check(*small)
    check(*small, k=3)


def test_small_pieces_and_blocks(small, monkeypatch):
    monkeypatch.setattr(search, "PIECE_DOCUMENTS", 5)
    monkeypatch.setattr(search, "BLOCK_BYTES", 200)
    monkeypatch.setattr(search, "SENT_STRATA", 0)
    check(*small)


def test_large_bounds_are_summed_in_whole_numbers(spark):
    items = spark.createDataFrame([(1, "rare " * 400000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "rare " * 7 + "x"), (2, "rare rare"), *((k, "other words") for k in range(3, 400))], "doc_id long, text string")
    got = search.search(docs, items).collect()
    assert [(r.doc_id, r.score) for r in got] == [(r[2], r[3]) for r in plain([(r.doc_id, r.text) for r in docs.collect()], [(1, "rare " * 400000)])]


def test_the_index_holds_every_document_in_its_stratum(spark, small):
    docs = small[0]
    index = search.build_index(docs, Steps(spark, "test"))
    n = [len(TERM.findall(r.text or "")) for r in docs.select("text").collect()]
    want = Counter(75 + 25 * x * index.documents // index.terms for x in n if x)
    got = Counter()
    for r in collected(index.pieces):
        got[r["m"]] += len(r["docs"])
        assert len(r["posting"]) == sum(r["length"]) == sum(r["df"]) and len(r["tf"]) == len(r["length"]) == sum(r["runs"])
    assert got == want and index.terms == sum(n)


def test_ids_decide_between_equal_scores():
    top = search._Best(1)
    top.add(search.np.array([0, 7, 7, 3]), search.pa.array([4, 9, 2, 1]))
    assert top.rows == [(-7, 2)] and top.least == 7


def test_no_rows(tables):
    assert collected(search.search(tables.documents.limit(0), tables.benchmark)) == []
    assert collected(search.search(tables.documents, tables.benchmark.limit(0))) == []
