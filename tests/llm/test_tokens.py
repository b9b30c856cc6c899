"""Token counts and sampled segmentations."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lakewright.llm import counting, sampling
from lakewright.llm.pieces import SPACE, Pieces, tokenizer_path
from tests.llm.helpers import by_id, collected

ALPHABET = "aabcdeehinorst  \n▁é①日x!?0\U0001f642\t"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.fixture(scope="module")
def pieces():
    return Pieces(tokenizer_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ["", " ", "  a  b ", "<s> </s>", "▁", "a" * 400, " " * 100, "①\U0001f642" * 150] + [
        "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(600)]


def test_every_prefix_has_the_count_of_the_library(pieces, library, texts):
    counter = counting.PrefixCounts(pieces)
    for text in texts[:300]:
        want = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert counter.table(text).tolist() == want
        for limit in (0, 1, 5, 40):
            assert counter.cut(text, limit) == max(k for k, n in enumerate(want) if n <= limit)


def test_totals_do_not_depend_on_what_is_kept(pieces, library, texts, monkeypatch):
    want = [len(library.encode(t)) for t in texts]
    assert counting.PrefixCounts(pieces).totals(texts) == want
    monkeypatch.setattr(counting, "KEPT_PARTS", 5)
    monkeypatch.setattr(counting, "KEPT_LENGTH", 4)
    counter = counting.PrefixCounts(pieces)
    assert [counter.total(t) for t in texts] == want


def test_counts_of_documents(documents, library):
    rows = by_id(counting.token_counts(documents, limit=300))
    for r in documents.collect():
        n = len(library.encode(r.text))
        got = rows[r.doc_id]
        assert (got["n_tokens"], got["n_bytes"], got["over_limit"]) == (n, len(r.text.encode()), n > 300)
        assert len(library.encode(r.text[:got["cut_chars"]])) <= 300


def test_counts_of_odd_rows(odd, nothing, library):
    rows = collected(counting.token_counts(odd))
    assert len(rows) == odd.count()
    assert sorted((r["n_tokens"], r["n_bytes"]) for r in rows) == sorted(
        (len(library.encode(r.text or "")), len((r.text or "").encode())) for r in odd.collect())
    assert counting.token_counts(nothing).count() == 0
    tables = {(r["doc_id"], len(r["counts"])): r["counts"] for r in collected(counting.prefix_tables(odd.where("doc_id < 5")))}
    assert tables[0, 1] == [0] and tables[3, 8][-1] == len(library.encode("one two"))


def segmentations(lattice, text):
    """All segmentations of a text with their probabilities."""
    part = SPACE + text.replace(SPACE, sampling._LITERAL).replace(" ", SPACE)
    found = {}

    def go(at, ids, weight):
        if at == len(part):
            found[tuple(ids)] = weight
            return
        for end in range(at + 1, len(part) + 1):
            piece = lattice.pieces.ids.get(part[at:end], -1)
            if piece >= 0:
                go(end, [*ids, piece], weight * lattice.weight[piece])
        if lattice.pieces.ids.get(part[at], -1) < 0:
            raw = lattice.spelling(part[at])
            go(at + 1, ids + [lattice.pieces.byte_id[b] for b in raw], weight * lattice.byte_weight ** len(raw))

    go(0, [], 1.0)
    total = sum(found.values())
    return {ids: w / total for ids, w in found.items()}


@pytest.mark.parametrize("text", ["the", "a b", "hé\n①x", "then ▁"])
@pytest.mark.parametrize("power", [0.3, 1.0])
def test_samples_follow_the_lattice(pieces, text, power):
    lattice, n = sampling.Lattice(pieces, power), 6000
    want = segmentations(lattice, text)
    got = collections.Counter(tuple(x.tolist()) for x in sampling._encoded(lattice, [text] * n, sampling._seeds(list(range(n)), "t")))
    assert set(got) <= set(want)
    for ids, p in want.items():
        assert abs(got[ids] - n * p) <= 6 * np.sqrt(n * p * (1 - p)) + 3


def test_samples_depend_on_seed_and_text_alone(pieces, texts, monkeypatch):
    lattice = sampling.Lattice(pieces, 1.0)
    seeds = sampling._seeds(list(range(len(texts))), "x")
    whole = sampling._encoded(lattice, texts, seeds)
    assert all(lattice.decode(x.tolist()) == t.encode() for x, t in zip(whole, texts))
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    monkeypatch.setattr(sampling, "KEPT_POSITIONS", 2000)
    other = sampling.Lattice(pieces, 1.0)
    for a in range(0, len(order), 40):
        part = order[a:a + 40]
        for k, ids in zip(part, sampling._encoded(other, [texts[k] for k in part], seeds[part])):
            assert ids.tolist() == whole[k].tolist()
    monkeypatch.setattr(sampling, "KEPT_LENGTH", 0)
    alone = sampling._encoded(sampling.Lattice(pieces, 1.0), texts[:200], seeds[:200])
    assert [x.tolist() for x in alone] == [x.tolist() for x in whole[:200]]


def test_encode_and_decode_documents(documents):
    encoded = sampling.encode(documents, carry=["lang"])
    rows, again = by_id(encoded), by_id(sampling.encode(documents.repartition(5)))
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in rows.values())
    assert {k: r["ids"] for k, r in rows.items()} == {k: r["ids"] for k, r in again.items()}
    assert {r["doc_id"]: r["text"] for r in collected(sampling.decode(encoded))} == texts
    digests = by_id(sampling.digests(documents))
    assert all(d["ids_sha256"] == hashlib.sha256(np.array(rows[k]["ids"], "<i4").tobytes()).hexdigest() for k, d in digests.items())
    assert by_id(sampling.digests(documents, seed="other"))[0]["ids_sha256"] != digests[0]["ids_sha256"]


def test_encode_odd_rows(odd, nothing):
    rows = collected(sampling.encode(odd, carry=["ids", "_id"]).drop("ids"))
    assert len(rows) == odd.count() and all(r["lossless"] and r["_id"] == "x" for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert collected(sampling.digests(nothing)) == [] and collected(sampling.encode(nothing)) == []
