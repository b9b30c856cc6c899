"""Suffix arrays and repeated substrings."""

import hashlib
import random
import re

import numpy as np
import pytest

from lakewright.llm import suffixarray, suffixes
from tests.llm.helpers import by_id, collected, prose


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(11)
    for _ in range(1500):
        text = bytes(rng.choice(b"ab\xffcdefg"[:rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 60)))
        s = np.frombuffer(text, np.uint8)
        order = suffixarray.suffix_array(s)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if len(text) < 2:
            continue
        shared = suffixarray.common_prefixes(s, order)
        for before, own in zip(order[:-1], order[1:]):
            n = 0
            while max(before, own) + n < len(text) and text[before + n] == text[own + n] != suffixarray.SEPARATOR:
                n += 1
            assert shared[own] == n


def plain(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            window = raw[a:a + length]
            if window in seen:
                gone[a:a + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def check(docs, rows, **options):
    got = by_id(suffixes.without_repeats(docs, **options))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == plain(rows, options.get("length", 100))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.values())


def test_documents(documents):
    check(documents, [(r.doc_id, r.text) for r in documents.collect()])


def passages(rng):
    passage, other = prose(rng, 60), prose(rng, 50)
    rows = [prose(rng, rng.randint(0, 60)) + " " + passage + " " + prose(rng, rng.randint(0, 60)) for _ in range(40)]
    rows += [passage + passage, other + passage[:300] + other, passage[40:], "xy" * 400, "z" * 700, "z" * 99, "z" * 100, "é" * 120, passage, passage]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("shard_bytes", [suffixes.SHARD_BYTES, 1500])
def test_shared_passages_and_crowded_anchors(spark, shard_bytes):
    rows = passages(random.Random(12))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, shard_bytes=shard_bytes)


def test_other_lengths(spark):
    rows = passages(random.Random(13))[:25]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, length=37, gram=9)


def test_odd_rows(odd, nothing):
    got = collected(suffixes.without_repeats(odd))
    texts = odd.collect()
    assert len(got) == len(texts)
    # Rows that share id and text count once; all others are compared as they are.
    want = plain({(r.doc_id, r.text) for r in texts})
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == {(k, *v) for k, v in want.items()}
    assert suffixes.without_repeats(nothing).count() == 0


def test_ids_that_are_text(spark):
    rows = [(str(k), t) for k, t in passages(random.Random(14))]
    got = by_id(suffixes.without_repeats(spark.createDataFrame(rows, "doc_id string, text string")))
    order = {k: n for n, k in enumerate(sorted(k for k, _ in rows))}
    want = plain([(order[k], t) for k, t in rows])
    assert {order[k]: r["n_removed"] for k, r in got.items()} == {k: v[1] for k, v in want.items()}
