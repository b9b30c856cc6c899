"""Exact duplicates and repeated line chunks."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from lakewright.llm import exact, lines, neardup
from tests.llm.helpers import by_id, collected, prose


def groups(rows):
    found = {}
    for k, (i, text) in enumerate(rows):
        found.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, k))
    return found


def check_exact(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = collected(exact.exact_duplicates(docs, **options))
    want = groups(rows)
    assert len(got) == len(rows)
    shas = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    for r in got:
        group = shas[r["text_sha256"]]
        assert r["group_size"] == len(group) and r["keep_id"] == (None if min(group)[1] else min(group)[2])
    assert sum(r["kept"] for r in got) == len(want)
    assert all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])


def test_exact_duplicates(documents, odd, nothing):
    check_exact(documents)
    check_exact(odd)
    assert exact.exact_duplicates(nothing).count() == 0


@pytest.mark.parametrize("width", [0, 1])
def test_equal_digests_of_different_chunks(documents, odd, width):
    check_exact(documents.limit(80), digest_bytes=width)
    check_exact(odd, digest_bytes=width)


def test_rows_that_stay(odd, nothing):
    out = exact.without_exact_duplicates(odd)
    assert out.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert len(rows) == len(groups([(r.doc_id, r.text) for r in odd.collect()])) == len(groups(rows))
    assert exact.without_exact_duplicates(nothing).count() == 0


def test_cuts_move_with_the_content():
    rng = random.Random(3)
    text = prose(rng, 30000).encode()
    changed = text[:5000] + b"something put in" + text[5000:]
    a, b = ([t[x:y] for x, y in zip([0, *e[:-1]], e)] for t, e in zip((text, changed), exact.chunk_ends([text, changed])))
    assert b"".join(a) == text and b"".join(b) == changed
    assert all(exact.LEAST_CHUNK <= len(c) <= exact.MOST_CHUNK for c in a[:-1])
    assert len(set(a) & set(b)) > 0.9 * len(set(a))
    assert exact.chunk_ends([b"x", changed])[1] == exact.chunk_ends([changed])[0]
    assert exact.chunk_ends([b"", b"a" * 20000])[0] == []


def plain_lines(rows):
    """Chunks of two lines or more that stand earlier too go."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        kept, chunks, at = [], 0, 0
        for a, b, n in lines.line_chunks(raw):
            body = raw[a:b].removesuffix(b"\n")
            again = n >= 2 and body.strip() and body in seen
            if n >= 2 and body.strip():
                seen.setdefault(body, (i, a))
            chunks += bool(again)
            if not again:
                kept.append(raw[a:b])
            at = b
        assert at == len(raw)
        out[i] = (b"".join(kept).decode(), chunks)
    return out


@pytest.mark.parametrize("width", [16, 1])
def test_repeated_lines(spark, documents, width):
    rng = random.Random(4)
    block = "\n".join(prose(rng, 6) for _ in range(9)) + "\n"
    rows = [(r.doc_id, r.text) for r in documents.limit(100).collect()]
    rows += [(1000 + k, prose(rng, 5) + "\n" + block + prose(rng, 5) + "\n" + (block if k % 2 else "")) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(lines.without_repeated_lines(docs, digest_bytes=width))
    want = plain_lines(rows)
    assert {k: (r["text"], r["n_removed_chunks"]) for k, r in got.items()} == want
    assert sum(r["n_removed_lines"] for r in got.values()) >= 20
    assert all(r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in got.values())
    assert all(r["n_lines"] == len([p for p in t.split("\n")[:-1]]) + bool(t.split("\n")[-1]) for (i, t), r in ((x, got[x[0]]) for x in rows))


def test_line_cuts_resist_shifts():
    rng = random.Random(6)
    text = "\n".join(prose(rng, 5) for _ in range(300)).encode()
    moved = b"new first line\nand another\nand a third\n" + text
    a, b = ({t[x:y] for x, y, _ in lines.line_chunks(t)} for t in (text, moved))
    assert len(a & b) > 0.9 * len(a)
    assert all(2 <= n <= lines.MOST_LINES for _, _, n in lines.line_chunks(text)[:-1])


def test_odd_lines(odd, nothing):
    rows = collected(lines.without_repeated_lines(odd))
    assert len(rows) == odd.count()
    assert all(r["text"] == "" and r["n_removed_lines"] == 0 for r in rows if r["doc_id"] in (0, 1))
    assert lines.without_repeated_lines(nothing).count() == 0


def plain_runs(rows):
    """Lines go that stand in a run of two lines or more, with a word, that starts earlier; by comparing all runs."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    texts = [(t or "").split("\n") for _, t in ordered]
    texts = [t[:-1] if t[-1] == "" else t for t in texts]
    first, out = {}, []
    for n, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + 2, len(t) + 1):
                first.setdefault(tuple(t[a:b]), (n, a))
    for n, ((i, text), t) in enumerate(zip(ordered, texts)):
        gone = {k for a in range(len(t)) for b in range(a + 2, len(t) + 1)
                if any(p.strip(" \t\n\x0b\x0c\r") for p in t[a:b]) and first[tuple(t[a:b])] != (n, a) for k in range(a, b)}
        whole = re.findall("[^\n]*\n|[^\n]+$", text or "")
        out.append((str(i), "".join(p for k, p in enumerate(whole) if k not in gone), len(gone), sum(k - 1 not in gone for k in gone), len(whole)))
    return out


def check_runs(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed_lines"], r["n_removed_chunks"], r["n_lines"]) for r in collected(
        lines.without_repeated_runs(docs, **options)))
    assert got == sorted(plain_runs(rows))
    return sum(r[2] for r in got)


@pytest.mark.parametrize("width", [16, 1, 0])
def test_all_repeated_runs(spark, width):
    """Runs of any length that begin and end anywhere, few different lines, blank lines, texts with and without a last line feed."""
    rng = random.Random(11)
    words = [prose(rng, 3) for _ in range(60)]
    rows = [(k, "\n".join(rng.choice([*words[:rng.choice([3, 60])], "", "", " "]) for _ in range(rng.randint(0, 9))) + "\n" * rng.randint(0, 3)) for k in range(150)]
    block = [prose(rng, 6) for _ in range(14)]
    for k in range(40):
        a = rng.randrange(12)
        rows.append((1000 + k, "\n".join([prose(rng, 5), *block[a:a + rng.randint(2, 12)], prose(rng, 4)])))
    assert check_runs(spark.createDataFrame(rows, "doc_id long, text string"), digest_bytes=width) > 300


def test_whole_copies_leave_no_line(spark):
    rng = random.Random(12)
    texts = ["\n".join(prose(rng, 4) for _ in range(n)) + end for n in range(2, 40) for end in ("", "\n", "\n\n\n")]
    rows = list(enumerate(texts)) + [(1000 + k, t) for k, t in enumerate(texts)]
    got = by_id(lines.without_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[1000 + k]["text"] == "" and got[k]["text"] == t for k, t in enumerate(texts))
    assert all(n >= 2 for t in texts for _, _, n in lines.line_chunks(t.encode()))


def test_runs_of_given_and_odd_documents(documents, odd, nothing):
    check_runs(documents.limit(150))
    check_runs(odd)
    assert lines.without_repeated_runs(nothing).count() == 0


def test_many_blank_lines_take_linear_time():
    found, stands = lines.line_windows(b"x\n" + b"\n" * 100_000 + b"y", lambda p: hashlib.md5(p).digest())
    assert len(found) < 210_000 and len(stands) < 210_000


def shared_ids(spark):
    """Many different texts without id or with one id, copies of some of them, under the same and under other ids."""
    rng = random.Random(13)
    texts = [prose(rng, 40) for _ in range(30)]
    rows = [(None, t) for t in texts[:12]] + [(7, t) for t in texts[12:24]] + [(k, t) for k, t in enumerate(texts[24:])]
    rows += [(None, texts[0]), (7, texts[12]), (None, texts[13]), (7, texts[1]), (900, texts[2]), (3, texts[14])]
    return texts, spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(4)


def test_different_texts_of_one_id_stay(spark):
    texts, docs = shared_ids(spark)
    for kept in (exact.without_exact_duplicates(docs), neardup.without_near_duplicates(docs, percent=80)):
        rows = kept.collect()
        assert sorted(r.text for r in rows) == sorted(texts)
        owner = {r.text: r.doc_id for r in rows}
        assert owner[texts[0]] is None and owner[texts[12]] == owner[texts[13]] == owner[texts[1]] == 7
        assert owner[texts[2]] == 900 and owner[texts[14]] == 3
        assert {r.n for r in rows if r.text in (texts[0], texts[12])} == {0, 12}


@pytest.mark.parametrize("operator", [lines.without_repeated_lines, lines.without_repeated_runs])
def test_lines_of_rows_that_share_an_id(spark, operator):
    """What repeats in one text of an id is cut from no other text of it, and equal places without id are told apart."""
    rng = random.Random(14)
    block = "\n".join("é日\U0001f642 " + prose(rng, 5) for _ in range(9)) + "\n"
    rows = [(1, block + "eins\n")]
    for i in (None, 7):
        rows += [(i, block + f"{prose(rng, 4)} ß\n" * 1), (i, "".join(f"{'ä日' * rng.randint(1, 9)} {prose(rng, 6)}\n" for _ in range(12)))]
    fresh = "\n".join("ö " + prose(rng, 5) for _ in range(9)) + "\n"
    rows += [(None, fresh + "a"), (None, fresh + "b"), (None, fresh + "b")]
    got = collected(operator(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    kept = [r["text"] for r in got]
    assert len(got) == len(rows) and all(t in kept for i, t in rows if block not in t and fresh not in t) and rows[0][1] in kept
    assert sum(fresh in t for t in kept) == 1 and sum(block in t for t in kept) == 1


def test_cuts_by_pieces_are_those_of_the_whole_and_take_little_memory():
    rng = random.Random(4)
    data = prose(rng, 200000).encode()
    assert len(data) > 3 * exact.STEP_BYTES
    gear = exact._GEAR.astype(np.uint64)[np.frombuffer(data, np.uint8)]
    rolling = sum(np.concatenate([np.zeros(j, np.uint64), gear[:len(gear) - j]]) << np.uint64(j) for j in range(16)) & np.uint64(0xFFFFFFFF)
    cuts = set((np.flatnonzero(rolling >> np.uint64(32 - exact.RARE_BITS) == 0) + 1).tolist())
    want, at = [], 0
    while at < len(data):
        at = next((k for k in range(at + exact.LEAST_CHUNK, min(at + exact.MOST_CHUNK, len(data))) if k in cuts), min(at + exact.MOST_CHUNK, len(data)))
        want.append(at)
    tracemalloc.start()
    try:
        assert exact.chunk_ends([data[:100], b"", data]) == [[100], [], want]
        assert tracemalloc.get_traced_memory()[1] < 5 * len(data)
    finally:
        tracemalloc.stop()
