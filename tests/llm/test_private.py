"""Personal data."""

import hashlib
import math
import random
import re

import pytest

from lakewright.llm import private
from tests.llm.helpers import by_id, collected, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_patterns():
    rng = random.Random(15)
    bits = ["a.b@c.d", "x_y", "@", "@@", ".", "-", "+1", " (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "256.1.1.1", "0001.2.3.4",
            "1.2.3.4.5.6.7.8", " ", "é", "word", "+", "0", "99999999999999999999", "378282246310005", "a@b", "a@b.c_d@e.f", "%+-._@x.y-z.q"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert [f"{k}:{a}:{b}" for k, a, b in private.mentions(text)] == plain(text), text


def test_documents(documents):
    rows = by_id(private.private_spans(documents))
    for r in documents.collect():
        want = plain(r.text)
        got = rows[r.doc_id]
        assert got["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got["spans"].split(",")[:len(want)] == want if want else not re.search("email|ip|card|phone", got["spans"])
        assert [got[f"n_{k}"] for k in private.KINDS] == [sum(s.startswith(k) for s in want) for k in private.KINDS]


def secrets(spark):
    """A nickname stands beside one address again and again; common words do too, but elsewhere as well."""
    rng = random.Random(16)
    rows = []
    for k in range(60):
        text = prose(rng, 30) + " common " + prose(rng, 30)
        if k % 6 == 0:
            text += f" write common Zorbulax {prose(rng, 2)} to zed@hidden.example.org please " + prose(rng, 20)
        if k % 7 == 0:
            text += " see +1 555 123 4567 common " + prose(rng, 9)
        rows.append((k, text))
    rows += [(100, "It was Zorbulax, they say"), (101, "ZORBULAX! é zorbulax@mail.org common")]
    rows += [(200 + k, f"copy of quibberish words beside one@copy.example.org {prose(random.Random(1), 20)}") for k in range(9)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def plain_terms(rows, support, most):
    word = re.compile("[A-Za-z\u0080-\U0010ffff]+")
    beside, both, places, count = {}, {}, {}, {}
    for _, text in rows:
        found = [(m.start(), m.end(), re.sub("[A-Z]", lambda x: x.group().lower(), m.group())) for m in word.finditer(text)]
        found = [t for t in found if len(t[2].encode()) >= 4]
        for _, _, t in found:
            count[t] = count.get(t, 0) + 1
        spans = [(kind, int(a), int(b)) for kind, a, b in (s.split(":") for s in plain(text))]
        # Terms that share a place with a mention stand beside none.
        free = [t for t in found if not any(t[0] < b and a < t[1] for _, a, b in spans)]
        occurrences = {}
        for kind, a, b in spans:
            value = text[a:b]
            entity = (kind, value.lower() if kind == "email" else re.sub("[^0-9]", "", value))
            near = [t for t in free if t[1] <= a][-8:] + [t for t in free if t[0] >= b][:8]
            occurrences.setdefault(entity, set()).update(near)
            for _, _, t in near:
                places.setdefault((entity, t), set()).add(tuple(t for _, _, t in near))
        for entity, near in occurrences.items():
            beside[entity] = beside.get(entity, 0) + len(near)
            for _, _, t in near:
                both[entity, t] = both.get((entity, t), 0) + 1
    total = sum(count.values())
    assert all(n <= count[t] for (_, t), n in both.items())
    return {(e, t): 1 - math.log2(n / count[t]) / math.log2(beside[e] / total) for (e, t), n in both.items() if len(places[e, t]) >= support
            and 1 - math.log2(n / count[t]) / math.log2(beside[e] / total) >= most}


@pytest.mark.parametrize("sent", [private.SENT_TERMS, 0])
def test_terms_that_reveal(spark, sent):
    rows, docs = secrets(spark)
    want = {t for _, t in plain_terms(rows, private.LEAST_SUPPORT, private.MOST_DISCLOSED)}
    assert "zorbulax" in want and "common" not in want and "quibberish" not in want
    got = by_id(private.private_spans(docs, sent_terms=sent))
    for k, text in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in plain(text)]
        terms = [(m.start(), m.end()) for m in re.finditer("[A-Za-z\u0080-\U0010ffff]+", text) if m.group().lower() in want]
        terms = [t for t in terms if not any(t[0] < b and a < t[1] for a, b in base)]
        assert got[k]["spans"] == ",".join(plain(text) + [f"term:{a}:{b}" for a, b in terms])
        assert got[k]["n_term"] == len(terms)


def test_sanitised_texts(spark):
    rows, docs = secrets(spark)
    got = {r["doc_id"]: r["text"] for r in collected(private.sanitised(docs))}
    assert got[100] == "It was [TERM], they say" and got[101] == "[TERM]! é [EMAIL] common"
    assert not any(re.search("zorbulax|@", t, re.I) for t in got.values())


def test_odd_rows(odd, nothing):
    rows = collected(private.private_spans(odd))
    assert len(rows) == odd.count()
    assert {(r["n_email"], r["n_ip"]) for r in rows if r["doc_id"] == 14} == {(1, 1)}
    assert all(r["spans"] == "" for r in rows if r["doc_id"] in (0, 1, 2))
    assert private.private_spans(nothing).count() == 0 and private.sanitised(nothing).count() == 0
    texts = sorted((str(r["doc_id"]), r["text"]) for r in collected(private.sanitised(odd)))
    assert texts == sorted((str(r.doc_id), re.sub(r"Bob.X@mail.example.org", "[EMAIL]", (r.text or "").replace("10.0.0.255", "[IP]"))) for r in odd.collect())


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" + " " * 200_000, "1.2." * 60_000, "a@" * 100_000):
        private.mentions(text)


@pytest.mark.parametrize("sent", [private.SENT_TERMS, 0])
def test_short_names_and_identifiers_reveal(spark, sent):
    """A name of three letters and identifiers with digits stand beside one address again and again."""
    rng = random.Random(17)
    rows = [(k, f"{prose(rng, 30)} it {prose(rng, 9)} no 12 {prose(rng, 9)}") for k in range(80)]
    rows += [(100 + k, f"{prose(rng, 20)} it Kim jd42 12 {prose(rng, 2)} to zed@hidden.example.org, A1773 {prose(rng, 20)}") for k in range(9)]
    rows += [(200, "so Kim, jd42 it is, 12 a1773.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(private.private_spans(docs, sent_terms=sent, kinds=private.EVERY))
    flagged = [rows[-1][1][int(a):int(b)] for _, a, b in (x.split(":") for x in got[200]["spans"].split(","))]
    assert {"Kim", "jd42", "a1773"} <= set(flagged) and not {"it", "12"} & set(flagged)
    assert got[200]["n_term"] == len(flagged)
    assert by_id(private.private_spans(docs))[200]["spans"] == ""


def test_an_occurrence_counts_once_however_many_mentions_stand_beside_it(spark):
    """Three mentions of one address in a row; a word beside it in a third of the documents that hold it."""
    rng = random.Random(18)
    rows = [(k, f"{prose(rng, 12)} our project write to a@x.com, a@x.com or a@x.com {prose(rng, 12)}") for k in range(4)]
    rows += [(10 + k, f"{prose(rng, 12)} another project here {prose(rng, 12)}") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for kinds in (private.LONG, private.EVERY):
        found = collected(private.revealing_terms(docs, kinds=kinds, most=0.0))
        assert found and all(r["disclosure"] <= 1 + 1e-12 for r in found)
        got = by_id(private.private_spans(docs, kinds=kinds))
        assert all(got[k]["spans"] == "" for k, _ in rows[4:])
    want = plain_terms(rows, private.LEAST_SUPPORT, 0.0)
    scores = sorted(r["disclosure"] for r in collected(private.revealing_terms(docs, most=0.0)))
    assert scores == pytest.approx(sorted(want.values()))


def test_counts_that_a_task_gives_out_in_parts(spark, monkeypatch):
    rows, docs = secrets(spark)
    want = by_id(private.private_spans(docs))
    monkeypatch.setattr(private, "HELD_TERMS", 3)
    assert by_id(private.private_spans(docs)) == want


def test_many_mentions_and_hits_in_one_text(spark):
    """Time grows with the length of a text, not with mentions times hits."""
    rng = random.Random(19)
    text = " ".join(f"Zorbulax u{k}@mail{k}.org" for k in range(30000))
    rows = [(k, f"{prose(rng, 20)} Zorbulax zed@hidden.org {prose(rng, 20)}") for k in range(9)] + [(100, text)]
    got = by_id(private.private_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[100]["n_email"] == 30000


def test_spans_that_overlap_are_merged_for_the_look_up():
    starts, ends = private._merged([("a", 5, 9), ("b", 0, 2), ("c", 8, 12), ("d", 12, 13)])
    assert list(zip(starts.tolist(), ends.tolist())) == [(0, 2), (5, 12), (12, 13)]
    begin, stop = private.np.array([0, 2, 3, 4, 11, 13]), private.np.array([1, 5, 5, 6, 12, 20])
    assert private._outside((starts, ends), begin, stop).tolist() == [False, True, True, False, False, True]
