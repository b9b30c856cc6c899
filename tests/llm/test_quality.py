"""Quality rules and line labels."""

import itertools

import numpy as np
import pyarrow as pa

from lakewright.llm import quality
from tests.llm.helpers import WORD, by_id, collected

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k:k + 8]), []).append(k)
    covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_base_counts(documents, odd):
    for rows in (documents.collect(), odd.collect()):
        found = quality.measure(pa.array([r.text for r in rows], pa.string()))
        got = np.array([getattr(found, c) for c in BASE]).T.tolist()
        assert got == [plain(r.text) for r in rows]
        assert found.base_failed.tolist() == [w < 20 or 100 * r > 30 * w for w, _, _, _, r in got]


def test_lines_are_cut_alike_alone_and_together(documents):
    texts = [r.text for r in documents.collect()][:60]
    whole = quality.measure(pa.array(texts))
    for k, text in enumerate(texts):
        alone = quality.measure(pa.array([text]))
        assert (whole.features[whole.line_row == k] == alone.features).all()
        assert [text.encode()[a:b].decode() for a, b in zip(alone.line_begin, alone.line_end)] == [x for x in text.split("\n") if WORD.search(x)]


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(4)
    for _ in range(40):
        field = quality.LineField(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
        sizes = rng.integers(1, 7, 3)
        features, rows = rng.normal(size=(sizes.sum(), 3)), np.repeat([0, 2, 5], sizes)
        got = field.label(features, rows)
        for row in (0, 2, 5):
            s = features[rows == row] @ field.emit
            score = {p: sum(s[t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
                     for p in itertools.product((0, 1), repeat=len(s))}
            assert tuple(got[rows == row]) == max(score, key=score.get)


def test_training_raises_the_likelihood_of_the_labels():
    rng = np.random.default_rng(5)
    labels = np.repeat(rng.integers(0, 2, 80)[:, None], 6, axis=1)
    features = np.concatenate([np.ones((80, 6, 1)), (labels ^ (rng.random((80, 6)) < 0.3))[:, :, None]], axis=2)
    used = (np.arange(6) < rng.integers(1, 7, 80)[:, None]).astype(float)
    field = quality.train(features, labels, used, steps=80)
    assert field.move[0, 0] > field.move[0, 1] and field.move[1, 1] > field.move[1, 0]
    flat = used.ravel() > 0
    got = field.label(features.reshape(-1, 2)[flat], np.repeat(np.arange(80), 6)[flat])
    alone = features.reshape(-1, 2)[flat][:, 1]
    assert np.mean(got == labels.ravel()[flat]) > np.mean(alone == labels.ravel()[flat]) + 0.05


def test_held_out_verdicts(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.where("doc_id % 2 = 0")
    rows = by_id(quality.assess(documents, quality.fit(documents, known)))
    held = [(rows[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    good = [r["kept"] for r, q in held if q and not r["base_failed"]]
    bad = [r["kept"] for r, q in held if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25
    assert not any(r["kept"] and r["base_failed"] for r in rows.values())


def test_odd_rows(odd, nothing, documents, labels):
    field = quality.fit(documents, labels)
    rows = collected(quality.assess(odd, field, carry=["kept", "size"]).select("doc_id", "n_words", "base_failed", "size"))
    assert len(rows) == odd.count()
    assert all(r["base_failed"] and not r["n_words"] for r in rows if r["doc_id"] in (0, 1, 2, 15))
    kept = quality.good_documents(odd, field)
    assert kept.columns == odd.columns and kept.count() < odd.count()
    assert collected(quality.assess(nothing, field)) == [] and quality.good_documents(nothing, field).count() == 0
    assert quality.fit(nothing, labels) is None and quality.fit(documents, labels.limit(0)) is None
    assert quality.fit(documents, labels.where("quality = 1")) is None
    assert sum(r["n_words"] >= 20 for r in rows) > 0
    lines = collected(quality.label_lines(odd.where("doc_id = 10"), field))
    text = odd.where("doc_id = 10").first().text.encode()
    assert sorted({text[r["begin"]:r["end"]] for r in lines}) == sorted(set(text.split(b"\n")))
