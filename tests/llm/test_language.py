"""Language identification."""

import numpy as np
import zlib

from lakewright.llm import language
from tests.llm.helpers import by_id, collected


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    one = language.Recurrence.random(3, rng)
    x = rng.integers(0, 256, (5, 4))
    goal = rng.normal(size=(5, 4, 3))
    states, held = one.forward(x)
    table, loop = one.backward(x, held, goal)

    def loss():
        return float((one.forward(x)[0] * goal).sum())

    for weights, grad, places in ((one.loop, loop, [(0, 0), (2, 5), (1, 8)]), (one.table, table, [(x[0, 0], 1), (x[4, 3], 7), (x[2, 1], 4)])):
        for at in places:
            before = weights[at]
            weights[at] = before + 1e-5
            high = loss()
            weights[at] = before - 1e-5
            low = loss()
            weights[at] = before
            assert abs((high - low) / 2e-5 - grad[at]) < 1e-3 * max(1, abs(grad[at]))


def test_packed_network_labels_as_the_trained_one_does():
    rng = np.random.default_rng(2)
    net = language.Network(["a", "b"], language.Recurrence.random(4, rng), language.Recurrence.random(4, rng), rng.normal(size=(8, 2)), rng.normal(size=2))
    x = rng.integers(0, 256, (7, language.WINDOW)).astype(np.uint8)
    both = np.concatenate([net.onward.forward(x.T)[0], net.back.forward(x.T[::-1])[0][::-1]], axis=2) @ net.out + net.bias
    want = np.exp(both) / np.exp(both).sum(axis=2, keepdims=True)
    for part, got in language.position_probabilities(net.packed(), x, 3):
        assert np.allclose(got, want[:, part], atol=1e-4)


def test_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language.fit(documents, per_language=120, steps=160)
    rows = by_id(language.identify(documents, network).withColumn("held_out", language.held_out()))
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    held = [k for k, r in rows.items() if r["held_out"]]
    assert np.mean([rows[k]["lang_pred"] == truth[k] for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and abs(sum(r["shares"].values()) - 1) < 1e-6 for r in rows.values())


def test_odd_rows(odd, nothing):
    network = language.fit(odd, steps=3)
    assert network.languages == ["de", "en"]
    rows = collected(language.identify(odd, network))
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (0, 1, 2, 12345):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in rows if r["doc_id"] == 16} == {"und"}
    assert language.fit(nothing) is None
    assert {r["lang_pred"] for r in collected(language.identify(odd, None))} == {"und"}
    assert language.identify(nothing, network).count() == 0


def test_a_window_does_not_depend_on_its_batch():
    rng = np.random.default_rng(3)
    net = language.Network(["a", "b"], language.Recurrence.random(4, rng), language.Recurrence.random(4, rng), rng.normal(size=(8, 2)), rng.normal(size=2))
    data = rng.integers(97, 120, 1000).astype(np.uint8)
    whole, length, row = language.cut_windows(data, np.array([0, 300, 300, 1000]))
    assert row.tolist() == [0] * 3 + [2] * 6 and length.sum() == 1000
    alone = language.cut_windows(data[300:], np.array([0, 700]))[0]
    assert (whole[3:] == alone).all()
