import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from concord.llm import gru
from concord.llm.toxicity_gru import STRIDE, WINDOW, Network, best_cut, features, op7_bigru_attention, pick_rows, score_texts, toxicity, train, window_index, without_toxic

FEW = (60, 40, 40)


def made_up(n, seed):
    rng = random.Random(seed)
    stem = lambda: "".join(rng.choice(("ka", "lo", "mi", "ru", "te")) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        w = [stem() for _ in range(rng.randrange(20, 150))]
        if i % 6 == 0:
            w[rng.randrange(len(w))] = "vexo" + stem()  # an unseen form of a known stem
        out.append((" ".join(w), int(i % 6 == 0)))
    return out


def auc(score, label):
    a, b = score[label == 1][:, None], score[label == 0]
    return float((a > b).mean() + 0.5 * (a == b).mean())


def test_held_out_documents_and_unseen_forms():
    net = train([(t.encode(), y) for t, y in made_up(400, 1)], FEW)
    test = made_up(200, 2)
    score, label = np.array(score_texts(net, [t.encode() for t, _ in test])), np.array([y for _, y in test])
    assert auc(score, label) > 0.95
    assert ((score >= 0.3) == label).mean() > 0.9


def test_every_window_counts():
    net = train([(t.encode(), y) for t, y in made_up(400, 1)], FEW)
    long = "kalo mi " * 20000
    low, high = score_texts(net, [long.encode(), (long + "vexoka " + long).encode()])
    assert high > low
    for n in (0, 1, 15, 16, 17, 24, 25, 100):
        at = window_index(n)
        assert at.shape[1] == WINDOW and set(range(n)) <= set(at.ravel().tolist()) and (np.diff(at[:, 0]) == STRIDE).all()


def test_query_returns_every_document_and_holds_labels_back(spark, sf, monkeypatch):
    monkeypatch.setattr("concord.llm.toxicity_gru.STEPS", FEW)
    got = {r["doc_id"]: r for r in toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), steps=FEW).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(got) == {r["doc_id"] for r in docs} and op7_bigru_attention.__name__.startswith("op7_")
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    # labels of held-out rows change nothing
    flipped = spark.read.parquet(f"{sf}/labels.parquet").withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity(spark.read.parquet(f"{sf}/documents.parquet"), flipped, steps=FEW).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())


def test_odd_rows(spark, docs_of):
    pairs = [(1, None), (2, ""), (3, "x" * 50000), (4, "same text"), (4, "same text"), (None, "no id"), (5, "é ñ \U0001f600")]
    docs = docs_of(pairs, {"score": "clash", "row": 1})
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(2, 1), (3, 0), (4, 0), (None, 1), (5, None), (1, 1), (9, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(docs, none).collect()} == {0.0}
    got = toxicity(docs, some, steps=(3, 2)).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    kept = without_toxic(docs, some, steps=(3, 2))
    assert kept.dtypes == docs.dtypes and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity(docs_of([]), some).count() == 0


def test_features_of_some_words_are_those_of_the_words():
    ws = [b"a", b"word", b"longer-word", b"\xc3\xa9"]
    found = features(ws)
    for k, w in enumerate(ws):
        for a, b in zip(pick_rows(found, np.array([k])), features([w])):
            assert a.tolist() == b.tolist()


def test_gradients_of_the_recurrent_layer():
    rng = np.random.default_rng(3)
    x, u, h, d = (rng.standard_normal(s).astype(np.float32) for s in ((5, 3, 12), (4, 12), (3, 4), (5, 3, 4)))
    states, kept = gru.run_kept(x, u, h)
    assert np.allclose(states, gru.run(x, u, h), atol=1e-5)
    dx, du = gru.back(d, kept, u)
    for array, grad, at in ((x, dx, (1, 2, 5)), (x, dx, (3, 0, 9)), (u, du, (2, 1)), (u, du, (3, 10))):
        old, e = array[at], 1e-2
        sides = []
        for s in (e, -e):
            array[at] = old + s
            sides.append(float((gru.run(x, u, h) * d).sum()))
        array[at] = old
        assert abs((sides[0] - sides[1]) / (2 * e) - grad[at]) < 2e-2


def test_best_cut_lies_between_the_labels():
    assert best_cut(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])) == 1.5
    assert Network().shift == 0.0
