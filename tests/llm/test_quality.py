import zlib

import numpy as np
import pyarrow as pa
import pytest

from flowsieve.llm import quality as Q


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def network(seed=0, prior=0.3):
    rng = np.random.default_rng(seed)
    return Q.Network({k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in Q.SHAPES.items()}, prior)


def plain_score(net, text):
    """The network written out position by position."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    data = list((text or "").encode())
    padded = data + [0] * Q.WIDTH
    answers = [sum(w["embed"][padded[i + k]] @ w["filters"][k * Q.EMBED : (k + 1) * Q.EMBED] for k in range(Q.WIDTH)) for i in range(len(data))]
    last = -(-(len(data) + Q.WIDTH - 1) // Q.HALF)
    chunks = []
    for c in range(max(1, last - 1)):
        inside = answers[c * Q.HALF : c * Q.HALF + Q.CHUNK]
        chunks.append(np.maximum(np.max(inside, axis=0) + w["bias"], 0) if inside else np.zeros(Q.FILTERS))
    hidden = np.max([np.maximum(c @ w["mix"] + w["mix_bias"], 0) for c in chunks], axis=0)
    return 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"][0] + net.prior)))


def test_scores_equal_the_plain_network_wherever_a_text_lies():
    net = network()
    texts = ["", None, "a", "ß" * 60, "word " * 25, "x" * (Q.HALF - Q.WIDTH + 1), "x" * (Q.HALF - Q.WIDTH + 2), "y" * Q.HALF, "ab" * Q.HALF, "one two. " * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = Q.score_texts(net, batch)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=2e-6)
    assert (Q.score_texts(net, batch.slice(4, 5)) == got[4:9]).all()


def test_gradient():
    net = network(3, 0.0)
    texts = [b"some words of a text " * 30, b"short", b"z" * 700]
    sizes = np.array([len(t) for t in texts])
    values, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    layout, target, weight = Q.Layout.of(values, starts, sizes), np.array([1.0, 0.0, 0.0]), np.array([0.2, 0.5, 0.3])
    weights = {k: v.astype(np.float32) for k, v in net.weights.items()}

    def loss():
        z = Q.logits(Q.Network(weights, 0.0), layout).astype(float)
        return float((weight * (np.log1p(np.exp(z)) - target * z)).sum())

    grad = Q._gradient(weights, layout, target, weight)
    rng = np.random.default_rng(1)
    for name, shape in Q.SHAPES.items():
        way = rng.normal(0, 1, shape).astype(np.float32)
        if name == "embed":
            way[[c for c in range(256) if c not in set(b"".join(texts))]] = 0
        step, keep = 2e-4, weights[name].copy()
        weights[name] = keep + step * way
        up = loss()
        weights[name] = keep - step * way
        down = loss()
        weights[name] = keep
        assert (up - down) / (2 * step) == pytest.approx(float((grad[name] * way).sum()), rel=0.05, abs=2e-3), name


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in Q.op11_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(out) == 1000 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    tested = [(out[d].score, q) for d, q in labels.items() if held(d)]
    good, bad = [s for s, q in tested if q == 1], [s for s, q in tested if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.5) == q for s, q in tested]) > 0.93


TYPES = "doc_id long, text string, held_out boolean"


def some_labels(spark):
    rows = [(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (2, 0, 0), (2, 1, 0), (2, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_nulls_repeats_long_texts_ids_of_other_types_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(Q, "EPOCHS", 1)
    known = {r.key: r.quality for r in Q.known_labels(some_labels(spark), Q.F.lit(True)).collect()}
    assert known == {str(k): 1 if k == 2 else k % 2 for k in range(40)}
    rows = [(k, f"text {k} " * 50, False) for k in range(40)] + [(1, "text 1 " * 50, False), (None, "text 1 " * 50, True), (None, None, True), (99, "", True), (98, "long text. " * 200_000, True)]
    wide = spark.createDataFrame([(*r, 1.0, "x") for r in rows], TYPES + ", score double, quality string")
    net = Q.fit(wide, some_labels(spark), Q.F.lit(True))
    out = Q.score(wide, net).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    scores = {}
    for r in out:
        scores.setdefault(r.doc_id, []).append(r.score)
    assert scores[1][0] == scores[1][1] in scores[None] and scores[99][0] in scores[None]
    named = spark.createDataFrame([(f"id{k}", t, h) for k, t, h in rows[:5]], TYPES.replace("long", "string"))
    assert [r.doc_id for r in Q.score(named, Q.fit(named, some_labels(spark), Q.F.lit(True))).collect()] == [f"id{k}" for k, *_ in rows[:5]]


def test_one_class_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a text", False), (2, None, False)], TYPES)
    labels = some_labels(spark)
    assert {r.score for r in Q.score(docs, Q.fit(docs, labels.where("false"), Q.F.lit(True))).collect()} == {0.5}
    ones = Q.fit(docs, labels.where("quality = 1 AND doc_id > 5"), Q.F.lit(True))
    assert {r.score for r in Q.score(docs, ones).collect()} == {round(18 / 19, 6)}
    assert Q.score(docs.where("false"), Q.fit(docs.where("false"), labels, Q.F.lit(True))).count() == 0


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE_BYTES", 1000)
    docs = spark.createDataFrame([(k, "x" * 300, False) for k in range(40)], TYPES)
    found = Q.sample_texts(docs, Q.known_labels(some_labels(spark), Q.F.lit(True))).collect()
    assert sorted(r.place for r in found) == [1, 2, 3] and all(len(r.text) == 300 for r in found)
