import numpy as np

from flowsieve.llm import toxicity as T

FOLDER = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    got = T.op4_toxicity(spark, FOLDER).toPandas()
    both = got[got.held_out].merge(spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas(), on="doc_id")
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count() and got.score.between(0, 1).all()
    bad, good = both[both.toxic == 1], both[both.toxic == 0]
    print(len(bad), (bad.score >= 0.5).mean(), (good.score >= 0.5).mean())
    assert (bad.score >= 0.5).mean() > 0.9 and (good.score >= 0.5).mean() < 0.02


def test_neighbours_are_exact(monkeypatch):
    monkeypatch.setattr(T, "FREQUENT", 12)  # the others are posting lists
    rng = np.random.default_rng(2)
    vectors, dense = [], np.zeros((700, 40))
    for k in range(700):
        at = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(at))
        dense[k, at] = w / np.linalg.norm(w)
        vectors.append((at, dense[k, at]))
    index = T.Index(list(range(700)), rng.integers(0, 2, 700), vectors, 40)
    assert (index.column >= 0).sum() == 12 and len(index.rows)
    for k, (at, w) in enumerate(vectors):
        rows, cosine = index.near(at, w, but=index.places[k])
        every = dense @ dense[k]
        every[k] = 0
        assert k not in [index.ids[r] for r in rows] and np.allclose(cosine, np.sort(every)[::-1][: T.NEAR], atol=2e-6)


def test_isotonic():
    x, y = T.isotonic(np.array([0.0, 1, 2, 3, 3]), np.array([0.0, 1, 0, 1, 0]))
    assert np.allclose(np.interp([0, 1, 2, 3], x, y), [0, 0.5, 0.5, 0.5])


def test_awkward_rows(spark):
    rows = [(k, "awful nasty words" if k % 3 == 0 else "kind and good words", "x") for k in range(60)] + [(100, None, "x"), (101, "", "x"), (None, "awful", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(50)] + [(1, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    model = T.fit(docs, T.examples(docs, labels, T.F.lit(True)))
    out = {r.doc_id: (r.predicted, r.evidence) for r in T.score(docs, model, ["doc_id"]).collect()}
    assert out[51][0] == 1 and out[52][0] == 0 and out[100] == (0, []) and out[101] == (0, []) and out[None][0] == 1
    assert all(e % 3 == 0 for e in out[51][1])
    none = T.fit(docs, T.examples(docs, labels.where("false"), T.F.lit(True)))
    assert {r.score for r in T.score(docs, none, ["doc_id"]).collect()} == {0.0}
    assert T.score(docs.where("false"), model, ["doc_id"]).count() == 0


def test_batched_queries_are_exact_and_few_examples_are_worked_out(monkeypatch):
    rng = np.random.default_rng(5)
    vectors, dense = [], np.zeros((2500, 60), np.float32)
    for k in range(2500):
        at = np.sort(rng.choice(60, rng.integers(8, 20), replace=False))
        w = rng.random(len(at))
        dense[k, at] = w / np.linalg.norm(w)
        vectors.append((at, dense[k, at].astype(float)))
    index = T.Index(list(range(2500)), rng.integers(0, 2, 2500), vectors, 60)
    worked, exact = [], T.Index._exact

    def counted(self, cosine, column, w, rows):
        worked.append(len(rows))
        return exact(self, cosine, column, w, rows)

    monkeypatch.setattr(T.Index, "_exact", counted)
    monkeypatch.setattr(T, "TOGETHER", 50)
    got = index.nearest([(*vectors[k], index.places[k]) for k in range(120)])
    for k, (rows, cosine) in enumerate(got):
        every = dense @ dense[k]
        every[k] = 0
        assert np.allclose(cosine, np.sort(every)[::-1][: T.NEAR], atol=2e-6) and np.allclose(every[[index.ids[r] for r in rows]], cosine, atol=2e-6)
    assert sum(worked) < 120 * 150  # bounds alone leave many hundreds open


def test_an_index_that_is_only_sent_on_holds_no_blocks():
    vectors = [(np.array([k % 5]), np.array([1.0])) for k in range(20)]
    index = T.Index(list(range(20)), np.zeros(20), vectors, 5, ready=False)
    sent = T.pickle.loads(T.pickle.dumps(index))
    assert not hasattr(index, "dense") and sent.dense.size
    assert all(np.array_equal(a, b) for a, b in zip(sent.near(*vectors[3]), index.near(*vectors[3])))
