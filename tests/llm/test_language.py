import numpy as np

from flowsieve.llm import language as L

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = L.op6_language_id(spark, FOLDER).toPandas()
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) == len(both)
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert both.score.between(0, 1).all()


def test_vectors_are_sums_of_bound_letters():
    enc = L.Encoder()
    v = enc.vector("ab ab")
    a, b, s = (enc.letter(ord(c)) for c in "ab ")
    want = sum(np.sqrt(2) * np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in [(s, a, b), (a, b, s)]) + np.roll(b, 2) * np.roll(s, 1) * a
    assert np.allclose(v, want / np.linalg.norm(want), atol=1e-5)


def test_awkward_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "el gato y el perro", "es", 1), (3, None, "en", 1), (4, "12 34 !", "es", 1), (5, "the dog", None, 1), (6, "the dog", None, 1), (None, "perro", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = {(r.doc_id, r.lang_pred) for r in L.predict(docs, docs).collect()}
    assert out == {(1, "en"), (2, "es"), (3, "und"), (4, "und"), (5, "en"), (6, "en"), (None, "es")}
    kept = L.keep_known(docs, docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert {r.lang_pred for r in L.predict(docs, docs.where("false")).collect()} == {"und"}
    assert L.predict(docs.where("false"), docs).count() == 0
