import math
from collections import Counter

import numpy as np

from flowsieve.llm import toxicity as T

FOLDER = "/root/testdata/sf0.01"


def test_scores_equal_a_plain_replay(spark):
    """All documents against all examples, with dictionaries and no index."""
    docs, labels = T.table(spark, FOLDER, "documents"), T.table(spark, FOLDER, "labels")
    sample = T.examples(docs, labels, T.fold(labels, 5) != 0)
    model = T.fit(docs, sample)
    got = {r.doc_id: r for r in T.score(docs, model, ["doc_id"]).collect()}

    every = {r.doc_id: Counter(T.WORD.findall((r.text or "").lower())) for r in docs.select("doc_id", "text").collect()}
    toxic = {r.doc_id: r.toxic for r in sample.collect()}
    n = len(every)
    df = Counter(w for c in every.values() for w in c)
    bad, good = (Counter(w for i, y in toxic.items() if y == v for w in every[i]) for v in (1, 0))
    odds = (len(toxic) - sum(toxic.values())) / sum(toxic.values())

    def vector(counts, own=None):
        w = {}
        for t, c in counts.items():
            known = bad[t] + good[t] > 0
            b, g = bad[t] - (own == 1), good[t] - (own == 0)
            seen = df[t] if known else 0
            w[t] = (1 + math.log(c)) * (math.log((n + 1) / (seen + 1)) + 1) * (math.log2(2 + (b if known else 0) * odds / max(g, 1)) ** T.POWER)
        size = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / size for t, v in w.items()} if size else {}

    vectors = {i: vector(every[i]) for i in toxic}
    order = [i for i in model.index.ids]
    assert sorted(order) == sorted(i for i in toxic if every[i])

    def vote(v, but=None):
        near = sorted(((-round(sum(x * vectors[i].get(t, 0.0) for t, x in v.items()), 6), k, i) for k, i in enumerate(order) if i != but))[: T.NEAR]
        near = [(-c, i) for c, _, i in near if c < 0]
        total = sum(c for c, _ in near)
        return sum(c * toxic[i] for c, i in near) / (total + T.SHRINK), [i for _, i in near[:5]]

    own = [(vote(vector(every[i], toxic[i]), i)[0], toxic[i]) for i in order]
    knots = T.isotonic(np.array([v for v, _ in own]), np.array([y for _, y in own]))
    for i, counts in every.items():
        v, evidence = vote(vector(counts)) if counts else (0.0, [])
        if evidence:
            assert abs(got[i].score - min(1.0, 0.98 * np.interp(v, *knots) + 0.02 * v)) < 1e-3 and set(got[i].evidence) == set(evidence), i
        else:
            assert got[i].score == model.blank and got[i].evidence == []


def test_every_text_with_a_known_word_has_evidence(spark):
    docs, labels = T.table(spark, FOLDER, "documents"), T.table(spark, FOLDER, "labels")
    model = T.fit(docs, T.examples(docs, labels, T.fold(labels, 5) != 0))
    for r in docs.select("text").collect():
        assert bool(model.score(r.text)[1]) == any(w in model.weights.words for w in T.words_of(r.text))


def test_long_words_are_read_whole(spark):
    one, two = "q" * 70 + "mild", "q" * 70 + "vile"
    docs = spark.createDataFrame([(k, two if k % 2 else one) for k in range(40)] + [(99, "x " * 300_000 + two)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    model = T.fit(docs, T.examples(docs, labels, T.F.lit(True)))
    assert model.score(one)[0] < 0.5 < model.score(two)[0]
    assert T.score(docs, model, ["doc_id"]).count() == 41


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(k % 20, "awful" if k % 2 else "kind", 0.5, 1, "x") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, evidence string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    out = T.score(docs, T.fit(docs, T.examples(docs, labels, T.F.lit(True))), ["doc_id"])
    assert out.columns == ["doc_id", "score", "predicted", "evidence"]
    assert {(r.doc_id, r.predicted) for r in out.collect()} == {(k, k % 2) for k in range(20)} and out.count() == 60


def test_words_are_the_matches_of_the_pattern():
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x20000)))
    mixed = ["Ça va_bien, 3x naïve ÜBER ß ½ ², 漢字 x́y İi", "", None, "a\nb\tc\x1cd\x85e f", every, "".join(f"{chr(0x2500 + k)}w{chr(0xE9)}" for k in range(200))]
    mixed += [every[k : k + 40] for k in range(0, len(every), 37)]
    assert all(T.words_of(t) == T.WORD.findall((t or "").lower()) for t in mixed)
    texts = ["so, (it) is: one-two; three." * 40] * 50
    calls = []
    T.LETTERS.clear()

    class Counting:
        match = staticmethod(T.WORD.match)

        def findall(self, text):
            calls.append(text)
            return []

    pattern, T.WORD = T.WORD, Counting()
    try:
        assert all(T.words_of(t) for t in texts) and not calls  # plain prose does without the pattern
    finally:
        T.WORD = pattern


def test_queries_of_like_terms_meet_the_examples_together(monkeypatch):
    rng = np.random.default_rng(3)
    # Two languages that share no word, in turn; each has a word that is in all of its texts.
    tongues = [[c + chr(97 + k % 26) + chr(97 + k // 26) for k in range(300)] for c in "xy"]
    rows = [" ".join([("xthe", "ythe")[k % 2], *rng.choice(tongues[k % 2], 40)]) for k in range(400)]
    counts = Counter(w for t in rows for w in set(T.words_of(t)))
    words = sorted(counts)
    seen = np.array([counts[w] for w in words])
    weights = T.Weights(words, np.append(seen, len(rows)), seen // 2, seen - seen // 2, 1.0)
    vectors = [weights.vector(t) for t in rows]
    index = T.Index(list(range(400)), np.arange(400) % 3 == 0, vectors, len(words))
    queries = [(*v, ()) for v in vectors[:40]]
    alone = [index.nearest([q])[0] for q in queries]
    met, batch = [], index._batch
    monkeypatch.setattr(T, "TOGETHER", 20)
    monkeypatch.setattr(index, "_batch", lambda own: met.append(own) or batch(own))
    for (rows_, cosines), (rows_alone, cosines_alone) in zip(index.nearest(queries), alone):
        assert rows_.tolist() == rows_alone.tolist() and cosines.tolist() == cosines_alone.tolist()
    assert [len(own) for own in met] == [20, 20]
    # Each batch has the terms of one language.
    assert not set(np.concatenate([q[0] for q in met[0]])) & set(np.concatenate([q[0] for q in met[1]]))
