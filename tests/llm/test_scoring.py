import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from flowsieve.llm import scoring as S

FOLDER = "/root/testdata/sf0.01"


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = S.op1_lm_scoring(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in docs}
    c = Counter(w for k, t in docs.items() if not held[k] for w in [*S.tokens(t), S.END])
    total, distinct = sum(c.values()), len(c)
    gain = []
    for r in got:
        words = [*S.tokens(docs[r.doc_id]), S.END]
        base = sum(log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(c[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
        if r.held_out:
            gain.append((r.score, base))
    a, b = np.sum(gain, 0)
    print("held out: model", a, "base", b)
    assert a > b


def test_code_is_a_prefix_code_and_probabilities_add_up():
    code = S.Code(np.bincount(np.frombuffer(b"the quick brown fox jumps over the lazy dog " * 9, np.uint8), minlength=256).astype(float))
    assert abs(sum(2.0 ** -n for n in code.size) - 1) < 1e-9
    odds = np.random.default_rng(1).integers(-60, 60, S.START[-1]).astype(np.int8)
    pool = S.Pool(code, odds, np.full((S.GATES, S.ORDERS), 0.2), [b"the"])
    # All bytes that can follow the start of a word share out the probability one.
    total = 0.0
    for b in range(256):
        slots, bits, gate, _ = code.spread([b"\1" + bytes([b]) + b"q"])
        n = code.size[b]
        x = (odds[slots[:n]].astype(float) / S.SCALE) @ np.full(S.ORDERS, 0.2)
        total += np.prod(1 / (1 + np.exp(-np.where(bits[:n] > 0, 1, -1) * x)))
    assert abs(total - 1) < 1e-6
    # Documents do not influence each other.
    docs = [[(0, 1, b""), (-1, 0, b"fox"), (-1, 1, S.END)], [(-1, 2, b"dog")] * 400 + [(-1, 2, S.END)], [(-1, 0, S.END)], [(0, 1, b"")] * 9]

    def scores(docs):
        flat = [t for d in docs for t in d]
        return pool.scores(np.array([t[0] for t in flat]), np.array([t[1] for t in flat]), [t[2] for t in flat if t[0] < 0], np.array([len(d) for d in docs]))

    assert np.allclose(scores(docs), [scores([d])[0] for d in docs], rtol=1e-5)


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b a", "x"), (3, "a b a", "x"), (None, "word " * 30_000, "x"), (5, "é" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = S.score(docs, S.F.lit(False)).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 2, 4, 4, 30_001] and {r.train_tokens for r in out} == {30_013}
    assert all(r.n_known == r.n_tokens for r in out)
    out = S.score(docs, S.F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in out)
    assert S.score(docs.where("false"), S.F.lit(False)).count() == 0


def test_tasks_of_a_worker_share_the_common_words(monkeypatch):
    spread = []

    class Code(S.Code):
        def spread(self, words):
            spread.extend(words)
            return super().spread(words)

    class Shared:
        def __init__(self, value):
            self.value = value

    monkeypatch.setattr(S, "TaskContext", type("", (), {"get": staticmethod(lambda: type("", (), {"partitionId": lambda self: 0})())}))
    code = Code(np.bincount(np.frombuffer(b"fox over dog ", np.uint8), minlength=256).astype(float))
    odds = np.random.default_rng(1).integers(-60, 60, S.START[-1]).astype(np.int8)
    frequent = Shared(({b"fox": 0, b"dog": 1}, np.zeros(2), np.zeros((3, 0), np.float32)))
    run = S._scorer(Shared(code), Shared((odds, np.full((S.GATES, S.ORDERS), 0.2))), frequent)
    batch = S.pa.record_batch({"text": ["fox dog over fox", None], "doc_id": [1, 2], "held_out": [False, True]})
    one, two = ([s for out in run([batch]) for s in out.column("score").to_pylist()] for _ in range(2))
    assert one == two and spread.count(b"\0fox") == spread.count(b"\0dog") == 1


def test_word_order_counts(spark):
    rng = np.random.default_rng(5)
    words, follows = [f"w{k}" for k in range(40)], rng.permutation(40)

    def chain(start, n):
        out = [start]
        for _ in range(n - 1):
            out.append(int(follows[out[-1]]) if rng.random() < 0.9 else int(rng.integers(40)))
        return [words[k] for k in out]

    rows = [(k, " ".join(chain(int(rng.integers(40)), 60)), "x") for k in range(300)]
    texts = [chain(int(rng.integers(40)), 60) for _ in range(20)]
    rows += [(1000 + k, " ".join(t), "x") for k, t in enumerate(texts)] + [(2000 + k, " ".join(t[::-1]), "x") for k, t in enumerate(texts)]
    out = {r.doc_id: r.score for r in S.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), S.F.col("doc_id") >= 1000).collect()}
    assert all(out[1000 + k] > out[2000 + k] + 5 for k in range(20)), out
