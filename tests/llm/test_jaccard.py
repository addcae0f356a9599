import numpy as np
import pytest

from flowsieve.llm import jaccard as J


def plain(rows, rule):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = rule.width
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rule.den * len(sets[i] & sets[j]) >= rule.num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=repr)


def families(seed, n=40, copies=6):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 120))]
        for _ in range(rng.integers(1, copies)):
            w = list(base)
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = f"x{rng.integers(0, 9)}"
            if rng.random() < 0.3:
                w += ["tail", "of", "words"][: rng.integers(0, 4)]
            rows.append((int(rng.integers(0, 10**6)), " ".join(w)))
    return rows


def got(spark, rows, rule):
    return sorted([tuple(r) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()], key=repr)


@pytest.mark.parametrize("setting", ["plain", "small blocks", "hard"])
def test_equals_all_pairs(spark, monkeypatch, setting):
    if setting == "small blocks":
        monkeypatch.setattr(J, "BLOCK_ROWS", 3)
        monkeypatch.setattr(J, "DELEGATES", 2)
    if setting == "hard":
        keys_of = J.keys_of
        monkeypatch.setattr(J, "keys_of", lambda s, rule: (keys_of(s, rule)[0][:0], True))
        monkeypatch.setattr(J, "HARD_BLOCK", 30)
    rows, rule = families(4), J.Rule()
    assert got(spark, rows, rule) == plain(rows, rule)


def test_large_family_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    assert got(spark, rows, J.Rule()) == plain(rows, J.Rule())


def test_other_rule(spark):
    rows, rule = families(5), J.Rule(80, 100, 5)
    assert got(spark, rows, rule) == plain(rows, rule)


def test_keys_meet_for_linked_sets():
    rng, rule = np.random.default_rng(1), J.Rule()
    for size in [5, 9, 10, 18, 40, 90, 300, 900]:
        for _ in range(40):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            d = rule.differ(size)
            drop = rng.integers(0, d + 1)
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, d - drop).astype(np.uint64)])
            if rule.linked(len(np.intersect1d(a, b)), len(a), len(b)) and d:
                (ka, ha), (kb, hb) = J.keys_of(np.sort(a), rule), J.keys_of(np.sort(b), rule)
                assert len(np.intersect1d(ka, kb)) or ha or hb


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (4, "a b"), (None, "a b"), (5, "a b c d"), (5, "x y z w"), (6, "long " * 40_000), (7, "long " * 30_000)]
    assert got(spark, rows, J.Rule()) == plain(rows, J.Rule())
    assert got(spark, [], J.Rule()) == []
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, node string")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 5, 6]
