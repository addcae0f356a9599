import hashlib

import numpy as np
import pytest

from flowsieve.llm import fingerprints as fp

FOLDER = "/root/testdata/sf0.001"


def check(rows, got):
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = {}
    for k, (doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1] or ""
        text = text or ""
        cut = len(text) // 3
        new = text[: len(text) - cut] + following[:cut]
        a, b, n = fp.sketch(text), fp.sketch(new), fp.sketch(following)
        want[doc_id] = (len(text), hashlib.sha256(new.encode()).hexdigest(), fp.pack(a), fp.pack(b), fp.likeness(a, b), fp.likeness(a, n))
    assert {r.doc_id: tuple(r)[1:7] for r in got} == want and len(got) == len(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, fp.op7_fingerprints(spark, FOLDER).collect())


def test_awkward_rows(spark):
    rows = [(5, None), (4, ""), (3, "a b"), (2, "word " * 500), (1, "a b"), (None, "é" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", fp.F.lit("clash"))
    check(rows, fp.fingerprints(docs).collect())
    assert fp.fingerprints(docs.where("false")).count() == 0
    check(rows[2:3], fp.fingerprints(docs.where("doc_id = 3")).collect())


@pytest.mark.parametrize("size", [2, 3, 10, 60, 5000])
@pytest.mark.parametrize("share", [0.3, 0.8])
def test_likeness_is_close_to_jaccard(size, share):
    rng = np.random.default_rng(size)
    error = []
    for _ in range(2000 if size < 60 else 60):
        x = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
        k = round(size * 2 * share / (1 + share))
        a, b = x[:size], np.concatenate([x[:k], x[size : 2 * size - k]])
        same = (fp.low_bits(fp.bins(a)) == fp.low_bits(fp.bins(b))).mean()  # not cut to [0, 1], which would shift the mean
        error.append((same - 2.0**-fp.BITS) / (1 - 2.0**-fp.BITS) - k / (2 * size - k))
    assert abs(np.mean(error)) < 0.03


def test_packing_is_exact():
    low = fp.sketch("some words that make a few shingles here")
    assert (fp.unpack(fp.pack(low)) == low).all()


def test_every_full_bin_is_as_likely():
    assert all((np.sort(order) == np.arange(fp.BINS)).all() for order in fp.BORROWED)
    h = np.random.default_rng(1).integers(0, 2**63, 3).astype(np.uint64)
    count = np.zeros(3)
    for k in range(300):
        out = fp.bins(h + np.uint64(k))
        count += [(out == v).sum() for v in fp.mix((h + np.uint64(k)) ^ np.uint64(0xA5A5F00D))]
    assert (abs(count / count.sum() - 1 / 3) < 0.03).all()


def test_repeated_ids(spark):
    rows = [(7, "a b c"), (7, "a b c"), (7, "x y"), (None, "x y"), (None, None)] + [(3, f"text {k}") for k in range(40)]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (-(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = [(i, len(t or ""), hashlib.sha256(fp.edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(want, key=repr)
