import numpy as np

from flowsieve.llm import whitening as W

FOLDER = "/root/testdata/sf0.001"
TYPES = "vec_id long, embedding array<float>"


def check(df, vectors):
    """Compare with plain numpy; ``vectors`` are the usable ones by id."""
    out = df.toPandas()
    ids = sorted(vectors)
    x = np.floor(1024 * np.array([vectors[k] for k in ids], dtype=np.float32).astype(float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    k = min(8, x.shape[1])
    assert len(out) == n * k and set(out.n) == {n}
    deviation = ((n * x - total) ** 2).sum(1)
    assert (out[out.component == 1].set_index("vec_id").deviation.loc[ids].to_numpy() == deviation).all()
    y = x - total / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = y @ axes / np.sqrt(values)
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-6
    explained = out.groupby("component").explained.agg(["min", "max"])
    assert np.allclose(explained["min"], values / np.trace(y.T @ y / n), rtol=1e-9) and (explained["min"] == explained["max"]).all()
    assert out.identity_error.nunique() == 1
    assert np.isclose(out.identity_error[0], np.abs(got.T @ got / n - np.eye(k)).max(), atol=1e-9) and out.identity_error[0] < 1e-6


def test_given_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    check(W.op12_whitening(spark, FOLDER), {r.vec_id: r.embedding for r in rows})


def test_many_blocks_repeats_bad_rows_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS", 16)
    monkeypatch.setattr(W, "COLS", 4)
    rng = np.random.default_rng(3)
    good = {k: [float(v) for v in rng.normal(0, 1, 6) @ np.diag([5, 4, 3, 2, 1, 0.5])] for k in range(200)}
    good |= {k: list(good[7]) for k in range(200, 260)}
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(k, v, "a", 1) for k, v in [*good.items(), *bad]], TYPES + ", row string, component int")
    check(W.whiten(df.repartition(5)), good)


def test_null_and_repeated_ids_are_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (1, [3.0, 1.0]), (1, [0.0, 5.0])], TYPES)
    assert W.whiten(df).count() == 8


def test_no_variance_huge_values_and_empty(spark):
    same = W.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], TYPES)).toPandas()
    assert set(same.whitened) == {0.0} and set(same.explained) == {0.0} and set(same.identity_error) == {1.0} and set(same.deviation) == {0}
    huge = W.whiten(spark.createDataFrame([(0, [1e30, 0.0]), (1, [-1e30, 1.0])], TYPES)).toPandas()
    assert len(huge) == 4 and huge.deviation.isna().all()
    for rows in ([], [(1, None)], [(1, [])]):
        out = W.whiten(spark.createDataFrame(rows, TYPES))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
