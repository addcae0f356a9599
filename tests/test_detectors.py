import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import planted
from pyspark.sql import functions as F

from flowsieve import session
from flowsieve.operators import iforest, joins, knn, lof, ocsvm
from flowsieve.operators.ocsvm import boundary_score, fit_boundary
from flowsieve.plans.report import build_report


def rows_of(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>").repartition(parts)


def brute_lof(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, -1)
    near = np.argsort(d, axis=1, kind="stable")[:, 1:k + 1]
    dist = np.take_along_axis(d, near, 1)
    kd = dist[:, -1]
    lrd = 1 / (np.maximum(kd[near], dist).mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


def check_lof(spark, x, k=20, block_rows=None, parts=3):
    got = {r["id"]: r["lof"] for r in lof.lof_scores(rows_of(spark, x, parts), "id", "x", k, block_rows).collect()}
    want = brute_lof(x, lof.neighbour_count(len(x), k))
    assert len(got) == len(x)
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-9)


def test_lof_small_and_blocked(spark):
    check_lof(spark, planted(60, 3, 3, 0))
    check_lof(spark, np.random.default_rng(0).normal(size=(7, 2)))
    check_lof(spark, planted(900, 3, 12, 1), block_rows=64)
    check_lof(spark, np.random.default_rng(5).exponential(size=(700, 2)) ** 4, block_rows=40, parts=7)


def test_lof_with_a_third_of_the_rows_equal(spark):
    x = np.random.default_rng(2).normal(size=(600, 2))
    x[:200] = x[0]
    x[200:207] = x[200]
    check_lof(spark, x, block_rows=50)


def test_lof_descends_box_levels_and_splits_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "TOP_BOXES", 3)
    monkeypatch.setattr(knn, "FAN_BITS", 2)
    monkeypatch.setattr(knn, "HOT_VISITS", 2)
    monkeypatch.setattr(knn, "host_bits", lambda blocks: 2)
    monkeypatch.setattr(joins, "SMALL", 10)
    monkeypatch.setattr(lof, "SMALL", 10)
    x = planted(800, 2, 10, 3)
    x[:270] = x[0]
    check_lof(spark, x, block_rows=32)


def test_far_points_visit_few_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.uniform(0, 1, (3000, 2)), rng.uniform(30, 400, (40, 2))])
    points = lof.weighted_points(rows_of(spark, x))
    near = knn.nearest_neighbours(points, len(x), 2, 10, 50)
    assert near.count() == len(x)
    lo, hi = np.zeros((1, 2)), np.ones((1, 2))
    far = np.array([[10.0, 10.0], [0.5, 0.5]])
    assert np.allclose(knn._tighten(far, np.array([500.0, 0.1]), lo, hi, np.array([11]), 10), [np.sqrt(200), 0.1])
    assert knn._tighten(far, np.array([500.0, -1.0]), lo, hi, np.array([10]), 10).tolist() == [500.0, -1.0]
    check_lof(spark, x, 10, 50)


def test_vectors_add_up_in_two_steps(spark, monkeypatch):
    from flowsieve.operators import sums

    df = spark.range(0, 600, 1, 6).select((F.col("id") % 2).cast("int").alias("arm"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    one = {r["arm"]: list(r["v"]) for r in sums.sum_vectors(df, ["arm"], 6).collect()}
    monkeypatch.setattr(sums, "DIRECT_TASKS", 2)
    assert {r["arm"]: list(r["v"]) for r in sums.sum_vectors(df, ["arm"], 6).collect()} == one == {0: [300.0, 89700.0], 1: [300.0, 90000.0]}


def test_correlated_wide_rows_visit_few_blocks(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(6000, 3)) @ rng.normal(size=(3, 64)) + 0.01 * rng.normal(size=(6000, 64))
    points = lof.weighted_points(rows_of(spark, x))
    turn = knn.turned(knn.principal_axes(points, len(x), 64))
    on_axes = session.durable(points.withColumn("x", turn("x")), "turned")
    share = []
    for p in (points, on_axes):
        blocks = knn.cut_into_blocks(p, len(x), 64, 10, 60)
        visits = knn._route(blocks, 64, 10, 0).select(F.sum(F.length("rows") / 8)).first()[0]
        share.append(visits / (len(x) * blocks.count()))
    assert share[1] < 0.2 and share[1] < share[0] / 2, share


def test_lof_in_many_dimensions(spark):
    check_lof(spark, np.random.default_rng(4).normal(size=(400, 40)), block_rows=64)


def test_forest_ranks_planted_points_first(spark):
    x = planted(2000, 4, 10, 5)
    rows = rows_of(spark, x)
    forest = iforest.fit_forest(rows, "id", "x", trees=100)
    scores = np.array([r["s"] for r in rows.select("id", iforest.forest_score(forest, F.col("x")).alias("s")).orderBy("id").collect()])
    assert ((scores > 0) & (scores < 1)).all()
    assert set(np.argsort(-scores)[:10]) == set(range(2000, 2010))
    again = rows_of(spark, x, 9)
    forest = iforest.fit_forest(again, "id", "x", trees=100)
    other = np.array([r["s"] for r in again.select("id", iforest.forest_score(forest, F.col("x")).alias("s")).orderBy("id").collect()])
    assert np.array_equal(scores, other)


@pytest.mark.parametrize("n, trees, sample", [(5000, 30, 64), (300, 12, 32)])
def test_forest_equals_its_sql(spark, n, trees, sample):
    rng = np.random.default_rng(n)
    x = np.column_stack([rng.normal(size=n), np.ones(n), rng.integers(0, 4, n).astype(float)])
    x[: n // 3] = x[0]
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})  # noqa: F841
    sql = f"WITH {iforest.forest_sql('pdf', ['a', 'b', 'c'], trees, sample, 7)} SELECT id, score FROM forest_scores ORDER BY id"
    want = duckdb.sql(sql).df()["score"].to_numpy()
    rows = rows_of(spark, x)
    forest = iforest.fit_forest(rows, "id", "x", trees, sample, 7)
    got = [r["s"] for r in rows.select("id", iforest.forest_score(forest, F.col("x")).alias("s")).orderBy("id").collect()]
    assert np.allclose(got, want, rtol=1e-12)


def test_forest_samples(spark):
    rows = spark.range(40_000).select("id", F.array(F.rand(1)).alias("x"))
    for trees in (5, 150):  # one draw per row, and several
        sizes = [r["count"] for r in iforest.tree_samples(rows, "id", "x", 40_000, trees, 256, 1).groupBy("tree").count().collect()]
        assert len(sizes) == trees and min(sizes) >= 256 and max(sizes) < 500


def test_forest_of_few_rows_uses_them_all(spark):
    rows = rows_of(spark, np.random.default_rng(0).normal(size=(100, 2)))
    sizes = {r["count"] for r in iforest.tree_samples(rows, "id", "x", 100, 20, 100, 1).groupBy("tree").count().collect()}
    assert sizes == {100}


def test_forest_edge_cases(spark):
    rows = rows_of(spark, np.ones((5, 2)))
    out = rows.select(iforest.forest_score(iforest.fit_forest(rows, "id", "x", trees=10), F.col("x")).alias("s")).distinct().collect()
    assert len(out) == 1
    assert iforest.expected_path(256) == pytest.approx(10.2448, abs=1e-4)


def exact_dual(x, gamma, nu, steps=4000, kernel=None):
    """Scores of the kernel problem, by pairwise updates on the dual."""
    n = len(x)
    if kernel is None:
        squares = (x * x).sum(1)
        kernel = np.exp(-gamma * np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0))
    cap = 1 / (nu * n)
    a = np.full(n, 1 / n)
    g = kernel @ a
    for _ in range(steps):
        up, down = np.where(a < cap - 1e-15)[0], np.where(a > 1e-15)[0]
        i, j = up[np.argmin(g[up])], down[np.argmax(g[down])]
        if g[j] - g[i] < 1e-7:
            break
        t = min((g[j] - g[i]) / max(2 - 2 * kernel[i, j], 1e-12), cap - a[i], a[j])
        a[i] += t
        a[j] -= t
        g += t * (kernel[:, i] - kernel[:, j])
    return g


def ranks(v):
    return np.argsort(np.argsort(v))


@pytest.mark.parametrize("n, d, features, seed", [(780, 4, 1024, 6), (780, 20, 4096, 16), (9900, 4, 1024, 26)])
def test_boundary_against_exact_dual(spark, n, d, features, seed):
    x = planted(n, d, n // 39, seed)
    x = (x - x.mean(0)) / x.std(0)
    nu = 0.12
    rows = rows_of(spark, x)
    boundary = fit_boundary(rows, len(x), d, 1 / d, nu, features=features)
    assert boundary.converged
    got = -np.array([r["s"] for r in rows.select("id", boundary_score(rows, boundary, F.col("x")).alias("s")).orderBy("id").collect()])
    want = exact_dual(x, 1 / d, nu, 4000 if n < 1000 else 30_000)
    assert np.corrcoef(ranks(got), ranks(want))[0, 1] >= 0.97
    low = lambda v: set(np.argsort(v)[: int(nu * len(v))])
    if d == 4:
        assert len(low(got) & low(want)) / int(nu * len(x)) >= 0.85
    # Rows on the boundary itself have equal scores in the dual; in many dimensions there are many.
    limit = np.sort(want)[int(nu * len(x)) - 1]
    assert np.mean([want[i] <= limit * 1.02 for i in low(got)]) >= 0.9
    assert np.allclose(got / (nu * len(x)), want, atol=0.05)


def test_boundary_solves_its_own_problem(spark):
    """In the space of its features: against pairwise updates on all rows, ties at the limit and a third of the rows equal."""
    x = planted(380, 3, 10, 8)
    x[:130] = x[0]
    x = (x - x.mean(0)) / x.std(0)
    nu, shape = 0.2, ocsvm.FeatureMap.draw(3, 1 / 3, 42, 64)
    z = shape(x).astype(float)
    boundary = fit_boundary(rows_of(spark, x), len(x), 3, 1 / 3, nu, features=64)
    least = exact_dual(x, 1 / 3, nu, 20_000, z @ z.T)
    assert boundary.weights @ boundary.weights <= np.sort(least)[: int(nu * len(x))].mean() * 1.01
    again = fit_boundary(rows_of(spark, x, 7), len(x), 3, 1 / 3, nu, features=64)
    assert np.allclose(again.weights, boundary.weights, atol=1e-4)


def test_boundary_reads_equal_rows_once(spark, monkeypatch):
    some = np.round(np.random.default_rng(4).normal(size=(30, 2)), 2)
    copies = np.repeat(some, np.arange(10, 40), axis=0)
    read, run = [], ocsvm.Pass.run

    def counted(points, *rest):
        read.append((points.count(), points.agg(F.sum("w")).first()[0]))
        return run(points, *rest)

    monkeypatch.setattr(ocsvm.Pass, "run", staticmethod(counted))
    with pytest.warns(UserWarning, match="duality gap"):
        folded = fit_boundary(rows_of(spark, copies), len(copies), 2, 0.5, 0.12, features=64, max_passes=4)
        assert set(read) == {(30, len(copies))}
        # The same rows, moved apart by next to nothing.
        apart = fit_boundary(rows_of(spark, copies + np.arange(len(copies))[:, None] * 1e-12), len(copies), 2, 0.5, 0.12, features=64, max_passes=4)
    assert read[-1][0] > 30 and np.allclose(folded.weights, apart.weights, atol=1e-4)


def test_boundary_warns_when_passes_run_out(spark):
    with pytest.warns(UserWarning, match="duality gap"):
        assert not fit_boundary(rows_of(spark, planted(200, 3, 5, 9)), 205, 3, 1 / 3, 0.1, max_passes=3).converged


def test_boundary_with_one_value(spark):
    rows = rows_of(spark, np.ones((40, 2)))
    boundary = fit_boundary(rows, 40, 2, 0.5, 0.12)
    assert boundary.converged and rows.select(F.round(boundary_score(rows, boundary, F.col("x")), 4)).distinct().count() == 1


def test_report(spark, frame):
    x = planted(380, 3, 20, 7)
    df = frame(x, [0] * 380 + [1] * 20).withColumnRenamed("truth", "label")
    out = build_report(df, ["f0", "f1", "f2"], "id", "label", contamination=0.05).toPandas().set_index("id").sort_index()
    assert len(out) == 400
    for flag in ("isolation_forest_flag", "lof_flag", "one_class_svm_flag"):
        assert out[flag].sum() == 20
    votes = out[["z_score_flag", "isolation_forest_flag", "lof_flag", "one_class_svm_flag"]].sum(axis=1)
    assert (out["ensemble_votes"] == votes).all() and (out["is_anomaly"] == (votes >= 2)).all()
    assert out["is_anomaly"][380:].sum() >= 19 and (out["ground_truth"] == out["label"]).all()
    assert (out["anomaly_reason"][out["is_anomaly"] == 0] == "baseline behavior").all()
    with pytest.raises(ValueError):
        build_report(df, ["f0"], "id", "nope")
    with pytest.raises(ValueError):
        build_report(df.withColumn("f0", F.when(F.col("id") > 3, F.col("f0"))), ["f0"], "id", on_dirty="error")


def test_blocks_that_meet_most_others_travel_once_for_many(spark, monkeypatch):
    x = np.random.default_rng(21).normal(size=(1500, 24))
    points = lof.weighted_points(rows_of(spark, x))
    blocks = knn.cut_into_blocks(points, len(x), 24, 10, 30)
    assert knn.host_bits(blocks.count()) == 0 and knn.dense_bits(blocks, 24, 10, 30) == 3  # no more than a quarter of the blocks in a host
    each = knn._route(blocks, 24, 10, 0).count()
    assert knn._route(blocks, 24, 10, 0, bare=True).count() == each and knn._route(blocks, 24, 10, 3).count() < each / 4
    monkeypatch.setattr(knn, "HOST_BYTES", 1)
    assert knn.dense_bits(blocks, 24, 10, 30) == 0
    monkeypatch.undo()
    check_lof(spark, x, block_rows=30)


def test_wide_rows_are_written_in_small_row_groups(spark):
    import glob

    import pyarrow.parquet as pq

    rng = np.random.default_rng(22)
    table = session.durable(spark.createDataFrame([(rng.bytes(1 << 18),) for _ in range(64)], "x binary").coalesce(1), "wide", wide=True)
    (path,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in table.inputFiles()}
    files = [pq.ParquetFile(f) for f in glob.glob(f"{path}/*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == 64
    assert max(f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)) <= 24
    assert spark.conf.get(session.ARROW_BYTES) == spark.newSession().conf.get(session.ARROW_BYTES)


def test_rows_meet_their_factor_without_carrying_the_point(spark, monkeypatch):
    x = planted(300, 3, 5, 7)
    x[:40] = x[0]
    made, kinds = lof.lof_scores(rows_of(spark, x), "id", "x"), []
    assert "Exchange hashpartitioning" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "BroadcastExchange" in plan
    monkeypatch.setattr(lof, "SENT", 10)
    # Points that share a hash are told apart by their own numbers.
    for same in (False, True):
        if same:
            monkeypatch.setattr(lof.F, "xxhash64", lambda c: F.lit(7).cast("bigint"))
        kinds.append({r["id"]: round(r["lof"], 9) for r in lof.lof_scores(rows_of(spark, x[:60]), "id", "x").collect()})
    assert kinds[0] == kinds[1] and len(kinds[0]) == 60
    monkeypatch.undo()
    assert {r["id"]: r["lof"] for r in made.collect()}.keys() == set(range(305))
