import numpy as np
import pytest
from conftest import separable
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowsieve.operators.logistic import fit_arms
from flowsieve.plans import active_learning, label_budget, supervised
from flowsieve.plans.active_learning import _fit_small
from flowsieve.plans.experiment import experiment_table


def names(x):
    return [f"f{j}" for j in range(x.shape[1])]


def local_fit(x, y):
    """Scaler plus balanced logistic regression on local rows; returns a probability function."""
    m, s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    beta = _fit_small((x - m) / s, y)
    return lambda z: 1 / (1 + np.exp(-(((z - m) / s) @ beta[:-1] + beta[-1])))


def test_arms_match_library_logistic(spark, frame):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1]
    y = (x[:, 0] + rng.normal(size=400) > 0.7).astype(int)
    table = experiment_table(frame(x, y), names(x), "truth", "id", 4, 1)
    k = 4

    def labels(cols, _):
        out = np.repeat(cols["truth"][:, None].astype(np.int8), k, axis=1)
        out[cols["fold"][:, None] == np.arange(k)[None, :]] = -1
        return out

    beta, rows = fit_arms(table, ["x", "truth", "fold"], labels, np.zeros((k, 4)))
    for arm in range(k):
        train = table.where(F.col("fold") != arm).toPandas()
        xs, ys = np.vstack(train["x"]), train["truth"].to_numpy()
        assert rows[arm] == len(ys)
        m, s, n = xs.mean(0), xs.std(0), len(ys)
        data = spark.createDataFrame([(((r - m) / s).tolist(), int(t), float(n / (2 * (ys == t).sum()))) for r, t in zip(xs, ys)], "x array<double>, y int, w double")
        model = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=1 / n, standardization=False, tol=1e-12, maxIter=500).fit(data.withColumn("v", array_to_vector("x")))
        assert np.allclose(model.coefficients.toArray(), beta[arm][:-1] * s, atol=1e-4)
        p = local_fit(xs, ys)(xs)
        q = 1 / (1 + np.exp(-(xs @ beta[arm][:-1] + beta[arm][-1])))
        assert np.allclose(p, q, atol=1e-5)


@pytest.mark.parametrize("model", ["logistic_regression", "random_forest"])
def test_cross_validation_learns_blobs(frame, model):
    x, y = separable(40, 4, 6, 0)
    options = {"trees": 20} if model == "random_forest" else {}
    r = supervised.cross_validate(frame(x, y), names(x), "truth", "id", model, folds=3, **options).first()
    for m in supervised.METRICS:
        assert r[f"{m}_mean"] > 0.9 and r[f"{m}_std"] < 0.1


def test_benchmark_comparison(frame):
    x, y = separable(60, 3, 5, 1)
    r = supervised.compare_benchmark(frame(x, y), names(x), "truth", "id", "generic", folds=3).first()
    assert (r["rows"], r["attacks"], r["numeric_features"]) == (120, 60, ["f0", "f1", "f2"])
    assert r["gap_f1"] == pytest.approx(r["supervised_f1_score_mean"] - r["unsupervised_f1_score"], abs=1e-9)


def test_self_training_equals_local_replay(frame):
    rng = np.random.default_rng(3)
    x, y = separable(120, 3, 1.6, 3)
    folds = 3
    budgets = [0.05, 1.0]
    scores = {(r["kind"], r["labeled_fraction"], r["fold"]): r["f1"] for r in label_budget.budget_folds(frame(x, y), names(x), "truth", "id", budgets, folds, 9)[0].collect()}
    table = experiment_table(frame(x, y), names(x), "truth", "id", folds, 9, keys=True)
    local = table.toPandas().sort_values("id")
    xs, fold, keys = np.vstack(local["x"]), local["fold"].to_numpy(), np.vstack(local["keys"])

    def f1(p, t):
        return 2 * (p & t).sum() / (p.sum() + t.sum())

    for k in range(folds):
        train = np.flatnonzero(fold != k)
        for f in budgets:
            size = max(4, round(f * len(train)))
            lab = train[np.argsort(keys[train, k])][:size]
            if len(set(y[lab])) < 2:
                continue
            known = np.full(len(y), -1)
            known[lab] = y[lab]
            p = local_fit(xs[lab], y[lab])
            test = fold == k
            assert scores[("supervised", f, k)] == pytest.approx(f1(p(xs[test]) > 0.5, y[test] == 1))
            for _ in range(10):
                rest = train[known[train] < 0]
                if not len(rest):
                    break
                have = train[known[train] >= 0]
                prob = local_fit(xs[have], known[have])(xs[rest])
                sure = np.maximum(prob, 1 - prob) > 0.75
                known[rest[sure]] = prob[sure] > 0.5
                if not sure.any():
                    break
            have = train[known[train] >= 0]
            p = local_fit(xs[have], known[have])
            assert scores[("self_training", f, k)] == pytest.approx(f1(p(xs[test]) > 0.5, y[test] == 1))
    del rng


def test_budget_sweep(frame):
    x, y = separable(96, 3, 4, 8)
    out = label_budget.label_budget(frame(x, y), names(x), "truth", "id", [0.03, 0.5], 3, 7).orderBy("labeled_fraction").collect()
    assert [r["approx_labeled_rows"] for r in out] == [4, 64]
    assert out[1]["supervised_f1"] >= out[0]["supervised_f1"] - 0.05
    assert out[1]["self_training_f1"] > 0.9


def test_active_learning_curves(frame):
    rng = np.random.default_rng(6)
    y = rng.permutation([0] * 130 + [1] * 50)
    x = rng.normal(size=(180, 3))
    x[y == 1, 2] -= 2.5
    out = active_learning.active_curves(frame(x, y), names(x), "truth", "id", folds=4, budget=40).toPandas()
    assert sorted(out["labels"].unique()) == [10, 20, 30, 40]
    assert out["f1"].between(0, 1).all() and len(out) == 2 * 4 * 4
    first = out[out["labels"] == 10].pivot(index="fold", columns="strategy", values="f1")
    assert (first["random"] == first["uncertainty"]).all()
    one = active_learning.active_fold(frame(x, y), names(x), "truth", "id", "uncertainty", 2, folds=4, budget=40).toPandas()
    same = out[(out["strategy"] == "uncertainty") & (out["fold"] == 2)]
    assert dict(zip(one["labels"], one["f1"])) == dict(zip(same["labels"], same["f1"]))


def test_active_learning_replay_and_small_pool(frame):
    x, y = separable(30, 2, 2, 4)
    out = active_learning.active_curves(frame(x, y), names(x), "truth", "id", folds=3, budget=500, seed=5).toPandas()
    assert out["labels"].max() == 40  # the pool is used up, and the last size is scored too
    table = experiment_table(frame(x, y), names(x), "truth", "id", 3, 5, keys=True).toPandas()
    xs, t, fold, keys = np.vstack(table["x"]), table["truth"].to_numpy(), table["fold"].to_numpy(), np.vstack(table["keys"])
    for k in range(3):
        train = np.flatnonzero(fold != k)
        order = train[np.argsort(keys[train, k])]
        for strategy in ("random", "uncertainty"):
            held = [i for c in (0, 1) for i in order[t[order] == c][:5]]
            while True:
                beta = _fit_small(xs[held], t[held])
                z = xs @ beta[:-1] + beta[-1]
                p, test = z > 0, fold == k
                f1 = 2 * (p[test] & (t[test] == 1)).sum() / (p[test].sum() + t[test].sum())
                row = out[(out["strategy"] == strategy) & (out["fold"] == k) & (out["labels"] == len(held))]
                assert row["f1"].item() == pytest.approx(f1, abs=6e-5)
                rest = [i for i in order if i not in held]
                if not rest:
                    break
                if strategy == "uncertainty":
                    gap = np.abs(1 / (1 + np.exp(-z)) - 0.5)
                    rest = sorted(rest, key=lambda i: (gap[i], keys[i, k]))
                held = held + rest[:10]


def test_dirty_and_unlabelled_rows_change_nothing(spark, frame):
    x, y = separable(60, 2, 6, 3)
    clean = frame(x, y)
    extra = spark.createDataFrame([(1000, None, 1.0, 1), (1001, float("nan"), 1.0, 0), (1002, 9.0, 9.0, None), (1003, float("inf"), 0.0, 1)], "id long, f0 double, f1 double, truth int")
    dirty = clean.unionByName(extra.select(*[F.col(c).cast(t) for c, t in clean.dtypes]))
    with pytest.warns(UserWarning, match="1 rows without a label and 3"):
        got = label_budget.label_budget(dirty, names(x), "truth", "id", [0.1], 3, 1).collect()
    assert got == label_budget.label_budget(clean, names(x), "truth", "id", [0.1], 3, 1).collect()
    with pytest.raises(ValueError):
        experiment_table(dirty, names(x), "truth", "id", 3, 1, on_dirty="error")
    with pytest.warns(UserWarning):
        assert supervised.cross_validate(dirty, names(x), "truth", "id", folds=3).collect() == supervised.cross_validate(clean, names(x), "truth", "id", folds=3).collect()


def test_one_class_is_an_error(frame):
    x, y = separable(20, 2, 3, 0)
    with pytest.raises(ValueError):
        active_learning.active_curves(frame(x, y * 0), names(x), "truth", "id")
