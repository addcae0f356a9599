import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import metrics, quantiles, sampling, stats, windows
from flowsieve.operators.ensemble import with_reason, with_vote


def z_flags(spark, values, threshold=2.5):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, packets double")
    out = stats.with_zscore(df, stats.fit_stats(df, ["packets"]), threshold).orderBy("id").collect()
    return out


def test_outlier_is_flagged(spark):
    out = z_flags(spark, [31.0, 29.0, 30.5, 30.0, 28.5, 31.5, 30.0, 29.5, 30.0, 30.5, 29.0, 140.0])
    assert [r["z_score_flag"] for r in out] == [0] * 11 + [1]
    assert out[-1]["z_score_reason"].startswith("packets=140.0 (z=3.3") and out[0]["z_score_reason"] == "baseline behavior"


def test_lone_extreme_masks_itself(spark):
    values = [3.0, 3.5, 2.5, 3.0, 3.25, 2000.0]  # of n values one can be (n - 1) ** 0.5 deviations away at most
    out = z_flags(spark, values)
    assert sum(r["z_score_flag"] for r in out) == 0 and out[-1]["z_score_max"] == pytest.approx(5**0.5, abs=1e-3)
    assert z_flags(spark, values, out[-1]["z_score_max"] - 1e-3)[-1]["z_score_flag"] == 1


def test_constant_and_dirty_columns_never_flag(spark):
    assert sum(r["z_score_flag"] for r in z_flags(spark, [7.25] * 6)) == 0
    out = z_flags(spark, [1.0, float("nan"), None, float("inf"), 2.0, 1.5], 0.1)
    assert [r["z_score_flag"] for r in out] == [1, 0, 0, 0, 1, 0]


@pytest.mark.parametrize("d", [3, 30])
def test_scaling_matches_population_statistics(frame, d):
    x = np.random.default_rng(0).normal(3, 2, (200, d))
    x[:, 1] = 7.0
    df = frame(x)
    names = [f"f{j}" for j in range(d)]
    fitted = stats.fit_stats(df, names)
    got = np.array([r["s"] for r in stats.with_scaled(df, fitted, "s").orderBy("id").collect()])
    want = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    assert np.allclose(got, want) and fitted.rows == 200


def test_windows(spark):
    rows = [(f"2031-02-03T21:{m:02d}:30", "s1", 40 + 3 * m, 7, 1) for m in range(0, 24, 2)] + [("junk", "s1", 1, 1, 0), ("2031-02-03T21:00:00", None, 1, 1, 0)]
    df = spark.createDataFrame(rows, "timestamp string, source_ip string, bytes_sent int, packets int, label int")
    out = windows.window_frame(df, "source_ip", 6).orderBy("timestamp").collect()
    assert [(r["bytes_sent_mean"], r["bytes_sent_sum"], r["bytes_sent_count"]) for r in out] == [(46.0, 138, 3), (64.0, 192, 3), (82.0, 246, 3), (100.0, 300, 3)]
    assert not [c for c in out[0].asDict() if c.startswith("label")]
    assert [r["ground_truth"] for r in windows.window_frame(df, "source_ip", 6, label="label").collect()] == [1, 1, 1, 1]
    with pytest.raises(ValueError):
        windows.window_frame(df, "nope", 5)
    with pytest.raises(ValueError):
        windows.window_frame(df.where("timestamp = 'junk'"), "source_ip", 5)


def test_vote_and_reason(spark):
    flags = ["z_score_flag", "isolation_forest_flag", "lof_flag", "one_class_svm_flag"]
    df = spark.createDataFrame([(1, 1, 0, 0, "v=1"), (1, 0, 0, 0, "v=2"), (0, 0, 1, 1, "-")], ", ".join(f"{f} int" for f in flags) + ", z_score_reason string")
    out = with_reason(with_vote(df)).collect()
    assert [(r["ensemble_votes"], r["is_anomaly"]) for r in out] == [(2, 1), (1, 0), (2, 1)]
    assert out[0]["anomaly_reason"].startswith("v=1; Isolation Forest") and out[1]["anomaly_reason"] == "baseline behavior"
    assert [list(r["reason_codes"]) for r in out] == [["Z_SCORE", "ISOLATION_FOREST"], [], ["LOCAL_OUTLIER_FACTOR", "ONE_CLASS_SVM"]]


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "t int, p int")
    r = metrics.method_metrics(df, "t", {"m": "p"}).first()
    assert (r["precision"], r["recall"], r["f1_score"], r["accuracy"], r["predicted_anomalies"]) == (0.0, 0.0, 0.0, 1.0, 0)
    assert [c["n"] for c in metrics.confusion(df, "t", "p").collect()] == [2, 0, 0, 0]


def test_best_method_first_wins_ties(spark):
    df = spark.createDataFrame([("ensemble", 0.5), ("z_score", 0.5), ("one_class_svm", 0.4)], "method string, f1_score double")
    assert metrics.best_method(df).first()[0] == "z_score"


def brute_auc(t, s):
    pos, neg = s[t == 1], s[t == 0]
    return ((pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2)


def test_auc_with_ties_and_groups(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANGE_ROWS", 3)
    rng = np.random.default_rng(1)
    t, s = rng.integers(0, 2, 3000), np.round(rng.normal(size=3000), 1)
    s[:1000] = 0.5
    g = rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(t, s, g)], "t int, s double, g int")
    assert metrics.roc_auc(df, "t", "s").first()[0] == pytest.approx(brute_auc(t, s), abs=1e-12)
    for r in metrics.roc_auc(df, "t", "s", ["g"]).collect():
        assert r["roc_auc"] == pytest.approx(brute_auc(t[g == r["g"]], s[g == r["g"]]), abs=1e-12)
    assert metrics.roc_auc(df.where("t = 1"), "t", "s").first()[0] is None
    assert metrics.roc_auc(df.withColumn("s", F.lit(0.3)), "t", "s").first()[0] == 0.5


@pytest.mark.parametrize("fetch", [50, 100_000])
@pytest.mark.parametrize("q", [0.0, 0.12, 0.5, 0.88, 1.0])
def test_exact_quantile(spark, monkeypatch, fetch, q):
    monkeypatch.setattr(quantiles, "FETCH_ROWS", fetch)
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.exponential(size=2000), np.full(1000, 0.7), np.round(rng.normal(size=500), 1)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert quantiles.exact_quantile(df, "v", q) == pytest.approx(np.quantile(v, q), rel=1e-12)


def test_hash_cuts_go_deep(spark, monkeypatch):
    monkeypatch.setattr(sampling, "FETCH_ROWS", 3)
    rng = np.random.default_rng(3)
    h = {g: rng.choice(1 << 60, 4000, replace=False) for g in ("a", "b")}
    df = spark.createDataFrame([(g, int(x)) for g, v in h.items() for x in v], "g string, h bigint")
    got = sampling.hash_cuts(df, "g", "h", {"a": [1, 7, 3999], "b": [2000]})
    assert got == {(g, r): int(np.sort(h[g])[r - 1]) for g, r in [("a", 1), ("a", 7), ("a", 3999), ("b", 2000)]}
    with pytest.raises(ValueError):
        sampling.hash_cuts(df, "g", "h", {"a": [4001]})


def test_samples(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    out = sampling.balanced_sample(df, "label", "id", 150)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 150, 1: 100}
    folds = sampling.with_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r["label"] == 0} == {180} and {r["count"] for r in folds if r["label"] == 1} == {20}
    again = sampling.with_folds(df.repartition(3), "label", "id", 5)
    assert again.exceptAll(sampling.with_folds(df, "label", "id", 5)).isEmpty()
    gaps = df.withColumn("label", F.when(F.col("id") >= 100, F.col("label")))
    assert {r["count"] for r in sampling.with_folds(gaps, "label", "id", 5).where("label is null").groupBy("fold").count().collect()} == {20}
    assert sampling.seed_labels(df, "label", "id", 10).groupBy("label").count().where("count = 5").count() == 2
    with pytest.raises(ValueError):
        sampling.seed_labels(df.where("label = 0"), "label", "id")
    assert sampling.random_queries(df, "id", 2000).count() == 1000
    probs = spark.createDataFrame([(i, p) for i, p in enumerate([0.03, 0.2, 0.46, 0.71, 0.97, 0.55, 0.88])], "id int, p double")
    assert sorted(r["id"] for r in sampling.uncertain_queries(probs, "p", "id", 2).collect()) == [2, 5]


@pytest.mark.parametrize("fraction", [0.0, 0.004, 0.02])
def test_labeled_subset_has_both_classes(spark, fraction):
    df = spark.range(1000).withColumn("label", (F.col("id") == 77).cast("int"))
    out = sampling.labeled_subset(df, "label", "id", fraction)
    assert out.count() == max(4, round(fraction * 1000)) and out.select("label").distinct().count() == 2


def test_class_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "c string, v double")
    assert {tuple(r) for r in metrics.class_counts(df, "c").collect()} == {("a", 2), ("b", 1)}
    r = metrics.class_profile(df, "c", ["v"], ["a", "b"]).first()
    assert (r["feature"], r["mean_a"], r["mean_b"]) == ("v", 2.0, 5.0)
