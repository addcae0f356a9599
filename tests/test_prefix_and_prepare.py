import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions.hashing import order_key
from flowsieve.operators import metrics, prefix, sampling
from flowsieve.plans import subsets
from flowsieve.sources.tables import number_rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_totals_before(spark, monkeypatch, block):
    monkeypatch.setattr(prefix, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = [(k, int(p), int(rng.integers(0, 9))) for k in ("a", None) for p in sorted(rng.choice(50, 30, replace=False))]
    got = prefix.totals_before(spark.createDataFrame(rows, "k string, p int, v long"), ["k"], "p", "v", 50, "before").collect()
    assert sorted((r.k or "", r.p, r.v, r.before) for r in got) == sorted((k or "", p, v, sum(w for j, q, w in rows if j == k and q < p)) for k, p, v in rows)
    assert prefix.totals_before(spark.createDataFrame(rows[:9], "k string, p int, v long").drop("k"), [], "p", "v", 50, "before").count() == 9


def test_many_ranges_change_nothing(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("label"), F.when(F.col("id") % 7 > 0, F.col("id") % 101).otherwise(5).cast("double").alias("score"), (F.col("id") % 5 == 0).cast("int").alias("truth"))
    folds, auc = sorted(map(tuple, sampling.with_folds(df, "label", "id").collect())), metrics.roc_auc(df, "truth", "score").first()[0]
    monkeypatch.setattr(sampling, "FOLD_ROWS", 10)
    monkeypatch.setattr(metrics, "RANGE_ROWS", 4)
    monkeypatch.setattr(prefix, "BLOCK", 4)
    assert sorted(map(tuple, sampling.with_folds(df, "label", "id").collect())) == folds
    assert metrics.roc_auc(df, "truth", "score").first()[0] == pytest.approx(auc, abs=1e-12)
    assert "SinglePartition" not in plan_of(sampling.with_folds(df, "label", "id"))
    assert sorted(r.row_id for r in number_rows(df.repartition(37)).collect()) == list(range(1, 3001))


def test_prepared_files(spark, tmp_path):
    for name, lo, hi in (("a.parquet", 0, 900), ("b.parquet", 900, 1500)):
        spark.range(lo, hi).select(F.concat(F.lit("f"), "id").alias("Flow ID"), (F.col("id") * 1.0).alias("Flow Duration"), F.when(F.col("id") % 10 == 0, "PortScan").otherwise("BENIGN").alias("Label")).write.parquet(str(tmp_path / name))
    target = str(tmp_path / "out")
    subset = subsets.prepare_files(spark, "cic", [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")], target, "Flow ID", 120, seed=3, rows_per_file=50)
    assert subset.columns == ["Flow ID", "Flow Duration", "Label"] and {r.Label: r["count"] for r in subset.groupBy("Label").count().collect()} == {0: 120, 1: 120}
    one = subset.where("Label = 1")
    assert "PartitionFilters: [isnotnull(Label" in plan_of(one) and one.select(F.input_file_name()).distinct().count() < subset.select(F.input_file_name()).distinct().count()
    for label in (0, 1):
        rows = spark.read.parquet(f"{target}/Label={label}").withColumn("at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())).withColumn("key", order_key(3, F.col("Flow ID")))
        keys = [r.key for r in rows.orderBy("at").collect()]
        assert keys == sorted(keys) and len(keys) == 120
    with pytest.raises(FileNotFoundError):
        subsets.prepare_files(spark, "cic", [str(tmp_path / "none.parquet")], target, "Flow ID")
