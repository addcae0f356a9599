import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from flowsieve.functions.labels import feature_columns, label_or_null, normalize_label, not_benign
from flowsieve.plans.subsets import prepare_cic, prepare_unsw
from flowsieve.sources import benchmarks, tables


def test_label_words(spark):
    words = ["1", "true", "attack", " Anomaly", "MALICIOUS ", "yes"], ["0", "false", "benign", "Normal", " no"]
    df = spark.createDataFrame([(w, 1) for w in words[0]] + [(w, 0) for w in words[1]], "w string, want int")
    assert df.where(normalize_label(F.col("w")) != F.col("want")).count() == 0


def test_unknown_label_fails(spark):
    df = spark.createDataFrame([("unsure",), (None,)], "w string")
    with pytest.raises(Exception, match="Not a label word"):
        df.select(normalize_label(F.col("w"))).collect()
    assert df.where(label_or_null(F.col("w")).isNull()).count() == 2


def test_not_benign(spark):
    df = spark.createDataFrame([(" BENIGN", 0), ("DoS Hulk", 1), (None, 1)], "w string, want int")
    assert df.where(not_benign(F.col("w")) != F.col("want")).count() == 0


def test_features_leave_the_label_out(spark):
    df = spark.createDataFrame([(1, 3, 0, "tcp")], "a int, b int, Label int, proto string")
    assert feature_columns(df, "Label") == ["a", "b"]
    with pytest.warns(UserWarning, match="leakage"):
        assert feature_columns(df) == ["a", "b"]
    with pytest.raises(ValueError):
        feature_columns(df.select("proto"))


def test_schema_recognition():
    assert benchmarks.recognise(["srcip", "sport", "label"]) == "unsw-nb15"
    assert benchmarks.recognise(["Flow Duration"]) == "cic-ids2017"
    assert benchmarks.recognise(["Label", "Total Fwd Packets"]) == "cic-ids2017"
    assert benchmarks.recognise(["Label", "bytes"]) == "generic"
    assert benchmarks.find_label(["x", "Class"]) == "Class"
    with pytest.raises(ValueError):
        benchmarks.find_label(["x"])


def test_csv_and_parquet(spark, tmp_path):
    csv = tmp_path / "flows.csv"
    csv.write_text("Flow ID,Flow Bytes/s,Label\na,1.5,BENIGN\nb,inf,DDoS\nc,nan,DDoS\n")
    df = tables.load_table(spark, str(csv), "`Flow ID` string, `Flow Bytes/s` double, Label string")
    out, names, schema = benchmarks.prepare_benchmark(df, keep=("Flow ID",))
    assert (names, schema) == (["Flow Bytes/s"], "cic-ids2017")
    assert [tuple(r) for r in out.collect()] == [("a", 1.5, 0)]
    tables.write_report(df, str(tmp_path / "r.parquet"))
    assert tables.load_table(spark, str(tmp_path / "r.parquet")).count() == 3
    tables.write_report(df, str(tmp_path / "r.csv"), "csv")
    assert tables.load_table(spark, str(tmp_path / "r.csv")).columns == df.columns
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path / "empty.csv"))


def test_json_and_prepared_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "label int, v double")
    tables.write_prepared(df, str(tmp_path / "p"), "label")
    assert sorted(d for d in os.listdir(tmp_path / "p") if "=" in d) == ["label=0", "label=1"]
    tables.write_json(df, str(tmp_path / "j"))
    lines = [json.loads(line) for f in (tmp_path / "j").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(line["label"] for line in lines) == [0, 1]


def test_numeric_cic_label_passes_through(spark):
    df = spark.createDataFrame([("a", 1.0, 0, 1), ("b", 2.0, 1, 0)], "`Flow ID` string, `Flow Duration` double, Label int, Label2 int")
    out, names, _ = benchmarks.prepare_benchmark(df, keep=("Flow ID",))
    assert names == ["Flow Duration"]
    assert sorted(r["ground_truth"] for r in out.collect()) == [0, 1]


def test_labeled_and_aliases(spark):
    df = spark.createDataFrame([(1, 2.0, "attack"), (2, None, "benign")], "id int, Sload double, label string")
    out, names = tables.labeled(df, "label", ("id",))
    assert names == ["Sload"] and [tuple(r) for r in out.collect()] == [(1, 2.0, 1)]
    with pytest.raises(ValueError):
        tables.labeled(df, "nope")
    assert tables.alias_columns(df).columns == ["id", "sload", "label"]
    assert tables.alias_columns(df.toDF("sload", "Sload", "label")).columns == ["sload", "Sload", "label"]


def test_row_numbers(spark):
    out = tables.number_rows(spark.range(1000).repartition(7)).collect()
    assert sorted(r["row_id"] for r in out) == list(range(1, 1001))


def test_row_numbers_of_a_shuffled_wide_table(spark):
    wide = spark.range(300_000).select((F.col("id") % 100_000).alias("k"), *[(F.col("id") * (j + 1)).alias(f"v{j}") for j in range(12)])
    grouped = wide.groupBy("k").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(12)])
    out = tables.number_rows(grouped)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count_distinct("k").alias("k")).first()
    assert tuple(r) == (100_000, 100_000, 1, 100_000, 100_000)


def test_folder_without_suffix(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "flows"))
    assert tables.load_table(spark, str(tmp_path / "flows"), fmt="parquet").count() == 5


def test_query_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location('entry_file', {os.path.join(root, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
print('rows', entry.queries()['q_iforest'](spark, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout, out.stderr[-2000:]


def test_prepared_subsets(spark):
    a = spark.createDataFrame([(f"a{i}", float(i), i % 3 == 0) for i in range(60)], "id string, Sload double, y0 boolean").select("id", "Sload", F.col("y0").cast("int").alias("label"))
    b = spark.createDataFrame([("b", 1.0, 5.0, 1), ("c", float("nan"), 1.0, 1)], "id string, sload double, extra double, label int")
    out = prepare_unsw([a, b], "id", 12)
    assert out.columns == ["id", "sload", "label"]
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 12, 1: 12}
    cic = spark.createDataFrame([("x", 1.0, "BENIGN"), ("y", float("inf"), "DDoS"), ("z", 3.0, "DDoS")], "`Flow ID` string, `Flow Bytes/s` double, Label string")
    assert sorted(tuple(r) for r in prepare_cic([cic], "Flow ID", 5).collect()) == [("x", 1.0, 0), ("z", 3.0, 1)]
    with pytest.raises(ValueError):
        benchmarks.curated(spark.createDataFrame([(1, 0)], "q int, label int"))
