import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.stats import ColumnStats, fit_stats
from flowsieve.operators.windows import window_frame
from flowsieve.plans.detect import class_overview, detect
from flowsieve.streaming.windows import run_available, score_windows, stream_windows


def flow_rows(n=240, attacks=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad = i >= n - attacks
        rows.append((
            f"2026-05-10T{8 + i // 60:02d}:{i % 60:02d}:00", f"s{i % 4}", float(rng.normal(9000 if bad else 450, 40)),
            int(rng.integers(70, 90) if bad else rng.integers(9, 15)), float(rng.normal(5, 0.5)), "attack" if bad else "benign",
        ))
    return rows


SCHEMA = "timestamp string, source_ip string, bytes_sent double, packets int, duration double, label string"


def test_run_writes_everything(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame(flow_rows(), SCHEMA).write.parquet(path)
    run = detect(spark.read.parquet(path), label="label", contamination=0.05)
    assert run.features == ["bytes_sent", "packets", "duration"]
    scores = {r["method"]: r for r in run.metrics.collect()}
    # Gaussian noise itself passes 2.5 deviations now and then, so only recall is exact for the z-score.
    assert scores["ensemble"]["recall"] == 1.0 and scores["z_score"]["recall"] == 1.0
    summary = run.summary.first()
    assert summary["rows_processed"] == 240 and summary["metrics_available"]
    assert summary["anomalies_detected"] == run.flagged().count() == {r["method"]: r["flagged"] for r in run.method_counts.collect()}["ensemble"]
    assert sum(r["n"] for r in run.confusion.collect()) == 240
    assert run.preview(3).count() == 3 and run.preview(3).first()["omitted"] == summary["anomalies_detected"] - 3
    assert run.scatter(points=50).count() == 50 and run.scatter("duration", points=9).columns[1:3] == ["x", "y"]
    for fmt in ("parquet", "csv"):
        run.save(str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet/report")).count() == 240
    assert spark.read.json(str(tmp_path / "csv/summary")).first()["best_method_by_f1"] == summary["best_method_by_f1"]
    assert summary["rows_dropped"] == 0
    with pytest.raises(ValueError):
        detect(spark.read.parquet(path), label="nope")
    with pytest.raises(ValueError, match="more than once"):
        detect(spark.read.parquet(path), id_col="source_ip", label="label")
    head, counts, profile = class_overview(run.report, "label", run.features, "row_id")
    assert head.count() == 5 and counts.count() == 2 and profile.columns == ["feature", "mean_attack", "mean_benign"]


def test_windowed_run(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame(flow_rows(480, 20), SCHEMA).write.parquet(path)
    run = detect(spark.read.parquet(path), label="label", window_minutes=10)
    assert "label_mean" not in run.report.columns and set(run.features) >= {"bytes_sent_mean", "packets_sum", "duration_count"}
    assert run.report.count() == run.report.select("source_ip", "timestamp").distinct().count()
    assert run.report.agg(F.sum("ground_truth")).first()[0] > 0


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(flow_rows(), SCHEMA)
    df.write.parquet(folder)
    batch = window_frame(df, "source_ip", 30, names=["bytes_sent"])
    fitted = fit_stats(batch, ["bytes_sent_mean"])
    loaded = ColumnStats.from_table(fitted.table(spark))
    assert loaded == fitted
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    out = score_windows(stream_windows(stream, "source_ip", 30, ["bytes_sent"], late="10 minutes"), loaded)
    query = (
        out.writeStream.format("memory").queryName("closed_windows").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(r["source_ip"], r["timestamp"]): (r["bytes_sent_sum"], r["z_score_flag"]) for r in spark.table("closed_windows").collect()}
    closed = batch.where("timestamp < '2026-05-10 11:30:00'")
    want = {(r["source_ip"], r["timestamp"]): (pytest.approx(r["bytes_sent_sum"]), r["z_score_flag"]) for r in score_windows(closed, fitted).collect()}
    assert len(want) == 28 and got == want


def test_runs_go_on_from_their_state(spark, tmp_path):
    """Two loads, the second with a record that is too late; a third run without new data changes nothing."""
    inbox, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = flow_rows()
    late = (rows[0][0], "s9", 1.0, 1, 1.0, "benign")
    batch = window_frame(spark.createDataFrame(rows, SCHEMA), "source_ip", 30, names=["bytes_sent"])
    fitted = fit_stats(batch, ["bytes_sent_mean"])

    def run():
        return run_available(spark.readStream.schema(SCHEMA).parquet(inbox), "source_ip", 30, ["bytes_sent"], fitted, target, state, late="10 minutes")

    spark.createDataFrame(rows[:150], SCHEMA).write.mode("append").parquet(inbox)
    first = run()
    assert first.records == 150 and first.late_groups == 0
    seen = spark.read.schema(first.schema).parquet(target).count()
    assert seen == 4 * 4
    spark.createDataFrame([*rows[150:], late], SCHEMA).write.mode("append").parquet(inbox)
    second = run()
    assert second.records == 91 and second.late_groups == 1
    assert run().records == 0
    got = {(r["source_ip"], r["timestamp"]): (round(r["bytes_sent_sum"], 6), r["z_score_flag"]) for r in spark.read.schema(first.schema).parquet(target).collect()}
    want = {(r["source_ip"], r["timestamp"]): (round(r["bytes_sent_sum"], 6), r["z_score_flag"]) for r in score_windows(batch.where("timestamp < '2026-05-10 11:30:00'"), fitted).collect()}
    assert got == want
