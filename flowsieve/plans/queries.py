"""Every operator bound to the driver's tables, with the SQL that must agree where SQL can say it.

flows: ``events`` as flow records. flows4: ``lineitem`` as four-feature records. vectors: ``embeddings``. texts:
``documents`` with their ``labels``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import col
from flowsieve.functions.labels import feature_columns, normalize_label, not_benign
from flowsieve.operators import ensemble, iforest, knn, lsh, metrics, sampling, stats, windows
from flowsieve.operators.logistic import logistic_sql
from flowsieve.plans import active_learning, label_budget, report, subsets, supervised
from flowsieve.session import durable, scratch_folder
from flowsieve.sources import benchmarks, tables
from flowsieve.streaming import windows as stream_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIMS = 64


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- views ---------------------------------------------------------------------------------------------------------

def flows(spark, folder) -> DataFrame:
    return read(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.when(F.col("event_type") == "error", "attack").otherwise("benign").alias("label"),
    )


FLOWS = """flows AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k,
         CASE WHEN event_type = 'error' THEN 'attack' ELSE 'benign' END AS label
  FROM events)"""


def flows4(spark, folder) -> DataFrame:
    row_id = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    return read(spark, folder, "lineitem").select(row_id.alias("id"), *FOUR, (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_returnflag")


FLOWS4 = """flows4 AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_quantity, l_extendedprice,
         l_discount, l_tax, CAST(l_returnflag = 'R' AS INTEGER) AS label, l_returnflag
  FROM lineitem)"""


def vectors(spark, folder) -> DataFrame:
    dims = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)]
    return read(spark, folder, "embeddings").select("vec_id", *dims, "label")


def texts(spark, folder) -> DataFrame:
    """Text measurements of the labelled documents; ``quality`` is the label."""
    text = F.col("text")
    words = F.size(F.split(text, r"\s+"))
    measured = read(spark, folder, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("chars"),
        words.cast("double").alias("words"),
        F.size(F.split(text, "\n")).cast("double").alias("lines"),
        (F.length(text) / words).alias("word_length"),
        (F.length(F.regexp_replace(text, r"[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))).alias("digit_share"),
        (F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length(text), F.lit(1))).alias("sign_share"),
    )
    return measured.join(read(spark, folder, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


TEXT_FEATURES = ["chars", "words", "lines", "word_length", "digit_share", "sign_share"]


def flag_table(spark, folder) -> DataFrame:
    """flows with four flags by plain thresholds, the vote, and the truth."""
    base = flows(spark, folder).select(
        "event_id", "value", "k",
        normalize_label(F.col("label")).alias("ground_truth"),
        (F.col("value") >= 100).cast("int").alias("z_score_flag"),
        (F.col("k") >= 80).cast("int").alias("isolation_forest_flag"),
        (F.col("value") < 10).cast("int").alias("lof_flag"),
        (F.col("k") < 15).cast("int").alias("one_class_svm_flag"),
        F.concat(F.lit("value="), F.col("value").cast("string")).alias("z_score_reason"),
    )
    return ensemble.with_vote(base)


FLAGS = FLOWS + """, votes AS (
  SELECT event_id, value, k, CASE WHEN label = 'attack' THEN 1 ELSE 0 END AS ground_truth,
         CAST(value >= 100 AS INTEGER) AS z_score_flag, CAST(k >= 80 AS INTEGER) AS isolation_forest_flag,
         CAST(value < 10 AS INTEGER) AS lof_flag, CAST(k < 15 AS INTEGER) AS one_class_svm_flag,
         'value=' || CAST(value AS VARCHAR) AS z_score_reason
  FROM flows), flags AS (
  SELECT *, z_score_flag + isolation_forest_flag + lof_flag + one_class_svm_flag AS ensemble_votes,
         CAST(z_score_flag + isolation_forest_flag + lof_flag + one_class_svm_flag >= 2 AS INTEGER) AS is_anomaly
  FROM votes)"""

METHOD_SQL = ", long AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, {i} AS place, ground_truth, {flag} AS flag FROM flags" for i, (m, flag) in enumerate(metrics.METHODS.items())
) + """), cells AS (
  SELECT method, place, count(*) FILTER (ground_truth = 1 AND flag = 1) AS tp, count(*) FILTER (ground_truth = 0 AND flag = 1) AS fp,
         count(*) FILTER (ground_truth = 1 AND flag = 0) AS fn, count(*) FILTER (ground_truth = 0 AND flag = 0) AS tn
  FROM long GROUP BY method, place), scored AS (
  SELECT method, place, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 4) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) AS recall,
         round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 4) AS f1_score, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy,
         tp + fp AS predicted_anomalies
  FROM cells)"""


# ---- sources, projections, filters ---------------------------------------------------------------------------------

@query("q_scan", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def q_scan(spark, folder):
    return tables.load_table(spark, f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")


@query("q_labeled", f"""WITH {FLOWS} SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, value, CAST(k AS DOUBLE) AS k,
CASE WHEN label = 'attack' THEN 1 ELSE 0 END AS ground_truth FROM flows""")
def q_labeled(spark, folder):
    return tables.labeled(flows(spark, folder), "label", ("event_id",))[0]


@query("q_alias", "SELECT l_orderkey, l_quantity AS sload, l_discount AS dload, l_tax AS sinpkt FROM lineitem")
def q_alias(spark, folder):
    mirror = read(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("Sload"), F.col("l_discount").alias("Dload"), F.col("l_tax").alias("Sintpkt"))
    return tables.alias_columns(mirror)


@query("q_features", "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(DIMS)) + " FROM embeddings")
def q_features(spark, folder):
    df = vectors(spark, folder)
    return df.select("vec_id", *feature_columns(df, None, ("vec_id",)))


@query("q_normalize_label", """SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS ground_truth FROM events""")
def q_normalize_label(spark, folder):
    kind = F.col("event_type")
    word = (
        F.when(kind == "error", " ATTACK ").when(kind == "view", "Malicious").when(kind == "click", "Normal")
        .when(kind == "signup", "no ").otherwise("0")
    )
    return flows(spark, folder).select("event_id", normalize_label(word).alias("ground_truth"))


@query("q_binary_label", """SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS ground_truth FROM events""")
def q_binary_label(spark, folder):
    word = F.when(F.col("event_type") == "view", " BENIGN").when(F.col("event_type") != "click", F.col("event_type"))
    return flows(spark, folder).select("event_id", not_benign(word).alias("ground_truth"))


def cic_style(spark, folder) -> DataFrame:
    """flows4 under the CIC vocabulary, with an infinite rate where the tax is 0."""
    rate = F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.col("l_extendedprice") / F.when(F.col("l_tax") != 0, F.col("l_tax")))
    return flows4(spark, folder).select(
        F.col("id").alias("Flow ID"), F.col("l_quantity").alias("Flow Duration"), rate.alias("Flow Bytes/s"),
        F.when(F.col("l_returnflag") == "N", "BENIGN").otherwise("DoS Hulk").alias("Label"), F.col("label").alias("Label2"),
    )


@query("q_prepare", f"""WITH {FLOWS4} SELECT id AS "Flow ID", l_quantity AS "Flow Duration", l_extendedprice / l_tax AS "Flow Bytes/s",
CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS ground_truth FROM flows4 WHERE l_tax <> 0""")
def q_prepare(spark, folder):
    return benchmarks.prepare_benchmark(cic_style(spark, folder), keep=("Flow ID",))[0]


def unsw_style(spark, folder) -> DataFrame:
    return flows4(spark, folder).select(
        "id", F.col("l_quantity").alias("dur"), F.col("l_extendedprice").alias("sbytes"), F.col("l_discount").alias("Sload"),
        F.col("l_tax").alias("Dload"), "label", "l_returnflag")


@query("q_curated", f"""WITH {FLOWS4} SELECT id, l_quantity AS dur, l_extendedprice AS sbytes, l_discount AS sload, l_tax AS dload, label FROM flows4""")
def q_curated(spark, folder):
    return benchmarks.curated(tables.alias_columns(unsw_style(spark, folder)), keep=("id",))


@query("q_clean_inf", f"""WITH {FLOWS4} SELECT id AS "Flow ID", l_quantity AS "Flow Duration", l_extendedprice / l_tax AS "Flow Bytes/s",
CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS "Label" FROM flows4 WHERE l_tax <> 0""")
def q_clean_inf(spark, folder):
    return benchmarks.numeric_clean(cic_style(spark, folder).drop("Label2"), "Label", ("Flow ID",))


@query("q_time_parse", """SELECT event_id, epoch_us(ts) AS event_us FROM events WHERE event_type <> 'error'""")
def q_time_parse(spark, folder):
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(F.col("ts").cast("string"))
    timed = windows.with_valid_time(flows(spark, folder).withColumn("timestamp", text))
    return timed.select("event_id", F.unix_micros("event_time").alias("event_us"))


@query("q_row_numbers", """WITH g AS (SELECT l_orderkey, count(*) AS lines, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS n, count(*) AS ids, CAST(1 AS BIGINT) AS low, count(*) AS high, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(quantity) AS BIGINT) AS quantity FROM g""")
def q_row_numbers(spark, folder):
    """Numbers of a shuffled table: none is missing or given twice, and no row is lost."""
    grouped = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    return tables.number_rows(grouped).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.min("row_id").alias("low"), F.max("row_id").alias("high"),
        F.sum("l_orderkey").alias("keys"), F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"),
    )


@query("q_union", """SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def q_union(spark, folder):
    c = read(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return tables.union_tables([c, s])


@query("q_flagged", f"WITH {FLAGS} SELECT event_id, value, k FROM flags WHERE is_anomaly = 1")
def q_flagged(spark, folder):
    return metrics.flagged(flag_table(spark, folder), "event_id", columns=["value", "k"])


# ---- aggregates ----------------------------------------------------------------------------------------------------

@query("q_time_window", f"""WITH {FLOWS} SELECT user_id, (epoch_us(ts) // 1800000000) * 1800000000 AS window_us, round(avg(value), 6) AS value_mean,
round(sum(value), 4) AS value_sum, count(value) AS value_count, round(avg(k), 6) AS k_mean, CAST(sum(k) AS BIGINT) AS k_sum, count(k) AS k_count
FROM flows GROUP BY 1, 2""")
def q_time_window(spark, folder):
    out = windows.window_frame(flows(spark, folder), "user_id", 30, "ts", ["value", "k"])
    return out.select("user_id", F.unix_micros("timestamp").alias("window_us"), F.round("value_mean", 6).alias("value_mean"),
                      F.round("value_sum", 4).alias("value_sum"), "value_count", F.round("k_mean", 6).alias("k_mean"), "k_sum", "k_count")


@query("q_col_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in FOUR))
def q_col_stats(spark, folder):
    return stats.column_stats(flows4(spark, folder), FOUR).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("q_confusion", """SELECT t.truth, p.predicted, count(l.doc_id) AS n FROM (VALUES (0), (1)) t(truth) CROSS JOIN (VALUES (0), (1)) p(predicted)
LEFT JOIN labels l ON l.quality = t.truth AND l.toxic = p.predicted GROUP BY 1, 2""")
def q_confusion(spark, folder):
    return metrics.confusion(read(spark, folder, "labels"), "quality", "toxic")


@query("q_metrics", f"WITH {FLAGS}{METHOD_SQL} SELECT * EXCLUDE (place) FROM scored")
def q_metrics(spark, folder):
    return metrics.method_metrics(flag_table(spark, folder))


@query("q_method_counts", f"WITH {FLAGS}{METHOD_SQL} SELECT method, predicted_anomalies AS flagged FROM scored")
def q_method_counts(spark, folder):
    return metrics.method_counts(flag_table(spark, folder))


@query("q_summary", f"""WITH {FLAGS}{METHOD_SQL} SELECT (SELECT count(*) FROM flags) AS rows_processed,
(SELECT CAST(sum(is_anomaly) AS BIGINT) FROM flags) AS anomalies_detected, 'value,k' AS numeric_features, CAST(2.5 AS DOUBLE) AS z_score_threshold,
CAST(0.12 AS DOUBLE) AS model_contamination, true AS metrics_available,
(SELECT method FROM scored ORDER BY f1_score DESC, place LIMIT 1) AS best_method_by_f1""")
def q_summary(spark, folder):
    found = metrics.run_summary(flag_table(spark, folder), ["value", "k"], 2.5, 0.12, "ground_truth")
    return found.withColumn("numeric_features", F.array_join("numeric_features", ","))


@query("q_roc_auc", f"""WITH {FLOWS}, ranked AS (SELECT label, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM flows)
SELECT round((sum(r) FILTER (label = 'attack') - count(*) FILTER (label = 'attack') * (count(*) FILTER (label = 'attack') + 1) / 2.0)
/ (CAST(count(*) FILTER (label = 'attack') AS DOUBLE) * count(*) FILTER (label = 'benign')), 8) AS roc_auc FROM ranked""")
def q_roc_auc(spark, folder):
    df = flows(spark, folder).select("value", normalize_label(F.col("label")).alias("truth"))
    return metrics.roc_auc(df, "truth", "value").select(F.round("roc_auc", 8).alias("roc_auc"))


FOLDS = """, folded AS (SELECT f.*, CAST((row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || {id}), {id}) - 1) % 5 AS INTEGER) AS fold FROM {table} f)"""


@query("q_fold_summary", f"""WITH {FLAGS}{FOLDS.format(label='ground_truth', id='event_id', table='flags')}, per AS (
SELECT fold, count(*) FILTER (ground_truth = 1 AND is_anomaly = 1) AS tp, count(*) FILTER (ground_truth = 0 AND is_anomaly = 1) AS fp,
count(*) FILTER (ground_truth = 1 AND is_anomaly = 0) AS fn, count(*) AS n FROM folded GROUP BY fold), m AS (
SELECT 'ensemble' AS method, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1_score FROM per)
SELECT method, round(avg("precision"), 4) AS precision_mean, round(stddev_pop("precision"), 4) AS precision_std, round(avg(recall), 4) AS recall_mean,
round(stddev_pop(recall), 4) AS recall_std, round(avg(f1_score), 4) AS f1_score_mean, round(stddev_pop(f1_score), 4) AS f1_score_std FROM m GROUP BY method""")
def q_fold_summary(spark, folder):
    folded = sampling.with_folds(flag_table(spark, folder), "ground_truth", "event_id")
    per_fold = metrics.method_metrics(folded, methods={"ensemble": "is_anomaly"}, by=["fold"], digits=None)
    return metrics.fold_summary(per_fold, ["method"], ["precision", "recall", "f1_score"])


@query("q_class_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def q_class_counts(spark, folder):
    return metrics.class_counts(read(spark, folder, "lineitem"), "l_returnflag")


@query("q_class_profile", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(avg({c}) FILTER (l_returnflag = 'A'), 6) AS "mean_A",
round(avg({c}) FILTER (l_returnflag = 'N'), 6) AS "mean_N", round(avg({c}) FILTER (l_returnflag = 'R'), 6) AS "mean_R" FROM lineitem""" for c in FOUR))
def q_class_profile(spark, folder):
    out = metrics.class_profile(read(spark, folder, "lineitem"), "l_returnflag", FOUR, ["A", "N", "R"])
    return out.select("feature", *[F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in "ANR"])


# ---- sort and limit ------------------------------------------------------------------------------------------------

@query("q_flagged_preview", f"""WITH {FLAGS} SELECT event_id, z_score_reason, (SELECT greatest(0, count(*) - 25) FROM flags WHERE is_anomaly = 1) AS omitted
FROM flags WHERE is_anomaly = 1 ORDER BY event_id LIMIT 25""")
def q_flagged_preview(spark, folder):
    return metrics.flagged_preview(flag_table(spark, folder), "event_id", "z_score_reason")


@query("q_uncertain_topk", f"""WITH {FLOWS} SELECT event_id, value / (value + 50.0) AS probability FROM flows
ORDER BY abs(value / (value + 50.0) - 0.5), event_id LIMIT 25""")
def q_uncertain_topk(spark, folder):
    df = flows(spark, folder).select("event_id", (F.col("value") / (F.col("value") + 50.0)).alias("probability"))
    return sampling.uncertain_queries(df, "probability", "event_id", 25)


@query("q_random_queries", f"""WITH {FLOWS} SELECT event_id, value FROM flows ORDER BY md5('42:' || event_id), event_id LIMIT 25""")
def q_random_queries(spark, folder):
    return sampling.random_queries(flows(spark, folder).select("event_id", "value"), "event_id", 25)


@query("q_scatter_points", f"""WITH {FLAGS} SELECT event_id, value AS x, k AS y, is_anomaly FROM flags ORDER BY md5('42:' || event_id) LIMIT 500""")
def q_scatter_points(spark, folder):
    return metrics.scatter_points(flag_table(spark, folder), "value", "k", "event_id", 500)


# ---- detectors -----------------------------------------------------------------------------------------------------

Z4 = "greatest(" + ", ".join(f"abs({c} - m_{c}) / s_{c}" for c in FOUR) + ")"
S4 = "s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FOUR) + " FROM flows4)"


@query("q_zscore", f"WITH {FLOWS4}, {S4} SELECT id, round({Z4}, 4) AS z_score_max, CAST({Z4} >= 1.7 AS INTEGER) AS z_score_flag FROM flows4, s")
def q_zscore(spark, folder):
    df = flows4(spark, folder)
    return stats.with_zscore(df, stats.fit_stats(df, FOUR), 1.7, reason=False).select("id", "z_score_max", "z_score_flag")


@query("q_zscore_reason", f"""WITH {FLOWS}, s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM flows),
z AS (SELECT event_id, value, k, abs(value - mv) / sv AS zv, abs(k - mk) / sk AS zk FROM flows, s)
SELECT event_id, coalesce(nullif(concat_ws('; ', CASE WHEN zv >= 1.5 THEN printf('value=%s (z=%.2f)', CAST(value AS VARCHAR), zv) END,
CASE WHEN zk >= 1.5 THEN printf('k=%s (z=%.2f)', CAST(k AS VARCHAR), zk) END), ''), 'baseline behavior') AS z_score_reason FROM z""")
def q_zscore_reason(spark, folder):
    df = flows(spark, folder)
    return stats.with_zscore(df, stats.fit_stats(df, ["value", "k"]), 1.5).select("event_id", "z_score_reason")


@query("q_scale", f"WITH {FLOWS4}, {S4} SELECT id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in FOUR) + " FROM flows4, s")
def q_scale(spark, folder):
    df = flows4(spark, folder)
    x = stats.with_scaled(df, stats.fit_stats(df, FOUR), "x")
    return x.select("id", *[F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate(FOUR)])


def scaled_view(df: DataFrame, features: list[str], id_col: str):
    """(scaled rows, stats) of a view."""
    clean = report.clean_rows(df, features)
    fitted = stats.fit_stats(clean, features)
    return report.scaled_rows(clean, features, id_col, fitted), fitted


SCALED4 = f"{FLOWS4}, {S4}, scaled4 AS (SELECT id, " + ", ".join(f"(({c} - m_{c}) / s_{c}) AS {c}" for c in FOUR) + " FROM flows4, s)"


@query("q_iforest", f"""WITH {SCALED4},
{iforest.forest_sql('scaled4', FOUR)},
nine AS (SELECT id, round(score, 9) AS score FROM forest_scores), cut AS (SELECT quantile_cont(score, 0.88) AS c FROM nine)
SELECT id, round(score, 4) AS isolation_forest_score, CAST(score > c AS INTEGER) AS isolation_forest_flag FROM nine, cut""")
def q_iforest(spark, folder):
    rows, fitted = scaled_view(flows4(spark, folder), FOUR, "id")
    return report.forest_flags(rows, "id", fitted.rows).withColumn("isolation_forest_score", F.round("isolation_forest_score", 4))


LOF_SQL = """WITH long AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY i),
scaled AS (SELECT vec_id, list(CASE WHEN sd = 0 THEN 0.0 ELSE (v - m) / sd END ORDER BY i) AS x FROM long JOIN s USING (i) GROUP BY vec_id),
points AS (SELECT x, min(vec_id) AS p, count(*) AS w FROM scaled GROUP BY x),
pairs AS (SELECT a.p, b.p AS q, CASE WHEN a.p = b.p THEN 0.0 ELSE list_distance(a.x, b.x) END AS d, CASE WHEN a.p = b.p THEN b.w - 1 ELSE b.w END AS w
FROM points a, points b WHERE a.p <> b.p OR a.w > 1),
filled AS (SELECT *, sum(w) OVER (PARTITION BY p ORDER BY d, q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w AS before FROM pairs),
near AS (SELECT p, q, d, least(w, 20 - before) AS w FROM filled WHERE before < 20),
kd AS (SELECT p, max(d) AS kd FROM near GROUP BY p),
lrd AS (SELECT near.p, 1 / (sum(w * greatest(kd.kd, d)) / sum(w) + 1e-10) AS lrd FROM near JOIN kd ON kd.p = near.q GROUP BY near.p),
lof AS (SELECT near.p, sum(w * nb.lrd) / sum(w) / any_value(me.lrd) AS lof FROM near JOIN lrd nb ON nb.p = near.q JOIN lrd me ON me.p = near.p GROUP BY near.p),
rows_ AS (SELECT scaled.vec_id, lof.lof FROM scaled JOIN points USING (x) JOIN lof ON lof.p = points.p),
cut AS (SELECT quantile_cont(lof, 0.88) AS c FROM rows_)
SELECT vec_id, round(lof, 4) AS lof_score, CAST(lof > c AS INTEGER) AS lof_flag FROM rows_, cut"""


@query("q_lof", LOF_SQL)
def q_lof(spark, folder):
    rows, _ = scaled_view(vectors(spark, folder), [f"e{i}" for i in range(DIMS)], "vec_id")
    return report.lof_flags(rows, "vec_id").withColumn("lof_score", F.round("lof_score", 4))


@query("q_lof_flows")
def q_lof_flows(spark, folder):
    rows, _ = scaled_view(flows4(spark, folder), FOUR, "id")
    return report.lof_flags(rows, "id").withColumn("lof_score", F.round("lof_score", 4))


@query("q_lof_lsh", """SELECT count(*) AS points, CAST(count(*) * 20 AS BIGINT) AS neighbours, true AS recall_reached,
CAST(count(*) - 1 - floor((count(*) - 1) * 0.88) AS BIGINT) AS flagged, true AS flags_agree FROM embeddings""")
def q_lof_lsh(spark, folder):
    """Neighbours and factors from hash tables, held against the exact ones: how many there are, and whether recall and flags come up to 0.9."""
    rows, fitted = scaled_view(vectors(spark, folder), [f"e{i}" for i in range(DIMS)], "vec_id")
    points = durable(knn.weighted_points(rows), "points", fitted.rows)
    exact = knn.nearest_neighbours(points, fitted.rows, DIMS, 20).select("key", F.array_max("dist").alias("far"))
    near = lsh.hashed_neighbours(points, fitted.rows, DIMS, 20, bucket=128).near.join(exact, "key")
    inside = F.aggregate(F.filter("dist", lambda v: v <= F.col("far") * (1 + 1e-9)), F.lit(0), lambda a, _: a + 1)
    searched = near.agg(F.count(F.lit(1)).alias("points"), F.sum(F.size("q")).alias("neighbours"), (F.avg(inside / 20.0) >= 0.9).alias("recall_reached"))
    flags = report.lof_flags(rows, "vec_id", search="hashed").select("vec_id", "lof_flag").join(report.lof_flags(rows, "vec_id").select("vec_id", F.col("lof_flag").alias("exact_flag")), "vec_id")
    both = flags.agg(F.sum("lof_flag").cast("bigint").alias("flagged"), (F.sum(F.col("lof_flag") * F.col("exact_flag")) >= 0.9 * F.sum("exact_flag")).alias("flags_agree"))
    return searched.join(F.broadcast(both))  # one row each


@query("q_ocsvm")
def q_ocsvm(spark, folder):
    rows, fitted = scaled_view(flows4(spark, folder), FOUR, "id")
    return report.svm_flags(rows, "id", fitted, fitted.rows).withColumn("one_class_svm_score", F.round("one_class_svm_score", 4))


@query("q_vote", f"WITH {FLAGS} SELECT event_id, ensemble_votes, is_anomaly FROM flags")
def q_vote(spark, folder):
    return flag_table(spark, folder).select("event_id", "ensemble_votes", "is_anomaly")


@query("q_reason", f"""WITH {FLAGS} SELECT event_id, CASE WHEN is_anomaly = 0 THEN 'baseline behavior' ELSE concat_ws('; ',
CASE WHEN z_score_flag = 1 THEN z_score_reason END, CASE WHEN isolation_forest_flag = 1 THEN '{ensemble.MODEL_REASONS['isolation_forest_flag']}' END,
CASE WHEN lof_flag = 1 THEN '{ensemble.MODEL_REASONS['lof_flag']}' END, CASE WHEN one_class_svm_flag = 1 THEN '{ensemble.MODEL_REASONS['one_class_svm_flag']}' END)
END AS anomaly_reason, CASE WHEN is_anomaly = 0 THEN '' ELSE concat_ws(',', CASE WHEN z_score_flag = 1 THEN 'Z_SCORE' END,
CASE WHEN isolation_forest_flag = 1 THEN 'ISOLATION_FOREST' END, CASE WHEN lof_flag = 1 THEN 'LOCAL_OUTLIER_FACTOR' END,
CASE WHEN one_class_svm_flag = 1 THEN 'ONE_CLASS_SVM' END) END AS reason_codes FROM flags""")
def q_reason(spark, folder):
    return ensemble.with_reason(flag_table(spark, folder)).select("event_id", "anomaly_reason", F.array_join("reason_codes", ",").alias("reason_codes"))


FLAGGED = "CAST(n - 1 - floor((n - 1) * 0.88) AS BIGINT)"


@query("q_report", f"""WITH {FLOWS}, s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk, count(*) AS n FROM flows),
scaled2 AS (SELECT event_id AS id, (value - mv) / sv AS value, (k - mk) / sk AS k FROM flows, s),
{iforest.forest_sql('scaled2', ['value', 'k'])},
nine AS (SELECT id, round(score, 9) AS score FROM forest_scores), cut AS (SELECT quantile_cont(score, 0.88) AS c FROM nine)
SELECT event_id, flows.value, CAST(abs((flows.value - mv) / sv) >= 2.5 OR abs((flows.k - mk) / sk) >= 2.5 AS INTEGER) AS z_score_flag, round(score, 4) AS isolation_forest_score,
CAST(score > c AS INTEGER) AS isolation_forest_flag, CASE WHEN label = 'attack' THEN 1 ELSE 0 END AS ground_truth, true AS votes_agree, true AS reasons_agree,
{FLAGGED} AS lof_flagged, {FLAGGED} AS one_class_svm_flagged FROM flows JOIN nine ON id = event_id, s, cut""")
def q_report(spark, folder):
    """The whole report; of what SQL cannot say (two detectors, the texts) there remain the numbers of flags and whether votes and reasons follow from them."""
    done = durable(report.build_report(flows(spark, folder), ["value", "k"], "event_id", "label"), "report")
    flags = [f for f in metrics.METHODS.values() if f != "is_anomaly"]
    votes = sum((F.col(f) for f in flags), F.lit(0))
    agree = (F.col("ensemble_votes") == votes) & (F.col("is_anomaly") == (votes >= 2).cast("int"))
    named = (F.col("anomaly_reason") != stats.BASELINE) == (F.col("is_anomaly") == 1)
    codes = F.when(F.col("is_anomaly") == 1, F.size("reason_codes") == votes).otherwise(F.size("reason_codes") == 0)
    totals = done.agg(F.sum("lof_flag").cast("bigint").alias("lof_flagged"), F.sum("one_class_svm_flag").cast("bigint").alias("one_class_svm_flagged"))
    kept = done.select("event_id", "value", "z_score_flag", "isolation_forest_score", "isolation_forest_flag", "ground_truth", agree.alias("votes_agree"), (named & codes).alias("reasons_agree"))
    return kept.join(F.broadcast(totals))  # one row


@query("q_unusual_windows", f"""WITH {FLOWS}, w AS (SELECT user_id, (epoch_us(ts) // 1800000000) * 1800000000 AS window_us, avg(value) AS value_mean,
sum(value) AS value_sum, count(value) AS value_count, avg(k) AS k_mean, sum(k) AS k_sum, count(k) AS k_count FROM flows GROUP BY 1, 2),
s AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("value_mean", "value_sum", "value_count", "k_mean", "k_sum", "k_count")) + """ FROM w),
z AS (SELECT user_id, window_us, greatest(""" + ", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE abs({c} - m_{c}) / s_{c} END" for c in ("value_mean", "value_sum", "value_count", "k_mean", "k_sum", "k_count")) + """) AS zmax FROM w, s)
SELECT user_id, window_us, round(zmax, 4) AS z_score_max FROM z WHERE zmax >= 2.5""")
def q_unusual_windows(spark, folder):
    """Which source and window is unusual: window aggregates, then z-scores on them."""
    return unusual_windows(spark, folder).select("user_id", F.unix_micros("timestamp").alias("window_us"), "z_score_max")


def unusual_windows(spark, folder) -> DataFrame:
    framed = durable(windows.window_frame(flows(spark, folder), "user_id", 30, "ts", ["value", "k"]), "windows")
    names = feature_columns(framed, None, ("user_id",))
    scored = stats.with_zscore(framed, stats.fit_stats(framed, names), 2.5)
    return scored.where("z_score_flag = 1")


# ---- streaming -----------------------------------------------------------------------------------------------------

ARRIVALS, LATE_MS = 3, 3_600_000
STREAM_STATS = ("value_mean", "value_sum", "value_count", "k_mean", "k_sum", "k_count")


@query("q_stream_windows", f"""WITH {FLOWS}, span AS (SELECT epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM flows),
timed AS (SELECT user_id, value, k, epoch_us(ts) AS us, (epoch_us(ts) // 1800000000) * 1800000000 AS window_us,
  least({ARRIVALS - 1}, {ARRIVALS} * (epoch_us(ts) - t0) // (t1 - t0) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS arrival FROM flows, span),
tops AS (SELECT arrival, max(us) AS top FROM timed GROUP BY arrival),
marks AS (SELECT a.arrival, (SELECT max(top) // 1000 - {LATE_MS} FROM tops b WHERE b.arrival < a.arrival) AS mark FROM tops a),
judged AS (SELECT timed.*, coalesce((window_us + 1800000000) // 1000 <= mark, false) AS late FROM timed JOIN marks USING (arrival)),
dropped AS (SELECT count(*) AS late_groups FROM (SELECT DISTINCT arrival, user_id, window_us FROM judged WHERE late)),
w AS (SELECT user_id, window_us, avg(value) AS value_mean, sum(value) AS value_sum, count(value) AS value_count, avg(k) AS k_mean, sum(k) AS k_sum, count(k) AS k_count
  FROM judged WHERE NOT late GROUP BY 1, 2),
base AS (SELECT user_id, window_us, avg(value) AS value_mean, sum(value) AS value_sum, count(value) AS value_count, avg(k) AS k_mean, sum(k) AS k_sum, count(k) AS k_count
  FROM judged WHERE arrival = 0 GROUP BY 1, 2),
s AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in STREAM_STATS) + """ FROM base)
SELECT user_id, window_us, round(value_sum, 4) AS value_sum, value_count, round(greatest(""" + ", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE abs({c} - m_{c}) / s_{c} END" for c in STREAM_STATS) + f"""), 4) AS z_score_max, late_groups
FROM w, s, dropped WHERE (window_us + 1800000000) // 1000 <= (SELECT max(top) // 1000 - {LATE_MS} FROM tops)""")
def q_stream_windows(spark, folder):
    """Events arrive in three loads, a tenth of them a load too late. A stream reads each load, going on from the state the last one left, and scores closed windows against saved statistics."""
    seen = flows(spark, folder).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    t0, t1 = seen.agg(F.min("us"), F.max("us")).first()
    t0, t1 = t0 or 0, t1 or 0
    load = F.expr(f"({ARRIVALS} * (us - {t0})) div {max(1, t1 - t0)}") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    loads = durable(seen.withColumn("arrival", F.least(F.lit(ARRIVALS - 1), load)).select("user_id", "ts", "value", "k", "arrival"), "stream-loads")
    rows = loads.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "k", "arrival")
    first = windows.window_frame(rows.where("arrival = 0"), "user_id", 30, "ts", ["value", "k"])
    saved = durable(stats.fit_stats(first, list(STREAM_STATS)).table(spark), "stream-stats")
    inbox, target, state = (scratch_folder(spark, f"stream-{name}") for name in ("inbox", "windows", "state"))
    runs = []
    for k in range(ARRIVALS):
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.drop("arrival").schema).parquet(inbox)
        runs.append(stream_windows.run_available(stream, "user_id", 30, ["value", "k"], stats.ColumnStats.from_table(saved), target, state, "ts"))
    closed = spark.read.schema(runs[-1].schema).parquet(target)
    return closed.select("user_id", F.unix_micros("timestamp").alias("window_us"), F.round("value_sum", 4).alias("value_sum"), "value_count", "z_score_max",
                         F.lit(sum(r.late_groups for r in runs)).cast("bigint").alias("late_groups"))


# ---- samples and folds ---------------------------------------------------------------------------------------------

@query("q_balanced_sample", f"""WITH {FLOWS} SELECT event_id, label FROM flows QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id)) <= 150""")
def q_balanced_sample(spark, folder):
    return sampling.balanced_sample(flows(spark, folder).select("event_id", "label"), "label", "event_id", 150)


@query("q_folds", f"""WITH {FLOWS}{FOLDS.format(label='label', id='event_id', table='flows')} SELECT event_id, label, fold FROM folded""")
def q_folds(spark, folder):
    return sampling.with_folds(flows(spark, folder).select("event_id", "label"), "label", "event_id")


@query("q_label_subset", f"""WITH {FLOWS}, r AS (SELECT event_id, CASE WHEN label = 'attack' THEN 1 ELSE 0 END AS truth,
row_number() OVER (ORDER BY md5('42:' || event_id)) AS rn, greatest(4, round_even(0.05 * count(*) OVER (), 0)) AS size FROM flows)
SELECT event_id, truth FROM r WHERE rn <= size""")
def q_label_subset(spark, folder):
    df = flows(spark, folder).select("event_id", normalize_label(F.col("label")).alias("truth"))
    return sampling.labeled_subset(df, "truth", "event_id", 0.05)


@query("q_seed_labels", f"""WITH {FLOWS} SELECT event_id, CASE WHEN label = 'attack' THEN 1 ELSE 0 END AS truth FROM flows
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id)) <= 5""")
def q_seed_labels(spark, folder):
    df = flows(spark, folder).select("event_id", normalize_label(F.col("label")).alias("truth"))
    return sampling.seed_labels(df, "truth", "event_id")


@query("q_prepare_subset", f"""WITH {FLOWS}, {FLOWS4}, both_ AS (SELECT 'e' || event_id AS id, value AS dur, CAST(k AS BIGINT) AS spkts, CAST(label = 'attack' AS INTEGER) AS label FROM flows
UNION ALL SELECT 'l' || id, l_quantity, CAST(l_discount * 100 AS BIGINT), label FROM flows4)
SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) <= 400""")
def q_prepare_subset(spark, folder):
    train = flows(spark, folder).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("value").alias("dur"), F.col("k").alias("Spkts"), F.when(F.col("label") == "attack", 1).otherwise(0).alias("label"))
    test = flows4(spark, folder).select(F.concat(F.lit("l"), F.col("id")).alias("id"), F.col("l_quantity").alias("dur"), F.round(F.col("l_discount") * 100).cast("bigint").alias("Spkts"), "label")
    return subsets.prepare_unsw([train, test], "id", 400)


@query("q_prepare_cic", f"""WITH {FLOWS4}, wide AS (SELECT id AS "Flow ID", l_quantity AS "Flow Duration", l_extendedprice / l_tax AS "Flow Bytes/s",
CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS "Label" FROM flows4 WHERE l_tax <> 0), picked AS (
SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY md5('42:' || "Flow ID")) AS place FROM wide)
SELECT "Flow ID", "Flow Duration", "Flow Bytes/s", "Label", place, (SELECT count(*) FROM picked WHERE place <= 700 AND "Label" = 1) AS attacks
FROM picked WHERE place <= 700""")
def q_prepare_cic(spark, folder):
    """Two files of flows, prepared into a written subset and read back: rows, their place in the written order, and the rows of the attack folder alone."""
    whole = cic_style(spark, folder).drop("Label2")
    halves = F.pmod(F.xxhash64("Flow ID"), F.lit(2))
    paths = []
    for k in (0, 1):
        paths.append(f"{scratch_folder(spark, 'cic')}/part{k}.parquet")
        whole.where(halves == k).write.parquet(paths[k])
    target = scratch_folder(spark, "cic-subset")
    subset = subsets.prepare_files(spark, "cic", paths, target, "Flow ID", 700, rows_per_file=300)
    # The place of a row by file and position, as a reader of the folder meets it.
    placed = subset.withColumn("at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    order = Window.partitionBy("Label").orderBy("at")
    attacks = subset.where("Label = 1").count()
    return placed.withColumn("place", F.row_number().over(order).cast("bigint")).drop("at").withColumn("attacks", F.lit(attacks).cast("bigint"))


# ---- experiments ---------------------------------------------------------------------------------------------------

def scaled_sql(columns: list[str]) -> str:
    return ", ".join(f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER () AS x{i}" for i, c in enumerate(columns))


SUMMARY = ", ".join(f'round(avg("{m}"), 4) AS {m}_mean, round(stddev_pop("{m}"), 4) AS {m}_std' for m in supervised.METRICS)


@query("q_lr_cv", f"""WITH {FLOWS4}{FOLDS.format(label='label', id='id', table='flows4')}, scaled AS MATERIALIZED (SELECT id, label AS y, fold, {scaled_sql(FOUR)} FROM folded),
train AS MATERIALIZED (SELECT k.arm, s.* FROM scaled s JOIN (SELECT unnest(range(5)) AS arm) k ON s.fold <> k.arm),
{logistic_sql('train', 4, 8, 'lr')},
scored AS (SELECT fold, y, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 + w4))) AS p FROM scaled JOIN lr_fit ON fold = arm),
ranked AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS r FROM scored),
counts AS (SELECT fold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, sum(r) FILTER (y = 1) AS ranks, count(*) FILTER (y = 1 AND p > 0.5) AS tp,
count(*) FILTER (y = 0 AND p > 0.5) AS fp FROM ranked GROUP BY fold),
m AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision", tp / pos AS recall, 2 * tp / (tp + fp + pos) AS f1_score,
(tp + neg - fp) / (pos + neg) AS accuracy, (ranks - pos * (pos + 1) / 2.0) / (CAST(pos AS DOUBLE) * neg) AS roc_auc FROM counts)
SELECT 'logistic_regression' AS model, {SUMMARY} FROM m""")
def q_lr_cv(spark, folder):
    return supervised.cross_validate(flows4(spark, folder), FOUR, "label", "id")


@query("q_rf_cv")
def q_rf_cv(spark, folder):
    return supervised.cross_validate(texts(spark, folder), TEXT_FEATURES, "label", "doc_id", "random_forest")


@query("q_supervised")
def q_supervised(spark, folder):
    """Both supervised baselines on the same folds."""
    return supervised.baselines(texts(spark, folder), TEXT_FEATURES, "label", "doc_id")


@query("q_benchmark")
def q_benchmark(spark, folder):
    df, names, schema = benchmarks.prepare_benchmark(flows(spark, folder).drop("ts", "user_id"), keep=("event_id",))
    found = supervised.compare_benchmark(df, names, "ground_truth", "event_id", schema)
    return found.withColumn("numeric_features", F.array_join("numeric_features", ","))


TEXTS = r"""texts AS (SELECT doc_id, chars, words, lines, size / words AS word_length, length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(size, 1) AS digit_share,
length(regexp_replace(text, '[\p{L}\p{N} \t\n\x0B\f\r]', '', 'g')) / greatest(size, 1) AS sign_share, quality AS label FROM (
SELECT doc_id, text, CAST(n_chars AS DOUBLE) AS chars, CAST(len(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS DOUBLE) AS words,
CAST(len(string_split(text, chr(10))) AS DOUBLE) AS lines, length(text) AS size FROM documents) JOIN labels USING (doc_id) WHERE text IS NOT NULL AND chars IS NOT NULL AND quality IS NOT NULL)"""


@query("q_self_training", f"""WITH {TEXTS}{FOLDS.format(label='label', id='doc_id', table='texts')}, scaled AS MATERIALIZED (SELECT doc_id AS id, label AS y, fold, {scaled_sql(TEXT_FEATURES)} FROM folded),
{label_budget.budget_sql('scaled', 6, [0.05])} SELECT * FROM f1s""")
def q_self_training(spark, folder):
    return label_budget.self_training(texts(spark, folder), TEXT_FEATURES, "label", "doc_id", 0.05)


@query("q_label_budget", f"""WITH {FLOWS}, clean AS (SELECT event_id, value, k, CAST(label = 'attack' AS INTEGER) AS truth FROM flows WHERE isfinite(value) AND k IS NOT NULL)
{FOLDS.format(label='truth', id='event_id', table='clean')}, scaled AS MATERIALIZED (SELECT event_id AS id, truth AS y, fold, {scaled_sql(['value', 'k'])} FROM folded),
{label_budget.budget_sql('scaled', 2, label_budget.BUDGETS)}
SELECT labeled_fraction, {', '.join(f"round(avg(f1) FILTER (kind = '{m}'), 4) AS {m}_f1, round(stddev_pop(f1) FILTER (kind = '{m}'), 4) AS {m}_f1_std" for m in ('supervised', 'self_training'))},
CAST(greatest(4, round_even(labeled_fraction * (SELECT count(*) FROM scaled) * 4 / 5, 0)) AS BIGINT) AS approx_labeled_rows FROM f1s GROUP BY labeled_fraction""")
def q_label_budget(spark, folder):
    df = flows(spark, folder).select("event_id", "value", "k", normalize_label(F.col("label")).alias("truth"))
    return label_budget.label_budget(df, ["value", "k"], "truth", "event_id")


@query("q_active_fold")
def q_active_fold(spark, folder):
    return active_learning.active_fold(texts(spark, folder), TEXT_FEATURES, "label", "doc_id", "uncertainty")


@query("q_active_curve")
def q_active_curve(spark, folder):
    df = flows(spark, folder).select("event_id", "value", "k", normalize_label(F.col("label")).alias("truth"))
    return active_learning.strategy_curve(df, ["value", "k"], "truth", "event_id")
