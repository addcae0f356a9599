"""How many labels are needed: supervised fits and self-training over a sweep of label fractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.logistic import fit_arms, logistic_sql, sigmoid, test_counts, with_intercept
from flowsieve.operators.metrics import scores_from_counts
from flowsieve.operators.sampling import subset_cuts, subset_ranks
from flowsieve.plans.experiment import experiment_table

# The label fractions of the sweep.
BUDGETS = [0.002, 0.005, 0.01, 0.02, 0.05, 0.10, 0.25, 0.50, 1.00]
CONFIDENCE = 0.75
ROUNDS = 10
COLUMNS = ["x", "truth", "fold", "keys"]


class Arms:
    """Labelled rows of every (fraction, fold) arm, as hash cuts per class.

    A row that self-training promoted is not stored anywhere: its label is what the first model of the arm
    that was sure enough about it says, so the list of models is the whole state.
    """

    def __init__(self, pairs: list[tuple[float, int]], cuts: np.ndarray):
        self.pairs = pairs
        self.folds = np.array([k for _, k in pairs])
        self.cuts = cuts

    def labels(self, models: np.ndarray, usable: np.ndarray):
        """``models`` is (rounds, arms, width); ``usable[r, a]`` tells which of them exist."""
        folds, cuts = self.folds, self.cuts

        def label(cols, x):
            truth = cols["truth"].astype(np.int64)
            train = cols["fold"][:, None] != folds[None, :]
            limit = np.where(truth[:, None] == 1, cuts[None, :, 1], cuts[None, :, 0])
            known = train & (cols["keys"][:, folds] <= limit)
            y = np.where(known, truth[:, None], -1).astype(np.int8)
            if len(models):
                x1 = with_intercept(x)
                for r in range(len(models)):
                    p = sigmoid(x1 @ models[r].T)
                    sure = train & (y < 0) & usable[r][None, :] & (np.maximum(p, 1 - p) > CONFIDENCE)
                    y[sure] = (p > 0.5)[sure]
            return y

        return label


def make_arms(table: DataFrame, budgets: list[float], folds: int) -> Arms:
    order = table.select(
        "truth", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))).alias("k"), "keys"
    ).select("truth", "k", F.element_at("keys", F.col("k") + 1).alias("key"))
    rows = {r["k"]: r["count"] for r in order.groupBy("k").count().collect()}
    sizes = {k: [subset_ranks(n, f) for f in budgets] for k, n in rows.items()}
    found = subset_cuts(order, "k", "truth", "key", sizes)
    pairs = [(f, k) for f in budgets for k in range(folds)]
    cuts = np.array([[found[(k, subset_ranks(rows[k], f))][c] for c in (0, 1)] for f, k in pairs])
    return Arms(pairs, cuts)


def self_train(table: DataFrame, arms: Arms, first: np.ndarray, rows: dict[int, float]) -> np.ndarray:
    """Weights after self-training, from the models of the labelled rows alone."""
    models, usable = [first], [np.ones(len(first), dtype=bool)]
    final, known = first.copy(), dict(rows)
    open_arms = list(range(len(first)))
    for _ in range(ROUNDS):
        labels = arms.labels(np.array(models), np.array(usable))
        beta, now = fit_arms(table, COLUMNS, labels, final, open_arms, known)
        open_arms = [a for a in open_arms if now[a] != known[a]]
        if not open_arms:
            break
        step = np.zeros(len(first), dtype=bool)
        step[open_arms] = True
        final[open_arms] = beta[open_arms]
        known.update({a: now[a] for a in open_arms})
        models.append(final.copy())
        usable.append(step)
    return final


def _f1_rows(table: DataFrame, arms: Arms, beta: np.ndarray, kind: str) -> DataFrame:
    lookup = table.sparkSession.createDataFrame(
        [(i, float(f), k, kind) for i, (f, k) in enumerate(arms.pairs)], "arm int, labeled_fraction double, fold int, kind string"
    )
    counts = test_counts(table, ["x", "truth", "fold"], beta, list(arms.folds))
    f1 = scores_from_counts(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])["f1_score"]
    return counts.join(F.broadcast(lookup), "arm").select("kind", "labeled_fraction", "fold", f1.alias("f1"))


def budget_folds(df: DataFrame, features: list[str], truth: str, id_col: str, budgets: list[float] = BUDGETS, folds: int = 5,
                 seed: int = 42) -> tuple[DataFrame, int]:
    """F1 per (kind, labeled_fraction, fold), and the number of rows."""
    table = experiment_table(df, features, truth, id_col, folds, seed, keys=True)
    arms = make_arms(table, budgets, folds)
    width = len(features) + 1
    none = np.zeros((0, len(arms.pairs), width))
    first, rows = fit_arms(table, COLUMNS, arms.labels(none, np.zeros((0, len(arms.pairs)), dtype=bool)), np.zeros((len(arms.pairs), width)))
    trained = self_train(table, arms, first, rows)
    out = _f1_rows(table, arms, first, "supervised").unionAll(_f1_rows(table, arms, trained, "self_training"))
    return out, table.count()


def label_budget(df: DataFrame, features: list[str], truth: str, id_col: str, budgets: list[float] = BUDGETS, folds: int = 5,
                 seed: int = 42) -> DataFrame:
    """One row per fraction: approximate labels, F1 mean and deviation of both kinds."""
    scores, total = budget_folds(df, features, truth, id_col, budgets, folds, seed)
    aggs = []
    for kind in ("supervised", "self_training"):
        value = F.when(F.col("kind") == kind, F.col("f1"))
        aggs += [F.round(F.avg(value), 4).alias(f"{kind}_f1"), F.round(F.stddev_pop(value), 4).alias(f"{kind}_f1_std")]
    approx = F.greatest(F.lit(4), F.rint(F.col("labeled_fraction") * total * (folds - 1) / folds).cast("bigint"))
    return scores.groupBy("labeled_fraction").agg(*aggs).withColumn("approx_labeled_rows", approx)


def self_training(df: DataFrame, features: list[str], truth: str, id_col: str, fraction: float, folds: int = 5, seed: int = 42) -> DataFrame:
    """F1 per fold with and without self-training, for one label fraction."""
    return budget_folds(df, features, truth, id_col, [fraction], folds, seed)[0]


def budget_sql(rows: str, width: int, budgets: list[float], folds: int = 5, seed: int = 42, steps: int = 9) -> str:
    """``budget_folds`` in SQL (DuckDB), to check results: table expressions ending in ``f1s`` (kind, labeled_fraction, fold, f1).

    ``rows`` holds id, y, fold and scaled x0... Every arm goes through all rounds: one that promotes no row is fitted to the same rows again.
    """
    z = " + ".join([*[f"w{i} * x{i}" for i in range(width)], f"w{width}"])
    out = [
        "budgets AS (SELECT unnest([" + ", ".join(map(repr, budgets)) + "]::DOUBLE[]) AS fraction, unnest(range(" + str(len(budgets)) + ")) AS place)",
        f"""ordered AS MATERIALIZED (SELECT k.k, r.*, row_number() OVER (PARTITION BY k.k ORDER BY md5('{seed}:' || k.k || ':' || id)) AS rn, count(*) OVER (PARTITION BY k.k) AS n
FROM {rows} r JOIN (SELECT unnest(range({folds})) AS k) k ON r.fold <> k.k)""",
        "late AS (SELECT k, max(first) AS late FROM (SELECT k, y, min(rn) AS first FROM ordered GROUP BY k, y) GROUP BY k)",
        f"""arms AS MATERIALIZED (SELECT place * {folds} + k AS arm, fraction, k, y AS truth, o.* EXCLUDE (k, y, n), late, least(n, greatest(4, round_even(fraction * n, 0))) AS size
FROM ordered o JOIN late USING (k) CROSS JOIN budgets)""",
        "known0 AS MATERIALIZED (SELECT *, CASE WHEN CASE WHEN late <= size THEN rn <= size ELSE rn < size OR rn = late END THEN truth END AS label FROM arms)",
    ]
    for r in range(ROUNDS + 1):
        if r:
            out.append(f"""known{r} AS MATERIALIZED (SELECT * EXCLUDE (label, p), CASE WHEN label IS NULL AND greatest(p, 1 - p) > {CONFIDENCE} THEN CAST(p > 0.5 AS INTEGER) ELSE label END AS label
FROM (SELECT a.*, 1 / (1 + exp(-({z}))) AS p FROM known{r - 1} a JOIN m{r - 1}_fit USING (arm)))""")
        out += [f"train{r} AS MATERIALIZED (SELECT arm, label AS y, {', '.join(f'x{i}' for i in range(width))} FROM known{r} WHERE label IS NOT NULL)", logistic_sql(f"train{r}", width, steps, f"m{r}")]
    out.append(f"""f1s AS (SELECT kind, fraction AS labeled_fraction, CAST(k AS INTEGER) AS fold, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (
SELECT kind, fraction, k, count(*) FILTER (y = 1 AND hit) AS tp, count(*) FILTER (y = 0 AND hit) AS fp, count(*) FILTER (y = 1 AND NOT hit) AS fn FROM (
SELECT kind, fraction, k, y, {z} > 0 AS hit FROM (SELECT 'supervised' AS kind, * FROM m0_fit UNION ALL SELECT 'self_training', * FROM m{ROUNDS}_fit)
JOIN (SELECT DISTINCT arm, fraction, k FROM arms) USING (arm) JOIN {rows} r ON r.fold = k) GROUP BY kind, fraction, k))""")
    return ",\n".join(out)
