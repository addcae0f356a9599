"""Active learning: random against uncertainty queries, all folds and strategies side by side.

One pass over the table per round scores every arm: it counts the arm's test fold and finds its next queries.
What an arm has labelled so far is at most ``budget`` rows, so it lives on the driver.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.arrow import batch_columns
from flowsieve.operators.logistic import _step, _sums, sigmoid, with_intercept
from flowsieve.operators.metrics import scores_from_counts
from flowsieve.operators.sampling import hash_cuts
from flowsieve.plans.experiment import experiment_table

STRATEGIES = ["random", "uncertainty"]


def _fit_small(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic model of one arm on its few labelled rows."""
    x1 = with_intercept(x)
    beta = np.zeros(x1.shape[1])
    objective, step, _ = _step(_sums(x1, y, beta), beta)
    for _ in range(100):
        trial = beta - step
        value, following, _ = _step(_sums(x1, y, trial), trial)
        if value > objective + 1e-9 * (1.0 + abs(objective)):
            step = step / 2
        else:
            beta, objective, step = trial, value, following
        if np.abs(step).max() <= 1e-8 * (1.0 + np.abs(beta).max()):
            return beta
    warnings.warn("A logistic fit on labelled rows had not converged after 100 steps.", stacklevel=2)
    return beta


def _round(table: DataFrame, beta: np.ndarray, folds: np.ndarray, picks: np.ndarray, exclude: list[np.ndarray]) -> DataFrame:
    """Rows of two kinds: test counts per arm (rank 0) and the best candidates of each task per arm.

    ``picks[a]`` is how many rows arm a wants to query by uncertainty; ``exclude[a]`` holds the order keys of its labelled rows.
    """

    def run(batches):
        counts = np.zeros((len(folds), 4), dtype=np.int64)
        best: list[list[tuple]] = [[] for _ in folds]
        for batch in batches:
            cols = batch_columns(batch)
            z = with_intercept(cols["x"]) @ beta.T
            gap = np.abs(sigmoid(z) - 0.5)
            hit = z > 0
            test = cols["fold"][:, None] == folds[None, :]
            pos = (cols["truth"] == 1)[:, None]
            counts += np.stack([(test & pos & hit).sum(0), (test & ~pos & hit).sum(0), (test & pos & ~hit).sum(0), (test & ~pos & ~hit).sum(0)], axis=1)
            for a in np.flatnonzero(picks):
                key = cols["keys"][:, folds[a]]
                pool = np.flatnonzero(~test[:, a] & ~np.isin(key, exclude[a]))
                if len(pool) > picks[a]:
                    limit = np.partition(gap[pool, a], picks[a] - 1)[picks[a] - 1]
                    pool = pool[gap[pool, a] <= limit]
                pool = pool[np.lexsort((key[pool], gap[pool, a]))][: picks[a]]
                best[a] += [(float(gap[i, a]), int(key[i]), int(cols["truth"][i]), cols["x"][i].tolist()) for i in pool]
                best[a] = sorted(best[a])[: picks[a]]
        rows = [(a, 0, 0.0, 0, 0, None, counts[a].tolist()) for a in range(len(folds))]
        for a, found in enumerate(best):
            rows += [(a, 1, g, k, t, x, None) for g, k, t, x in found]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64())]
        names = ["arm", "kind", "gap", "key", "truth", "x", "counts"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return table.select("x", "truth", "fold", "keys").mapInArrow(
        run, "arm int, kind int, gap double, key bigint, truth int, x array<double>, counts array<bigint>"
    )


def active_curves(df: DataFrame, features: list[str], truth: str, id_col: str, folds: int = 5, seed_size: int = 10, batch_size: int = 10,
                  budget: int = 240, seed: int = 42, strategies: list[str] = STRATEGIES, only_folds: list[int] | None = None) -> DataFrame:
    """Test F1 per (strategy, fold, labels)."""
    table = experiment_table(df, features, truth, id_col, folds, seed, keys=True)
    used = list(range(folds)) if only_folds is None else only_folds
    order = table.select(
        "truth", "x", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))).alias("k"), "keys"
    ).select("truth", "x", "k", F.element_at("keys", F.col("k") + 1).alias("key")).where(F.col("k").isin(used))

    # Seed rows: the first rows of each class in the fold's order. Both strategies start from them.
    grouped = order.withColumn("g", F.col("k") * 2 + F.col("truth"))
    sizes = {r["g"]: r["count"] for r in grouped.groupBy("g").count().collect()}
    takes = {}
    for k in used:
        n = [sizes.get(2 * k, 0), sizes.get(2 * k + 1, 0)]
        if not all(n):
            raise ValueError("Seed labels need at least one row of each class in the training fold.")
        takes[k] = max(1, min(seed_size // 2, *n))
    cuts = hash_cuts(grouped, "g", "key", {2 * k + c: [takes[k]] for k in used for c in (0, 1)})
    in_seed = F.lit(False)
    for (g, _), cut in cuts.items():
        in_seed = in_seed | ((F.col("g") == g) & (F.col("key") <= cut))
    seeds = {k: [] for k in used}
    for r in grouped.where(in_seed).select("k", "key", "truth", "x").collect():
        seeds[r["k"]].append((r["key"], r["truth"], r["x"]))

    # Random queries do not depend on the model: they are the next rows in the fold's order.
    queue: dict[int, list] = {k: [] for k in used}
    if "random" in strategies:
        want = {k: min(budget, sizes[2 * k] + sizes[2 * k + 1]) for k in used}
        ends = hash_cuts(order, "k", "key", {k: [n] for k, n in want.items()})
        ahead = F.lit(False)
        for (k, _), cut in ends.items():
            ahead = ahead | ((F.col("k") == k) & (F.col("key") <= cut))
        for r in order.where(ahead).collect():
            queue[r["k"]].append((r["key"], r["truth"], r["x"]))
        for k in used:
            taken = {s[0] for s in seeds[k]}
            queue[k] = sorted((q for q in queue[k] if q[0] not in taken), key=lambda q: q[0])

    arms = [(s, k) for s in strategies for k in used]
    arm_folds = np.array([k for _, k in arms])
    held = [list(seeds[k]) for _, k in arms]
    pool = [sizes[2 * k] + sizes[2 * k + 1] for _, k in arms]
    open_arms = list(range(len(arms)))
    results = []
    while open_arms:
        beta = np.array([_fit_small(np.array([h[2] for h in held[a]]), np.array([h[1] for h in held[a]])) for a in open_arms])
        wants = [max(0, min(batch_size, budget - len(held[a]), pool[a] - len(held[a]))) for a in open_arms]
        picks = np.array([w if arms[a][0] == "uncertainty" else 0 for a, w in zip(open_arms, wants)])
        exclude = [np.array([h[0] for h in held[a]], dtype=np.int64) for a in open_arms]
        out = _round(table, beta, arm_folds[open_arms], picks, exclude)
        best = Window.partitionBy("arm", "kind").orderBy("gap", "key")
        limited = out.where("kind = 1").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= batch_size).drop("rank")
        totals = out.where("kind = 0").groupBy("arm", "kind").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(4)]).alias("counts"))
        both = limited.unionByName(totals, allowMissingColumns=True) if picks.any() else totals
        queries: dict[int, list] = {}
        for r in both.collect():
            a = open_arms[r["arm"]]
            if r["kind"] == 0:
                results.append((arms[a][0], int(arms[a][1]), len(held[a]), *r["counts"]))
            else:
                queries.setdefault(a, []).append((r["gap"], r["key"], r["truth"], r["x"]))
        left = []
        for a, want in zip(open_arms, wants):
            if want == 0:
                continue
            strategy, k = arms[a]
            if strategy == "uncertainty":
                held[a] += [q[1:] for q in sorted(queries[a])[:want]]
            else:
                held[a] += queue[k][:want]
                if strategies.index("random") == strategies.index(strategy):
                    queue[k] = queue[k][want:]
            left.append(a)
        open_arms = left
    scored = df.sparkSession.createDataFrame(results, "strategy string, fold int, labels int, tp bigint, fp bigint, fn bigint, tn bigint")
    f1 = scores_from_counts(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])["f1_score"]
    return scored.select("strategy", "fold", "labels", F.round(f1, 4).alias("f1"))


def active_fold(df: DataFrame, features: list[str], truth: str, id_col: str, strategy: str, fold: int = 0, **options) -> DataFrame:
    """One fold under one strategy."""
    return active_curves(df, features, truth, id_col, strategies=[strategy], only_folds=[fold], **options)


def strategy_curve(df: DataFrame, features: list[str], truth: str, id_col: str, **options) -> DataFrame:
    """Mean and deviation of F1 over the folds per (strategy, labels)."""
    folds = active_curves(df, features, truth, id_col, **options)
    return folds.groupBy("strategy", "labels").agg(F.round(F.avg("f1"), 4).alias("f1_mean"), F.round(F.stddev_pop("f1"), 4).alias("f1_std"))
