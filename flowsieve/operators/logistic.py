"""Many class-balanced logistic regressions over one table, trained together.

Every model ("arm") has its own labelled rows. One pass over the table sums, per arm and
class, what a Newton step needs; the step itself is a solve of (features + 1) unknowns on the driver.
The objective is the weighted log loss plus half the squared weights on standardised features (C = 1),
with the intercept left out of the penalty and each class weighted to half of the rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.arrow import batch_columns
from flowsieve.operators.sums import sum_vectors

# Given the columns of a batch and its feature matrix: 1 / 0 for a labelled row of an arm, -1 otherwise.
LabelFn = Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]

MAX_PASSES = 60
# A Newton step of this relative size is still taken; what is left after it is its square.
TOLERANCE = 1e-4


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def with_intercept(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _sums(x1: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Per class: rows, feature sums, squared sums, loss, gradient, upper half of the Hessian."""
    upper = np.triu_indices(x1.shape[1])
    parts = []
    for c in (0, 1):
        xc = x1[y == c]
        z = xc @ beta
        p = sigmoid(z)
        loss = np.logaddexp(0.0, z if c == 0 else -z).sum()
        hess = (xc * (p * (1 - p))[:, None]).T @ xc
        parts += [[len(xc)], xc[:, :-1].sum(0), (xc[:, :-1] ** 2).sum(0), [loss], xc.T @ (p - c), hess[upper]]
    return np.concatenate(parts)


def _pass(df: DataFrame, columns: list[str], labels: LabelFn, beta: np.ndarray, arms: list[int], tasks: int) -> dict[int, np.ndarray]:
    width = beta.shape[1]
    length = 2 * (1 + 2 * (width - 1) + 1 + width + width * (width + 1) // 2)

    def run(batches):
        total = np.zeros((len(arms), length))
        for batch in batches:
            cols = batch_columns(batch)
            x = cols["x"]
            y = labels(cols, x)
            x1 = with_intercept(x)
            for i, arm in enumerate(arms):
                rows = y[:, arm] >= 0
                if rows.any():
                    total[i] += _sums(x1[rows], y[rows, arm], beta[arm])
        yield pa.RecordBatch.from_arrays(
            [pa.array(arms, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["arm", "v"]
        )

    partial = df.select(*columns).mapInArrow(run, "arm int, v array<double>")
    return {r["arm"]: np.array(r["v"]) for r in sum_vectors(partial, ["arm"], tasks).collect()}


def _step(v: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(objective, Newton step, rows per class) from one arm's sums."""
    width = len(beta)
    d, half = width - 1, width * (width + 1) // 2
    upper = np.triu_indices(width)
    block = len(v) // 2
    count, sums, squares, loss, grads, hessians = [], [], [], [], [], []
    for c in (0, 1):
        b = v[c * block:(c + 1) * block]
        count.append(b[0])
        sums.append(b[1:1 + d])
        squares.append(b[1 + d:1 + 2 * d])
        loss.append(b[1 + 2 * d])
        grads.append(b[2 + 2 * d:2 + 2 * d + width])
        h = np.zeros((width, width))
        h[upper] = b[-half:]
        hessians.append(h + np.triu(h, 1).T)
    count = np.array(count)
    n = count.sum()
    if not count.all():
        raise ValueError("A training set holds only one class.")
    weight = n / (2 * count)
    mean = (sums[0] + sums[1]) / n
    spread = np.maximum((squares[0] + squares[1]) / n - mean**2, 0.0)
    constant = spread <= 1e-12 * np.maximum(1.0, mean**2)
    penalty = np.append(np.where(constant, 0.0, spread), 0.0)
    objective = weight @ np.array(loss) + 0.5 * (penalty * beta**2).sum()
    grad = weight[0] * grads[0] + weight[1] * grads[1] + penalty * beta
    hess = weight[0] * hessians[0] + weight[1] * hessians[1] + np.diag(penalty)
    # A column that is constant in this training set carries nothing: its weight goes to 0.
    fixed = np.flatnonzero(constant)
    hess[fixed, :] = 0.0
    hess[:, fixed] = 0.0
    hess[fixed, fixed] = 1.0
    grad[fixed] = beta[fixed]
    hess[-1, -1] += 1e-12
    return float(objective), np.linalg.solve(hess, grad), count


def fit_arms(df: DataFrame, columns: list[str], labels: LabelFn, start: np.ndarray, arms: list[int] | None = None,
             known: dict[int, float] | None = None) -> tuple[np.ndarray, dict[int, float]]:
    """Weights (arms x features + 1, intercept last) and labelled rows per arm.

    ``columns`` must hold ``x`` (array<double>). Arms whose number of labelled rows equals ``known``
    are left as they are: their training set has not changed.
    """
    beta = start.copy()
    open_arms = list(range(len(start))) if arms is None else list(arms)
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    rows: dict[int, float] = {}
    tasks = df.rdd.getNumPartitions()
    for turn in range(MAX_PASSES):
        if not open_arms:
            break
        sums = _pass(df, columns, labels, beta, open_arms, tasks)
        left = []
        for arm in open_arms:
            objective, step, count = _step(sums[arm], beta[arm])
            if not np.isfinite(objective):
                raise ValueError("The logistic objective is not finite: features must be finite numbers.")
            rows[arm] = float(count.sum())
            if turn == 0 and known is not None and known.get(arm) == rows[arm]:
                continue
            if arm in best and objective > best[arm][0] + 1e-9 * (1.0 + abs(best[arm][0])):
                old, at, old_step = best[arm]
                best[arm] = (old, at, old_step / 2)
                beta[arm] = at - old_step / 2
                left.append(arm)
                continue
            best[arm] = (objective, beta[arm].copy(), step)
            beta[arm] = beta[arm] - step
            if np.abs(step).max() > TOLERANCE * (1.0 + np.abs(beta[arm]).max()):
                left.append(arm)
        open_arms = left
    if open_arms:
        warnings.warn(f"{len(open_arms)} logistic fits had not converged after {MAX_PASSES} passes.", stacklevel=2)
    return beta, rows


def decision(x: Column, weights: Column) -> Column:
    """Linear score of one row, in Spark: weights hold the intercept last."""
    d = F.size(x)
    products = F.zip_with(x, F.slice(weights, F.lit(1), d), lambda a, b: a * b)
    return F.aggregate(products, F.element_at(weights, -1), lambda s, v: s + v)


def probability(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def weights_literal(beta: np.ndarray) -> Column:
    """All arms' weights as one constant array of arrays."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in beta])


def test_counts(df: DataFrame, columns: list[str], beta: np.ndarray, arm_folds: list[int]) -> DataFrame:
    """(arm, tp, fp, fn, tn) on each arm's held-out fold, in one pass."""
    folds = np.array(arm_folds)
    weights = beta.T

    def run(batches):
        total = np.zeros((len(folds), 4), dtype=np.int64)
        for batch in batches:
            cols = batch_columns(batch)
            hit = with_intercept(cols["x"]) @ weights > 0
            test = cols["fold"][:, None] == folds[None, :]
            pos = (cols["truth"] == 1)[:, None]
            total += np.stack([(test & pos & hit).sum(0), (test & ~pos & hit).sum(0), (test & pos & ~hit).sum(0), (test & ~pos & ~hit).sum(0)], axis=1)
        arrays = [pa.array(range(len(folds)), pa.int32())] + [pa.array(total[:, i], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(arrays, ["arm", "tp", "fp", "fn", "tn"])

    partial = df.select(*columns).mapInArrow(run, "arm int, tp bigint, fp bigint, fn bigint, tn bigint")
    return partial.groupBy("arm").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def logistic_sql(rows: str, width: int, steps: int, name: str) -> str:
    """The same fits in SQL (DuckDB), to check results: table expressions ending in ``{name}_fit`` (arm, w0.., the intercept last).

    ``rows`` holds arm, y (0 or 1) and x0... A fixed number of full Newton steps from zero stands for the test of convergence; each solves its
    equations by elimination, written out.
    """
    every = range(width + 1)
    x = [f"x{i}" for i in range(width)] + ["1.0"]
    pairs = [(i, j) for i in every for j in every if i <= j]
    # A column that is constant among the rows carries nothing: such a penalty keeps its weight at 0.
    spread = ", ".join(f"CASE WHEN var_pop(x{i}) <= 1e-12 * greatest(1, avg(x{i}) ** 2) THEN 1e30 ELSE var_pop(x{i}) END AS v{i}" for i in range(width))
    out = [
        f"{name}_size AS MATERIALIZED (SELECT arm, count(*) / (2.0 * count(*) FILTER (y = 0)) AS c0, count(*) / (2.0 * count(*) FILTER (y = 1)) AS c1, {spread} FROM {rows} GROUP BY arm)",
        f"{name}_0 AS (SELECT arm, {', '.join(f'CAST(0 AS DOUBLE) AS w{i}' for i in every)} FROM {name}_size)",
    ]
    z = " + ".join(f"w{i} * {x[i]}" for i in every)
    for t in range(1, steps + 1):
        sums = [f"sum(c * (p - y) * {x[i]}) AS g{i}" for i in every] + [f"sum(c * p * (1 - p) * {x[i]} * {x[j]}) AS h{i}_{j}" for i, j in pairs]
        scored = f"SELECT r.*, CASE WHEN y = 1 THEN c1 ELSE c0 END AS c, 1 / (1 + exp(-({z}))) AS p FROM {rows} r JOIN {name}_size USING (arm) JOIN {name}_{t - 1} USING (arm)"
        solved = f"SELECT * FROM (SELECT arm, {', '.join(sums)} FROM ({scored}) GROUP BY arm) JOIN {name}_size USING (arm) JOIN {name}_{t - 1} USING (arm)"
        # One nested query per unknown: a{k}_{i}_{j} and r{k}_{i} are what is left of the equations after k unknowns are eliminated.
        kept = ["arm", *[f"w{i}" for i in every]]
        first = [f"h{i}_{j}{f' + v{i}' if i == j and i < width else ''} AS a0_{i}_{j}" for i, j in pairs] + [f"g{i}{f' + v{i} * w{i}' if i < width else ''} AS r0_{i}" for i in every]
        solved = f"SELECT {', '.join(kept + first)} FROM ({solved})"
        for k in range(width):
            kept += [f"a{k}_{k}_{j}" for j in every if j >= k] + [f"r{k}_{k}"]
            less = [f"a{k}_{i}_{j} - a{k}_{k}_{i} * a{k}_{k}_{j} / a{k}_{k}_{k} AS a{k + 1}_{i}_{j}" for i, j in pairs if i > k] + [f"r{k}_{i} - a{k}_{k}_{i} * r{k}_{k} / a{k}_{k}_{k} AS r{k + 1}_{i}" for i in every if i > k]
            solved = f"SELECT {', '.join(kept + less)} FROM ({solved})"
        for i in reversed(every):
            solved = f"SELECT *, (r{i}_{i}{''.join(f' - a{i}_{i}_{j} * s{j}' for j in every if j > i)}) / a{i}_{i}_{i} AS s{i} FROM ({solved})"
        out.append(f"{name}_{t} AS MATERIALIZED (SELECT arm, {', '.join(f'w{i} - s{i} AS w{i}' for i in every)} FROM ({solved}))")
    out.append(f"{name}_fit AS (SELECT * FROM {name}_{steps})")
    return ",\n".join(out)
