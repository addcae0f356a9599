"""Random forests for all cross-validation folds together.

Arm f is a forest that never sees fold f. One job grows every tree of every arm: tree t of all arms meets the same rows in one task, at most about SAMPLE of them, picked by hash. With no more rows than
that every tree sees all rows of its arm. Rows weigh by a bootstrap count (Poisson, from the hash of row and tree) and by class, so that both classes weigh the same.

Trees grow level by level, all arms at once: the classes of all open nodes are counted per feature and bin in one histogram, and each node takes the cut with the largest loss of
Gini impurity among a few features drawn for it. Bins come from quantiles of the whole table.

Nothing depends on how rows are partitioned. A row's score is the mean over its own arm's trees of the share of class 1 in its leaf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.arrow import matrix

TREES, SAMPLE, BINS, MAX_DEPTH, MIN_LEAF = 300, 8192, 64, 30, 2
TREE_SCHEMA = "tree int, arm int, feature binary, bin binary, left binary, share binary"


@dataclass(frozen=True)
class Growth:
    """What one tree of each arm is grown by."""

    cuts: tuple[np.ndarray, ...]
    folds: int
    sample: int
    seed: int
    max_depth: int
    min_leaf: int

    @property
    def tried(self) -> int:
        """Features a node looks at."""
        return max(1, int(math.sqrt(len(self.cuts))))


def mixed(*words: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of unsigned words, element by element."""
    out = np.zeros(1, np.uint64)
    for word in words:
        out = (out ^ np.asarray(word, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(32))
    return out


def bootstrap(row_hash: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) counts."""
    u = (mixed(row_hash, tree, seed) >> np.uint64(11)).astype(float) / float(1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, u, side="right").astype(float)


def quantile_cuts(table: DataFrame, d: int, bins: int = BINS) -> tuple[np.ndarray, ...]:
    """Upper ends of the bins of each feature but the last, from all rows."""
    steps = [i / bins for i in range(1, bins)]
    row = table.agg(*[F.percentile_approx(F.col("x")[j], steps, 10_000).alias(f"q{j}") for j in range(d)]).first()
    return tuple(np.unique(np.array(row[j], float)) for j in range(d))


def coded(x: np.ndarray, cuts: tuple[np.ndarray, ...]) -> np.ndarray:
    """The bin of each value: values up to a cut lie under it."""
    return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)


def drawn_features(names: np.ndarray, arms: np.ndarray, tree: int, growth: Growth) -> np.ndarray:
    """For each node, which features it looks at."""
    d = len(growth.cuts)
    order = mixed(names[:, None], arms[:, None], tree, growth.seed + 1, np.arange(d)[None, :])
    rank = np.argsort(np.argsort(order, axis=1), axis=1)
    return rank < growth.tried


def grow(codes: np.ndarray, truth: np.ndarray, fold: np.ndarray, weight: np.ndarray, tree: int, growth: Growth) -> list[dict[str, np.ndarray]]:
    """A tree per arm: feature (-1 at a leaf), bin (codes up to it go left), left child (the right one follows), share of class 1.

    ``weight`` are bootstrap counts. A node ends at ``max_depth``, with one class, or where no cut leaves ``min_leaf`` counts on both sides and gains anything.
    """
    folds, d, bins = growth.folds, len(growth.cuts), max(len(c) for c in growth.cuts) + 1
    arm, row = (v.ravel() for v in np.meshgrid(np.arange(folds), np.arange(len(truth)), indexing="ij"))
    use = (fold[row] != arm) & (weight[row] > 0)
    arm, row = arm[use], row[use]
    y, w = truth[row], weight[row]
    of_class = np.bincount(arm * 2 + y, w, folds * 2).reshape(folds, 2)
    scale = np.where(of_class > 0, of_class.sum(1, keepdims=True) / (2 * np.maximum(of_class, 1)), 0.0)
    mass = w * scale[arm, y]

    nodes = [{"feature": [], "bin": [], "left": [], "share": []} for _ in range(folds)]
    # Open nodes of a level: their arm, and their number in the arm's tree.
    open_arm, number = np.arange(folds), np.zeros(folds, np.int64)
    for k in range(folds):
        _append(nodes[k], 1)
    at = arm.copy()  # the open node of each (arm, row) pair
    for depth in range(growth.max_depth + 1):
        n = len(open_arm)
        if not n:
            break
        total = np.bincount(at * 2 + y, mass, n * 2).reshape(n, 2)
        weights = total.sum(1)
        share = np.divide(total[:, 1], weights, out=np.full(n, 0.5), where=weights > 0)
        for a, k, s in zip(open_arm, number, share):
            nodes[a]["share"][k] = s
        if depth == growth.max_depth:
            break
        tried = drawn_features(number, open_arm, tree, growth)
        best, which, cut = np.full(n, 1e-12), np.full(n, -1), np.zeros(n, np.int64)
        for j in range(d):
            mine = np.flatnonzero(tried[:, j])
            if not len(mine):
                continue
            place = np.full(n, -1)
            place[mine] = np.arange(len(mine))
            here = place[at]
            pick = here >= 0
            cell = here[pick] * bins + codes[row[pick], j]
            size = len(mine) * bins
            first = [np.bincount(cell, mass[pick] * (y[pick] == c), size).reshape(-1, bins).cumsum(1) for c in (0, 1)]
            count = np.bincount(cell, w[pick], size).reshape(-1, bins).cumsum(1)
            left, both = first[0] + first[1], weights[mine][:, None]
            right = both - left
            allowed = (count >= growth.min_leaf) & (count[:, -1:] - count >= growth.min_leaf) & (left > 0) & (right > 1e-12)
            # Loss of impurity times the node's weight, up to a constant.
            gain = np.divide(first[0] ** 2 + first[1] ** 2, left, out=np.zeros_like(left), where=allowed) + np.divide(
                (total[mine, 0][:, None] - first[0]) ** 2 + (total[mine, 1][:, None] - first[1]) ** 2, right, out=np.zeros_like(left), where=allowed)
            gain = np.where(allowed, gain - ((total[mine] ** 2).sum(1) / np.maximum(weights[mine], 1e-300))[:, None], -1.0)
            top = gain.argmax(1)
            value = gain[np.arange(len(mine)), top]
            # Sums of floats: a later feature must gain clearly more to win.
            better = value > best[mine] * (1 + 1e-9)
            best[mine[better]], which[mine[better]], cut[mine[better]] = value[better], j, top[better]
        split = np.flatnonzero(which >= 0)
        child = np.full(n, -1)
        child[split] = 2 * np.arange(len(split))
        next_arm, next_number = np.repeat(open_arm[split], 2), np.zeros(2 * len(split), np.int64)
        for c, k in zip(child[split], split):
            tree_nodes = nodes[open_arm[k]]
            start = len(tree_nodes["share"])
            _append(tree_nodes, 2)
            tree_nodes["feature"][number[k]], tree_nodes["bin"][number[k]], tree_nodes["left"][number[k]] = which[k], cut[k], start
            next_number[c], next_number[c + 1] = start, start + 1
        stay = child[at] >= 0
        row, y, w, mass, at = row[stay], y[stay], w[stay], mass[stay], at[stay]
        at = child[at] + (codes[row, which[at]] > cut[at])
        open_arm, number = next_arm, next_number
    return [{"feature": np.array(t["feature"], np.int16), "bin": np.array(t["bin"], np.uint8), "left": np.array(t["left"], np.int32), "share": np.array(t["share"], np.float32)} for t in nodes]


def _append(tree: dict[str, list], n: int) -> None:
    for name, value in (("feature", -1), ("bin", 0), ("left", 0), ("share", 0.5)):
        tree[name] += [value] * n


def _task(growth: Growth):
    def build(key, rows):
        tree = key[0].as_py()
        hashes = rows.column("hash").to_numpy().view(np.uint64)
        # Rows come in any order: that of the hash makes sums repeatable.
        order = np.lexsort((rows.column("fold").to_numpy(), hashes))
        x = matrix(rows.column("x").combine_chunks())[order]
        truth, fold = rows.column("truth").to_numpy()[order].astype(np.int64), rows.column("fold").to_numpy()[order]
        made = grow(coded(x, growth.cuts), truth, fold, bootstrap(hashes[order], tree, growth.seed), tree, growth)
        names = ["feature", "bin", "left", "share"]
        return pa.table({"tree": pa.array([tree] * len(made), pa.int32()), "arm": pa.array(range(len(made)), pa.int32()), **{n: pa.array([t[n].tobytes() for t in made], pa.binary()) for n in names}})

    return build


def fit_forests(table: DataFrame, count: int, folds: int, d: int, trees: int = TREES, sample: int = SAMPLE, seed: int = 42, max_depth: int = MAX_DEPTH, min_leaf: int = MIN_LEAF) -> tuple[DataFrame, Growth]:
    """(tree, arm, nodes) rows. ``table`` holds id, x, truth and fold."""
    growth = Growth(quantile_cuts(table, d), folds, sample, seed, max_depth, min_leaf)
    rate = min(1.0, sample / count)
    base = table.select(F.xxhash64(F.lit(seed), F.col("id").cast("string")).alias("hash"), "x", "truth", "fold")
    # A tree's rows by a hash of its own; one draw serves as many trees as can share it without meeting a row twice.
    shared = min(trees, max(1, int(1 / rate)))
    rounds = F.sequence(F.lit(0), F.lit(math.ceil(trees / shared) - 1))

    def pick(g: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed + 1), "hash", g), F.lit(1 << 53)) / F.lit(float(1 << 53))
        tree = g * shared + F.floor(u / rate).cast("int")
        return F.when((u < shared * rate) & (tree < trees), tree)

    drawn = base.withColumn("tree", F.explode(F.array_compact(F.transform(rounds, pick))))
    spread = drawn.repartition(min(trees, 4 * table.sparkSession.sparkContext.defaultParallelism), "tree")
    return spread.groupBy("tree").applyInArrow(_task(growth), TREE_SCHEMA), growth


def forests_probability(forests: DataFrame, growth: Growth, x: Column, fold: Column) -> Column:
    """Probability of class 1 by the trees of arm ``fold``. At most trees x folds x sample nodes of 11 bytes travel with the tasks."""
    kinds = {"feature": np.int16, "bin": np.uint8, "left": np.int32, "share": np.float32}
    arms: list[list[dict]] = [[] for _ in range(growth.folds)]
    for r in sorted(forests.collect(), key=lambda r: r["tree"]):
        arms[r["arm"]].append({n: np.frombuffer(r[n], k) for n, k in kinds.items()})
    shared = forests.sparkSession.sparkContext.broadcast((arms, growth))

    @F.pandas_udf("double")
    def score(xs: pd.Series, fs: pd.Series) -> pd.Series:
        arms, growth = shared.value
        out, folds = np.zeros(len(xs)), fs.to_numpy()
        for f in np.unique(folds):
            rows = np.flatnonzero(folds == f)
            out[rows] = forest_share(arms[f], coded(np.vstack(xs.iloc[rows].to_numpy()), growth.cuts))
        return pd.Series(out)

    return score(x, fold)


def forest_share(trees: list[dict[str, np.ndarray]], codes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes))
    for t in trees:
        node = np.zeros(len(codes), np.int64)
        walking = np.flatnonzero(t["feature"][node] >= 0)
        while len(walking):
            here = node[walking]
            node[walking] = t["left"][here] + (codes[walking, t["feature"][here]] > t["bin"][here])
            walking = walking[t["feature"][node[walking]] >= 0]
        total += t["share"][node]
    return total / max(len(trees), 1)
