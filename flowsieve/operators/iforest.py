"""Isolation forest: trees grown in tasks on small row samples, every row scored by all trees.

All chance comes from md5, so that any engine grows the same trees: a row's place in a sample from ``seed:draw:id``, its order there from ``seed+1:tree:id``, a node's
feature and threshold from ``seed:tree:node:f`` and ``seed:tree:node:t``; the first 60 bits make a number in [0, 1). ``forest_sql`` says the same in SQL.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.arrow import matrix
from flowsieve.functions.columns import col
from flowsieve.functions.hashing import HASH_BITS, order_key

TREES = 300
SAMPLE = 256
TREE_SCHEMA = "tree int, sampled int, feature array<int>, threshold array<double>, path array<double>"


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def sampling_plan(count: int, trees: int, sample: int) -> tuple[float, int, int]:
    """(share of the rows a tree draws, trees served by one draw, draws per row)."""
    spare = sample + 6 * math.sqrt(sample) + 6
    rate = min(1.0, spare / count)
    shared = min(trees, max(1, int(0.5 / rate)))
    return rate, shared, math.ceil(trees / shared)


def draw(*words: object) -> float:
    """A number in [0, 1) from the md5 of the words."""
    return int(hashlib.md5(":".join(map(str, words)).encode()).hexdigest()[: HASH_BITS // 4], 16) / float(1 << HASH_BITS)


def tree_samples(rows: DataFrame, id_col: str, x: str, count: int, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, order, x): a few more rows per tree than needed, picked by hash. The tree keeps the first ones.

    One hash draw per row serves as many trees as can share it without using up more than half of the rows. A large table needs
    a single draw per row; a tiny one needs one per tree.
    """
    rate, shared, draws = sampling_plan(count, trees, sample)
    base = rows.select(col(id_col).alias("id"), col(x).alias("x"))

    def pick(g):
        words = F.md5(F.concat(F.lit(f"{seed}:"), g.cast("string"), F.lit(":"), F.col("id").cast("string")))
        u = F.conv(F.substring(words, 1, HASH_BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << HASH_BITS))
        tree = g * shared + F.floor(u / rate).cast("int")
        return F.when((u < shared * rate) & (tree < trees), tree)

    if draws == 1:
        picked = base.withColumn("tree", pick(F.lit(0))).where(F.col("tree").isNotNull())
    else:
        mine = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), pick))
        picked = base.withColumn("tree", F.explode(mine))
    return picked.select("tree", order_key(seed + 1, F.concat(F.col("tree").cast("string"), F.lit(":"), F.col("id").cast("string"))).alias("order"), "x")


def _grow(seed: int, sample: int, depth: int):
    def build(key, rows):
        tree = key[0].as_py()
        x = matrix(rows.column("x").combine_chunks())
        # Ties in the hash go by the values, so that the order of arrival never matters.
        x = x[np.lexsort((*x.T, rows.column("order").to_numpy()))][:sample]
        nodes = (1 << (depth + 1)) - 1
        feature = np.zeros(nodes, np.int32)
        threshold = np.full(nodes, np.inf)
        path = np.zeros(nodes)
        todo = [(0, 0, np.arange(len(x)))]
        while todo:
            node, at, rows = todo.pop()
            name = node
            free = ()
            if at < depth and len(rows) > 1:
                lo, hi = x[rows].min(0), x[rows].max(0)
                free = np.flatnonzero(hi > lo)
            if not len(free):
                value = at + expected_path(len(rows))
                for _ in range(depth - at):
                    node = 2 * node + 1
                path[node] = value
                continue
            f = free[int(draw(seed, tree, name, "f") * len(free))]
            t = lo[f] + draw(seed, tree, name, "t") * (hi[f] - lo[f])
            if t >= hi[f]:
                t = lo[f]
            feature[node], threshold[node] = f, t
            right = x[rows, f] > t
            todo.append((2 * node + 2, at + 1, rows[right]))
            todo.append((2 * node + 1, at + 1, rows[~right]))
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        values = [[tree], [len(x)], [feature], [threshold], [path]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["tree", "sampled", "feature", "threshold", "path"])

    return build


def fit_forest(rows: DataFrame, id_col: str, x: str = "x", trees: int = TREES, sample: int = SAMPLE, seed: int = 42, count: int | None = None) -> DataFrame:
    """One row per tree. Trees are complete binary heaps of at most log2(sample) levels; a leaf sends every row left down to
    the last level, where its path length is."""
    count = rows.count() if count is None else count
    sample = min(sample, count)
    depth = math.ceil(math.log2(max(sample, 2)))
    samples = tree_samples(rows, id_col, x, count, trees, sample, seed)
    spread = samples.repartition(min(trees, rows.sparkSession.sparkContext.defaultParallelism), "tree")
    return spread.groupBy("tree").applyInArrow(_grow(seed, sample, depth), TREE_SCHEMA)


def forest_sql(rows: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> str:
    """CTEs that grow the same forest and score every row: ``forest_scores`` (id, score). ``rows`` is a relation of (id, features as doubles), at least ``sample`` rows.

    It lets an SQL engine check the trees. All trees grow by one aggregate and one join a level; then each row goes down each tree, a join a level.
    """
    depth = math.ceil(math.log2(max(sample, 2)))
    whole = float(1 << HASH_BITS)
    cols = ", ".join(features)

    def unit(text: str) -> str:
        return f"CAST(CAST('0x' || substr(md5({text}), 1, {HASH_BITS // 4}) AS BIGINT) AS DOUBLE) / {whole!r}"

    def of(side: str) -> str:
        return "CASE f " + " ".join(f"WHEN {i} THEN {side}{c}" for i, c in enumerate(features)) + " END"

    spans = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in features)
    free = ", ".join(f"CASE WHEN hi_{c} > lo_{c} THEN {i} END" for i, c in enumerate(features))
    parts = [
        f"plan AS (SELECT least(1.0, {sample + 6 * math.sqrt(sample) + 6!r} / count(*)) AS rate FROM {rows})",
        f"shares AS (SELECT rate, least({trees}, greatest(1, CAST(floor(0.5 / rate) AS BIGINT))) AS shared FROM plan)",
        f"drawn AS (SELECT id, {cols}, g, rate, shared, {unit(f"'{seed}:' || g || ':' || id")} AS u FROM {rows}, shares, range({trees}) d(g) WHERE g < ceil({trees} / shared))",
        f"picked AS (SELECT id, {cols}, g * shared + CAST(floor(u / rate) AS BIGINT) AS tree FROM drawn WHERE u < shared * rate)",
        f"""level0 AS MATERIALIZED (SELECT tree, CAST(0 AS BIGINT) AS node, {cols} FROM picked WHERE tree < {trees}
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY substr(md5('{seed + 1}:' || tree || ':' || id), 1, {HASH_BITS // 4}), {cols}) <= {sample})""",
    ]
    for k in range(depth):
        parts += [
            f"spans{k} AS (SELECT tree, node, count(*) AS n, {spans} FROM level{k} GROUP BY tree, node)",
            f"able{k} AS (SELECT *, list_filter([{free}], lambda v: v IS NOT NULL) AS able FROM spans{k})",
            f"chosen{k} AS (SELECT *, able[1 + CAST(floor({unit(f"'{seed}:' || tree || ':' || node || ':f'")} * len(able)) AS BIGINT)] AS f FROM able{k})",
            f"ends{k} AS (SELECT tree, node, n, f, {of('lo_')} AS lo, {of('hi_')} AS hi FROM chosen{k})",
            f"cut{k} AS (SELECT tree, node, n, f, lo, hi, lo + {unit(f"'{seed}:' || tree || ':' || node || ':t'")} * (hi - lo) AS t FROM ends{k})",
            f"split{k} AS MATERIALIZED (SELECT tree, node, n, f, CASE WHEN t >= hi THEN lo ELSE t END AS t FROM cut{k})",
            f"level{k + 1} AS MATERIALIZED (SELECT tree, CASE WHEN {of('')} > t THEN 2 * node + 2 ELSE 2 * node + 1 END AS node, {cols} FROM level{k} JOIN split{k} USING (tree, node) WHERE f IS NOT NULL)",
        ]
    parts.append(f"split{depth} AS MATERIALIZED (SELECT tree, node, count(*) AS n, CAST(NULL AS INTEGER) AS f, CAST(NULL AS DOUBLE) AS t FROM level{depth} GROUP BY tree, node)")
    parts.append(f"at0 AS (SELECT id, {cols}, CAST(tree AS BIGINT) AS tree, CAST(0 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS path FROM {rows}, range({trees}) t(tree))")
    for k in range(depth + 1):
        # A row that reached a leaf keeps its path and has no node any more.
        beyond = f"CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1.0) + {float(np.euler_gamma)!r}) - 2.0 * (n - 1.0) / n END"
        parts.append(
            f"at{k + 1} AS (SELECT id, {cols}, a.tree, CASE WHEN f IS NULL THEN NULL WHEN {of('')} > t THEN 2 * a.node + 2 ELSE 2 * a.node + 1 END AS node, "
            f"CASE WHEN path IS NOT NULL THEN path WHEN f IS NULL THEN {k} + {beyond} END AS path FROM at{k} a LEFT JOIN split{k} s ON a.tree = s.tree AND a.node = s.node)"
        )
    parts.append(f"forest_scores AS (SELECT id, pow(2.0, -sum(path) / {trees} / {expected_path(sample)!r}) AS score FROM at{depth + 1} GROUP BY id)")
    return ",\n".join(parts)


def _paths(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray, depth: int) -> np.ndarray:
    """Each row's path lengths in all trees, added up."""
    values, first, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
    node, at, value, cut, right = np.empty(len(x), np.int64), np.empty(len(x), np.int64), np.empty(len(x)), np.empty(len(x)), np.empty(len(x), bool)
    for f, cuts, paths in zip(feature, threshold, path):
        node[:] = 0
        for _ in range(depth):
            # Indices are in range; "clip" spares a copy of the output.
            f.take(node, out=at, mode="clip")
            at += first
            values.take(at, out=value, mode="clip")
            cuts.take(node, out=cut, mode="clip")
            np.greater(value, cut, out=right)
            node += node
            node += 1
            node += right
        paths.take(node, out=value, mode="clip")
        total += value
    return total


def forest_score(forest: DataFrame, x: Column) -> Column:
    """Anomaly score in (0, 1). The forest has a fixed size (trees x 2 * sample nodes) and travels with the task."""
    model = forest.orderBy("tree").toPandas()
    feature = np.vstack(model["feature"].to_numpy()).astype(np.int64)
    threshold, path = np.vstack(model["threshold"].to_numpy()), np.vstack(model["path"].to_numpy())
    trees, nodes = feature.shape
    depth = int(math.log2(nodes + 1)) - 1
    scale = expected_path(int(model["sampled"].max()))
    shared = forest.sparkSession.sparkContext.broadcast((feature, threshold, path))

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        feature, threshold, path = shared.value
        x = np.concatenate(xs.to_numpy()).reshape(len(xs), -1)
        total = _paths(x, feature, threshold, path, depth)
        return pd.Series(np.power(2.0, -total / trees / scale) if scale > 0 else np.full(len(x), 0.5))

    return score(x)
