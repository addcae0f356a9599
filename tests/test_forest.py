import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowsieve.operators import forest
from flowsieve.plans import supervised
from flowsieve.plans.experiment import experiment_table
from conftest import separable


def moons(n, seed):
    """Two classes no line parts, and two columns of noise."""
    rng = np.random.default_rng(seed)
    angle, y = rng.uniform(0, np.pi, n), (rng.uniform(size=n) < 0.3).astype(int)
    x = np.column_stack([np.cos(angle) + y, np.sin(angle) * np.where(y, -1, 1) + 0.4 * y, rng.normal(size=n), rng.normal(size=n)])
    return x + rng.normal(0, 0.2, x.shape), y


def plain_tree(codes, y, w, mass, arm, tree, growth):
    """The same tree for one arm, by breadth-first recursion over rows; share of class 1 for any code row."""
    nodes, todo, made = {}, [(0, np.arange(len(y)), 0)], 1
    while todo:
        name, rows, depth = todo.pop(0)
        total = np.array([mass[rows][y[rows] == c].sum() for c in (0, 1)])
        best = (1e-12, None, None)
        if depth < growth.max_depth:
            looks = forest.drawn_features(np.array([name]), np.array([arm]), tree, growth)[0]
            for j in np.flatnonzero(looks):
                options = []
                for b in range(len(growth.cuts[j]) + 1):
                    left = codes[rows, j] <= b
                    if w[rows][left].sum() < growth.min_leaf or w[rows][~left].sum() < growth.min_leaf:
                        continue
                    parts = [np.array([mass[rows][side & (y[rows] == c)].sum() for c in (0, 1)]) for side in (left, ~left)]
                    options.append((sum((p**2).sum() / p.sum() for p in parts) - (total**2).sum() / total.sum(), -b))
                if options and max(options)[0] > best[0] * (1 + 1e-9):
                    best = (max(options)[0], j, -max(options)[1])
        if best[1] is None:
            nodes[name] = total[1] / total.sum()
            continue
        left = codes[rows, best[1]] <= best[2]
        nodes[name] = (best[1], best[2], made)
        todo += [(made, rows[left], depth + 1), (made + 1, rows[~left], depth + 1)]
        made += 2

    def share(code):
        at = 0
        while isinstance(nodes[at], tuple):
            j, b, child = nodes[at]
            at = child + (code[j] > b)
        return nodes[at]

    return share


@pytest.mark.parametrize("depth, leaf", [(3, 2), (30, 5)])
def test_grown_trees_equal_plain_ones(depth, leaf):
    x, y = moons(220, 1)
    fold = np.arange(220) % 3
    cuts = tuple(np.unique(np.quantile(x[:, j], np.linspace(0.1, 0.9, 9))) for j in range(4))
    growth = forest.Growth(cuts, 3, 1000, 5, depth, leaf)
    codes, weight = forest.coded(x, cuts), forest.bootstrap(np.arange(220, dtype=np.uint64), 4, 5)
    assert 0.8 < weight.mean() < 1.2 and 0.25 < (weight == 0).mean() < 0.5
    for arm, tree in enumerate(forest.grow(codes, y, fold, weight, 4, growth)):
        use = (fold != arm) & (weight > 0)
        of = [weight[use & (y == c)].sum() for c in (0, 1)]
        mass = np.where(y == 1, sum(of) / (2 * of[1]), sum(of) / (2 * of[0])) * weight
        share = plain_tree(codes[use], y[use], weight[use], mass[use], arm, 4, growth)
        assert np.allclose(forest.forest_share([tree], codes), [share(c) for c in codes], atol=1e-6)


def scored(table, folds, **options):
    return {r.id: r for r in supervised.forest_scores(table, folds, **options).collect()}


def test_forest_is_as_good_as_the_library_one(spark, frame):
    x, y = moons(700, 2)
    table = experiment_table(frame(x, y), [f"f{j}" for j in range(4)], "truth", "id", 3, 1)
    mine = scored(table, 3, trees=60)
    auc = lambda s, t: np.mean([a > b for a in s[t == 1] for b in s[t == 0]])
    truth = np.array([mine[i].truth for i in range(700)])
    vectors = table.withColumn("v", array_to_vector("x"))
    other = np.zeros(700)
    for k in range(3):
        model = RandomForestClassifier(featuresCol="v", labelCol="truth", numTrees=60, minInstancesPerNode=2, maxDepth=20, seed=1).fit(vectors.where(F.col("fold") != k))
        for r in model.transform(vectors.where(F.col("fold") == k)).select("id", vector_to_array("probability")[1].alias("p")).collect():
            other[r.id] = r.p
    got = auc(np.array([mine[i].probability for i in range(700)]), truth)
    assert got > 0.9 and got > auc(other, truth) - 0.02
    again = scored(table.repartition(7), 3, trees=60)
    assert all(again[i].probability == mine[i].probability for i in mine)


def test_trees_of_a_larger_table_see_samples(spark, frame):
    x, y = moons(2000, 3)
    table = experiment_table(frame(x, y), [f"f{j}" for j in range(4)], "truth", "id", 3, 1)
    forests, growth = forest.fit_forests(table, 2000, 3, 4, trees=40, sample=150)
    rows = forests.collect()
    assert len(rows) == 120 and max(len(r["bin"]) for r in rows) < 150
    mine = scored(table, 3, trees=40, sample=150)
    assert np.mean([(r.probability > 0.5) == r.truth for r in mine.values()]) > 0.85


def test_both_baselines_on_the_same_folds(frame):
    x, y = separable(60, 3, 6, 4)
    rows = {r.model: r for r in supervised.baselines(frame(x, y), ["f0", "f1", "f2"], "truth", "id", folds=3, trees=15).collect()}
    assert set(rows) == {"logistic_regression", "random_forest"} and all(r.f1_score_mean > 0.9 and r.roc_auc_mean > 0.95 for r in rows.values())


def test_one_class_and_constant_features(frame):
    x = np.ones((40, 2))
    with pytest.raises(ValueError, match="one class"):
        supervised.forest_scores(experiment_table(frame(x, np.zeros(40)), ["f0", "f1"], "truth", "id", 2, 1), 2)
    table = experiment_table(frame(x, np.arange(40) % 2), ["f0", "f1"], "truth", "id", 2, 1)
    assert {round(r.probability, 6) for r in scored(table, 2, trees=3).values()} == {0.5}
