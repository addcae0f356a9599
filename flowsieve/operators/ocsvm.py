"""One-class boundary with an RBF kernel, by random Fourier features.

A seeded map turns a row into FEATURES cosines and sines whose inner products are close to the kernel's values. In their space the boundary is the shortest
convex combination w of all rows in which no row weighs more than 1 / (nu * n). A subgradient step asks for the mean of the nu * n rows that w scores lowest. Tasks add those rows up and
the sums meet in a tree; w then becomes the shortest mix of all means found so far, a problem of a few dozen unknowns. It stops when the duality gap is small.

Where the lowest nu * n rows end is found by counting all rows in bins of their score. Rows of the bin that holds the limit share the weight that is left. If that
bin holds too many rows, the pass is made again with finer bins inside it. Every row takes part at any size, in the same way; nothing is sampled. Equal rows have equal scores: they
are folded into one point with a weight before the passes, which changes no sum.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.arrow import matrix
from flowsieve.operators.knn import weighted_points
from flowsieve.operators.sums import sum_vectors
from flowsieve.session import durable

FEATURES = 1024
MAX_PASSES = 80
BINS = 32
# The bin of the limit may hold this share of nu * n rows.
FINE = 0.01
# Rows worked on at a time: their features stay in the cache.
CHUNK = 256
# Rows to a part of the folded table, at most.
POINTS = 2_000_000


def clamp_nu(contamination: float) -> float:
    return max(0.01, min(0.5, contamination))


@dataclass(frozen=True)
class FeatureMap:
    """Frequencies (d, FEATURES / 2) of an RBF kernel exp(-gamma * distance^2)."""

    frequencies: np.ndarray

    @staticmethod
    def draw(d: int, gamma: float, seed: int, features: int = FEATURES) -> FeatureMap:
        """Directions come in orthogonal sets of d, with the lengths of Gaussian vectors: less variance than independent ones."""
        rng = np.random.default_rng(seed)
        half = features // 2
        sets = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-half // d))]
        directions = np.hstack(sets)[:, :half]
        lengths = np.sqrt(rng.chisquare(d, half))
        return FeatureMap(directions * lengths * np.sqrt(2 * gamma))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        along = (x @ self.frequencies).astype(np.float32)
        half = along.shape[1]
        z = np.empty((len(x), 2 * half), np.float32)
        np.cos(along, out=z[:, :half])
        np.sin(along, out=z[:, half:])
        z /= np.float32(np.sqrt(half))
        return z


@dataclass(frozen=True)
class Boundary:
    """The feature map, the weights, the scale of the dual (nu * n), the relative duality gap reached and the passes over all rows it took."""

    features: FeatureMap
    weights: np.ndarray
    scale: float
    gap: float
    passes: int
    converged: bool


@dataclass(frozen=True)
class Pass:
    """One pass over all rows, folded into ``points`` (x, w): their number and feature sums per score bin, and the least and largest score.

    Bin 0 lies under ``edges[0]``, the last one from ``edges[-1]`` on; of that only the number is known."""

    edges: np.ndarray
    count: np.ndarray
    sums: np.ndarray
    low: float
    high: float

    @staticmethod
    def run(points: DataFrame, features: FeatureMap, weights: np.ndarray, edges: np.ndarray) -> Pass:
        size, bins = len(weights), len(edges) + 1
        shared = points.sparkSession.sparkContext.broadcast((features, weights, edges))

        def collect(batches):
            features, weights, edges = shared.value
            count, sums, ends = np.zeros(bins), np.zeros((bins - 1, size)), [np.inf, -np.inf]
            for batch in batches:
                x, copies = matrix(batch.column("x")), batch.column("w").to_numpy()
                for s in range(0, len(x), CHUNK):
                    w = copies[s : s + CHUNK]
                    z = features(x[s : s + CHUNK])
                    score = z @ weights
                    place = np.searchsorted(edges, score, side="right")
                    count += np.bincount(place, w, bins)
                    mine = np.flatnonzero(place < bins - 1)
                    if len(mine):
                        onto = np.zeros((bins - 1, len(mine)), np.float32)
                        onto[place[mine], np.arange(len(mine))] = w[mine]
                        sums += onto @ z[mine]
                    ends = [min(ends[0], score.min()), max(ends[1], score.max())]
            yield pa.RecordBatch.from_arrays([pa.array([[*count, *sums.ravel()]], pa.list_(pa.float64())), pa.array([ends[0]]), pa.array([ends[1]])], ["v", "low", "high"])

        # The sums of a task are some 300 kB; they are written nowhere and add up before they meet.
        partial = points.select("x", "w").mapInArrow(collect, "v array<double>, low double, high double").withColumn("one", F.lit(1))
        ends = {"low": F.min("low"), "high": F.max("high")}
        total = sum_vectors(partial, ["one"], points.sparkSession.sparkContext.defaultParallelism, ends).first()
        v = np.array(total["v"])
        return Pass(edges, v[:bins], v[bins:].reshape(bins - 1, size), total["low"], total["high"])

    def limit_bin(self, mass: float) -> int:
        """The bin where the lowest ``mass`` rows end."""
        return min(int(np.searchsorted(np.cumsum(self.count), mass * (1 - 1e-12), side="left")), len(self.count) - 1)

    def lowest_mean(self, mass: float) -> np.ndarray:
        at = self.limit_bin(mass)
        before = self.count[:at].sum()
        return (self.sums[:at].sum(0) + (mass - before) / self.count[at] * self.sums[at]) / mass

    def span(self, at: int) -> tuple[float, float]:
        """Where the scores of a bin lie."""
        low = self.low if at == 0 else max(self.low, self.edges[at - 1])
        high = self.high if at == len(self.edges) else min(self.high, self.edges[at])
        return low, high


def shortest_mix(gram: np.ndarray, steps: int = 100_000) -> np.ndarray:
    """Weights on the simplex that make the combination with this Gram matrix shortest."""
    mix = np.full(len(gram), 1.0 / len(gram))
    slope = gram @ mix
    for _ in range(steps):
        up = int(np.argmin(slope))
        down = int(np.argmax(np.where(mix > 0, slope, -np.inf)))
        if slope[down] - slope[up] <= 1e-10 * abs(slope[up]):
            return mix
        curve = gram[up, up] + gram[down, down] - 2.0 * gram[up, down]
        step = min(mix[down], (slope[down] - slope[up]) / max(curve, 1e-300))
        mix[up] += step
        mix[down] -= step
        slope += step * (gram[:, up] - gram[:, down])
    warnings.warn("The mix of means did not settle; its duality gap tells how far it is off.", stacklevel=2)
    return mix


def _points(rows: DataFrame, count: int) -> DataFrame:
    """(x, w) as a written table, spread over all cores however few points there are."""
    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, count // 250), count // POINTS)
    return durable(weighted_points(rows.select("x")).select("x", "w").repartition(parts), "boundary")


def fit_boundary(rows: DataFrame, count: int, d: int, gamma: float, nu: float, seed: int = 42, features: int = FEATURES,
                 max_passes: int = MAX_PASSES, tolerance: float = 1e-3) -> Boundary:
    """``rows`` holds ``x`` (array<double> of length d), ``count`` rows. A warning says so if ``max_passes`` passes are not enough."""
    shape = FeatureMap.draw(d, gamma, seed, features)
    mass = nu * count
    size = shape.frequencies.shape[1] * 2
    points = _points(rows, count)
    start = Pass.run(points, shape, np.zeros(size), np.array([1.0]))  # all rows in one bin: their mean
    weights, means, passes, gap = start.sums[0] / count, [start.sums[0] / count], 1, np.inf
    cut, width = 0.0, 1.0
    while passes < max_passes:
        seen, edges = None, np.linspace(cut - width, cut + width, BINS + 1)
        while passes < max_passes:
            seen = Pass.run(points, shape, weights, edges)
            passes += 1
            at = seen.limit_bin(mass)
            low, high = seen.span(at)
            last = at == len(seen.edges)
            if not last and (seen.count[at] <= max(1.0, FINE * mass) or high - low <= 1e-7):
                break
            # The limit lies in too full a bin, or above all edges: look inside. The least float above its end keeps the top rows in.
            edges = np.linspace(low, np.nextafter(np.float32(high), np.float32(np.inf)), BINS + 1)
        if seen is None or seen.limit_bin(mass) == len(seen.edges):
            break
        target = seen.lowest_mean(mass)
        low, high = seen.span(seen.limit_bin(mass))
        # Sharing the last bin's weight evenly overstates the target by at most its share times its width.
        slack = seen.count[seen.limit_bin(mass)] / mass * (high - low)
        gap = float(weights @ (weights - target) + slack) / float(weights @ weights)
        if gap <= tolerance:
            break
        means.append(target)
        stack = np.array(means)
        before, weights = cut, shortest_mix(stack @ stack.T) @ stack
        cut = (low + high) / 2
        width = max(2 * (high - low), 2 * abs(cut - before), 1e-3 * max(abs(cut), 1e-3))
    if gap > tolerance:
        warnings.warn(f"The one-class boundary stopped after {passes} passes with a duality gap of {gap:.2g}.", stacklevel=2)
    return Boundary(shape, weights, mass, gap, passes, gap <= tolerance)


def boundary_score(rows: DataFrame, boundary: Boundary, x: Column) -> Column:
    """Higher is more anomalous."""
    shared = rows.sparkSession.sparkContext.broadcast(boundary)

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        b = shared.value
        x = np.concatenate(xs.to_numpy()).reshape(len(xs), -1)
        return pd.Series(-b.scale * np.concatenate([(b.features(x[s : s + CHUNK]) @ b.weights).astype(float) for s in range(0, len(x), CHUNK)]))

    return score(x)
