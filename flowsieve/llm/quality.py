"""Text quality by a convolutional network over bytes, in numpy.

Every byte has a learned vector of EMBED numbers. FILTERS learned filters, WIDTH bytes wide, run over every position of a text. A chunk is CHUNK bytes long, the next one starts half a chunk
later, and together they cover the whole text; a chunk's features are its filters' maxima. HIDDEN units combine the features of a chunk, so that they can also see what is
lacking in it (many different letters, say); their maxima over all chunks are combined into one probability.

Spark's part: the labelled rows to learn from are the only thing that is sampled: at most SAMPLE rows, half of each class if there are so many, in a hash order of their ids, and
whole texts of at most SAMPLE_BYTES together. One task fits the network on them (seeded, so a lost task repeats itself). Its weights, some 20 kB, travel with the
tasks that score every text; texts are laid out half a chunk at a time, so memory does not grow with their length.

The network learns from balanced classes; the classes' true shares among the training labels come in afterwards as a constant.

Rules: a null text is empty. Labels without doc_id or quality, or with another quality than 0 and 1, are left out; of several labels of one document the mean decides, 0.5 counting as 1. Of several
texts under one id the network learns from the least one. Without labels of both classes every score is the smoothed share of label 1 (0.5 without any). Scores have six decimals, so equal
texts score equally wherever they lie. Rows are not changed, repeated rows stay, an empty table gives no rows, further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import fold, slices, table
from flowsieve.session import durable

SAMPLE, SAMPLE_BYTES = 3000, 24_000_000
EMBED, WIDTH, FILTERS, HIDDEN = 6, 8, 24, 12
CHUNK = 256
HALF = CHUNK // 2
EPOCHS, DOCS, RATE, DECAY = 12, 24, 4e-3, 1e-5
BLOCK = 192  # halves at a time
SHAPES = {"embed": (256, EMBED), "filters": (WIDTH * EMBED, FILTERS), "bias": (FILTERS,), "mix": (FILTERS, HIDDEN), "mix_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}


@dataclass(frozen=True)
class Network:
    weights: dict[str, np.ndarray]
    prior: float

    @staticmethod
    def flat(weights: dict[str, np.ndarray]) -> list[float]:
        return np.concatenate([weights[k].ravel() for k in SHAPES]).astype(float).tolist()

    @staticmethod
    def of(flat: list[float], prior: float) -> Network:
        out, at = {}, 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            out[name] = np.array(flat[at : at + size], np.float32).reshape(shape)
            at += size
        return Network(out, prior)


# ---- layout --------------------------------------------------------------------------------------------------------

@dataclass
class Layout:
    """Texts side by side, each in whole halves with at least WIDTH - 1 zero bytes after it. ``valid``: positions of a half that lie in the text."""

    data: np.ndarray
    valid: np.ndarray
    first: np.ndarray  # a text's first half; one more at the end

    @staticmethod
    def of(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Layout:
        halves = (sizes + WIDTH - 1 + HALF - 1) // HALF
        first = np.concatenate([[0], np.cumsum(halves)])
        data = np.zeros(first[-1] * HALF + WIDTH - 1, np.uint8)
        for at, start, size in zip(first * HALF, starts, sizes):
            data[at : at + size] = values[start : start + size]
        within = np.arange(first[-1]) - np.repeat(first[:-1], halves)
        valid = np.clip(np.repeat(sizes, halves) - within * HALF, 0, HALF)
        return Layout(data, valid, first)


def _peaks(weights: dict, layout: Layout, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's largest answer in each half, at least 0, and its position in ``data`` if asked for."""
    n = len(layout.valid)
    best = np.zeros((n, FILTERS), np.float32)
    spot = np.zeros((n, FILTERS), np.int64) if where else None
    for s in range(0, n, BLOCK):
        e = min(n, s + BLOCK)
        seen = weights["embed"][layout.data[s * HALF : e * HALF + WIDTH - 1]].ravel()
        windows = np.lib.stride_tricks.as_strided(seen, ((e - s) * HALF, WIDTH * EMBED), (EMBED * 4, 4))
        answer = (np.ascontiguousarray(windows) @ weights["filters"]).reshape(e - s, HALF, FILTERS)
        short = np.flatnonzero(layout.valid[s:e] < HALF)
        for h in short:
            answer[h, layout.valid[s + h] :] = -np.inf
        if where:
            at = answer.argmax(1)
            best[s:e] = np.take_along_axis(answer, at[:, None, :], 1)[:, 0]
            spot[s:e] = at + (np.arange(s, e) * HALF)[:, None]
        else:
            best[s:e] = answer.max(1)
    return np.maximum(best + weights["bias"], 0.0), spot


def _chunks(layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left half, right half) of every chunk, and each text's first chunk. A text of one half is one chunk."""
    count = np.maximum(np.diff(layout.first) - 1, 1)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    left = np.arange(count.sum()) - np.repeat(start - layout.first[:-1], count)
    single = np.repeat(np.diff(layout.first) == 1, count)
    return left, np.where(single, left, left + 1), start


def logits(net: Network, layout: Layout) -> np.ndarray:
    peaks, _ = _peaks(net.weights, layout, False)
    left, right, start = _chunks(layout)
    hidden = np.maximum(np.maximum(peaks[left], peaks[right]) @ net.weights["mix"] + net.weights["mix_bias"], 0.0)
    return np.maximum.reduceat(hidden, start, axis=0) @ net.weights["out"] + net.weights["out_bias"][0] + np.float32(net.prior)


# ---- training ------------------------------------------------------------------------------------------------------

def _gradient(weights: dict, layout: Layout, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    peaks, spot = _peaks(weights, layout, True)
    left, right, start = _chunks(layout)
    from_right = peaks[right] > peaks[left]
    features = np.where(from_right, peaks[right], peaks[left])
    hidden = np.maximum(features @ weights["mix"] + weights["mix_bias"], 0.0)
    ends = np.append(start[1:], len(left))
    winner = np.array([s + hidden[s:e].argmax(0) for s, e in zip(start, ends)])
    doc = np.take_along_axis(hidden, winner, 0)
    p = 1 / (1 + np.exp(-(doc @ weights["out"] + weights["out_bias"][0])))
    delta = ((p - target) * weight).astype(np.float32)
    grad = {"out": doc.T @ delta, "out_bias": delta.sum(keepdims=True)}
    to_doc = delta[:, None] * weights["out"] * (doc > 0)
    to_hidden = np.zeros_like(hidden)
    np.add.at(to_hidden, (winner, np.arange(HIDDEN)[None, :]), to_doc)
    grad["mix"], grad["mix_bias"] = features.T @ to_hidden, to_hidden.sum(0)
    to_features = to_hidden @ weights["mix"].T
    to_peaks = np.zeros_like(peaks)
    np.add.at(to_peaks, left, np.where(from_right, 0, to_features))
    np.add.at(to_peaks, right, np.where(from_right, to_features, 0))
    to_peaks *= peaks > 0
    grad["bias"] = to_peaks.sum(0)
    half, which = np.nonzero(to_peaks)
    g = to_peaks[half, which]
    codes = layout.data[spot[half, which][:, None] + np.arange(WIDTH)]
    seen = weights["embed"][codes].reshape(len(g), WIDTH * EMBED)
    grad["filters"] = np.zeros_like(weights["filters"])
    for f in range(FILTERS):
        mine = which == f
        grad["filters"][:, f] = g[mine] @ seen[mine]
    back = (g[:, None] * weights["filters"].T[which]).reshape(-1, EMBED)
    grad["embed"] = np.stack([np.bincount(codes.ravel(), back[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
    return grad


def train(texts: list[bytes], good: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of the network for texts with both labels, by Adam over shuffled texts; classes weigh the same."""
    rng = np.random.default_rng(seed)
    weights = {name: rng.normal(0, 1 / np.sqrt(shape[0]) if name != "embed" else 0.5, shape).astype(np.float32) if len(shape) > 1 else np.zeros(shape, np.float32) for name, shape in SHAPES.items()}
    weights["out"] = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32)
    share = good.mean()
    weight = np.where(good == 1, 0.5 / share, 0.5 / (1 - share))
    sizes = np.array([len(t) for t in texts], np.int64)
    values = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first, second, t = {k: np.zeros_like(w) for k, w in weights.items()}, {k: np.zeros_like(w) for k, w in weights.items()}, 0
    steps = EPOCHS * -(-len(texts) // DOCS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), DOCS):
            mine = order[s : s + DOCS]
            grad = _gradient(weights, Layout.of(values, starts[mine], sizes[mine]), good[mine], weight[mine] / len(mine))
            t += 1
            rate = RATE * (1 - t / (steps + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8) + RATE * DECAY * weights[k]
    return weights


# ---- the table -----------------------------------------------------------------------------------------------------

def known_labels(labels: DataFrame, train_rows: Column) -> DataFrame:
    """(key, quality): one label per document, its id as text."""
    rows = labels.where(train_rows).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    return rows.groupBy(F.col("doc_id").cast("string").alias("key")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))


def sample_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(key, text, quality, place): the bounded sample to learn from, in its hash order."""
    order = [F.xxhash64("key"), F.col("key")]
    halves = [known.where(F.col("quality") == y).orderBy(*order).limit(SAMPLE // 2) for y in (0, 1)]
    picked = halves[0].unionAll(halves[1])  # at most SAMPLE rows of two short values
    texts = docs.select(F.col("doc_id").cast("string").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "key")
    texts = texts.groupBy("key", "quality").agg(F.min("text").alias("text"))
    # At most SAMPLE rows: their order is a small sort.
    running = Window.orderBy(*order)
    placed = texts.withColumn("place", F.row_number().over(running)).withColumn("bytes", F.sum(F.octet_length("text")).over(running.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where((F.col("bytes") <= SAMPLE_BYTES) | (F.col("place") == 1)).select("place", "text", "quality")


def _fit(sample: pa.Table) -> pa.Table:
    order = np.argsort(sample.column("place").to_numpy(), kind="stable")
    texts, good = sample.column("text").to_pylist(), sample.column("quality").to_numpy().astype(np.float32)
    texts, good = [texts[i].encode() for i in order], good[order]
    both = 0 < good.sum() < len(good)
    return pa.table({"weights": pa.array([Network.flat(train(texts, good)) if both else []], pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column) -> Network:
    known = durable(known_labels(labels, train_rows), "quality-labels")
    total, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    share = (ones + 1) / (total + 2)
    prior = float(np.log(share / (1 - share)))
    found = sample_texts(docs, known).withColumn("all", F.lit(1)).groupBy("all").applyInArrow(_fit, "weights array<double>").first()
    if found is None or not found["weights"]:
        return Network({k: np.zeros(s, np.float32) for k, s in SHAPES.items()}, prior)
    return Network.of(found["weights"], prior)


def score_texts(net: Network, batch: pa.RecordBatch) -> np.ndarray:
    text = batch.column("text").cast(pa.large_binary())
    sizes = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text)]
    values = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    out = logits(net, Layout.of(values, offsets, sizes)).astype(float)
    return np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 6)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and a ``held_out`` column) as doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = score_texts(shared.value, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    net = fit(docs, labels, fold(labels, 3) != 1)
    return score(docs.withColumn("held_out", fold(docs, 3) == 1), net)
