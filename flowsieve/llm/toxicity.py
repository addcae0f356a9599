"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are at most LABELLED labelled rows, the first in a hash order of their ids; they are the only thing that is sampled. Terms are all words of the
examples, whole and of any length; none is chosen or left out. A term weighs its (damped) count, times its inverse document frequency over all documents, times its
relevance: how many times likelier a toxic example has it than a clean one, on a log scale, to the power POWER. Words that no example has count in a
text's length only. Every document is scored from its whole text.

The index has posting lists of examples and weights. For the FREQUENT terms that most examples have it holds their weights by blocks of examples, with the
largest weight of each block. A query adds up the lists of its other terms, which are short, then adds each block's maxima to get a bound per example, works out the examples with the
best bounds, and after these all whose bound can still beat the NEAR nearest found, so the neighbours are exact. Where these are many, the queries of a batch meet a run of blocks as one
matrix product in single precision, and only what its rounding leaves open is worked out again. They vote with their cosine as
weight. Votes become probabilities by isotonic regression on the examples' own votes, each found without the rows of its id and with its own label taken out of the relevance.
A text that shares no word with any example gets the toxic share of the examples without words, which leans on that of all. Evidence are the nearest examples' ids.

Nulls: a null text is empty; labels without doc_id or toxic are left out; a document with several labels is toxic if one says so. Without
examples every score is 0. Equal cosines go by the order of examples. An empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowsieve.llm.common import fold, slices, table, texts
from flowsieve.session import durable

LABELLED = 12_000
NEAR = 15
BLOCK = 64
# Queries that meet a run of so many blocks together, and the cells (query, example) they may have; the slack for cosines in single precision.
TOGETHER, RUN, CELLS = 256, 16, 3_000_000
SLACK = 1e-5
SIGNS = 64
FREQUENT = 1024
POWER = 1.5
SHRINK = 0.05
WORD = re.compile(r"[^\W\d_]+")


def packed(value: object) -> bytes:
    return zlib.compress(pickle.dumps(value), 1)


def unpacked(value: bytes) -> object:
    return pickle.loads(zlib.decompress(value))


def numbered(words: str) -> dict[str, int]:
    """Numbers of words from a line each."""
    return {w: k for k, w in enumerate(words.split("\n"))} if words else {}


class Letters(dict):
    """Whether a character belongs to words, remembered."""

    def __missing__(self, c: str) -> bool:
        self[c] = found = WORD.match(c) is not None
        return found


LETTERS = Letters()


def words_of(text: str | None) -> list[str]:
    """The matches of WORD. What is no letter becomes a space, a character at a time, which is faster than the pattern unless there are many such characters."""
    low = (text or "").lower()
    others = [c for c in set(low) if not LETTERS[c]]
    if len(others) > SIGNS:
        return WORD.findall(low)
    for c in others:
        low = low.replace(c, " ")
    return low.split()


def examples(docs: DataFrame, labels: DataFrame, train: object) -> DataFrame:
    """Labelled texts of the hash-ordered sample: doc_id, text, toxic. ``train`` keeps rows of ``labels`` to learn from."""
    known = labels.where(train).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)  # at most LABELLED rows of two numbers
    return durable(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "examples")


def _example_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {0: Counter(), 1: Counter()}
    for batch in slices(batches, "text"):
        for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
            counts[toxic].update(set(words_of(text)))
    words = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([counts[y][w] for w in words], pa.int64()) for y in (1, 0)]], ["word", "bad", "good"])


def example_words(sample: DataFrame) -> pa.Table:
    """Every word of the examples in order, with the numbers of toxic and of clean examples that have it."""
    return sample.mapInArrow(_example_counts, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy("word").toArrow()


def frequencies(docs: DataFrame, words: list[str]) -> np.ndarray:
    """Documents of the whole table that hold each word; the last entry counts all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(packed("\n".join(words)))
    size = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = numbered(unpacked(shared.value)), np.zeros(size + 2, np.int64)  # the last two: all documents, words of no example
        for batch in slices(batches, "text"):
            seen = Counter()  # of a piece's words, each of which is looked up once
            for text in texts(batch):
                seen.update(set(words_of(text)))
            total[np.fromiter(map(number.get, seen, repeat(size + 1)), np.int64, len(seen))] += np.fromiter(seen.values(), np.int64, len(seen))
            total[size] += len(batch)
        at = np.flatnonzero(total[: size + 1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(size + 1, np.int64)
    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    shared.destroy()
    return out


class Weights:
    """Unit TF-IDF vectors over all words of the examples. It travels as words and counts, packed."""

    def __init__(self, words: list[str], frequency: np.ndarray, bad: np.ndarray, good: np.ndarray, odds: float):
        self.frequency, self.bad, self.good, self.odds = frequency, bad, good, odds
        self.words = {w: k for k, w in enumerate(words)}
        self.idf = np.log((frequency[-1] + 1) / (frequency[:-1] + 1)) + 1
        self.unseen = float(np.log(frequency[-1] + 1)) + 1
        self.factor = self.idf * self.relevance(bad, good)

    def __reduce__(self) -> tuple:
        return _weights, (packed(("\n".join(self.words), self.frequency, self.bad.astype(np.int32), self.good.astype(np.int32), self.odds)),)

    def relevance(self, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        """One for a word that no toxic example has."""
        return np.log2(2 + bad * self.odds / np.maximum(good, 1)) ** POWER

    def vector(self, text: str | None, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text; ``own`` is the label of an example whose own part in the relevance is taken out."""
        counts = Counter(words_of(text))
        number = np.fromiter(map(self.words.get, counts, repeat(-1)), np.int64, len(counts))
        times = np.fromiter(counts.values(), float, len(counts))
        known = number >= 0
        at = number[known]
        w = 1 + np.log(times[known])
        if own is None:
            w *= self.factor[at]
        else:
            w *= self.idf[at] * self.relevance(self.bad[at] - own, self.good[at] - (1 - own))
        rest = (1 + np.log(times[~known])) * self.unseen
        return at, w / max(float(np.sqrt((w * w).sum() + (rest * rest).sum())), 1e-12)


def _weights(state: bytes) -> Weights:
    words, *counts = unpacked(state)
    return Weights(list(numbered(words)), *counts)


class Index:
    """Block-max inverted index over the examples. It travels as posting lists of all terms, packed."""

    def __init__(self, ids: list, toxic: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, ready: bool = True):
        """Not ``ready``: blocks and lists are made when they are first searched, so that a driver which only sends the index on never holds them."""
        # Examples with the same heaviest term stand together, so that blocks hold like vectors and their maxima are tight.
        order = sorted(range(len(ids)), key=lambda k: (int(vectors[k][0][vectors[k][1].argmax()]) if len(vectors[k][0]) else terms, k))
        at = np.concatenate([vectors[k][0] for k in order])
        weights = np.concatenate([vectors[k][1] for k in order]).astype(np.float32)
        rows = np.repeat(np.arange(len(ids), dtype=np.int32), [len(vectors[k][0]) for k in order])
        sort = np.argsort(at, kind="stable")
        self.ids, self.toxic, self.lists, self.column = [ids[k] for k in order], toxic[order].astype(float), (rows[sort], weights[sort], np.bincount(at, minlength=terms)), None
        if ready:
            self._build()

    def _build(self) -> None:
        ids, (rows, weights, often) = self.ids, self.lists
        self.places: dict = {}
        for row, i in enumerate(ids):
            self.places.setdefault(i, []).append(row)
        frequent = np.argsort(-often, kind="stable")[:FREQUENT]
        frequent = frequent[often[frequent] > 1]
        self.column = np.full(len(often), -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        blocks = -(-len(ids) // BLOCK)
        self.dense = np.zeros((len(frequent), blocks * BLOCK), np.float32)
        column = np.repeat(self.column, often)
        mine = column >= 0
        self.dense[column[mine], rows[mine]] = weights[mine]
        self.most = self.dense.reshape(len(frequent), blocks, BLOCK).max(2)
        self.examples = None  # the same by examples, made where it is first used
        self.rows, self.weights = rows[~mine], weights[~mine]
        self.start = np.concatenate([[0], np.cumsum(np.where(self.column >= 0, 0, often))])

    def __getstate__(self) -> bytes:
        rows, weights, often = self.lists
        return packed((self.ids, self.toxic, rows, weights, often.astype(np.int32)))

    def __setstate__(self, state: bytes) -> None:
        self.ids, self.toxic, *lists = unpacked(state)
        self.lists = tuple(lists)
        self._build()

    def near(self, at: np.ndarray, w: np.ndarray, but: list[int] | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the NEAR nearest examples with a positive cosine; rows ``but`` are left out."""
        return self.nearest([(at, w, but)])[0]

    def nearest(self, queries: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for many queries of terms, weights and rows to leave out."""
        if self.column is None:
            self._build()
        size = max(1, min(TOGETHER, CELLS // max(len(self.ids), 1)))
        # Queries with the same most frequent terms (of one language, say) meet the examples together: they share few other terms with the rest.
        order = sorted(range(len(queries)), key=lambda k: self._commonest(queries[k][0]))
        out: list = [None] * len(queries)
        for a in range(0, len(order), size):
            for k, found in zip(order[a : a + size], self._batch([queries[k] for k in order[a : a + size]])):
                out[k] = found
        return out

    def _commonest(self, at: np.ndarray) -> list[int]:
        column = self.column[at]
        return np.sort(column[column >= 0])[:6].tolist()

    def _batch(self, queries: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        cosine, terms, found, open_ = np.empty((len(queries), len(self.ids))), [], [], []
        for k, (at, w, but) in enumerate(queries):
            column = self.column[at]
            often = column >= 0
            low, n = self.start[at], self.start[at + 1] - self.start[at]
            each = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            cosine[k] = np.bincount(self.rows.take(each), self.weights.take(each) * np.repeat(w, n), len(self.ids))
            column, w = column[often], w[often]
            terms.append((column, w))
            bound = cosine[k] + (w.astype(np.float32) @ self.most[column]).repeat(BLOCK)[: len(self.ids)]
            bound[list(but)] = 0.0
            # First those with the best bounds, then all that can still be among the nearest.
            some = 4 * NEAR
            first = np.argpartition(bound, -some)[-some:] if len(bound) > some else np.arange(len(bound))
            first = first[bound[first] > 0]
            best = self._keep(first, self._exact(cosine[k], column, w, first))
            bound[first] = -1.0
            found.append(best)
            open_.append(np.flatnonzero(bound >= max(best[1][-1] - SLACK if len(best[1]) == NEAR else 0.0, 1e-12)))
        for k, more in self._narrowed(cosine, terms, found, open_):
            rows, exact = found[k]
            found[k] = self._keep(np.concatenate([rows, more]), np.concatenate([exact, self._exact(cosine[k], *terms[k], more)]))
        return found

    def _exact(self, cosine: np.ndarray, column: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        # A row of weights is read faster whole than in many places; a few examples are read one by one.
        if len(rows) * 16 < len(cosine):
            if self.examples is None:
                self.examples = np.ascontiguousarray(self.dense.T)
            rest = self.examples[rows[:, None], column] @ w
        else:
            rest = (w @ self.dense[column])[rows]
        return np.round(cosine[rows] + rest, 6)

    @staticmethod
    def _keep(rows: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, exact = rows[exact > 0], exact[exact > 0]
        keep = np.lexsort((rows, -exact))[:NEAR]
        return rows[keep], exact[keep]

    def _narrowed(self, cosine: np.ndarray, terms: list[tuple], found: list[tuple], open_: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Of each query's open examples those that may be among the nearest by their cosines in single precision; a few are handed on as they are."""
        wide = RUN * BLOCK
        many = [k for k, more in enumerate(open_) if len(more) * 16 >= len(self.ids)]
        weights, needs = np.zeros((len(many), len(self.dense)), np.float32), np.zeros((len(many), -(-len(self.ids) // wide)), bool)
        for j, k in enumerate(many):
            weights[j, terms[k][0]] = terms[k][1]
            needs[j, open_[k] // wide] = True
        used = np.flatnonzero(weights.any(0))
        weights = np.ascontiguousarray(weights[:, used])
        rest = np.zeros((len(many), self.dense.shape[1]), np.float32)
        for run in range(needs.shape[1]):
            mine = np.flatnonzero(needs[:, run])
            if len(mine):
                rest[mine, run * wide : (run + 1) * wide] = weights[mine] @ self.dense[used, run * wide : (run + 1) * wide]
        place = {k: j for j, k in enumerate(many)}
        for k, more in enumerate(open_):
            if k in place:
                about = cosine[k, more] + rest[place[k], more]
                # The last of the NEAR best, of those found and of these.
                best = np.concatenate([found[k][1], about])
                floor = np.partition(best, len(best) - NEAR)[len(best) - NEAR] if len(best) >= NEAR else 0.0
                more = more[about >= floor - 2 * SLACK]
            if len(more):
                yield k, more

    def votes(self, queries: list[tuple]) -> list[tuple[float, np.ndarray]]:
        """Share of toxic neighbours, weighted by cosine, and the neighbours' rows, for queries as in ``nearest``."""
        return [(float((cosine * self.toxic[rows]).sum() / (cosine.sum() + SHRINK)), rows) for rows, cosine in self.nearest(queries)]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on x."""
    stack: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist())):
        stack.append([b, 1.0, a, a])
        while len(stack) > 1 and (stack[-2][0] >= stack[-1][0] or stack[-2][3] == stack[-1][2]):
            v, n, lo, hi = stack.pop()
            u = stack[-1]
            stack[-1] = [(u[0] * u[1] + v * n) / (u[1] + n), u[1] + n, u[2], hi]
    knots = [(lo, v) for v, _, lo, _ in stack] + [(hi, v) for v, _, _, hi in stack]
    knots.sort()
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


class Model:
    """Weights, index of the examples with words, knots from votes to probabilities, and the score of texts that have no neighbour."""

    def __init__(self, weights: Weights, rows: list[tuple]):
        """Rows are doc_id, toxic, terms and weights."""
        filled, blank = [r for r in rows if len(r[2])], [r[1] for r in rows if not len(r[2])]
        self.weights, self.knots = weights, None
        self.blank = (sum(blank) + sum(r[1] for r in rows) / max(len(rows), 1)) / (len(blank) + 1)
        self.index = Index([r[0] for r in filled], np.array([r[1] for r in filled], float), [(np.asarray(r[2], np.int64), np.asarray(r[3])) for r in filled], len(weights.words), ready=False) if filled else None

    def score(self, text: str | None) -> tuple[float, list]:
        return self.scores([text])[0]

    def scores(self, texts: list) -> list[tuple[float, list]]:
        """Score and evidence of each text."""
        out: list[tuple[float, list]] = [(self.blank, [])] * len(texts)
        if self.index is None:
            return out
        vectors = [self.weights.vector(t) for t in texts]
        asked = [k for k, (at, _) in enumerate(vectors) if len(at)]
        for k, (vote, rows) in zip(asked, self.index.votes([(*vectors[k], ()) for k in asked])):
            if len(rows):
                # A little of the vote itself keeps the order of votes inside one step.
                out[k] = float(np.clip(0.98 * np.interp(vote, *self.knots) + 0.02 * vote, 0, 1)), [self.index.ids[r] for r in rows[:5].tolist()]
        return out


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    share = docs.sparkSession.sparkContext.broadcast
    found = example_words(sample)
    clean, toxic = (sample.agg(F.sum(F.when(F.col("toxic") == y, 1).otherwise(0)).alias("n")).head()["n"] or 0 for y in (0, 1))
    words = found.column("word").to_pylist()
    weights = Weights(words, frequencies(docs, words), found.column("bad").to_numpy(), found.column("good").to_numpy(), clean / max(toxic, 1))
    sent = share(weights)
    kind = sample.schema["doc_id"].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = [sent.value.vector(t) for t in texts(batch)]
            lists = [pa.array([x[j] for x in got], pa.list_(k)) for j, k in ((0, pa.int64()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], ["doc_id", "toxic", "terms", "weights"])

    # At most LABELLED examples.
    rows = sample.select("doc_id", "toxic", "text").mapInArrow(vectors, f"doc_id {kind}, toxic int, terms array<bigint>, weights array<double>").orderBy("doc_id").toArrow()
    sent.destroy()
    model = Model(weights, list(zip(*(c.to_pylist() if k < 2 else c.to_numpy() for k, c in enumerate(rows.columns)))))
    if model.index is None:
        return model
    shared = share(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text"):
            queries, labels = [], []
            for i, text, y in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("toxic").to_pylist()):
                at, w = model.weights.vector(text, own=y)
                if len(at):
                    queries.append((at, w, model.index.places.get(i, ())))
                    labels.append(y)
            got = [(vote, y) for (vote, _), y in zip(model.index.votes(queries), labels)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in got], pa.float64()), pa.array([y for _, y in got], pa.int32())], ["vote", "toxic"])

    own = sample.select("doc_id", "toxic", "text").mapInArrow(votes, "vote double, toxic int").toArrow()
    shared.destroy()
    model.knots = isotonic(own.column("vote").to_numpy(), own.column("toxic").to_numpy())
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then score, predicted and evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = to_arrow_type(docs.schema["doc_id"].dataType)
    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text"):
            got = model.scores(texts(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), pa.array([e for _, e in got], pa.list_(ids))], [*batch.schema.names[1:], "score", "predicted", "evidence"])

    return docs.select("text", *keep).mapInArrow(run, f"{columns}, score double, predicted int, evidence array<{kind}>")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit(docs, examples(docs, labels, fold(labels, 5) != 0))
    return score(docs.withColumn("held_out", fold(docs, 5) == 0), model, ["doc_id", "held_out"])
