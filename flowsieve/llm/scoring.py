"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is read as words (A-Z lowered, split at white space), each followed by a space, and one end sign, so its probability is that of the token sequence.
Bytes become bits by a Huffman code of the training bytes. For every bit, ORDERS predictors look up the hash of their context and of the place in the
code; each gives the log odds that the training counts of that slot show. Contexts are the last three bytes of the word, all of the word so far, and, once more, two bytes and all of the
word together with the state of the document: the language (a column of the training documents) that the frequent words before speak for. One more context
goes over the edge of the word: the word before and all of the word so far. A mixer adds them up with weights chosen by a gate (depth in the code, place in the word). The gated weights are fitted on one fold of the
training text; while a document is read, two factors on them, one for the contexts without and one for those with a state, follow the gradient, STEP
bits at a time, from the bits already read.

Everything gathered grows with the corpus: words of all training documents are counted by language (a sum with partial counts in the tasks), and the slots of
contexts that are a word's and a state's are filled from the word table, weighted by counts. The word table knows no order: the slots of the context with the word before are
filled by a pass over the texts of all training documents. Weights are fitted by Newton steps on the words, and then on the texts, of one
fold of the training documents, with slots filled from the others; then the slots of all of them are used. Slot tables have a fixed size
(2**SLOTS in all orders, 2**FOLLOW for the word before), as hashed contexts have, and are what the tasks get.

The base score needs the count of every token. The FREQUENT most frequent words are a dictionary of bounded size in every task, so they never meet in a
shuffle; the others are joined to the word table by word, where no word has a large share of rows.

Nulls: a null text is empty and consists of its end sign. Null ids are in no held-out part. Without a language column, or for languages beyond the STATES most frequent, there is no state. Repeated rows are scored each on its own. Without training
documents all slots are empty and every bit costs one bit. An empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import fold, mix, slices, table, texts
from flowsieve.session import durable

NEAR, STATE_NEAR = 3, 2
# Contexts: NEAR bytes, the word so far; with the state: STATE_NEAR bytes, the word so far. Slots are numbered by the hash's upper bits.
ORDERS, STATED = 4, 2
SLOTS = [19, 22, 19, 21]
STATES, MARGIN = 15, 2.0
START = np.concatenate([[0], np.cumsum([1 << s for s in SLOTS])])
# The context with the word before has slots of its own behind the others.
FOLLOW = 22
BLOCK = 1 << 15
GATES = 8 * 4
STEP = 192
RATE = 0.002
PRIOR = 0.3
SCALE = 16.0
FREQUENT = 1 << 17
END = b"\n"
POOL_BITS = 6_000_000
PIECE = 1 << 20
BEGIN = np.uint64(0x5851F42D4C957F2D)
SPREAD = np.uint64(0x9FB21C651E98DF25)
NODE_MIX = mix(np.arange(512, dtype=np.uint64) + np.uint64(0x7654321))
BYTE_MIX = mix(np.arange(256 * 256, dtype=np.uint64) + np.uint64(0x1234567))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


# --- counts ------------------------------------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # By language: a word's key is the number of its language, then the word.
    whole: dict[int, Counter] = {}
    fit: dict[int, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for state, counts in whole.items():
            fitted = fit.get(state, {})
            words = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([bytes([state]) + w for w in words], pa.binary()), pa.array(counts.values(), pa.int64()), pa.array([fitted.get(w, 0) for w in words], pa.int64())], ["word", "c", "c_fit"])

    for batch in slices(batches, "text"):
        for text, fitting, state in zip(texts(batch), batch.column("fitting").to_pylist(), batch.column("state").to_pylist()):
            words = tokens(text)
            words.append(END)
            whole.setdefault(state, Counter()).update(words)
            if fitting:
                fit.setdefault(state, Counter()).update(words)
        if sum(map(len, whole.values())) > 400_000:
            yield from rows()
            whole.clear()
            fit.clear()
    yield from rows()


def word_counts(train: DataFrame) -> DataFrame:
    """word (with its state in front), c (all training documents), c_fit (those with ``fitting``)."""
    return durable(train.select("text", "fitting", "state").mapInArrow(_count, "word binary, c long, c_fit long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_fit").alias("c_fit")), "words")


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(258)
    for batch in batches:
        words, c = [w[1:] for w in batch.column("word").to_pylist()], batch.column("c").to_numpy()
        sizes = np.array([len(w) for w in words], np.int64)
        total[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(c, sizes), 256)
        total[32] += c.sum()
        total[256] += len(words)
        total[257] += c.sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(258)), pa.array(total.astype(np.int64))], ["k", "n"])


class Code:
    """Huffman code of bytes: node numbers, bits and depths along each byte's path."""

    def __init__(self, counts: np.ndarray):
        counts = counts + counts.sum() / 16384 + 1
        heap = [(float(c), b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        children, order = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[order] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], order, order))
            order += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        stack = [(heap[0][2], [])]
        while stack:
            node, path = stack.pop()
            if node < 256:
                paths[node] = path
            else:
                stack += [(child, [*path, (node, bit)]) for bit, child in enumerate(children[node])]
        self.size = np.array([len(paths[b]) for b in range(256)])
        width = self.size.max()
        self.nodes, self.bits = np.zeros((256, width), np.int64), np.zeros((256, width), np.int8)
        for b, path in paths.items():
            self.nodes[b, : len(path)] = [n for n, _ in path]
            self.bits[b, : len(path)] = [x for _, x in path]

    def spread(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slots [bits, ORDERS], bits, gates, and bits per word."""
        state = np.fromiter((w[0] for w in words), np.uint64, len(words))
        marked = [END if w[1:] == END else w[1:] + b" " for w in words]
        sizes = np.array([len(w) for w in marked])
        sym = np.frombuffer(b"".join(marked), np.uint8).astype(np.int64)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(sym)) - first
        context = np.zeros((len(sym), ORDERS), np.uint64)
        near = np.zeros(len(sym), np.int64)
        for k in range(1, NEAR + 1):
            near = near * 257 + np.where(at >= k, sym[np.maximum(np.arange(len(sym)) - k, 0)] + 1, 0)
            if k == STATE_NEAR:
                context[:, STATED] = near.astype(np.uint64)
        context[:, 0] = near.astype(np.uint64)
        sums = np.cumsum(BYTE_MIX[(np.minimum(at, 255) << 8) | sym], dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), sums[:-1]])
        context[:, 1] = context[:, STATED + 1] = before - before[first]
        context[:, STATED:] += mix((np.repeat(state, sizes) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))[:, None]
        context = mix(context * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, ORDERS + 1, dtype=np.uint64))
        n = self.size[sym]
        total = int(n.sum())
        depth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        step = np.repeat(sym * self.nodes.shape[1], n) + depth
        place = NODE_MIX.take(self.nodes.ravel().take(step))
        slots = np.empty((ORDERS, total), np.int32)
        for k in range(ORDERS):
            hashed = np.repeat(context[:, k], n)
            hashed += place
            hashed *= SPREAD
            hashed >>= np.uint64(64 - SLOTS[k])
            np.add(hashed.view(np.int64), START[k], out=slots[k], casting="unsafe")
        if not state.all():
            blank = np.repeat(np.repeat(state == 0, sizes), n)  # without a state, the contexts without one stand in
            for k in range(STATED, ORDERS):
                np.copyto(slots[k], slots[k - STATED], where=blank)
        gate = np.minimum(depth, 7) * 4 + np.repeat(np.minimum(at, 3), n)
        return slots.T, self.bits.ravel().take(step), gate, np.add.reduceat(n, np.cumsum(sizes) - sizes)


    def inside(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the word so far and the place in the code, marks (bit, then gate), and bits per word."""
        marked = [w if w == END else w + b" " for w in words]
        sizes = np.array([len(w) for w in marked])
        sym = np.frombuffer(b"".join(marked), np.uint8).astype(np.int64)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(sym)) - first
        sums = np.cumsum(BYTE_MIX[(np.minimum(at, 255) << 8) | sym], dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), sums[:-1]])
        n = self.size[sym]
        depth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        step = np.repeat(sym * self.nodes.shape[1], n) + depth
        mark = (np.minimum(depth, 7) * 4 + np.repeat(np.minimum(at, 3), n)) * 2 + self.bits.ravel().take(step)
        return np.repeat(mix(before - before[first]), n) + NODE_MIX.take(self.nodes.ravel().take(step)), mark.astype(np.uint8), np.add.reduceat(n, np.cumsum(sizes) - sizes)


# --- words in their order --------------------------------------------------------------------------------------------------------------


class Tokens:
    """The texts of a batch as numbers of common words (-1 for others), the other words in order, and the words of each text."""

    def __init__(self, batch: pa.RecordBatch, number: dict[bytes, int]):
        self.docs = [[*tokens(t), END] for t in texts(batch)]
        self.lengths = np.array([len(d) for d in self.docs])
        flat = [w for d in self.docs for w in d]
        self.at = np.fromiter(map(number.get, flat, repeat(-1)), np.int64, len(flat))
        self.far = np.flatnonzero(self.at < 0)
        self.others = [flat[i] for i in self.far.tolist()]
        self.stop = np.cumsum(self.lengths)

    def states(self, speaks: np.ndarray) -> np.ndarray:
        return np.concatenate([states(self.at[b - n : b], speaks) for n, b in zip(self.lengths.tolist(), self.stop.tolist())])


class Sequence:
    """Slots of words that follow each other: the hash of the word before with that of each bit. Common words are kept while there is room, as in ``Pool``."""

    def __init__(self, code: Code, common: list[bytes]):
        self.code, self.common = code, common
        self.first, self.size = np.full(max(len(common), 1), -1, np.int32), np.zeros(max(len(common), 1), np.int32)
        self.held, self.mark, self.used = np.zeros(POOL_BITS // 4, np.uint64), np.zeros(POOL_BITS // 4, np.uint8), 0
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, common), np.uint64, len(common))

    def _put(self, words: list[bytes], at: int) -> tuple[np.ndarray, np.ndarray]:
        held, mark, per_word = self.code.inside(words)
        if at + len(held) > len(self.held):
            room = at + len(held) + POOL_BITS // 4
            self.held, self.mark = (np.concatenate([a[:at], np.zeros(room - at, a.dtype)]) for a in (self.held, self.mark))
        self.held[at : at + len(held)], self.mark[at : at + len(held)] = held, mark
        return at + np.cumsum(per_word) - per_word, per_word

    def rows(self, at: np.ndarray, rare: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each token."""
        far = at < 0
        near = at[~far]
        start, size = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        new = np.unique(near[self.first[near] < 0])
        if len(new):
            self.first[new], self.size[new] = self._put([self.common[k] for k in new.tolist()], self.used)
        start[~far], size[~far] = self.first[near], self.size[near]
        top = self.used + int(self.size[new].sum())
        if top <= POOL_BITS:
            self.used = top
        else:
            self.first[new] = -1  # no room to keep them
        if rare:
            number = {w: k for k, w in enumerate(dict.fromkeys(rare))}
            first, rows = self._put(list(number), top)
            which = np.fromiter(map(number.__getitem__, rare), np.int64, len(rare))
            start[far], size[far] = first[which], rows[which]
        return start, size

    def pieces(self, at: np.ndarray, rare: list[bytes], lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """From and to which token, bits per token, slots and marks, some PIECE bits at a time."""
        start, size = self.rows(at, rare)
        own = np.empty(len(at), np.uint64)
        own[at >= 0] = self.hash[at[at >= 0]]
        own[at < 0] = np.fromiter(map(xxhash.xxh3_64_intdigest, rare), np.uint64, len(rare))
        before = np.concatenate([[BEGIN], own[:-1]])
        before[np.cumsum(lengths) - lengths] = BEGIN
        ends = np.cumsum(size)
        edges = [0, *np.unique(np.searchsorted(ends, np.arange(PIECE, ends[-1], PIECE))).tolist(), len(at)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            n = size[a:b]
            row = np.repeat(start[a:b] - (np.cumsum(n) - n), n)
            row += np.arange(len(row))
            slot = self.held.take(row)
            slot += np.repeat(before[a:b], n)
            slot *= SPREAD
            slot >>= np.uint64(64 - FOLLOW)
            yield a, b, n, slot.view(np.int64), self.mark.take(row)


_sequences: dict[str, Sequence] = {}


def kept_sequence(run: str, code: Code, common: dict[bytes, int]) -> Sequence:
    """The sequence of this run, shared like ``kept_pool``."""
    if run not in _sequences:
        _sequences.clear()
        _sequences[run] = Sequence(code, list(common))
    return _sequences[run]


# --- slots and weights --------------------------------------------------------------------------------------------------------------


def _parts(df: DataFrame, rows: int) -> DataFrame:
    return df.repartition(int(max(1, min(256, max(8, rows // 5_000_000), rows // 200_000 + 1))))


def _filler(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2 * START[-1]), np.float32)  # all, fitting fold; slots of bit 0, then of bit 1

        def add(row: np.ndarray, slots: np.ndarray, weight: np.ndarray) -> None:
            for k in range(ORDERS):
                np.add.at(row, slots[:, k], weight)

        for batch in batches:
            words, c, fit = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float32), batch.column("c_fit").to_numpy().astype(np.float32)
            for a in range(0, len(words), 20_000):
                slots, bits, _, per_word = code.value.spread(words[a : a + 20_000])
                up = (bits.astype(np.int32) * np.int32(START[-1]))[:, None]
                for row, weight in zip(counts, (c, fit)):
                    w = np.repeat(weight[a : a + 20_000], per_word)
                    use = w > 0
                    add(row, (slots + up)[use] if not use.all() else slots + up, w[use])
        yield from _sent(counts.reshape(2, 2, START[-1]), 0)

    return run


def _sent(counts: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """Blocks of counts [all or fitting fold, bit, slot], numbered from ``first``."""
    for v in (0, 1):
        for block in range(-(-counts.shape[2] // BLOCK)):
            part = counts[v, :, block * BLOCK : (block + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), pa.array([first + block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["v", "block", "data"])


def _follower(name: str, code, frequent):
    """Counts of the slots of the word before, over texts (text, fitting)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = frequent.value[0]
        sequence = kept_sequence(name, code.value, number)
        counts = np.zeros((2, 2 << FOLLOW), np.float32)
        for batch in slices(batches, "text", 1_000_000):
            some = Tokens(batch, number)
            fitting = np.repeat(np.array(batch.column("fitting").to_pylist(), bool), some.lengths)
            for a, b, n, slot, mark in sequence.pieces(some.at, some.others, some.lengths):
                slot += (mark & 1).astype(np.int64) << FOLLOW
                np.add.at(counts[0], slot, np.float32(1))
                if fitting[a:b].any():
                    np.add.at(counts[1], slot[np.repeat(fitting[a:b], n)], np.float32(1))
        yield from _sent(counts.reshape(2, 2, 1 << FOLLOW), int(START[-1]) // BLOCK)

    return run


def _add_blocks(group: pa.Table) -> pa.Table:
    """Log odds of a block, from all folds and from those that are not fitted on."""
    total = {0: 0.0, 1: 0.0}
    for v, data in zip(group.column("v").to_pylist(), group.column("data").to_pylist()):
        total[v] = total[v] + np.frombuffer(zlib.decompress(data), np.float32).reshape(2, -1).astype(np.float64)
    out = []
    for n in (total[0], np.maximum(total[0] - total[1], 0)):
        odds = np.log((n[1] + PRIOR) / (n[0] + PRIOR))
        out.append(np.clip(np.round(odds * SCALE), -127, 127).astype(np.int8).tobytes())
    return pa.table({"block": group.column("block")[:1], "whole": pa.array(out[:1], pa.binary()), "rest": pa.array(out[1:], pa.binary())})


def fill(words: DataFrame, train: DataFrame, name: str, code, frequent, rows: int) -> np.ndarray:
    """Log odds per slot, those of the word before behind the others: from the other folds and from all of them."""
    out = np.zeros((2, START[-1] + (1 << FOLLOW)), np.int8)
    counted = _parts(words, rows).mapInArrow(_filler(code), "v int, block int, data binary")
    counted = counted.unionByName(train.select("text", "fitting").mapInArrow(_follower(name, code, frequent), counted.schema))
    blocks = counted.groupBy("block").applyInArrow(_add_blocks, "block int, whole binary, rest binary")
    for block, whole, rest in blocks.collect():  # two tables of bytes, of that many slots at most
        out[0, block * BLOCK : block * BLOCK + len(rest)] = np.frombuffer(rest, np.int8)
        out[1, block * BLOCK : block * BLOCK + len(whole)] = np.frombuffer(whole, np.int8)
    return out


def fit_weights(words: DataFrame, code, odds, rows: int, rounds: int = 3) -> np.ndarray:
    """Gated weights by Newton steps on the words of the fitting fold."""
    spark = words.sparkSession
    fitting = _parts(words.where("c_fit > 0").select("word", "c_fit"), rows)
    weights = np.full((GATES, ORDERS), 0.3)

    def pass_over(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, hess = np.zeros((GATES, ORDERS)), np.zeros((GATES, ORDERS, ORDERS))
            w, stretch = shared.value.astype(np.float32), odds.value
            for batch in batches:
                words, c = batch.column("word").to_pylist(), batch.column("c_fit").to_numpy()
                for a in range(0, len(words), 20_000):
                    slots, bits, gate, per_word = code.value.spread(words[a : a + 20_000])
                    count = np.repeat(c[a : a + 20_000], per_word)
                    x = [stretch.take(slots[:, i]).astype(np.float32) / SCALE for i in range(ORDERS)]
                    p = 1 / (1 + np.exp(-sum(w[:, i].take(gate) * x[i] for i in range(ORDERS))))
                    e, v = count * (bits - p), count * p * (1 - p)
                    for i in range(ORDERS):
                        grad[:, i] += np.bincount(gate, e * x[i], GATES)
                        scaled = v * x[i]
                        for j in range(i + 1):
                            hess[:, i, j] += np.bincount(gate, scaled * x[j], GATES)
            values = np.concatenate([grad.ravel(), hess.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "value"])

        return run

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)
        sums = np.zeros(GATES * ORDERS * (1 + ORDERS))
        for k, value in fitting.mapInArrow(pass_over(shared), "k long, value double").groupBy("k").agg(F.sum("value")).collect():
            sums[k] = value
        grad = sums[: GATES * ORDERS].reshape(GATES, ORDERS) - 1e-3 * (weights - 0.3)
        low = sums[GATES * ORDERS :].reshape(GATES, ORDERS, ORDERS)
        hess = low + np.tril(low, -1).transpose(0, 2, 1) + np.eye(ORDERS) * 1e-3
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        weights = weights + np.clip(step, -0.5, 0.5)
        shared.unpersist()
    return weights


def fit_follow(train: DataFrame, name: str, code, frequent, model, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Per gate, what the weights of the other contexts are multiplied by and the weight of the context with the word before: Newton steps on the texts of the fitting fold."""
    spark = train.sparkSession
    fitting = train.where("fitting").select("text")
    weights, prior = np.tile([1.0, 0.3], (GATES, 1)), np.array([1.0, 0.3])

    def pass_over(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, _, speaks = frequent.value
            sequence, pool = kept_sequence(name, code.value, number), kept_pool(f"{name}-fit", code.value, model.value[:2], number)
            w, odds, sums = shared.value.astype(np.float32), model.value[2], np.zeros((5, GATES))
            for batch in slices(batches, "text", 1_000_000):
                some = Tokens(batch, number)
                start, size = pool.rows(some.at, some.states(speaks), some.others)
                for a, b, n, slot, mark in sequence.pieces(some.at, some.others, some.lengths):
                    row = np.repeat(start[a:b] - (np.cumsum(n) - n), n) + np.arange(len(slot))
                    gate = mark >> 1
                    x = pool.z[0].take(row) + pool.z[1].take(row)
                    y = odds.take(slot) * SIGNS.take(mark & 1)
                    miss = 1 / (1 + np.exp(w[:, 0].take(gate) * x + w[:, 1].take(gate) * y))
                    v = miss * (1 - miss)
                    for k, value in enumerate((miss * x, miss * y, v * x * x, v * x * y, v * y * y)):
                        sums[k] += np.bincount(gate, value, GATES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["k", "value"])

        return run

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)
        sums = np.zeros(5 * GATES)
        for k, value in fitting.mapInArrow(pass_over(shared), "k long, value double").groupBy("k").agg(F.sum("value")).collect():
            sums[k] = value
        gx, gy, xx, xy, yy = sums.reshape(5, GATES)
        grad = np.stack([gx, gy], axis=1) - 1e-3 * (weights - prior)
        hess = np.stack([xx, xy, xy, yy], axis=1).reshape(GATES, 2, 2) + np.eye(2) * 1e-3
        weights = weights + np.clip(np.linalg.solve(hess, grad[:, :, None])[:, :, 0], -0.5, 0.5)
        shared.unpersist()
    return weights[:, 0], weights[:, 1]


# --- scores ---------------------------------------------------------------------------------------------------------------------------


class Pool:
    """Inputs of words: mixed log odds per bit of the contexts without and with a state, with the bit's sign worked in.

    Common words are kept while there is room; the others are worked out for the texts at hand and stand behind the kept ones. Row 0 is a bit that is sure.
    """

    def __init__(self, code: Code, odds: np.ndarray, weights: np.ndarray, common: list[bytes], follow: tuple | None = None):
        self.follow = follow  # log odds of the context with the word before, their weights per gate, and the sequence that has its slots
        self.code, self.odds, self.weights, self.common = code, odds, weights.astype(np.float32), common
        self.first, self.size = np.full((STATES + 1) * max(len(common), 1), -1, np.int32), np.zeros((STATES + 1) * max(len(common), 1), np.int32)
        self.used = 1
        self.z = np.zeros((2, POOL_BITS // 4), np.float32)
        self.z[0, 0] = 40.0

    def _put(self, words: list[bytes], at: int) -> tuple[np.ndarray, np.ndarray]:
        """Work out words and write them from row ``at``: their first rows and numbers of rows."""
        slots, bits, gate, per_word = self.code.spread(words)
        if at + len(bits) > self.z.shape[1]:
            grown = np.zeros((2, at + len(bits) + POOL_BITS // 4), np.float32)
            grown[:, :at] = self.z[:, :at]
            self.z = grown
        sign = np.where(bits > 0, np.float32(1 / SCALE), np.float32(-1 / SCALE))
        for z, orders in zip(self.z, (range(STATED), range(STATED, ORDERS))):
            x = sum(self.odds.take(slots[:, k]) * self.weights[:, k].take(gate) for k in orders)
            np.multiply(x, sign, out=z[at : at + len(bits)])
        return at + np.cumsum(per_word) - per_word, per_word

    def rows(self, at: np.ndarray, state: np.ndarray, rare: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each token: number of its common word (or -1), state, and the other words in order."""
        key = state * max(len(self.common), 1) + at
        far = at < 0
        near = key[~far]
        start, size = np.empty(len(at), np.int32), np.empty(len(at), np.int32)
        new = np.unique(near[self.first[near] < 0])
        if len(new):
            words = [MARKS[k // len(self.common)] + self.common[k % len(self.common)] for k in new.tolist()]
            self.first[new], self.size[new] = self._put(words, self.used)
        start[~far], size[~far] = self.first[near], self.size[near]
        top = self.used + int(self.size[new].sum())
        if top <= POOL_BITS:
            self.used = top
        else:
            self.first[new] = -1  # no room to keep them
        if rare:
            marked = [MARKS[k] + w for k, w in zip(state[far].tolist(), rare)]
            number = {w: k for k, w in enumerate(dict.fromkeys(marked))}
            first, rows = self._put(list(number), top)
            which = np.fromiter(map(number.__getitem__, marked), np.int64, len(marked))
            start[far], size[far] = first[which], rows[which]
        return start, size

    def scores(self, at: np.ndarray, state: np.ndarray, rare: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each of the token lists, which follow each other with these lengths."""
        start, size = self.rows(at, state, rare)
        ends = np.cumsum(size, dtype=np.int64)
        stops = ends[np.cumsum(lengths) - 1]
        length = np.diff(stops, prepend=0)
        steps = -(-length // STEP)
        # Every document begins with a step of its own, filled up with sure bits.
        shift = (np.cumsum(steps) - steps) * STEP - (stops - length)
        row = np.zeros(int(steps.sum()) * STEP, np.int32)
        own = np.arange(ends[-1], dtype=np.int32)
        row[own + np.repeat(shift.astype(np.int32), length)] = np.repeat((start - (ends - size)).astype(np.int32), size) + own
        free, stated = (z.take(row, mode="clip").reshape(-1, STEP) for z in self.z)
        if self.follow:
            odds, gains, sequence = self.follow
            gain = (SIGNS * gains.astype(np.float32)[:, None]).ravel()
            place = np.repeat(shift, length)
            for a, b, n, slot, mark in sequence.pieces(at, rare, lengths):
                here = slice(int(ends[a - 1]) if a else 0, int(ends[b - 1]))
                free.reshape(-1)[own[here] + place[here]] += odds.take(slot) * gain.take(mark)
        order = np.argsort(-steps, kind="stable")
        first, steps = (np.cumsum(steps) - steps)[order], steps[order]
        factor, out = np.ones((2, len(lengths), 1), np.float32), np.zeros(len(lengths))
        for s in range(int(steps[0])):
            live = int(np.searchsorted(-steps, -s, side="left"))  # documents with steps left
            at = first[:live] + s
            a, b = free[at], stated[at]
            p = 1 / (1 + np.exp(-(a * factor[0, :live] + b * factor[1, :live])))
            out[:live] += np.log(np.maximum(p, 1e-30)).sum(1)
            miss = 1 - p
            # A sure bit that fills up a step is missed by nothing, so it moves no factor.
            factor[0, :live, 0] += RATE * np.einsum("ij,ij->i", miss, a)
            factor[1, :live, 0] += RATE * np.einsum("ij,ij->i", miss, b)
        back = np.empty(len(lengths))
        back[order] = out
        return back


_pools: dict[str, Pool] = {}


def kept_pool(run: str, code: Code, model: tuple, common: dict[bytes, int]) -> Pool:
    """The pool of this run. Tasks that follow each other in one Python worker share it, so common words are worked out once in each worker and not in each task; a new run drops the last one's."""
    if run not in _pools:
        _pools.clear()
        odds, weights, *follow = model
        _pools[run] = Pool(code, odds, weights, list(common), (*follow, kept_sequence(run, code, common)) if follow else None)
    return _pools[run]


SIGNS = np.array([-1 / SCALE, 1 / SCALE], np.float32)  # of a bit's log odds, by the bit
MARKS = [bytes([k]) for k in range(STATES + 1)]


def states(at: np.ndarray, speaks: np.ndarray) -> np.ndarray:
    """State before each word: the language that the frequent words so far speak for by MARGIN, else 0."""
    if speaks.shape[1] < 2:
        return np.full(len(at), speaks.shape[1], np.int64)
    sums = np.cumsum(speaks[at], axis=0)  # the last row, of unknown words, is zero
    sums = np.concatenate([np.zeros((1, sums.shape[1]), sums.dtype), sums[:-1]])
    two = np.partition(sums, -2, axis=1)[:, -2:]
    return np.where(two[:, 1] - two[:, 0] >= MARGIN, sums.argmax(1) + 1, 0)


def _scorer(code, model, frequent, name: str | None = None):
    name = name or uuid4().hex
    names = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "score", "known", "base", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, logs, speaks = frequent.value
        pool = kept_pool(name, code.value, model.value, number)
        first = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text", 1_000_000):
            some = Tokens(batch, number)
            docs, lengths, at, others, stop = some.docs, some.lengths, some.at, some.others, some.stop
            owner = np.repeat(np.arange(len(docs)), lengths)
            edge = np.searchsorted(some.far, stop)
            tails = [Counter(others[a:b]) for a, b in zip([0, *edge[:-1].tolist()], edge.tolist())]
            base = np.bincount(owner, np.append(logs, 0.0)[at], len(docs))
            known = lengths - np.diff(edge, prepend=0)
            score = pool.scores(at, some.states(speaks), others, lengths)
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + np.arange(n)), batch.column("doc_id"), batch.column("held_out"), pa.array(lengths, pa.int64()), pa.array([sum(map(len, d)) + len(d) - 1 for d in docs], pa.int64()), pa.array(score / np.log(10)), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int64()))],
                names,
            )
            first += n

    return run


def score(docs: DataFrame, held_out: object) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. Learns from rows that are not ``held_out``."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    df = docs.select("doc_id", "text", lang.alias("lang")).withColumn("held_out", held_out)
    train = df.where(~F.col("held_out"))
    langs = [r[0] for r in train.where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(STATES).collect()]
    state = F.coalesce(F.array_position(F.array(*map(F.lit, langs)), F.col("lang")), F.lit(0)).cast("int") if langs else F.lit(0)
    train = train.withColumn("fitting", fold(df, 10) == 1).withColumn("state", state)
    words = word_counts(train)
    by_word = words.select(F.expr("substring(word, 2)").alias("word"), "c", F.ascii(F.col("word").cast("string")).alias("state")).groupBy("word").agg(F.sum("c").alias("c"), *[F.sum(F.when(F.col("state") == k + 1, F.col("c")).otherwise(0)).alias(f"s{k}") for k in range(len(langs))])
    by_word = durable(by_word, "vocabulary")
    totals = np.zeros(258, np.int64)
    for k, n in words.select("word", "c").mapInArrow(_histogram, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        totals[k] = n
    keys, total, distinct = int(totals[256]), int(totals[257]), by_word.count()
    code = share(Code(totals[:256]))
    top = by_word.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    seen = np.array([tuple(r)[2:] for r in top], np.float64).reshape(len(top), len(langs))
    speaks = np.log((seen + 0.5) / (seen.sum(0) + 1)) if len(langs) else seen
    speaks = np.vstack([speaks - speaks.mean(1, keepdims=True) if len(langs) else speaks, np.zeros((1, len(langs)))]).astype(np.float32)
    frequent = share(({bytes(r["word"]): k for k, r in enumerate(top)}, np.log10(np.array([r["c"] for r in top], float) + 0.1), speaks))
    name = uuid4().hex
    odds = fill(words, train, name, code, frequent, keys)
    rest = share(odds[0, : START[-1]])
    weights = fit_weights(words, code, rest, keys)
    rest.unpersist()
    fitted = share((odds[0, : START[-1]], weights, odds[0, START[-1] :]))
    scale, follow = fit_follow(train, name, code, frequent, fitted)
    fitted.unpersist()
    model = share((odds[1, : START[-1]], weights * scale[:, None], odds[1, START[-1] :], follow))
    floor = float(np.log10(total + 0.1 * (distinct + 1)))
    kind = df.schema["doc_id"].dataType.simpleString()
    scored = durable(df.select("text", "doc_id", "held_out").mapInArrow(_scorer(code, model, frequent, name), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_bytes long, score double, known long, base double, rare array<binary>, times array<bigint>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("word"), F.col("t.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    found = rare.join(by_word.select("word", "c"), "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(c + 0.1)).alias("logs"))
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score(docs, fold(docs, 10) == 0)
