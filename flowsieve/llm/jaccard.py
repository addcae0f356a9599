"""Exact Jaccard join of shingle sets with a count-vector R-tree, and its components.

Sets are classes: texts with equal sets share a node, so copies cost nothing further. Two different sets of Jaccard ``share`` or more differ in at most
d = s * (1 - share) / share shingles, s being the smaller size.

1. Dealing out. Shingles are hashed into more than d groups; a differing shingle spoils one group, so some group holds the same shingles in both sets. A key is
   (size class, group, hash of the group's shingles); sets near the top of a class go into the next one too. Only groups of enough shingles count: as many
   as leave more full groups than can be spoiled. A set with too few groups of any content is searched apart (hard). Sets that share a key are joined to the key's smallest node; the components of that
   graph are clusters, and every link lies inside one. A task joins what it has itself, FLUSH keys at a time, and sends each key once, so a key of very
   many sets has few rows in the shuffle.
2. R-tree. A cluster's sets are sorted by size and cut into blocks of bounded size, the upper boxes of the tree; inside a block, leaves hold LEAF sets. A set is a point:
   its shingles counted in GROUPS hash groups. The summed minima of two points (of a point and the largest counts of a box) bound the overlap; pairs that can
   reach the needed overlap are verified on the sets themselves, unless already connected.
3. Blocks of one cluster. Some members of every part of a block meet in blocks of their own, level by level, which connects a large group in steps
   linear in its size. Then only blocks that are not wholly in their cluster's largest component are held against the other blocks of the cluster. For that
   a cluster's blocks, by size, are cut into chunks of bounded bytes; two chunks that can hold linked sets are a tile, and a task holds one chunk of a tile at a time.

Links are a forest of verified pairs: every link between different texts is implied by the components, no pairs of a large group are listed.

Words are split at white space, A-Z lowered. A null text or one without words has the empty set and is linked with nothing. Null ids: a row without id takes
part, and its component is the smallest id of the others (null if there is none). Rows with one id and different texts count each. Ties have no effect.
An empty table gives no rows. Further columns are left out by ``join`` and kept by ``keep_one``. Hashes have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import Memo, mix, shingles, slices, small_batches, table, texts, tidy
from flowsieve.session import durable

GROUPS = 64
LEAF = 16
BLOCK_ROWS, BLOCK_BYTES = 256, 4_000_000
CLASS_RATIO = 1.5
DELEGATES = 8
BROADCAST_IDS = 1_000_000
HARD_BLOCK = 2000
# Of a cluster's blocks in one chunk, with SET_BYTES for each set's counts; and the parts a smaller cluster is cut into, so that its tiles spread.
CHUNK_BYTES, SET_BYTES, CHUNKS = 16_000_000, 1_200, 12
FLUSH = 500_000
CONST = np.uint64(0x9E3779B97F4A7C15)


class Rule:
    """Sets are linked if ``den`` * overlap >= ``num`` * union; shingles are ``width`` words."""

    def __init__(self, num: int = 90, den: int = 100, width: int = 3):
        self.num, self.den, self.width = num, den, width

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def needed(self, a, b):
        """Least overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def differ(self, size: int) -> int:
        """Most shingles in which a linked set can differ, if this size is the smaller."""
        return size * (self.den - self.num) // self.num

    def schemes(self, size: int) -> list[int]:
        own = max(0, int(math.log(size) / math.log(CLASS_RATIO)))
        while CLASS_RATIO**own > size:
            own -= 1
        while CLASS_RATIO ** (own + 1) <= size:
            own += 1
        return [own, own + 1] if size * self.den >= self.num * CLASS_RATIO ** (own + 1) - 1 else [own]

    def groups(self, scheme: int) -> tuple[int, int]:
        """Number of groups and the shingles of one that counts, to begin with."""
        return _groups(self.num, self.den, scheme)


@lru_cache(maxsize=None)
def _groups(num: int, den: int, scheme: int) -> tuple[int, int]:
    top = CLASS_RATIO ** (scheme + 1)
    spoiled = (den - num) / num
    m, least = math.ceil(1.1 * top * spoiled) + (3 if top < 200 else 5), 1 if top < 60 else 2 if top < 200 else 3
    if spoiled < 0.112:
        return m, least
    # At shares under 0.9 so few groups are not full often enough: more of them, and of fewer shingles each. The smallest sets of a class come from under it.
    sizes = [share * top for share in (1, 0.9, 0.8, 0.7, 0.6, num / den / CLASS_RATIO)]
    for fewer in range(least, 0, -1):
        for load in np.arange(8, 0.4, -0.1):
            if all(full(n / top * load, fewer) / (n / top * load) > 1.1 * spoiled for n in sizes):
                return math.ceil(top / load) + (100 if top < 8 else 30 if top < 20 else 8), fewer
    return math.ceil(2 * top) + 8, 1


def full(load: float, least: int) -> float:
    """Share of groups with ``least`` shingles or more, if each has ``load`` on average."""
    return 1 - math.exp(-load) * sum(load**k / math.factorial(k) for k in range(least))


def keys_of(s: np.ndarray, rule: Rule) -> tuple[np.ndarray, bool]:
    """Keys of a set, and whether it has too few of them for some scheme. Sets that can differ in nothing need none."""
    if rule.differ(len(s)) < 1:
        # A linked set of another size would have to be larger, and differ in one shingle at least.
        if rule.differ(len(s) + 1) < 1 or not rule.linked(len(s), len(s), len(s) + 1):
            return np.empty(0, np.uint64), False
    out, hard = [], False
    h = mix(s + CONST)
    for scheme in rule.schemes(len(s)):
        m, least = rule.groups(scheme)
        group = (h % np.uint64(m)).astype(np.uint16 if m < 65536 else np.int64)
        order = np.argsort(group, kind="stable")
        dealt = group[order]
        start = np.concatenate([[0], np.flatnonzero(dealt[1:] != dealt[:-1]) + 1])
        where, load = dealt[start], np.diff(start, append=len(dealt))
        sums = np.add.reduceat(h[order] * MULTIPLIER, start)
        # If either of two linked sets has more full groups than can be spoiled, one of these is whole in both. A set without enough counts smaller groups
        # too, and so still has the keys of a set that need not.
        while least > 1 and int((load >= least).sum()) <= rule.differ(len(s)):
            least -= 1
        use = load >= least
        hard |= int(use.sum()) <= rule.differ(len(s))
        out.append(mix(sums[use] + where[use].astype(np.uint64) * CONST + np.uint64(scheme << 40) + load[use].astype(np.uint64)))
    return np.concatenate(out), hard


MULTIPLIER = np.uint64(0xD1B54A32D192ED03)
_memo = Memo()


def forget() -> None:
    _memo.clear()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return shingles((text or "").encode("utf-8", "replace").lower().split(), width, _memo)


def node_of(s: np.ndarray) -> int | None:
    """Number of a set: a hash of all its shingles."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(s ^ MULTIPLIER)) + np.bitwise_xor.reduce(mix(s + MULTIPLIER)) * CONST + np.uint64(len(s))
    return int(mix(np.array([total]))[0].astype(np.int64))


def _signatures(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, rule.width) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())], ["doc_id", "n_shingles", "node"])

    return run


def _keys(rule: Rule):
    """Rows (key, node, null), each key once in FLUSH keys; rows (any key, node, other) for sets that met in the task, and (any key, node, node) for hard sets."""

    def joined(keys: list[np.ndarray], nodes: list[int], hard: list[int]) -> pa.RecordBatch:
        key, node = np.concatenate([*keys, np.empty(0, np.uint64)]), np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        pivot = node[first][np.cumsum(first) - 1] if len(key) else node
        met = ~first & (pivot != node)
        pairs = np.unique(np.stack([node[met], pivot[met]], axis=1), axis=0) if met.any() else np.empty((0, 2), np.int64)
        pairs = np.concatenate([pairs, np.repeat(np.array(hard, np.int64)[:, None], 2, axis=1)])
        spread = mix(pairs[:, 0].astype(np.uint64) + mix(pairs[:, 1].astype(np.uint64))).astype(np.int64)
        other = pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(pairs[:, 1])])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[first].astype(np.int64), spread])), pa.array(np.concatenate([node[first], pairs[:, 0]])), other], ["key", "node", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        keys, nodes, hard, held = [], [], [], 0
        for batch in slices(batches, "text"):
            for t in texts(batch):
                s = shingle_set(t, rule.width)
                node = node_of(s)
                if node is None or node in seen:
                    continue
                seen.add(node)
                own, odd = keys_of(s, rule)
                keys.append(own)
                nodes.append(node)
                held += len(own)
                if odd:
                    hard.append(node)
            if held >= FLUSH:
                yield joined(keys, nodes, hard)
                keys, nodes, hard, held = [], [], [], 0
                if len(seen) > FLUSH:
                    seen.clear()
        yield joined(keys, nodes, hard)

    return run


# --- components ---------------------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected with), for all nodes of the edges (a, b). Large and small stars in turn."""
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = durable(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).head())
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- the tree -------------------------------------------------------------------------------------------------------------------------


def point(s: np.ndarray) -> np.ndarray:
    return np.bincount((mix(s + np.uint64(77)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)


class Forest:
    """Union-find over positions."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(labels)]

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        self.up[self.root(b)] = self.root(a)


class Tree:
    """Leaves of LEAF points in order of size; a leaf's box is its largest counts and its range of sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
        self.sizes = np.array([len(sets[k]) for k in self.order])
        self.points = np.stack([point(sets[k]) for k in self.order])
        edges = np.arange(0, len(sets), LEAF)
        self.boxes, self.small, self.large = np.maximum.reduceat(self.points, edges, axis=0), self.sizes[edges], self.sizes[np.minimum(edges + LEAF, len(sets)) - 1]

    def reach(self, p: np.ndarray, size: int, rule: Rule) -> np.ndarray:
        """Positions (in the order given) whose overlap with the point may be enough, the most promising first."""
        bound = np.minimum(np.minimum(self.boxes, p).sum(1), np.minimum(size, self.large))
        leaves = np.flatnonzero(bound >= rule.needed(size, self.small))
        if not len(leaves):
            return leaves
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        overlap = np.minimum(np.minimum(self.points[at], p).sum(1), np.minimum(size, self.sizes[at]))
        spare = overlap - rule.needed(size, self.sizes[at])
        at, spare = at[spare >= 0], spare[spare >= 0]
        return np.array([self.order[k] for k in at[np.argsort(-spare, kind="stable")]], np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def link(sets: list[np.ndarray], labels: list, rule: Rule, split: int | None = None, tree: Tree | None = None, points: list[np.ndarray] | None = None) -> tuple[list[tuple[int, int]], Forest]:
    """Verified pairs that connect what has different labels so far. With ``split``, only pairs of one before and one after that position. ``tree`` (of the
    sets after it) and ``points`` (of those before) may be given, if they are used again."""
    forest, pairs = Forest(labels), []
    left = range(split if split is not None else len(sets))
    right = range(split or 0, len(sets))
    tree = tree or Tree([sets[k] for k in right])
    for i in left:
        for j in (tree.reach(points[i] if points else point(sets[i]), len(sets[i]), rule) + right.start).tolist():
            if j == i or forest.root(i) == forest.root(j):
                continue
            if rule.linked(overlap(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                forest.join(i, j)
                pairs.append((i, j))
    return pairs, forest


BLOCK_SCHEMA = "kind int, cluster long, block long, a long, b long, nodes array<bigint>, sizes array<bigint>, sets binary, part array<bigint>"


def _row(**values) -> dict:
    return {c.split()[0]: None for c in BLOCK_SCHEMA.split(", ")} | values


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [c.split() for c in BLOCK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def _blocks(rule: Rule):
    """Rows (cluster, node, set) in order of cluster: links inside blocks (kind 0), and blocks (kind 1) of clusters that may have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        cluster, size, first, closed = None, 0, True, 0

        def close(more: bool) -> Iterator[pa.RecordBatch]:
            nodes, sets = [n for n, _ in held], [s for _, s in held]
            pairs, forest = link(sets, nodes, rule)
            rows = [_row(kind=0, a=nodes[i], b=nodes[j]) for i, j in pairs]
            if more or first or closed:
                rows.append(_row(kind=1, cluster=cluster, block=nodes[0], nodes=nodes, sizes=[len(s) for s in sets], sets=np.concatenate(sets).tobytes(), part=[nodes[forest.root(k)] for k in range(len(nodes))]))
            for k in range(0, len(rows), 2000):
                yield _batch(rows[k : k + 2000])

        for batch in slices(batches, "set"):
            for c, node, data in zip(*(batch.column(n).to_pylist() for n in ("cluster", "node", "set"))):
                full = len(held) >= BLOCK_ROWS or size + len(data) > BLOCK_BYTES
                if held and (c != cluster or full):
                    yield from close(c == cluster)
                    closed = closed + 1 if c == cluster else 0
                    first &= c == cluster
                    held, size = [], 0
                cluster = c
                held.append((node, np.frombuffer(data, np.uint64)))
                size += len(data)
        if held:
            yield from close(True)

    return run


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one: a block is a wide row, and a copy of all in a batch would stand beside it."""
    for k in range(len(batch)):
        yield batch.slice(k, 1).to_pylist()[0]


def _delegates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to DELEGATES members of every part of a block, evenly over its sizes."""
    for batch in batches:
        for row in rows_of(batch):
            parts: dict = {}
            for k, p in enumerate(row["part"]):
                parts.setdefault(p, []).append(k)
            at = np.concatenate([[0], np.cumsum(row["sizes"])]) * 8
            picked = sorted({own[round(j * (len(own) - 1) / max(DELEGATES - 1, 1))] for own in parts.values() for j in range(DELEGATES)})
            yield pa.RecordBatch.from_arrays([pa.array([row["cluster"]] * len(picked), pa.int64()), pa.array([row["nodes"][k] for k in picked], pa.int64()), pa.array([len(row["sets"][at[k] : at[k + 1]]) for k in picked], pa.int64()), pa.array([row["sets"][at[k] : at[k + 1]] for k in picked], pa.binary())], ["cluster", "node", "size", "set"])


class Block:
    """A block of one side of a tile; its tree and points are made when they are first asked for."""

    def __init__(self, row: dict):
        at, body = np.concatenate([[0], np.cumsum(row["sizes"])]), np.frombuffer(row["sets"], np.uint64)
        self.sets = [body[at[k] : at[k + 1]] for k in range(len(at) - 1)]
        self.nodes, self.roots, self.open, self.low, self.high = (row[c] for c in ("nodes", "roots", "open", "low", "high"))

    @cached_property
    def tree(self) -> Tree:
        return Tree(self.sets)

    @cached_property
    def points(self) -> list[np.ndarray]:
        return [point(s) for s in self.sets]

    def links(self, other: Block, rule: Rule) -> list[tuple[int, int]]:
        """Links between the blocks. Of two blocks one at least is open; sizes too far apart never link."""
        if not (self.open or other.open) or self.low * rule.num > other.high * rule.den or other.low * rule.num > self.high * rule.den:
            return []
        pairs, _ = link(self.sets + other.sets, self.roots + other.roots, rule, len(self.sets), other.tree, self.points)
        return [(self.nodes[i], other.nodes[j - len(self.sets)]) for i, j in pairs]


def _cross(rule: Rule):
    """Blocks in order of tile and side: those of side 0 are held, those of side 1 meet them and go. In a tile of a chunk with itself all are of side 0, and each meets those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            for row in rows_of(batch):
                here = (row["cluster"], row["i"], row["j"])
                if here != tile:
                    tile, held = here, []
                block = Block(row)
                if row["side"] or row["i"] == row["j"]:
                    pairs = [p for other in held for p in block.links(other, rule)]
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["a", "b"])
                if not row["side"]:
                    held.append(block)

    return run


def _tiles(blocks: DataFrame, rule: Rule) -> DataFrame:
    """The rows of ``blocks`` once for every tile and side they have a part in: cluster, i, j, side and the block."""
    order, whole = Window.partitionBy("cluster").orderBy("low", "block"), Window.partitionBy("cluster")
    bytes_ = (F.length("sets") + SET_BYTES * F.size("nodes")).cast("long")
    step = F.least(F.lit(CHUNK_BYTES), F.greatest(F.lit(CHUNK_BYTES // 16), F.sum("bytes").over(whole) / CHUNKS))
    before = F.sum("bytes").over(order) - F.col("bytes")
    chunk = blocks.select("cluster", "block", "open", "low", "high", bytes_.alias("bytes")).withColumn("chunk", F.floor(before / step).cast("long"))
    chunk = durable(chunk, "chunks")
    ends = chunk.groupBy("cluster", "chunk").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("open").alias("open"))
    x, y = ends.alias("x"), ends.alias("y")
    fits = (F.col("x.low") * rule.num <= F.col("y.high") * rule.den) & (F.col("y.low") * rule.num <= F.col("x.high") * rule.den)
    tiles = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.chunk") <= F.col("y.chunk")) & (F.col("x.open") | F.col("y.open")) & fits)
    tiles = durable(tiles.select(F.col("x.cluster").alias("cluster"), F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j")), "tiles")
    sides = tiles.select("cluster", F.col("i").alias("chunk"), "i", "j", F.lit(0).alias("side")).unionByName(tiles.where("i < j").select("cluster", F.col("j").alias("chunk"), "i", "j", F.lit(1).alias("side")))
    # The wide rows are the right side, of which a join holds the rows of one key.
    return sides.join(chunk.select("cluster", "chunk", "block"), ["cluster", "chunk"]).drop("chunk").join(blocks, ["cluster", "block"])


def _range_blocks(points: DataFrame, rule: Rule, tag: str) -> DataFrame:
    """Blocks of points in order of cluster and size; written once, since ranges are drawn anew in every job."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(points.repartitionByRange(parts, "cluster", "size", "node").sortWithinPartitions("cluster", "size", "node").select("cluster", "node", "set").mapInArrow(tidy(_blocks(rule)), BLOCK_SCHEMA), tag, wide=True)


def verified_links(points: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame | None]:
    """A forest of verified links (a, b) with the same components as all links between points (cluster, node, size, set) of one cluster, and the components
    where they are known already."""
    base = _range_blocks(points, rule, "blocks")
    links = base.where("kind = 0").select("a", "b")
    several = lambda df: df.where("kind = 1").join(df.where("kind = 1").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster"), "cluster")
    many = several(base)
    if many.isEmpty():
        return links, None
    level = many
    while not level.isEmpty():
        delegates = level.select("cluster", "nodes", "sizes", "sets", "part").mapInArrow(tidy(_delegates), "cluster long, node long, size long, set binary")
        rows = level.select(F.sum(F.size("nodes"))).head()[0]
        upper = _range_blocks(delegates, rule, "delegates")
        links = links.unionByName(upper.where("kind = 0").select("a", "b"))
        level = several(upper)
        if (level.select(F.sum(F.size("nodes"))).head()[0] or 0) > 0.7 * rows:
            break  # parts too many to thin out; the comparison of blocks below does the rest
    roots = components(links)
    members = many.select("cluster", "block", F.posexplode("nodes").alias("pos", "node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = durable(members, "members")
    by_root = members.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    main = by_root.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    labelled = members.groupBy("cluster", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "root"))).alias("r"))
    blocks = many.join(labelled, ["cluster", "block"]).join(main, "cluster").select("cluster", "block", "nodes", "sizes", "sets", F.col("r.root").alias("roots"), F.exists("r.root", lambda x: x != F.col("main")).alias("open"), F.array_min("sizes").alias("low"), F.array_max("sizes").alias("high"))
    blocks = durable(blocks, "labelled", wide=True)
    tiles = _tiles(blocks, rule).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "block")
    cross = durable(tiles.select("cluster", "i", "j", "side", "nodes", "sizes", "sets", "roots", "open", "low", "high").mapInArrow(tidy(_cross(rule)), "a long, b long"), "cross")
    return links.unionByName(cross), roots if cross.isEmpty() else None


# --- the whole join --------------------------------------------------------------------------------------------------------------------


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, node, cluster in zip(texts(batch), batch.column("node").to_pylist(), batch.column("cluster").to_pylist()):
                s = shingle_set(text, rule.width)
                if node_of(s) == node:  # else another text under the same id
                    rows.append((cluster, node, len(s), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["cluster", "node", "size", "set"])

    return run


def _hard_links(docs: DataFrame, signed: DataFrame, hard: DataFrame, rule: Rule) -> DataFrame | None:
    """Links of the sets that the keys cannot vouch for, against all sets, HARD_BLOCK at a time."""
    hard = signed.join(hard, "node").groupBy("node").agg(F.min(F.struct("doc_id")).alias("d")).select("node", "d.doc_id")
    ids = [r[0] for r in hard.select("node").orderBy("node").toLocalIterator()]
    out = None
    for k in range(0, len(ids), HARD_BLOCK):
        part = hard.where(F.col("node").between(ids[k], ids[min(k + HARD_BLOCK, len(ids)) - 1]))
        sets = docs.join(F.broadcast(part.withColumn("cluster", F.lit(0).cast("long"))), docs["doc_id"].eqNullSafe(part["doc_id"])).select("text", "node", "cluster").mapInArrow(_sets(rule), "cluster long, node long, size long, set binary").dropDuplicates(["node"])
        shared = docs.sparkSession.sparkContext.broadcast([(r["node"], np.frombuffer(r["set"], np.uint64)) for r in sets.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            nodes, tree, bodies = [n for n, _ in shared.value], Tree([s for _, s in shared.value]), [s for _, s in shared.value]
            for batch in slices(batches, "text"):
                pairs = []
                for text in texts(batch):
                    s = shingle_set(text, rule.width)
                    node = node_of(s)
                    if node is not None:
                        pairs += [(node, nodes[j]) for j in tree.reach(point(s), len(s), rule).tolist() if nodes[j] != node and rule.linked(overlap(s, bodies[j]), len(s), len(bodies[j]))]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["a", "b"])

        found = docs.select("text").mapInArrow(run, "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


def grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, node, grp: rows with one ``grp`` are connected; null for empty sets."""
    with small_batches(docs.sparkSession):
        return _grouped(docs, rule)


def _grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = durable(docs.mapInArrow(tidy(_signatures(rule), forget), f"doc_id {kind}, n_shingles long, node long"), "signed")
    keys = docs.select("text").mapInArrow(tidy(_keys(rule), forget), "key long, node long, other long")
    pivot = F.min(F.when(F.col("other").isNull(), F.col("node"))).over(Window.partitionBy("key"))
    stars = keys.select("node", F.coalesce("other", pivot).alias("b"), F.col("other").isNotNull().alias("sent")).where("node <> b OR sent").select(F.col("node").alias("a"), "b").distinct()
    stars = durable(stars, "stars")
    hard = stars.where("a = b").select(F.col("a").alias("node"))
    clusters = durable(components(stars).select("node", F.col("root").alias("cluster")), "clusters")
    chosen = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id")).alias("d")).join(clusters, "node").select("node", F.col("d.doc_id").alias("doc_id"), "cluster")
    chosen = durable(chosen, "chosen")
    # A row without id is found by a null-safe join; few ids go to every task, more are met in a shuffle.
    few = chosen.count() <= BROADCAST_IDS
    near = docs.join(F.broadcast(chosen) if few else chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"])).select("text", "node", "cluster")
    points = near.mapInArrow(tidy(_sets(rule), forget), "cluster long, node long, size long, set binary")
    if signed.groupBy("doc_id").agg(F.count_distinct("node").alias("n")).where("n > 1").isEmpty() is False:
        points = points.dropDuplicates(["node"])
    links, roots = verified_links(points, rule)
    more = _hard_links(docs, signed, hard, rule)
    if roots is None or more is not None:
        roots = components(links if more is None else links.unionByName(more))
    return signed.join(roots, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("grp"))


def join(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    rows = durable(grouped(docs, rule or Rule()), "grouped")
    least = rows.where("grp IS NOT NULL").groupBy("grp").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "grp", "left").select("doc_id", "n_shingles", F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _with_node(rule: Rule):
    """Appends the number of the first column's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            nodes = [node_of(shingle_set(t, rule.width)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(nodes, pa.int64())], [*batch.schema.names[1:], "node"])

    return run


def keep_one(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row of each component: that with the smallest id, a row without id only if there is no other; and all rows with empty sets.

    Rows that share an id, or have none, are told apart by their sets, and exact repeats of a row by a count: one of them stays.
    """
    rule = rule or Rule()
    names = docs.columns
    rows = durable(grouped(docs, rule), "grouped")
    best = rows.where("grp IS NOT NULL").groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("b")).select("b.doc_id", "b.node")
    best = durable(best, "best")
    unclear = durable(rows.groupBy(F.col("doc_id").alias("unclear_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR unclear_id IS NULL").select("unclear_id"), "unclear")
    many = unclear.count()
    inner = docs.toDF(*["doc_id" if c == "doc_id" else f"c{k}" for k, c in enumerate(names)])
    first = best.select(F.col("doc_id").alias("kept_id")).unionAll(rows.where("grp IS NULL").select("doc_id"))
    if not many:
        return inner.join(first, inner["doc_id"] == first["kept_id"], "left_semi").toDF(*names)
    few = F.broadcast(unclear) if many <= BROADCAST_IDS else unclear
    same = inner["doc_id"].eqNullSafe(few["unclear_id"])
    plain = inner.join(few, same, "left_anti").join(first, inner["doc_id"] == first["kept_id"], "left_semi")
    doubtful = inner.join(few, same, "left_semi")
    text = doubtful[doubtful.columns[names.index("text")]]
    noded = doubtful.select(text.alias("text"), *[doubtful[c].alias(f"d{k}") for k, c in enumerate(doubtful.columns)])
    noded = noded.mapInArrow(tidy(_with_node(rule), forget), ", ".join(f"d{k} {f.dataType.simpleString()}" for k, f in enumerate(doubtful.schema.fields)) + ", node long")
    at = f"d{names.index('doc_id')}"
    chosen = noded.join(best.withColumnRenamed("doc_id", "kept_id").withColumnRenamed("node", "kept_node"), noded[at].eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node")), "left_semi")
    once = chosen.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64(*[c for c in chosen.columns if c != "node"])))).where("place = 1").drop("place")
    again = once.unionByName(noded.where("node IS NULL")).drop("node")
    return plain.toDF(*names).unionAll(again.toDF(*names))


NEAR_COPIES = Rule(80, 100, 5)


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return join(table(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies. No contract binds the stage, so the general rule holds: 0.8 of the shingles of five words, not that of ``op5``."""
    del spark, folder
    return keep_one(docs, NEAR_COPIES)
