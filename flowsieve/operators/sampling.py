"""Seeded samples and folds.

Random order is the md5 of ``seed:id``. A sample of m rows is "all rows up to the m-th smallest
hash": the hash is found by counting, and the rows are then picked by a filter, with no sort.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import col
from flowsieve.functions.hashing import HASH_BITS, order_key
from flowsieve.operators.prefix import totals_before

STEP_BITS = 12
FETCH_ROWS = 50_000
FOLD_ROWS = 20_000


def hash_cuts(df: DataFrame, group: str, key: str, wanted: dict[object, Iterable[int]]) -> dict[tuple[object, int], int]:
    """The r-th smallest ``key`` of a group, for each wanted rank r (from 1).

    Counts per hash prefix narrow each rank down, 12 bits a pass, until few enough rows are left.
    Both the counts and the rows fetched are bounded by the number of ranks, not by the table.
    """
    out: dict[tuple[object, int], int] = {}
    # (group, prefix of the level above) -> [(rank asked for, rank within that prefix)]
    open_ranks: dict[tuple[object, int], list[tuple[int, int]]] = {}
    for g, ranks in wanted.items():
        asked = [(r, r) for r in sorted(set(ranks)) if r > 0]
        if asked:
            open_ranks[(g, 0)] = asked
    level = 0
    rows = df.select(col(group).alias("g"), col(key).alias("h"))
    while open_ranks:
        shift = HASH_BITS - STEP_BITS * (level + 1)
        part = _only(rows, open_ranks, shift + STEP_BITS)
        counts = part.groupBy("g", F.shiftright("h", shift).alias("p")).count().collect()
        deeper: dict[tuple[object, int], list[tuple[int, int]]] = {}
        left = 0
        by_parent: dict[tuple[object, int], list[tuple[int, int]]] = {}
        for r in counts:
            by_parent.setdefault((r["g"], r["p"] >> STEP_BITS), []).append((r["p"], r["count"]))
        for parent, asked in open_ranks.items():
            seen, todo = 0, list(asked)
            for prefix, n in sorted(by_parent.get(parent, [])):
                inside = [(full, r - seen) for full, r in todo if r - seen <= n]
                if inside:
                    deeper[(parent[0], prefix)] = inside
                    left += n
                    todo = todo[len(inside):]
                seen += n
                if not todo:
                    break
            if todo:
                raise ValueError(f"Group {parent[0]!r} has too few rows for rank {todo[0][0]}.")
        if left <= FETCH_ROWS or shift == 0:
            found: dict[tuple[object, int], list[int]] = {}
            for r in _only(rows, deeper, shift).withColumn("p", F.shiftright("h", shift)).collect():
                found.setdefault((r["g"], r["p"]), []).append(r["h"])
            for (g, prefix), asked in deeper.items():
                keys = sorted(found[(g, prefix)])
                for full, r in asked:
                    out[(g, full)] = keys[r - 1]
            return out
        open_ranks, level = deeper, level + 1
    return out


def _only(rows: DataFrame, ranks: dict[tuple[object, int], list], shift: int) -> DataFrame:
    """Rows under the wanted (group, prefix) pairs; there are at most as many pairs as ranks."""
    if shift >= HASH_BITS:
        return rows.where(F.col("g").isin(*{g for g, _ in ranks}))
    pairs = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(p).cast("bigint").alias("p")) for g, p in ranks])
    wanted = rows.sparkSession.range(1).select(F.inline(pairs))
    marked = rows.withColumn("p", F.shiftright("h", shift))
    return marked.join(F.broadcast(wanted), ["g", "p"], "left_semi").select("g", "h")


def up_to_cut(group: Column, key: Column, cuts: dict[object, int]) -> Column:
    """True for rows of a group at or under the group's cut; groups without a cut get false."""
    test = F.lit(False)
    for g, cut in cuts.items():
        test = test | ((group == F.lit(g)) & (key <= F.lit(cut)))
    return test


MAX_CLASSES = 1000


def class_sizes(df: DataFrame, label: str) -> dict[object, int]:
    """Rows per class. More than MAX_CLASSES distinct values are no label column, and an error."""
    found = df.where(col(label).isNotNull()).groupBy(col(label)).count().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"'{label}' has more than {MAX_CLASSES} distinct values; name a column of classes.")
    return {r[0]: r[1] for r in found}


def balanced_sample(df: DataFrame, label: str, id_col: str, rows_per_class: int, seed: int = 42) -> DataFrame:
    """min(rows_per_class, class size) rows of each class. Order the sink by ``order_key`` for a shuffled file."""
    keyed = df.withColumn("_key", order_key(seed, col(id_col)))
    sizes = class_sizes(df, label)
    wanted = {c: [min(rows_per_class, n)] for c, n in sizes.items()}
    cuts = hash_cuts(keyed, label, "_key", wanted)
    return keyed.where(up_to_cut(col(label), F.col("_key"), {g: cut for (g, _), cut in cuts.items()})).drop("_key")


def with_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Stratified folds 0..k-1: position in the class by seeded hash, modulo k.

    Positions come from counts per hash range, some FOLD_ROWS rows each, and a rank inside the range, so no class is ever sorted as a whole.
    """
    keyed = df.withColumn("_key", order_key(seed, col(id_col)))
    rows = df.count()
    bits = max(5, (rows // FOLD_ROWS).bit_length())
    keyed = keyed.withColumn("_range", F.shiftright("_key", HASH_BITS - bits))
    counted = keyed.groupBy(col(label).alias("_label"), F.col("_range").alias("_at")).count()
    starts = totals_before(counted, ["_label"], "_at", "count", 1 << bits, "_start").drop("count")
    inside = Window.partitionBy(col(label), F.col("_range")).orderBy("_key", col(id_col))
    # Null-safe, so that rows without a label keep their place as a class of their own.
    same = col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_at"))
    placed = keyed.withColumn("_rank", F.row_number().over(inside)).join(starts, same)
    fold = F.pmod(F.col("_start") + F.col("_rank") - 1, F.lit(k)).cast("int")
    return placed.select(*[col(c) for c in df.columns], fold.alias(name))


def subset_ranks(size: int, fraction: float) -> int:
    return min(size, max(4, round(fraction * size)))


def subset_cuts(df: DataFrame, group: str, label: str, key: str, sizes: dict[object, list[int]]) -> dict[tuple[object, int], dict[int, int]]:
    """Per (group, size) and class the hash up to which rows belong to the labelled subset.

    A subset is the first ``size`` rows of its group. If one class is missing there, the class's
    first row takes the place of the last row.
    """
    overall = hash_cuts(df, group, key, {g: {s for n in ns for s in (n, n - 1)} for g, ns in sizes.items()})
    firsts = {
        (r["g"], r["c"]): r["h"]
        for r in df.groupBy(col(group).alias("g"), col(label).alias("c")).agg(F.min(col(key)).alias("h")).collect()
    }
    out = {}
    for g, ns in sizes.items():
        for n in ns:
            cut = overall[(g, n)]
            cuts = {c: cut for c in (0, 1)}
            missing = [c for c in (0, 1) if (g, c) in firsts and firsts[(g, c)] > cut]
            if missing and n > 1:
                cuts[1 - missing[0]] = overall[(g, n - 1)]
                cuts[missing[0]] = firsts[(g, missing[0])]
            out[(g, n)] = cuts
    return out


def labeled_subset(df: DataFrame, label: str, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """max(4, round(fraction * n)) rows that hold both classes."""
    keyed = df.withColumn("_key", order_key(seed, col(id_col))).withColumn("_all", F.lit(0))
    size = subset_ranks(df.count(), fraction)
    cuts = subset_cuts(keyed, "_all", label, "_key", {0: [size]})[(0, size)]
    return keyed.where(up_to_cut(col(label), F.col("_key"), cuts)).drop("_key", "_all")


def seed_labels(df: DataFrame, label: str, id_col: str, seed_size: int = 10, seed: int = 42) -> DataFrame:
    """min(seed_size // 2, class sizes) rows of each class; an error if a class is absent."""
    sizes = class_sizes(df, label)
    if not sizes.get(0) or not sizes.get(1):
        raise ValueError("Seed labels need at least one row of each class.")
    take = min(seed_size // 2, sizes[0], sizes[1])
    keyed = df.withColumn("_key", order_key(seed, col(id_col)))
    cuts = hash_cuts(keyed, label, "_key", {0: [take], 1: [take]})
    return keyed.where(up_to_cut(col(label), F.col("_key"), {g: cut for (g, _), cut in cuts.items()})).drop("_key")


def uncertain_queries(df: DataFrame, probability: str, id_col: str, n: int) -> DataFrame:
    """The n rows whose probability is nearest to 0.5; the smaller id wins a tie."""
    return df.orderBy(F.abs(col(probability) - 0.5), col(id_col)).limit(n)


def random_queries(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, or the whole pool if it is smaller."""
    return df.withColumn("_key", order_key(seed, col(id_col))).orderBy("_key", col(id_col)).limit(n).drop("_key")
