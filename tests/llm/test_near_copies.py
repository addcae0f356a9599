import numpy as np
import pyarrow as pa

from flowsieve.llm import jaccard as J
from flowsieve.llm.common import ARROW_BYTES, small_batches
from test_jaccard import families, plain

FOLDER = "/root/testdata/sf0.001"
GENERAL = J.Rule(80, 100, 5)


def kept(spark, docs):
    return sorted(r.doc_id for r in J.stage(spark, docs, FOLDER).select("doc_id").collect())


def test_stage_follows_the_general_rule(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept(spark, docs) == sorted(d for d, _, c in plain(rows, GENERAL) if d == c)
    rows = [(k, text) for k, (_, text) in enumerate(families(6))]
    assert kept(spark, spark.createDataFrame(rows, "doc_id long, text string")) == sorted(d for d, _, c in plain(rows, GENERAL) if d == c)


def test_few_sets_are_hard_at_the_general_rule():
    rng = np.random.default_rng(1)
    for size in [4, 5, 8, 10, 14, 20, 40, 90, 300, 900, 3000]:
        for _ in range(40):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            drop = rng.integers(0, GENERAL.differ(size) + 1)
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, GENERAL.differ(size) - drop).astype(np.uint64)])
            (ka, ha), (kb, hb) = J.keys_of(np.sort(a), GENERAL), J.keys_of(np.sort(b), GENERAL)
            assert not ha and not hb
            assert not GENERAL.linked(len(np.intersect1d(a, b)), len(a), len(b)) or len(np.intersect1d(ka, kb))


def test_repeats_null_ids_and_shared_ids_are_decided_row_by_row(spark):
    long = [f"word{k}" for k in range(60)]
    near = " ".join([*long[:-1], "other"])
    a, b, c = " ".join(long), " ".join(long[::-1]), " ".join(f"z{k}" for k in range(40))
    rows = [(1, a), (1, a), (2, near), (None, near), (None, c), (None, c), (3, b), (3, c), (3, c), (4, ""), (4, ""), (None, None), (5, b)]
    # Columns named like the operator's own.
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node string, kept_id int")
    out = J.stage(spark, df, FOLDER)
    assert out.columns == df.columns
    got = sorted((repr(r.doc_id), r.text) for r in out.collect())
    assert got == sorted((repr(i), t) for i, t in [(1, a), (3, b), (3, c), (4, ""), (4, ""), (None, None)])


def test_very_long_text(spark):
    text = " ".join(f"w{k % 7919}x{k % 31}" for k in range(150_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "something else entirely here")], "doc_id long, text string")
    assert kept(spark, df) == [1, 3]


def test_wide_rows_reach_python_in_small_batches(spark, monkeypatch):
    before, during, components = spark.conf.get(ARROW_BYTES), [], J.components

    def watched(edges):
        during.append(spark.conf.get(ARROW_BYTES))
        return components(edges)

    monkeypatch.setattr(J, "components", watched)
    J.grouped(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"), GENERAL).count()
    assert during and all(size == "8000000" for size in during)
    assert spark.conf.get(ARROW_BYTES) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    # 400 blocks of 64 KB. Sizes are looked at as a batch grows, so the last row may pass the limit.
    blocks = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 65536) AS body")
    with small_batches(spark):
        assert max(r.n for r in blocks.mapInArrow(sizes, "n long").collect()) <= 8_200_000


def test_blocks_of_one_cluster_meet_in_tiles_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK_BYTES", 16 * 4000)
    rng = np.random.default_rng(3)
    blocks = []
    for k in range(60):
        low = 20 + 2 * k
        sets = [np.sort(rng.integers(0, 2**63, low + j % 3).astype(np.uint64)) for j in range(4)]
        if k % 5 == 4:  # linked with the block before
            sets[0] = np.sort(np.append(blocks[-1][6][0], rng.integers(0, 2**63, low - len(blocks[-1][6][0])).astype(np.uint64)))
        nodes = [10 * k + j for j in range(4)]
        blocks.append((7, nodes[0], nodes, nodes, k % 7 != 0, [len(s) for s in sets], sets))
    rows = [(c, b, n, s, np.concatenate(x).tobytes(), r, o, min(s), max(s)) for c, b, n, r, o, s, x in blocks]
    df = spark.createDataFrame(rows, "cluster long, block long, nodes array<bigint>, sizes array<bigint>, sets binary, roots array<bigint>, open boolean, low long, high long")
    tiles = J._tiles(df, GENERAL)
    at = {}
    for r in tiles.select("i", "j", "side", "block", "sets").collect():
        at.setdefault((r.i, r.j), {}).setdefault(r.side, []).append(r)
    assert len(at) > 12 and max(sum(len(r.sets) for r in sides[0]) for sides in at.values()) < 24_000 < sum(len(r[4]) for r in rows)
    # Every two blocks of fitting sizes, one of them open, meet in one tile.
    met = [tuple(sorted((a.block, b.block))) for (i, j), s in at.items() for a in s[0] for b in (s[0] if i == j else s.get(1, [])) if i < j or a.block < b.block]
    assert len(met) == len(set(met))
    fit = {tuple(sorted((a[1], b[1]))) for a in rows for b in rows if a[1] < b[1] and (a[6] or b[6]) and a[7] * 80 <= b[8] * 100 and b[7] * 80 <= a[8] * 100}
    assert fit <= set(met)
    found = tiles.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "block").mapInArrow(J._cross(GENERAL), "a long, b long").collect()
    assert sorted(tuple(sorted(p)) for p in found) == [(10 * (k - 1), 10 * k) for k in range(4, 60, 5)]
