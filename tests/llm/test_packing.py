import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowsieve.llm import packing

FOLDER = "/root/testdata/sf0.001"


def check(pieces, docs, capacity=1024):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert own[0].start == 0 and sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for p, q in zip(own, own[1:]):
            assert p.start + p.length == q.start
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return by


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pieces = packing.op10_packing(spark, FOLDER).collect()
    by = check(pieces, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    ids = sum(p.length for p in pieces)
    assert len(by) * 1024 < 1.03 * ids


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a  b\n\n c <|endoftext|> d"), (4, "word " * 3000), (5, " x "), (6, "  　é\t "), (None, "no id"), (7, "same"), (8, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", packing.F.lit("clash"))
    pieces = packing.pack(docs, with_ids=True).collect()
    check(pieces, rows)
    assert all(len(p.ids) == p.length for p in pieces)
    assert packing.pack(docs.where("false")).count() == 0


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 400)
    window, offset, opened = packing.best_fit(lengths, 64)
    rooms, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fit = [r for r in rooms if r >= lengths[i]]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - lengths[i])
        else:
            rooms.append(64 - lengths[i])
    used = np.zeros(opened, int)
    np.add.at(used, window, lengths)
    assert opened == len(rooms) and sorted(64 - used) == sorted(rooms)
