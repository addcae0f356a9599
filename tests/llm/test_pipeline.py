import re

import corpus_pipeline as P
from flowsieve.llm import decontaminate as D
from flowsieve.llm import packing, pii
from test_jaccard import plain
from flowsieve.llm.jaccard import NEAR_COPIES

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, seen = source, {}
    for name, stage in P.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == source.columns
    before = {r.doc_id: r.text for r in source.collect()}
    text = {n: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for n, df in seen.items() if n != "packing"}
    assert set(text["language"]) == {k for k, t in before.items() if t and any(c.isalpha() for c in t)}
    groups = plain(sorted(text["language"].items()), NEAR_COPIES)
    assert set(text["near_copies"]) == {d for d, _, c in groups if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = {d: n for d, _, n, *_ in D.brute(sorted(text["near_copies"].items()), items)}
    clean = {k for k, n in hits.items() if not n}
    assert clean <= set(text["decontamination"]) and all(text["decontamination"][k] == text["near_copies"][k] for k in clean)
    assert all(not r[2] for r in D.brute(sorted(text["decontamination"].items()), items))
    assert set(text["pii"]) == set(text["decontamination"])
    for k, t in text["pii"].items():
        assert not pii.base_spans(t) and (re.sub("<(email|ip|card|phone)>", "", t) == t) == (t == text["decontamination"][k])
    pieces = seen["packing"].collect()
    sizes = {}
    for p in pieces:
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
    encode = packing.Encoder().encode
    assert sizes == {k: len(encode(t)) // 4 + 1 for k, t in text["pii"].items()}
    assert sorted(P.run(spark, FOLDER).select("doc_id", "start", "ids_crc32").collect()) == sorted((p.doc_id, p.start, p.ids_crc32) for p in pieces)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
