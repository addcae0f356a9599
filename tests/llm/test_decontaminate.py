import numpy as np
import pytest

from flowsieve.llm import decontaminate as d


def make(seed):
    rng = np.random.default_rng(seed)
    letters = "abcde"
    items = [(k, " ".join(rng.choice(list(letters), rng.integers(1, 9)))) for k in range(12)] + [(99, "A a a a a a a"), (98, None), (97, "...")]
    docs = [(k, " ".join(rng.choice(list(letters + "z"), rng.integers(0, 60)))) for k in range(40)] + [(50, None), (51, "")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [200_000, 15])
def test_equals_a_plain_search(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(d, "SHARD_WORDS", limit)
    docs, items = make(seed)
    got = d.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4).drop("hit_spans").collect()
    assert sorted(map(tuple, got)) == sorted(d.brute(docs, items, 4))


def test_spans_go_and_clean_text_stays(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "Before. One, two three four five six seven eight nine TEN eleven! after " + "word " * 30, "x"), (2, item, "x"), (3, "clean   text\n", "x"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = {r.doc_id: r.text for r in d.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert out == {1: "Before. ! after " + "word " * 30, 3: "clean   text\n", 4: None}
    assert d.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == 4
    assert d.decontaminate(docs.where("false"), spark.createDataFrame([(7, item)], "item_id long, text string")).count() == 0
