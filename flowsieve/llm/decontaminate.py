"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The automaton holds every run of words of every item. Streaming a document's words gives, at each word, the longest match that ends there.
A window is ``window`` consecutive item words, or a whole shorter item; the last words of a match at least that long are hit. Words in no item,
and neighbours that are neighbours in no item, cannot extend a match to a window, so a numpy pass first keeps only the runs in which they can.

Items are cut into shards of at most SHARD_WORDS words; each shard's automaton is a broadcast of bounded size, and a document passes
through the shards one after another in a narrow plan (no shuffle).

Nulls: a null text has no words, a null item is left out, a null item_id is kept as an item but names nothing. Repeated items all count. Empty tables give
rows without hits, or no rows. Documents keep all their columns; the columns that ``match`` adds replace ones of equal name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from flowsieve.llm.common import slices, table, texts

WINDOW = 10
SHARD_WORDS = 200_000
# Separators become spaces and A-Z is lowered; bytes of other characters stay.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(item, np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64)) for item, ws in items]
        for _, codes in coded:
            last = 0
            for c in codes.tolist():
                last = self._extend(last, c)
        size = len(self.vocab)
        pairs = [codes[:-1] * size + codes[1:] for _, codes in coded if len(codes) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.shortest = min((min(window, len(c)) for _, c in coded), default=window)
        # Items by the state and length of their windows; up[v] is the nearest state on the link path that ends a window.
        self.ends: dict[int, dict[int, set]] = {}
        for item, codes in coded:
            full, state, length = min(window, len(codes)), 0, 0
            for c in codes.tolist():
                state, length = self.next[state][c], length + 1
                if length > full:
                    length = full
                while self.len[self.link[state]] >= length:
                    state = self.link[state]
                if length == full:
                    self.ends.setdefault(state, {}).setdefault(full, set()).add(item)
        self.up = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.len.__getitem__):
            self.up[v] = v if v in self.ends else self.up[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def lengths(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest match at each word."""
        nxt, link, length = self.next, self.link, self.len
        state = matched = 0
        for c in codes:
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state, matched = nxt[state][c], matched + 1
            yield state, matched

    def scan(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges inside windows, merged, and the items the windows come from."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        if len(doc) < self.shortest or not self.vocab:
            return spans, items
        get = self.vocab.get
        codes = np.fromiter((get(w, -1) for w in doc), np.int64, len(doc))
        for start, stop in self._runs(codes):
            for k, (state, matched) in enumerate(self.lengths(codes[start:stop].tolist())):
                v = self.up[state]
                while v >= 0:
                    for size, names in self.ends[v].items():
                        if size <= matched:
                            items |= names
                            begin, end = start + k + 1 - size, start + k + 1
                            while spans and begin <= spans[-1][1]:
                                begin = min(begin, spans.pop()[0])
                            spans.append((begin, end))
                    v = self.up[self.link[v]]
        return spans, items

    def _runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words that follow each other in items, at least as long as the shortest window."""
        known = codes >= 0
        if self.shortest > 1:
            if not len(self.pairs):
                return
            pair = codes[:-1] * len(self.vocab) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = (self.pairs[at] == pair) & known[:-1] & known[1:]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        more = self.shortest > 1
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b + more - a >= self.shortest:
                yield a, b + more


def shards(items: DataFrame, window: int) -> list[Automaton]:
    """Automata over at most SHARD_WORDS words each; the item table is read row by row."""
    out, held, size = [], [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        ws = words(row["text"])
        if not ws:
            continue
        if held and size + len(ws) > SHARD_WORDS:
            out.append(Automaton(held, window))
            held, size = [], 0
        held.append((row["item"], ws))
        size += len(ws)
    if held or not out:
        out.append(Automaton(held, window))
    return out


ADDED = {"n_words": LongType(), "hit_spans": ArrayType(LongType()), "hit_items": ArrayType(StringType())}


def match(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, hit_spans (start, end, start, end ... in words) and hit_items."""
    spark = docs.sparkSession
    df = docs.drop(*ADDED).select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<bigint>").alias("hit_spans"), F.lit(None).cast("array<string>").alias("hit_items"))
    for automaton in shards(items, window):
        shared = spark.sparkContext.broadcast(automaton)
        df = df.mapInArrow(_scanner(shared), df.schema)
    return df


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in slices(batches, "text"):
            n, spans, found = [], [], []
            old_spans, old_items = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
            for text, before, named in zip(texts(batch), old_spans, old_items):
                doc = words(text)
                own, items = automaton.scan(doc)
                ranges = sorted([*own, *zip((before or [])[::2], (before or [])[1::2])])
                merged: list[int] = []
                for a, b in ranges:
                    if merged and a <= merged[-1]:
                        merged[-1] = max(merged[-1], b)
                    else:
                        merged += [a, b]
                n.append(len(doc))
                spans.append(merged)
                found.append(sorted(items | set(named or ()), key=lambda x: (x is None, x)))
            names = batch.schema.names
            columns = list(batch.columns)
            for name, values, kind in (("n_words", n, pa.int64()), ("hit_spans", spans, pa.list_(pa.int64())), ("hit_items", found, pa.list_(pa.string()))):
                columns[names.index(name)] = pa.array(values, kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = WINDOW - 1, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with spans of more than ``max_span`` hit words cut out of the text. A document goes when over ``max_coverage`` of its words are hit,
    or when no word is left of one that had hits."""
    names = docs.columns
    docs = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(names)])
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keep, out = [], []
            for text, n, spans in zip(texts(batch), batch.column("n_words").to_pylist(), batch.column("hit_spans").to_pylist()):
                ranges = list(zip(spans[::2], spans[1::2]))
                if n and sum(b - a for a, b in ranges) > max_coverage * n:
                    keep.append(False)
                    out.append(text)
                    continue
                cut = [(a, b) for a, b in ranges if b - a > max_span or n == b - a]
                if cut:
                    at = [m.span() for m in WORD.finditer(text)]
                    pieces, done = [], 0
                    for a, b in cut:
                        pieces.append(text[done : at[a][0]])
                        done = at[b - 1][1]
                    text = "".join([*pieces, text[done:]])
                keep.append(not cut or n > sum(b - a for a, b in cut))
                out.append(text)
            columns = [pa.array(out, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(keep))

    return match(docs, items, window).mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema.fields])).toDF(*names)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    hit = F.aggregate("hit_spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda acc, x: F.struct((acc["sum"] + acc["sign"] * x).alias("sum"), (-acc["sign"]).alias("sign")))["sum"]
    named = F.array_distinct(F.filter("hit_items", lambda x: x.isNotNull()))
    return match(docs.select("doc_id", "text"), items, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(named), ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"), "hit_spans",
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return report(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("hit_spans")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate(docs, table(spark, folder, "benchmark"))


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The report by a plain search, for tests."""
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, body in items:
            iw = words(body)
            size = min(window, len(iw))
            for k in range(len(iw) - size + 1) if size else ():
                for i in range(len(ws) - size + 1):
                    if ws[i : i + size] == iw[k : k + size]:
                        hit |= set(range(i, i + size))
                        found.add(str(item))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS gram FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) WHERE len(w) >= size),
occ AS (SELECT g.doc_id, g.i, g.size, win.item_id FROM grams g JOIN win USING (size, gram)),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM occ), LATERAL (SELECT unnest(range(0, size)) AS j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
