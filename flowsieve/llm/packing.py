"""Packing token sequences by best-fit decreasing.

A document's ids, then one end id, are cut into full windows of ``capacity`` ids and a remainder. Remainders go, longest first, to the open
window with the least room that still takes them; a segment tree over remaining capacities finds it. Every task packs the rows of its own input
split, in groups of at most GROUP_ROWS remainders, so no row is shuffled and memory is bounded. A task's sequence numbers carry its partition number in
the upper bits. A lost task gives the same pieces again, since its input split is the same.

Nulls: a null text is an empty one and becomes the end id alone; a null id stays null. Repeated rows are packed each on its own. An
empty table gives no piece. Ties in length keep input order. Further columns are left out.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import slices, table, texts

CAPACITY = 1024
END = b"\0\0\0\0"
GROUP_ROWS = 200_000
GROUP_BYTES = 64_000_000
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPACED = re.compile(r"\s | \s|^ | $")


class Encoder:
    """Byte-level BPE ids as little-endian bytes.

    A single space between two other characters always starts a new token, so the parts between such spaces are encoded once and remembered.
    Texts with other runs of white space, or with a special token's string, are encoded whole.
    """

    LIMIT = 400_000

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.parts = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if SPACED.search(text):
            return np.array(self.parts.encode_ordinary(text), "<u4").tobytes()
        known, out = self.known, []
        first, *rest = text.split(" ")
        out.append(self.part(first))
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = self.part(" " + word)
                if len(word) < 64:
                    if len(known) >= self.LIMIT:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def part(self, text: str) -> bytes:
        return np.array(self.parts.encode_ordinary(text), "<u4").tobytes()


class Rooms:
    """Segment tree over remaining capacities; a leaf counts the open windows with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.size
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``length``, and that room; it is no longer open."""
        counts, node = self.counts, length + self.size
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not counts[2 * node])
        room = node - self.size
        window = self.windows[room].pop()
        while node:
            counts[node] -= 1
            node >>= 1
        return window, room


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of every remainder, and the number of windows."""
    window, offset, rooms, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), Rooms(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = rooms.take(length)
        if found is None:
            found, opened = (opened, capacity), opened + 1
        window[i], offset[i] = found[0], capacity - found[1]
        if found[1] > length:
            rooms.add(found[1] - length, found[0])
    return window, offset, opened


def packer(capacity: int, id_type: pa.DataType, with_ids: bool):
    """The pieces of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = Encoder(), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        held = 0

        def close(first: int) -> tuple[list[pa.RecordBatch], int]:
            ids, start, length, crc, tokens, full, payload = zip(*rows)
            full, length = np.array(full), np.array(length, np.int64)
            rest = np.flatnonzero(~full)
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            window, at, opened = best_fit(length[rest], capacity)
            sequence[rest], offset[rest] = window, at
            sequence[full] = opened + np.arange(full.sum())
            data = [pa.array(ids, id_type), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens, pa.int64()), pa.array(sequence + first), pa.array(offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                data.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in payload], pa.list_(pa.int32())))
                names.append("ids")
            out = pa.Table.from_arrays(data, names).to_batches(max_chunksize=50_000)
            return out, first + opened + int(full.sum())

        step = 4 * capacity
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                data = encoder.encode(text or "") + END
                tokens = len(data) // 4
                for k in range(0, len(data), step):
                    piece = data[k : k + step]
                    rows.append((doc_id, k // 4, len(piece) // 4, zlib.crc32(piece), tokens, len(piece) == step, piece if with_ids else None))
                held += len(data) * with_ids
                if len(rows) >= GROUP_ROWS or held >= GROUP_BYTES:
                    out, first = close(first)
                    yield from out
                    rows, held = [], 0
        if rows:
            yield from close(first)[0]

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves."""
    field = docs.schema["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(field.dataType.simpleString(), pa.string())
    if id_type == pa.string():
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(packer(capacity, id_type, with_ids), schema)


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
