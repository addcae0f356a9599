"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each distinct shingle (five words, A-Z lowered, split at white space) is hashed once; the hash names its bin, and the bin keeps its smallest
value. An empty bin borrows from the first full one in its own random order of all bins, the same in every document: every full bin is as likely, however few there are. The low
BITS bits of each bin are packed and written in base64. Two fingerprints agree in a share m of bins; unlike values agree by chance in 1 of
2**BITS, so the likeness is (m - c) / (1 - c) with c = 2**-BITS, cut to [0, 1].

The edited copy of the query needs the next document in descending doc_id. Texts are dealt out once by ranges of doc_id, and of the text's md5 where ids repeat; inside a range the next
row follows, and only the first and the last row of each range meet in a second, small step. The ranges are used in one job whose result is
written, so that no second job can draw other ranges.

A text without words has the empty fingerprint: likeness 1 with another empty one, 0 with any other. Null texts are empty; a null doc_id sorts
last; rows with one doc_id go in order of the md5 of their texts. An empty table gives no rows; a table of one row is its own next. Further columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowsieve.llm.common import Memo, mix, shingles, slices, table, texts
from flowsieve.session import durable

BINS, BITS, WIDTH = 256, 4, 5


def _borrowed() -> np.ndarray:
    """For every bin, all bins in the order in which it asks them."""
    at = np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS)
    return mix(at + np.uint64(0x51ED27)).argsort(axis=1, kind="stable")


BORROWED = _borrowed()
EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)


def bins(hashes: np.ndarray) -> np.ndarray | None:
    """BINS values of a set of 64-bit hashes; None for the empty set."""
    if not len(hashes):
        return None
    # The top eight bits name the bin, so the bin's smallest value is the first one in order.
    h = np.sort(mix(hashes ^ np.uint64(0xA5A5F00D)))
    first = np.searchsorted(h, EDGES)
    out = h[np.minimum(first, len(h) - 1)]
    full = (first < len(h)) & (out >> np.uint64(56) == EDGES >> np.uint64(56))
    if not full.all():
        empty = np.flatnonzero(~full)
        out[empty] = out[BORROWED[empty, full[BORROWED[empty]].argmax(1)]]
    return out


def low_bits(values: np.ndarray | None) -> np.ndarray | None:
    return None if values is None else (mix(values) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(low: np.ndarray | None) -> str:
    if low is None:
        return ""
    raw = np.unpackbits(low[:, None], axis=1)[:, 8 - BITS :].ravel()
    return base64.b64encode(np.packbits(raw).tobytes()).decode()


def unpack(text: str) -> np.ndarray | None:
    if not text:
        return None
    raw = np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8))[: BINS * BITS].reshape(BINS, BITS)
    return raw @ (1 << np.arange(BITS - 1, -1, -1))


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


_memo = Memo()


def sketch(text: str | None) -> np.ndarray | None:
    words = (text or "").encode("utf-8", "replace").lower().split()
    return low_bits(bins(shingles(words, WIDTH, _memo, distinct=False)))


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OPEN = ", part int, side int, text string"


def _digest(text: str, own, following: str, next_sketch) -> tuple:
    new = edited(text, following)
    changed = own if new == text else sketch(new)
    return len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), pack(own), pack(changed), likeness(own, changed), likeness(own, next_sketch)


def _neighbours(id_type: pa.DataType):
    """Results of all rows whose next row is in the range; besides them, the first (side 0) and last (side 1) row with its text."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "side", "text"]
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = TaskContext.get().partitionId(), None, []
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                text = text or ""
                own = sketch(text)
                if held is None:
                    out.append((doc_id, *[None] * 6, part, 0, text))
                else:
                    out.append((held[0], *_digest(held[1], held[2], text, own), None, None, None))
                held = (doc_id, text, own)
            if out:
                yield emit(out)
                out = []
        if held is not None:
            yield emit([(held[0], *[None] * 6, part, 1, held[1])])

    return run


def _ends(id_type: pa.DataType):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(i, *_digest(t, sketch(t), n, sketch(n))) for i, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each row, of its edited text, and their likeness."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    order = [F.desc_nulls_last("doc_id"), F.asc("digest")]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    dealt = docs.select("doc_id", "text", digest.alias("digest")).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("digest")
    made = durable(dealt.mapInArrow(_neighbours(id_type), RESULT.format(id=kind) + OPEN), "fingerprints")
    ends = made.where("side IS NOT NULL").select("doc_id", "part", "side", "text")
    # A range's last row is followed by the next range's first one; ranges are numbered in order, and empty ones are absent.
    firsts = ends.where("side = 0").select("part")
    ring = Window.orderBy("part")
    follows = firsts.select("part", F.coalesce(F.lead("part").over(ring), F.min("part").over(Window.partitionBy())).alias("next_part"))
    pairs = (
        ends.where("side = 1").select("doc_id", "part", "text").join(follows, "part")
        .join(ends.where("side = 0").select(F.col("part").alias("next_part"), F.col("text").alias("following")), "next_part")
        .select("doc_id", "text", "following")
    )
    columns = [c.split()[0] for c in RESULT.format(id=kind).split(", ")]
    return made.where("side IS NULL").select(*columns).unionByName(pairs.mapInArrow(_ends(id_type), RESULT.format(id=kind)))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))
