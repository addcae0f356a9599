"""Embedding whitening with distributed block matrices.

Vectors become whole numbers first (``floor(1024 * c) + 100000``), so that their sums, and each row's distance from the mean, are exact. The centred rows are
numbered and laid into a ``BlockMatrix``; its transpose times itself is the scatter. Blocks of that product are added up in SPLITS partial sums, so no task
meets all rows. The scatter has a row and a column per dimension and is decomposed on the driver; the eigenvectors, divided by the roots of their eigenvalues, go
back as a small ``BlockMatrix`` that projects every row.

Rules: a row whose vector is null or holds a null, NaN or infinity is left out. So is a row whose vector has another length than most (the longer
length wins a tie), and every row if that length is 0. Values beyond 2^52 count as 2^52. Equal rows, null ids and repeated ids are rows of their own. A deviation that a long cannot hold is
null. A component without variance (eigenvalue at most RANK of the largest) projects to 0; ``identity_error`` is then 1, as the identity cannot be reached.
No rows left, no result. Further columns are left out.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import table
from flowsieve.session import durable
from flowsieve.sources.tables import number_rows

COMPONENTS = 8
ROWS, COLS = 1024, 1024
RANK = 1e-12
LARGEST = 2.0**52
SCHEMA = "vec_id bigint, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x): rows whose vector is whole and finite, as whole numbers."""
    good = F.forall(F.col("c"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform("c", lambda v: F.floor(F.greatest(F.least(v * 1024.0, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(100_000).cast("bigint"))
    doubles = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("c"))
    return doubles.where(F.col("c").isNotNull() & good).select("id", whole.alias("x"))


def common_length(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""
    long = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    found = {r["i"]: (int(r["s"]), r["n"]) for r in long.collect()}  # one row per dimension
    return (found[0][1], [found[i][0] for i in range(d)]) if found else (0, [])


def centred(rows: DataFrame, n: int, total: list[int]) -> DataFrame:
    """(row, id, deviation, y): y is x less its mean, deviation the exact squared length of n * y."""
    means = F.array(*[F.lit(Decimal(s)).cast("decimal(38,0)") for s in total])
    moved = F.zip_with("x", means, lambda v, s: (v.cast("decimal(19,0)") * F.lit(Decimal(n)).cast("decimal(18,0)")).cast("decimal(38,0)") - s)
    held = F.transform("t", lambda t: t.try_cast("bigint"))
    squared = F.aggregate(F.transform(held, lambda t: F.try_multiply(t, t)), F.lit(0).cast("bigint"), F.try_add)
    out = number_rows(rows, "row").withColumn("t", moved)
    return out.select((F.col("row") - 1).alias("row"), "id", squared.alias("deviation"), F.transform("t", lambda t: t.cast("double") / F.lit(float(n))).alias("y"))


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector("y").alias("y")), "y")
    # Scatter and projection both read the blocks; lost ones are made again.
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(ROWS, COLS).cache()


def local_blocks(spark: SparkSession, m: np.ndarray) -> BlockMatrix:
    """A small matrix, cut like the columns of the rows it is to meet."""
    parts = [((i // COLS, 0), Matrices.dense(len(m[i : i + COLS]), m.shape[1], m[i : i + COLS].ravel(order="F").tolist())) for i in range(0, len(m), COLS)]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), COLS, m.shape[1], len(m), m.shape[1])


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times itself, added up in several partial sums per block of the product: without them one task would get all rows."""
    splits = max(1, blocks.numRowBlocks // 8)
    left, right = blocks.transpose(), blocks._java_matrix_wrapper._java_model
    product = BlockMatrix(left._java_matrix_wrapper.call("multiply", right, splits), COLS, COLS)
    return product.toLocalMatrix().toArray()


def axes(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as columns; the largest entry of a vector is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order]
    top = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return values[order], vectors * np.where(top < 0, -1.0, 1.0)


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    kept = durable(usable(df, id_col, vector), "whitening-x")
    d = common_length(kept)
    same = kept.where(F.size("x") == d)
    n, total = sums(same, d)
    if not n:
        return kept.select(F.col("id").alias(id_col), F.lit(1).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).where("false")
    rows = durable(centred(same, n, total), "whitening-y", n)
    blocks = block_matrix(rows, n, d)
    covariance = scatter(blocks) / n
    k = min(components, d)
    values, vectors = axes(covariance, k)
    held = values > RANK * max(values[0], 0.0)
    trace = float(np.trace(covariance))
    shares = values / trace if trace > 0 else np.zeros(k)
    matrix = np.where(held, vectors / np.sqrt(np.where(held, values, 1.0)), 0.0)
    projected = blocks.multiply(local_blocks(spark, matrix)).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).toDF("row", "w")
    found = durable(found.select("row", vector_to_array("w").alias("w")), "whitening-w", n)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cells = found.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cells, pairs))
    explained = F.array(*[F.lit(float(s)) for s in shares])
    out = rows.select("row", "id", "deviation").join(found, "row").select("id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
