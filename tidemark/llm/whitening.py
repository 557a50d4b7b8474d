"""Whitening of integer vectors with distributed block matrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import write_table
from tidemark.session import scratch_dir

#: Rows of a block (half a MB for 64 dimensions), blocks that one task multiplies, and the least number of such tasks.
BLOCK, TOGETHER, TASKS = 1024, 128, 8
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def finite(vec: str | Column) -> Column:
    """Whether a vector is there and all its entries are there and finite."""
    column = F.col(vec) if isinstance(vec, str) else vec
    return column.isNotNull() & F.coalesce(F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    """(number of rows, exact sum of every dimension); a task passes on one row for each dimension."""

    def partial(batches):
        total: dict[int, int] = {}
        n = 0
        for batch in batches:
            column = batch.column("x")
            n += len(column)
            offsets, flat = np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            for d in np.unique(sizes).tolist():
                x = flat[offsets[:-1][sizes == d][:, None] + np.arange(d)]
                # Halves of 32 bits: their sums over a batch are exact.
                for j, (high, low) in enumerate(zip((x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist())):
                    total[j] = total.get(j, 0) + (high << 32) + low
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *total], pa.int32()), pa.array([str(v) for v in (n, *total.values())])], names=["dim", "part"])

    got = dict(rows.select("x").mapInArrow(partial, "dim int, part string").groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect())
    return int(got.pop(-1, 0)), [int(got[j]) for j in sorted(got)]


def numbered(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with consecutive numbers (index) from 0: the place inside a written partition plus the sizes of the partitions before it (one row each)."""
    placed = write_table(rows.withColumn("place", F.monotonically_increasing_id()), f"{folder}/placed").withColumn("part", F.shiftright("place", 33))
    sizes = sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(r["n"] for r in sizes)]).tolist()
    offsets = rows.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part long, before long")
    return placed.join(offsets, "part").withColumn("index", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before", "place")


def centred_blocks(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(block, ids, deviations, values): BLOCK rows each, in the order of their index, as a matrix of x - S/n. n*x - S is exact, so every entry is rounded once."""
    d = len(sums)
    row = F.struct((F.col("index") % BLOCK).alias("at"), "vec_id", "x")
    gathered = rows.groupBy(F.floor(F.col("index") / BLOCK).cast("int").alias("block")).agg(F.collect_list(row).alias("rows"))
    s = np.array(sums, object)

    def dense(batches):
        for batch in batches:
            for block, found in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                found.sort(key=lambda r: r["at"])
                exact = n * np.array([r["x"] + [0] * (d - len(r["x"])) for r in found], object) - s
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int32()), pa.array([[r["vec_id"] for r in found]], pa.list_(pa.int64())),
                    pa.array([[str(v) for v in (exact**2).sum(axis=1)]], pa.list_(pa.string())), pa.array([(exact / n).astype(np.float64).tobytes()], pa.binary()),
                ], names=["block", "ids", "deviations", "values"])

    return gathered.mapInArrow(dense, "block int, ids array<long>, deviations array<string>, values binary")


def block_matrix(blocks: DataFrame, values: str, columns: int, n: int, wide: int = 1) -> BlockMatrix:
    """The rows of all blocks as a matrix: one below the other, or `wide` blocks side by side."""

    def dense(row):
        m = np.frombuffer(row[1], np.float64).reshape(-1, columns)
        return divmod(row[0], wide), DenseMatrix(m.shape[0], columns, m.ravel(order="F"))

    return BlockMatrix(blocks.select("block", values).rdd.map(dense), BLOCK, columns, n if wide == 1 else math.ceil(n / BLOCK / wide) * BLOCK, columns * wide)


def scatter(matrix: BlockMatrix, tasks: int) -> np.ndarray:
    """The transpose times the matrix. The rows are the middle dimension of this product, which has one result block: `tasks` parts of them are multiplied by themselves and
    summed (the second argument of the Scala method, which the Python method leaves out; without it one task would read all rows)."""
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, tasks)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(blocks: DataFrame, w: np.ndarray, n: int, tasks: int) -> DataFrame:
    """(block, z): the rows of every block times `w`. The blocks stand in a square and `w` along the diagonal of another: MLlib deals the blocks of a product out along both
    edges, so a tall matrix would only be spread over the root of its partitions."""
    d, m = w.shape
    wide = math.ceil(math.sqrt(math.ceil(n / BLOCK)))
    one = DenseMatrix(d, m, w.ravel(order="F"))
    spark = blocks.sparkSession
    diagonal = BlockMatrix(spark.sparkContext.parallelize([((j, j), one) for j in range(wide)], tasks), d, m, d * wide, m * wide)
    product = block_matrix(blocks, "values", d, n, wide).multiply(diagonal)
    found = product.blocks.map(lambda x: (x[0][0] * wide + x[0][1], bytearray(np.ascontiguousarray(x[1].toArray()).tobytes())))
    return spark.createDataFrame(found, "block int, z binary")


def whitening_matrix(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, whether a component has variance, share of the trace) of the first components; an eigenvector's largest entry is positive."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    e, u = values[order], vectors[:, order]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(e))] < 0, -1.0, 1.0)
    some = e > max(float(values.max()), 0.0) * len(v) * np.finfo(float).eps
    return np.where(some, u / np.sqrt(np.where(some, e, 1.0)), 0.0), some, np.where(some, e, 0.0) / (float(np.trace(v)) or 1.0)


def whiten(spark: SparkSession, vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "x", components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every vector and each of the first `components` components.

    `vec` holds whole numbers (array of long). All rows with a vector are the fit list: n rows with sums S. `deviation` is the sum of (n*x - S)^2, exact (decimal);
    `whitened` is x - S/n, projected on the component and divided by the root of its eigenvalue; `explained` is the eigenvalue's share of the trace;
    `identity_error` is the largest entry of the covariance of all whitened rows minus the identity, over the components with variance.

    Rows get consecutive numbers, blocks of them become a distributed BlockMatrix of centred rows, its transpose times itself gives the scatter matrix (d x d, decomposed on the
    driver), and the BlockMatrix times the whitening matrix projects the rows. Only sizes, sums and d x d matrices reach the driver. Blocks and projections are
    written tables, so what a lost executor held is made anew from them.

    Null vectors are left out; null ids and repeated rows are rows like others. A vector shorter than the longest counts as filled up with zeros. Directions without
    variance (a single row, constant columns) give 0 for `whitened` and `explained`. An empty table, and one of empty vectors only, give no rows. Other columns are not read.
    """
    folder = scratch_dir(spark, "whitening")
    taken = vectors.where(F.col(vec).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<bigint>").alias("x"))
    rows = numbered(taken, folder)
    n, sums = sums_of(rows)
    if not sums:
        return spark.createDataFrame([], RESULT)
    tasks = max(TASKS, math.ceil(n / BLOCK / TOGETHER))
    blocks = write_table(centred_blocks(rows, n, sums), f"{folder}/blocks")
    w, some, share = whitening_matrix(scatter(block_matrix(blocks, "values", len(sums), n), tasks) / n, min(components, len(sums)))
    projected = write_table(project(blocks, w, n, tasks), f"{folder}/projected")
    k = len(share)
    error = np.abs(scatter(block_matrix(projected, "z", k, n), tasks) / n - np.diag(some.astype(float)))[np.ix_(some, some)].max(initial=0.0)

    def each(batches):
        for batch in batches:
            for ids, deviations, z in zip(*(batch.column(c).to_pylist() for c in ("ids", "deviations", "z"))):
                size = len(ids)
                row = pa.array(np.repeat(np.arange(size), k))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(deviations, pa.string()).take(row),
                    pa.array(np.frombuffer(z, np.float64)), pa.array(np.tile(share, size)),
                ], names=["vec_id", "component", "deviation", "whitened", "explained"])

    out = blocks.select("block", "ids", "deviations").join(projected, "block").select("ids", "deviations", "z").mapInArrow(each, "vec_id long, component int, deviation string, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(float(error)).alias("identity_error"))
