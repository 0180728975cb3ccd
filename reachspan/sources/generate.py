"""Seeded random matrices and pairs, made where they are needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspan.matrix import BoolMatrix


def _draw(number: str, seed: int, below: int) -> Column:
    return F.pmod(F.xxhash64(number, F.lit(seed)), F.lit(below))


def random_pairs(spark: SparkSession, n: int, count: int, seed: int = 1) -> DataFrame:
    """Pairs (i, j) below n, with replacement; equal for equal seeds, however many tasks make them."""
    return spark.range(count).select(_draw("id", 2 * seed, n).alias("i"), _draw("id", 2 * seed + 1, n).alias("j"))


#: Cells that one block of rows is drawn for, about.
DRAWN = 1 << 17


def _shares(rows: list[int], n: int, nnz: int, seed: int) -> list[int]:
    """How many of nnz cells each block of rows gets, as if they were drawn from all cells together.

    Block by block by the hypergeometric law; where its numbers are too large for the generator, by the binomial one within the same limits.
    """
    rng, left, capacity, out = np.random.default_rng([seed, 0]), nnz, sum(rows) * n, []
    for r in rows:
        own, rest = r * n, capacity - r * n
        if capacity < 10**9:
            drawn = int(rng.hypergeometric(own, rest, left)) if left else 0
        else:
            drawn = int(rng.binomial(left, own / capacity))
        drawn = min(max(drawn, left - rest), own, left)
        out.append(drawn)
        left, capacity = left - drawn, rest
    return out


def random_binary_matrix(spark: SparkSession, n: int, nnz: int, seed: int = 1) -> BoolMatrix:
    """A square matrix with exactly nnz distinct cells, equal for equal seeds.

    The cells are first shared out among blocks of rows; then each block draws its own without replacement where it is made.  No task sees
    more than a block, and nothing is sorted or shuffled.
    """
    if not 0 <= nnz <= n * n:
        raise ValueError("a matrix has between 0 and n * n cells")
    many = min(max(1, -(-nnz // DRAWN)), max(n, 1))
    ends = [n * i // many for i in range(many + 1)]
    rows = [b - a for a, b in zip(ends, ends[1:], strict=False)]
    blocks = [(i, ends[i], rows[i], k) for i, k in enumerate(_shares(rows, n, nnz, seed)) if k]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                cells = np.random.default_rng([seed, 1 + block["block"]]).choice(block["rows"] * n, block["k"], replace=False, shuffle=False)
                yield pa.RecordBatch.from_arrays([pa.array(block["first"] + cells // n), pa.array(cells % n)], names=["row", "col"])

    told = spark.createDataFrame(blocks, "block long, first long, rows long, k long").repartition(max(1, len(blocks)), "block")
    return BoolMatrix(told.mapInArrow(drawn, "row long, col long"), n, n, "basic")


def random_matrix(spark: SparkSession, n: int, nnz: int, low: float = 0.0, high: float = 1.0, seed: int = 1) -> DataFrame:
    """Cells (row, col, value) with values in [low, high), for comparison with libraries that hold values."""
    share = F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return random_binary_matrix(spark, n, nnz, seed).df.withColumn("value", F.lit(low) + share * (high - low))
