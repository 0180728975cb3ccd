"""Matrices as tables: Parquet with the shape beside it, and compressed sparse rows."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspan.functions.ranges import row_delimiters
from reachspan.matrix import COLUMNS, BoolMatrix

#: Places of a flat array that meet their rows at once.
PLACES = 1 << 12


def save(m: BoolMatrix, path: str, mode: str = "errorifexists", compression: str = "zstd", buckets: int = 0) -> None:
    """Writes entries sorted by row, so that a lookup's row filter skips row groups, and a one-row table of shape, count, encoding and buckets.

    With `buckets`, entries are dealt to so many buckets by row: lookups and products with the loaded matrix shuffle the other side only.
    """
    spark = m.df.sparkSession
    if buckets:
        dealt = m.df.repartition(buckets, "row").write.mode(mode).format("parquet").option("compression", compression).option("path", f"{path}/entries")
        dealt.bucketBy(buckets, "row").sortBy(*m.df.columns).saveAsTable(_bucketed(path))
    else:
        sorted_ = m.df.repartitionByRange(F.col("row")).sortWithinPartitions(*m.df.columns)
        sorted_.write.mode(mode).option("compression", compression).parquet(f"{path}/entries")
    nnz = m.with_df(spark.read.parquet(f"{path}/entries")).nnz()
    shape = spark.createDataFrame([(m.nrows, m.ncols, nnz, m.encoding, buckets)], "nrows long, ncols long, nnz long, encoding string, buckets int")
    shape.coalesce(1).write.mode(mode).parquet(f"{path}/shape")


def _bucketed(path: str) -> str:
    """The name of the table that tells a session of the buckets at a path; the files are all there is."""
    return f"reachspan_{hashlib.md5(path.encode()).hexdigest()}"


def load(spark: SparkSession, path: str) -> BoolMatrix:
    """What `save` wrote; Spark's error where nothing is there."""
    shape = spark.read.parquet(f"{path}/shape").first()
    if not shape.asDict().get("buckets"):
        return BoolMatrix(spark.read.parquet(f"{path}/entries"), shape.nrows, shape.ncols, shape.encoding)
    columns, name = COLUMNS[shape.encoding], _bucketed(path)
    entries = ", ".join(f"`{c}` bigint" for c in columns)
    place = f"{path}/entries".replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({entries}) USING parquet CLUSTERED BY (`row`) SORTED BY ({', '.join(f'`{c}`' for c in columns)}) INTO {shape.buckets} BUCKETS LOCATION '{place}'")
    return BoolMatrix(spark.table(name), shape.nrows, shape.ncols, shape.encoding)


def plain_size(m: BoolMatrix) -> int:
    """Bytes of the matrix as flat arrays of longs: one for a cell, two for a range, row delimiters, one more than rows, and the number of columns."""
    return 8 * (m.measured().entries * (1 if m.encoding == "basic" else 2) + m.nrows + 2)


def size_in_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the stored entries."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{path}/entries")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n


def from_csr(spark: SparkSession, ncols: int, entries, delimiters, encoding: str = "basic") -> BoolMatrix:
    """A matrix of compressed sparse rows that the driver holds: flat entries, two for a range, and row delimiters from 0."""
    entries, delimiters = np.asarray(entries, np.int64), np.asarray(delimiters, np.int64)
    if not len(delimiters):
        delimiters = np.zeros(1, np.int64)
    if delimiters[0] != 0 or delimiters[-1] != len(entries) or (np.diff(delimiters) < 0).any() or encoding == "ranges" and (delimiters % 2).any():
        raise ValueError("entries and delimiters do not fit")
    import pandas as pd

    row = np.repeat(np.arange(len(delimiters) - 1), np.diff(delimiters))
    columns = {"row": row, "col": entries} if encoding == "basic" else {"row": row[::2], "lo": entries[::2], "hi": entries[1::2]}
    df = spark.createDataFrame(pd.DataFrame(columns), ", ".join(f"{c} long" for c in columns))
    return BoolMatrix(df, len(delimiters) - 1, ncols, encoding)


def from_csr_tables(entries: DataFrame, delimiters: DataFrame, ncols: int, encoding: str = "basic") -> BoolMatrix:
    """A matrix of tables as `to_csr` gives them: entries (place, entry) and rows (row, begin, end), of any size.

    Places and rows meet in blocks of PLACES places: an equality join, whatever the lengths of rows.
    """
    block = lambda c: F.floor(c / PLACES).cast("long")
    rows = delimiters.where("begin < end").select("row", "begin", "end", F.explode(F.sequence(block(F.col("begin")), block(F.col("end") - 1))).alias("_block"))
    placed = entries.select("place", "entry", block(F.col("place")).alias("_block")).join(rows, "_block").where("place >= begin and place < end")
    nrows = delimiters.agg(F.coalesce(F.max("row") + 1, F.lit(0)).alias("n")).first().n
    if encoding == "basic":
        return BoolMatrix(placed.select("row", F.col("entry").alias("col")).distinct(), nrows, ncols, encoding)
    pair = F.floor((F.col("place") - F.col("begin")) / 2).alias("_pair")
    ranges = placed.groupBy("row", pair).agg(F.min("entry").alias("lo"), F.max("entry").alias("hi"))
    return BoolMatrix(ranges.select("row", "lo", "hi"), nrows, ncols, encoding)


def to_csr(m: BoolMatrix) -> tuple[DataFrame, DataFrame]:
    """Tables of compressed sparse rows: (place, entry) and (row, begin, end)."""
    from pyspark.sql import Window

    rows = row_delimiters(m)
    sort = "col" if m.encoding == "basic" else "lo"
    each = 1 if m.encoding == "basic" else 2
    place = (F.row_number().over(Window.partitionBy("row").orderBy(sort)) - 1) * each + F.col("begin")
    placed = m.df.join(rows.select("row", "begin"), "row").withColumn("_at", place)
    if m.encoding == "basic":
        return placed.select(F.col("_at").alias("place"), F.col("col").alias("entry")), rows
    return placed.select(F.inline(F.array(F.struct(F.col("_at").alias("place"), F.col("lo").alias("entry")), F.struct((F.col("_at") + 1).alias("place"), F.col("hi").alias("entry"))))), rows
