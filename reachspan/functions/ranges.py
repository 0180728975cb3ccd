"""Conversions between cells and intervals, as window and generator expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachspan.matrix import BoolMatrix


#: Columns of one block of a row, as a power of two: a row's block holds at most half as many intervals apart.
COLUMN_BITS = 18


_NONE = np.iinfo(np.int64).min


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals (keys..., lo, hi) of which those are united that follow each other with equal keys and growing lo, and overlap, nest or touch.

    Only the last interval is kept from batch to batch.
    """
    open_ = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.fill_null(_NONE).to_numpy(zero_copy_only=False) for c in batch.columns]
        if open_ is not None:
            columns = [np.concatenate([o, c]) for o, c in zip(open_, columns, strict=True)]
        *keys, lo, hi = columns
        fresh = lo[1:] < lo[:-1]
        for key in keys:
            fresh |= key[1:] != key[:-1]
        group = np.concatenate([[0], np.cumsum(fresh)])
        # the largest end so far, not the end before, tells where a new interval begins, as intervals may be nested
        longest, far, step = int(np.bincount(group).max()), hi, 1
        while step < longest:
            far = np.concatenate([far[:step], np.where(group[step:] == group[:-step], np.maximum(far[step:], far[:-step]), far[step:])])
            step *= 2
        first = np.flatnonzero(np.concatenate([[True], fresh | (lo[1:] > far[:-1] + 1)]))
        last = np.concatenate([first[1:] - 1, [len(lo) - 1]])
        made = [*(c[first] for c in (*keys, lo)), far[last]]
        yield _batch([c[:-1] for c in made], batch.schema)
        open_, schema = [c[-1:] for c in made], batch.schema
    if open_ is not None:
        yield _batch(open_, schema)


def _batch(columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=c == _NONE) for c in columns], names=schema.names)


def united(df: DataFrame) -> DataFrame:
    """df (keys..., lo, hi) of which neighbours within a task are united; canonical, if tasks hold whole keys, sorted by keys, lo and hi."""
    longs = df.select(*(F.col(c).cast("long").alias(c) for c in df.columns))
    return longs.mapInArrow(_unite, ", ".join(f"{c} long" for c in df.columns))


def _coalesced(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """Canonical intervals within each group of keys: one shuffle (none, if keys are dealt to tasks already), one sort, and a pass that holds one interval."""
    own = df.select(*keys, "lo", "hi")
    return united((own if dealt else own.repartition(*keys)).sortWithinPartitions(*keys, "lo", "hi"))


def carried(df: DataFrame, end: str) -> DataFrame:
    """row, _block, _end, _carry: of each row's blocks the largest end, and that of all blocks before; one row a block, not an interval."""
    ends = df.groupBy("row", "_block").agg(F.max(end).alias("_end"))
    before = Window.partitionBy("row").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("row", "_block", "_end", F.max("_end").over(before).alias("_carry"))


def coalesce_ranges(df: DataFrame, most: int | None = None, bits: int = COLUMN_BITS, dealt: bool = False) -> DataFrame:
    """Canonical intervals of each row: overlapping, nested and adjacent ones become one.

    most: intervals that one row can have, where that is known; the number of columns bounds it, too.  Up to 2**bits of them a row is one task's, in one pass; `dealt` rows are where they belong.  Else rows
    are cut into blocks of 2**bits columns by where intervals begin, so that a
    row with many intervals is the work of many tasks: intervals are made canonical within blocks; then each block learns how far those before it
    reach.  What lies within that reach is dropped, what begins beyond it and is not its block's last is done, and the rest, at most two intervals a
    block, is stitched by a second pass.
    """
    if most is not None and most <= 1 << bits:
        return _coalesced(df, "row", dealt=dealt)
    own = _coalesced(df.select("row", "lo", "hi", F.shiftright("lo", bits).alias("_block")), "row", "_block")
    told = own.join(carried(own, "hi"), ["row", "_block"]).where("_carry is null or hi > _carry")
    done = (F.col("_carry").isNull() | (F.col("lo") > F.col("_carry") + 1)) & (F.col("hi") < F.col("_end"))
    return told.where(done).select("row", "lo", "hi").unionByName(_coalesced(told.where(~done), "row"))


def to_ranges(df: DataFrame, most: int | None = None, dealt: bool = False) -> DataFrame:
    """Intervals of cells (row, col), of which a row has at most `most`; repeated cells count once."""
    return coalesce_ranges(df.select("row", F.col("col").alias("lo"), F.col("col").alias("hi")), most, dealt=dealt)


def to_basic(df: DataFrame) -> DataFrame:
    """Cells of canonical intervals."""
    return df.select("row", F.explode(F.sequence("lo", "hi")).alias("col"))


def nnz(m: BoolMatrix) -> DataFrame:
    """One row, nnz."""
    cells = F.count("*") if m.encoding == "basic" else F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0))
    return m.df.agg(cells.cast("long").alias("nnz"))


def stats(m: BoolMatrix) -> DataFrame:
    """One row: ranges, nnz, ranges per row, cells per range, bandwidth (largest |col - row|)."""
    far = F.greatest(F.abs(F.col("lo") - F.col("row")), F.abs(F.col("hi") - F.col("row")))
    return m.to_ranges().df.agg(
        F.count("*").alias("ranges"), F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).cast("long").alias("nnz"),
        (F.count("*") / F.lit(max(m.nrows, 1))).alias("ranges_per_row"), (F.sum(F.col("hi") - F.col("lo") + 1) / F.count("*")).alias("nnz_per_range"), F.coalesce(F.max(far), F.lit(0)).alias("bandwidth"),
    )


def row_bands(m: BoolMatrix) -> DataFrame:
    """row, first and last column of each row that has any."""
    lo, hi = ("col", "col") if m.encoding == "basic" else ("lo", "hi")
    return m.df.groupBy("row").agg(F.min(lo).alias("first"), F.max(hi).alias("last"))


def packed(m: BoolMatrix) -> DataFrame:
    """row, ranges: sorted array of (lo, hi), for display and export; a row's intervals are one value."""
    return m.to_ranges().df.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def rendered(m: BoolMatrix) -> DataFrame:
    """row, text: `row: (lo, hi) (lo, hi)` for each row that has any."""
    parts = F.transform("ranges", lambda r: F.format_string("(%d, %d)", r["lo"], r["hi"]))
    return packed(m).select("row", F.concat(F.col("row").cast("string"), F.lit(": "), F.array_join(parts, " ")).alias("text"))


def rendered_values(cells: DataFrame) -> DataFrame:
    """row, text: `row: (col, value) (col, value)` for each row of cells with values."""
    held = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("cells"))
    parts = F.transform("cells", lambda c: F.concat(F.lit("("), c["col"].cast("string"), F.lit(", "), c["value"].cast("string"), F.lit(")")))
    return held.select("row", F.concat(F.col("row").cast("string"), F.lit(": "), F.array_join(parts, " ")).alias("text"))


def row_of(m: BoolMatrix, row: int) -> DataFrame:
    """The entries of one row."""
    return m.df.where(F.col("row") == row).drop("row")


def row_delimiters(m: BoolMatrix) -> DataFrame:
    """row, begin, end: places of each row's entries in a flat array, as compressed sparse rows have them; two entries a range.

    Rows are numbered through in blocks, whose totals are summed first, so that no task sees all rows.
    """
    each = 2 if m.encoding == "ranges" else 1
    spark = m.df.sparkSession
    counts = m.df.groupBy("row").agg((F.count("*") * each).alias("n"))
    rows = spark.range(m.nrows).select(F.col("id").alias("row")).join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return prefix_sum(rows, "row", "n").select("row", F.col("before").alias("begin"), (F.col("before") + F.col("n")).alias("end"))


BLOCK_BITS = 16


def prefix_sum(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with `before`: the sum of `value` over all rows of smaller `order`, a distinct long.

    Within blocks of 2**16 numbers by window, across blocks by the blocks' sums: only those pass one task.
    """
    block = F.shiftright(order, BLOCK_BITS)
    sums = df.groupBy(block.alias("_block")).agg(F.sum(value).alias("_sum"))
    lead = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lead"))
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = df.withColumn("_block", block).withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return held.join(lead, "_block").withColumn("before", (F.col("_own") + F.col("_lead")).cast("long")).drop("_block", "_own", "_lead")
