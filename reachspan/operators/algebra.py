"""Boolean matrix algebra: sums are unions, products are joins on the contracted index."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspan.functions.ranges import COLUMN_BITS, coalesce_ranges, united
from reachspan.matrix import BoolMatrix, Sizes
from reachspan.runtime import cut, parts_for


def _same(a: BoolMatrix, b: BoolMatrix) -> None:
    if a.encoding != b.encoding:
        raise TypeError(f"operands are {a.encoding} and {b.encoding}; convert one first")


def identity(spark: SparkSession, n: int, encoding: str = "ranges") -> BoolMatrix:
    ids = spark.range(n)
    names = ("row", "col") if encoding == "basic" else ("row", "lo", "hi")
    return BoolMatrix(ids.select(*(F.col("id").alias(c) for c in names)), n, n, encoding, False, Sizes(n, n, min(n, 1), min(n, 1), min(n, 1), n))


def add(a: BoolMatrix, b: BoolMatrix) -> BoolMatrix:
    """Cells of either."""
    _same(a, b)
    if a.shape != b.shape:
        raise ValueError(f"shapes {a.shape} and {b.shape} differ")
    both = a.df.unionByName(b.df)
    most = min(a.ncols, a.most_entries() + b.most_entries())
    df = both.distinct() if a.encoding == "basic" else coalesce_ranges(both, most)
    return BoolMatrix(df, a.nrows, a.ncols, a.encoding, bound=min(a.ncols, a.most_cells() + b.most_cells()))


#: Two distance indices are merged as they are added.
merge = add

#: Ranges of A that are longer than this are cut into aligned blocks instead of single columns.
BUCKET = 64
#: Average length of A's ranges from which blocks of powers of two are taken, and the most sizes of them.
LONG, MAX_LEVELS = 64, 16


def multiply(a: BoolMatrix, b: BoolMatrix, method: str = "explode") -> BoolMatrix:
    """Boolean product.  Only A is expanded; B's rows stay intervals.

    method: explode joins on each column of A; bucket joins on blocks of up to BUCKET columns with a residual test, and unites what a row meets in a
    block before it is shuffled to its row, if no block is crowded; dyadic joins on aligned
    blocks of powers of two, for which B's rows are united before, so that a long range of A meets few of them.  auto takes dyadic if
    A's ranges are long enough on average and bucket if they are longer than cells, which costs a count of A.  All are equality joins, so Spark can split skewed keys.
    """
    _same(a, b)
    if a.ncols != b.nrows:
        raise ValueError(f"shapes {a.shape} and {b.shape} do not fit")
    bound = min(b.ncols, a.most_cells() * b.most_cells())
    if a.encoding == "basic":
        cells = a.df.select("row", F.col("col").alias("_k")).join(b.df.select(F.col("row").alias("_k"), "col"), "_k").select("row", "col").distinct()
        return BoolMatrix(cells, a.nrows, b.ncols, "basic", bound=bound)
    if method in ("auto", "bucket"):
        a = _written(a, True)
        width = min(BUCKET, 1 << max(2, int(a.sizes.mean).bit_length()))
        if method == "auto":
            method = "dyadic" if a.sizes.mean >= LONG else "bucket" if a.sizes.mean >= COMPACT and _spread(a, width) else "explode"
    right = b.df.select(F.col("row").alias("_k"), "lo", "hi")
    if method == "explode":
        joined = a.df.select("row", F.explode(F.sequence("lo", "hi")).alias("_k")).join(right, "_k")
    elif method == "bucket":
        block = lambda c: F.shiftright(c, width.bit_length() - 1)
        left = a.df.select("row", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.sequence(block("lo"), block("hi"))).alias("_b"))
        right = right.withColumn("_b", block("_k"))
        if _spread(a, width):
            # dealt by block once: what a row meets in a block is made canonical there, before it goes to its row
            parts = parts_for(a.df.sparkSession, a.sizes.cells)
            rows = right.repartition(parts, "_b").sortWithinPartitions("_b", "_k", "lo")
            met = left.repartition(parts, "_b").join(rows.hint("merge"), "_b").where("_k between _lo and _hi")
            joined = united(met.select("row", "lo", "hi"))
        else:
            joined = left.join(right, "_b").where("_k between _lo and _hi")
    elif method == "dyadic":
        levels = _levels(a.measured().longest or 1)
        joined = _cover(a.df, levels).join(_united(b, levels), ["_level", "_b"])
    else:
        raise ValueError(f"unknown method {method!r}")
    # a row of the product has no more intervals than its cells in A have in B: where these are few, one window takes them as they come; else one end for each
    # start and row goes on from every task
    met = a.most_cells() * b.most_entries()
    if met > 1 << COLUMN_BITS:
        joined = joined.groupBy("row", "lo").agg(F.max("hi").alias("hi"))
    return BoolMatrix(coalesce_ranges(joined.select("row", "lo", "hi"), min(b.ncols, met)), a.nrows, b.ncols, "ranges", bound=bound)


#: Ranges that may meet in one block of columns for its products to be one task's.
CROWD = 1 << 16


def _spread(a: BoolMatrix, width: int) -> bool:
    """Whether no block of so many columns is met by more than CROWD ranges."""
    bits = width.bit_length() - 1
    met = a.df.select(F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits))).alias("_b")).groupBy("_b").count()
    return (met.agg(F.max("count").alias("n")).first().n or 0) <= CROWD


def _levels(longest: int) -> int:
    """Levels of blocks that ranges of a length can fill: 1, 2, 4, ... columns."""
    return min(MAX_LEVELS, longest.bit_length() - 1)


def _cover(ranges: DataFrame, levels: int) -> DataFrame:
    """row, _level, _b: the fewest aligned blocks of 1, 2, 4, ... columns that make up each range."""
    lo, hi, blocks = F.col("lo"), F.col("hi"), []
    for level in range(levels):
        part = lambda b, level=level: F.struct(F.lit(level).alias("_level"), b.alias("_b"))
        odd, even = (lo <= hi) & (lo % 2 == 1), (lo <= hi) & (hi % 2 == 0)
        # a block that is both ends is taken once: if odd then at the lower end, if even at the upper
        blocks += [F.when(odd, F.array(part(lo))), F.when(even, F.array(part(hi)))]
        lo, hi = F.shiftright(lo + 1, 1), F.shiftright(hi - 1, 1)
    top = F.when(lo <= hi, F.transform(F.sequence(F.least(lo, hi), hi), lambda b: F.struct(F.lit(levels).alias("_level"), b.alias("_b"))))
    none = F.array().cast("array<struct<_level:int,_b:bigint>>")
    return ranges.select("row", F.inline(F.concat(*(F.coalesce(b, none) for b in [*blocks, top]))))


def _united(m: BoolMatrix, levels: int) -> DataFrame:
    """_level, _b, lo, hi: the union of the rows of each block, level by level from the one below."""
    level = m.df.select(F.lit(0).alias("_level"), F.col("row").alias("_b"), "lo", "hi")
    out, most = level, m.measured().fullest
    for n in range(1, levels + 1):
        merged = coalesce_ranges(level.select(F.shiftright("_b", 1).alias("row"), "lo", "hi"), min(m.ncols, most << n))
        level = cut(merged.select(F.lit(n).alias("_level"), F.col("row").alias("_b"), "lo", "hi"))
        out = out.unionByName(level)
    return out


#: Cells of an average range under which cells are kept as they are between products, while a row has at most so many.
COMPACT, FEW = 1.5, 64


def power(a: BoolMatrix, k: int, keep: bool = True) -> BoolMatrix:
    """A multiplied k times, by squaring; A**0 is the identity.  Every product is written, so plans stay short; the last one if it is to be kept, not if it is read once.

    Ranges that are hardly longer than cells are multiplied as cells until rows fill; only the last product makes intervals.
    """
    if a.nrows != a.ncols:
        raise ValueError("only square matrices have powers")
    if k < 0:
        raise ValueError("the exponent is not negative")
    if k == 0:
        return identity(a.df.sparkSession, a.nrows, a.encoding)
    if k == 1:
        return a
    encoding, result = a.encoding, None
    square = a = _written(a, True)
    if encoding == "ranges" and a.sizes.mean < COMPACT:
        square = _written(a.to_basic(), True)
    while True:
        if k & 1:
            result = square if result is None else _product(result, square, k == 1, encoding, keep or k > 1)
        k >>= 1
        if not k:
            return result
        # squares of ranges that another power has written are not made again
        found = square.known.get("square")
        if found is None:
            found = _product(square, square, k == 1 and result is None, encoding, keep or k > 1 or result is not None)
            if found.held and square.encoding == "ranges":
                square.known["square"] = found
        square = found


def with_identity(a: BoolMatrix) -> BoolMatrix:
    """A + I on disk, made once."""
    if "looped" not in a.known:
        a.known["looped"] = _written(add(a, identity(a.df.sparkSession, a.nrows, a.encoding)))
    return a.known["looped"]


def _product(a: BoolMatrix, b: BoolMatrix, last: bool, encoding: str, keep: bool) -> BoolMatrix:
    """A product (written, if it is kept) of a power, in its encoding if it is the last or if rows have filled."""
    if encoding == "ranges" and (last or "ranges" in (a.encoding, b.encoding) or max(a.measured().cells, b.measured().cells) > FEW * max(a.nrows, 1)):
        a, b = _as_ranges(a), _as_ranges(b)
        a.measured(), b.measured()
    product = multiply(a, b, "auto")
    return _written(product) if keep else product


def _as_ranges(m: BoolMatrix) -> BoolMatrix:
    """Cells as ranges of one column, which may be adjacent: for operands only, as products come out canonical."""
    if m.encoding == "ranges":
        return m
    return BoolMatrix(m.df.select("row", F.col("col").alias("lo"), F.col("col").alias("hi")), m.nrows, m.ncols, "ranges", m.held, m.measured(), m.bound)


def _written(m: BoolMatrix, measure: bool = False) -> BoolMatrix:
    """The matrix on disk, with its sizes if asked for; one that stands there is not written again."""
    if not m.held:
        if "written" not in m.known:
            ranges = cut(m.ranges) if m.ranges is not None else None
            m.known["written"] = BoolMatrix(cut(m.df), m.nrows, m.ncols, m.encoding, True, bound=m.bound, ranges=ranges)
        m = m.known["written"]
    if measure:
        m.measured()
    return m


def shift(m: BoolMatrix, rows: int, cols: int) -> DataFrame:
    """The relation with all rows and columns moved."""
    return m.df.select(*((F.col(c) + (rows if c == "row" else cols)).alias(c) for c in m.df.columns))


def from_blocks(nrows: int, ncols: int, blocks: Iterable[tuple[BoolMatrix, int, int]], encoding: str = "ranges") -> BoolMatrix:
    """A matrix of blocks (matrix, first row, first column) that do not overlap, in any order; all else is false."""
    parts, bound, ranges = [], 0, None
    for m, row, col in blocks:
        if row < 0 or col < 0 or row + m.nrows > nrows or col + m.ncols > ncols:
            raise ValueError("a block reaches beyond the matrix")
        parts.append(shift(m.to_basic() if encoding == "basic" else m.to_ranges(), row, col))
        bound += m.most_cells()
        ranges = None if m.ranges is None else shift(m.to_ranges(), row, col)
    if not parts:
        raise ValueError("there are no blocks")
    if encoding != "basic" or len(parts) > 1:
        ranges = None
    while len(parts) > 1:  # pairwise, so that the plan stays shallow
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else [])
    return BoolMatrix(parts[0], nrows, ncols, encoding, bound=min(bound, ncols), ranges=ranges)


def from_provider(corners: DataFrame, provider: Callable[..., Iterable[tuple[int, int, int]]], nrows: int, ncols: int) -> BoolMatrix:
    """A matrix of blocks that a function makes on the executors: one call for each row of `corners`, whose columns are its arguments.

    The first two arguments are a block's first row and column; it gives ranges (row, lo, hi) counted from there, one at a time.  Blocks do not overlap; a range beyond the
    matrix is an error when it runs.  The driver sees neither corners nor blocks.
    """

    class Blocks:
        def eval(self, row: int, col: int, *more):
            for r, lo, hi in provider(row, col, *more):
                if not (0 <= row + r < nrows and 0 <= col + lo <= col + hi < ncols):
                    raise ValueError("a block reaches beyond the matrix")
                yield row + r, col + lo, col + hi

    made = F.udtf(Blocks, returnType="row long, lo long, hi long")
    names = [f"_{i}" for i in range(len(corners.columns))]
    blocks = corners.toDF(*names).lateralJoin(made(*(F.col(c).outer() for c in names)))
    return BoolMatrix(blocks.select("row", "lo", "hi"), nrows, ncols, "ranges")


def from_cells(df: DataFrame, nrows: int, ncols: int, row: str = "row", col: str = "col", bound: int | None = None) -> BoolMatrix:
    """A matrix of any table of cells, of which a row has at most `bound`, if that is known; repeated cells count once, cells outside of the shape are an error when it runs."""
    cells = df.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col")).where("row is not null and col is not null")
    inside = (F.col("row").between(0, nrows - 1)) & (F.col("col").between(0, ncols - 1))
    checked = cells.select("col", F.when(inside, F.col("row")).otherwise(F.raise_error(F.lit("a cell lies outside of the matrix")).cast("long")).alias("row"))
    return BoolMatrix(checked.distinct(), nrows, ncols, "basic", bound=bound)
