"""Distance index: D[i, j] is true where some walk from i to j has between d1 and d2 steps, both included."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachspan.functions.ranges import COLUMN_BITS, carried, coalesce_ranges, to_basic, to_ranges
from reachspan.matrix import BoolMatrix
from reachspan.operators.algebra import COMPACT, _written, identity, multiply, power, with_identity
from reachspan.operators.graph import Graph, locus_offsets


#: Loci that meet their nodes at once, as a power of two.
BLOCK_BITS = 6


#: Rows that a job may as well handle for what it costs to start; entries that a size estimate looks at; bits of its sketches.
JOB_ROWS, SAMPLED, SKETCH_BITS = 200_000, 100_000, 12
#: Steps of more than this are never taken one by one.
MAX_STEPS = 32


def create_distance_index(a: BoolMatrix, d1: int, d2: int, method: str = "auto", keep: bool = True) -> BoolMatrix:
    """A**d1 (A + I)**(d2 - d1), in the encoding of A; written, unless it is read once and so not to be kept.

    method: doubling takes log2(d1) + log2(d2 - d1) products and one more; steps takes the second factor one step at a time, over
    the pairs that the step before has found first; auto estimates which of them makes fewer rows (`steps_pay`).
    """
    if not 0 <= d1 <= d2 or d2 == 0:
        raise ValueError("bounds need 0 <= d1 <= d2 and d2 > 0")
    if a.nrows != a.ncols:
        raise ValueError("an adjacency matrix is square")
    if method not in ("auto", "doubling", "steps"):
        raise ValueError(f"unknown method {method!r}")
    more = d2 - d1
    if a.encoding == "basic" and method != "steps" and (a.held or a.ranges is not None):
        # cells that stand side by side are few ranges, and stay few by squaring
        ranges = _written(a.to_ranges()) if a.ranges is not None else None
        if ranges is not None and more and _long(ranges):
            cells = create_distance_index(ranges, d1, d2, method, keep)
            return BoolMatrix(to_basic(cells.df), a.nrows, a.ncols, "basic", cells.held, bound=cells.bound, ranges=cells.df)
        a = BoolMatrix(a.df, a.nrows, a.ncols, "basic", a.held, a.sizes, a.bound)
    a = _written(a)
    if more == 0:
        return power(a, d1, keep)
    if more > 1 and (method == "steps" or method == "auto" and steps_pay(a, more, d1)):
        return _stepped(a, d1, more, keep)
    up = power(with_identity(a), more, keep or d1 > 0)
    if d1 == 0:
        return _written(up) if keep else up
    product = multiply(_written(power(a, d1), True), _written(up, True), "auto")
    return _written(product) if keep else product


def _long(a: BoolMatrix) -> bool:
    """Whether the ranges of A + I are longer than cells; entries that touch the diagonal become one with it."""
    sizes, rows = a.measured(), max(a.nrows, 1)
    return sizes.cells + rows >= COMPACT * (sizes.entries + rows - sizes.touching)


def product_size(a: BoolMatrix, b: BoolMatrix) -> float:
    """About how many cells the product of two matrices has.

    The product's cells are only counted, by a distinct-count sketch for each block of rows, which merge within and across tasks: no cell is shuffled
    after the join.  A large left operand is judged by the rows whose hashes choose them, about SAMPLED of its entries.
    """
    every = max(1, a.measured().entries // SAMPLED)
    left = a.to_basic().df.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("row", F.col("col").alias("_k"))
    joined = left.join(b.to_basic().df.select(F.col("row").alias("_k"), "col"), "_k")
    sketches = joined.groupBy(F.shiftright("row", 16).alias("_rows")).agg(F.hll_sketch_agg(F.xxhash64("row", "col"), SKETCH_BITS).alias("sketch"))
    return every * (sketches.agg(F.sum(F.hll_sketch_estimate("sketch")).alias("n")).first().n or 0)


def steps_pay(a: BoolMatrix, steps: int, before: int = 0) -> bool:
    """Whether A**before (A + I)**steps is cheaper by single steps from A**before than by squaring A + I and one product more.

    Long ranges stay few by squaring.  Of other matrices up to three steps take no more products than squaring, and smaller ones.  For more steps, the cells a row at one and at
    two steps give the power by which they grow, and so the rows that each way joins and compares.
    """
    sizes, rows = a.measured(), max(a.nrows, 1)
    if steps > MAX_STEPS or not sizes.entries:
        return False
    if a.encoding == "ranges" and _long(a):
        return False
    if steps <= 3:
        return True
    one = sizes.cells / rows
    growth = math.log2(1 + product_size(a, a) / rows / one)
    size = lambda t: 1 + one * t**growth if t > 0 else float(t == 0)
    exactly = lambda t: size(t) - size(t - 1)
    first = max(before, 1)
    stepping = sum(exactly(t) * one + size(t) for t in range(first, before + steps)) * rows + 2 * JOB_ROWS * (before + steps - first)
    squaring, done, t, k = exactly(before) * size(steps) * rows + JOB_ROWS if before else 0.0, 0, 1, steps
    while k:
        if k & 1:
            squaring += size(done) * size(t) * rows + JOB_ROWS if done else 0
            done += t
        k >>= 1
        squaring += size(t) ** 2 * rows + JOB_ROWS if k else 0
        t *= 2
    return stepping < squaring


def _stepped(a: BoolMatrix, d1: int, more: int, keep: bool = True) -> BoolMatrix:
    """A**d1 (A + I)**more by cells: each step goes on from the pairs that were not there before it."""
    step, width = a.to_basic(), a.measured().widest
    # how many cells a row can have is worth an aggregate a step only where the columns do not bound it
    fullest = lambda m: m.measured().fullest if a.ncols > 1 << COLUMN_BITS else a.ncols
    if d1 == 0:
        # no step and one step
        found = identity(a.df.sparkSession, a.nrows, "basic").df
        new = step.with_df(step.df.where("row <> col"))
        found, more, most = found.unionByName(new.df), more - 1, 1 + width
    else:
        new = _written(power(step, d1))
        found, most = new.df, fullest(new)
    for left in range(more, 0, -1):
        if left == 1 and a.encoding == "ranges":
            # intervals are made of all of them, so the last step need tell neither new nor equal ones
            found, most = found.unionByName(reached(new, step)), most + width * (width if new.sizes is None and not new.held else fullest(new))
            break
        new = _written(step.with_df(reached(new, step).distinct().join(found, ["row", "col"], "left_anti")))
        if new.df.isEmpty():
            break
        found, most = found.unionByName(new.df), most + fullest(new)
    most = min(most, a.ncols)
    index = BoolMatrix(found if a.encoding == "basic" else to_ranges(found, most), a.nrows, a.ncols, a.encoding, bound=most)
    return _written(index) if keep else index


def reached(pairs: BoolMatrix, step: BoolMatrix) -> DataFrame:
    """Cells one step behind those of pairs, repeated ones too."""
    return pairs.df.select("row", F.col("col").alias("_k")).join(step.df.select(F.col("row").alias("_k"), "col"), "_k").select("row", "col")


def compress_distance_index(index: BoolMatrix, graph: Graph) -> BoolMatrix:
    """Without the pairs of which both lie in one node; for a whole-graph index, in either encoding."""
    if index.encoding == "basic" and index.ranges is not None:
        # cells are made of what is left of their ranges
        rest = compress_distance_index(BoolMatrix(index.ranges, index.nrows, index.ncols, "ranges"), graph).df
        return BoolMatrix(to_basic(rest), index.nrows, index.ncols, "basic", bound=index.bound, ranges=rest)
    # nodes and rows meet in blocks of loci, so that nodes are not expanded
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    ends = locus_offsets(graph).where("len > 0").select(F.col("start").alias("_from"), (F.col("start") + F.col("len") - 1).alias("_to"))
    of_block = ends.select("_from", "_to", F.explode(F.sequence(block("_from"), block("_to"))).alias("_block"))
    joined = index.df.withColumn("_block", block("row")).join(of_block, "_block").where("row between _from and _to")
    if index.encoding == "basic":
        return index.with_df(joined.where(~F.col("col").between(F.col("_from"), F.col("_to"))).select("row", "col"))
    before = F.struct(F.col("lo"), F.least("hi", F.col("_from") - 1).alias("hi"))
    after = F.struct(F.greatest("lo", F.col("_to") + 1).alias("lo"), F.col("hi"))
    return index.with_df(joined.select("row", F.inline(F.array(before, after))).where("lo <= hi"))


#: Columns of a block of lookups, as a power of two, and intervals of one row from which rows are cut into blocks.
LOOKUP_BITS, HUB = 16, 4096


def query(index: BoolMatrix, pairs: DataFrame, out_of_range: str = "false", method: str = "auto") -> DataFrame:
    """pairs (i, j) with `hit`; repeated pairs are answered each, pairs with a null are false.

    out_of_range: `false` answers false beyond the shape, `raise` fails when it runs.
    method: join is one join on the row; a row with m intervals and n pairs takes m * n tests.  asof sorts both by place and takes the last interval
    that starts before a pair, by blocks of columns.  auto takes asof if some row has more than HUB intervals, which costs a count by rows; streams and cells are joined.
    """
    if out_of_range not in ("false", "raise"):
        raise ValueError(f"unknown choice {out_of_range!r}")
    if method not in ("auto", "join", "asof"):
        raise ValueError(f"unknown method {method!r}")
    asked = pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    if out_of_range == "raise":
        inside = F.col("i").between(0, index.nrows - 1) & F.col("j").between(0, index.ncols - 1)
        asked = asked.withColumn("i", F.when(inside, F.col("i")).otherwise(F.raise_error(F.lit("index out of range")).cast("long")))
    if _by_place(index, pairs, method):
        return asof(index, asked)
    on = (F.col("row") == F.col("i")) & (F.col("col") == F.col("j") if index.encoding == "basic" else F.col("j").between(F.col("lo"), F.col("hi")))
    return asked.join(index.df, on, "left").select("i", "j", F.col("row").isNotNull().alias("hit"))


def _by_place(index: BoolMatrix, pairs: DataFrame, method: str) -> bool:
    if index.encoding == "basic" or pairs.isStreaming or method == "join":
        return False
    if method == "auto" and index.most_entries() <= HUB:
        return False
    return method == "asof" or (index.df.groupBy("row").count().agg(F.max("count").alias("n")).first().n or 0) > HUB


def asof(index: BoolMatrix, pairs: DataFrame, bits: int = LOOKUP_BITS) -> DataFrame:
    """i, j, hit of pairs (i, j) by an as-of join with an index of ranges.

    Intervals and distinct pairs are united and sorted by place within (row, block of 2**bits columns), so no key holds more than a block's columns
    twice, however many intervals or pairs a row has.  Intervals are disjoint: only the last one that starts before a pair can hold it.  If none starts
    within the block, it is the last of the blocks before, of which each block knows how far it reaches.
    """
    asked = pairs.groupBy("i", "j").agg(F.count("*").alias("n"))
    starts = index.df.select("row", F.col("lo").alias("place"), "hi", F.lit(0).cast("long").alias("n"))
    points = asked.select(F.col("i").alias("row"), F.col("j").alias("place"), F.lit(None).cast("long").alias("hi"), "n")
    both = starts.unionByName(points).withColumn("_block", F.shiftright("place", bits))
    # at one place the interval comes first, as its n is 0
    upto = Window.partitionBy("row", "_block").orderBy("place", "n").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_reach", F.max("hi").over(upto)).where("n > 0")
    reach = carried(both, "hi").select(F.col("row").alias("_row"), F.col("_block").alias("_of"), "_carry")
    told = placed.join(reach, (F.col("row") == F.col("_row")) & (F.col("_block") == F.col("_of")), "left")
    hit = F.coalesce(F.greatest("_reach", "_carry") >= F.col("place"), F.lit(False))
    # copies of a pair in two steps, so that no array is longer than the root of their number
    root = F.ceil(F.sqrt("n")).cast("long")
    some = told.select(F.col("row").alias("i"), F.col("place").alias("j"), hit.alias("hit"), "n", root.alias("root"), F.explode(F.sequence(F.lit(0), root - 1)).alias("part"))
    many = some.withColumn("copies", F.least("root", F.col("n") - F.col("part") * F.col("root"))).where("copies > 0")
    return many.select("i", "j", "hit", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def hits(index: BoolMatrix, pairs: DataFrame, method: str = "auto") -> DataFrame:
    """The pairs that are true, with all their columns; methods as in `query`."""
    if _by_place(index, pairs, method):
        asked = pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct()
        return pairs.join(asof(index, asked).where("hit").select("i", "j"), ["i", "j"], "left_semi")
    on = (F.col("row") == F.col("i")) & (F.col("col") == F.col("j") if index.encoding == "basic" else F.col("j").between(F.col("lo"), F.col("hi")))
    return pairs.join(index.df, on, "left_semi")


def at(index: BoolMatrix, i: int, j: int) -> bool:
    """One cell; IndexError beyond the shape.  The filter on the row reaches a stored index's scan."""
    if not (0 <= i < index.nrows and 0 <= j < index.ncols):
        raise IndexError("index out of range")
    row = index.df.where(F.col("row") == i)
    return not row.where(F.col("col") == j if index.encoding == "basic" else F.lit(j).between(F.col("lo"), F.col("hi"))).isEmpty()


def stepwise_index(a: BoolMatrix, d1: int, d2: int) -> BoolMatrix:
    """The same index by one product of cells a step: the plain way, to check and to compare with."""
    step = power(a.to_basic(), d1)
    found = step
    for _ in range(d2 - d1):
        step = _written(multiply(step, a.to_basic()))
        found = found.with_df(found.df.unionByName(step.df))
    return found.with_df(coalesce_ranges(found.df.select("row", F.col("col").alias("lo"), F.col("col").alias("hi")), a.ncols), "ranges")
