"""What rows meet is united before it is shuffled, cells side by side are handled as ranges, and tables between steps are compressed."""

import random

from pyspark.sql import functions as F

from reachspan.functions import ranges as R
from reachspan.matrix import BoolMatrix
from reachspan.operators import algebra as A
from reachspan.operators import dindex as D
from reachspan.operators import graph as G
from reachspan.plans import derived
from reachspan.runtime import cut, parts_for


def cells(df):
    return sorted((r.row, r.lo, r.hi) for r in df.collect())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_intervals_over_many_batches(spark):
    """one pass that keeps one interval between batches, with nested and touching ones and a null row."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 0, 1, 7]), lo := rng.randint(0, 4000), lo + rng.choice([0, 1, 2, 60])) for _ in range(900)]
    want = []
    for row, lo, hi in sorted(rows, key=lambda r: (r[0] is not None, r)[0:1] + ((r[0] or -1), r[1], r[2])):
        if want and want[-1][0] == row and lo <= want[-1][2] + 1:
            want[-1][2] = max(want[-1][2], hi)
        else:
            want.append([row, lo, hi])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = R.coalesce_ranges(spark.createDataFrame(rows, "row long, lo long, hi long"), 5000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))


def test_bucket_goes_to_its_row_united(spark):
    """two shuffles by block and one by row; a third before was for starts."""
    n = 3000
    band = BoolMatrix(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("lo"), F.least(F.col("id") + 9, F.lit(n - 1)).alias("hi")), n, n, "ranges")
    band = BoolMatrix(cut(band.df), n, n, "ranges", True, bound=10)
    for method in ("bucket", "dyadic", "explode", "auto"):
        assert cells(A.multiply(band, band, method).df) == [(i, i, min(i + 18, n - 1)) for i in range(n)]
    product = A.multiply(band, band, "bucket").df
    assert exchanges(product) == 0 or "_b" in product._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in product._jdf.queryExecution().executedPlan().toString()


def test_cells_side_by_side_are_ranges(spark):
    """the index of a chain's cells is made of one range a row, not of eleven cells a row joined at each step."""
    nodes = spark.range(1, 41).select(F.col("id").alias("rank"), "id", F.col("id").cast("string").alias("name"), (F.col("id") % 7).alias("len"))
    g = G.Graph(nodes, spark.range(1, 40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    a = G.adjacency_matrix(g)
    plain = BoolMatrix(a.df, a.nrows, a.ncols, "basic")
    index = D.create_distance_index(a, 2, 12)
    assert index.encoding == "basic" and index.ranges is not None
    want = D.create_distance_index(plain, 2, 12)
    assert want.ranges is None and sorted(index.df.collect()) == sorted(want.df.collect())
    assert sorted(D.compress_distance_index(index, g).df.collect()) == sorted(D.compress_distance_index(want, g).df.collect())
    assert cells(a.to_ranges().df) == cells(plain.to_ranges().df)


def test_rows_dealt_once(spark):
    """intervals of orders are made where the rows are: one shuffle, and no hash table of cells."""
    m = derived.orders_parts(spark, "/root/testdata/sf0.001")
    plan = m.to_ranges().df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan and "Window" not in plan
    assert cells(m.to_ranges().df) == cells(BoolMatrix(m.df, m.nrows, m.ncols, "basic").to_ranges().df)
    assert parts_for(spark, 1) == 1 and parts_for(spark, 100 << 20) == 100


def test_equal_in_one_pass(spark):
    """an interval more or less on either side tells."""
    make = lambda rows: BoolMatrix(spark.createDataFrame(rows, "row long, lo long, hi long"), 9, 9, "ranges")
    a, b, c = make([(0, 1, 2), (3, 4, 4)]), make([(3, 4, 4), (0, 1, 2)]), make([(0, 1, 2)])
    assert a.equals(b) and not a.equals(c) and not c.equals(a) and a.equals(a.to_basic())


def test_tables_between_steps_are_compressed(spark, tmp_path):
    """a million sequential numbers take less than their eight bytes each."""
    df = cut(spark.range(1_000_000).toDF("row"))
    files = df.inputFiles()
    assert files and sum(spark.read.format("binaryFile").load(files).select("length").agg(F.sum("length")).first()) < 4_000_000


def test_buckets_grow_with_rows(spark, monkeypatch):
    """A bucket is one task's: rows that are too many for the usual buckets take more of them."""
    from reachspan import runtime
    from reachspan.plans import queries
    from reachspan.sources import storage

    asked, own = [], storage.save
    monkeypatch.setattr(storage, "save", lambda m, path, buckets: (asked.append(buckets), own(m, path, buckets=buckets))[1])
    monkeypatch.setattr(runtime, "TASK_ROWS", 500)
    assert queries.QUERIES["lookup_stored_buckets"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert asked[0] > 8


def test_following_by_ranges(spark):
    """Events of one type are many tasks' work, with the same result as a window over each type; null types and ranges of one event too."""
    rng = random.Random(5)
    events = spark.createDataFrame([(i, rng.randint(0, 400), rng.choice(["a", "a", "b", None])) for i in range(3000)] + [(3000, 1, "z")], "event_id long, ts long, event_type string")
    want = sorted(tuple(r) for r in derived.following(events, "event_type").collect())
    dealt = derived.following(events, "event_type", 3001, 100)
    assert sorted((tuple(r) for r in dealt.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert "hashpartitioning(event_type" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert derived.following(events.limit(0), "event_type", 3001, 100).count() == 0


def test_blocks_and_sums_keep_bounds(spark):
    """rows that are known to be short are compared in one pass, though the matrix has more columns than a block."""
    n, wide = 50, 1 << (R.COLUMN_BITS + 2)
    cells_ = spark.range(n).select(F.col("id").alias("row"), F.explode(F.array(F.col("id"), F.col("id") + 1, F.col("id") + 9)).alias("col"))
    m = BoolMatrix(cells_, n, wide, "basic", bound=3, ranges=R.to_ranges(cells_, 3))
    larger = A.from_blocks(n + 1, wide, [(m, 0, 0)], "basic")
    more = A.add(larger, A.from_cells(spark.createDataFrame([(n, 0)], "row long, col long"), n + 1, wide, bound=1))
    assert (larger.bound, more.bound) == (3, 4)
    for x in (larger, more):
        assert "Window" not in x.to_ranges().df._jdf.queryExecution().executedPlan().toString()
    assert cells(larger.to_ranges().df) == cells(R.to_ranges(larger.df)) and len(cells(more.to_ranges().df)) == 2 * n + 1
    moved = A.from_blocks(n + 2, wide + 5, [(m, 2, 5)], "basic")
    assert cells(moved.to_ranges().df) == cells(R.to_ranges(moved.df)) == [(r + 2, lo + 5, hi + 5) for r, lo, hi in cells(m.ranges)]
    assert m.equals(m.to_ranges()) and not larger.equals(more) and not m.equals(larger)
    two = A.from_blocks(2 * n, wide, [(m, 0, 0), (m, n, 0)], "basic")
    assert two.ranges is None and two.bound == 6 and len(cells(two.to_ranges().df)) == 4 * n


def test_indices_share_squares(spark, monkeypatch):
    """a second index of a matrix does not make the squares of the first again."""
    n = 40
    a = BoolMatrix(spark.range(n - 1).select(F.col("id").alias("row"), (F.col("id") + 1).alias("lo"), (F.col("id") + 1).alias("hi")), n, n, "ranges", bound=1)
    made, own = [], A._product
    monkeypatch.setattr(A, "_product", lambda *more: (made.append(more), own(*more))[1])
    first, second, third = D.create_distance_index(a, 0, 12), D.create_distance_index(a, 0, 8), D.create_distance_index(a, 3, 18)
    band = lambda low, high: [(i, i + low, min(i + high, n - 1)) for i in range(n - low)]
    assert (cells(first.df), cells(second.df), cells(third.df)) == (band(0, 12), band(0, 8), band(3, 18))
    assert len(made) == 4 + 0 + 3 + 2
