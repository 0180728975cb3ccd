"""Long rows, planned indices, samples, buckets and blocks made on executors: that work is spread, and that results do not depend on how."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reachspan.functions import ranges as R
from reachspan.matrix import BoolMatrix
from reachspan.operators import algebra as A
from reachspan.operators import dindex as D
from reachspan.sources import generate, gfa, storage


@pytest.fixture
def setting(spark):
    old = {}

    def put(key, value):
        old.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def intervals(df):
    return sorted((r.row, r.lo, r.hi) for r in df.collect())


def plain_coalesced(rows):
    out = []
    for row, lo, hi in sorted(rows):
        if out and out[-1][0] == row and lo <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], hi)
        else:
            out.append([row, lo, hi])
    return [tuple(r) for r in out]


def test_coalescing_by_blocks(spark):
    """Intervals that nest, touch and reach over many blocks."""
    rng = random.Random(1)
    rows = []
    for row in range(60):
        for _ in range(rng.randint(0, 40)):
            lo = rng.randint(0, 300)
            rows.append((row, lo, lo + rng.choice([0, 0, 1, 2, 5, 30, 200])))
    df = spark.createDataFrame(rows, "row long, lo long, hi long")
    for bits in (0, 2, 4, 8, 12):
        assert intervals(R.coalesce_ranges(df, bits=bits)) == plain_coalesced(rows)
    assert R.coalesce_ranges(df.limit(0), bits=2).count() == 0


def test_row_of_five_million_intervals(spark, setting):
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.shuffle.partitions", "16")
    # every second interval touches the next one
    df = spark.range(5_000_000).select(F.lit(0).alias("row"), (F.col("id") * 4).alias("lo"), (F.col("id") * 4 + F.when(F.col("id") % 2 == 0, 3).otherwise(1)).alias("hi"))
    out = R.coalesce_ranges(df, 20_000_000)
    tasks = {r.part: r["count"] for r in out.groupBy(F.spark_partition_id().alias("part")).count().collect()}
    assert sum(tasks.values()) == 2_500_000 and len(tasks) >= 16 and max(tasks.values()) < 700_000
    total = out.agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi")).first()
    assert (total.lo, total.hi) == (8 * sum(range(2_500_000)), 8 * sum(range(2_500_000)) + 5 * 2_500_000)


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_asof(spark, bits):
    rng = random.Random(2)
    rows = plain_coalesced([(rng.choice([0, 0, 0, 1, 5]), lo := rng.randint(0, 900), lo + rng.choice([0, 1, 3, 70])) for _ in range(120)])
    index = BoolMatrix(spark.createDataFrame(rows, "row long, lo long, hi long"), 6, 1000, "ranges")
    pairs = [(rng.choice([0, 0, 1, 2, 5, 9, -1, None]), rng.choice([rng.randint(-3, 1005), None])) for _ in range(1500)] + [(0, 5)] * 999
    df = spark.createDataFrame(pairs, "i long, j long")
    held = lambda i, j: i is not None and j is not None and any(r == i and lo <= j <= hi for r, lo, hi in rows)
    got = sorted((str(r.i), str(r.j), r.hit) for r in D.asof(index, df, bits).collect())
    assert got == sorted((str(i), str(j), held(i, j)) for i, j in pairs)
    more = df.withColumn("_i", F.lit(7))
    assert D.hits(index, more, "asof").count() == D.hits(index, more, "join").count() == sum(held(i, j) for i, j in pairs)
    assert D.asof(index.with_df(index.df.limit(0)), df).where("hit").isEmpty() and D.asof(index, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        D.query(index, df, method="best")


def test_hub_row_of_lookups(spark, setting):
    """A hundred thousand intervals and a million pairs in one row: no key holds more than a block, and auto finds out."""
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.shuffle.partitions", "16")
    index = BoolMatrix(spark.range(100_000).select(F.lit(0).alias("row"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 4).alias("hi")), 1, 1_000_000, "ranges")
    pairs = spark.range(1_000_000).select(F.lit(0).alias("i"), ((F.col("id") * 7) % 1_000_000).alias("j"))
    answered = D.query(index, pairs)
    plan = answered._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(row#\d+L?, _block#\d+L?", plan) and not re.search("SinglePartition|CartesianProduct|NestedLoop", plan)
    told = answered.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.bool_and(F.col("hit") == (F.col("j") % 10 <= 4)).alias("right")).first()
    assert (told.n, told.hits, told.right) == (1_000_000, 500_000, True)


def small_graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("encoding", ["basic", "ranges"])
@pytest.mark.parametrize("bounds", [(0, 1), (0, 4), (1, 3), (2, 6), (3, 3)])
def test_steps_and_doubling_agree(spark, encoding, bounds):
    cells = small_graph(4, 25, 40)
    a = BoolMatrix(spark.createDataFrame(cells, "row long, col long"), 25, 25, "basic")
    a = a if encoding == "basic" else a.to_ranges()
    want = {(i, i) for i in range(25)} if bounds[0] == 0 else set()
    walk = {(i, i) for i in range(25)}
    for k in range(1, bounds[1] + 1):
        walk = {(i, c) for i, j in walk for r, c in cells if r == j}
        want |= walk if k >= bounds[0] else set()
    for method in ("steps", "doubling", "auto"):
        d = D.create_distance_index(a, *bounds, method)
        assert d.encoding == encoding
        got = [tuple(r) for r in d.to_basic().df.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        if encoding == "ranges":
            assert intervals(d.df) == plain_coalesced(intervals(d.df))


def test_plan_of_an_index(spark, monkeypatch):
    n = 400
    chain = BoolMatrix(spark.range(n - 1).select(F.col("id").alias("row"), (F.col("id") + 1).alias("col")), n, n, "basic").to_ranges()
    rng = random.Random(5)
    spread = BoolMatrix(spark.createDataFrame(sorted({(i, rng.randrange(n)) for i in range(n) for _ in range(2)}), "row long, col long"), n, n, "basic").to_ranges()
    assert not D.steps_pay(chain, 8) and not D.steps_pay(spread, D.MAX_STEPS + 1)
    # steps cost jobs, so that they pay on large matrices only
    assert not D.steps_pay(spread, 8)
    monkeypatch.setattr(D, "JOB_ROWS", 0)
    assert D.steps_pay(spread, 4) and not D.steps_pay(chain, 4)
    assert D.steps_pay(spread, 3, 2) and not D.steps_pay(chain, 3)


def test_product_size(spark, monkeypatch):
    cells = small_graph(6, 3000, 9000)
    a = BoolMatrix(spark.createDataFrame(cells, "row long, col long"), 3000, 3000, "basic")
    true = A.multiply(a, a).nnz()
    assert abs(D.product_size(a, a) - true) < 0.05 * true
    monkeypatch.setattr(D, "SAMPLED", 2000)
    assert abs(D.product_size(a, a) - true) < 0.2 * true
    assert D.product_size(a.with_df(a.df.limit(0)), a) == 0


def test_written_matrices_know_their_sizes(spark):
    m = A._written(BoolMatrix(spark.createDataFrame([(0, 0, 4), (1, 2, 2), (1, 4, 4)], "row long, lo long, hi long"), 3, 5, "ranges"), True)
    assert (m.sizes.entries, m.sizes.cells, m.sizes.longest, m.sizes.fullest, m.sizes.widest, m.sizes.touching) == (3, 7, 5, 2, 5, 2) and A._written(m) is m
    assert m.with_df(m.df.limit(1)).sizes is None and m.with_df(m.df.limit(0)).measured().mean == 0


@pytest.mark.parametrize("size", [(0, 0), (7, 0), (7, 49), (50, 1234), (300_000, 5000), (2000, 300_000)])
def test_samples(spark, size):
    n, nnz = size
    m = generate.random_binary_matrix(spark, n, nnz, seed=3)
    told = m.df.agg(F.count("*").alias("n"), F.count_distinct("row", "col").alias("d"), F.coalesce(F.bool_and(F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)), F.lit(True)).alias("inside")).first()
    assert (told.n, told.d, told.inside) == (nnz, nnz, True)
    assert m.df.exceptAll(generate.random_binary_matrix(spark, n, nnz, seed=3).df).isEmpty()
    if nnz == 5000:
        assert not m.df.exceptAll(generate.random_binary_matrix(spark, n, nnz, seed=4).df).isEmpty()


def test_large_sample_without_a_global_limit(spark):
    m = generate.random_binary_matrix(spark, 1 << 12, 1 << 22, seed=1)
    plan = m.df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("SinglePartition|GlobalLimit|TakeOrdered", plan)
    rows = m.df.groupBy("row").count().agg(F.sum("count").alias("n"), F.min("count").alias("low"), F.max("count").alias("high")).first()
    assert rows.n == 1 << 22 and 850 < rows.low <= 1024 <= rows.high < 1200


def test_shares():
    for rows, n, nnz in (([3, 3, 1], 7, 49), ([3, 3, 1], 7, 11), ([10**6] * 5, 5 * 10**6, 12345), ([1], 10**10, 3)):
        got = generate._shares(rows, n, nnz, 1)
        assert sum(got) == nnz and all(0 <= k <= r * n for k, r in zip(got, rows, strict=True))


def test_stored_buckets(spark, setting, tmp_path):
    """The index side of lookups and products is not shuffled."""
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(7)
    rows = plain_coalesced([(rng.randrange(50), lo := rng.randint(0, 90), lo + rng.randint(0, 5)) for _ in range(300)])
    m = BoolMatrix(spark.createDataFrame(rows, "row long, lo long, hi long"), 50, 100, "ranges")
    path = str(tmp_path / "buckets")
    storage.save(m, path, buckets=5)
    held = storage.load(spark, path)
    assert held.shape == m.shape and intervals(held.df) == rows
    pairs = spark.createDataFrame([(rng.randrange(50), rng.randrange(100)) for _ in range(500)], "i long, j long")
    answered = D.query(held, pairs, method="join")
    for df in (answered, A.multiply(BoolMatrix(pairs.select(F.col("i").alias("row"), (F.col("j") % 50).alias("lo"), (F.col("j") % 50).alias("hi")), 50, 50, "ranges"), held).df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]
        lines = plan.split("\n")
        scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
        above = []
        depth = lines[scan].index("FileScan")
        for line in reversed(lines[:scan]):
            at = len(line) - len(line.lstrip(" :+-*(0123456789)"))
            if at < depth:
                above.append(line)
                depth = at
            if "Join" in line:
                break
        assert "Bucketed: true" in plan and not any("Exchange" in line for line in above)
    assert sorted(answered.collect()) == sorted(D.query(m, pairs).collect())
    spark.sql(f"DROP TABLE {storage._bucketed(path)}")
    assert intervals(storage.load(spark, path).df) == rows


def test_plain_sizes(spark):
    m = BoolMatrix(spark.createDataFrame([(0, 0, 4), (1, 2, 2)], "row long, lo long, hi long"), 3, 5, "ranges")
    assert storage.plain_size(m) == 8 * (4 + 4 + 1) and storage.plain_size(m.to_basic()) == 8 * (6 + 4 + 1)


def test_blocks_made_on_executors(spark):
    def ladder(row, col, n, extra):
        for i in range(n):
            yield i, i, min(i + extra, n - 1)

    corners = spark.createDataFrame([(0, 0, 3, 1), (3, 3, 0, 1), (3, 3, 2, 5)], "a long, b long, n long, extra int")
    m = A.from_provider(corners, ladder, 5, 5)
    assert intervals(m.df) == [(0, 0, 1), (1, 1, 2), (2, 2, 2), (3, 3, 4), (4, 4, 4)]
    with pytest.raises(Exception, match="beyond the matrix"):
        A.from_provider(corners, ladder, 4, 5).df.collect()
    assert A.from_provider(corners.limit(0), ladder, 5, 5).df.count() == 0


def test_fasta_in_many_splits(spark, setting, tmp_path):
    setting("spark.sql.files.maxPartitionBytes", "64")
    setting("spark.sql.files.openCostInBytes", "0")
    rng = random.Random(9)
    lines, whole = [], ""
    for record in range(40):
        lines.append(f">r{record}")
        whole += "N" if record else ""
        for _ in range(rng.randint(1, 6)):
            lines.append("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30))))
            whole += lines[-1]
    path = tmp_path / "many.fa"
    path.write_text("\n".join(lines) + "\n")
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    pieces = sorted((r.at, r.text) for r in gfa.fasta_pieces(spark, str(path)).collect())
    assert "".join(t for _, t in pieces) == whole + "N" and all(at == sum(len(t) for _, t in pieces[:i]) for i, (at, _) in enumerate(pieces))
