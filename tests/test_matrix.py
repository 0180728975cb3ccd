"""Matrices against sets of cells, and the laws of the algebra."""

import random

import pytest
from pyspark.sql import functions as F

from reachspan.functions import ranges as R
from reachspan.functions.indexing import ends_with, starts_with
from reachspan.matrix import BoolMatrix
from reachspan.operators import algebra as A
from reachspan.operators import dindex as D
from reachspan.sources import generate, storage
from reachspan.streaming.lookup import answers

# A 10 x 10 matrix of 25 cells, with empty rows and a cycle.
TINY = {0: [(3, 6)], 1: [(7, 9)], 2: [(0, 1), (6, 6)], 4: [(1, 2)], 5: [(0, 9)], 8: [(9, 9)], 9: [(8, 9)]}


def of(spark, cells, n, m=None, encoding="ranges"):
    basic = BoolMatrix(spark.createDataFrame(sorted(cells), "row long, col long"), n, m or n, "basic")
    return basic if encoding == "basic" else basic.to_ranges()


def cells(m):
    return {(r.row, r.col) for r in m.to_basic().df.collect()}


def product(a, b):
    by = {}
    for i, j in b:
        by.setdefault(i, []).append(j)
    return {(i, k) for i, j in a for k in by.get(j, ())}


TINY_CELLS = {(r, c) for r, spans in TINY.items() for lo, hi in spans for c in range(lo, hi + 1)}


def some(seed, n, m, count):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(m)) for _ in range(count)}


def test_ranges_are_canonical(spark):
    raw = [(0, 0, 63), (0, 500, 511), (0, 512, 639), (0, 5, 9), (1, 7, 7), (1, 1, 9), (3, 4, 4), (3, 6, 6)]
    got = {tuple(r) for r in R.coalesce_ranges(spark.createDataFrame(raw, "row long, lo long, hi long")).collect()}
    assert got == {(0, 0, 63), (0, 500, 639), (1, 1, 9), (3, 4, 4), (3, 6, 6)}


@pytest.mark.parametrize("seed", [1, 2])
def test_conversions(spark, seed):
    want = some(seed, 40, 60, 900)
    m = of(spark, want, 40, 60)
    assert cells(m) == want and m.nnz() == m.to_basic().nnz() == len(want)
    for _, group in m.df.toPandas().sort_values(["row", "lo"]).groupby("row"):
        assert (group.lo <= group.hi).all() and (group.lo.iloc[1:].to_numpy() > group.hi.iloc[:-1].to_numpy() + 1).all()


def test_tiny(spark):
    m = of(spark, TINY_CELLS, 10)
    assert m.df.count() == 8 and m.nnz() == 25
    square = A.multiply(m, m)
    assert (square.nnz(), square.df.count()) == (39, 8)
    plus = A.add(m, A.identity(spark, 10))
    assert (plus.nnz(), plus.df.count()) == (33, 14)
    for (d1, d2), want in {(1, 3): (47, 7), (0, 2): (49, 13), (2, 2): (39, 8)}.items():
        d = D.create_distance_index(m, d1, d2)
        assert (d.nnz(), d.df.count()) == want


@pytest.mark.parametrize("method", ["explode", "bucket", "dyadic", "auto"])
def test_product(spark, method):
    a, b = some(3, 30, 200, 500) | {(7, c) for c in range(40, 190)}, some(4, 200, 50, 700)
    got = A.multiply(of(spark, a, 30, 200), of(spark, b, 200, 50), method)
    assert got.shape == (30, 50) and cells(got) == product(a, b)
    assert cells(A.multiply(of(spark, a, 30, 200, "basic"), of(spark, b, 200, 50, "basic"))) == product(a, b)


def test_laws(spark):
    a, b = of(spark, some(5, 25, 25, 60), 25), of(spark, some(6, 25, 25, 60), 25)
    one = A.identity(spark, 25)
    assert A.add(a, a).equals(a) and A.multiply(a, one).equals(a) and A.multiply(one, a).equals(a)
    assert A.power(a, 0).equals(one) and A.power(a, 1).equals(a)
    assert A.power(a, 5).equals(A.multiply(A.power(a, 2), A.power(a, 3)))
    assert A.add(a, b).equals(A.add(b, a)) and A.merge(A.merge(a, b), b).equals(A.merge(a, b))
    assert not a.equals(b)


@pytest.mark.parametrize(("d1", "d2"), [(0, 1), (0, 4), (1, 3), (2, 2), (2, 5)])
def test_index_is_walks(spark, d1, d2):
    a = some(7, 20, 20, 45)
    step = {(i, i) for i in range(20)}
    want = set()
    for k in range(d2 + 1):
        want |= step if k >= d1 else set()
        step = product(step, a)
    for encoding in ("ranges", "basic"):
        assert cells(D.create_distance_index(of(spark, a, 20, encoding=encoding), d1, d2)) == want
    assert cells(D.stepwise_index(of(spark, a, 20), d1, d2)) == want


def test_errors(spark):
    a, b = of(spark, {(0, 1)}, 3), of(spark, {(0, 1)}, 3, encoding="basic")
    with pytest.raises(TypeError):
        A.add(a, b)
    with pytest.raises(TypeError):
        A.multiply(a, b)
    with pytest.raises(ValueError):
        A.add(a, of(spark, {(0, 1)}, 4))
    for d1, d2 in ((3, 2), (0, 0), (-1, 2)):
        with pytest.raises(ValueError):
            D.create_distance_index(a, d1, d2)
    with pytest.raises(ValueError):
        BoolMatrix(a.df, 1, 1, "dense")
    with pytest.raises(IndexError):
        D.at(a, 3, 0)
    with pytest.raises(Exception, match="outside"):
        A.from_cells(spark.createDataFrame([(5, 0)], "row long, col long"), 3, 3).df.collect()


def test_lookup(spark):
    want = some(8, 15, 15, 60)
    pairs = [(i, j) for i in range(17) for j in range(17)] + [(0, 0)]
    df = spark.createDataFrame(pairs, "i long, j long")
    for encoding in ("ranges", "basic"):
        m = of(spark, want, 15, encoding=encoding)
        got = [(r.i, r.j, r.hit) for r in D.query(m, df).collect()]
        assert sorted(got) == sorted((i, j, (i, j) in want) for i, j in pairs)
        assert {tuple(r) for r in D.hits(m, df).collect()} == want
        i, j = next(iter(want))
        assert D.at(m, i, j) and not D.at(m, *next((i, j) for i in range(15) for j in range(15) if (i, j) not in want))
        with pytest.raises(Exception, match="out of range"):
            D.query(m, df, "raise").collect()


def test_blocks_with_gaps(spark):
    a, b = some(9, 20, 20, 60), some(10, 40, 40, 90)
    m = A.from_blocks(70, 80, [(of(spark, b, 40), 23, 26), (of(spark, a, 20), 0, 0)])
    assert m.shape == (70, 80) and cells(m) == a | {(i + 23, j + 26) for i, j in b}
    with pytest.raises(ValueError):
        A.from_blocks(30, 30, [(of(spark, b, 40), 0, 0)])


def test_storage(spark, tmp_path):
    m = of(spark, some(11, 50, 30, 300), 50, 30)
    storage.save(m, str(tmp_path / "m"))
    again = storage.load(spark, str(tmp_path / "m"))
    assert again.equals(m) and again.shape == (50, 30) and storage.size_in_bytes(spark, str(tmp_path / "m")) > 0
    plan = again.df.where("row = 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(row), EqualTo(row,3)]" in plan
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        storage.load(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("encoding", ["basic", "ranges"])
def test_csr(spark, encoding):
    m = of(spark, TINY_CELLS, 10, encoding=encoding)
    entries, rows = storage.to_csr(m)
    flat = [r.entry for r in sorted(entries.collect())]
    ends = [0] + [r.end for r in sorted(rows.collect())]
    assert storage.from_csr(spark, 10, flat, ends, encoding).equals(m)
    assert storage.from_csr(spark, 4, [], [], encoding).shape == (0, 4)
    with pytest.raises(ValueError):
        storage.from_csr(spark, 4, [1, 2, 3], [0, 2], encoding)


def test_generators(spark):
    for n, nnz in ((30, 40), (30, 800), (5, 25), (4, 0)):
        m = generate.random_binary_matrix(spark, n, nnz)
        assert m.nnz() == nnz == m.df.distinct().count() and m.to_ranges().nnz() == nnz
    assert generate.random_binary_matrix(spark, 50, 70, 3).equals(generate.random_binary_matrix(spark, 50, 70, 3))
    pairs = generate.random_pairs(spark, 9, 200)
    assert pairs.count() == 200 and pairs.agg(F.min("i"), F.max("j")).first() == (0, 8)
    low, high = generate.random_matrix(spark, 20, 90, 2.0, 3.0).agg(F.min("value"), F.max("value")).first()
    assert 2 <= low <= high < 3


def test_display_and_counts(spark):
    m = of(spark, TINY_CELLS, 10)
    assert {r.row: r.text for r in R.rendered(m).collect()}[2] == "2: (0, 1) (6, 6)"
    s = R.stats(m).first()
    assert (s.ranges, s.nnz, s.bandwidth) == (8, 25, 8) and s.ranges_per_row == 0.8
    assert {tuple(r) for r in R.row_bands(m).collect()} >= {(0, 3, 6), (2, 0, 6)}
    names = spark.createDataFrame([("abc",)], "s string")
    assert names.select(starts_with("s", "ab"), ends_with("s", "b")).first() == (True, False)


def test_stream(spark, tmp_path):
    m = of(spark, TINY_CELLS, 10)
    spark.createDataFrame([(0, 3), (0, 7), (5, 5)], "i long, j long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, j long").parquet(str(tmp_path / "in"))
    q = answers(m.cached(), stream).writeStream.format("memory").queryName("answers").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.table("answers").collect()} == {(0, 3, True), (0, 7, False), (5, 5, True)}
    finally:
        q.stop()
    with pytest.raises(ValueError):
        answers(m, spark.createDataFrame([(0, 3)], "i long, j long"))
