"""Fuzzy line dedup by MinHash, with DataFrame functions but for crowded buckets, which are compared by NumPy in cells.

Lines of the whole corpus that hold a word are known by their hash; equal lines are one from the first aggregation on.  A line's
shingles are its runs of SHINGLE characters: the line is encoded with two bytes a character (UTF-16; characters beyond the basic plane
count as two), so that a shingle is a byte slice at a fixed place, and rows of places are exploded, hashed and reduced to MINIMA minima by
generated code, before any shuffle.  The
permutations of MinHash are exclusive-ors with constants of a hash that is random itself.  Bands are the twelve lines of the affine
plane of nine points, so that nine minima give twelve bands of three, any two of which share one minimum at most.

Lines that share a band are candidates, and every candidate pair is decided: it is verified by the exact Jaccard similarity of all
shingles, or its lines are linked by others, or bitmaps of the shingles, whose differing bits are never more than the shingles that
differ, tell that it is below the threshold.  Each bucket is compared with one head first, so that lines alike become one group; then all
lines outside a bucket's largest group meet all of the bucket: in crowded buckets within cells of bounded size, the nearest pairs first, so
that pairs connected by then are not compared; else as rows.  Verified
links are joined by distributed union-find, and of each component the first line (smallest doc_id, then place) stays.

Scale: a line costs three numbers and twelve short rows in shuffles; texts are read again only for lines in buckets of two and more, and
for documents that lose a line, told by a bitmap that grows with their number.  Pairs are rows only in buckets with at most CROWD lines outside
the largest group, so rows grow with the lines; a crowded bucket sends each line to as many cells as it has parts of CELL lines, and comparisons
within its cells grow with the product of its lines and those outside its largest group.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._spark import row_of, written

#: Minima of a signature, and those of each band: the lines of the affine plane of order three.
MINIMA = 9
BANDS = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6)]
THRESHOLD = 0.8
#: Characters of a shingle, shingles of a line that one generated row stands for at most, and bytes of a character.
SHINGLE, STEP, WIDE = 8, 4096, 2
#: Shingles that one row stands for where lines are signed; STEP is a multiple.
RUN = 8
#: Longs of a line's bitmap of shingles (PART are made at a time), and lines outside a bucket's largest group that make it crowded.
BITMAP, PART, CROWD = 32, 4, 50
#: Lines of a crowded bucket on one side of a cell and bytes of their codes, lines whose pairs are looked at together, pairs that are compared together at first.
CELL, CELL_BYTES, ROWS, TAKE = 512, 1 << 20, 128, 256
#: Bytes of lines' places that are broadcast.
SMALL_BYTES = 16 << 20
#: Pairs that a task compares, while there are not too many tasks.
PAIRS = 500
_WORD = r"[^\x20\x09-\x0D]"
#: Bits of a bitmap of keys for each key that it marks, and the most bits that are broadcast.
_BITS_A_KEY, _MOST_BITS = 16, 1 << 27
_LAST = (1 << 63) - 1


def _constants() -> list[int]:
    """Spread over all longs, so that the minima of a small set are different shingles' as far as can be."""
    rng = random.Random(20240229)
    return [int((i + rng.random()) * (1 << 64) / MINIMA) - (1 << 63) for i in range(MINIMA)]


class _Marks:
    """Bitmap of one column of longs, as rows of 64 bits: 16 bits a key up to 2**27 bits, beyond which more of the others pass too."""

    def __init__(self, keys: DataFrame):
        column, n = keys.columns[0], keys.count()
        self.bits = 1 << 10
        while self.bits < min(_BITS_A_KEY * n, _MOST_BITS):
            self.bits *= 2
        self.rows = written(keys.groupBy(self._word(column).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))")).alias("_bits")))

    def _word(self, column: str) -> Column:
        return F.shiftright(F.xxhash64(column).bitwiseAND(F.lit(self.bits - 1)), 6)

    def among(self, rows: DataFrame, column: str, wanted: bool = True) -> DataFrame:
        """Rows that may be, or surely are not, among the marked keys; columns named _word and _bits must not be there."""
        joined = rows.join(F.broadcast(self.rows), self._word(column) == F.col("_word"), "left")
        hit = F.coalesce(F.expr(f"shiftright(_bits, cast(xxhash64({column}) & 63 as int)) & 1") == 1, F.lit(False))
        return joined.where(hit if wanted else ~hit).drop("_word", "_bits")


def _coded(lines: DataFrame) -> DataFrame:
    """line_id and code, the line with WIDE bytes a character."""
    return lines.select("line_id", F.encode("line", "UTF-16BE").alias("code"))


def _places(coded: DataFrame, apart: int = 1) -> DataFrame:
    """line_id, code, end (byte place of the last shingle) and the place of every shingle, or every so many shingles, of lines that have one."""
    # places are bytes from one
    coded = coded.select("line_id", "code", (F.octet_length("code") - (WIDE * SHINGLE - 1)).alias("end")).where("end > 0")
    steps = coded.select("line_id", "end", "code", F.explode(F.sequence(F.lit(1), F.col("end"), F.lit(WIDE * STEP))).alias("first"))
    last = F.least(F.col("first") + WIDE * (STEP - 1), F.col("end"))
    return steps.select("line_id", "end", "code", F.explode(F.sequence("first", last, F.lit(WIDE * apart))).alias("place"))


def _hash(place: str) -> Column:
    return F.xxhash64(F.expr(f"substring(code, {place}, {WIDE * SHINGLE})"))


def _hashes(coded: DataFrame) -> DataFrame:
    """line_id, end and hash of every shingle."""
    return _places(coded).select("line_id", "end", _hash("place").alias("hash"))


def _signed(coded: DataFrame) -> DataFrame:
    """line_id and its minima; lines shorter than a shingle have none, as only equal ones are like them.

    A row stands for RUN shingles, so that only each run's minima are looked up in the aggregation; the last shingle fills up a short run.
    """
    runs = _places(coded, RUN).select("line_id", *(_hash(f"least(place + {WIDE * i}, end)").alias(f"h{i}") for i in range(RUN)))
    least = lambda c: F.least(*(F.col(f"h{i}").bitwiseXOR(F.lit(c)) for i in range(RUN)))
    return runs.groupBy("line_id").agg(*(F.min(least(c)).alias(f"m{i}") for i, c in enumerate(_constants())))


def _crowded(signed: DataFrame) -> DataFrame:
    """line_id, band (a hash of three minima, twelve of each line) and n of the bands that two lines and more share."""
    bands = F.array(*(F.xxhash64(F.lit(b), *(F.col(f"m{i}") for i in band)) for b, band in enumerate(BANDS)))
    leaves = signed.select("line_id", F.explode(bands).alias("band"))
    crowds = written(leaves.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    return _Marks(crowds.select("band")).among(leaves, "band").join(crowds, "band")


def _headed(members: DataFrame) -> DataFrame:
    """line_id, band, n and head: of a bucket's lines the one whose buckets hold the most lines in all.

    It stands nearest to the middle of a group of near copies, so that most are like it, and is the same in most of the group's buckets, so that fewer pairs are compared.
    """
    fame = members.groupBy("line_id").agg(F.sum("n").alias("fame"))
    heads = members.join(fame, "line_id").groupBy("band").agg(F.max(F.struct("fame", "line_id"))["line_id"].alias("head"))
    return members.join(heads, "band")


def _facts(coded: DataFrame) -> DataFrame:
    """line_id, size (number of shingles with repeats) and the bitmap of its shingles, made in parts of PART longs."""
    longs = [F.expr(f"bit_or(if((shiftright(hash, 6) & {PART - 1}) = {j}, shiftleft(1L, cast(hash & 63 as int)), 0L))").alias(f"l{j}") for j in range(PART)]
    part = F.expr(f"cast(shiftright(hash, 16) & {BITMAP // PART - 1} as int)").alias("part")
    parts = _hashes(coded.repartition("line_id")).groupBy("line_id", part).agg(F.max("end").alias("end"), *longs)
    bits = [F.coalesce(F.max(F.when(F.col("part") == j // PART, F.col(f"l{j % PART}"))), F.lit(0).cast("long")).alias(f"b{j}") for j in range(BITMAP)]
    return parts.groupBy("line_id").agg(((F.max("end") + WIDE - 1) / WIDE).cast("long").alias("size"), *bits)


def _shingles(code: str) -> Column:
    """Distinct hashes of a line's shingles; it has one at least.  The code is bound to a name, as it would else be copied for every shingle."""
    hashes = f"transform(sequence(1, octet_length(c) - {WIDE * SHINGLE - 1}, {WIDE}), p -> xxhash64(substring(c, p, {WIDE * SHINGLE})))"
    return F.expr(f"array_distinct(element_at(transform(array({code}), c -> {hashes}), 1))")


def _jaccard(x: str, y: str) -> Column:
    """Similarity of two arrays without repeated values."""
    either = F.size(F.array_union(x, y))
    return (F.size(x) + F.size(y) - either) / either


def _near(threshold: float) -> Column:
    """Whether bitmaps leave it open that lines x and y are similar: similar sets differ by a bounded share of their sizes."""
    apart = sum((F.bit_count(F.col(f"x.b{j}").bitwiseXOR(F.col(f"y.b{j}"))) for j in range(BITMAP)), F.lit(0))
    return apart <= (F.col("x.size") + F.col("y.size")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)


def _links(lines: DataFrame, threshold: float) -> DataFrame:
    """Links a, b between lines, by which all candidates that are similar are connected."""
    members = written(_headed(written(_crowded(written(_signed(_coded(lines)))))))
    known = members.select("line_id").distinct()
    # texts of candidates, once each; codes are written, as they would else be made anew for every shingle
    pool = written(_coded(_Marks(known).among(lines.select("line_id", "line"), "line_id").join(known, "line_id", "left_semi").dropDuplicates(["line_id"])))
    facts = written(_facts(pool))

    def verified(pairs: DataFrame) -> DataFrame:
        # few bytes make much work here, so the number of tasks goes by the pairs
        tasks = min(max(1, pairs.count() // PAIRS), 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        compared = pairs.join(pool.toDF("a", "x"), "a").repartition(tasks, "b").join(pool.toDF("b", "y").repartition(tasks, "b"), "b")
        # sets are columns of their own, so that each is made once
        sets = compared.select("a", "b", _shingles("x").alias("x"), _shingles("y").alias("y"))
        return written(sets.where(_jaccard("x", "y") >= threshold).select("a", "b"))

    def bounded(pairs: DataFrame) -> DataFrame:
        met = pairs.distinct().join(facts.alias("x"), F.col("a") == F.col("x.line_id")).join(facts.alias("y"), F.col("b") == F.col("y.line_id"))
        return written(met.where(_near(threshold)).select("a", "b"))

    found = verified(bounded(members.where("line_id <> head").select(F.col("line_id").alias("a"), F.col("head").alias("b"))))
    # groups that are not yet whole only leave more to compare
    members = written(_strays(members.where("n > 2"), found))
    crowded = members.where(F.col("strays") > CROWD)
    if not crowded.isEmpty():
        # crowded buckets are decided as they are; their links leave fewer strays in the others
        found = found.unionByName(written(_decided(crowded, pool, threshold)))
        members = written(_strays(members.where(F.col("strays") <= CROWD), found))
    # every line outside the bucket's largest group meets all of the bucket
    sides = members.select("line_id", "band", "group", "apart").join(facts, "line_id")
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.group") != F.col("y.group")) & (~F.col("y.apart") | (F.col("x.line_id") < F.col("y.line_id"))) & _near(threshold)
    pairs = sides.where("apart").alias("x").join(sides.alias("y"), met).select(F.col("x.line_id").alias("a"), F.col("y.line_id").alias("b")).distinct()
    return found.unionByName(verified(written(pairs)))


def _strays(members: DataFrame, found: DataFrame) -> DataFrame:
    """line_id, band, group, n, strays (lines outside the bucket's largest group) and apart (whether the line is one) of the buckets that have strays."""
    groups = written(components(found, rounds=3)).toDF("line_id", "group")
    placed = written(members.select("line_id", "band").join(groups, "line_id", "left").withColumn("group", F.coalesce("group", "line_id")))
    sizes = placed.groupBy("band", "group").agg(F.count("*").alias("size"))
    crowds = sizes.groupBy("band").agg(F.sum("size").alias("n"), F.max(F.struct("size", "group")).alias("main")).select("band", "n", (F.col("n") - F.col("main.size")).alias("strays"), F.col("main.group").alias("main")).where("strays > 0")
    return placed.join(crowds, "band").select("line_id", "band", "group", "n", "strays", (F.col("group") != F.col("main")).alias("apart"))


def _decided(members: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """Links a, b of crowded buckets, a forest of each cell: of two lines of a bucket that are alike, links of its cells or groups from before connect them.

    A cell has at most CELL lines a side, fewer if their codes are over CELL_BYTES; it holds texts, not pairs, and pairs of lines that links connect already are not compared.
    """
    held = members.join(pool, "line_id")
    room = members.join(pool.select("line_id", F.octet_length("code").cast("long").alias("bytes")), "line_id").groupBy("band").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("bytes") / CELL_BYTES)).cast("int").alias("parts"))
    sides = held.join(room, "band").withColumn("part", F.pmod(F.xxhash64("line_id", F.lit(7)), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = sides.where("apart").select("*", every.alias("of"), F.lit(True).alias("left")).withColumn("cell", F.xxhash64("band", "part", "of"))
    # of a cell whose sides are one part, a line that is apart stands on the left once, and on the right too
    y = sides.select("*", every.alias("of"), F.lit(False).alias("left")).where("not apart or of <> part").withColumn("cell", F.xxhash64("band", "of", "part"))
    both = x.unionByName(y).select("cell", "line_id", "group", "apart", "left", (F.col("of") == F.col("part")).alias("own"), "code")
    return both.groupBy("cell").applyInArrow(lambda cell: _forest(cell, threshold), "a long, b long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned longs that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of lines, numbered through: where each line's begin, the sorted distinct numbers line by line, and how many there are."""
    ends = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1].astype(np.int64) // WIDE
    units = np.frombuffer(codes.buffers()[2], np.uint8)[: ends[-1] * WIDE].view(np.uint16).astype(np.uint64)
    four = units[:-3] << np.uint64(48) | units[1:-2] << np.uint64(32) | units[2:-1] << np.uint64(16) | units[3:]
    n = np.diff(ends) - (SHINGLE - 1)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) + np.repeat(ends[:-1] - (np.cumsum(n) - n), n)
    values, number = np.unique(_mixed(_mixed(four[place]) + four[place + 4]), return_inverse=True)
    distinct = np.unique(row * len(values) + number)
    row, number = np.divmod(distinct, len(values))
    return np.searchsorted(row, np.arange(len(n) + 1)), number, len(values)


def _forest(cell: pa.Table, threshold: float) -> pa.Table:
    """Links that connect the lines of a cell's two sides as all its links would: pairs go by their bitmaps, the nearest first, and are left out once they are connected."""
    cell = cell.combine_chunks()
    ids, group, apart, left, own = (cell.column(c).to_numpy() for c in ("line_id", "group", "apart", "left", "own"))
    begin, number, values = _sets(pa.concat_arrays(cell.column("code").cast(pa.binary()).chunks))
    size, label = np.diff(begin), np.unique(group, return_inverse=True)[1]
    marks = np.zeros((len(ids), 64 * BITMAP), bool)
    marks[np.repeat(np.arange(len(ids)), size), number % (64 * BITMAP)] = True
    bits = np.packbits(marks, axis=1).view(np.uint64)
    first, second = np.flatnonzero(left), np.flatnonzero(~left | own)
    share, links = (1 - threshold) / (1 + threshold), []

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        def keys(of: np.ndarray) -> np.ndarray:
            n = size[of]
            at = np.arange(n.sum()) + np.repeat(begin[of] - (np.cumsum(n) - n), n)
            return np.repeat(np.arange(len(of)), n) * values + number[at]

        x, y = keys(a), keys(b)
        found = np.searchsorted(y, x)
        both = np.bincount(x[(found < len(y)) & (y[np.minimum(found, len(y) - 1)] == x)] // values, minlength=len(a))
        return both / (size[a] + size[b] - both) >= threshold

    for some in np.split(first, range(ROWS, len(first), ROWS)):
        far = np.zeros((len(some), len(second)), np.int32)
        for j in range(BITMAP):
            far += np.bitwise_count(bits[some, j][:, None] ^ bits[second, j][None, :])
        bound = (size[some][:, None] + size[second][None, :]) * share + 1e-6
        x, y = np.nonzero((far <= bound) & (label[some][:, None] != label[second][None, :]) & (~apart[second][None, :] | (ids[some][:, None] < ids[second][None, :])))
        near = np.argsort(far[x, y] / bound[x, y], kind="stable")
        a, b, take = some[x[near]], second[y[near]], TAKE
        while len(a):
            for i in np.flatnonzero(alike(a[:take], b[:take])):
                p, q = label[a[i]], label[b[i]]
                if p != q:
                    label[label == q] = p
                    links.append((ids[a[i]], ids[b[i]]))
            a, b = a[take:], b[take:]
            open_ = label[a] != label[b]
            a, b, take = a[open_], b[open_], min(2 * take, 16 * TAKE)
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})


def _lines(rows: DataFrame) -> DataFrame:
    """key, did, place, line and its hash of every line with a word."""
    lines = rows.select("key", "did", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.where(F.col("line").rlike(_WORD)).withColumn("line_id", F.xxhash64("line"))


def _removed(rows: DataFrame, threshold: float) -> DataFrame:
    """key and the places of lines that go, of each document that loses any."""
    lines = _lines(rows)
    # where lines stand, without their texts, is written once, as it is read more often than that
    placed = written(lines.select("key", "did", "place", "line_id"))
    firsts = placed.groupBy("line_id").agg(F.min("did").alias("did"), (F.count("*") > 1).alias("again"))
    nodes = components(_links(lines, threshold)).select(F.col("node").alias("line_id"), "component")
    grouped = firsts.join(nodes, "line_id", "left").where("again or component is not null").select("line_id", "did", F.coalesce("component", "line_id").alias("component"))
    kept = grouped.groupBy("component").agg(F.min("did").alias("kept"))
    heads = written(grouped.select("line_id", "component").join(kept, "component"))
    shared = _Marks(heads.select("line_id")).among(placed, "line_id").join(heads, "line_id")
    shared = written(shared.select("key", "place", "component", (F.col("did") == F.col("kept")).alias("tied")))
    # within the first document, or rows of its id, the first place stays
    tied = shared.where("tied")
    stay = tied.groupBy("component").agg(F.min(F.struct("key", "place")).alias("stays"))
    later = tied.join(stay, "component").where("key <> stays.key or place <> stays.place")
    return written(shared.where("not tied").select("key", "place").unionByName(later.select("key", "place")).groupBy("key").agg(F.collect_set("place").alias("places")))


def _deduped(documents: DataFrame, threshold: float) -> DataFrame:
    """row (all columns of documents, text without the lines that go), n_removed."""
    text, did = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    key = F.xxhash64(F.col("doc_id").cast("long"), text)
    removed = _removed(documents.select(key.alias("key"), did.alias("did"), text.alias("text")), threshold)
    marks = _Marks(removed.select("key"))
    rows = documents.select(key.alias("key"), row_of(documents))
    n = removed.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("places")).first()
    # places of few documents go to the documents, those of many are met by a shuffle
    places = F.broadcast(removed) if 40 * n.rows + 8 * n.places <= SMALL_BYTES else removed
    hit = marks.among(rows, "key").join(places, "key", "left")
    # the lines are bound to a name, as the text would else be split anew for every line
    left = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("places"))
    joined = F.transform(F.array(F.split("row.text", "\n")), lambda own: F.array_join(F.transform(left(own), lambda i: own[i]), "\n"))[0]
    shorter = F.col("row").withField("text", joined)
    hit = hit.select(F.when(F.col("places").isNull(), F.col("row")).otherwise(shorter).alias("row"), F.coalesce(F.array_size("places"), F.lit(0)).cast("long").alias("n_removed"))
    return hit.unionByName(marks.among(rows, "key", False).select("row", F.lit(0).cast("long").alias("n_removed")))


def dedup(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of documents as they are, whatever their names, but text without the lines that go.

    Lines without a word stay and do not count.  Null and empty texts stay as they are.  Rows with equal id and text are one document and
    have equal results; rows without id come after all others, and of rows with one id that with the smallest hash comes first.  The
    last line end goes with a last line that goes.  Texts and lines may be of any length: a line's shingles are made in steps of STEP.
    An empty table gives an empty one.
    """
    return _deduped(documents, threshold).select("row.*")


def report(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text as `dedup` leaves it, n_lines (with a word, before) and n_removed."""
    out = _deduped(documents.select("doc_id", "text"), threshold).select("row.doc_id", "row.text", "n_removed")
    left = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.rlike(line, F.lit(_WORD))))
    return out.select("doc_id", "text", (left + F.col("n_removed")).cast("long").alias("n_lines"), "n_removed")


def digest(reported: DataFrame) -> DataFrame:
    """The rows of the query."""
    return reported.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
