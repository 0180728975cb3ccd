"""N-gram Jaccard self-join by MinHash banding.

A document is the set of its runs of `n` words (one run of all words if it has fewer).  Each of TREES trees labels it with one
hash of a prefix of MinHash values.  The prefix has one length for all, the longest up to DEPTH by which TREES trees find a pair
at the threshold with the target recall: this is banding, not a forest whose prefixes are shortened by the candidates found.  Documents with equal sets are one class, and only
classes are compared.  Classes that share a prefix in some tree are candidates; candidates' connected
components are verified exactly, all pairs of compatible size in blocks, so that chance misses of the bands inside a component
are made up for.

Scale: labels are some 200 bytes a class.  Only the texts of classes with candidates are read again.  A component of any
size is dealt into cells of about 2 * BLOCK classes and 2 * BLOCK_RUNS runs at most, by size of set first: sets of which one is less than `threshold` times
as large as the other never meet.  A cell gives one row for each class: its links there and one neighbour in a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._components import components
from ._repeats import bitmap, concerned
from ._spark import cut, map_batches, row_of

N = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.999
BLOCK = 400
BLOCK_RUNS = 200_000
_COLUMNS = 2048
#: Edges that one task may finish.
FEW_EDGES = 200_000


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix by which the trees find a pair at the threshold with the recall."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingles(words: X.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's runs, and the rows' offsets."""
    start, run = X.grams(words.hashes, words.row_end(), n)
    row = np.searchsorted(words.at, start, side="right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        run = np.concatenate([run, X.span_hash(X.prefix(words.hashes), words.at[short], words.at[short + 1])])
        row = np.concatenate([row, short])
    order = np.lexsort((run, row))
    run, row = run[order], row[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    return run[new], np.searchsorted(row[new], np.arange(len(words.at)))


def labels(sets: np.ndarray, at: np.ndarray, length: int, trees: int = TREES) -> np.ndarray:
    """Hashes of each full row's label prefixes, one column for each tree."""
    full = at[:-1] < at[1:]
    out = np.zeros((len(at) - 1, trees), np.uint64)
    heads = at[:-1][full]
    if not len(heads):
        return out
    for tree in range(trees):
        prefix = np.full(len(heads), tree, np.uint64)
        for level in range(length):
            a = X._SALT[tree * DEPTH + level]
            prefix = X.mix(prefix * X._SALT[-1 - level] + np.minimum.reduceat((sets ^ (a >> X.U(7))) * a, heads))
        out[full, tree] = prefix
    return out


def _links(sets: list[np.ndarray], block: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set, how many sets of another block (of the same, if there is one only) are similar, and the first of its tree of links."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    member = np.repeat(np.arange(n), sizes)
    values, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    member, column = member[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    by_column = np.argsort(column, kind="stable")
    member, column = member[by_column], column[by_column]
    width = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, width + _COLUMNS, _COLUMNS))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = np.zeros((n, _COLUMNS), np.float32)
        part[member[lo:hi], column[lo:hi] % _COLUMNS] = 1
        common += part @ part.T
    similar = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-3
    similar &= block[:, None] != block[None, :] if block.min() < block.max() else ~np.eye(n, dtype=bool)
    root = np.full(n, -1)
    for s in order:
        if root[s] >= 0:
            continue
        root[s], ahead = s, [s]
        while ahead:
            found = np.flatnonzero(similar[ahead].any(axis=0) & (root < 0))
            root[found] = s
            ahead = found.tolist()
    return similar.sum(axis=1), root


def join(documents: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: key, doc_id, class (hash of the set, null without words), copies (documents with that set), links (other sets that are
    similar) and group_id (the smallest id of its connected component of links and copies).

    Words are those of lower-cased text between ASCII characters that are no letters or digits.  Documents without words have no copies
    and no links and are groups of their own; rows without id count, but give no group_id while others have ids; repeated rows are copies.
    """
    length = prefix_length(threshold, recall)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))

    def labelled(batch: pa.RecordBatch):
        for block in X.blocks(batch.column("text")):
            sets, at = shingles(block.words(X.ALNUM, lower=True), n)
            size = np.diff(at)
            sums = np.concatenate([[X.U(0)], np.cumsum(X.mix(sets), dtype=np.uint64)])
            own = X.mix((sums[at[1:]] - sums[at[:-1]]) ^ X.mix(size.astype(np.uint64)))
            part = batch.slice(block.first, len(block))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(labels(sets, at, length).view(np.int64).ravel()), TREES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(own.view(np.int64), mask=size == 0), pa.array(size.astype(np.int64)), lists], names=["key", "doc_id", "class", "size", "labels"])

    labelled_ = cut(map_batches(rows.select("key", "doc_id", "text"), labelled, "key long, doc_id long, class long, size long, labels array<long>"))
    classes = cut(labelled_.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("labels").alias("labels")))
    leaves = classes.select("class", F.posexplode("labels").alias("tree", "label"))
    tries = leaves.groupBy("tree", "label").agg(F.min("class").alias("first"), F.count("*").alias("n")).where("n > 1").select("tree", "label", "first")
    near = components(leaves.join(tries, ["tree", "label"]).select(F.col("class").alias("a"), F.col("first").alias("b")), FEW_EDGES)
    similar = verify(rows, classes, cut(near.select(F.col("node").alias("class"), "component")), n, threshold)
    linked = components(similar.select(F.col("class").alias("a"), F.col("root").alias("b")), FEW_EDGES)
    links = similar.groupBy("class").agg(F.sum("links").alias("links"))
    grouped = classes.select("class", "first_id", "copies").join(linked.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("group_id"))
    known = grouped.join(least, "component").join(links, "class", "left").select("class", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "group_id")
    found = labelled_.select("key", "doc_id", "class").join(known, "class", "left")
    return found.select("key", "doc_id", "class", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"))


def verify(rows: DataFrame, classes: DataFrame, near: DataFrame, n: int, threshold: float) -> DataFrame:
    """class, links and root of the classes of each cell of a component; a link is in exactly one cell."""
    # sets whose sizes are one step apart at most can be similar: a step is one over the threshold
    members = near.join(classes.select("class", "key", "size"), "class").withColumn("step", F.floor(F.log("size") / math.log(1 / threshold) + 1e-9).cast("int"))
    count = lambda name: F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_RUNS)).cast("int").alias(name)
    crowd = members.groupBy("component", "step").agg(count("blocks"))
    whole = members.groupBy("component").agg(count("all"))
    crowd = cut(crowd.join(whole, "component").select("component", F.when(F.col("all") == 1, F.lit(-1)).otherwise(F.col("step")).alias("at"), "step", F.when(F.col("all") == 1, F.lit(1)).otherwise(F.col("blocks")).alias("blocks")))
    beside = lambda by, name: crowd.where("at >= 0").select("component", (F.col("step") + by).alias("step"), F.col("blocks").alias(name))
    placed = members.join(crowd, ["component", "step"]).join(beside(-1, "above"), ["component", "step"], "left").join(beside(1, "below"), ["component", "step"], "left")
    own = F.pmod(F.xxhash64("class", F.lit(3)), F.col("blocks")).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda s, i, t, j: F.xxhash64("component", s, i, t, j)
    placed = placed.withColumn("own", own)
    at, o = F.col("at"), F.col("own")
    cells = F.concat(
        F.transform(upto("blocks"), lambda j: cell(at, F.least(o, j), at, F.greatest(o, j))),
        F.when(F.col("above").isNotNull(), F.transform(upto("above"), lambda j: cell(at, o, at + 1, j))).otherwise(F.array().cast("array<bigint>")),
        F.when(F.col("below").isNotNull(), F.transform(upto("below"), lambda j: cell(at - 1, j, at, o))).otherwise(F.array().cast("array<bigint>")),
    )
    placed = cut(placed.select("key", "class", F.xxhash64("at", "own").alias("block"), cells.alias("cells")))
    needed = concerned(rows, bitmap(placed.select(F.array("key").alias("keys"))))

    def sets_of(batch: pa.RecordBatch):
        for block in X.blocks(batch.column("text")):
            sets, at = shingles(block.words(X.ALNUM, lower=True), n)
            part = batch.slice(block.first, len(block))
            offsets = (at * 8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("class"), part.column("block"), part.column("cells"), pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(offsets), pa.py_buffer(sets.tobytes())])], names=["class", "block", "cells", "members"])

    texts = needed.join(placed, "key").select("class", "block", "cells", "text").dropDuplicates(["class"])
    sets = map_batches(texts, sets_of, "class long, block long, cells array<long>, members binary").select("class", "block", "members", F.explode("cells").alias("cell"))
    shards = max(1, -(-int(placed.agg(F.sum(F.size("cells")).alias("n")).first().n or 0) // (2 * BLOCK)))

    def compared(table):
        order = np.argsort(table.column("cell").to_numpy(), kind="stable")
        cell, own, block = (table.column(c).to_numpy()[order] for c in ("cell", "class", "block"))
        raw = table.column("members").combine_chunks()
        ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
        out, first = [], 0
        for end in ends:
            if end - first > 1:
                sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in order[first:end]]
                links, root = _links(sets, block[first:end], threshold)
                linked = np.flatnonzero(links)
                out.append((own[first:end][linked], links[linked], own[first:end][root[linked]]))
            first = end
        columns = [np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]).astype(np.int64) for i in range(3)]
        return pa.table({"class": columns[0], "links": columns[1], "root": columns[2]})

    return cut(sets.withColumn("shard", F.pmod("cell", F.lit(shards))).groupBy("shard").applyInArrow(compared, "class long, links long, root long"))


def digest(joined: DataFrame) -> DataFrame:
    """The rows of the query: class_id is the smallest id of the group, n_links counts similar other texts."""
    return joined.select("doc_id", F.col("group_id").alias("class_id"), F.col("copies").alias("n_copies"), F.col("links").alias("n_links"))


def keep_one(documents: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, that with the smallest id, with all columns as they are, whatever their names; of repeated rows one stays.

    Rows without id stay if they are alone in their group or no row of it has an id; then that with the smallest key stays.
    """
    joined = join(documents, n, threshold)
    group = F.coalesce(F.col("group_id"), F.col("class"), F.col("key"))
    first = joined.groupBy(group, F.col("group_id").isNull()).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("kept"))
    rows = documents.select(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).alias("key"), row_of(documents))
    return rows.join(first.select(F.col("kept").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
