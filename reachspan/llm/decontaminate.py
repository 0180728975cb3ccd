"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item.  Of the K-grams that a window of WINDOW words holds, the one
with the smallest hash is its fingerprint; a text keeps the fingerprints of all its windows.  Equal windows
choose equal fingerprints, so every shared span of WINDOW words or more has one in common.  Documents' and items'
fingerprints are joined and each hit is extended word by word to both sides, as far as a window reaches.
Items of fewer words are one window, found by all runs of their length.

Scale: documents are scanned once; a bitmap of the benchmark's fingerprints (fixed at 2 MB) drops nearly all of
a document's fingerprints before the join, without loss.  The benchmark side is a broadcast only while its
measured size is below `BROADCAST_BYTES`; above that Spark shuffles both sides and splits skewed keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import cut, keyed, map_batches, row_of

WINDOW = 10
K = 5
BROADCAST_BYTES = 64 << 20
BITMAP_BITS = 1 << 24


def fingerprints(words: X.Words, sums: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the K-grams that some window of a row chooses: the smallest hash, the first of equal ones."""
    end = words.row_end()
    start, gram = X.grams(words.hashes, end, k, sums)
    n = len(words) - window + 1
    if n <= 0:
        return start[:0], gram[:0]
    bits = max(1, int(len(words)).bit_length())
    low = np.uint64((1 << bits) - 1)
    order = np.full(len(words), np.iinfo(np.uint64).max)
    order[start] = (gram & ~low) | start.astype(np.uint64)
    least = sliding_min(order, window - k + 1)[:n]
    valid = np.arange(window, n + window) <= end[:n]
    chosen = np.zeros(len(words), bool)
    chosen[(least[valid] & low).astype(np.int64)] = True
    keep = chosen[start]
    return start[keep], gram[keep]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i up to len(x) - width."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


_HIT = "k:int,hash:long,place:long,left:array<long>,right:array<long>"


def _marks(text: pa.Array, lengths: list[int], k: int, window: int, bitmap: np.ndarray | None):
    """Per block: the block, its words' offsets, and for each row the fingerprints with the words beside them, as Arrow structs.

    `lengths`: lengths of short items, whose runs are given without words beside them.  bitmap: of hashes to keep.
    """
    for block in X.blocks(text):
        words = block.words(X.ALNUM, lower=True)
        sums, end, found = X.prefix(words.hashes), words.row_end(), []
        for size in [window, *lengths]:
            start, run = fingerprints(words, sums, k, window) if size == window else X.grams(words.hashes, end, size, sums)
            run = run ^ np.uint64(size)
            if bitmap is not None:
                bit = (run & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
                keep = bitmap[bit >> 3] >> (bit & 7) & 1 > 0
                start, run = start[keep], run[keep]
            found.append((start, run, np.full(len(start), size)))
        start, run, size = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(start, kind="stable")
        start, run, size = start[order], run[order], size[order]
        row = np.searchsorted(words.at, start, side="right") - 1
        beside = np.where(size == window, window - k, 0)
        own = np.where(size == window, k, size)
        left = np.minimum(beside, start - words.at[row])
        right = np.minimum(beside, words.at[row + 1] - start - own)
        plain = words.hashes.view(np.int64)
        lists = [
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(plain[at]))
            for n, at in ((left, np.repeat(2 * start - left - 1, left) - X.ragged(start - left, left)), (right, X.ragged(start + own, right)))
        ]
        hits = pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.array(run.view(np.int64)), pa.array((start - words.at[row]).astype(np.int64)), *lists], names=["k", "hash", "place", "left", "right"])
        yield block, words, pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(block) + 1)).astype(np.int32)), hits)


def _same(a: str, b: str) -> Column:
    """How many words of two lists are equal before the first that differ."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("long")


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document: key, doc_id, n_words, spans [(begin, end)] of hit words, merged and sorted, and items, distinct.

    Null and empty texts, and texts without words, have no spans; items without words never occur; items without id mark words but
    are not among `items`; repeated documents have equal results, repeated items count once.
    """
    if not 1 <= k <= window:
        raise ValueError("k is between 1 and the window")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def sized(batch: pa.RecordBatch):
        for block in X.blocks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(block.words(X.ALNUM, lower=True).counts.astype(np.int64))], names=["n"])

    lengths = [r.n for r in map_batches(items.select("text"), sized, "n long").where(f"n > 0 and n < {window}").distinct().collect()]

    def of_items(batch: pa.RecordBatch):
        for block, words, hits in _marks(batch.column("text"), lengths, k, window, None):
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(block.first, len(block)), pa.array(words.counts.astype(np.int64)), hits], names=["item_id", "n", "hits"])

    marked = map_batches(items, of_items, f"item_id string, n long, hits array<struct<{_HIT}>>").select("item_id", "n", F.inline("hits"))
    marked = cut(marked.where(f"k = least(n, {window})").select("item_id", "k", "hash", F.col("left").alias("i_left"), F.col("right").alias("i_right")).distinct())
    bit = F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1))
    maps = marked.groupBy((bit / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg((bit % 32768).cast("long")).alias("bits"), F.count("*").alias("n")).collect()
    bitmap = np.zeros(BITMAP_BITS >> 3, np.uint8)
    for r in maps:
        bitmap[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    small = sum(r.n for r in maps) * (64 + 16 * (window - k)) <= BROADCAST_BYTES

    def of_documents(batch: pa.RecordBatch):
        for block, words, hits in _marks(batch.column("text"), lengths, k, window, bitmap):
            part = batch.slice(block.first, len(block))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(words.counts.astype(np.int64)), hits], names=["key", "doc_id", "n_words", "hits"])

    scanned = cut(map_batches(keyed(documents), of_documents, f"key long, doc_id long, n_words long, hits array<struct<{_HIT}>>"))
    pairs = scanned.where(F.size("hits") > 0).select("key", F.inline("hits")).distinct().join(F.broadcast(marked) if small else marked, ["k", "hash"])
    before, after = _same("left", "i_left"), _same("right", "i_right")
    own = F.when(F.col("k") == window, F.lit(k)).otherwise(F.col("k"))
    spans = pairs.select("key", "item_id", "k", (F.col("place") - before).alias("begin"), (F.col("place") + own + after).alias("end")).where(F.col("end") - F.col("begin") >= F.col("k"))
    merged = F.aggregate(
        F.sort_array("spans"), F.array().cast("array<struct<begin:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, F.when(F.size(done) > 0, -1).otherwise(1))["end"] >= s["begin"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    by_key = spans.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items")).select("key", merged.alias("spans"), "items")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return scanned.select("key", "doc_id", "n_words").join(by_key, "key", "left").select("key", "doc_id", "n_words", none("spans", "array<struct<begin:bigint,end:bigint>>"), none("items", "array<string>"))


def digest(found: DataFrame) -> DataFrame:
    """The rows of the query."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without hits, with all columns as they are, whatever their names; null, empty and repeated rows without hits all stay."""
    bad = find(documents, benchmark).where(F.size("spans") > 0).select("key").distinct()
    rows = documents.select(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).alias("key"), row_of(documents))
    return rows.join(bad, "key", "left_anti").select("row.*")
