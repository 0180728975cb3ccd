"""Spelling variants: words one edit apart, found by Aho-Corasick automata of words' halves.

If two words differ by one inserted, deleted or replaced code point, the edit lies in one half of the shorter (or equally long) one, and its other half stands
in the longer word unchanged, at the start or at the end.  Automaton shards hold both halves of every word; words are scanned by
the shards that can match them, a hit counts if its place and the lengths fit, and what is left is verified.

Routing: a key stands for one length, one open part (where the edit must lie) and all code points around it, so near words share a key, and a
word has four of them.  Keys that more than `CROWDED` words share are split: the open part is halved again and each half's outside joins the key, as often as
needed (words that agree in all but one code point are few, as the alphabet has 90 letters).  So one half that a third of all words share is no hot key,
no word is compared with a whole group, and only verified pairs leave a task.

Scale: words are counted exactly within each batch before the shuffle; everything after works on the words that are frequent enough.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import map_batches, small_batches, written

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: The damage of the query: one run in so many loses a code point.
DAMAGE = 199
#: Words of one key that are compared with each other, and keys of words that one automaton shard takes.
CROWDED, SHARD = 200, 60_000
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC3] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _crc32(state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of many spans of bytes, each carried on from a state; all spans go forward by a byte at a time, longest first."""
    order = np.argsort(begin - end, kind="stable")
    begin, size = begin[order], (end - begin)[order]
    crc = ~state[order]
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i, side="left"))
        crc[:n] = _CRC[(crc[:n] ^ data[begin[:n] + i]) & 255] ^ (crc[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def runs(block: X.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, begin, end and row of the maximal runs of letters: A to Z in either case, and U+00C0 to U+00FF, which UTF-8 writes as C3 and one more."""
    data = X.LOWER[block.data]
    letter = _LETTER[block.data]
    letter[1:] |= block.data[:-1] == 0xC3
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    full = block.at[:-1] < block.at[1:]
    head, tail = block.at[:-1][full], block.at[1:][full] - 1
    begins[head], ends[tail] = letter[head], letter[tail]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return data, begin, end, np.searchsorted(block.at, begin, side="right") - 1


def words(documents: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """word, n: the runs of whole texts, of at least MIN_LENGTH code points and MIN_COUNT occurrences.

    One run in `damage` (0: none), by the crc32 of `<doc_id>:<run>`, first loses the code point that the crc names; a missing id is empty there.  Null texts have no words.
    """

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = [b"" if x is None else str(x).encode() for x in batch.column("doc_id").to_pylist()]
        for block in X.blocks(batch.column("text")):
            data, begin, end, row = runs(block)
            odd: list[str] = []
            if damage and len(begin):
                state = np.array([zlib.crc32(names[block.first + i] + b":") for i in range(len(block))], np.uint32)
                crc = _crc32(state[row], data, begin, end)
                hit = crc % np.uint32(damage) == 0
                for b, e, h in zip(begin[hit].tolist(), end[hit].tolist(), crc[hit].tolist(), strict=True):
                    run = data[b:e].tobytes().decode()
                    at = h % len(run)
                    odd.append(run[:at] + run[at + 1 :])
                begin, end = begin[~hit], end[~hit]
            letters = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))
            long = letters[end] - letters[begin] >= MIN_LENGTH
            begin, end = begin[long], end[long]
            at = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
            inside = X.covered(len(data), begin, end) if len(begin) else np.zeros(len(data), bool)
            plain = pa.StringArray.from_buffers(len(begin), pa.py_buffer(at), pa.py_buffer(data[inside].tobytes()))
            found = pc.value_counts(pa.concat_arrays([plain, pa.array([w for w in odd if len(w) >= MIN_LENGTH], pa.string())]))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return map_batches(rows, counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _keys(found: DataFrame) -> DataFrame:
    """key, word, size, b, e: of the shorter word's size, the open part [b, e) of it that holds the edit; in the longer word it ends one later."""
    size = F.char_length("word")
    sizes = found.select("word", F.explode(F.array(size, size - 1)).alias("size")).where(F.col("size") >= MIN_LENGTH)
    half = F.floor(F.col("size") / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.lit(0).alias("b"), half.alias("e")), F.struct(half.alias("b"), F.col("size").alias("e"))))
    level = sizes.select("word", "size", parts.alias("p")).select("word", "size", "p.b", "p.e")
    done = None
    while True:
        keyed = written(level.select(F.xxhash64("size", "b", "e", F.expr("substring(word, 1, b)"), F.expr("substring(word, e + 1 + length(word) - size)")).alias("key"), "word", "size", "b", "e"))
        crowded = keyed.where("e - b > 1").groupBy("key").count().where(F.col("count") > CROWDED).select("key")
        if crowded.isEmpty():
            return keyed if done is None else done.unionByName(keyed)
        crowded = written(crowded)
        rest = keyed.join(crowded, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        middle = F.expr("b + cast((e - b) div 2 as int)")
        parts = F.explode(F.array(F.struct(F.col("b"), middle.alias("e")), F.struct(middle.alias("b"), F.col("e"))))
        level = keyed.join(crowded, "key", "left_semi").select("word", "size", parts.alias("p")).select("word", "size", "p.b", "p.e")


def near(found: DataFrame) -> DataFrame:
    """word, other: all ordered pairs of the distinct words of `found` that are exactly one edit apart."""
    keys = written(_keys(found))
    shards = max(1, -(-keys.count() // SHARD))
    dealt = keys.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards))).where("word is not null")
    pairs = dealt.groupBy("shard").applyInArrow(_scanned, "a string, b string").distinct()
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))))


def _scanned(table: pa.Table) -> pa.Table:
    """Pairs (a, b), a the shorter or smaller word, of one shard."""
    key, word, size = table.column("key").to_pylist(), table.column("word").to_pylist(), table.column("size").to_pylist()
    begin = table.column("b").to_pylist()
    owners: dict[int, list[str]] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for k, w, n, b in zip(key, word, size, begin, strict=True):
        if len(w) == n:
            owners.setdefault(k, []).append(w)
            half = w[n // 2 :] if b < n // 2 else w[: n // 2]
            automaton.add_word(half, len(half))
    if not owners:
        return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})
    automaton.make_automaton()
    left: list[str] = []
    right: list[str] = []
    scans: dict[str, list[tuple[int, int, bool]]] = {}
    for k, w, n, b in zip(key, word, size, begin, strict=True):
        if k in owners:
            scans.setdefault(w, []).append((k, n, b < n // 2))
    for w, asked in scans.items():
        hits = {(end + 1 - length, length) for end, length in automaton.iter(w)}
        for k, n, suffix in asked:
            length = n - n // 2 if suffix else n // 2
            # the half that is whole stands at the end, or at the start
            if (len(w) - length if suffix else 0, length) not in hits:
                continue
            for own in owners[k]:
                if (len(own) < len(w) or own < w) and _one_edit(own, w):
                    left.append(own)
                    right.append(w)
    return pa.table({"a": pa.array(left, pa.string()), "b": pa.array(right, pa.string())})


def _one_edit(short: str, long: str) -> bool:
    """Whether one replaced code point, or one more in the longer word, tells two words apart."""
    n = len(short)
    same = 0
    while same < n and short[same] == long[same]:
        same += 1
    return short[same + 1 :] == long[same + 1 :] if n == len(long) else short[same:] == long[same + 1 :]


def variants(found: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n); see the query's contract.

    A form has at least RATIO times the count of its word, so chains are short; roots come by doubling steps over the words that have a form.
    Empty tables give empty results.
    """
    counted = written(found.select("word", "n"))
    pairs = near(counted.select("word"))
    rated = pairs.join(counted.select(F.col("word").alias("other"), F.col("n").alias("_n")), "other")
    best = F.min(F.struct((-F.col("_n")).alias("least"), F.col("other").alias("other")))
    told = rated.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = counted.join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.least") >= RATIO * F.col("n"), F.col("best")).alias("best"))
    formed = written(formed.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.least")).alias("form_n")))
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
