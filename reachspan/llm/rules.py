"""Quality rules with an isolation forest on their statistics.

Each document gets counts (words, symbols, repeated lines and windows, character classes) in one pass over its
bytes.  Two base rules reject outright.  An isolation forest, fitted on a bounded sample of labelled rows, gives
every other document a score from the path lengths over random splits: documents that few splits set apart are
anomalous.  The threshold is calibrated on labelled rows so that at most a given share of good ones is lost.

Scale: the sample has at most `MAX_FIT_ROWS` rows, its ids are a broadcast; the forest is some 100 kB.
Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import map_batches, small_batches

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled rows that the forest and its threshold are fitted on, at most: those with the smallest hashes of ids.
MAX_FIT_ROWS = 20_000
TREES, SAMPLE = 100, 256
MAX_GOOD_LOST = 0.001
MARGIN = 0.01
#: A statistic tells bad rows if this share of them lies farther off than all but so many of the good ones.
MIN_TELLING, GOOD_BEYOND = 0.02, 0.001
N_FEATURES = 7
#: Bytes of texts that are looked at together; the arrays over them take many times as much.
BLOCK_BYTES = 1 << 19

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_digits", "n_capitals", "n_marks", "n_lines")


def _kind(members: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members.encode())] = True
    return table


_SYMBOLS, _DIGITS, _CAPITALS = _kind("#*$%&|<>"), _kind("0123456789"), _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARKS = _kind("!\"'()+,-./:;=?@[\\]^_`{}~")


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys, and for each place in it whether the key before is equal."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    return order, same


def statistics(block: X.Block) -> dict[str, np.ndarray]:
    """COUNTS and further counts of each row of a block."""
    data, at, n = block.data, block.at, len(block)
    words = block.words(X.VISIBLE, lower=False)
    visible = X.VISIBLE[data]
    out = {"n_words": words.counts.astype(np.int64), "word_chars": X.row_sums(visible & ((data & 0xC0) != 0x80), at)}
    for name, table in (("n_symbols", _SYMBOLS), ("n_digits", _DIGITS), ("n_capitals", _CAPITALS), ("n_marks", _MARKS)):
        out[name] = X.row_sums(table[data], at)
    breaks = np.flatnonzero(data == 10)
    begin, end = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([breaks, at[1:]]))
    inked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(visible, out=inked[1:])
    full = inked[end] > inked[begin]
    begin, end = begin[full], end[full]
    row = np.searchsorted(at, begin, side="right") - 1
    order, same = _repeats(X.span_hash(X.prefix(X._BYTE[data]), begin, end) ^ X.mix(row.astype(np.uint64)))
    out["n_lines"], out["n_dup_lines"] = np.bincount(row, minlength=n), np.bincount(row[order[same]], minlength=n)
    start, gram = X.grams(words.hashes, words.row_end(), 3)
    order, same = _repeats(gram ^ X.mix((np.searchsorted(words.at, start, side="right") - 1).astype(np.uint64)))
    same[:-1] |= same[1:]
    twice = start[order[same]]
    out["n_repeat_words"] = X.row_sums(X.covered(len(words), twice, twice + 3), words.at)
    return out


def counted(column) -> Iterator[tuple[X.Block, dict[str, np.ndarray]]]:
    """Blocks of a string column with their statistics."""
    for block in X.blocks(column, BLOCK_BYTES):
        yield block, statistics(block)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(counts[c], 1).astype(float) for c in ("n_words", "word_chars", "n_lines"))
    return np.stack([chars / words, counts["n_symbols"] / words, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / words, counts["n_digits"] / chars, counts["n_capitals"] / chars, counts["n_marks"] / chars], axis=1)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points in a binary tree."""
    m = np.maximum(n, 2).astype(float)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees of random splits as arrays; a leaf's feature is -1, its `value` is depth plus expected rest."""

    feature: np.ndarray
    value: np.ndarray
    norm: float
    used: np.ndarray
    threshold: float = np.inf

    @classmethod
    def fit(cls, points: np.ndarray, used: np.ndarray, around: np.ndarray, seed: int = 11) -> Forest:
        """Splits random samples at random features and values, to a depth of log2 of the sample; no points: no anomalies.

        Values are drawn from the box that all labelled rows (`around`) span, and within it from what earlier splits left: splits in
        empty space cut off what is unlike the points, also where they do not vary at all.
        """
        points = points[:, used]
        rng = np.random.default_rng(seed)
        size = min(SAMPLE, len(points))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        feature, value = np.full((TREES, 2 ** (depth + 1) - 1), -1), np.zeros((TREES, 2 ** (depth + 1) - 1))
        for t in range(TREES if size else 0):
            at = [(0, 0, points[rng.choice(len(points), size, replace=False)], around[:, used].min(axis=0), around[:, used].max(axis=0))]
            while at:
                node, d, rows, low, high = at.pop()
                open_ = np.flatnonzero(high > low)
                if d == depth or len(rows) < 2 or not len(open_):
                    value[t, node] = d + _average_path(np.array(len(rows)))
                    continue
                f = int(rng.choice(open_))
                split = rng.uniform(low[f], high[f])
                side = rows[:, f] <= split
                feature[t, node], value[t, node] = f, split
                below, above = high.copy(), low.copy()
                below[f] = above[f] = split
                at += [(2 * node + 1, d + 1, rows[side], low, below), (2 * node + 2, d + 1, rows[~side], above, high)]
        return cls(feature, value, float(_average_path(np.array(size))) or 1.0, used)

    def scores(self, points: np.ndarray) -> np.ndarray:
        """0 to 1: above about 0.5 for points that few splits set apart."""
        points = points[:, self.used]
        total = np.zeros(len(points))
        row = np.arange(len(points))
        for feature, value in zip(self.feature, self.value, strict=True):
            node = np.zeros(len(points), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (points[row, f] > value[node]))
            total += value[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def telling(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Which statistics tell some bad rows from good ones by their distance from the good median; all, if none does.

    Upper ends are compared, not averages: a statistic that only a minority of the bad rows is unusual in, one kind of junk among others, is used, too.
    """
    if not len(good) or not len(bad):
        return np.arange(good.shape[1])
    middle = np.median(good, axis=0)
    limit = np.quantile(np.abs(good - middle), 1 - GOOD_BEYOND, axis=0)
    used = np.flatnonzero((np.abs(bad - middle) > limit).mean(axis=0) >= MIN_TELLING)
    return used if len(used) else np.arange(good.shape[1])


def fit(documents: DataFrame, labels: DataFrame, max_good_lost: float = MAX_GOOD_LOST) -> Forest:
    """A forest of the good labelled documents, with the threshold that loses at most the given share of them.

    Statistics that tell no kind of sampled bad rows from good ones are left out.  Half of the sampled good rows grow the trees, the other half set the threshold, so that it holds for rows not seen.
    Rows that the base rules reject, and rows without id or label, are left out; rows of one id go by their statistics, so equal tables give equal
    forests.  Without labelled rows, or in an empty table, nothing is anomalous.
    """
    ids = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    sample = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT_ROWS)

    small_batches(documents.sparkSession)

    def pointed(batch: pa.RecordBatch):
        for block, counts in counted(batch.column("text")):
            part = batch.slice(block.first, len(block))
            points = features(counts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(base_failed(counts)), pa.array(points.tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "failed", "point"])

    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = map_batches(texts.join(F.broadcast(sample), "doc_id"), pointed, "doc_id long, quality int, failed boolean, point array<double>").where("not failed").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "point").limit(MAX_FIT_ROWS).toArrow()
    points = np.array(rows.column("point").to_pylist() or np.zeros((0, N_FEATURES)))
    good = rows.column("quality").to_numpy() == 1
    good, bad = points[good], points[~good]
    forest = Forest.fit(good[::2], telling(good, bad), points)
    if len(good) > 1:
        held = np.sort(forest.scores(good[1::2]))
        forest.threshold = float(held[-1 - int(max_good_lost * len(held))]) + MARGIN
    return forest


def judge(documents: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept of each row.  Null and empty texts have no words and fail; long texts are one pass over their bytes; empty tables give empty ones."""
    small_batches(documents.sparkSession)

    def judged(batch: pa.RecordBatch):
        for block, counts in counted(batch.column("text")):
            failed, scores = base_failed(counts), forest.scores(features(counts))
            columns = [batch.column("doc_id").slice(block.first, len(block)), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(scores), pa.array(~failed & (scores <= forest.threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text"), judged, "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, score double, kept boolean")


def keep(documents: DataFrame, forest: Forest) -> DataFrame:
    """The rows of documents that are kept, with all columns as they are."""
    small_batches(documents.sparkSession)

    def passed(batch: pa.RecordBatch):
        for block, counts in counted(batch.column("text")):
            good = ~base_failed(counts)
            good[good] = forest.scores(features(counts)[good]) <= forest.threshold
            yield batch.slice(block.first, len(block)).filter(pa.array(good))

    return map_batches(documents, passed, documents.schema)
