"""Byte-substring dedup over suffix arrays, sorted by bucket-pointer refinement.

Every byte goes that is covered by a `window`-byte string which also starts in a document with a smaller id.  Candidates
come from `_repeats`; here the open segments' suffixes are sorted as far as the window reaches: buckets of equal q-grams
first, then each bucket of several suffixes is refined by the bucket pointers of later offsets, which doubles the depth,
and the refined pointers serve the next round.  Suffixes that are alone in their bucket are done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._repeats import Repeats

WINDOW = 50
K = 16
#: Open segments sorted at once.
SEGMENTS = 20_000


def window_buckets(data: np.ndarray, window: int) -> np.ndarray:
    """Bucket pointers of the strings of `window` bytes at each place: equal for equal strings, in their order."""
    n = len(data)
    q, gram = 1, data.astype(np.uint64)
    while q * 2 <= min(8, window):
        later = np.zeros(n, np.uint64)
        later[: n - q] = gram[q:] if n > q else 0
        gram = (gram << np.uint64(8 * q)) | later
        q *= 2
    order = np.argsort(gram, kind="stable")
    new = np.ones(n, bool)
    new[1:] = gram[order][1:] != gram[order][:-1]
    pointer = np.zeros(n, np.int64)
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while q < window:
        step = min(q, window - q)
        later = np.zeros(n, np.int64)
        later[: max(n - step, 0)] = pointer[step:]
        several = np.bincount(pointer, minlength=n)[pointer] > 1
        at = np.flatnonzero(several)
        at = at[np.argsort(pointer[at] * np.int64(n) + later[at], kind="stable")]
        own, then = pointer[at], later[at]
        bucket, part = np.ones(len(at), bool), np.ones(len(at), bool)
        bucket[1:] = own[1:] != own[:-1]
        part[1:] = bucket[1:] | (then[1:] != then[:-1])
        spot = np.arange(len(at))
        first = lambda new: np.maximum.accumulate(np.where(new, spot, 0)) if len(spot) else spot  # noqa: E731, B023
        pointer = pointer.copy()
        pointer[at] = own + first(part) - first(bucket)
        q += step
    return pointer


def refine(data: np.ndarray, at: np.ndarray, did: np.ndarray, anchor: np.ndarray, window: int) -> np.ndarray:
    """Where windows begin that also occur in a segment of a smaller document."""
    hit = np.zeros(len(data), bool)
    pointer = window_buckets(data, window)
    size = np.diff(at) - window + 1
    start = X.ragged(at[:-1], size)
    own = np.repeat(did, size)
    order = np.lexsort((own, pointer[start]))
    group = pointer[start][order]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    heads = np.flatnonzero(new)
    least = own[order][heads][np.cumsum(new) - 1] if len(order) else own
    hit[start[order]] = least < own[order]
    return hit


def _bytes(block: X.Block):
    return X._BYTE[block.data], block.at


def remove_repeats(documents: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes) of each row.

    Judged on the input: a string counts even if it is itself removed elsewhere.  Matches lie within documents; null and
    empty texts have no bytes.  Rows with one id do not count for each other; rows without id come after all others.
    """

    def result(doc_id, block, row, begin, end):
        removed = X.covered(len(block.data), block.at[row] + begin, block.at[row] + end)
        kept = block.data[~removed]
        n_removed = X.row_sums(removed, block.at)
        offsets = block.at - np.concatenate([[0], np.cumsum(n_removed)])
        sizes = np.diff(block.at)
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(sizes), pa.array(n_removed), pa.array(np.bincount(row, minlength=len(sizes)).astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept)])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    job = Repeats(_bytes, lambda block: (block.data, block.at), refine, np.uint8, window, k, SEGMENTS)
    return job.find(documents, result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    """The rows of the query."""
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
