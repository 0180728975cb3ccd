"""Word-substring dedup with suffix automata of reference shards.

Every word goes that is covered by a window of `window` words which also starts in a document with a smaller id.
Candidates come from `_repeats`.  A shard's reference are the segments of one anchor, in the order of their documents:
each document's segments are streamed through the automaton of all smaller documents' segments, which gives
the length of the longest match that ends at every word (matching statistics), and then extend the automaton.

A shard holds at most `SEGMENTS` segments of an anchor, whatever the corpus; segments are sent to the one shard that can match
them.  Broadcasting every shard to every document would take work that grows with the square of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._repeats import Repeats

WINDOW = 50
K = 20
SEGMENTS = 4000


class SuffixAutomaton:
    """Suffix automaton of several sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _clone(self, p: int, c, q: int) -> int:
        new = len(self.size)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._clone(last, c, q)
                continue
            own, p = len(self.size), last
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = own
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[own] = q if self.size[q] == self.size[p] + 1 else self._clone(p, c, q)
            last = own

    def matching(self, sequence) -> list[int]:
        """For each place, the length of the longest suffix of what was read that occurs in an added sequence."""
        state, length, out = 0, 0, []
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            out.append(length)
        return out


def refine(units: np.ndarray, at: np.ndarray, did: np.ndarray, anchor: np.ndarray, window: int) -> np.ndarray:
    """Where windows begin that also occur in a segment of a smaller document with the same anchor."""
    hit = np.zeros(len(units), bool)
    order = np.lexsort((did, anchor))
    ends = np.flatnonzero(np.diff(anchor[order], append=~anchor[order][-1:])) + 1 if len(order) else []
    first = 0
    for end in ends:
        shard, waiting = SuffixAutomaton(), []
        for i in order[first:end]:
            if waiting and did[waiting[-1]] < did[i]:
                for j in waiting:
                    shard.add(units[at[j] : at[j + 1]].tolist())
                waiting = []
            if len(shard.size) > 1:
                lengths = np.array(shard.matching(units[at[i] : at[i + 1]].tolist()))
                hit[at[i] + np.flatnonzero(lengths >= window) - window + 1] = True
            waiting.append(i)
        first = end
    return hit


def _words(block: X.Block):
    words = block.words(X.VISIBLE, lower=False)
    return words.hashes, words.at


def remove_repeats(documents: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the other words, joined by one space) of each row.

    Words are runs without white space, unchanged.  Judged on the input: a window counts even if it is itself removed
    elsewhere.  Null and empty texts have no words.  Rows with one id do not count for each other; rows without id come after all others.
    """

    def result(doc_id, block, row, begin, end):
        words = block.words(X.VISIBLE, lower=False)
        removed = X.covered(len(words), words.at[row] + begin, words.at[row] + end)
        n_removed = X.row_sums(removed, words.at)
        keep = np.flatnonzero(~removed)
        size = words.end[keep] - words.begin[keep]
        owner = np.searchsorted(words.at, keep, side="right") - 1
        more = np.zeros(len(keep), np.int64)  # 1 where another kept word of the row follows
        more[:-1] = owner[:-1] == owner[1:]
        data = np.append(block.data, np.uint8(32))
        spaced = data.copy()
        spaced[words.end[keep][more > 0]] = 32
        kept = spaced[X.ragged(words.begin[keep], size + more)]
        offsets = np.concatenate([[0], np.cumsum(size + more)])[np.searchsorted(owner, np.arange(len(block) + 1))]
        text = pa.Array.from_buffers(pa.string(), len(block), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept)])
        return pa.RecordBatch.from_arrays([doc_id, pa.array(words.counts.astype(np.int64)), pa.array(n_removed), text], names=["doc_id", "n_words", "n_removed", "kept"])

    job = Repeats(_words, _words, refine, np.uint64, window, k, SEGMENTS)
    return job.find(documents, result, "doc_id long, n_words long, n_removed long, kept string")


def digest(cleaned: DataFrame) -> DataFrame:
    """The rows of the query."""
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
