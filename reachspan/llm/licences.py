"""Licence scan by diagonal voting.

Every run of k words of every document is hashed (in NumPy) and looked up among the runs of the licence
templates.  A hit at document word p and template word t votes for the diagonal p - t.  Spark joins the
hits to all template positions, sums them by (document, template, diagonal), merges neighbouring
diagonals into one span, of which the diagonals differ by a share of the template's length at most (longer rows of diagonals are several spans that
overlap by half), and the span is verified by the longest common subsequence of its words and
the template's, by the words that stand between those, and by the runs of words that tell the licence and its version from others, which must stand in it.  Of
notices that overlap the one with the most words found stays.  Phrases are templates that must match in full, on one diagonal.

Scale: only hits leave the scan, with the words of documents that have hits coded by the templates' few
hundred words.  Templates are a fixed list, so their table is joined as a broadcast; `MAX_TEMPLATE_WORDS`
is checked.  All groups are within one document.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._licences import NOTICES, PHRASES
from ._spark import cut, keyed, map_batches

K = 3
SLACK = 4
#: Share of a template's length by which the diagonals of a span may differ twice.
SPREAD = 0.25
MIN_SCORE = 0.8
MAX_TEMPLATE_WORDS = 100_000


class Templates:
    """Word codes of all templates, and hashes of their runs: of K words, or of all words for phrases and short ones."""

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str, list[str]]]):
        texts = [(label, text, True) for text, label in phrases.items()] + [(n[0], n[1], False) for n in notices]
        hashes = [X.word_hashes(text, X.ALNUM, True) for _, text, _ in texts]
        if sum(map(len, hashes)) > MAX_TEMPLATE_WORDS or not all(map(len, hashes)):
            raise ValueError(f"templates need 1 to {MAX_TEMPLATE_WORDS} words in all")
        self.vocabulary = np.unique(np.concatenate(hashes))
        self.labels, self.whole = [t[0] for t in texts], [t[2] for t in texts]
        self.codes = [np.searchsorted(self.vocabulary, h).astype(np.int32) for h in hashes]
        # the last place is for words of no template, whose code is -1
        self.members = [np.isin(np.arange(len(self.vocabulary) + 1), own) for own in self.codes]
        needs = [[]] * len(phrases) + [[X.word_hashes(must, X.ALNUM, True) for must in n[2]] for n in notices]
        if any(not np.isin(h, own).all() for own, must in zip(hashes, needs, strict=True) for h in must):
            raise ValueError("words that must stand in a notice are words of it")
        self.needs = [[np.searchsorted(self.vocabulary, h).astype(np.int32) for h in must] for must in needs]
        self.runs: list[tuple[int, int, int, int]] = []  # length of run, hash, template, place
        for n, h in enumerate(hashes):
            k = len(h) if self.whole[n] else min(K, len(h))
            start, run = X.grams(h, np.full(len(h), len(h)), k)
            self.runs += [(k, int(r.astype(np.int64)), n, int(s)) for s, r in zip(start, run, strict=True)]
        self.by_length = {k: np.unique(np.array([r for n, r, _, _ in self.runs if n == k], dtype=np.int64).view(np.uint64)) for k in {r[0] for r in self.runs}}

    def code(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1).astype(np.int32)


def _grown(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence, and how many words of a it takes to reach it."""
    best, taken = np.zeros(len(b) + 1, dtype=np.int64), 0
    for i, x in enumerate(a):
        before = best[-1]
        hit = np.where(b == x, best[:-1] + 1, 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], hit))
        taken = i + 1 if best[-1] > before else taken
    return int(best[-1]), taken


def common_words(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the stretch [begin, end) of a that holds it: the earliest end, then the latest begin."""
    if len(a) >= len(b) and np.array_equal(a[: len(b)], b):
        return len(b), 0, len(b)
    found, end = _grown(a, b)
    return found, end - _grown(a[:end][::-1], b[::-1])[1], end


def wide(size: int) -> int:
    """Diagonals that half of a span covers."""
    return max(SLACK, int(SPREAD * size))


def stands_in(run: np.ndarray, words: np.ndarray) -> bool:
    """Whether the words hold the run together."""
    starts = np.flatnonzero(words[: len(words) - len(run) + 1] == run[0]) if len(run) <= len(words) else []
    return any(np.array_equal(words[s : s + len(run)], run) for s in starts)


def best_of(spans: list[dict]) -> list[dict]:
    """Phrases, and of overlapping notices the one with the most words found (then the first by label and place), by place."""
    ends: list[tuple[int, int]] = []
    kept: list[dict] = []
    for s in sorted((s for s in spans if not s["whole"]), key=lambda s: (-s["found"], s["label"], s["first"])):
        # kept ones do not overlap, so that only the last that begins before this one ends can meet it
        at = bisect.bisect_right(ends, (s["last"], _FAR))
        if not at or ends[at - 1][1] < s["first"]:
            ends.insert(at, (s["first"], s["last"]))
            kept.append(s)
    return sorted(kept + [s for s in spans if s["whole"]], key=lambda s: (s["first"], s["last"], s["label"]))


_FAR = 1 << 62


def scan(documents: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str, list[str]]] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: key, doc_id, n_words and spans: [(label, whole, first, last, score)], by place.

    `whole` marks phrases; first and last are word numbers, last included, of the stretch from the first word found to the last.  score is twice the number of the
    template's words found in order over the words of template and stretch, so foreign words between lower it.  Notices need `min_score`, this share of
    their words, and all their required runs, and do not overlap.
    Null and empty texts have no words and no spans; repeated rows have equal results; an empty table gives an empty one.  Texts may
    be of any length: a span is verified by itself.
    """
    t = Templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    spark = documents.sparkSession

    def hits(batch: pa.RecordBatch):
        for block in X.blocks(batch.column("text")):
            words = block.words(X.ALNUM, lower=True)
            end, found = words.row_end(), []
            sums = X.prefix(words.hashes)
            for k, known in t.by_length.items():
                start, run = X.grams(words.hashes, end, k, sums)
                at = np.minimum(np.searchsorted(known, run), len(known) - 1)
                hit = known[at] == run
                found.append((start[hit], np.full(hit.sum(), k), run[hit].view(np.int64)))
            start, size, run = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.argsort(start, kind="stable")
            start, size, run = start[order], size[order], run[order]
            row = np.searchsorted(words.at, start, side="right") - 1
            at = np.searchsorted(row, np.arange(len(block) + 1))
            local = (start - words.at[row]).astype(np.int64)
            struct = pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.array(run), pa.array(local)], names=["k", "run", "place"])
            held = np.repeat(np.diff(at) > 0, words.counts)
            codes = t.code(words.hashes[held])
            per_row = np.where(np.diff(at) > 0, words.counts, 0)
            code_at = np.concatenate([[0], np.cumsum(per_row)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").slice(block.first, len(block)), batch.column("doc_id").slice(block.first, len(block)), pa.array(words.counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), struct),
                    pa.array([codes[code_at[i] : code_at[i + 1]].tobytes() if per_row[i] else None for i in range(len(block))], pa.binary()),
                ],
                names=["key", "doc_id", "n_words", "hits", "codes"],
            )

    scanned = cut(map_batches(keyed(documents), hits, "key long, doc_id long, n_words long, hits array<struct<k:int,run:long,place:long>>, codes binary"))
    places = spark.createDataFrame([(k, run, n, place, len(t.codes[n]), t.whole[n]) for k, run, n, place in t.runs], "k int, run long, template int, t_place int, size int, whole boolean")
    votes = (
        scanned.where(F.size("hits") > 0).dropDuplicates(["key"]).select("key", F.inline("hits")).join(F.broadcast(places), ["k", "run"])
        .groupBy("key", "template", "whole", "size", (F.col("place") - F.col("t_place")).alias("diagonal")).agg(F.count("*").alias("votes"))
    )
    near = Window.partitionBy("key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > F.when(F.col("whole"), 0).otherwise(SLACK), F.lit(True))
    # a row of diagonals that is wider than a span is cut into halves of spans, and each two neighbours are one
    chain = Window.partitionBy("key", "template", "run")
    half = F.greatest(F.lit(SLACK), F.floor(F.col("size") * SPREAD)).cast("int")
    pieces = F.when(F.col("_width") < 2 * half, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.floor(F.col("_along") / half) - 1, F.floor(F.col("_along") / half)))
    spans = (
        votes.withColumn("run", F.sum(far.cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_along", F.col("diagonal") - F.min("diagonal").over(chain)).withColumn("_width", F.max("diagonal").over(chain) - F.min("diagonal").over(chain))
        .withColumn("piece", F.explode(pieces)).where("piece >= 0")
        .groupBy("key", "template", "size", "run", "piece").agg(F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.sum("votes").alias("votes"))
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("first"), (F.col("last") + F.col("size")).alias("end"), "template", "votes"))).alias("spans"))
    )

    def verify(batch: pa.RecordBatch):
        out = []
        for codes, spans in zip(batch.column("codes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            kept = []
            words = np.frombuffer(codes or b"", dtype=np.int32)
            for s in spans or []:
                n = s["template"]
                begin, end = max(0, s["first"]), min(len(words), s["end"])
                own = words[begin:end]
                size = len(t.codes[n])
                if t.whole[n]:
                    found, first, last = size * np.array_equal(own, t.codes[n]), 0, len(own)
                elif t.members[n][own].sum() < min_score * size:
                    # not enough of the template's words, in any order
                    continue
                else:
                    found, first, last = common_words(own, t.codes[n])
                score = 2 * found / (size + last - first)
                if found >= (1.0 if t.whole[n] else min_score) * size and score >= min_score and all(stands_in(run, own[first:last]) for run in t.needs[n]):
                    kept.append({"label": t.labels[n], "whole": t.whole[n], "first": begin + first, "last": begin + last - 1, "score": score, "found": found})
            out.append([{c: v for c, v in s.items() if c != "found"} for s in best_of(kept)])
        kind = pa.list_(pa.struct([("label", pa.string()), ("whole", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("n_words"), pa.array(out, kind)], names=["key", "doc_id", "n_words", "spans"])

    return map_batches(scanned.join(spans, "key", "left").select("key", "doc_id", "n_words", "codes", "spans"), verify, "key long, doc_id long, n_words long, spans array<struct<label:string,whole:boolean,first:long,last:long,score:double>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The rows of the query: counts, places and labels of each document."""
    base = F.filter("spans", lambda s: s["whole"])
    labels = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    firsts = F.transform(base, lambda s: s["first"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
