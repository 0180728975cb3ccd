"""Token counts with overlap resynchronisation.

Documents above `chunk` characters are cut into chunks that overlap by `overlap` characters on each side of
a cut.  Every chunk is encoded on its own, with the offsets of its tokens; two neighbours are spliced at
a boundary that both have in their overlap and that is stable: white space stands before it, and tokenizers
of this kind drop white space and encode what stands between on its own, so no context reaches over it.
Where neighbours have no such boundary in common, the document is cut again with a wider overlap, at last
into one chunk.  Chunks of one document are spread over tasks; a document of one chunk needs no splice.

The encoder asks the library once for each distinct piece between white space, and keeps a bounded number of answers.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import cut, keyed, map_batches

CHUNK = 65536
OVERLAP = 512
#: The encoder's pieces come from blocks of so many bytes; so many answers are kept.
BLOCK = 8 << 20
KEPT = 600_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Counts the tokens of pieces without white space, by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def counts(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        if missing := [p for p in pieces if p not in known]:
            if len(known) + len(missing) > KEPT:
                known.clear()
                missing = pieces
            for i in range(0, len(missing), 4096):
                part = missing[i : i + 4096]
                known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def block(self, block: X.Block) -> tuple[X.Words, np.ndarray]:
        """The pieces of a block and each one's number of tokens."""
        visible = X.VISIBLE[block.data]
        inner = block.data[visible]
        places = np.flatnonzero(np.diff(np.concatenate([[False], visible, [False]]).astype(np.int8)))
        begin, end = places[::2], places[1::2]
        # a piece that runs over rows' ends is cut there
        edges = block.at[1:-1]
        inside = edges[np.searchsorted(begin, edges, side="left") > np.searchsorted(end, edges, side="right")]
        inside = np.unique(inside)
        begin, end = np.sort(np.concatenate([begin, inside])), np.sort(np.concatenate([end, inside]))
        offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(inner)).dictionary_encode()
        counts = self.counts(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()] if len(begin) else np.zeros(0, np.int64)
        return X.Words(begin, end, np.searchsorted(begin, block.at), np.zeros(len(begin), np.uint64)), counts


def _encoded(path: str, overlap: int):
    """Encodes chunks: each one's tokens, and in its overlaps the stable boundaries: (character in the document, tokens of the chunk before it)."""

    def encode(batch: pa.RecordBatch):
        coder = Encoder.of(path)
        for block in X.blocks(batch.column("text"), BLOCK):
            pieces, counts = coder.block(block)
            part = batch.slice(block.first, len(block))
            totals = X.row_sums(counts, pieces.at)
            heads, tails = [None] * len(block), [None] * len(block)
            for i, (start, last) in enumerate(zip(part.column("start").to_pylist(), part.column("last").to_pylist(), strict=True)):
                if start == 0 and last:
                    continue
                lo, hi = pieces.at[i], pieces.at[i + 1]
                row = block.data[block.at[i] : block.at[i + 1]]
                char = np.concatenate([[0], np.cumsum((row & 0xC0) != 0x80)])
                # a piece is stable if white space stands before it in this chunk
                at = char[pieces.begin[lo:hi] - block.at[i]]
                before = np.concatenate([[0], np.cumsum(counts[lo:hi])])[:-1]
                stable = at > 0
                head, tail = stable & (at < 2 * overlap), stable & (at >= char[-1] - 2 * overlap)
                point = lambda which: [{"at": int(a) + start, "before": int(b)} for a, b in zip(at[which], before[which], strict=True)]  # noqa: B023, E731
                heads[i], tails[i] = point(head) if start else None, None if last else point(tail)
            kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), part.column("n_bytes"), part.column("chunk"), pa.array(totals), pa.array(heads, kind), pa.array(tails, kind)], names=["key", "doc_id", "n_bytes", "chunk", "total", "head", "tail"])

    return encode


_CODED = "key long, doc_id long, n_bytes long, chunk long, total long, head array<struct<at:long,before:long>>, tail array<struct<at:long,before:long>>"


def _splice(batch: pa.RecordBatch):
    """Joins a document's chunks; n_tokens is null if two neighbours have no stable boundary in common."""
    totals = []
    for chunks in batch.column("chunks").to_pylist():
        tokens, skipped = 0, 0
        for c, after in zip(chunks, [*chunks[1:], None], strict=True):
            if after is None:
                tokens += c["total"] - skipped
                break
            left, right = ({p["at"]: p["before"] for p in points or []} for points in (c["tail"], after["head"]))
            shared = sorted(p for p in left.keys() & right.keys() if left[p] >= skipped)
            if not shared:
                tokens = None
                break
            at = shared[len(shared) // 2]
            tokens += left[at] - skipped
            skipped = right[at]
        totals.append(tokens)
    yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())], names=["key", "doc_id", "n_bytes", "n_tokens"])


def count_tokens(documents: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row.

    Null and empty texts have no bytes and no tokens; a repeated row is counted again; other columns are
    not read.  `tokenizer` is the path of a tokenizers file, on every executor.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("the overlap needs to be positive and at most half of the chunk")
    rows = keyed(documents).withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = "key long, doc_id long, n_bytes long, n_tokens long"
    small = rows.where(F.col("n_bytes") <= chunk).select("*", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("start"), F.lit(True).alias("last"))
    done = map_batches(small, _encoded(tokenizer, overlap), _CODED).select("doc_id", "n_bytes", F.col("total").alias("n_tokens"))
    huge, copies = rows.where(F.col("n_bytes") > chunk), F.count("*").alias("copies")
    left = cut(huge.groupBy("key", "doc_id", "n_bytes").agg(copies, F.any_value("text").alias("text"), F.char_length(F.any_value("text")).cast("long").alias("n_chars")))
    while True:
        cuts = F.greatest(F.ceil(F.col("n_chars") / chunk), F.lit(1))
        begin = f"greatest(chunk * {chunk} - {overlap}, 0)"
        chunks = left.withColumn("cuts", cuts).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select(
            "key", "doc_id", "n_bytes", "chunk", F.expr(begin).alias("start"), (F.col("chunk") == F.col("cuts") - 1).alias("last"),
            F.expr(f"substring(text, cast({begin} + 1 as int), cast((chunk + 1) * {chunk} + {overlap} - {begin} as int))").alias("text"),
        )
        coded = map_batches(chunks.repartition("key", "chunk"), _encoded(tokenizer, overlap), _CODED)
        whole = coded.groupBy("key", "doc_id", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("chunk", "total", "head", "tail"))).alias("chunks"))
        spliced = cut(map_batches(whole, _splice, schema).join(left.select("key", "copies"), "key"))
        done = done.unionByName(spliced.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("col"))
        missed = spliced.where("n_tokens is null").select("key")
        if missed.isEmpty():
            return done
        left = cut(left.join(missed, "key", "left_semi"))
        chunk, overlap = chunk * 4, overlap * 16 if overlap * 16 <= chunk * 2 else chunk * 2
