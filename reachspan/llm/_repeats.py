"""Windows of consecutive units that also start in a document with a smaller id, over a whole corpus.

1. Every document is cut into anchored segments (see _segments).  A task resolves what it can: of equal segments only those of
   the smallest document go on, in compact arrays dealt by anchor; later documents' equal segments are repeated for certain.
2. For each anchor: segments equal to one of a smaller document are repeated as a whole.  Of unequal segments with one
   anchor those that also agree in what stands before or after it, as every common window must, are open.
3. Open segments' units are fetched from their documents and dealt by anchor again; the method's own test
   (`refine`) tells which of their windows start in a smaller document.  Anchors with very many open segments are dealt
   by whole windows instead, so that no group grows with the corpus; equal windows are combined by their smallest documents before.
4. Repeated spans meet their documents.

Texts pass a shuffle only where a bitmap of fixed size (2 MB) says that a document may be concerned.  Buckets
are sized from the corpus' bytes; nothing is collected but that bitmap and counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._segments import Segments
from ._spark import cut, small_batches

#: Bytes of text that one bucket stands for, and records that a task combines at once.
BUCKET_BYTES = 4 << 20
COMBINED = 1 << 19
BLOCK_BYTES = 1 << 20
BITMAP_BITS = 1 << 24
_LAST = (1 << 63) - 1
_DEALT = "bucket int, open boolean, data binary, keys array<long>, units long"


def pack(**columns: np.ndarray) -> bytes:
    """Columns of one length, each laid out by byte planes, which compress well in a shuffle."""
    n = len(next(iter(columns.values())))
    return n.to_bytes(8, "little") + b"".join(c.view(np.uint8).reshape(n, -1).T.tobytes() for c in (np.ascontiguousarray(c) for c in columns.values()))


def unpack(blobs: list, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {c: [] for c in kinds}
    for blob in blobs:
        n, at = int.from_bytes(blob[:8], "little"), 8
        for c, kind in kinds.items():
            width = np.dtype(kind).itemsize
            parts[c].append(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind)[:, 0] if n else np.zeros(0, kind))
            at += n * width
    return {c: np.concatenate(p) if p else np.zeros(0, kinds[c]) for c, p in parts.items()}


def _take(columns: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[which] for c, v in columns.items()}


_RECORD = {"anchor": np.uint64, "content": np.uint64, "did": np.int64, "key": np.int64, "begin": np.uint32, "windows": np.uint16, "place": np.uint16, "left": np.uint8, "right": np.uint8}
_SPAN = {"key": np.int64, "begin": np.uint32, "end": np.uint32}
_OPEN = {"anchor": np.uint64, "did": np.int64, "key": np.int64, "begin": np.uint32, "windows": np.uint16, "hot": np.uint8}
_SENT = {"anchor": np.uint64, "did": np.int64, "key": np.int64, "begin": np.uint32, "windows": np.uint16}


def _group_ids(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys, which are sorted."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _extent(group: np.ndarray, did: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest did of each row's group; groups are sorted runs."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return np.minimum.reduceat(did, starts)[group], np.maximum.reduceat(did, starts)[group]


def _others(anchor: np.ndarray, side: np.ndarray, did: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which rows have another document's row with the same anchor and side."""
    out = np.zeros(len(anchor), bool)
    at = np.flatnonzero(valid)
    if len(at):
        order = at[np.lexsort((side[at], anchor[at]))]
        low, high = _extent(_group_ids(anchor[order], side[order]), did[order])
        out[order] = low < high
    return out


class Repeats:
    """The operator for one kind of unit.

    units(block): unit hashes and row offsets.  raw(block): units as they are sent, of type `dtype`.
    refine(units, at, did, anchor, window): for segments of such units, with their offsets, documents and anchors, a mask
    of the units: true where a window begins that also occurs in a segment of a smaller document with the same anchor.
    """

    def __init__(self, units: Callable, raw: Callable, refine: Callable, dtype: type, window: int, k: int, at_once: int):
        if not 1 <= k < window or window - k > 60_000:
            raise ValueError("k needs to be smaller than the window")
        self.units, self.raw, self.refine, self.dtype, self.window, self.k, self.at_once = units, raw, refine, dtype, window, k, at_once
        self.left = (window - k) // 2
        self.right = window - k - self.left + 1

    # -- steps on arrays ---------------------------------------------------------------------------------------------

    def records(self, block: X.Block, did: np.ndarray, key: np.ndarray) -> dict[str, np.ndarray]:
        units, at = self.units(block)
        s = Segments(units, at, self.window, self.k)
        if not len(s.row):
            return {c: np.zeros(0, k) for c, k in _RECORD.items()}
        place = at[s.row] + s.begin + s.place
        has_left, has_right = s.place >= self.left, s.place - s.windows + 1 < self.left
        side = lambda begin, end, has: np.where(has, X.span_hash(s.sums, np.where(has, begin, 0), np.where(has, end, 0)).astype(np.uint8), 0).astype(np.uint8)
        return {
            "anchor": s.anchor, "content": s.content, "did": did[s.row], "key": key[s.row], "begin": s.begin.astype(np.uint32), "windows": s.windows.astype(np.uint16),
            "place": s.place.astype(np.uint16), "left": side(place - self.left, place, has_left), "right": side(place + self.k, place + self.k + self.right, has_right),
        }

    def combine(self, records: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Records of each content's smallest document, sorted by anchor, and the spans of the others."""
        r = _take(records, np.lexsort((records["did"], records["content"], records["anchor"])))
        if not len(r["did"]):
            return r, self.spans(r)
        low, _ = _extent(_group_ids(r["anchor"], r["content"]), r["did"])
        first = r["did"] == low
        return _take(r, first), self.spans(_take(r, ~first))

    def spans(self, r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Merged spans of whole segments."""
        return merge(r["key"], r["begin"].astype(np.int64), r["begin"].astype(np.int64) + r["windows"] - 1 + self.window)

    def open_segments(self, r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Segments that may share windows with unequal ones; r: as from `combine`."""
        if not len(r["did"]):
            return {c: np.zeros(0, k) for c, k in _OPEN.items()}
        place = r["place"].astype(np.int64)
        least = place - r["windows"] + 1
        content = _group_ids(r["anchor"], r["content"])
        single = np.flatnonzero(np.diff(content, prepend=-1))  # one record of each content stands for the others
        pairs = np.zeros(len(content), bool)
        a, d = r["anchor"][single], r["did"][single]
        pairs[single] = _others(a, r["left"][single], d, place[single] >= self.left) | _others(a, r["right"][single], d, least[single] < self.left)
        open_ = pairs[single][content]
        r = _take(r, open_)
        size = np.unique(r["anchor"], return_inverse=True, return_counts=True) if len(r["anchor"]) else (None, np.zeros(0, int), np.zeros(0, int))
        return {**{c: r[c] for c in ("anchor", "did", "key", "begin", "windows")}, "hot": (size[2][size[1]] > self.at_once).astype(np.uint8)}

    def sent_units(self, s: dict[str, np.ndarray]) -> np.ndarray:
        """Units that each open segment takes when it is sent, whole or by windows."""
        windows = s["windows"].astype(np.int64)
        return np.where(s["hot"] > 0, windows * self.window, windows - 1 + self.window)

    # -- the job -----------------------------------------------------------------------------------------------------

    def find(self, documents: DataFrame, result: Callable, schema: str) -> DataFrame:
        """`result(doc_id, block, row, begin, end)` of all documents, a record batch for each block: spans [begin, end) of repeated units and the rows that they are in.

        Rows without id come after all others; documents with one id do not count for each other.
        """
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        small_batches(documents.sparkSession)
        did = F.coalesce(F.col("doc_id"), F.lit(_LAST))
        unique = rows.groupBy("doc_id").count().where("count > 1").isEmpty()
        rows = rows.select(did.alias("key") if unique else F.xxhash64("doc_id", "text").alias("key"), "doc_id", did.alias("did"), "text")
        total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        buckets = max(1, -(-int(total) // BUCKET_BYTES))
        me = self

        def shipped(batches: Iterator[pa.RecordBatch]):
            held, n = [], 0

            def flush():
                records, spans = me.combine({c: np.concatenate([h[c] for h in held]) for c in _RECORD})
                # anchors are minima, so most are small numbers: they are mixed before they are dealt
                bucket = (X.mix(records["anchor"]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                out = [(b, True, pack(**_take(records, order[which])), None, None) for b, which in _runs(bucket[order])]
                yield _batch(out + deal(spans, buckets))

            for batch in batches:
                for block in X.blocks(batch.column("text"), BLOCK_BYTES):
                    part = batch.slice(block.first, len(block))
                    held.append(me.records(block, part.column("did").to_numpy(), part.column("key").to_numpy()))
                    n += len(held[-1]["did"])
                    if n >= COMBINED:
                        yield from flush()
                        held, n = [], 0
            if held:
                yield from flush()

        def decided(table):
            ships = np.array(table.column("open").to_pylist(), bool)
            blobs = table.column("data").to_pylist()
            records, spans = me.combine(unpack([b for b, s in zip(blobs, ships, strict=True) if s], _RECORD))
            found = unpack([b for b, s in zip(blobs, ships, strict=True) if not s], _SPAN)
            spans = {c: np.concatenate([spans[c], found[c]]) for c in _SPAN}
            open_ = me.open_segments(records)
            return _table(deal(spans, buckets) + deal(open_, buckets, me.sent_units(open_)))

        dealt = cut(rows.select("key", "did", "text").mapInArrow(shipped, _DEALT).groupBy("bucket").applyInArrow(decided, _DEALT))
        asked = concerned(rows, bitmap(dealt.where("open")))
        sent = dealt.where("open").agg(F.sum("units").alias("n")).first().n or 0
        shards = max(1, -(-int(sent) // (self.at_once * self.window)), buckets // 4)

        def fetched(left, right):
            if not right.num_rows:
                return _table([])
            segments = unpack(right.column("data").to_pylist(), _OPEN)
            segments = _take(segments, np.argsort(segments["key"], kind="stable"))
            out = []
            for block in X.blocks(left.column("text"), BLOCK_BYTES):
                key = left.column("key").slice(block.first, len(block)).to_numpy()
                units, at = me.raw(block)
                key, row = np.unique(key, return_index=True)
                lo, hi = np.searchsorted(segments["key"], key, "left"), np.searchsorted(segments["key"], key, "right")
                which, row = X.ragged(lo, hi - lo), np.repeat(row, hi - lo)
                s = _take(segments, which)
                start, windows = at[row] + s["begin"].astype(np.int64), s["windows"].astype(np.int64)
                hot = s.pop("hot") > 0
                if hot.any():  # one record for each window
                    cold = np.flatnonzero(~hot)
                    each = np.repeat(np.flatnonzero(hot), windows[hot])
                    shift = X.ragged(np.zeros(hot.sum(), np.int64), windows[hot])
                    start = np.concatenate([start[cold], start[each] + shift])
                    s = {c: np.concatenate([v[cold], v[each]]) for c, v in s.items()}
                    s["begin"][len(cold) :] += shift.astype(np.uint32)
                    s["windows"][len(cold) :] = 1
                    windows = s["windows"].astype(np.int64)
                    sums = X.prefix(me.units(block)[0])
                    s["anchor"][len(cold) :] = X.span_hash(sums, start[len(cold) :], start[len(cold) :] + me.window)
                    # of equal windows only those of this block's smallest document go on
                    order = np.lexsort((s["did"][len(cold) :], s["anchor"][len(cold) :])) + len(cold)
                    low, _ = _extent(_group_ids(s["anchor"][order]), s["did"][order])
                    later = order[s["did"][order] > low]
                    if len(later):
                        out.append((int(s["key"][later[0]] % shards), False, pack(**me.spans(_take(s, later))), None, None))
                        on = np.ones(len(start), bool)
                        on[later] = False
                        s, start, windows = _take(s, on), start[on], windows[on]
                size = windows - 1 + me.window
                shard = (X.mix(s["anchor"]) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                for b, which in _runs(shard[order]):
                    o = order[which]
                    out.append((b, True, pack(**_take(s, o)) + units[X.ragged(start[o], size[o])].tobytes(), None, None))
            return _table(out)

        def refined(table):
            parts, units, whole = [], [], []
            for blob, sent in zip(table.column("data").to_pylist(), table.column("open").to_pylist(), strict=True):
                if not sent:
                    whole.append(blob)
                    continue
                parts.append(unpack([blob], _SENT))
                skip = 8 + len(parts[-1]["did"]) * sum(np.dtype(k).itemsize for k in _SENT.values())
                units.append(np.frombuffer(blob, me.dtype, -1, skip))
            known = unpack(whole, _SPAN)
            if not parts:
                return _table(deal(known, buckets))
            s = {c: np.concatenate([p[c] for p in parts]) for c in _SENT}
            windows = s["windows"].astype(np.int64)
            size = windows - 1 + me.window
            at = np.concatenate([[0], np.cumsum(size)])
            hit = me.refine(np.concatenate(units), at, s["did"], s["anchor"], me.window)
            places = np.flatnonzero(hit)
            row = np.searchsorted(at, places, side="right") - 1
            begin = s["begin"].astype(np.int64)[row] + places - at[row]
            found = {"key": s["key"][row], "begin": begin, "end": begin + me.window}
            return _table(deal(merge(*(np.concatenate([found[c], known[c].astype(np.int64)]) for c in _SPAN)), buckets))

        bucket = F.pmod("key", F.lit(buckets)).cast("int").alias("bucket")
        fetched_ = asked.select("key", "text", bucket).groupBy("bucket").cogroup(dealt.where("open").groupBy("bucket")).applyInArrow(fetched, _DEALT)
        spans = dealt.where("not open").unionByName(cut(fetched_.groupBy("bucket").applyInArrow(refined, _DEALT)))

        def cleaned(left, right):
            s = unpack(right.column("data").to_pylist(), _SPAN) if right.num_rows else {c: np.zeros(0, k) for c, k in _SPAN.items()}
            s = merge(s["key"], s["begin"].astype(np.int64), s["end"].astype(np.int64))
            out = []
            left = left.combine_chunks()
            for block in X.blocks(left.column("text"), BLOCK_BYTES):
                part = left.slice(block.first, len(block))
                out.append(result(part.column("doc_id").combine_chunks(), block, *_lists(s, part.column("key").to_numpy())))
            return pa.Table.from_batches(out or [result(pa.array([], pa.int64()), X.Block(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0), *[np.zeros(0, np.int64)] * 3)])

        bits = bitmap(spans)
        shared = rows.sparkSession.sparkContext.broadcast(bits)

        def untouched(batches: Iterator[pa.RecordBatch]):
            for batch in batches:  # the filter is here too, so that a task has one Python worker
                batch = _passed(batch, shared.value, False)
                for block in X.blocks(batch.column("text"), BLOCK_BYTES):
                    yield result(batch.column("doc_id").slice(block.first, len(block)), block, *[np.zeros(0, np.int64)] * 3)

        touched = concerned(rows, bits).select("key", "doc_id", "text", bucket)
        done = touched.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(cleaned, schema)
        return done.unionByName(_with_bit(rows).select("bit", "doc_id", "text").mapInArrow(untouched, schema))


def bitmap(dealt: DataFrame) -> np.ndarray:
    """Marks of the hashes of all keys, of fixed size."""
    bit = F.xxhash64("key").bitwiseAND(F.lit(BITMAP_BITS - 1))
    parts = dealt.select(F.explode("keys").alias("key")).groupBy((bit / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg((bit % 32768).cast("long")).alias("bits")).collect()
    marks = np.zeros(BITMAP_BITS >> 3, np.uint8)
    for p in parts:
        marks[p.part * 4096 : (p.part + 1) * 4096] = np.frombuffer(bytes(p.bits), np.uint8)
    return marks


def concerned(rows: DataFrame, marks: np.ndarray) -> DataFrame:
    """Rows whose keys are marked: some others may be, none is missed."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def passed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield _passed(batch, shared.value, True)

    marked = _with_bit(rows)
    return marked.mapInArrow(passed, marked.schema).drop("bit")


def _with_bit(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bit", F.xxhash64("key").bitwiseAND(F.lit(BITMAP_BITS - 1)))


def _passed(batch: pa.RecordBatch, marks: np.ndarray, wanted: bool) -> pa.RecordBatch:
    bit = batch.column("bit").to_numpy()
    return batch.filter(pa.array((marks[bit >> 3] >> (bit & 7) & 1 > 0) == wanted))


def merge(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Overlapping or touching spans of a key become one; sorted by key and begin."""
    order = np.lexsort((begin, key))
    key, begin, end = key[order], begin[order], end[order]
    if not len(key):
        return {"key": key, "begin": begin.astype(np.uint32), "end": end.astype(np.uint32)}
    # ends grow within a key once each key's are lifted above the ones before
    lift = _group_ids(key) * (np.int64(1) << 32)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(key), bool)
    new[1:] = begin[1:] + lift[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(key)) - 1
    return {"key": key[starts], "begin": begin[starts].astype(np.uint32), "end": (reach[last] - lift[last]).astype(np.uint32)}


def deal(columns: dict[str, np.ndarray], buckets: int, sent: np.ndarray | None = None) -> list[tuple]:
    """Rows of _DEALT, dealt by key; with the units that each open segment takes, these are open segments, else spans."""
    bucket = columns["key"] % buckets
    order = np.argsort(bucket, kind="stable")
    kinds, out = _SPAN if sent is None else _OPEN, []
    for b, which in _runs(bucket[order]):
        o = order[which]
        out.append((b, sent is not None, pack(**{c: columns[c][o].astype(k) for c, k in kinds.items()}), np.unique(columns["key"][o]), None if sent is None else int(sent[o].sum())))
    return out


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket of a sorted array, with its slice."""
    if not len(bucket):
        return
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(bucket)).tolist(), strict=True):
        yield int(bucket[lo]), slice(lo, hi)


_KINDS = [("bucket", pa.int32()), ("open", pa.bool_()), ("data", pa.binary()), ("keys", pa.list_(pa.int64())), ("units", pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _lists(s: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, begins and ends of the spans of rows with these keys, in order."""
    lo, hi = np.searchsorted(s["key"], keys, "left"), np.searchsorted(s["key"], keys, "right")
    which = X.ragged(lo, hi - lo)
    return np.repeat(np.arange(len(keys)), hi - lo), s["begin"].astype(np.int64)[which], s["end"].astype(np.int64)[which]
