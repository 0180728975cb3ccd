"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one last token belongs to the exact encoding.  It is among the
tokens that are suffixes of the prefix, which an automaton of the vocabulary lists for the state
after the prefix, longest first; it is the one that is compatible with the last token of the prefix before
it, that is, a pair that BPE would leave as it is.  Storing that token for every prefix takes time linear in
the text, however the merges interact; back-pointers then give the ids.

The programme runs over all distinct pre-tokens of a block at once, position by position, in NumPy.
Documents are cut where white space follows other text, which the pre-tokenizer never joins; distinct pieces
are encoded once and a bounded number of them is kept.  Each document is one row's work, without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _text as X
from ._spark import keyed, map_batches

BLOCK = 4 << 20
KEPT = 300_000
_NONE = np.int64(1 << 40)

# White space of the pre-tokenizer, and its pattern.
_SPACE = "\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_WIDE_SPACE = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

_coders: dict[str, Coder] = {}


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a visible Latin-1 byte stands for itself, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class Coder:
    """Vocabulary, merges and automaton of a byte-level tokenizers file.

    Tokens are numbered as they come into being: 0 to 255 are the bytes, 256 + r is what merge r makes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["ignore_merges"]:
            raise ValueError("not a byte-level BPE file of the supported kind")
        symbols, vocabulary = byte_symbols(), model["vocab"]
        raw = lambda token: bytes(symbols[c] for c in token)
        own = {bytes([b]): b for b in range(256)}
        left, right = [*range(256)], [*range(256)]
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = raw(a), raw(b)
            left.append(own[a])
            right.append(own[b])
            if own.setdefault(a + b, 256 + n) != 256 + n:
                raise ValueError("two merges make one token")
        self.tokens = list(own)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        to_id = {raw(t): i for t, i in vocabulary.items()}
        self.ids = np.array([to_id[t] for t in self.tokens], np.uint32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        keys = (self.left[256:] << 20) | self.right[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order + 256
        self._automaton()
        by_id = to_id | {t.encode(): i for t, i in self.special.items()}
        spelled = [b""] * (max(by_id.values()) + 1)
        for t, i in by_id.items():
            spelled[i] = t
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(t) for t in spelled])])
        # what all special strings begin with tells most pieces without any apart
        self.special_start = os.path.commonprefix(list(self.special))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(_PATTERN)
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> Coder:
        if path not in _coders:
            _coders[path] = Coder(path)
        return _coders[path]

    def _automaton(self) -> None:
        """States are prefixes of tokens; `step` leads on, `longest` is the longest token that ends in a state, `shorter` the next one down."""
        data = np.frombuffer(b"".join(self.tokens), np.uint8).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        node = np.zeros(len(self.tokens), np.int64)
        levels, n = [], 1
        for depth in range(int(self.size.max())):
            on = np.flatnonzero(self.size > depth)
            edges, which = np.unique(node[on] * 256 + data[at[on] + depth], return_inverse=True)
            node[on] = n + which
            levels.append((edges >> 8, edges & 255, n + np.arange(len(edges))))
            n += len(edges)
        step, fail, longest = np.zeros((n, 256), np.int32), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        longest[node] = np.arange(len(self.tokens))
        for depth, (parent, byte, child) in enumerate(levels):
            fail[child] = 0 if depth == 0 else step[parent, byte]
            step[parent, byte] = child
            if depth:
                none = child[longest[child] < 0]
                longest[none] = longest[fail[none]]
            step[child] = step[fail[child]]
        self.step, self.longest = step, longest
        self.shorter = longest[fail[node]]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the text of tokens a, b as these two.

        Merges are undone from the latest; where the parts that then meet at the boundary have a merge that comes
        before the one undone last, BPE would have joined them across the boundary.
        """
        good = np.ones(len(a), bool)
        open_, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), _NONE)
        while len(open_):
            keys = (a << 20) | b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)
            clash = rank < limit
            good[open_[clash]] = False
            on = ~clash & ((a >= 256) | (b >= 256))
            open_, a, b = open_[on], a[on], b[on]
            first = a > b
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def encode(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, one after the other, and each one's number of ids."""
        size = np.array([len(p) for p in pretokens], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(pretokens), np.uint8)
        start = (np.cumsum(size) - size)[order]
        length = size[order]
        row = start + order  # place 0 of each pre-token's prefixes: one more than its bytes
        last, count = np.full(len(data) + len(size), -1, np.int64), np.zeros(len(data) + len(size), np.int64)
        state = np.zeros(len(size), np.int64)
        for p in range(1, int(length[0]) + 1 if len(length) else 1):
            n = int(np.searchsorted(-length, -p, side="right"))
            state = self.step[state[:n], data[start[:n] + p - 1]].astype(np.int64)
            todo, token = np.arange(n), self.longest[state]
            while len(todo):
                before = row[todo] + p - self.size[token]
                previous = last[before]
                fits = previous < 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self.compatible(previous[inner], token[inner])
                done = todo[fits]
                last[row[done] + p], count[row[done] + p] = token[fits], count[before[fits]] + 1
                todo, token = todo[~fits], self.shorter[token[~fits]]
        counts = np.zeros(len(size), np.int64)
        counts[order] = count[row + length]
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        begin, at, on = (ends - counts)[order], row + length, np.flatnonzero(length)
        while len(on):
            token = last[at[on]]
            out[begin[on] + count[at[on]] - 1] = self.ids[token]
            at[on] -= self.size[token]
            on = on[at[on] > row[on]]
        return out, counts

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that are not known yet."""
        cuts, distinct = [], {}
        for piece in pieces:
            parts = []
            for part in self.split_special.split(piece) if self.split_special and self.special_start in piece else (piece,):
                if part in self.special:
                    parts.append(-1 - self.special[part])
                elif part:
                    parts += [distinct.setdefault(x, len(distinct)) for x in self.pattern.findall(part)]
            cuts.append(parts)
        ids, counts = self.encode([x.encode() for x in distinct])
        ends = np.cumsum(counts) * 4
        raw, begin, end = ids.astype("<u4").tobytes(), (ends - counts * 4).tolist(), ends.tolist()
        self.pieces.update((piece, b"".join([raw[begin[x] : end[x]] if x >= 0 else int(-1 - x).to_bytes(4, "little") for x in parts])) for piece, parts in zip(pieces, cuts, strict=True))

    def block(self, block: X.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's rows and the offsets of each row's ids."""
        data = block.data
        space = ~X.VISIBLE[data]
        any_space = space
        raw = data.tobytes()
        if wide := [m.span() for m in _WIDE_SPACE.finditer(raw)]:
            any_space = space | X.covered(len(data), np.array([a for a, _ in wide]), np.array([b for _, b in wide]))
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & ~any_space[:-1]
        cut[block.at] = True
        cuts = np.flatnonzero(cut)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
        coded = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        missing = [p for p in pieces if p not in self.pieces]
        if missing:
            if len(self.pieces) + len(missing) > KEPT:
                self.pieces.clear()
                missing = pieces
            self.learn(missing)
        known = [self.pieces[p] for p in pieces]
        table, size = np.frombuffer(b"".join(known), "<u4"), np.array([len(k) >> 2 for k in known])
        at = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        counts = size[which]
        return table[X.ragged(at[which], counts)], np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cuts, block.at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids' text, and the offsets of each row's bytes."""
        size = np.diff(self.spelled_at)[ids]
        return self.spelling[X.ragged(self.spelled_at[ids], size)], np.concatenate([[0], np.cumsum(size)])[at]


def encode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """key, doc_id and ids (little-endian unsigned 32-bit integers) of each document, for storage."""

    def ids_of(batch: pa.RecordBatch):
        coder = Coder.of(tokenizer)
        for block in X.blocks(batch.column("text"), BLOCK):
            ids, at = coder.block(block)
            part = batch.slice(block.first, len(block))
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array([raw[a * 4 : b * 4] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["key", "doc_id", "ids"])

    return map_batches(keyed(documents), ids_of, "key long, doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """key, doc_id and text of each row of `encode`."""

    def texts(batch: pa.RecordBatch):
        coder = Coder.of(tokenizer)
        out = []
        for raw in batch.column("ids").to_pylist():
            ids = np.frombuffer(raw or b"", "<u4")
            out.append(coder.decode(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(out, pa.string())], names=["key", "doc_id", "text"])

    return map_batches(encoded, texts, "key long, doc_id long, text string")


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    Ids are hashed as little-endian unsigned 32-bit integers, decoded text in UTF-8.  Null and empty texts have no tokens
    and an empty text; a repeated row is given again; special tokens' strings in texts become their ids.
    """

    def check(batch: pa.RecordBatch):
        coder = Coder.of(tokenizer)
        for block in X.blocks(batch.column("text"), BLOCK):
            ids, at = coder.block(block)
            text, text_at = coder.decode(ids, at)
            raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(text.tobytes())
            part = batch.slice(block.first, len(block))
            sha = lambda view, ends, width: [hashlib.sha256(view[a * width : b * width]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(sha(raw, at, 4)), pa.array(sha(text, text_at, 1))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(keyed(documents).drop("key"), check, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
