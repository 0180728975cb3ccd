"""Spelling variants against plain loops over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reachspan.llm import _text as X
from reachspan.llm import spelling

SCHEMA = "doc_id long, text string, word string, key int, n int, form int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(rows, damage=199):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    rows = {}
    for w, n in counts.items():
        near = [o for o in counts if o != w and one_edit(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] < 5 * n:
            best = None
        rows[w] = [best, n, len(near), counts[best] if best else None]
    out = []
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, n_near, form_n))
    return sorted(out)


def told(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def changed(rng, word, letters):
    i, c = rng.randrange(len(word)), rng.choice(letters)
    return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


def corpus(seed, n, letters="abéÿÀ"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words = base + [changed(rng, w, letters) for w in base for _ in range(3)]
    words += [changed(rng, w, letters) for w in words if len(w) > 1]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) + rng.choice([".", "×3", "\n", ""])) for i in range(n)]


ODD = [(900, None), (901, ""), (902, "- 12 \n"), (None, "without number " * 6), (903, "anlonger" * 2000 + " "), (7, "repeated Repeated REPEATED repeated repeated"), (7, "repeated Repeated REPEATED repeated repeated")]


def test_crc_of_spans():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(500))
    spans = [(b := rng.randrange(500), rng.randint(b, 500)) for _ in range(200)]
    states = [zlib.crc32(str(i).encode()) for i in range(200)]
    got = spelling._crc32(np.array(states, np.uint32), np.frombuffer(data, np.uint8), np.array([b for b, _ in spans]), np.array([e for _, e in spans]))
    assert got.tolist() == [zlib.crc32(data[b:e], s) for (b, e), s in zip(spans, states, strict=True)]


def test_runs():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aZé×÷ÿĀ漢À .1") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for block in X.blocks(pa.array(texts), 300):
        data, begin, end, row = spelling.runs(block)
        got = [[] for _ in range(len(block))]
        for b, e, r in zip(begin, end, row, strict=True):
            got[r].append(data[b:e].tobytes().decode())
        assert got == [[lower(x) for x in re.findall("[A-Za-zÀ-ÿ]+", t)] for t in texts[block.first : block.first + len(block)]]


@pytest.mark.parametrize("damage", [199, 3])
def test_variants(spark, damage):
    rows = corpus(1, 120) + ODD
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    counts = plain_words(rows, damage)
    assert counts and told(spelling.variants(spelling.words(df, damage))) == plain_variants(counts)


def test_crowded_halves(spark, monkeypatch):
    """Keys that many words share are split, down to single letters, and nothing is lost."""
    monkeypatch.setattr(spelling, "CROWDED", 3)
    monkeypatch.setattr(spelling, "SHARD", 50)
    rng = random.Random(9)
    words = {"common" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(250)} | {"".join(rng.choice("ab") for _ in range(6)) + "ending" for _ in range(60)}
    found = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = sorted((r.word, r.other) for r in spelling.near(found.select("word")).collect())
    assert got == sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))
    assert spelling._keys(found.select("word")).groupBy("key").count().where("count > 3").isEmpty() or spelling._keys(found.select("word")).where("e - b > 1").groupBy("key").count().where("count > 3").isEmpty()


def test_chain_of_forms(spark):
    """Roots are followed to the end of a chain; ties go to the smaller word."""
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 20000, "zzzzzz": 5, "zzzzzy": 25, "zzzzzx": 25}
    got = told(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain_variants(counts)
    assert {r[0]: r[2] for r in got}["aaaaaa"] == "abbbbb" and {r[0]: r[1] for r in got}["zzzzzz"] == "zzzzzx"


def test_empty(spark):
    assert spelling.variants(spelling.words(spark.createDataFrame([], SCHEMA))).count() == 0
    assert spelling.variants(spelling.words(spark.createDataFrame([(1, None, "", 1, 1, 1), (2, "short", "", 1, 1, 1)], SCHEMA))).count() == 0
