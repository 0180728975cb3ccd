"""The isolation forest: kinds of junk, each a minority of the bad rows, and verdicts against trees walked one by one."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from reachspan.llm import _text as X
from reachspan.llm import rules


def prose(rng):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(80, 160))]
    lines = [" ".join(words[i : i + 12]).capitalize() + rng.choice([".", ".", "!"]) for i in range(0, len(words), 12)]
    if rng.random() < 0.2:
        lines.append(f"In {rng.randint(1900, 2020)} there were {rng.randint(1, 99)}.")
    return "\n".join(lines)


def spoiled(rng, text, kind):
    words = text.split(" ")
    for i in range(len(words)):
        if kind == "symbols" and rng.random() < 0.4:
            words[i] += " " + rng.choice("#*$%&|<>")
        elif kind == "digits" and rng.random() < 0.6:
            words[i] = str(rng.randint(1000, 99999))
        elif kind == "capitals" and rng.random() < 0.9:
            words[i] = words[i].upper()
    return " ".join(words)


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(i, prose(rng), 1) for i in range(2500)]
    for kind, n in (("symbols", 150), ("digits", 50), ("capitals", 50)):
        rows += [(10_000 + len(rows) + i, spoiled(rng, prose(rng), kind), 0, kind) for i in range(n)]
    return rows


def test_kinds_of_junk(spark):
    rows = corpus()
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    forest = rules.fit(documents, labels)
    kept = {r.doc_id: r.kept for r in rules.judge(documents, forest).collect()}
    for kind in ("symbols", "digits", "capitals"):
        assert np.mean([not kept[r[0]] for r in rows if r[3:] == (kind,)]) >= 0.95
    assert np.mean([kept[r[0]] for r in rows if r[2] == 1]) >= 0.99
    # equal for the rows in another order, also where rows of one id differ
    twice = documents.union(spark.createDataFrame([(r[0], rows[0][1]) for r in rows[:200]], documents.schema))
    again = rules.fit(twice.repartition(3), labels)
    other = rules.fit(twice.orderBy("text"), labels)
    assert again.threshold == other.threshold and (again.value == other.value).all()


def walked(forest, point):
    """Mean path over trees, each walked from its root."""
    total = 0.0
    for feature, value in zip(forest.feature, forest.value, strict=True):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + 1 + int(point[forest.used[feature[node]]] > value[node])
        total += value[node]
    return 2.0 ** (-total / len(forest.feature) / forest.norm)


def test_verdicts_against_trees(spark):
    rows = [r[:3] for r in corpus(3)][::9] + [(5, None, 1), (6, "", 1), (None, "a b", 1), (7, "x " * 3000, 1), (8, "#" * 10_000, 0)]
    documents = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, quality int, kept int")
    forest = rules.fit(documents, documents.select("doc_id", "quality"))
    got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept, round(r.score, 9)) for r in rules.judge(documents, forest).collect())
    want = []
    for doc_id, text, _ in rows:
        (block,) = X.blocks(pa.array([text], pa.string()))
        counts = rules.statistics(block)
        score = walked(forest, rules.features(counts)[0])
        words, repeats = int(counts["n_words"][0]), int(counts["n_repeat_words"][0])
        failed = words < 50 or 100 * repeats > 50 * words
        want.append((str(doc_id), words, failed, not failed and score <= forest.threshold, round(score, 9)))
    assert got == sorted(want)
    assert rules.keep(documents, forest).count() == sum(w[3] for w in want)


def test_telling():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (3000, 3)), rng.normal(0, 1, (400, 3))
    bad[:20, 1] += 9
    assert rules.telling(good, bad).tolist() == [1]
    assert rules.telling(good, good[:50]).tolist() == [0, 1, 2] and rules.telling(good, bad[:0]).tolist() == [0, 1, 2]


def test_counts_take_bounded_memory():
    """Eight MB of texts in one batch are looked at in blocks."""
    texts = pa.array([("some words of a line %d, and more of them\n" % i) * 50 for i in range(4000)])
    next(rules.counted(texts.slice(0, 400)))
    tracemalloc.start()
    n = sum(len(block) for block, _ in rules.counted(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 and peak < 100 << 20
