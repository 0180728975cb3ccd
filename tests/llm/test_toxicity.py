"""Toxicity on held-out rows, the learner against a plain one, and which rows may be learned from."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from reachspan.llm import _text as X
from reachspan.llm import toxicity as T

SCHEMA = "doc_id long, text string, label int, score int, held_out int, toxic int"
BAD = ["vile", "rotten", "filthy"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        own, toxic = [rng.choice(words) for _ in range(rng.randint(5, 60))], int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                own.insert(rng.randint(0, len(own)), rng.choice(BAD))
        rows.append((i, " ".join(own)))
        labels.append((i, toxic))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out(spark):
    rows, labels = corpus(1500)
    odd = [(9000, None), (9001, ""), (9002, "  \n"), (None, "vile rotten filthy vile"), (9003, "vile " * 50000), (5, rows[5][1])]
    d, lab = frames(spark, rows + odd, labels + [(None, 1), (9001, None), (77777, 1)])
    model = T.fit(d, lab)
    assert 0 < len(model.coordinates) < 3000
    got = {}
    for r in T.score(d, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, rs in got.items() for r in rs)
    held = [(got[i][0].score, t) for i, t in labels if got[i][0].held_out]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([s >= 0.7 for s in toxic]) >= 0.95 and np.mean([s >= 0.7 for s in clean]) <= 0.01
    # empty texts score as the bias; one row's copies alike; ids and other columns do not count
    assert got[9000][0].score == got[9001][0].score == got[9002][0].score < 0.5
    assert len(got[5]) == 2 and got[5][0].score == got[5][1].score
    assert got[None][0].predicted == 1 and got[None][0].held_out is False and got[9003][0].predicted == 1


def test_labels_of_held_out_rows_do_not_count(spark):
    rows, labels = corpus(300, seed=2)
    d, lab = frames(spark, rows, labels)
    other = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels], "doc_id long, toxic int")
    a, b = T.fit(d, lab), T.fit(d, other)
    assert a.coordinates.tolist() == b.coordinates.tolist() and a.weights.tolist() == b.weights.tolist() and a.bias == b.bias


def test_learner_against_a_plain_one():
    rng = random.Random(4)
    learner, z, n = T.Learner(), {}, {}

    def weight(c):
        least = 0.0 if c == T.COORDINATES else T.L1
        own = z.get(c, 0.0)
        return 0.0 if abs(own) <= least else -(own - math.copysign(least, own)) / ((T.SMOOTHING + math.sqrt(n.get(c, 0.0))) / T.RATE + T.L2)

    for _ in range(300):
        at, label = sorted(rng.sample(range(40), rng.randint(0, 12))), rng.randint(0, 1)
        learner.learn(np.array(at, np.int64), label)
        ws = {c: weight(c) for c in [*at, T.COORDINATES]}
        g = (1 / (1 + math.exp(-sum(ws.values()))) - label) * (T.POSITIVE if label else 1)
        for c, w in ws.items():
            before = n.get(c, 0.0)
            z[c] = z.get(c, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / T.RATE * w
            n[c] = before + g * g
    cs = [*range(40), T.COORDINATES]
    assert np.allclose(learner.weights(np.array(cs)), [weight(c) for c in cs])


def test_features():
    texts = ["one two three two", "", "Alone", "one two three two"]
    for block in X.blocks(pa.array(texts)):
        row, at = T.features(block)
        own = [sorted(at[row == i].tolist()) for i in range(4)]
        assert [len(x) for x in own] == [4 + 3 + 2, 0, 1, 9] and own[0] == own[3]


def test_empty(spark):
    d, lab = frames(spark, [], [])
    model = T.fit(d, lab)
    assert T.score(d, model).count() == 0 and not len(model.coordinates)
    d, _ = frames(spark, [(1, "some text"), (2, None)], [])
    assert [(r.score, r.predicted) for r in T.score(d, model).collect()] == [(0.5, 0), (0.5, 0)]
