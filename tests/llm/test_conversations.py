"""Conversation repair against a shortest-path search over (row, state), and against direct counts."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from reachspan.llm import conversations as C

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string, at int, found int, code int"


def cheapest(rows):
    """cost, audit and repaired rows of (fault, role, text) rows, by the least (cost, audit)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        if (i, q) in done:
            continue
        done.add((i, q))
        legal = [(x, full) for x, full in (("u", "user"), ("a", "assistant")) if (q, x) in NEXT]
        for x, full in legal:
            heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[q, x], (*out, f"{full}:")))
        if i < len(rows):
            fault, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (q, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[q, role[:1]], (*out, f"{role}:{text}")))
                for x, full in legal:
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, NEXT[q, x], (*out, f"{full}:{text}")))


def plain(rows, damage=True):
    found = {}
    for conv, turn, role, text in rows:
        own = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in found.items():
        # as documented: by turn, role and the text's first 256 characters, then by the digest of role and text
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:256], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, judged = set(), []
        for _, role, text in own:
            ink = re.findall("[^\x20\x09-\x0d]", text)
            judged.append(("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "", role, text))
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        count = lambda f: sum(j[0] == f for j in judged)  # noqa: B023, E731
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = cheapest(judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversation(rng, conv, n):
    texts = ["Yes.", "No!", "open end", "", " \n", "Well?  ", "a.b", "é.", "x" * 500 + ".", "x" * 300 + "y.", "x" * 300 + "z.", None]
    return [(conv, rng.choice([i, i, i, i + 1, None, 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    made = [r for conv in range(250) for r in conversation(rng, conv, rng.randint(1, 9))]
    made += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (None, None, None, None)]
    made += [(5000, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(600)] + [(5001, 1, "user", "Same.")] * 40
    return made


def test_repair(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert told(C.repair(C.damage(df), df)) == plain(rows)


def test_without_damage(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert told(C.repair(df)) == plain(rows, damage=False)


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.", 1, 2, 3)], SCHEMA)
    assert told(C.repair(C.damage(df), df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(C.damage(df.limit(0)), df.limit(0)).count() == 0


def test_layers():
    rng, layers = random.Random(7), C.Layers()
    names = ["", "truncated", "blank", "duplicate"]
    for _ in range(3000):
        codes = bytes(rng.choice([0, 1, 2, 3, 1, 2, 5, 6, 4, 9, 14]) if rng.random() < 0.8 else rng.randrange(16) for _ in range(rng.randint(0, 9)))
        assert layers.least(codes) == cheapest([(names[c >> 2], ["system", "user", "assistant", "x"][c & 3], "") for c in codes])[:2]
    assert len(layers.values) < 100


def test_long_conversation_is_spread(spark):
    """One conversation's rows are placed by several tasks."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i}.", 1, 2, 3) for i in range(20000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = C.repair(df).first()
    assert (got.cost, got.audit) == (0, "K" * 20000)
