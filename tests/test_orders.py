"""Orders and their building blocks against plain versions, with blocks and bounds small enough that every round is taken."""

import random

import pytest

from reachspan.operators import ordering as O


def frames(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(1, n + 1)], "rank long"), spark.createDataFrame(edges, "a long, b long")


def places(df):
    return {r["rank"]: r.place for r in df.collect()}


def plain_levels(n, edges):
    """Longest paths from nodes without predecessors; None on cycles and behind them."""
    missing = {i: 0 for i in range(1, n + 1)}
    for _, b in edges:
        missing[b] += 1
    level, ready = dict.fromkeys(missing), [i for i in missing if not missing[i]]
    held = dict.fromkeys(missing, 0)
    while ready:
        x = ready.pop()
        level[x] = held[x]
        for a, b in edges:
            if a == x:
                held[b] = max(held[b], held[x] + 1)
                missing[b] -= 1
                if not missing[b]:
                    ready.append(b)
    return level


def reach(n, edges):
    ahead = {i: {b for a, b in edges if a == i} for i in range(1, n + 1)}
    out = {}
    for i in ahead:
        seen, todo = set(), list(ahead[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead[x]
        out[i] = seen
    return out


def some_graph(seed, n, m, acyclic):
    rng = random.Random(seed)
    names = list(range(1, n + 1))
    rng.shuffle(names)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted((names[min(a, b)], names[max(a, b)]) if acyclic else (names[a], names[b]) for a, b in pairs if a != b)


def test_followed(spark):
    links = [(i, i - 1) for i in range(2, 30)] + [(101, 100), (100, 103), (103, 102), (102, 101)]
    got = {r.node: (r.last, r.steps if not r.ring else None, r.ring) for r in O.followed(spark.createDataFrame(links, "node long, next long")).collect()}
    assert got == {i: (1, i - 1, False) for i in range(2, 30)} | {i: (100, None, True) for i in range(100, 104)}


def test_connected(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 40)] + [(rng.randint(50, 120), rng.randint(50, 120)) for _ in range(50)] + [(200, 201), (201, 200), (300, 300)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in O.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert O.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("acyclic", [True, False])
def test_levels_by_blocks(spark, acyclic):
    edges = some_graph(5, 40, 55, acyclic)
    nodes, e = frames(spark, 40, edges)
    for bits in (2, 20):
        assert {r["rank"]: r.level for r in O.levels(nodes, e, bits).collect()} == plain_levels(40, edges)


@pytest.mark.parametrize("small", [0, 1000])
def test_strongly_connected(spark, small):
    edges = some_graph(8, 25, 34, False)
    far = reach(25, edges)
    got = {r.node: r.unit for r in O.strongly_connected(frames(spark, 25, edges)[1], small).collect()}
    for x, unit in got.items():
        assert unit == min([y for y in far[x] if x in far[y]] + [x])
    assert {x for x in far if x in far[x] and min(y for y in far[x] if x in far[y]) != x} <= set(got)


@pytest.mark.parametrize("small", [0, 1000])
def test_topological(spark, small):
    """On cycles nodes share a level, the lowest first; all other edges lead forward."""
    edges = some_graph(11, 30, 40, False) + [(31, 32), (32, 31), (31, 33), (33, 34)]
    edges = sorted({(a, b) for a, b in edges if a != b})
    far = reach(34, edges)
    nodes, e = frames(spark, 34, edges)
    place = places(O.topological(nodes, e, small))
    assert sorted(place.values()) == list(range(1, 35))
    assert all(place[a] < place[b] for a, b in edges if a not in far[b])
    assert place == places(O.topological(nodes, e))


def test_min_breaks(spark):
    edges = sorted(set(some_graph(2, 30, 28, True)))
    nodes, e = frames(spark, 30, edges)
    place = places(O.min_breaks(nodes, e))
    assert sorted(place.values()) == list(range(1, 31)) and all(place[a] < place[b] for a, b in edges)
    out, into = [a for a, _ in edges], [b for _, b in edges]
    assert all(place[b] == place[a] + 1 for a, b in edges if out.count(a) == 1 and into.count(b) == 1)
    broken = lambda p: sum(p[b] != p[a] + 1 for a, b in edges)
    # a backbone with leaves: the order as it is breaks less than one by levels, and stays
    comb = [(i, i + 1) for i in range(1, 6)] + [(i, i + 6) for i in range(1, 6)]
    nodes, e = frames(spark, 12, comb)
    assert places(O.min_breaks(nodes, e)) == {i: i for i in range(1, 13)}
    assert broken(place) <= len(edges)
    # rings, with and without a way in
    ring = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 5)]
    got = places(O.min_breaks(*frames(spark, 6, ring)))
    assert sorted(got.values()) == [1, 2, 3, 4, 5, 6] and got[2] == got[1] + 1 and got[3] == got[2] + 1 and got[4] < got[5]


def plain_cuthill_mckee(n, edges):
    near = {i: sorted({b for a, b in edges if a == i} | {a for a, b in edges if b == i} - {i}) for i in range(1, n + 1)}
    key = lambda r: (len(near[r]), r)
    seen, order = set(), []
    for root in sorted(near, key=key):
        if root not in seen:
            own = [root]
            seen.add(root)
            for x in own:
                more = sorted((y for y in near[x] if y not in seen), key=key)
                seen.update(more)
                own += more
            order += own
    return {x: i + 1 for i, x in enumerate(order)}


@pytest.mark.parametrize("small", [0, 1000])
def test_cuthill_mckee(spark, small):
    edges = some_graph(6, 24, 20, False) + [(25, 26), (26, 27), (25, 28)]
    nodes, e = frames(spark, 30, edges)
    assert places(O.cuthill_mckee(nodes, e, small)) == plain_cuthill_mckee(30, edges)


def test_nothing(spark):
    nodes, e = frames(spark, 3, [])
    for order in (O.topological, O.min_breaks, O.cuthill_mckee):
        assert places(order(nodes, e)) == {1: 1, 2: 2, 3: 3}
        assert order(nodes.limit(0), e).count() == 0
    assert places(O.cuthill_mckee(nodes, e, 0)) == {1: 1, 2: 2, 3: 3}


def counted(monkeypatch, name):
    """How often a function of the module is called, by its first argument."""
    own, calls = getattr(O, name), []
    monkeypatch.setattr(O, name, lambda df, *more: (calls.append(df), own(df, *more))[1])
    return calls


def test_levels_of_a_path_between_blocks(spark, monkeypatch):
    """A path that changes blocks with every step takes rounds for the blocks, not for its steps."""
    path = [x for i in range(1, 16) for x in (i, i + 16)]
    nodes, e = frames(spark, 31, list(zip(path, path[1:], strict=False)))
    calls = counted(monkeypatch, "cut")
    assert {r["rank"]: r.level for r in O.levels(nodes, e, 4).collect()} == {x: i for i, x in enumerate(path)} | {16: 0}
    assert len(calls) < 45


@pytest.mark.parametrize("small", [0, 1000])
def test_followed_counts_steps(spark, small):
    links = spark.createDataFrame([(2, 1, 5), (3, 2, 7), (4, 3, 1), (9, 8, 2), (12, 11, 1), (11, 12, 1)], "node long, next long, steps long")
    got = {r.node: (r.last, None if r.ring else r.steps) for r in O.followed(links, small).collect()}
    assert got == {2: (1, 5), 3: (1, 12), 4: (1, 13), 9: (8, 2), 11: (11, None), 12: (11, None)}


def test_cuthill_mckee_plans_stay_short(spark, monkeypatch):
    """The plan of a level does not hold all levels before."""
    nodes, e = frames(spark, 10, [(i, i + 1) for i in range(1, 10)])
    calls = counted(monkeypatch, "numbered")
    assert places(O.cuthill_mckee(nodes, e, 0)) == {i: i for i in range(1, 11)}
    # the first numbers nodes, the last one all places
    read = [df._jdf.queryExecution().analyzed().toString().count("Relation [") for df in calls[1:-1]]
    assert len(read) == 10 and read[-1] == read[2]


@pytest.mark.parametrize("acyclic, carried", [(True, 4), (False, 4), (True, 0), (False, 0)])
def test_levels_by_windows(spark, monkeypatch, acyclic, carried):
    """nodes with another number that hardly an edge leads back by are peeled window by window; what waits too long is peeled by blocks."""
    monkeypatch.setattr(O, "WINDOW_BITS", 0)
    monkeypatch.setattr(O, "CARRIED", carried)
    edges = some_graph(21, 60, 90, acyclic)
    before = plain_levels(60, edges)
    # by level, with some places changed; on cycles and behind them in any order
    hint = sorted(before, key=lambda x: ((before[x] if before[x] is not None else 3) + (x % 7 == 0), x))
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(hint)], "rank long, hint long")
    e = spark.createDataFrame(edges, "a long, b long")
    followed, windows = counted(monkeypatch, "followed"), []
    own = O._window_of
    monkeypatch.setattr(O, "_window_of", lambda *more: (windows.append(more), own(*more))[1])
    for bits in (3, 4):
        assert {r["rank"]: r.level for r in O.levels(nodes, e, bits).collect()} == before
    assert len(windows) == 8 + 4
    assert not acyclic or not followed  # nothing is placed by depth


def test_tables_of_nodes_are_not_broadcast(spark, monkeypatch):
    """files of a few MB hold millions of ranks, which the driver has no room to broadcast."""
    nodes, e = frames(spark, 40, sorted(set(some_graph(5, 40, 55, True))))
    plans = []
    own = O.cut
    monkeypatch.setattr(O, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), own(df))[1])
    monkeypatch.setattr(O, "SMALL", -1)
    monkeypatch.setattr(O, "numbered", lambda df, order, name: df.withColumn(name, O.F.col("rank")))
    O.min_breaks(nodes.withColumn("hint", O.F.col("rank")), e).collect()
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_depths_by_stops(spark, monkeypatch):
    """links are followed to their ends in stretches, to the same steps."""
    rng = random.Random(4)
    up = {i: rng.randint(max(1, i - 3), i - 1) for i in range(2, 120)}
    steps = {1: 0}
    for i in sorted(up):
        steps[i] = steps[up[i]] + 1
    monkeypatch.setattr(O, "SMALL", 5)
    monkeypatch.setattr(O, "STOPS", 4)
    links = spark.createDataFrame([(a, b, 1) for a, b in up.items()], "node long, next long, steps long")
    assert {r.node: r.steps for r in O._depths(links).collect()} == {i: steps[i] for i in up}
    assert O._depths(spark.createDataFrame([(i, i % 60 + 1, 1) for i in range(1, 61)], "node long, next long, steps long")) is None


def test_tables_of_alike_parts(spark, monkeypatch):
    """a chain that goes through all copies of a table at each time, beside chains within copies, is placed at once."""
    monkeypatch.setattr(O, "WINDOW_BITS", 0)
    copies, times = 10, 24
    at = lambda c, t: c * times + t + 1
    chain = [at(c, t) for t in range(times) for c in range(copies)]
    edges = list(zip(chain, chain[1:], strict=False)) + [(at(c, t), at(c, t + 5)) for c in range(copies) for t in range(times - 5)]
    nodes, e = frames(spark, copies * times, edges)
    calls = counted(monkeypatch, "_told")
    assert {r["rank"]: r.level for r in O.levels(nodes, e, 4).collect()} == {x: i for i, x in enumerate(chain)}
    assert len(calls) == 1
