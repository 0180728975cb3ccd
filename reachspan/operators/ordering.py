"""Orders of nodes of graphs of any size, as relations (rank, place).

Three building blocks: `followed` jumps along links by doubling, `connected` contracts edges until components are single nodes, and
`levels` peels nodes whose predecessors are gone.  Peeling goes by blocks of neighbouring places: a task peels its block as far as it can, and only what
leaves a block is sent on, so the number of rounds is how often a path changes blocks, not how long it is.  Where ranks let paths come back to earlier blocks, nodes are
first placed anew (`by_depth`), by another number that they have or by estimated depth, and peeled window by window (`swept`): a round for each window, which reads that window only.

Tables of nodes compress so well that Spark takes millions of them for small enough to broadcast, which the driver has no room for: joins with them are told to sort (`wide`).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachspan.functions.indexing import numbered
from reachspan.runtime import checkpoint_folder, cut

#: Ranks of a block, as a power of two, and by how much more a window of the sweep holds; windows of nodes without a predecessor yet that are carried on at most.
BLOCK_BITS, WINDOW_BITS, CARRIED = 17, 3, 4
#: Edges of a part with cycles, or nodes and edges of a graph, that one task handles; others take rounds of joins, to the same result.
SMALL = 200_000


def wide(df: DataFrame) -> DataFrame:
    """A table of about as many rows as there are nodes, not to be broadcast however small its files are."""
    return df.hint("merge")


def _sized(df: DataFrame) -> DataFrame:
    """A table on disk that is to be broadcast if it has few rows only."""
    return df if df.count() <= SMALL else wide(df)


def _followed_frames(frames):
    """`followed` of one group of links, by the same doubling."""
    for frame in frames:
        for node, nxt, steps in zip(frame["node"], frame["next"], frame["steps"], strict=True):
            order = np.argsort(node)
            node, nxt, steps = node[order], nxt[order], steps[order]
            n = len(node)
            least = np.minimum(node, nxt)
            at = np.minimum(np.searchsorted(node, nxt), n - 1)
            at = np.where(node[at] == nxt, at, n)
            for _ in range(n.bit_length() + 1):
                moved = at < n
                if not moved.any():
                    break
                ahead = at[moved]
                steps, nxt, least, at = steps.copy(), nxt.copy(), least.copy(), at.copy()
                steps[moved], least[moved] = steps[moved] + steps[ahead], np.minimum(least[moved], least[ahead])
                nxt[moved], at[moved] = nxt[ahead], at[ahead]
            ring = at < n
            yield pd.DataFrame({"node": node, "last": np.where(ring, least, nxt), "steps": steps, "ring": ring})


def followed(links: DataFrame, small: int | None = None) -> DataFrame:
    """node, last, steps, ring of links (node, next, and steps if they count for more than one) of which each node has at most one: where following them ends, after how many steps.

    Doubling: after r rounds each node knows its 2**r-th successor.  Nodes that still move when that exceeds their number lead into a ring; their `last` is the
    smallest node met, their `steps` mean nothing.  Up to `small` links are one task's.
    """
    small = SMALL if small is None else small
    steps = F.col("steps") if "steps" in links.columns else F.lit(1)
    now = cut(links.select("node", F.col("next").alias("last"), steps.cast("long").alias("steps"), F.least("node", "next").alias("least")))
    n, moving = now.count(), True
    if n <= small:
        whole = now.groupBy(F.lit(1).alias("one")).agg(F.collect_list("node").alias("node"), F.collect_list("last").alias("next"), F.collect_list("steps").alias("steps"))
        return whole.mapInPandas(_followed_frames, "node long, last long, steps long, ring boolean")
    for _ in range(max(1, n).bit_length() + 1):
        ahead = now.select(F.col("node").alias("last"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("least").alias("_least"))
        now = cut(now.join(wide(ahead), "last", "left").select("node", F.coalesce("_last", "last").alias("last"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.least("least", "_least").alias("least"), F.col("_last").isNotNull().alias("moved")))
        moving = not now.where("moved").isEmpty()
        if not moving:
            break
    return now.select("node", F.when(F.col("moved"), F.col("least")).otherwise(F.col("last")).alias("last"), "steps", F.col("moved").alias("ring"))


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node) of each component of edges (a, b), taken both ways; nodes without edges do not occur.

    Each round links every node to its smallest neighbour if that is smaller, follows the links to their ends, and keeps the edges between different ends: at least
    half of the nodes go.
    """
    found, left = None, cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lower = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("next"))
        ends = followed(lower.where("next < node")).select("node", F.col("last").alias("root"))
        ends = cut(lower.join(ends, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
        found = ends if found is None else cut(found.withColumnRenamed("root", "_mid").join(ends.select(F.col("node").alias("_mid"), "root"), "_mid", "left").select("node", F.coalesce("root", "_mid").alias("root")))
        a, b = ends.select(F.col("node").alias("a"), F.col("root").alias("x")), ends.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = cut(left.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _peeled(key, state: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """One block after its nodes without missing predecessors are taken, and those that this frees; `fresh` ones are taken now."""
    state = state.sort_values("rank", ignore_index=True)
    ranks, missing, level, done = (state[c].to_numpy(copy=True) for c in ("rank", "missing", "level", "done"))
    edges = edges.sort_values("a")
    source, target = np.searchsorted(ranks, edges["a"].to_numpy()), np.searchsorted(ranks, edges["b"].to_numpy())
    first = np.searchsorted(source, np.arange(len(ranks) + 1))
    fresh = np.zeros(len(ranks), bool)
    ready = np.flatnonzero((missing == 0) & ~done).tolist()
    while ready:
        x = ready.pop()
        fresh[x] = done[x] = True
        for y in target[first[x] : first[x + 1]].tolist():
            level[y] = max(level[y], level[x] + 1)
            missing[y] -= 1
            if not missing[y]:
                ready.append(y)
    return pd.DataFrame({"rank": ranks, "missing": missing, "level": level, "done": done, "fresh": fresh})


def _deepened(key, state: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The longest paths within one block, from what its nodes are entered at: each node's root, where its path enters the block, and steps from there; `behind` is what leads to it."""
    state = state.sort_values("rank", ignore_index=True)
    ranks, entered = state["rank"].to_numpy(), state["entry"].fillna(0).to_numpy(np.int64)
    edges = edges.sort_values("a")
    source, target = np.searchsorted(ranks, edges["a"].to_numpy()), np.searchsorted(ranks, edges["b"].to_numpy())
    first = np.searchsorted(source, np.arange(len(ranks) + 1)).tolist()
    missing, target = np.bincount(target, minlength=len(ranks)).tolist(), target.tolist()
    depth, root, steps = entered.tolist(), list(range(len(ranks))), [0] * len(ranks)
    ready = [x for x, m in enumerate(missing) if not m]
    while ready:
        x = ready.pop()
        for y in target[first[x] : first[x + 1]]:
            if depth[y] <= depth[x]:
                depth[y], root[y], steps[y] = depth[x] + 1, root[x], steps[x] + 1
            missing[y] -= 1
            if not missing[y]:
                ready.append(y)
    return pd.DataFrame({"rank": ranks, "depth": depth, "root": ranks[np.array(root, np.int64)], "steps": steps, "behind": state["behind"].astype("Int64")})


#: Rounds in which nodes are placed by depth at most; what they leave costs rounds of peeling.
DEPTH_ROUNDS = 48


def by_depth(nodes: DataFrame, edges: DataFrame, bits: int) -> tuple[DataFrame, DataFrame] | None:
    """An order of nodes in which no edge leads back further than to the window before: (rank, place) and the edges by rank and place (a, b, _x, _y); nothing, if no edge (a, b) leads back to an earlier block of ranks.

    Nodes may have a `hint`, another number that could be such an order; it is where to begin, if fewer edges lead back by it than by rank.  If many do, every node first follows those that come from the most
    distant places to their beginning, and nodes are placed by the steps, if that is better.  Each round takes, block by block, the longest paths within blocks
    from what is known of the depths outside; every node then follows the path that it has chosen, over all blocks, to its
    beginning (`followed`), which gives it the depth on that path, and nodes are placed anew by depth.  Depths only grow, up to the longest path's.  It ends when hardly an edge leads back, when paths run into
    a ring, or after DEPTH_ROUNDS.
    """
    block, window = lambda c: F.shiftright(c, bits), lambda c: F.shiftright(c, bits + WINDOW_BITS)
    back = edges.where(block("a") > block("b")).count()
    if not back:
        return None
    zero = F.lit(0).cast("long")
    placed, told = nodes.select("rank", zero.alias("depth"), F.col("rank").alias("place")), edges.select("a", "b", zero.alias("_depth"), F.col("a").alias("_x"), F.col("b").alias("_y"))
    if "hint" in nodes.columns:
        hinted = cut(numbered(nodes.select("rank", F.struct("hint", "rank").alias("_order")), "_order", "place").select("rank", zero.alias("depth"), "place"))
        by_hint = cut(_told(edges, hinted))
        if by_hint.where(block("_x") > block("_y")).count() < back:
            placed, told = hinted, by_hint
    leads_back = lambda told: told.where(window("_x") > window("_y") + 1)
    if far := leads_back(told).count():
        # paths within blocks are found below; here those whose every step leaves its block, as in tables that are put together of alike ones
        links = told.groupBy(F.col("b").alias("node")).agg(F.max_by("a", F.struct(F.abs(F.col("_x") - F.col("_y")), "a")).alias("next"))
        deep = _depths(cut(links.withColumn("steps", zero + 1)))
        if deep is not None:
            order = nodes.select("rank").join(wide(deep.toDF("rank", "depth")), "rank", "left").select("rank", F.coalesce("depth", zero).alias("depth"))
            by_steps = cut(numbered(order.withColumn("_order", F.struct("depth", "rank")), "_order", "place").select("rank", "depth", "place"))
            told_so = cut(_told(edges, by_steps))
            if leads_back(told_so).count() < far:
                placed, told = by_steps, told_so
    for _ in range(DEPTH_ROUNDS):
        if leads_back(told).isEmpty():
            break
        crossing = block("_x") != block("_y")
        entries = told.where(crossing).groupBy(F.col("b").alias("rank")).agg(F.max(F.struct(F.col("_depth").alias("d"), F.col("a").alias("a"))).alias("_in"))
        own = placed.join(wide(entries), "rank", "left").select("rank", (F.col("_in.d") + 1).alias("entry"), F.col("_in.a").alias("behind"), block("place").alias("_block"))
        inner = told.where(~crossing).select("a", "b", block("_y").alias("_block"))
        out = cut(own.groupBy("_block").cogroup(inner.groupBy("_block")).applyInPandas(_deepened, "rank long, depth long, root long, steps long, behind long"))
        before = out.select(F.col("rank").alias("behind"), F.col("root").alias("next"), (F.col("steps") + 1).alias("steps"))
        links = out.where("rank = root and behind is not null").select(F.col("rank").alias("node"), "behind").join(wide(before), "behind").select("node", "next", "steps")
        ends = cut(followed(links))
        if not ends.where("ring").isEmpty():
            break
        begun = ends.select(F.col("node").alias("root"), F.col("steps").alias("_before"))
        deep = out.join(wide(begun), "root", "left").select("rank", (F.col("steps") + F.coalesce("_before", F.lit(0))).alias("depth"))
        placed = cut(numbered(deep.withColumn("_order", F.struct("depth", "rank")), "_order", "place").select("rank", "depth", "place"))
        told = cut(_told(edges, placed))
    return placed.select("rank", "place"), told.select("a", "b", "_x", "_y")


#: One of so many nodes, by hash, at which following stops first; the links between them are followed next.
STOPS = 16


def _depths(links: DataFrame, turn: int = 0) -> DataFrame | None:
    """node, steps to the end of the links (node, next, steps) of each; nothing, if some run into a ring."""
    if links.count() <= SMALL:
        ends = cut(followed(links))
        return ends.select("node", "steps") if ends.where("ring").isEmpty() else None
    stop = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(STOPS)) == 0  # others in each turn
    ends = cut(followed(links.where(~stop)))
    if not ends.where("ring").isEmpty():
        return None
    on = ends.select(F.col("node").alias("next"), "last", F.col("steps").alias("_steps"))
    between = links.where(stop).join(wide(on), "next", "left").select("node", F.coalesce("last", "next").alias("next"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
    further = _depths(cut(between), turn + 1)
    if further is None:
        return None
    then = further.select(F.col("node").alias("last"), F.col("steps").alias("_steps"))
    return further.unionByName(cut(ends.join(wide(then), "last", "left").select("node", (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))))


def _told(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges (a, b) with a's depth and both places."""
    a, b = placed.select(F.col("rank").alias("a"), F.col("depth").alias("_depth"), F.col("place").alias("_x")), placed.select(F.col("rank").alias("b"), F.col("place").alias("_y"))
    return edges.select("a", "b").join(wide(a), "a").join(wide(b), "b").select("a", "b", "_depth", "_x", "_y")


def levels(nodes: DataFrame, edges: DataFrame, bits: int | None = None) -> DataFrame:
    """rank, level of nodes (rank, and hint if there is one) under edges (a, b): the most edges that lead to a node; null on cycles and behind them."""
    bits = BLOCK_BITS if bits is None else bits
    known = by_depth(nodes, edges, bits)
    if known is None:
        return _peeled_levels(_entered(nodes.select("rank"), edges.select("a", "b")), edges.select("a", "b"), bits)
    places, told = known
    moved = told.select(F.col("_x").alias("a"), F.col("_y").alias("b"))
    found = swept(_entered(places.select(F.col("place").alias("rank")), moved), moved, bits)
    return places.join(wide(found.toDF("place", "level")), "place").select("rank", "level")


def _entered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rank, missing (edges that lead there), level of nodes before any is taken."""
    each = nodes.select("rank", F.lit(0).cast("long").alias("n")).unionByName(edges.select(F.col("b").alias("rank"), F.lit(1).cast("long").alias("n")))
    return each.groupBy("rank").agg(F.sum("n").alias("missing")).select("rank", "missing", F.lit(0).cast("long").alias("level"))


#: Rows of the sweep's table: what is known of a node (a) is added up, its missing edges (b) and the largest level (c); edges (a, b); nodes (a) that are taken, with their level (c).
NODE, EDGE, TAKEN = 0, 1, 2
#: Windows that come never: of nodes that are taken, and of those that wait too long.
DONE, ASIDE = -1, -2


def _window_of(bits: int, window: int, following: int, most: int):
    """Peels the nodes of a window and those carried on to it, as one task that holds a window; yields what is sent to other windows."""

    def peeled(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        kind, a, b, c = (np.concatenate([f[n].to_numpy() for f in frames]) for n in ("kind", "a", "b", "c"))
        frames.clear()
        own, way = kind == NODE, kind == EDGE
        ranks, at = np.unique(a[own], return_inverse=True)
        missing, level = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        np.add.at(missing, at, b[own])
        np.maximum.at(level, at, c[own])
        order = np.argsort(a[way])
        a, b = a[way][order], b[way][order]
        source, goal = np.searchsorted(ranks, a), np.minimum(np.searchsorted(ranks, b), len(ranks) - 1)
        inside = ranks[goal] == b
        first = np.searchsorted(source[inside], np.arange(len(ranks) + 1)).tolist()
        target, left, high, taken = goal[inside].tolist(), missing.tolist(), level.tolist(), bytearray(len(ranks))
        ready = np.flatnonzero(missing == 0)[::-1].tolist()
        while ready:
            x = ready.pop()
            taken[x], up = 1, high[x] + 1
            for y in target[first[x] : first[x + 1]]:
                if high[y] < up:
                    high[y] = up
                left[y] -= 1
                if not left[y]:
                    ready.append(y)
        taken, missing, level = np.frombuffer(taken, np.uint8).astype(bool), np.array(left, np.int64), np.array(high, np.int64)
        yield from _rows(TAKEN, ranks[taken], 0, level[taken], DONE)
        # one row for each node that is led to from here, in its window; those that waited too long are in none
        out = taken[source] & ~inside
        led, to = np.unique(b[out], return_inverse=True)
        most_led = np.zeros(len(led), np.int64)
        np.maximum.at(most_led, to, level[source[out]] + 1)
        ahead = led >> bits
        yield from _rows(NODE, led, -np.bincount(to, minlength=len(led)), most_led, np.where(ahead > window, ahead, ASIDE))
        waiting = ASIDE if following < 0 or np.count_nonzero(~taken) > most else following
        yield from _rows(NODE, ranks[~taken], missing[~taken], level[~taken], waiting)
        open_ = ~taken[source]
        yield from _rows(EDGE, a[open_], b[open_], 0, waiting)

    return peeled


def _rows(kind: int, a: np.ndarray, b, c, to):
    b, c, to = (np.broadcast_to(x, a.shape) for x in (b, c, to))
    for i in range(0, len(a), 1 << 18):
        part = slice(i, i + (1 << 18))
        yield pd.DataFrame({"kind": np.full(len(a[part]), kind, np.int32), "a": a[part], "b": b[part], "c": c[part], "to": to[part]})


def swept(state: DataFrame, edges: DataFrame, bits: int) -> DataFrame:
    """`levels` of nodes (rank, missing, level), window after window of 2**(bits + WINDOW_BITS) ranks.

    Nodes and edges are dealt to windows once.  A round reads its window, what was sent there, and the nodes that the window before could not take, as those that lead to them come later.
    More of them than fill CARRIED windows are set aside, and peeled by blocks in the end, with all that is still waiting then.
    """
    spark, width = state.sparkSession, bits + WINDOW_BITS
    folder, schema = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}", "kind int, a long, b long, c long"
    none = F.lit(0).cast("long")
    rows = state.select(F.lit(NODE).alias("kind"), F.col("rank").alias("a"), F.col("missing").alias("b"), F.col("level").alias("c")).unionByName(edges.select(F.lit(EDGE).alias("kind"), "a", "b", none.alias("c")))
    write = lambda df, name: df.write.partitionBy("to").option("compression", "zstd").parquet(f"{folder}/turn={name}")
    # whoever reads a table of rows that go to windows reads one window of it
    held = lambda: spark.read.schema(f"{schema}, turn long, to long").parquet(folder)
    write(rows.withColumn("to", F.shiftright("a", width)).repartition("to"), -1)
    windows = sorted(r.to for r in held().where(F.col("kind") == NODE).select("to").distinct().collect())
    for window, following in zip(windows, [*windows[1:], ASIDE], strict=True):
        now = held().where(F.col("to") == window).select("kind", "a", "b", "c").coalesce(1)
        write(now.mapInPandas(_window_of(width, window, following, CARRIED << width), f"{schema}, to long"), window)
    found = held().where(F.col("to") == DONE).select(F.col("a").alias("rank"), F.col("c").alias("level"))
    aside = held().where(F.col("to") == ASIDE)
    if aside.isEmpty():
        return found
    rest = aside.where(F.col("kind") == NODE).groupBy(F.col("a").alias("rank")).agg(F.sum("b").alias("missing"), F.max("c").alias("level"))
    return found.unionByName(_peeled_levels(rest, cut(aside.where(F.col("kind") == EDGE).select("a", "b")), bits))


def _peeled_levels(nodes: DataFrame, edges: DataFrame, bits: int) -> DataFrame:
    """`levels` of nodes (rank, missing, level), by blocks of ranks as they are, all at once in each round."""
    block = lambda c: F.shiftright(c, bits)
    inner, cross = edges.where(block("a") == block("b")).withColumn("_block", block("a")), _sized(edges.where(block("a") != block("b")))
    state = cut(nodes.select("rank", "missing", "level", F.lit(False).alias("done"), block("rank").alias("_block")))
    active = None
    while True:
        now, own = (state, inner) if active is None else (state.join(active, "_block", "left_semi"), inner.join(active, "_block", "left_semi"))
        out = now.groupBy("_block").cogroup(own.groupBy("_block")).applyInPandas(_peeled, "rank long, missing long, level long, done boolean, fresh boolean")
        out = cut(out)
        sent = cut(out.where("fresh").join(cross, F.col("rank") == F.col("a")).groupBy(F.col("b").alias("rank")).agg(F.count("*").alias("_n"), (F.max("level") + 1).alias("_level")))
        held = out.drop("fresh").withColumn("_block", block("rank"))
        state = held if active is None else state.join(active, "_block", "left_anti").unionByName(held)
        if sent.isEmpty():
            return state.select("rank", F.when(F.col("done"), F.col("level")).alias("level"))
        state = cut(state.join(wide(sent), "rank", "left").select("rank", (F.col("missing") - F.coalesce("_n", F.lit(0))).alias("missing"), F.greatest("level", "_level").alias("level"), "done", "_block"))
        active = cut(sent.select(block("rank").alias("_block")).distinct())


def _components_of(frames):
    """unit of each node of one group of edges, by depth-first search with low links."""
    for frame in frames:
        for a, b in zip(frame["a"], frame["b"], strict=True):
            ahead: dict[int, list[int]] = {}
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                ahead.setdefault(x, []).append(y)
            number, low, unit, stack, open_ = {}, {}, {}, [], set()
            for start in list(ahead):
                if start in number:
                    continue
                path = [(start, iter(ahead[start]))]
                number[start] = low[start] = len(number)
                stack.append(start)
                open_.add(start)
                while path:
                    x, rest = path[-1]
                    y = next(rest, None)
                    if y is None:
                        path.pop()
                        if path:
                            low[path[-1][0]] = min(low[path[-1][0]], low[x])
                        if low[x] == number[x]:
                            members = []
                            while not members or members[-1] != x:
                                members.append(stack.pop())
                            open_.difference_update(members)
                            unit.update(dict.fromkeys(members, min(members)))
                    elif y not in number:
                        number[y] = low[y] = len(number)
                        stack.append(y)
                        open_.add(y)
                        path.append((y, iter(ahead.get(y, ()))))
                    elif y in open_:
                        low[x] = min(low[x], number[y])
            yield pd.DataFrame({"node": pd.Series(list(unit), dtype="int64"), "unit": pd.Series(list(unit.values()), dtype="int64")})


def strongly_connected(edges: DataFrame, small: int | None = None) -> DataFrame:
    """node, unit of edges (a, b): equal for nodes that reach each other, the smallest of them.

    Up to `small` edges are one task's.  Others take rounds: every node takes the smallest node that reaches it as its colour; who reaches the node of its
    colour within the colour is in its unit; the same again on what is left, without the edges between colours.
    """
    small = SMALL if small is None else small
    left, found = cut(edges.where("a <> b").select("a", "b").distinct()), None
    add = lambda part: part if found is None else found.unionByName(part)
    while n := left.count():
        if n <= small:
            whole = left.groupBy(F.lit(1).alias("one")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
            return add(whole.mapInPandas(_components_of, "node long, unit long"))
        ends = cut(left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        colour = ends.select("node", F.col("node").alias("colour"))
        while True:
            smaller = left.join(colour, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("_new"))
            moved = cut(colour.join(smaller, "node", "left").select("node", F.least("colour", "_new").alias("colour"), (F.col("_new") < F.col("colour")).alias("moved")))
            colour = moved.select("node", "colour")
            if moved.where("moved").isEmpty():
                break
        a, b = colour.toDF("a", "x"), colour.toDF("b", "y")
        left = cut(left.join(a, "a").join(b, "b").where("x = y").select("a", "b"))
        reached = front = cut(colour.where("node = colour").select("node"))
        while not front.isEmpty():
            front = cut(left.join(front, F.col("b") == F.col("node"), "left_semi").select(F.col("a").alias("node")).distinct().join(reached, "node", "left_anti"))
            reached = cut(reached.unionByName(front))
        found = add(cut(reached.join(colour, "node").select("node", F.col("colour").alias("unit"))))
        left = cut(left.join(reached.select(F.col("node").alias("a")), "a", "left_anti").join(reached.select(F.col("node").alias("b")), "b", "left_anti"))
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("unit"))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between names (node, name); nodes without one keep theirs, and edges within one go."""
    names = _sized(names)
    a, b = names.toDF("a", "_x"), names.toDF("b", "_y")
    return edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_x", "a").alias("a"), F.coalesce("_y", "b").alias("b")).where("a <> b").distinct()


def acyclic_levels(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> DataFrame:
    """rank, level of all nodes; nodes that reach each other are one, with one level.  Edges between others lead to higher levels."""
    edges = edges.where("a <> b")
    found = cut(levels(nodes, edges))
    open_ = cut(found.where("level is null").select("rank"))
    if open_.isEmpty():
        return found
    inside = lambda e, n: e.join(wide(n.toDF("a")), "a", "left_semi").join(wide(n.toDF("b")), "b", "left_semi")
    # what lies behind cycles but on none of them is peeled from the other end
    behind = levels(open_, cut(_turned(inside(edges, open_))))
    core = cut(inside(edges, behind.where("level is null").select("rank")))
    units = cut(strongly_connected(core, small).where("node <> unit"))
    rest = nodes.join(units.select(F.col("node").alias("rank")), "rank", "left_anti")
    single = levels(rest, cut(_renamed(edges, units)))
    return cut(single.unionByName(units.join(single, F.col("unit") == F.col("rank")).select(F.col("node").alias("rank"), "level")))


def topological(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> DataFrame:
    """rank, place: by level, then by rank."""
    placed = acyclic_levels(nodes, edges, small).select("rank", F.struct("level", "rank").alias("_order"))
    return numbered(placed, "_order", "place").select("rank", "place")


def chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rank, head, at: the chain of each node, of edges that are the only way out of one node and the only way into the next, and its place on it.

    Rings begin with their lowest rank.
    """
    edges = edges.where("a <> b")
    only_out = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    only_in = edges.groupBy("b").agg(F.count("*").alias("n")).where("n = 1").select("b")
    links = cut(only_out.join(wide(only_in), "b", "left_semi").select(F.col("b").alias("node"), F.col("a").alias("next")))  # towards the head
    ends = followed(links)
    rings = ends.where("ring").select(F.col("last").alias("node")).distinct()
    if not rings.isEmpty():
        ends = followed(links.join(rings, "node", "left_anti"))
    ends = _sized(cut(ends.select(F.col("node").alias("rank"), F.col("last").alias("head"), F.col("steps").alias("at"))))
    return nodes.select("rank").join(ends, "rank", "left").select("rank", F.coalesce("head", "rank").alias("head"), F.coalesce("at", F.lit(0)).alias("at"))


def breaks(places: DataFrame, edges: DataFrame) -> int:
    """Edges (a, b) that do not lead to the next place of (rank, place)."""
    placed = edges.join(wide(places.toDF("a", "x")), "a").join(wide(places.toDF("b", "y")), "b")
    return placed.where("y <> x + 1").count()


def min_breaks(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> DataFrame:
    """rank, place: chains as wholes, by the level of their head and its rank; the order as it is where that leads forward, too, and breaks less."""
    edges = cut(edges)
    held = cut(chains(nodes, edges))
    behind = cut(held.where("at > 0").select(F.col("rank").alias("node"), "head"))
    heads = nodes.join(wide(behind.select(F.col("node").alias("rank"))), "rank", "left_anti")
    between = cut(_renamed(edges, behind))
    level = acyclic_levels(cut(heads), between, small).toDF("head", "level")
    placed = held.join(wide(level), "head").select("rank", F.struct("level", "head", "at").alias("_order"))
    new = cut(numbered(placed, "_order", "place").select("rank", "place"))
    own = cut(numbered(nodes.select("rank"), "rank", "place").select("rank", "place"))
    if edges.where("a > b").isEmpty() and breaks(own, edges) < breaks(new, edges):
        return own
    return new


def _cuthill_mckee_frames(frames):
    """The plain order of one group: breadth first from the lowest (degree, rank) of what is left, neighbours by (degree, rank)."""
    for frame in frames:
        for ranks, a, b in zip(frame["ranks"], frame["a"], frame["b"], strict=True):
            beside: dict[int, list[int]] = {r: [] for r in ranks.tolist()}
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                beside[x].append(y)
            key = {r: (len(near), r) for r, near in beside.items()}
            order, seen = [], set()
            for root in sorted(beside, key=key.get):
                if root in seen:
                    continue
                seen.add(root)
                at = len(order)
                order.append(root)
                while at < len(order):
                    near = sorted((r for r in beside[order[at]] if r not in seen), key=key.get)
                    seen.update(near)
                    order += near
                    at += 1
            yield pd.DataFrame({"rank": order, "place": range(1, len(order) + 1)})


def cuthill_mckee(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> DataFrame:
    """rank, place: breadth first through each component from its node of lowest (degree, rank); each level by (place of the parent, degree, rank).

    Components go by their first nodes.  Up to `small` nodes and edges are one task's; others take a round for each level, with all components at
    once, and number each level by range partitions.
    """
    small = SMALL if small is None else small
    both = cut(edges.unionByName(_turned(edges)).where("a <> b").distinct())
    if both.count() + nodes.count() <= small:
        listed = both.groupBy(F.lit(1).alias("one")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
        whole = nodes.groupBy(F.lit(1).alias("one")).agg(F.collect_list("rank").alias("ranks")).join(listed, "one", "left")
        none = F.array().cast("array<bigint>")
        return whole.select("ranks", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b")).mapInPandas(_cuthill_mckee_frames, "rank long, place long")
    degree = both.groupBy(F.col("a").alias("rank")).agg(F.count("*").alias("degree"))
    sized = nodes.select("rank").join(degree, "rank", "left").select("rank", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "rank").alias("_order"))
    # from here on a node is its number by (degree, rank), so that the smallest of a component is its root
    names = cut(numbered(sized, "_order", "node").select("rank", "node"))
    near = cut(both.join(wide(names.toDF("a", "x")), "a").join(wide(names.toDF("b", "y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = cut(names.join(connected(near), "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    spark, schema = nodes.sparkSession, "node long, root long, at long"
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    front, level = roots.where("node = root").select("node", "root", F.lit(0).cast("long").alias("at")), 0
    last = None
    while True:
        front.write.option("compression", "zstd").parquet(f"{folder}/level={level}")
        before, last = last, spark.read.schema(schema).parquet(f"{folder}/level={level}")
        if last.isEmpty():
            break
        level += 1
        # a neighbour of a level is in the level before, in it or in the next
        known = last.select("node") if before is None else last.select("node").unionByName(before.select("node"))
        reached = near.join(last.select(F.col("node").alias("a"), "root", "at"), "a").groupBy(F.col("b").alias("node"), "root").agg(F.min("at").alias("_parent"))
        new = reached.join(known, "node", "left_anti").withColumn("_order", F.struct("root", "_parent", "node"))
        front = numbered(new, "_order", "at").select("node", "root", "at")
    seen = spark.read.schema(f"{schema}, level long").parquet(folder)
    placed = numbered(seen.select("node", F.struct("root", "level", "at").alias("_order")), "_order", "place")
    return placed.join(wide(names), "node").select("rank", "place")
