"""Sequence graphs: nodes with lengths, edges between whole nodes, and named paths; loci are their characters."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachspan.functions.indexing import numbered
from reachspan.functions.ranges import prefix_sum, to_ranges
from reachspan.matrix import BoolMatrix
from reachspan.operators.ordering import cuthill_mckee, min_breaks, topological, wide
from reachspan.runtime import cut, parts_for


@dataclass(frozen=True)
class Graph:
    """nodes (rank from 1, id, name, len), edges (src, dst: ids), paths (name, pos, node: id)."""

    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame | None = None


def _ranked(graph: Graph) -> DataFrame:
    """Distinct edges by rank; orientation is not kept, an edge leads from the end of src to the start of dst."""
    first, second = graph.nodes.select(F.col("id").alias("src"), F.col("rank").alias("a")), graph.nodes.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
    return graph.edges.select("src", "dst").distinct().join(wide(first), "src").join(wide(second), "dst").select("a", "b")


def _range(graph: Graph, lower: int, upper: int) -> DataFrame:
    return graph.nodes.where(F.col("rank") >= lower) if upper == 0 else graph.nodes.where((F.col("rank") >= lower) & (F.col("rank") < upper))


def first_node_in_region(graph: Graph, name: str) -> int:
    """Id of the first node on a path; 0 if there is none."""
    row = graph.paths.where(F.col("name") == name).orderBy("pos").select("node").first() if graph.paths is not None else None
    return row.node if row else 0


def node_by_name(graph: Graph, name: str) -> int:
    """Id of the node with a name, the lowest in rank; 0 if there is none."""
    row = graph.nodes.where(F.col("name") == name).orderBy("rank").select("id").first()
    return row.id if row else 0


def start_nodes(graph: Graph) -> DataFrame:
    """Nodes without incoming edges."""
    return graph.nodes.join(graph.edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select(*graph.nodes.columns)


def components(graph: Graph) -> DataFrame:
    """component from 1, lower, upper (past the last rank): a component reaches from one start node to the next.

    Start nodes may be as many as nodes, so they are numbered by range partitions; the next start is a join on the number.
    """
    end = graph.nodes.agg((F.max("rank") + 1).alias("end")).first().end
    starts = cut(numbered(start_nodes(graph).select("rank"), "rank", "component"))
    following = starts.select((F.col("component") - 1).alias("component"), F.col("rank").alias("next"))
    return starts.join(following, "component", "left").select("component", F.col("rank").alias("lower"), F.coalesce("next", F.lit(end)).alias("upper"))


def upper_node_rank_in_component(graph: Graph, rank: int) -> tuple[int, int, int]:
    """Past the last rank of the component of a rank, that component's number from 1, and the number of components.

    Ranks before the first start node are in component 0, which ends there; so are all ranks of a graph without start nodes.
    """
    starts = start_nodes(graph)
    row = starts.agg(F.min(F.when(F.col("rank") > rank, F.col("rank"))).alias("upper"), F.count_if(F.col("rank") <= rank).alias("own"), F.count("*").alias("n")).first()
    return row.upper or graph.nodes.count() + 1, row.own, row.n


def node_count(graph: Graph, lower: int = 1, upper: int = 0) -> int:
    return _range(graph, lower, upper).count()


def edge_count(graph: Graph, lower: int = 1, upper: int = 0) -> int:
    """Edges that leave the nodes of a range."""
    return graph.edges.select("src", "dst").distinct().join(_range(graph, lower, upper).select(F.col("id").alias("src")), "src", "left_semi").count()


def total_loci(graph: Graph, lower: int = 1, upper: int = 0) -> int:
    return _range(graph, lower, upper).agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n")).first().n


def locus_offsets(graph: Graph) -> DataFrame:
    """Nodes with `start`, the locus of their first character."""
    return prefix_sum(graph.nodes, "rank", "len").withColumnRenamed("before", "start")


def adjacency_matrix(graph: Graph, lower: int = 1, upper: int = 0) -> BoolMatrix:
    """Cells (locus, next locus) of the nodes of a rank range, numbered from its first locus; edges that leave it are left out."""
    # read four times
    nodes = cut(locus_offsets(graph).select("rank", "len", "start"))
    own = nodes.where((F.col("rank") >= lower) & ((F.col("rank") < upper) if upper else F.lit(True)))
    shape = own.agg(F.coalesce(F.min("start"), F.lit(0)).alias("base"), F.coalesce(F.sum("len"), F.lit(0)).alias("n")).first()
    moved = lambda row, col: ((row - shape.base).alias("row"), (col - shape.base).alias("col"))
    # a node's loci are one row here: dealt out by how many loci there are
    dealt = own.where("len >= 2").repartition(parts_for(graph.nodes.sparkSession, shape.n), "rank")
    within = dealt.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 2)).alias("row"))
    inner = within.select(*moved(F.col("row"), F.col("row") + 1))
    ends = own.select(F.col("rank").alias("a"), (F.col("start") + F.col("len") - 1).alias("row"))
    outer = _ranked(graph).join(ends, "a").join(own.select(F.col("rank").alias("b"), F.col("start").alias("col")), "b").select(*moved(F.col("row"), F.col("col")))
    # rows within nodes have one cell each, rows at the ends of nodes only those of edges (of several nodes, if some have no loci)
    outer = cut(outer.distinct())
    one = inner.select("row", F.col("col").alias("lo"), F.col("col").alias("hi"))
    fullest = outer.groupBy("row").count().agg(F.max("count").alias("n")).first().n or 0
    ranges = one.unionByName(to_ranges(outer, fullest))
    return BoolMatrix(inner.unionByName(outer), shape.n, shape.n, "basic", bound=max(1, fullest), ranges=ranges)


def range_adjacency_matrix(graph: Graph, lower: int = 1, upper: int = 0) -> BoolMatrix:
    return adjacency_matrix(graph, lower, upper).to_ranges()


def adjacency_values(graph: Graph, lower: int = 1, upper: int = 0) -> DataFrame:
    """Cells with a value of 1, for libraries that hold values."""
    return adjacency_matrix(graph, lower, upper).df.withColumn("value", F.lit(1))


def region_nodes_rank_range(graph: Graph, path: str = "", segment: str = "") -> tuple[int, int]:
    """Ranks [first, upper) from the start of a named path, else of a named segment, else of the graph, to the end of its component."""
    node = first_node_in_region(graph, path) if path else 0
    if path and not node:
        warnings.warn(f"there is no path {path!r}", stacklevel=2)
    if not node and segment:
        node = node_by_name(graph, segment)
        if not node:
            warnings.warn(f"there is no segment {segment!r}", stacklevel=2)
    rank = graph.nodes.where(F.col("id") == node).select("rank").first().rank if node else 1
    return rank, upper_node_rank_in_component(graph, rank)[0]


def order_nodes(graph: Graph, ordering: str = "min-breaks", seed: int = 1) -> Graph:
    """Ranks by another order of nodes.  Indices are equal up to that renumbering; the number of intervals differs.

    native: as they are.  random: by a hash with the seed.  topological: by level, the most edges that lead to a node; nodes on a
    cycle share a level, lowest rank first.  cuthill-mckee: breadth first from nodes of low degree, neighbours by degree.  min-breaks: topological,
    with each chain of single ways in one piece, so that neighbours are often adjacent.
    """
    if ordering == "native":
        return graph
    if ordering == "random":
        new = numbered(graph.nodes.select("id", F.struct(F.xxhash64("id", F.lit(seed)), "id").alias("_order")), "_order", "_new").select("id", "_new")
    elif ordering in _ORDERS:
        # ids may follow the edges where ranks do not
        ranks = cut(graph.nodes.select("rank", F.col("id").alias("hint")))
        placed = _ORDERS[ordering](ranks, cut(_ranked(graph)))
        new = ranks.join(wide(placed), "rank").select(F.col("hint").alias("id"), F.col("place").alias("_new"))
    else:
        raise ValueError(f"unknown ordering {ordering!r}")
    return Graph(graph.nodes.drop("rank").join(wide(new), "id").select(F.col("_new").alias("rank"), "id", "name", "len"), graph.edges, graph.paths)


_ORDERS = {"topological": topological, "min-breaks": min_breaks, "cuthill-mckee": cuthill_mckee}
