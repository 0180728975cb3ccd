"""Graphs from files, their loci and orders."""

import random

import pytest

from reachspan.operators import dindex as D
from reachspan.operators import graph as G
from reachspan.sources import gfa

GFA2 = "H\tVN:Z:2.0\nS\t1\t3\tACG\nS\t2\t1\tT\nS\t3\t2\tGG\nS\t4\t4\tACGT\nS\t5\t1\tA\nE\t*\t1+\t2+\t3$\t3$\t0\t0\t0M\nE\t*\t1+\t3+\t3$\t3$\t0\t0\t0M\nE\t*\t2+\t3+\t1$\t1$\t0\t0\t0M\nE\t*\t4+\t5+\t4$\t4$\t0\t0\t0M\nO\tx+\t4+ 5+\n"
GFA1 = "H\tVN:Z:1.0\nS\tb\tACG\nS\ta\tT\nS\tc\t*\tLN:i:2\nL\tb\t+\ta\t+\t0M\nL\tb\t+\ta\t+\t0M\nL\ta\t+\tc\t+\t0M\nP\tp\ta+,c+\t*\n"


def written(tmp_path, text, name):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_gfa2(spark, tmp_path):
    g = gfa.read_gfa(spark, written(tmp_path, GFA2, "g.gfa"))
    assert [tuple(r) for r in sorted(g.nodes.select("rank", "id", "len").collect())] == [(1, 1, 3), (2, 2, 1), (3, 3, 2), (4, 4, 4), (5, 5, 1)]
    a = G.adjacency_matrix(g)
    assert a.shape == (11, 11) and {tuple(r) for r in a.df.collect()} == {(0, 1), (1, 2), (2, 3), (2, 4), (3, 4), (4, 5), (6, 7), (7, 8), (8, 9), (9, 10)}
    assert (G.node_count(g), G.edge_count(g), G.total_loci(g), a.nnz()) == (5, 4, 11, 11 - 5 + 4)
    assert (G.node_count(g, 2, 4), G.edge_count(g, 2, 4), G.total_loci(g, 4)) == (2, 1, 5)
    assert {tuple(r) for r in G.components(g).collect()} == {(1, 1, 4), (2, 4, 6)}
    assert G.upper_node_rank_in_component(g, 2) == (4, 1, 2)
    assert (G.first_node_in_region(g, "x"), G.first_node_in_region(g, "y"), G.node_by_name(g, "3"), G.node_by_name(g, "9")) == (4, 0, 3, 0)
    assert G.region_nodes_rank_range(g, "x") == (4, 6) and G.region_nodes_rank_range(g, segment="2") == (2, 4)
    with pytest.warns(UserWarning):
        assert G.region_nodes_rank_range(g, "y") == (1, 4)
    second = G.adjacency_matrix(g, 4, 6)
    assert second.shape == (5, 5) and {tuple(r) for r in second.df.collect()} == {(0, 1), (1, 2), (2, 3), (3, 4)}
    assert {r.value for r in G.adjacency_values(g).collect()} == {1}


def test_gfa1(spark, tmp_path):
    path = written(tmp_path, GFA1, "g.gfa")
    g = gfa.read_gfa(spark, path, "gfa1")
    assert sorted((r.name, r.len) for r in g.nodes.collect()) == [("a", 1), ("b", 3), ("c", 2)] and g.edges.count() == 2
    assert [r.pos for r in g.paths.orderBy("pos").collect()] == [0, 1]
    with pytest.raises(ValueError):
        gfa.read_gfa(spark, path, "vg")


def test_dot(spark, tmp_path):
    dot = written(tmp_path, 'digraph G {\n 0 [label="0:4,2:5"]\n 1 [label="4:4"]\n 2 [label=""]\n 0 -> 1\n 0 -> 1\n 1 -> 1\n}\n', "g.dot")
    fasta = written(tmp_path, ">s\nACGTA\nCCGGT\n", "g.fa")
    got = sorted(r.value for r in gfa.dot_to_gfa(spark, dot, fasta, 3, skip_loops=True).collect())
    assert got == ["H\tVN:Z:1.0", "L\t1\t+\t2\t+\t0M", "S\t1\tGTACC", "S\t2\tCG", "S\t3\tN"]
    assert any(r.value == "L\t2\t+\t2\t+\t0M" for r in gfa.dot_to_gfa(spark, dot, fasta, 3).collect())


def test_dot_over_several_records(spark, tmp_path):
    """An N after each record, and for each letter that is no base."""
    fasta = written(tmp_path, ">a\nACGT\n>b x\nRTTT\nca\n", "g.fa")
    pieces = sorted((r["at"], r.text) for r in gfa.fasta_pieces(spark, fasta).collect())
    assert "".join(t for _, t in pieces) == "ACGTNNTTTcaN"
    dot = written(tmp_path, 'digraph G {\n 0 [label="5:4"]\n 1 [label="3:3"]\n}\n', "g.dot")
    assert sorted(r.value for r in gfa.dot_to_gfa(spark, dot, fasta, 1).collect()) == ["H\tVN:Z:1.0", "S\t1\tNTTT", "S\t2\tTNN"]


def test_components_without_starts(spark):
    g = graph(spark, 6, [(1, 2), (2, 1), (2, 3), (4, 5)])  # 4 and 6 are starts
    assert [G.upper_node_rank_in_component(g, r) for r in (1, 3, 4, 5, 6)] == [(4, 0, 2), (4, 0, 2), (6, 1, 2), (6, 1, 2), (7, 2, 2)]
    assert G.upper_node_rank_in_component(graph(spark, 3, [(1, 2), (2, 3), (3, 1)]), 2) == (4, 0, 0)


def graph(spark, n, edges, seed=0):
    rng = random.Random(seed)
    nodes = [(i, i, f"n{i}", rng.randint(1, 4)) for i in range(1, n + 1)]
    return G.Graph(spark.createDataFrame(nodes, "rank long, id long, name string, len long"), spark.createDataFrame(edges, "src long, dst long"))


@pytest.mark.parametrize("ordering", ["native", "random", "topological", "cuthill-mckee", "min-breaks"])
def test_orders(spark, ordering):
    rng = random.Random(1)
    edges = sorted({(a, b) for a, b in ((rng.randint(1, 20), rng.randint(1, 20)) for _ in range(40)) if a < b})
    moved = [(21 - a, 21 - b) for a, b in edges]
    g = graph(spark, 20, moved)
    o = G.order_nodes(g, ordering, seed=3)
    rank = {r.id: r["rank"] for r in o.nodes.collect()}
    assert sorted(rank.values()) == list(range(1, 21))
    if ordering in ("topological", "min-breaks"):
        assert all(rank[a] < rank[b] for a, b in moved)
    assert D.create_distance_index(G.range_adjacency_matrix(o), 1, 3).nnz() == D.create_distance_index(G.range_adjacency_matrix(g), 1, 3).nnz()


def test_orders_of_cycles_and_errors(spark):
    g = graph(spark, 3, [(1, 2), (2, 1), (2, 3)])
    assert G.order_nodes(g, "topological").nodes.count() == 3
    with pytest.raises(ValueError):
        G.order_nodes(g, "best")


@pytest.mark.parametrize("encoding", ["basic", "ranges"])
def test_compress(spark, encoding):
    g = graph(spark, 12, [(i, i + 1) for i in range(1, 12)] + [(1, 5), (3, 9)])
    offsets = {r["rank"]: (r.start, r.len) for r in G.locus_offsets(g).collect()}
    node = {x: r for r, (s, n) in offsets.items() for x in range(s, s + n)}
    a = G.range_adjacency_matrix(g)
    index = D.create_distance_index(a if encoding == "ranges" else a.to_basic(), 1, 6)
    want = {tuple(r) for r in index.to_basic().df.collect() if node[r.row] != node[r.col]}
    assert {tuple(r) for r in D.compress_distance_index(index, g).to_basic().df.collect()} == want
