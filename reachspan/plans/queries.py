"""Queries over matrices and graphs that stand in the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspan.functions import indexing as I
from reachspan.functions import ranges as R
from reachspan.operators import algebra as A
from reachspan.operators import dindex as D
from reachspan.operators import graph as G
from reachspan.operators.ordering import wide
from reachspan.plans import derived
from reachspan.runtime import checkpoint_folder, cut, parts_for
from reachspan.sources import generate, gfa, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_EVENTS = """
nxt AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u, lead(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t FROM events),
a AS (SELECT event_id AS "row", u AS col FROM nxt WHERE u IS NOT NULL UNION SELECT event_id, t FROM nxt WHERE t IS NOT NULL),
ids AS (SELECT event_id AS i FROM events)"""
_WALK = """
walk AS (SELECT i, i AS j, 0 AS k FROM ids UNION SELECT w.i, a.col, w.k + 1 FROM walk w JOIN a ON a."row" = w.j WHERE w.k < {steps})"""
_TURNS = """
t AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS len, row_number() OVER (ORDER BY conv_id, turn) AS rank FROM conversations),
n AS (SELECT conv_id, turn, len, rank, CAST(coalesce(sum(len) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, lead(rank) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM t),
adj AS (SELECT "row", "row" + 1 AS col FROM (SELECT unnest(range(start, start + len - 1)) AS "row" FROM n) UNION SELECT x.start + x.len - 1, y.start FROM n x JOIN n y ON y.rank = x.nx)"""
_CELLS = 'cells AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS "row", CAST(l_partkey AS BIGINT) AS col FROM lineitem)'


def _islands(cells: str) -> str:
    """Intervals of a relation of distinct cells."""
    return f'SELECT "row", min(col) AS lo, max(col) AS hi FROM (SELECT "row", col, col - row_number() OVER (PARTITION BY "row" ORDER BY col) AS g FROM {cells}) GROUP BY "row", g'


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- graphs ----------------------------------------------------------------------------------------------------------


@_query(f'WITH {_TURNS} SELECT CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col FROM adj')
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adjacency_matrix(derived.conversations_graph(spark, sf_dir)).df


@_query(f"WITH {_TURNS} {_islands('adj')}")
def adjacency_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.range_adjacency_matrix(derived.conversations_graph(spark, sf_dir)).df


@_query(f'WITH {_TURNS} SELECT CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, 1 AS value FROM adj')
def adjacency_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adjacency_values(derived.conversations_graph(spark, sf_dir))


@_query(f"WITH {_TURNS} SELECT rank, CAST(len AS BIGINT) AS len, start FROM n")
def locus_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.locus_offsets(derived.conversations_graph(spark, sf_dir)).select("rank", "len", "start")


@_query(f"WITH {_TURNS} SELECT rank FROM n WHERE turn = (SELECT min(m.turn) FROM n m WHERE m.conv_id = n.conv_id)")
def start_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.start_nodes(derived.conversations_graph(spark, sf_dir)).select("rank")


@_query(f"WITH {_TURNS}, c AS (SELECT conv_id, min(rank) AS lower FROM n GROUP BY conv_id) SELECT row_number() OVER (ORDER BY lower) AS component, lower, coalesce(lead(lower) OVER (ORDER BY lower), (SELECT max(rank) + 1 FROM n)) AS upper FROM c")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(derived.conversations_graph(spark, sf_dir))


@_query(f"WITH {_TURNS} SELECT count(*) AS nodes, count(nx) AS edges, CAST(sum(len) AS BIGINT) AS loci, CAST(sum(len) - count(*) + count(nx) AS BIGINT) AS nnz FROM n")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.conversations_graph(spark, sf_dir)
    nodes, edges, loci = G.node_count(g), G.edge_count(g), G.total_loci(g)
    return G.adjacency_matrix(g).df.agg(F.lit(nodes).cast("long").alias("nodes"), F.lit(edges).cast("long").alias("edges"), F.lit(loci).cast("long").alias("loci"), F.count("*").alias("nnz"))


@_query(f"WITH {_TURNS}, c AS (SELECT conv_id, min(rank) AS lower, max(rank) + 1 AS upper FROM n GROUP BY conv_id) SELECT lower, upper FROM c WHERE conv_id = (SELECT max(conv_id) FROM n)")
def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.conversations_graph(spark, sf_dir)
    last = derived.table(spark, sf_dir, "conversations").agg(F.max("conv_id").alias("c")).first().c
    return spark.createDataFrame([G.region_nodes_rank_range(g, path=str(last))], "lower long, upper long")


# -- conversions and counts ------------------------------------------------------------------------------------------


@_query(f"WITH {_CELLS} {_islands('cells')}")
def to_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.orders_parts(spark, sf_dir).to_ranges().df


@_query(f"WITH {_CELLS} SELECT * FROM cells")
def to_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.orders_parts(spark, sf_dir).to_ranges().to_basic().df


@_query(f"WITH {_CELLS} SELECT count(*) AS nnz FROM cells")
def nnz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nnz(derived.orders_parts(spark, sf_dir).to_ranges())


@_query(f'WITH {_TURNS}, r AS ({_islands("adj")}) SELECT count(*) AS ranges, CAST(sum(hi - lo + 1) AS BIGINT) AS nnz, CAST(max(greatest(abs(lo - "row"), abs(hi - "row"))) AS BIGINT) AS bandwidth FROM r')
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stats(G.adjacency_matrix(derived.conversations_graph(spark, sf_dir))).select("ranges", "nnz", "bandwidth")


@_query(f'WITH {_CELLS} SELECT "row", min(col) AS first, max(col) AS last FROM cells GROUP BY "row"')
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_bands(derived.orders_parts(spark, sf_dir))


@_query(f"""WITH {_CELLS}, r AS ({_islands("cells")}) SELECT "row", "row" || ': ' || string_agg('(' || lo || ', ' || hi || ')', ' ' ORDER BY lo) AS text FROM r GROUP BY "row" """)
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rendered(derived.orders_parts(spark, sf_dir))


@_query(
    f'WITH {_CELLS}, r AS (SELECT unnest(range((SELECT max("row") + 1 FROM cells))) AS "row"), c AS (SELECT r."row", count(cells.col) AS n FROM r LEFT JOIN cells ON cells."row" = r."row" GROUP BY 1) '
    'SELECT "row", CAST(sum(n) OVER (ORDER BY "row") - n AS BIGINT) AS "begin", CAST(sum(n) OVER (ORDER BY "row") AS BIGINT) AS "end" FROM c'
)
def row_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_delimiters(derived.orders_parts(spark, sf_dir))


# -- algebra ---------------------------------------------------------------------------------------------------------


@_query('SELECT i AS "row", i AS lo, i AS hi FROM (SELECT unnest(range((SELECT count(*) FROM events))) AS i)')
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.identity(spark, derived.table(spark, sf_dir, "events").count()).df


@_query(f'WITH {_EVENTS}, s AS (SELECT * FROM a UNION SELECT i, i FROM ids) {_islands("s")}')
def add(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = derived.events_matrix(spark, sf_dir).to_ranges()
    return A.add(a, A.identity(spark, a.nrows)).df


@_query(f'WITH {_CELLS}, p AS (SELECT DISTINCT x."col" AS "row", y.col FROM cells x JOIN cells y ON x."row" = y."row") {_islands("p")}')
def multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that some order holds together."""
    m = derived.orders_parts(spark, sf_dir)
    return A.multiply(derived.transposed(m).to_ranges(), m.to_ranges()).df


def _walks(low: int, high: int) -> str:
    return f'WITH RECURSIVE {_EVENTS}, {_WALK.format(steps=high)}, d AS (SELECT DISTINCT i AS "row", j AS col FROM walk WHERE k BETWEEN {low} AND {high}) '


for _k in (0, 1, 2, 3, 5):

    def _power(spark: SparkSession, sf_dir: str, k: int = _k) -> DataFrame:
        return A.power(derived.events_matrix(spark, sf_dir).to_ranges(), k, keep=False).df

    _power.__name__ = f"power_{_k}"
    _query(_walks(_k, _k) + _islands("d"))(_power)


@_query(_walks(2, 4) + _islands("d"))
def dindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: events within two to four steps."""
    return D.create_distance_index(derived.events_matrix(spark, sf_dir).to_ranges(), 2, 4).df


@_query(_walks(0, 3) + _islands("d"))
def dindex_from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.create_distance_index(derived.events_matrix(spark, sf_dir).to_ranges(), 0, 3).df


@_query(_walks(3, 3) + 'SELECT "row", col FROM d')
def dindex_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.create_distance_index(derived.events_matrix(spark, sf_dir), 3, 3).df


@_query(_walks(1, 3) + _islands("d"))
def dindex_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stepwise_index(derived.events_matrix(spark, sf_dir), 1, 3).df


@_query(f'WITH RECURSIVE {_EVENTS}, {_WALK.format(steps=4)}, d AS (SELECT DISTINCT i AS "row", j AS col FROM walk WHERE k IN (1, 4)) {_islands("d")}')
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = derived.events_matrix(spark, sf_dir).to_ranges()
    return A.merge(D.create_distance_index(a, 1, 1), D.create_distance_index(a, 4, 4)).df


_CONVERSATION_INDEX = f"""WITH {_TURNS}, l AS (SELECT unnest(range(start, start + len)) AS x, conv_id, start, start + len - 1 AS stop FROM n), d AS (SELECT p.x AS "row", q.x AS col FROM l p JOIN l q ON q.conv_id = p.conv_id AND q.x - p.x BETWEEN 2 AND 12 {{only}}) """


@_query(_CONVERSATION_INDEX.format(only="AND q.x > p.stop") + _islands("d"))
def compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.conversations_graph(spark, sf_dir)
    return D.compress_distance_index(D.create_distance_index(G.range_adjacency_matrix(g), 2, 12, keep=False), g).df


@_query(f"WITH {_TURNS} {_islands('adj')}")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole adjacency put together from the ranks' two halves and what lies between them."""
    g = derived.conversations_graph(spark, sf_dir)
    parts = [(r.lower, r.upper) for r in G.components(g).agg(F.min("lower").alias("lower"), F.max("upper").alias("upper")).collect()]
    lower, upper = parts[0]
    middle = G.components(g).where(F.col("lower") >= (lower + upper) // 2).agg(F.min("lower").alias("m")).first().m or upper
    first, second = G.range_adjacency_matrix(g, lower, middle), G.range_adjacency_matrix(g, middle, upper + 1)
    whole = first.nrows + second.nrows
    return A.from_blocks(whole, whole, [(second, first.nrows, first.ncols), (first, 0, 0)]).df


_PAIRS = "pairs AS (SELECT event_id AS i, (event_id * 7 + 3) % (SELECT count(*) + 5 FROM events) AS j FROM events UNION ALL SELECT event_id, event_id + 40 FROM events)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "events").select("event_id")
    n = events.count()
    i = F.col("event_id")
    return events.select(i.alias("i"), ((i * 7 + 3) % (n + 5)).alias("j")).unionByName(events.select(i.alias("i"), (i + 40).alias("j")))


@_query(_walks(1, 4) + f', {_PAIRS} SELECT i, j, EXISTS (SELECT 1 FROM d WHERE d."row" = i AND d.col = j) AS hit FROM pairs')
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = D.create_distance_index(derived.events_matrix(spark, sf_dir).to_ranges(), 1, 4, keep=False)
    return D.query(index, _pairs(spark, sf_dir))


@_query(_walks(1, 4) + f', {_PAIRS} SELECT i, j FROM pairs WHERE EXISTS (SELECT 1 FROM d WHERE d."row" = i AND d.col = j)')
def lookup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = D.create_distance_index(derived.events_matrix(spark, sf_dir).to_ranges(), 1, 4)
    return D.hits(index, _pairs(spark, sf_dir))


# -- sources and sinks -----------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _read_back(spark: SparkSession, sf_dir: str, version: str, read_as: str) -> G.Graph:
    path = _folder(spark, "graph")
    gfa.write_gfa(derived.conversations_graph(spark, sf_dir), path, version)
    return gfa.read_gfa(spark, path, read_as)


_NAMED = _TURNS + ", named AS (SELECT *, conv_id || '/' || turn AS name FROM n)"


@_query(f"WITH {_NAMED} SELECT name, CAST(len AS BIGINT) AS len, row_number() OVER (ORDER BY name) AS rank FROM named")
def gfa1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir, "gfa1", "gfa1").nodes.select("name", "len", "rank")


@_query(f"WITH {_NAMED} SELECT a.name AS a, b.name AS b FROM named a JOIN named b ON b.rank = a.nx")
def gfa1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _read_back(spark, sf_dir, "gfa1", "gfa")
    names = g.nodes.select("id", "name")
    return g.edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select("a", "b")


@_query(f"WITH {_NAMED}, o AS (SELECT name, len, row_number() OVER (ORDER BY name) AS rank FROM named) SELECT rank, CAST(coalesce(sum(len) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM o")
def gfa2_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.locus_offsets(_read_back(spark, sf_dir, "gfa2", "gfa2")).select("rank", "start")


@_query(f"WITH {_NAMED} SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, name FROM named")
def gfa2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _read_back(spark, sf_dir, "gfa2", "")
    return g.paths.select(F.col("name").alias("path"), F.col("pos").cast("long").alias("pos"), F.col("node").alias("id")).join(g.nodes.select("id", "name"), "id").select("path", "pos", "name")


_DOT_K = 3


@_query(f"""
WITH q AS (SELECT string_agg(regexp_replace(upper(n_name), '[^ACGTNacgtn]', 'N', 'g'), 'N' ORDER BY n_nationkey) || 'N' AS s FROM nation),
e AS (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 7 + 3) % 20 AS BIGINT) AS b FROM nation),
v AS (SELECT CAST(n_nationkey AS BIGINT) AS i, n_nationkey * 5 AS p, 2 + n_nationkey % 6 AS l, CASE WHEN n_nationkey IN (SELECT b FROM e) THEN {_DOT_K - 1} ELSE 0 END AS cut FROM nation)
SELECT 'H' || chr(9) || 'VN:Z:1.0' AS value UNION ALL
SELECT 'S' || chr(9) || (i + 1) || chr(9) || CASE WHEN length(substr(s, CAST(p + 1 AS BIGINT), CAST(l AS BIGINT))) > cut THEN substr(substr(s, CAST(p + 1 AS BIGINT), CAST(l AS BIGINT)), cut + 1) ELSE 'N' END FROM v, q UNION ALL
SELECT 'L' || chr(9) || (a + 1) || chr(9) || '+' || chr(9) || (b + 1) || chr(9) || '+' || chr(9) || '0M' FROM e WHERE a <> b""")
def dot_to_gfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOT graph with one node for each nation, over the nations' names as FASTA records."""
    nations = derived.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"), "n_name")
    dot, fasta = _folder(spark, "dot"), _folder(spark, "fasta")
    label = F.format_string('%d [label="0:1,%d:%d"]', "i", F.col("i") * 5, F.col("i") % 6 + 2)
    edge = F.format_string("%d -> %d", "i", (F.col("i") * 7 + 3) % 20)
    nations.select(F.explode(F.array(label, edge)).alias("value")).write.text(dot)
    nations.repartitionByRange(1, "i").sortWithinPartitions("i").select(F.explode(F.array(F.concat(F.lit(">"), F.col("i").cast("string")), F.upper("n_name"))).alias("value")).write.text(fasta)
    return gfa.dot_to_gfa(spark, dot, fasta, _DOT_K, skip_loops=True)


def _stored(spark: SparkSession, m) -> tuple[str, object]:
    path = _folder(spark, "matrix")
    storage.save(m, path)
    return path, storage.load(spark, path)


@_query(f"WITH {_CELLS} {_islands('cells')}")
def stored_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, derived.orders_parts(spark, sf_dir).to_ranges())[1].df


@_query(f"""WITH {_CELLS} SELECT max("row") + 1 AS nrows, max(col) + 1 AS ncols, count(*) AS nnz, 'basic' AS encoding, true AS held FROM cells""")
def stored_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, m = _stored(spark, derived.orders_parts(spark, sf_dir))
    held = storage.size_in_bytes(spark, path) > 0
    return spark.read.parquet(f"{path}/shape").select("nrows", "ncols", "nnz", "encoding", F.lit(held).alias("held"))


@_query(_CONVERSATION_INDEX.format(only="AND q.x > p.stop") + _islands("d"))
def stored_compressed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.conversations_graph(spark, sf_dir)
    index = D.compress_distance_index(D.create_distance_index(G.range_adjacency_matrix(g), 2, 12, keep=False), g)
    return _stored(spark, index)[1].df


_PLACED = f'WITH {_CELLS}, c AS (SELECT *, row_number() OVER (ORDER BY "row", col) - 1 AS place FROM cells) '


@_query(_PLACED + "SELECT place, col AS entry FROM c")
def csr_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat entries, sorted in every row."""
    return storage.to_csr(derived.orders_parts(spark, sf_dir))[0]


@_query(f"WITH {_CELLS} {_islands('cells')}")
def csr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived.orders_parts(spark, sf_dir).to_ranges()
    return storage.from_csr_tables(*storage.to_csr(m), m.ncols, "ranges").df


_NATIONS = 'cells AS (SELECT CAST(n_regionkey AS BIGINT) AS "row", CAST(n_nationkey AS BIGINT) AS col FROM nation)'


@_query(f"WITH {_NATIONS} {_islands('cells')}")
def csr_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays that the driver holds: which nations a region has."""
    nation = derived.table(spark, sf_dir, "nation")
    size = nation.agg(F.max("n_regionkey") + 1, F.max("n_nationkey") + 1).first()
    entries, rows = storage.to_csr(A.from_cells(nation, size[0], size[1], "n_regionkey", "n_nationkey").to_ranges())
    ends = [r.end for r in rows.orderBy("row").collect()]
    return storage.from_csr(spark, size[1], [r.entry for r in entries.orderBy("place").collect()], [0, *ends], "ranges").df


@_query(f"WITH {_CELLS} SELECT * FROM cells")
def external_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived.orders_parts(spark, sf_dir)
    return A.from_cells(derived.table(spark, sf_dir, "lineitem"), m.nrows, m.ncols, "l_orderkey", "l_partkey").df


@_query("SELECT CAST(count(*) AS BIGINT) AS n, true AS inside, true AS again FROM events")
def random_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.table(spark, sf_dir, "events").count()
    pairs, again = (generate.random_pairs(spark, 100, n, seed=5) for _ in range(2))
    equal = pairs.exceptAll(again).isEmpty()
    return pairs.agg(F.count("*").alias("n"), F.bool_and(F.col("i").between(0, 99) & F.col("j").between(0, 99)).alias("inside"), F.lit(equal).alias("again"))


_SIZES = "(SELECT count(*) AS k FROM nation) t, (SELECT count(*) AS r FROM region) u"


@_query(f"SELECT CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS cells, true AS inside FROM (SELECT unnest([0, r, k * k // 2, k * k]) AS n FROM {_SIZES})")
def random_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty, sparse, half and full matrices with as many rows as nations and values from one to two: as many distinct cells as asked for."""
    k, r = derived.table(spark, sf_dir, "nation").count(), derived.table(spark, sf_dir, "region").count()
    parts = []
    for n in (0, r, k * k // 2, k * k):
        m = generate.random_matrix(spark, k, n, 1.0, 2.0, seed=n)
        inside = F.col("row").between(0, k - 1) & F.col("col").between(0, k - 1) & (F.col("value") >= 1) & (F.col("value") < 2)
        parts.append(m.agg(F.lit(n).cast("long").alias("n"), F.count_distinct("row", "col").alias("cells"), F.coalesce(F.bool_and(inside), F.lit(True)).alias("inside")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_query("SELECT (SELECT count(*) FROM orders) AS n, count(*) AS cells, count(*) AS places, true AS inside, true AS again FROM lineitem")
def random_matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix with a row for each order and a cell for each line item, drawn by blocks of rows, and drawn again."""
    n, nnz = derived.table(spark, sf_dir, "orders").count(), derived.table(spark, sf_dir, "lineitem").count()
    m, again = (generate.random_binary_matrix(spark, n, nnz, seed=9).df for _ in range(2))
    total = lambda df: df.agg(F.sum(F.xxhash64("row", "col").cast("decimal(38,0)")).alias("s")).first().s
    inside = F.bool_and(F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1))
    return m.agg(F.lit(n).cast("long").alias("n"), F.count("*").alias("cells"), F.count_distinct("row", "col").alias("places"), inside.alias("inside"), F.lit(total(m) == total(again)).alias("again"))


# -- more of graphs --------------------------------------------------------------------------------------------------


@_query(f"WITH {_NAMED}, w AS (SELECT name, rank FROM named WHERE rank = (SELECT max(rank) FROM named)) SELECT name, rank AS id FROM w UNION ALL SELECT 'no such name', 0")
def node_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.conversations_graph(spark, sf_dir)
    name = g.nodes.agg(F.max_by("name", "rank").alias("name")).first().name
    return spark.createDataFrame([(n, G.node_by_name(g, n)) for n in (name, "no such name")], "name string, id long")


@_query(f"WITH {_NAMED}, c AS (SELECT conv_id, min(rank) AS lower, max(rank) + 1 AS upper FROM n GROUP BY conv_id) SELECT rank AS lower, (SELECT upper FROM c WHERE c.conv_id = named.conv_id) AS upper FROM named WHERE rank IN (1, (SELECT max(rank) FROM named))")
def region_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a segment's name, where the path is missing, and from the first node, where both are."""
    g = derived.conversations_graph(spark, sf_dir)
    name = g.nodes.agg(F.max_by("name", "rank").alias("name")).first().name
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = [G.region_nodes_rank_range(g, "no such path", name), G.region_nodes_rank_range(g, "no such path", "no such segment")]
    return spark.createDataFrame(found, "lower long, upper long")


@_query("SELECT CAST(count(*) + 1 AS BIGINT) AS upper, CAST(0 AS BIGINT) AS component, CAST(0 AS BIGINT) AS n FROM nation")
def component_of_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a circle: there is no start node."""
    n = derived.table(spark, sf_dir, "nation").count()
    ids = spark.range(1, n + 1)
    nodes = ids.select(F.col("id").alias("rank"), "id", F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("len"))
    edges = ids.select(F.col("id").alias("src"), (F.col("id") % n + 1).alias("dst"))
    return spark.createDataFrame([G.upper_node_rank_in_component(G.Graph(nodes, edges), 3)], "upper long, component long, n long")


@_query(f"WITH {_NAMED} SELECT name FROM named WHERE starts_with(name, '1') AND suffix(name, '/0')")
def names_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.conversations_graph(spark, sf_dir).nodes.where(I.starts_with("name", "1") & I.ends_with("name", "/0")).select("name")


def _order_query(ordering: str, by: str) -> None:
    def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = G.order_nodes(derived.conversations_graph(spark, sf_dir), ordering, seed=3)
        ranks = g.nodes.select("id", "rank")
        n = ranks.agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("n"), F.count("*").alias("m")).first()
        whole = (n.a, n.b, n.m) == (1, n.n, n.n)
        steps = g.edges.join(ranks.toDF("src", "a"), "src").join(ranks.toDF("dst", "b"), "dst")
        return steps.select("src", "dst", F.expr(by).alias("holds"), F.lit(whole).alias("whole"))

    ordered.__name__ = "order_" + ordering.replace("-", "_")
    ordered.__doc__ = f"Edges of the graph ordered by {ordering}, whether what the order promises on chains holds, and whether ranks are whole."
    _query(f"WITH {_TURNS} SELECT rank AS src, nx AS dst, true AS holds, true AS whole FROM n WHERE nx IS NOT NULL")(ordered)


for _ordering, _by in {"native": "b = a + 1", "random": "a <> b", "topological": "a < b", "cuthill-mckee": "abs(a - b) = 1", "min-breaks": "b = a + 1"}.items():
    _order_query(_ordering, _by)


# -- more of matrices ------------------------------------------------------------------------------------------------


@_query('SELECT i AS "row", i AS col FROM (SELECT unnest(range((SELECT count(*) FROM events))) AS i)')
def identity_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.identity(spark, derived.table(spark, sf_dir, "events").count(), "basic").df


@_query(f"WITH {_CELLS} SELECT count(*) AS nnz FROM cells")
def nnz_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nnz(derived.orders_parts(spark, sf_dir))


@_query(f'WITH {_TURNS}, r AS ({_islands("adj")}) SELECT count(*) AS ranges, CAST(round(1000000 * count(*) / (SELECT sum(len) FROM n)) AS BIGINT) AS ranges_a_million_rows, CAST(round(1000 * sum(hi - lo + 1) / count(*)) AS BIGINT) AS cells_a_thousand_ranges FROM r')
def stats_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.stats(G.adjacency_matrix(derived.conversations_graph(spark, sf_dir)))
    return s.select("ranges", F.round(F.col("ranges_per_row") * 1000000).cast("long").alias("ranges_a_million_rows"), F.round(F.col("nnz_per_range") * 1000).cast("long").alias("cells_a_thousand_ranges"))


@_query(f"""WITH {_TURNS} SELECT CAST("row" AS BIGINT) AS "row", "row" || ': ' || string_agg('(' || col || ', 1)', ' ' ORDER BY col) AS text FROM adj GROUP BY "row" """)
def rendered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rendered_values(G.adjacency_values(derived.conversations_graph(spark, sf_dir)))


@_query(f'WITH {_CELLS} SELECT lo, hi FROM ({_islands("cells")}) WHERE "row" = (SELECT max("row") FROM cells)')
def one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived.orders_parts(spark, sf_dir).to_ranges()
    return R.row_of(m, m.nrows - 1)


@_query("SELECT true AS same, false AS other, false AS shape")
def equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix and its other encoding are equal; with one more cell, or with another shape, they are not."""
    m = derived.orders_parts(spark, sf_dir)
    larger = A.from_blocks(m.nrows + 1, m.ncols, [(m, 0, 0)], "basic")
    more = A.add(larger, A.from_cells(spark.createDataFrame([(m.nrows, 0)], "row long, col long"), m.nrows + 1, m.ncols, bound=1))
    return spark.createDataFrame([(m.equals(m.to_ranges()), larger.equals(more), m.equals(larger))], "same boolean, other boolean, shape boolean")


@_query(f'WITH {_CELLS} SELECT DISTINCT x.col AS "row", y.col FROM cells x JOIN cells y ON x."row" = y."row"')
def multiply_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived.orders_parts(spark, sf_dir)
    return A.multiply(derived.transposed(m), m).df


_TWO_STEPS = f"WITH {_TURNS}, l AS (SELECT unnest(range(start, start + len)) AS x, conv_id FROM n) "


@_query(_TWO_STEPS + ', d AS (SELECT p.x AS "row", q.x AS col FROM l p JOIN l q ON q.conv_id = p.conv_id AND q.x - p.x BETWEEN 0 AND 20) ' + _islands("d"))
def multiply_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long intervals by blocks of columns: up to twelve steps and up to eight more."""
    a = G.range_adjacency_matrix(derived.conversations_graph(spark, sf_dir))
    return A.multiply(D.create_distance_index(a, 0, 12), D.create_distance_index(a, 0, 8), "bucket").df


@_query(_TWO_STEPS + ', d AS (SELECT p.x AS "row", q.x AS col FROM l p JOIN l q ON q.conv_id = p.conv_id AND q.x - p.x BETWEEN 3 AND 30) ' + _islands("d"))
def multiply_dyadic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long intervals by blocks of powers of two: 3 to 18 steps and up to twelve more."""
    a = G.range_adjacency_matrix(derived.conversations_graph(spark, sf_dir))
    return A.multiply(D.create_distance_index(a, 3, 18), D.create_distance_index(a, 0, 12), "dyadic").df


@_query(f'WITH RECURSIVE {_EVENTS}, {_WALK.format(steps=4)} SELECT DISTINCT i AS "row", j AS col FROM walk WHERE k IN (1, 4)')
def merge_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = derived.events_matrix(spark, sf_dir)
    return A.merge(D.create_distance_index(a, 1, 1), D.create_distance_index(a, 4, 4)).df


@_query(_CONVERSATION_INDEX.format(only="AND q.x > p.stop") + 'SELECT "row", col FROM d')
def compress_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.conversations_graph(spark, sf_dir)
    return D.compress_distance_index(D.create_distance_index(G.adjacency_matrix(g), 2, 12, keep=False), g).df


@_query(_walks(1, 2) + f', {_PAIRS} SELECT i, j, EXISTS (SELECT 1 FROM d WHERE d."row" = i AND d.col = j) AS hit FROM pairs')
def lookup_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.query(D.create_distance_index(derived.events_matrix(spark, sf_dir), 1, 2), _pairs(spark, sf_dir))


@_query(f'WITH {_CELLS}, p AS (SELECT * FROM (SELECT "row" AS i, col AS j FROM cells ORDER BY 1, 2 LIMIT 3) UNION ALL SELECT 0, max(col) FROM cells) SELECT i, j, EXISTS (SELECT 1 FROM cells WHERE "row" = i AND col = j) AS hit, false AS refused FROM p UNION ALL SELECT max("row") + 1, 0, false, true FROM cells')
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three cells, one more, and one that lies beyond the matrix and is refused."""
    m = _stored(spark, derived.orders_parts(spark, sf_dir).to_ranges())[1]
    asked = [tuple(r) for r in m.to_basic().df.orderBy("row", "col").limit(3).collect()] + [(0, m.ncols - 1), (m.nrows, 0)]
    rows = []
    for i, j in asked:
        try:
            rows.append((i, j, D.at(m, i, j), False))
        except IndexError:
            rows.append((i, j, False, True))
    return spark.createDataFrame(rows, "i long, j long, hit boolean, refused boolean")


# -- long rows, planned indices, branching graphs, stored buckets -----------------------------------------------------


@_query("SELECT CAST(0 AS BIGINT) AS i, CAST(l_orderkey * 10 + l_partkey % 10 AS BIGINT) AS j, l_partkey % 10 <= o_custkey % 8 AS hit FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 1, CAST(l_orderkey AS BIGINT), false FROM lineitem")
def lookup_hub_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each line item in the one row that holds all orders' intervals, and as many in an empty row."""
    lines = derived.table(spark, sf_dir, "lineitem")
    asked = lines.select(F.lit(0).alias("i"), (F.col("l_orderkey") * 10 + F.col("l_partkey") % 10).alias("j")).unionByName(lines.select(F.lit(1).alias("i"), F.col("l_orderkey").alias("j")))
    return D.query(derived.orders_row(spark, sf_dir), asked, method="asof")


@_query("SELECT CAST(l_orderkey * 10 + l_partkey % 10 AS BIGINT) AS j, CAST(l_linenumber AS BIGINT) AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 10 <= o_custkey % 8")
def hits_hub_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items of `lookup_hub_row` that are held, with another column; auto finds the long row."""
    lines = derived.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("i"), (F.col("l_orderkey") * 10 + F.col("l_partkey") % 10).cast("long").alias("j"), F.col("l_linenumber").cast("long").alias("line"))
    return D.hits(derived.orders_row(spark, sf_dir), lines).select("j", "line")


@_query("""WITH s AS (SELECT o_orderkey * 10 AS lo, o_orderkey * 10 + o_custkey % 8 AS hi FROM orders UNION ALL SELECT l_partkey * 50, l_partkey * 50 + l_suppkey % 60 FROM lineitem),
m AS (SELECT lo, hi, coalesce(lo > max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS fresh FROM s),
g AS (SELECT lo, hi, sum(CAST(fresh AS INT)) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT CAST(0 AS BIGINT) AS "row", CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi FROM g GROUP BY g""")
def add_hub_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row with all orders' intervals and one with all parts' of line items, which overlap, nest and touch, made one by blocks of columns."""
    first = derived.orders_row(spark, sf_dir)
    lines = derived.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("row"), (F.col("l_partkey") * 50).alias("lo"), (F.col("l_partkey") * 50 + F.col("l_suppkey") % 60).alias("hi"))
    return R.coalesce_ranges(first.df.unionByName(lines), bits=10)


@_query(_walks(2, 4) + _islands("d"))
def dindex_by_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.create_distance_index(derived.events_matrix(spark, sf_dir).to_ranges(), 2, 4, "steps").df


@_query(_walks(2, 4) + _islands("d"))
def dindex_by_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.create_distance_index(derived.events_matrix(spark, sf_dir).to_ranges(), 2, 4, "doubling", keep=False).df


@_query(_walks(2, 2) + "SELECT count(*) AS cells, true AS near FROM d")
def product_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the events' second power, and whether the estimate from sketches is within a twentieth."""
    a = A._written(derived.events_matrix(spark, sf_dir))
    about = D.product_size(a, a)
    return R.nnz(A.multiply(a, a)).select(F.col("nnz").alias("cells"), (F.abs(F.col("nnz") - about) * 20 <= F.col("nnz")).alias("near"))


def _placed_edges(g: G.Graph, o: G.Graph) -> tuple[DataFrame, int]:
    """Edges of a graph with both ranks in another order, a and b, and in its own, x and y; and how many ranks the other has, if they are whole from 1."""
    ranks = cut(o.nodes.select("id", F.col("rank").alias("new")).join(wide(g.nodes.select("id", F.col("rank").alias("old"))), "id"))
    edges = g.edges.join(wide(ranks.toDF("src", "a", "x")), "src").join(wide(ranks.toDF("dst", "b", "y")), "dst")
    n = ranks.agg(F.min("new").alias("a"), F.max("new").alias("b"), F.count_distinct("new").alias("n")).first()
    return edges, n.n if (n.a, n.b) == (1, n.n) else -1


_WHOLE = "(SELECT count(*) FROM events) AS ranks"


@_query(f'WITH {_EVENTS} SELECT "row" + 1 AS src, col + 1 AS dst, true AS forward, {_WHOLE} FROM a')
def order_topological_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step between events leads forward, though their ranks were by type."""
    g = derived.events_graph(spark, sf_dir)
    placed, ranks = _placed_edges(g, G.order_nodes(g, "topological"))
    return placed.select("src", "dst", (F.col("a") < F.col("b")).alias("forward"), F.lit(ranks).cast("long").alias("ranks"))


@_query(f"""WITH {_EVENTS}, o AS (SELECT "row" FROM a GROUP BY 1 HAVING count(*) = 1), i AS (SELECT col FROM a GROUP BY 1 HAVING count(*) = 1)
SELECT count(*) AS edges, count(*) FILTER (WHERE "row" IN (SELECT "row" FROM o) AND col IN (SELECT col FROM i)) AS single, true AS forward, true AS together, {_WHOLE} FROM a""")
def order_min_breaks_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that are the only way out and the only way in lead to the next rank; all lead forward."""
    g = derived.events_graph(spark, sf_dir)
    placed, ranks = _placed_edges(g, G.order_nodes(g, "min-breaks"))
    out, into = placed.groupBy("src").agg(F.count("*").alias("n_out")), placed.groupBy("dst").agg(F.count("*").alias("n_in"))
    told = placed.join(wide(out), "src").join(wide(into), "dst").withColumn("single", (F.col("n_out") == 1) & (F.col("n_in") == 1))
    return told.agg(
        F.count("*").alias("edges"), F.count_if("single").alias("single"), F.bool_and(F.col("a") < F.col("b")).alias("forward"),
        F.coalesce(F.bool_and(F.when(F.col("single"), F.col("b") == F.col("a") + 1)), F.lit(True)).alias("together"), F.lit(ranks).cast("long").alias("ranks"),
    )


@_query(f"WITH {_EVENTS} SELECT count(*) AS edges, true AS narrower, {_WHOLE} FROM a")
def order_cuthill_mckee_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest distance of an edge's ranks is smaller than by type."""
    g = derived.events_graph(spark, sf_dir)
    placed, ranks = _placed_edges(g, G.order_nodes(g, "cuthill-mckee"))
    far = lambda p, q: F.max(F.abs(F.col(p) - F.col(q)))
    return placed.agg(F.count("*").alias("edges"), (far("a", "b") < far("x", "y")).alias("narrower"), F.lit(ranks).cast("long").alias("ranks"))


@_query(f"WITH {_CELLS} SELECT l_orderkey AS i, l_partkey + l_linenumber % 2 AS j, EXISTS (SELECT 1 FROM cells WHERE \"row\" = l_orderkey AND col = l_partkey + l_linenumber % 2) AS hit FROM lineitem")
def lookup_stored_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups on a matrix that is stored in buckets by row."""
    path, held = _folder(spark, "buckets"), derived.table(spark, sf_dir, "lineitem")
    # a bucket is one task's, so there are more of them for more rows
    storage.save(derived.orders_parts(spark, sf_dir).to_ranges(), path, buckets=max(8, parts_for(spark, held.count())))
    lines = held.select(F.col("l_orderkey").alias("i"), (F.col("l_partkey") + F.col("l_linenumber") % 2).alias("j"))
    return D.query(storage.load(spark, path), lines, method="join")


@_query(f"WITH {_CELLS}, r AS ({_islands('cells')}), n AS (SELECT max(\"row\") + 1 AS n FROM cells) SELECT CAST(8 * ((SELECT count(*) FROM cells) + n + 2) AS BIGINT) AS basic, CAST(8 * (2 * (SELECT count(*) FROM r) + n + 2) AS BIGINT) AS ranges, true AS smaller FROM n")
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as flat arrays in each encoding, and whether the stored files of both are smaller."""
    m = derived.orders_parts(spark, sf_dir)
    plain, stored = [], []
    for own in (A._written(m), A._written(m.to_ranges())):  # read for its sizes, for the order of rows and to be stored
        plain.append(storage.plain_size(own))
        stored.append(storage.size_in_bytes(spark, _stored(spark, own)[0]))
    return spark.createDataFrame([(*plain, stored[0] < plain[0] and stored[1] < plain[1])], "basic long, ranges long, smaller boolean")


def _band(row: int, col: int, n: int):
    """Two to twelve columns past the diagonal of a block of n rows."""
    for i in range(n - 2):
        yield i, i + 2, min(i + 12, n - 1)


@_query(_CONVERSATION_INDEX.format(only="") + _islands("d"))
def provided_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all conversations put together from one block each, which the executors make."""
    g = derived.conversations_graph(spark, sf_dir)
    loci = G.locus_offsets(g).join(g.paths.select("name", F.col("node").alias("id")).withColumnRenamed("name", "conv"), "id")
    corners = loci.groupBy("conv").agg(F.min("start").alias("row"), F.sum("len").alias("n")).select("row", F.col("row").alias("col"), "n")
    n = G.total_loci(g)
    return A.from_provider(corners, _band, n, n).df


@_query("""WITH p AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^ACGTNacgtn]', 'N', 'g') AS s FROM part)
SELECT CAST(coalesce(sum(length(s) + 1) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at, s AS text FROM p WHERE length(s) > 1""")
def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the names of parts, as FASTA records in several files, stand in the joined sequence."""
    path = _folder(spark, "fasta")
    parts = derived.table(spark, sf_dir, "part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
    parts.select(F.explode(F.array(F.concat(F.lit(">"), F.col("p_partkey").cast("string")), F.upper(F.trim("p_name")))).alias("value")).write.text(path)
    return gfa.fasta_pieces(spark, path).where(F.length("text") > 1)
