"""Graph files: GFA 1 and 2, and the conversion of DOT with FASTA to GFA 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspan.functions.indexing import numbered
from reachspan.functions.ranges import prefix_sum
from reachspan.operators.graph import Graph
from reachspan.runtime import cut


def read_gfa(spark: SparkSession, path: str, version: str = "") -> Graph:
    """Nodes, edges and paths of a file.

    version: gfa1, gfa2, or gfa or empty to take it from the header, else from the records.  Nodes are ranked by numeric
    names if all names are numbers, which are their ids then, else by name.  Overlaps and orientation are not kept.
    """
    if version not in ("", "gfa", "gfa1", "gfa2"):
        raise ValueError(f"unknown format {version!r}")
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).withColumn("kind", F.col("f")[0])
    if version in ("", "gfa"):
        found = lines.where("kind in ('H', 'E', 'O')").agg(F.max(F.regexp_extract(F.array_join("f", "\t"), r"VN:Z:(\d)", 1)).alias("header"), F.max(F.col("kind").isin("E", "O")).alias("second")).first()
        version = f"gfa{found.header}" if found.header else "gfa2" if found.second else "gfa1"
        if version not in ("gfa1", "gfa2"):
            raise ValueError(f"unknown version {version!r}")
    segments = lines.where("kind = 'S'")
    if version == "gfa2":
        segments = segments.select(F.col("f")[1].alias("name"), F.col("f")[2].cast("long").alias("len"))
        ends = lines.where("kind = 'E'").select(F.regexp_replace(F.col("f")[2], "[+-]$", "").alias("a"), F.regexp_replace(F.col("f")[3], "[+-]$", "").alias("b"))
        steps = lines.where("kind = 'O'").select(F.regexp_replace(F.col("f")[1], "[+-]$", "").alias("name"), F.posexplode(F.split(F.col("f")[2], " ")).alias("pos", "step"))
    else:
        tagged = F.regexp_extract(F.array_join("f", "\t"), r"\tLN:i:(\d+)", 1)
        size = F.when(F.col("f")[2] == "*", F.coalesce(F.nullif(tagged, F.lit("")), F.lit("0")).cast("long")).otherwise(F.char_length(F.col("f")[2]))
        segments = segments.select(F.col("f")[1].alias("name"), size.cast("long").alias("len"))
        ends = lines.where("kind = 'L'").select(F.col("f")[1].alias("a"), F.col("f")[3].alias("b"))
        steps = lines.where("kind = 'P'").select(F.col("f")[1].alias("name"), F.posexplode(F.split(F.col("f")[2], "[,;]")).alias("pos", "step"))
    numeric = segments.where(~F.col("name").rlike(r"^\d{1,18}$")).isEmpty()
    order = F.col("name").cast("long") if numeric else F.col("name")
    nodes = numbered(segments.withColumn("_order", order), "_order", "rank")
    nodes = cut(nodes.select("rank", (F.col("_order") if numeric else F.col("rank")).alias("id"), "name", "len"))
    by_name = nodes.select("name", "id")
    edges = ends.join(by_name.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").join(by_name.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b").select("src", "dst").distinct()
    paths = steps.withColumn("_node", F.regexp_replace("step", "[+-]$", "")).join(by_name.select(F.col("name").alias("_node"), F.col("id").alias("node")), "_node").select("name", "pos", "node")
    return Graph(nodes, edges, paths)


def write_gfa(graph: Graph, path: str, version: str = "gfa1") -> None:
    """A graph as text, one line a record, in folder `path`: segments without sequence but with their lengths, edges forward with overlap 0M, and paths."""
    if version not in ("gfa1", "gfa2"):
        raise ValueError(f"unknown format {version!r}")
    first = version == "gfa1"
    tab = lambda *c: F.concat_ws("\t", *c).alias("value")
    names = graph.nodes.select("id", "name", "len")
    size = F.col("len").cast("string")
    segments = graph.nodes.select(tab(F.lit("S"), "name", F.lit("*"), F.concat(F.lit("LN:i:"), size)) if first else tab(F.lit("S"), "name", size, F.lit("*")))
    ends = graph.edges.join(names.toDF("src", "a", "n"), "src").join(names.toDF("dst", "b", "_n"), "dst")
    last = F.concat(F.col("n").cast("string"), F.lit("$"))
    plus = lambda c: F.concat(F.col(c), F.lit("+"))
    edges = ends.select(tab(F.lit("L"), "a", F.lit("+"), "b", F.lit("+"), F.lit("0M")) if first else tab(F.lit("E"), F.lit("*"), plus("a"), plus("b"), last, last, F.lit("0"), F.lit("0"), F.lit("0M")))
    lines = graph.nodes.sparkSession.createDataFrame([(f"H\tVN:Z:{'1' if first else '2'}.0",)], "value string").unionByName(segments).unionByName(edges)
    if graph.paths is not None:
        # a path is one record of the format, so its steps are one value
        steps = graph.paths.join(names.toDF("node", "step", "_n"), "node").groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", plus("step").alias("step")))), lambda x: x["step"]).alias("steps"))
        lines = lines.unionByName(steps.select(tab(F.lit("P"), "name", F.array_join("steps", ","), F.lit("*")) if first else tab(F.lit("O"), "name", F.array_join("steps", " "))))
    lines.write.text(path)


def fasta_pieces(spark: SparkSession, fasta: str) -> DataFrame:
    """at, text: the joined sequence of all records in file order, an N after each, by lines; letters other than A, C, G, T and N become N.

    Lines are numbered by file, by the start of their split in it and by their place within the split, however Spark packs splits into tasks; running sums go
    over lengths by blocks, so that no task sees all lines.
    """
    read = spark.read.text(fasta).select("_metadata.file_path", "_metadata.file_block_start", "value", F.monotonically_increasing_id().alias("line"))
    read = read.select("value", F.struct("file_path", "file_block_start", "line").alias("order"))
    rows = cut(numbered(read, "order", "number").select("number", F.trim("value").alias("line")))
    head = F.col("line").startswith(">")
    first = rows.where(head).agg(F.min("number").alias("n")).first().n
    # a record's N stands before the next record's header; the last one has its own line
    pieces = rows.select("number", F.when(head, F.when(F.col("number") > F.lit(first), F.lit("N")).otherwise(F.lit(""))).otherwise(F.regexp_replace("line", "[^ACGTNacgtn]", "N")).alias("text"))
    end = rows.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("number")).select("number", F.lit("N").alias("text"))
    sized = pieces.unionByName(end).withColumn("size", F.length("text"))
    return prefix_sum(sized.select("number", "size", "text"), "number", "size").select(F.col("before").alias("at"), "text").where("text <> ''")


def dot_to_gfa(spark: SparkSession, dot: str, fasta: str, k: int, skip_loops: bool = False) -> DataFrame:
    """Lines (value) of a GFA 1 file of a compressed de Bruijn graph.

    Nodes have labels with `position:length` pairs of the FASTA's joined sequence (see fasta_pieces), of which the last counts; without
    one, or if nothing is left, they are `N`.  Nodes are named by their number in the DOT file and one.  Nodes with incoming edges, loops too, lose their first k - 1 characters; repeated edges are one.  The sequence is cut into pieces of its
    lines, and a node's text is put together from those that it touches.
    """
    lines = spark.read.text(dot)
    nodes = lines.select(F.regexp_extract("value", r"^\s*(\w+)\s*\[", 1).alias("name"), F.regexp_extract("value", r'label\s*=\s*"([^"]*)"', 1).alias("label")).where("name <> '' and name not in ('node', 'edge', 'graph')")
    edges = lines.select(F.regexp_extract("value", r"^\s*(\w+)\s*->\s*(\w+)", 1).alias("a"), F.regexp_extract("value", r"^\s*(\w+)\s*->\s*(\w+)", 2).alias("b")).where("a <> ''").distinct()
    places = F.expr(r"regexp_extract_all(label, '(\\d+:\\d+)', 1)")
    last = F.split(F.try_element_at(places, F.lit(-1)), ":")
    entered = edges.select(F.col("b").alias("name"), F.lit(k - 1).alias("trim")).distinct()
    spans = nodes.groupBy("name").agg(F.max("label").alias("label")).select("name", last[0].cast("long").alias("begin"), last[1].cast("long").alias("n")).join(entered, "name", "left").withColumn("begin", F.col("begin") + F.coalesce("trim", F.lit(0))).withColumn("n", F.col("n") - F.coalesce("trim", F.lit(0)))
    pieces = fasta_pieces(spark, fasta)
    block = 4096
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor(b / block)))
    left = spans.where("n > 0").select("name", "begin", "n", cells(F.col("begin"), F.col("begin") + F.col("n") - 1).alias("cell"))
    right = pieces.where("text <> ''").select("at", "text", cells(F.col("at"), F.col("at") + F.length("text") - 1).alias("cell"))
    touched = left.join(right, "cell").where("at < begin + n and at + length(text) > begin").dropDuplicates(["name", "at"])
    part = F.expr("substring(text, cast(greatest(begin - at, 0) + 1 as int), cast(least(begin + n, at + length(text)) - greatest(begin, at) as int))")
    texts = touched.withColumn("part", part).groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "").alias("text"))
    one = lambda c: (F.col(c).cast("long") + 1).cast("string")
    if skip_loops:
        edges = edges.where("a <> b")
    out = spans.select("name").join(texts, "name", "left").select(F.concat_ws("\t", F.lit("S"), one("name"), F.coalesce("text", F.lit("N"))).alias("value"))
    return spark.createDataFrame([("H\tVN:Z:1.0",)], "value string").unionByName(out).unionByName(edges.select(F.concat_ws("\t", F.lit("L"), one("a"), F.lit("+"), one("b"), F.lit("+"), F.lit("0M")).alias("value")))
