"""Graphs and matrices that stand in the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspan.functions import ranges as R
from reachspan.functions.indexing import numbered
from reachspan.matrix import BoolMatrix
from reachspan.operators.graph import Graph
from reachspan.runtime import TASK_ROWS, cut, parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_matrix(spark: SparkSession, sf_dir: str) -> BoolMatrix:
    """Each event leads to the next event of its user and to the next of its type, by time and id."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    size = events.agg(F.coalesce(F.max("event_id") + 1, F.lit(0)).alias("n"), F.count("*").alias("events")).first()
    # there are few types, so that a window over one would be a task that grows with the events
    steps = following(events, "user_id").unionByName(following(events, "event_type", size.events))
    cells = steps.select(F.col("event_id").alias("row"), F.col("next").alias("col")).where("col is not null").distinct()
    return BoolMatrix(cut(cells), size.n, size.n, "basic", True, bound=2)


def following(events: DataFrame, by: str, rows: int = 0, most: int = TASK_ROWS) -> DataFrame:
    """event_id, next: the event that follows by time and id among those with the same value of a column, null where there is none.

    rows: how many events there are, for a column of few values; more than `most` are dealt to tasks by ranges of (value, time, id), and the last event of a range looks at the first one of the next.
    """
    if rows <= most:
        return events.select("event_id", F.lead("event_id").over(Window.partitionBy(by).orderBy("ts", "event_id")).alias("next"))
    order, place = [by, "ts", "event_id"], F.struct(by, "event_id")
    dealt = cut(events.select(*order).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    firsts = dealt.groupBy("_part").agg(F.min(F.struct(*order)).alias("first")).select("_part", F.struct(f"first.{by}", "first.event_id").alias("first"))
    after = firsts.select("_part", F.lead("first").over(Window.orderBy("_part")).alias("_after"))
    ranges = dealt.repartition(parts_for(events.sparkSession, rows), "_part")
    own = ranges.withColumn("_then", F.lead(place).over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(after), "_part")
    then = own.select("event_id", by, F.coalesce("_then", "_after").alias("_then"))
    return then.select("event_id", F.when(F.col(by).eqNullSafe(F.col(f"_then.{by}")), F.col("_then.event_id")).alias("next"))


def orders_parts(spark: SparkSession, sf_dir: str) -> BoolMatrix:
    """Which order holds which part."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("row"), F.col("l_partkey").cast("long").alias("col"))
    rows = lines.groupBy("row").agg(F.count("*").alias("lines"), F.max("col").alias("col"))
    size = rows.agg(F.coalesce(F.max("row") + 1, F.lit(0)).alias("n"), F.coalesce(F.max("col") + 1, F.lit(0)).alias("m"), F.coalesce(F.max("lines"), F.lit(0)).alias("most"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).first()
    if size.most > 1 << R.COLUMN_BITS:
        return BoolMatrix(lines.distinct(), size.n, size.m, "basic", bound=size.most)
    # dealt by row once: cells and intervals are made where the rows are
    dealt = lines.repartition(parts_for(spark, size.lines), "row")
    return BoolMatrix(dealt.distinct(), size.n, size.m, "basic", bound=size.most, ranges=R.to_ranges(dealt, size.most, dealt=True))


def transposed(m: BoolMatrix) -> BoolMatrix:
    basic = m.to_basic()
    most = None if m.nrows <= 1 << R.COLUMN_BITS else basic.df.groupBy("col").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first().n
    return BoolMatrix(basic.df.select(F.col("col").alias("row"), F.col("row").alias("col")), m.ncols, m.nrows, "basic", bound=most)


def conversations_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns are nodes as long as their words, in the order of conversation and turn; each leads to the next; conversations are paths."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).cast("long").alias("len"))
    placed = numbered(turns.withColumn("_order", F.struct("conv_id", "turn")), "_order", "rank")
    nodes = cut(placed.select("rank", F.col("rank").alias("id"), F.concat_ws("/", "conv_id", "turn").alias("name"), "len", "conv_id", "turn"))
    following = F.lead("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    edges = nodes.select(F.col("id").alias("src"), following.alias("dst")).where("dst is not null")
    paths = nodes.select(F.col("conv_id").cast("string").alias("name"), F.col("turn").cast("int").alias("pos"), F.col("id").alias("node"))
    return Graph(nodes.select("rank", "id", "name", "len"), edges, paths)


def events_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Events as nodes of one locus, ranked by type and id, and the steps of `events_matrix`: a branching graph without cycles whose ranks do not follow its edges."""
    m = events_matrix(spark, sf_dir)
    events = table(spark, sf_dir, "events").select((F.col("event_id") + 1).cast("long").alias("id"), "event_type")
    placed = numbered(events.withColumn("_order", F.struct("event_type", "id")), "_order", "rank")
    nodes = cut(placed.select("rank", "id", F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("len")))
    return Graph(nodes, m.df.select((F.col("row") + 1).alias("src"), (F.col("col") + 1).alias("dst")))


def orders_row(spark: SparkSession, sf_dir: str) -> BoolMatrix:
    """One row with an interval for each order, from ten times its key, by its customer up to eight columns long; and a second row without any."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10).cast("long").alias("lo"), (F.col("o_custkey") % 8).alias("more"))
    n = orders.agg(F.coalesce(F.max("lo") + 10, F.lit(0)).alias("n")).first().n
    return BoolMatrix(orders.select(F.lit(0).alias("row"), "lo", (F.col("lo") + F.col("more")).alias("hi")), 2, n, "ranges")
