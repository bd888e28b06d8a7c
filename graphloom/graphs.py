"""Property graphs over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .plans.ordering import parts_for, successor
from .plans.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def _of(edges: DataFrame, bounded: bool = False) -> PropertyGraph:
    """bounded: sort by as many ranges as there are rows for."""
    e = cut(edges)
    return PropertyGraph.of(e, _ends(e), parts_for(e, e.count()) if bounded else None)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w: the user of each event and that of the next one, by time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", (F.abs(F.floor(F.col("value") * 100)) + 1).cast("long").alias("w"))
    e = successor(e, ["ts", "event_id"], "user_id", "dst")
    return e.where("dst is not null").select(F.col("user_id").alias("src"), "dst", "w")


def user_next(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Distinct transitions, the least weight of each."""
    return _of(transitions(spark, sf_dir).groupBy("src", "dst").agg(F.min("w").alias("w")))


def user_next_multi(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """All transitions, parallel edges included."""
    return _of(transitions(spark, sf_dir))


def copart(spark: SparkSession, sf_dir: str, least: int = 1) -> PropertyGraph:
    """Pairs of parts (src < dst) that share at least so many orders; w: how many."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = parts_for(lines, lines.count())
    # Each exchange has as many parts as rows ask for, whatever the session sets, so a task's maps and sorts keep their size.
    # Lines are laid out by order once, for the distinct, the sizes and the pairs.
    p = lines.repartition(parts, "l_orderkey").distinct()
    n = F.count("*")
    most = p.groupBy("l_orderkey").agg((n * (n - 1) / 2).alias("n")).agg(F.sum("n")).first()[0]
    pairs = p.withColumnRenamed("l_partkey", "src").join(p.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("src < dst")
    pairs = pairs.select("src", "dst").repartition(parts_for(lines, int(most or 0)), "src", "dst")
    return _of(pairs.groupBy("src", "dst").agg(F.count("*").alias("w")).where(F.col("w") >= least), bounded=True)


def part_supplier(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts and the suppliers that sent them; supplier s is node -s - 1."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).agg(F.count("*").alias("w"))
    return _of(e)


def customer_supplier(spark: SparkSession, sf_dir: str, least: int = 1) -> PropertyGraph:
    """Customers and suppliers -s - 1 that share at least so many order lines; w: how many."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    e = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).agg(F.count("*").alias("w"))
    return _of(e.where(F.col("w") >= least))


#: Where the nodes of each table start in the foreign-key graph; keys keep their distance.
OFFSET = {"region": 0, "nation": 1_000, "customer": 1_000_000_000, "supplier": 2_000_000_000}


def geography(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Typed foreign-key graph: region -> nation -> customer and supplier; customers with a balance below 0 are Debtors, too."""
    r, n, c, s = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    at = lambda col, t: (F.col(col).cast("long") + OFFSET[t])
    label = lambda *x: F.array_sort(F.array_compact(F.array(*x)))
    nodes = r.select(at("r_regionkey", "region").alias("id"), label(F.lit("Place"), F.lit("Region")).alias("types"), F.col("r_name").alias("name"), F.lit(None).cast("double").alias("balance"))
    nodes = nodes.unionAll(n.select(at("n_nationkey", "nation"), label(F.lit("Place"), F.lit("Nation")), "n_name", F.lit(None).cast("double")))
    nodes = nodes.unionAll(c.select(at("c_custkey", "customer"), label(F.lit("Customer"), F.when(F.col("c_acctbal") < 0, F.lit("Debtor"))), "c_name", "c_acctbal"))
    nodes = nodes.unionAll(s.select(at("s_suppkey", "supplier"), label(F.lit("Supplier")), "s_name", "s_acctbal"))
    e = n.select(at("n_regionkey", "region").alias("src"), at("n_nationkey", "nation").alias("dst"), label(F.lit("HAS_NATION")).alias("types"))
    e = e.unionAll(c.select(at("c_nationkey", "nation"), at("c_custkey", "customer"), label(F.lit("HAS_MEMBER"), F.lit("HAS_CUSTOMER"))))
    e = e.unionAll(s.select(at("s_nationkey", "nation"), at("s_suppkey", "supplier"), label(F.lit("HAS_MEMBER"), F.lit("HAS_SUPPLIER"))))
    return PropertyGraph.of(e, nodes)
