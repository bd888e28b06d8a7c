"""Global numbering and successors without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

#: Rows that a task should sort, join or group at most.
PART_ROWS = 500_000


def parts_for(df: DataFrame, rows: int) -> int:
    """So many parts that each has PART_ROWS rows or fewer, and at least as many as the session sets."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def numbered(df: DataFrame, order: list[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """df with name: each row's rank from 0 by order. parts: how many ranges to sort, if not as many as the session sets.

    Rows are sorted by range once and written to the shared folder; a row's rank is its place in
    its part plus the rows in the parts before, which takes one count per part. Equal keys are
    ranked in some order.
    """
    sorted_ = df.orderBy(*order) if parts is None else df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = cut(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))  # one row a part
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(before), "_part").withColumn(name, rank.cast("long")).drop("_at", "_part", "_before")


def successor(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with name: value of the row that follows by order, null after the last.

    Rows are sorted by sampled ranges, so a window holds one range, and only one row per range meets
    the others. Ties in order are broken in some way.
    """
    kept = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    heads = kept.groupBy("_part").agg(F.min_by(F.struct(F.col(value).alias("v")), "_at").alias("h"))
    heads = heads.select("_part", F.lead("h.v").over(Window.orderBy("_part")).alias("_next"))  # one row a part
    w = Window.partitionBy("_part").orderBy("_at")
    rows = kept.withColumns({"_in": F.lead(F.struct(F.col(value).alias("v"))).over(w)})
    return rows.join(F.broadcast(heads), "_part").withColumn(name, F.when(F.col("_in").isNull(), F.col("_next")).otherwise(F.col("_in.v"))).drop("_part", "_at", "_in", "_next")
