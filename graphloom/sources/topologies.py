"""Symmetric graphs of closed form, for tests and examples."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.graph import PropertyGraph


def _of(spark: SparkSession, n: int, pairs: list[tuple[int, int]]) -> PropertyGraph:
    both = sorted({p for a, b in pairs for p in ((a, b), (b, a))})
    return PropertyGraph.of(spark.createDataFrame(both, "src long, dst long"), spark.range(n).select("id"))


def grid(spark: SparkSession, width: int, height: int, diagonals: bool = True) -> PropertyGraph:
    at = lambda x, y: y * width + x
    e = [(at(x, y), at(x + 1, y)) for y in range(height) for x in range(width - 1)]
    e += [(at(x, y), at(x, y + 1)) for y in range(height - 1) for x in range(width)]
    if diagonals:
        e += [p for y in range(height - 1) for x in range(width - 1) for p in ((at(x, y), at(x + 1, y + 1)), (at(x + 1, y), at(x, y + 1)))]
    return _of(spark, width * height, e)


def wheel(spark: SparkSession, n: int) -> PropertyGraph:
    """A hub and a rim of n - 1 nodes."""
    rim = [(i, i % (n - 1) + 1) for i in range(1, n)]
    return _of(spark, n, [(0, i) for i in range(1, n)] + rim)


def sawtooth(spark: SparkSession, n: int) -> PropertyGraph:
    """A line of n + 1 nodes with a tooth over each of its edges."""
    e = [(i, i + 1) for i in range(n)] + [p for i in range(n) for p in ((i, n + 1 + i), (i + 1, n + 1 + i))]
    return _of(spark, 2 * n + 1, e)


def clique(spark: SparkSession, n: int) -> PropertyGraph:
    return _of(spark, n, [(a, b) for a in range(n) for b in range(a)])


def triangle(spark: SparkSession, rows: int) -> PropertyGraph:
    """A triangular array of rows rows of small triangles."""
    at = lambda r, c: r * (r + 1) // 2 + c
    e = [p for r in range(rows) for c in range(r + 1) for p in ((at(r, c), at(r + 1, c)), (at(r, c), at(r + 1, c + 1)), (at(r + 1, c), at(r + 1, c + 1)))]
    return _of(spark, at(rows + 1, 0), e)
