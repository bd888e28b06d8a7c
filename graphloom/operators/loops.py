"""Loops over a graph that users fill in: pregel rounds, worklists, and reductions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.plans.session import cut


class NotSettled(RuntimeError):
    """A loop used up its rounds before its end."""


def do_all(g: PropertyGraph, **values: Column) -> PropertyGraph:
    """The graph with node properties computed from the others, every node by itself."""
    return PropertyGraph(g.nodes.withColumns(values), g.edges)


def pregel(
    g: PropertyGraph,
    init: dict[str, Column],
    message: Column,
    combine: Callable[[Column], Column],
    update: dict[str, Column],
    symmetric: bool | None = None,
    active: Column | None = None,
    max_rounds: int = 10_000,
    fixed_rounds: int | None = None,
) -> DataFrame:
    """id and the state columns after rounds of messages.

    init: state columns over the nodes' columns. A round sends message along every edge whose source
    is active (at first all nodes, or those where active holds). A message is a column over the
    edge's properties and the source's state, read as src_<column>; a null one isn't sent.
    combine aggregates what a node gets, as a partial aggregate before the shuffle, into a column
    named message; update computes new state from the state and message (null for none). Nodes whose
    state changed are active in the next round; it ends when none are. With fixed_rounds, all nodes
    send in exactly so many rounds. symmetric None follows the edges; False walks edges both ways;
    True says that the graph has both already.

    Edges are laid out by their source once, so a round shuffles states and combined messages only.
    """
    names = list(init)
    edges = g.edges.select("src", "dst", *g.edge_properties()) if symmetric is None else g.neighbours(symmetric, *g.edge_properties())
    edges = cut(edges.repartition("src"))
    start = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    state = g.nodes.withColumns({f"_{n}": c for n, c in init.items()}).select("id", *[F.col(f"_{n}").alias(n) for n in names])
    state = cut(state.withColumn("_active", start))
    for _ in range(max_rounds if fixed_rounds is None else fixed_rounds):
        senders = state if fixed_rounds is not None else state.where("_active")
        senders = senders.select(F.col("id").alias("src"), *[F.col(n).alias(f"src_{n}") for n in names])
        sent = edges.join(senders, "src").select(F.col("dst").alias("id"), message.alias("_sent")).where("_sent is not null")
        got = sent.groupBy("id").agg(combine(F.col("_sent")).alias("message"))
        new = state.join(got, "id", "left").withColumns({f"_{n}": c for n, c in update.items()})
        new = new.select("id", *[F.col(f"_{n}" if n in update else n).alias(n) for n in names], *[F.col(n).alias(f"_old_{n}") for n in names])
        changed = F.lit(False)
        for n in names:
            changed = changed | ~F.col(n).eqNullSafe(F.col(f"_old_{n}"))
        state = cut(new.select("id", *names, changed.alias("_active")))
        if fixed_rounds is None and not state.where("_active").take(1):
            break
    else:
        if fixed_rounds is None:
            raise NotSettled("pregel rounds are used up")
    return state.select("id", *names)


def for_each(start: DataFrame, body: Callable[[DataFrame, DataFrame], DataFrame], key: list[str], priority: str | None = None, width: float = 1.0, max_rounds: int = 10_000) -> DataFrame:
    """All items that a worklist met: body(items, done) gives the items that follow from a batch; those met before are dropped.

    With priority, a batch holds only the items of the least bucket of that column, width wide, so
    items come in about that order; else a batch is all that is open.
    """
    done = cut(start.limit(0))
    open_ = cut(start.dropDuplicates(key))
    for _ in range(max_rounds):
        if open_.isEmpty():
            return done
        batch, rest = open_, None
        if priority is not None:
            bucket = F.floor(F.col(priority) / width)
            least = open_.agg(F.min(bucket)).first()[0]  # one number
            batch, rest = open_.where(bucket == least), open_.where(bucket != least)
        done = cut(done.unionByName(batch))
        more = body(batch, done).select(*start.columns)
        more = more if rest is None else rest.unionByName(more)
        if priority is not None:
            more = more.groupBy(*key).agg(F.min_by(F.struct(*start.columns), priority).alias("_r")).select("_r.*")
        open_ = cut(more.dropDuplicates(key).join(done, key, "left_anti").select(*start.columns))
    raise NotSettled("worklist rounds are used up")


def reduce_nodes(g: PropertyGraph, **aggregates: Column) -> DataFrame:
    """One row of aggregates over the nodes."""
    return g.nodes.agg(*[c.alias(n) for n, c in aggregates.items()])
