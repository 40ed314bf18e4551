"""Many graphs as one, batches of rows, partitions of one graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.operators.sparse import offsets


def disjoint_union(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (gid, local) and edges (gid, src, dst) under ids that count on from graph to graph; and the offsets."""
    sizes = nodes.groupBy(F.col("gid").alias("id")).agg(F.count("*").alias("deg"))
    start = offsets(sizes).select(F.col("id").alias("gid"), "start")
    n = nodes.join(start, "gid").select("gid", (F.col("local") + F.col("start")).alias("id"), "local")
    e = edges.join(start, "gid").select("gid", (F.col("src") + F.col("start")).alias("src"), (F.col("dst") + F.col("start")).alias("dst"))
    return n, e, start


def unbatched(edges: DataFrame, start: DataFrame, gid: int | None = None) -> DataFrame:
    """Each graph's edges, or those of one graph, under its own ids."""
    if gid is not None:
        edges, start = edges.where(F.col("gid") == gid), start.where(F.col("gid") == gid)
    return edges.join(start, "gid").select("gid", (F.col("src") - F.col("start")).alias("src"), (F.col("dst") - F.col("start")).alias("dst"))


def inside_parts(edges: DataFrame, part: Column | None = None, parts: DataFrame | None = None) -> DataFrame:
    """Edges whose ends lie in one part; parts are (id, part)."""
    s, d = parts.select(F.col("id").alias("src"), F.col("part").alias("ps")), parts.select(F.col("id").alias("dst"), F.col("part").alias("pd"))
    return edges.join(s, "src").join(d, "dst")


def renumbered(parts: DataFrame) -> DataFrame:
    """id, part, local: numbers from 0 inside each part, in the order of ids."""
    return parts.select("id", "part", (F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).cast("long").alias("local"))


def merged_parts(edges: DataFrame, parts: DataFrame, batches: int, seed: int) -> DataFrame:
    """batch, src_id, dst_id, src, dst, w: small parts go to batches by a draw; the edges inside each batch, under its
    nodes' own ids and under numbers from 0 inside it."""
    from arcloom.functions.portable import draw

    lo = renumbered(parts.select("id", (draw(F.col("part"), 3, seed) % batches).alias("part")))
    s = lo.select(F.col("id").alias("src"), F.col("part").alias("batch"), F.col("local").alias("s"))
    d = lo.select(F.col("id").alias("dst"), F.col("part").alias("_b"), F.col("local").alias("d"))
    return edges.join(s, "src").join(d, "dst").where("batch = _b").select("batch", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def label_propagation_parts(edges: DataFrame, nodes: DataFrame, parts: int, rounds: int = 3) -> DataFrame:
    """id, part: nodes take the part that most neighbours have, from a hashed start; sizes are evened by a hash."""
    from arcloom.functions.durable import durable
    from arcloom.functions.portable import draw

    both = edges.where("src <> dst").select("src", "dst").unionAll(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    state = nodes.select("id", (draw(F.col("id"), 0, 11) % parts).alias("part"))
    for _ in range(rounds):
        votes = both.join(state.select(F.col("id").alias("dst"), "part"), "dst").groupBy("src", "part").agg(F.count("*").alias("n"))
        sizes = state.groupBy("part").agg(F.count("*").alias("size"))
        best = votes.join(F.broadcast(sizes), "part").groupBy("src").agg(F.max_by("part", F.struct((F.col("n") / F.col("size")).alias("s"), (-F.col("part")).alias("p"))).alias("new"))
        state = durable(state.join(best, F.col("id") == F.col("src"), "left").select("id", F.coalesce("new", "part").alias("part")))
    return state


def shortest_paths(edges: DataFrame, cost: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """gid, s, t, dist, parent, c: breadth first from every node of every graph, until nothing new is met.

    Of several nodes before a target the smallest is the parent; c adds cost(parent, node) up along the parents (0
    without a cost). Each graph is a map of neighbours on one row, so the search is an expression over that row and needs
    no join for a step: made for many small graphs (molecules, orders). Memory grows with one graph, not with their number.
    """
    to = edges.groupBy("gid", "src").agg(F.collect_set("dst").alias("to"))
    graph = to.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("src", "to"))).alias("near"), F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("src"), "to")))).alias("nodes"))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731  use(value), worked out once
    step_cost = lambda a, b: (cost(a, b) if cost else F.lit(0.0)).cast("double")
    seen = lambda t, dist, parent, c: F.struct(t.alias("t"), dist.cast("int").alias("dist"), parent.cast("long").alias("parent"), c.alias("c"))

    def reached(acc: Column) -> Column:
        """t, parent, c of each neighbour of the last nodes, the smallest parent first."""
        none = F.array().cast("array<bigint>")
        out = lambda f: F.transform(F.coalesce(F.try_element_at("near", f["t"]), none), lambda t: F.struct(t.alias("t"), f["t"].alias("parent"), (f["c"] + step_cost(f["t"], t)).alias("c")))
        return F.array_sort(F.flatten(F.transform(acc["front"], out)))

    def step(acc: Column, d: Column) -> Column:
        fresh = lambda found: F.filter(found, lambda x, i: ((i == 0) | (F.get(found, i - 1)["t"] != x["t"])) & ~F.exists(acc["seen"], lambda y: y["t"] == x["t"]))
        grown = lambda new: F.struct(F.concat(acc["seen"], F.transform(new, lambda x: seen(x["t"], d, x["parent"], x["c"]))).alias("seen"), F.transform(new, lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c"))).alias("front"))
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(bound(bound(reached(acc), fresh), grown))

    zero = F.lit(0.0)
    begin = F.struct(F.array(seen(F.col("s"), F.lit(0), F.lit(None), zero)).alias("seen"), F.array(F.struct(F.col("s").alias("t"), zero.alias("c"))).alias("front"))
    whole = graph.select("gid", "near", F.size("nodes").alias("size"), F.explode("nodes").alias("s"))
    return whole.select("gid", "s", F.inline(F.aggregate(F.sequence(F.lit(1), F.col("size")), begin, step, lambda acc: acc["seen"])))
