"""Algebra on edge tables (src, dst, w). Multiplicity is kept unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.durable import durable

REDUCERS = {"sum": F.sum, "add": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "mul": F.product}


def coalesce(edges: DataFrame, reduce: str = "sum") -> DataFrame:
    """Each (src, dst) once, its weights reduced."""
    return edges.groupBy("src", "dst").agg(REDUCERS[reduce]("w").alias("w"))


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def to_undirected(edges: DataFrame, reduce: str = "add") -> DataFrame:
    """Both directions of each edge; equal pairs are reduced.

    Pairs are brought together under their smaller end first, and each is turned round after that, so that no pair is held
    or shuffled twice. A loop is its own other direction and counts twice.
    """
    first = F.coalesce(F.col("src") <= F.col("dst"), F.col("src").isNull())
    pairs = edges.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"), "w", F.col("src").eqNullSafe(F.col("dst")).alias("_loop"))
    twice = pairs.select("src", "dst", F.explode(F.when(F.col("_loop"), F.array("w", "w")).otherwise(F.array("w"))).alias("w"))
    ways = F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return coalesce(twice, reduce).select(ways.alias("_e"), "w").select(F.inline("_e"), "w")


def to_undirected_first(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, one row a pair: the least weight, as which survives is not said."""
    return to_undirected(edges, "min")


def sort_edges(edges: DataFrame, by_row: bool = True) -> DataFrame:
    """A global order; a range partitioning, not one task."""
    return edges.orderBy(*(("src", "dst") if by_row else ("dst", "src")))


def contains_self_loops(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.bool_or(F.col("src") == F.col("dst")), F.lit(False)).alias("found"))


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def segregate_self_loops(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return edges.where("src <> dst"), edges.where("src = dst")


def add_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """A loop for every node, whether it has one or not."""
    return edges.select("src", "dst", "w").unionAll(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(fill).alias("w")))


def add_remaining_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """One loop for every node: its own of the largest weight, or the fill."""
    loops = edges.where("src = dst").groupBy("src").agg(F.max("w").alias("own"))
    every = nodes.select("id").join(loops, F.col("id") == F.col("src"), "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.coalesce("own", F.lit(fill)).alias("w"))
    return edges.where("src <> dst").select("src", "dst", "w").unionAll(every)


def endpoints(edges: DataFrame) -> DataFrame:
    """Nodes that some edge other than a loop touches."""
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


def isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("id").join(endpoints(edges), "id", "left_anti")


def relabel(ids: DataFrame, column: str = "id", salt: int = 64) -> DataFrame:
    """id and its rank from 0, in ascending order. Ranks are counted in ranges of ids, then the ranges' sizes are
    added up: no task sees all ids."""
    width = ids.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    cut = ids.crossJoin(F.broadcast(width)).withColumn("part", F.floor((F.col(column) - F.col("lo")) * salt / (F.col("hi") - F.col("lo") + 1)))
    before = cut.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return cut.withColumn("r", rank).join(F.broadcast(before), "part").select(F.col(column).alias("id"), (F.col("r") + F.col("before")).cast("long").alias("new_id"))


def ranked_by_count(counts: DataFrame, salt: int = 64) -> DataFrame:
    """symbol, cnt, rank: from 0, the most frequent first, then by symbol. Counted as in relabel(), in ranges of the
    symbols of each count."""
    width = counts.agg(F.min("symbol").alias("lo"), F.max("symbol").alias("hi"))
    cut = counts.crossJoin(F.broadcast(width)).withColumn("part", F.floor((F.col("symbol") - F.col("lo")) * salt / (F.col("hi") - F.col("lo") + 1)))
    before = cut.groupBy("cnt", "part").count().select("cnt", "part", F.coalesce(F.sum("count").over(Window.orderBy(F.desc("cnt"), "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("cnt", "part").orderBy("symbol")) - 1
    return cut.withColumn("r", rank).join(before, ["cnt", "part"]).select("symbol", "cnt", (F.col("r") + F.col("before")).cast("long").alias("rank"))


def remap(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose both ends have a new label, under it."""
    s, d = labels.select(F.col("id").alias("src"), F.col("new_id").alias("s")), labels.select(F.col("id").alias("dst"), F.col("new_id").alias("d"))
    return edges.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def remove_isolated(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relabelled edges (loops of the others' nodes stay), and the labels."""
    labels = relabel(endpoints(edges))
    return remap(edges, labels), labels


def induced(edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges inside a set of nodes, relabelled, and the labels."""
    labels = relabel(chosen.select("id").distinct())
    return remap(edges, labels), labels


def degree(edges: DataFrame, nodes: DataFrame, by: str = "dst", weight: Column | None = None) -> DataFrame:
    """id, deg of every node, 0 without edges."""
    d = edges.groupBy(F.col(by).alias("id")).agg(F.sum(weight if weight is not None else F.lit(1)).alias("deg"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))


def inverse_power(deg: Column, power: float) -> Column:
    """deg ** power, 0 where the degree is 0."""
    return F.when(deg > 0, F.pow(deg, F.lit(power))).otherwise(F.lit(0.0))


def laplacian(edges: DataFrame, nodes: DataFrame, normalization: str | None = None) -> DataFrame:
    """None: D - A. sym: I - D^-1/2 A D^-1/2. rw: I - D^-1 A. Degrees are of sources; loops are left out."""
    e = remove_self_loops(edges)
    deg = degree(e, nodes, "src", F.col("w"))
    if normalization is None:
        return e.select("src", "dst", (-F.col("w")).alias("w")).unionAll(deg.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("deg").cast("double").alias("w")))
    ones = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    s = deg.select(F.col("id").alias("src"), F.col("deg").alias("ds"))
    if normalization == "rw":
        return e.join(s, "src").select("src", "dst", (-F.col("w") * inverse_power(F.col("ds"), -1.0)).alias("w")).unionAll(ones)
    d = deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd"))
    scaled = e.join(s, "src").join(d, "dst")
    return scaled.select("src", "dst", (-inverse_power(F.col("ds"), -0.5) * F.col("w") * inverse_power(F.col("dd"), -0.5)).alias("w")).unionAll(ones)


def num_nodes(edges: DataFrame) -> DataFrame:
    return edges.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("num_nodes"))


def one_way(edges: DataFrame, upper: bool = True) -> DataFrame:
    """For an undirected export: the edges with src <= dst (or >=), each pair once."""
    return edges.where("src <= dst" if upper else "src >= dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def index_to_mask(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    return nodes.select("id").join(chosen.select("id").distinct().withColumn("mask", F.lit(True)), "id", "left").select("id", F.coalesce("mask", F.lit(False)).alias("mask"))


def one_hot(df: DataFrame, column: str, classes: int) -> DataFrame:
    return df.withColumn("one_hot", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == F.col(column)).cast("int")))


def row_normalised(x: Column, floor: float | None = None) -> Column:
    """x over its sum: 0 where that is 0, or over at least `floor`."""
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    if floor is not None:
        return F.transform(x, lambda v: v / F.greatest(total, F.lit(floor)))
    return F.transform(x, lambda v: F.when(total == 0, F.lit(0.0)).otherwise(v / total))


def quantile_labels(df: DataFrame, column: str, classes: int) -> DataFrame:
    """The number of quantiles k/classes that a value reaches; linear interpolation, ties share a class."""
    q = df.agg(F.percentile(column, F.array(*[F.lit(k / classes) for k in range(1, classes)])).alias("q"))
    return df.crossJoin(F.broadcast(q)).withColumn("label", F.size(F.filter("q", lambda b: F.col(column) >= b))).drop("q")


def encoded(df: DataFrame, column: str) -> DataFrame:
    """Codes from 0 in the order of the distinct values.

    Values are dealt out in ranges, which a checkpoint makes lasting; ranks are counted inside them, and the ranges'
    sizes added up.
    """
    values = durable(df.select(F.col(column).alias("value")).distinct().repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    before = values.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1)
    codes = ranked.join(F.broadcast(before), "part").select("value", (F.col("r") + F.col("before")).cast("long").alias("code"))
    return df.join(codes, F.col(column) == F.col("value")).drop("value")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("std", F.stddev_pop))])
    z = df.crossJoin(F.broadcast(stats))
    return z.select(*df.columns, *[F.when(F.col(f"std_{c}") > 0, (F.col(c) - F.col(f"avg_{c}")) / F.col(f"std_{c}")).otherwise(F.lit(0.0)).alias(f"z_{c}") for c in columns])


def chebyshev(order: int, x: Column) -> Column:
    """T_order(x) by its recurrence."""
    before, now = F.lit(1.0), x
    if order == 0:
        return before
    for _ in range(order - 1):
        before, now = now, 2 * x * now - before
    return now
