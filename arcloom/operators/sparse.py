"""Sparse kernels: compressed layouts, moves between vertices and edges, sampled layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.portable import norm
from arcloom.operators.edges import degree
from arcloom.operators.propagate import sum_vectors, zeros


def offsets(counts: DataFrame, salt: int = 64) -> DataFrame:
    """id, start: for each id the sum of `deg` of smaller ids. Ranges of ids are summed first, then added up."""
    width = counts.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    cut = counts.crossJoin(F.broadcast(width)).withColumn("part", F.floor((F.col("id") - F.col("lo")) * salt / (F.col("hi") - F.col("lo") + 1)))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("part").agg(F.sum("deg").alias("s")).select("part", F.coalesce(F.sum("s").over(up_to(Window.orderBy("part"))), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("deg").over(up_to(Window.partitionBy("part").orderBy("id"))), F.lit(0))
    return cut.withColumn("inner", inner).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("inner")).alias("start"))


def compressed(edges: DataFrame, nodes: DataFrame, key: str, other: str) -> DataFrame:
    """id, place, other, w: each edge's place in the index sorted by `key`. Nodes without edges have an empty range."""
    start = offsets(degree(edges, nodes, key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(other)) - 1
    ranked = edges.withColumn("r", rank)
    return ranked.join(start, ranked[key] == start["id"]).select("id", (F.col("start") + F.col("r")).cast("long").alias("place"), F.col(other).alias("other"), "w")


def layer_csr(edges: DataFrame, dst: DataFrame, src: DataFrame) -> DataFrame:
    """A sampled layer regrouped by source; sources outside the list are dropped."""
    own = edges.join(dst.select(F.col("id").alias("dst")), "dst", "left_semi").join(src.select(F.col("id").alias("src")), "src", "left_semi")
    return own.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("place"))


def softmax_gradient(scored: DataFrame, y: str, g: str, by: str = "dst") -> DataFrame:
    """y * g - y * the destination's sum of y * g."""
    total = scored.groupBy(by).agg(F.sum(F.col(y) * F.col(g)).alias("_t"))
    return scored.join(total, by).withColumn("grad", F.col(y) * F.col(g) - F.col(y) * F.col("_t")).drop("_t")


def to_edges(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """src, dst, x of one end."""
    return edges.select("src", "dst").join(nodes.select(F.col("id").alias(end), "x"), end).select("src", "dst", "x")


def to_vertices(edges: DataFrame, nodes: DataFrame, width: int, end: str = "dst") -> DataFrame:
    """id, x: the sum of edge vectors at one end; zeros without edges."""
    total = edges.groupBy(F.col(end).alias("id")).agg(sum_vectors("x", width).alias("x"))
    return nodes.select("id").join(total, "id", "left").select("id", F.coalesce("x", zeros(width)).alias("x"))


def neighbours(edges: DataFrame, listed: DataFrame, own: str, other: str) -> DataFrame:
    """id, neighbour: with multiplicity; an id that is listed twice repeats."""
    return listed.select("id").join(edges, F.col("id") == F.col(own)).select("id", F.col(other).alias("neighbour"))


def layer_weights(layer: DataFrame) -> DataFrame:
    """1 / (sqrt(out degree of src) * sqrt(in degree of dst)) inside the layer."""
    out = layer.groupBy("src").agg(F.count("*").alias("o"))
    into = layer.groupBy("dst").agg(F.count("*").alias("i"))
    return layer.join(out, "src").join(into, "dst").select("src", "dst", (1 / (F.sqrt("o") * F.sqrt("i"))).alias("weight"))


def repeat_interleave(df: DataFrame, times: str) -> DataFrame:
    return df.where(F.col(times) > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))


def linear_attention(nodes: DataFrame, width: int) -> DataFrame:
    """(q K^T V + N v) / (q sum(k) + N) with q = k = x over its Frobenius norm and v = x: two small global sums."""
    size = nodes.agg(F.sqrt(F.sum(norm(F.col("x")) * norm(F.col("x")))).alias("z"), F.count("*").cast("double").alias("cnt"))
    k = nodes.crossJoin(F.broadcast(size)).select("id", "x", F.transform("x", lambda v: v / F.col("z")).alias("k"), "cnt")
    sums = k.agg(*[F.sum(F.get("k", i) * F.get("x", j)).alias(f"s{i}_{j}") for i in range(width) for j in range(width)], *[F.sum(F.get("k", i)).alias(f"t{i}") for i in range(width)])
    j = k.crossJoin(F.broadcast(sums))
    below = sum((F.get("k", i) * F.col(f"t{i}") for i in range(width)), F.lit(0.0)) + F.col("cnt")
    return j.select("id", F.array(*[(sum((F.get("k", i) * F.col(f"s{i}_{o}") for i in range(width)), F.lit(0.0)) + F.col("cnt") * F.get("x", o)) / below for o in range(width)]).alias("x"))
