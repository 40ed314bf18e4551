"""Scatter, segment and pooling aggregates. Groups without rows get the neutral value: a left join from all groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NEUTRAL = {"sum": 0.0, "mean": 0.0, "min": 0.0, "max": 0.0, "mul": 1.0}
_AGG = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "mul": F.product}
_SAME = {"add": "sum", "avg": "mean"}


def scatter(df: DataFrame, groups: DataFrame, index: str, value: str, reduce: str = "sum") -> DataFrame:
    """id, value of every row of `groups` (id)."""
    how = _SAME.get(reduce, reduce)
    out = df.groupBy(F.col(index).alias("id")).agg(_AGG[how](value).alias("value"))
    return groups.select("id").join(out, "id", "left").select("id", F.coalesce("value", F.lit(_NEUTRAL[how])).alias("value"))


def segment(df: DataFrame, ptr: DataFrame, place: str, value: str, reduce: str = "sum") -> DataFrame:
    """Segments [start, end) of places, as ptr (id, start, end).

    A range join by blocks: a segment is listed once for each block of places it touches, so that the join is on
    equality and its size stays that of the rows.
    """
    block = 1024
    listed = ptr.where("start < end").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    rows = df.withColumn("b", F.floor(F.col(place) / block))
    hit = rows.join(listed, "b").where((F.col(place) >= F.col("start")) & (F.col(place) < F.col("end")))
    return scatter(hit, ptr, "id", value, reduce)


def to_dense(df: DataFrame, group: str, order: str, value: str, width: int, fill: float = 0.0) -> DataFrame:
    """Each group's values in order, padded or cut to `width`. The cut comes first, so a group's list stays short."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= width)
    lists = ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda s: s["v"]).alias("x"))
    return lists.select(F.col(group).alias("id"), F.concat("x", F.array_repeat(F.lit(fill), F.lit(width) - F.size("x"))).alias("x"))


def multi(df: DataFrame, group: str, value: str) -> DataFrame:
    """Several aggregates of one pass, to be put side by side. std and var divide by n."""
    v = F.col(value)
    top = F.max(v)
    return df.groupBy(F.col(group).alias("id")).agg(F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"), F.log(F.sum(F.exp(v))).alias("logsumexp"), top.alias("top")).drop("top")


def group_softmax(df: DataFrame, group: str, value: str, log: bool = False) -> DataFrame:
    """The softmax of a value in its group; two small aggregates joined back."""
    top = df.groupBy(group).agg(F.max(value).alias("_m"))
    j = df.join(top, group).withColumn("_e", F.exp(F.col(value) - F.col("_m")))
    total = j.groupBy(group).agg(F.sum("_e").alias("_s"))
    j = j.join(total, group)
    return j.withColumn("softmax", F.log(F.col("_e") / F.col("_s")) if log else F.col("_e") / F.col("_s")).drop("_m", "_e", "_s")


def argmax(df: DataFrame, group: str, row: str, value: str) -> DataFrame:
    """id, value, row of the group's largest value; the earliest row on a tie."""
    best = df.groupBy(F.col(group).alias("id")).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(row)).alias("r"))).alias("b"))
    return best.select("id", F.col("b")["v"].alias("value"), (-F.col("b")["r"]).alias("row"))


def unique_consecutive(df: DataFrame, lane: str, order: list[str | Column], value: str) -> DataFrame:
    """lane, run, value, n: runs of equal values along each lane's order."""
    w = Window.partitionBy(lane).orderBy(*order)
    flagged = df.withColumn("_new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1)))
    runs = flagged.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(lane, "run").agg(F.first(value).alias("value"), F.count("*").alias("n"))


def latest(df: DataFrame, group: str, time: str, row: str, message: str) -> DataFrame:
    """id, message of the latest row of each group; of equal times the smallest row."""
    return df.groupBy(F.col(group).alias("id")).agg(F.max_by(message, F.struct(F.col(time), (-F.col(row)).alias("r"))).alias("message"))


def graph_norm(df: DataFrame, group: str, columns: list[str], eps: float = 1e-5) -> DataFrame:
    """(x - mean) / sqrt(var + eps) over all channels of a graph."""
    n = len(columns)
    mean = sum((F.sum(c) for c in columns), F.lit(0.0)) / (F.count("*") * n)
    square = sum((F.sum(F.col(c) * F.col(c)) for c in columns), F.lit(0.0)) / (F.count("*") * n)
    stats = df.groupBy(group).agg(mean.alias("_m"), square.alias("_q"))
    j = df.join(stats, group)
    return j.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col("_m")) / F.sqrt(F.col("_q") - F.col("_m") * F.col("_m") + eps)).alias(c) for c in columns])


def running_coefficients(count: int, raw: list[float], down: bool = False) -> list[float]:
    """Prefix sums of coefficients, or the first less the sums of the others: small, on the driver."""
    out, total = [], 0.0
    for i, v in enumerate(raw[:count]):
        total = v if not i else total - v if down else total + v
        out.append(total)
    return out
