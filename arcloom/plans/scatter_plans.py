"""Queries for scatter, segments and pooling. Orders are groups; line items are their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.functions.portable import long_form, norm, r6
from arcloom.operators import scatter as S
from arcloom.plans.registry import query
from arcloom.sources import views as V

_Q = "CAST(l_quantity AS DOUBLE)"


def _lines(spark, sf):
    return V.table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("g"), F.col("l_quantity").alias("v"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _groups(spark):
    return spark.range(60)


for _name, _sql, _neutral in (("sum", "sum(v)", 0.0), ("mean", "avg(v)", 0.0), ("min", "min(v)", 0.0), ("max", "max(v)", 0.0)):
    @query(f"scatter_{_name}", f"WITH r AS (SELECT l_partkey % 50 AS g, {_Q} AS v FROM lineitem), i AS (SELECT CAST(unnest(range(60)) AS BIGINT) AS id) SELECT i.id, round(coalesce({_sql}, {_neutral}), 6) AS value FROM i LEFT JOIN r ON r.g = i.id GROUP BY i.id")
    def _(spark, sf, how=_name):
        return S.scatter(_lines(spark, sf), _groups(spark), "g", "v", how).select("id", r6("value").alias("value"))


@query("scatter_mul", "WITH r AS (SELECT l_partkey % 50 AS g, 1 + (l_linenumber % 2) / 1000.0 AS v FROM lineitem), i AS (SELECT CAST(unnest(range(60)) AS BIGINT) AS id) SELECT i.id, round(coalesce(product(v), 1.0), 4) AS value FROM i LEFT JOIN r ON r.g = i.id GROUP BY i.id")
def _(spark, sf):
    rows = _lines(spark, sf).withColumn("v", 1 + (F.col("l_linenumber") % 2) / F.lit(1000.0))
    return S.scatter(rows, _groups(spark), "g", "v", "mul").select("id", F.round("value", 4).alias("value"))


for _name, _sql in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    @query(f"segment_{_name}", f"WITH s AS (SELECT CAST(unnest(range(40)) AS BIGINT) AS id) SELECT s.id, round(coalesce({_sql}(CAST(p_size AS DOUBLE)), 0), 6) AS value FROM s LEFT JOIN part ON p_partkey >= s.id * 45 AND p_partkey < s.id * 45 + s.id GROUP BY s.id")
    def _(spark, sf, how=_name):
        ptr = spark.range(40).select("id", (F.col("id") * 45).alias("start"), (F.col("id") * 46).alias("end"))
        rows = V.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"))
        return S.segment(rows, ptr, "p_partkey", "v", how).select("id", r6("value").alias("value"))


@query("to_dense_batch", "WITH r AS (SELECT p_partkey % 200 AS id, row_number() OVER (PARTITION BY p_partkey % 200 ORDER BY p_partkey) - 1 AS pos, CAST(p_size AS DOUBLE) AS v FROM part), g AS (SELECT CAST(a.a AS BIGINT) AS id, CAST(b.b AS INTEGER) AS pos FROM unnest(range(200)) a(a), unnest(range(12)) b(b)) SELECT g.id, g.pos, coalesce(r.v, 0.0) AS v FROM g LEFT JOIN r ON r.id = g.id AND r.pos = g.pos")
def _(spark, sf):
    rows = V.table(spark, sf, "part").select((F.col("p_partkey") % 200).alias("g"), "p_partkey", F.col("p_size").cast("double").alias("v"))
    return long_form(S.to_dense(rows, "g", "p_partkey", "v", 12))


@query("multi_aggregation", f"SELECT l_partkey % 50 AS id, round(sum(v), 6) AS sum, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(min(v), 6) AS min, round(stddev_pop(v), 6) AS std, round(var_pop(v), 6) AS var, round(ln(sum(exp(v))), 6) AS logsumexp FROM (SELECT l_partkey, {_Q} / 10 AS v FROM lineitem) GROUP BY l_partkey % 50")
def _(spark, sf):
    m = S.multi(_lines(spark, sf).withColumn("v", F.col("v") / 10), "g", "v")
    return m.select("id", *[r6(c).alias(c) for c in m.columns if c != "id"])


_POOL = f"SELECT l_orderkey AS id, round({{}}(l_quantity), 6) AS v0, round({{}}(CAST(l_linenumber AS DOUBLE)), 6) AS v1 FROM lineitem GROUP BY l_orderkey"
for _name, _sql, _fn in (("global_add_pool", "sum", F.sum), ("global_mean_pool", "avg", F.avg), ("avg_pooling", "avg", F.avg), ("global_max_pool", "max", F.max)):
    @query(_name, _POOL.format(_sql, _sql))
    def _(spark, sf, fn=_fn):
        return V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(r6(fn("l_quantity")).alias("v0"), r6(fn(F.col("l_linenumber").cast("double"))).alias("v1"))


@query("global_add_pool_single", "SELECT round(sum(l_quantity), 6) AS v0, round(sum(CAST(l_linenumber AS DOUBLE)), 6) AS v1 FROM lineitem")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").agg(r6(F.sum("l_quantity")).alias("v0"), r6(F.sum(F.col("l_linenumber").cast("double"))).alias("v1"))


for _name, _log in (("softmax_batch", False), ("log_softmax_batch", True)):
    @query(_name, f"WITH r AS (SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_quantity / 10 AS v FROM lineitem), x AS (SELECT *, exp(v - max(v) OVER (PARTITION BY id)) AS e FROM r) SELECT id, l_linenumber, l_partkey, l_suppkey, round({'ln' if _log else ''}(e / sum(e) OVER (PARTITION BY id)), 6) + 0.0 AS softmax FROM x")
    def _(spark, sf, log=_log):
        rows = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10).alias("v"))
        return S.group_softmax(rows, "id", "v", log).select("id", "l_linenumber", "l_partkey", "l_suppkey", (r6("softmax") + 0.0).alias("softmax"))


@query("scatter_argmax", "SELECT p_partkey % 50 AS id, max(p_retailprice) AS value, min(p_partkey) FILTER (WHERE p_retailprice = m) AS row FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_partkey % 50) AS m FROM part) GROUP BY p_partkey % 50")
def _(spark, sf):
    return S.argmax(V.table(spark, sf, "part").withColumn("g", F.col("p_partkey") % 50), "g", "p_partkey", "p_retailprice")


@query("scatter_max_first", "SELECT p_partkey % 50 AS id, max(CAST(p_size AS DOUBLE)) AS value, min(p_partkey) FILTER (WHERE p_size = m) AS row FROM (SELECT *, max(p_size) OVER (PARTITION BY p_partkey % 50) AS m FROM part) GROUP BY p_partkey % 50")
def _(spark, sf):
    return S.argmax(V.table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("g"), "p_partkey", F.col("p_size").cast("double").alias("s")), "g", "p_partkey", "s")


@query("unique_consecutive", "WITH o AS (SELECT user_id, ts, event_id, event_type AS value, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT user_id, CAST(run AS BIGINT) AS run, min(value) AS value, count(*) AS n FROM r GROUP BY user_id, run")
def _(spark, sf):
    return S.unique_consecutive(V.table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("last_aggregator", "SELECT user_id AS id, arg_max(value, (ts, -event_id)) AS message FROM events GROUP BY user_id")
def _(spark, sf):
    return S.latest(V.table(spark, sf, "events"), "user_id", "ts", "event_id", "value")


@query("mean_aggregator", "SELECT user_id AS id, round(avg(value), 6) AS message FROM events GROUP BY user_id")
def _(spark, sf):
    return V.table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(r6(F.avg("value")).alias("message"))


@query("graph_layer_norm", "WITH r AS (SELECT l_orderkey AS g, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, CAST(l_linenumber AS DOUBLE) AS b FROM lineitem), s AS (SELECT g, (sum(a) + sum(b)) / (2 * count(*)) AS m, (sum(a * a) + sum(b * b)) / (2 * count(*)) AS q FROM r GROUP BY g) SELECT r.g, l_linenumber, l_partkey, l_suppkey, round((a - m) / sqrt(q - m * m + 1e-5), 4) + 0.0 AS a, round((b - m) / sqrt(q - m * m + 1e-5), 4) + 0.0 AS b FROM r JOIN s ON s.g = r.g")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("a"), F.col("l_linenumber").cast("double").alias("b"))
    return S.graph_norm(rows, "g", ["a", "b"]).select("g", "l_linenumber", "l_partkey", "l_suppkey", (F.round("a", 4) + 0.0).alias("a"), (F.round("b", 4) + 0.0).alias("b"))


@query("layer_norm_sum", f"WITH {V.SQL_NODES} SELECT id, 0 AS pos, round(x0 / sqrt(x0 * x0 + x1 * x1), 6) AS v FROM n WHERE x0 + x1 > 0 UNION ALL SELECT id, 1, round(x1 / sqrt(x0 * x0 + x1 * x1), 6) FROM n WHERE x0 + x1 > 0")
def _(spark, sf):
    n = V.nodes(spark, sf).withColumn("z", norm(F.col("x"))).where("z > 0")
    return long_form(n.select("id", F.transform("x", lambda v: v / F.col("z")).alias("x"))).select("id", "pos", r6("v").alias("v"))


for _name, _down in (("presum_coefficients", False), ("preminus_coefficients", True)):
    @query(_name, f"SELECT CAST(k AS INTEGER) AS k, round({'CASE WHEN k = 0 THEN 1.0 ELSE 1.0 - sum(CASE WHEN k > 0 THEN 1.0 / (k + 1) ELSE 0 END) OVER (ORDER BY k) END' if _down else 'sum(1.0 / (k + 1)) OVER (ORDER BY k)'}, 6) AS v FROM unnest(range(8)) t(k)")
    def _(spark, sf, down=_down):
        c = S.running_coefficients(8, [1.0 / (k + 1) for k in range(8)], down)
        return spark.createDataFrame(list(enumerate(c)), "k int, v double").select("k", r6("v").alias("v"))
