"""Queries for the algebra on edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.functions.portable import draw, draw_sql, long_form, r6
from arcloom.operators import edges as E
from arcloom.operators import propagate as P
from arcloom.plans.registry import query
from arcloom.plans.sqltext import EDGES, GCN, step
from arcloom.sources import views as V


def _w(df):
    return df.select("src", "dst", r6("w").alias("w"))


@query("coo_coalesce_sum", f"{EDGES} SELECT src, dst, round(w, 6) AS w FROM e")
def _(spark, sf):
    rows = V.session_rows(spark, sf).withColumn("w", F.lit(1.0))
    return _w(E.coalesce(rows))


for _name, _sql in (("mean", "avg"), ("min", "min"), ("max", "max")):
    @query(f"coo_coalesce_{_name}", f"WITH {V.SQL_ROWS} SELECT src, dst, round({_sql}(CAST((src * 3 + dst) % 11 AS DOUBLE)), 6) AS w FROM rows_ GROUP BY src, dst")
    def _(spark, sf, how=_name):
        rows = V.session_rows(spark, sf)
        return _w(E.coalesce(rows.withColumn("w", ((F.col("src") * 3 + F.col("dst")) % 11).cast("double")), how))


@query("to_undirected", f"{EDGES} SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY src, dst")
def _(spark, sf):
    return _w(E.to_undirected(V.session_edges(spark, sf)))


@query("to_undirected_first", f"{EDGES} SELECT src, dst, round(min(w), 6) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY src, dst")
def _(spark, sf):
    return _w(E.to_undirected_first(V.session_edges(spark, sf)))


@query("sort_edge_index", f"{EDGES} SELECT src, dst, w FROM e ORDER BY src, dst")
def _(spark, sf):
    return E.sort_edges(V.session_edges(spark, sf))


@query("index_sort", f"WITH {V.SQL_ROWS} SELECT dst AS value FROM rows_ ORDER BY dst")
def _(spark, sf):
    return V.session_rows(spark, sf).select(F.col("dst").alias("value")).orderBy("value")


@query("unique_sorted", f"WITH {V.SQL_ROWS} SELECT DISTINCT dst AS value FROM rows_ ORDER BY dst")
def _(spark, sf):
    return V.session_rows(spark, sf).select(F.col("dst").alias("value")).distinct().orderBy("value")


@query("contains_self_loops", f"{EDGES} SELECT bool_or(src = dst) AS found FROM e")
def _(spark, sf):
    return E.contains_self_loops(V.session_edges(spark, sf))


@query("remove_self_loops", f"{EDGES} SELECT src, dst, w FROM e WHERE src <> dst")
def _(spark, sf):
    return E.remove_self_loops(V.session_edges(spark, sf))


@query("segregate_self_loops", f"{EDGES} SELECT src, dst, w, src = dst AS is_loop FROM e")
def _(spark, sf):
    rest, loops = E.segregate_self_loops(V.session_edges(spark, sf))
    return rest.withColumn("is_loop", F.lit(False)).unionAll(loops.withColumn("is_loop", F.lit(True)))


@query("add_self_loops", f"{EDGES} SELECT src, dst, w FROM e UNION ALL SELECT id, id, 1.0 FROM n")
def _(spark, sf):
    return E.add_self_loops(V.session_edges(spark, sf), V.nodes(spark, sf))


@query("add_remaining_self_loops", f"{EDGES} SELECT src, dst, w FROM e WHERE src <> dst UNION ALL SELECT id, id, coalesce(l.w, 2.0) FROM n LEFT JOIN (SELECT src, max(w) AS w FROM e WHERE src = dst GROUP BY src) l ON l.src = n.id")
def _(spark, sf):
    return E.add_remaining_self_loops(V.session_edges(spark, sf), V.nodes(spark, sf), 2.0)


_SPARSE = f"{EDGES}, s AS (SELECT * FROM e WHERE w >= 2), ends AS (SELECT src AS id FROM s WHERE src <> dst UNION SELECT dst FROM s WHERE src <> dst)"


def _sparse(spark, sf):
    """Pairs that were bought together more than once: few, so that many parts are isolated."""
    return V.session_edges(spark, sf).where("w >= 2")


@query("contains_isolated_nodes", f"{_SPARSE} SELECT count(*) > 0 AS found, count(*) AS n FROM n WHERE id NOT IN (SELECT id FROM ends)")
def _(spark, sf):
    return E.isolated(_sparse(spark, sf), V.nodes(spark, sf)).agg((F.count("*") > 0).alias("found"), F.count("*").alias("n"))


@query("remove_isolated_nodes", f"{_SPARSE}, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM ends) SELECT a.k AS src, b.k AS dst, s.w FROM s JOIN m a ON a.id = s.src JOIN m b ON b.id = s.dst")
def _(spark, sf):
    return E.remove_isolated(_sparse(spark, sf))[0]


@query("isolated_node_mask", f"{_SPARSE} SELECT id, id IN (SELECT id FROM ends) AS mask FROM n")
def _(spark, sf):
    return E.index_to_mask(V.nodes(spark, sf), E.endpoints(_sparse(spark, sf)))


_E0 = f"{EDGES}, e0 AS (SELECT * FROM e WHERE src <> dst), d AS (SELECT n.id, coalesce(sum(e0.w), 0.0) AS d FROM n LEFT JOIN e0 ON e0.src = n.id GROUP BY n.id)"


@query("laplacian", f"{_E0} SELECT src, dst, round(-w, 6) AS w FROM e0 UNION ALL SELECT id, id, round(d, 6) FROM d")
def _(spark, sf):
    return _w(E.laplacian(V.session_edges(spark, sf), V.nodes(spark, sf)))


@query("laplacian_sym", f"{_E0} SELECT src, dst, round(-(w * CASE WHEN a.d > 0 THEN pow(a.d, -0.5) ELSE 0 END * CASE WHEN b.d > 0 THEN pow(b.d, -0.5) ELSE 0 END), 6) + 0.0 AS w FROM e0 JOIN d a ON a.id = src JOIN d b ON b.id = dst UNION ALL SELECT id, id, 1.0 FROM d")
def _(spark, sf):
    return E.laplacian(V.session_edges(spark, sf), V.nodes(spark, sf), "sym").select("src", "dst", (r6("w") + 0.0).alias("w"))


@query("laplacian_rw", f"{_E0} SELECT src, dst, round(-w / a.d, 6) AS w FROM e0 JOIN d a ON a.id = src UNION ALL SELECT id, id, 1.0 FROM d")
def _(spark, sf):
    return _w(E.laplacian(V.session_edges(spark, sf), V.nodes(spark, sf), "rw"))


@query("induced_subgraph", f"{EDGES}, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n WHERE x0 <= 20) SELECT a.k AS src, b.k AS dst, e.w FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst")
def _(spark, sf):
    return E.induced(V.session_edges(spark, sf), V.nodes(spark, sf).where("x[0] <= 20"))[0]


@query("one_hot", "SELECT p_partkey AS id, c.pos, CAST(p_partkey % 5 = c.pos AS INTEGER) AS v FROM part, (SELECT CAST(unnest(range(5)) AS INTEGER) AS pos) c")
def _(spark, sf):
    return long_form(E.one_hot(V.nodes(spark, sf), "y", 5), "one_hot")


@query("num_nodes", f"{EDGES} SELECT greatest(max(src), max(dst)) + 1 AS num_nodes FROM e")
def _(spark, sf):
    return E.num_nodes(V.session_edges(spark, sf))


@query("export_undirected_upper", f"{EDGES} SELECT src, dst, min(w) AS w FROM e WHERE src <= dst GROUP BY src, dst")
def _(spark, sf):
    return E.one_way(V.session_edges(spark, sf))


@query("export_undirected_lower", f"{EDGES} SELECT src, dst, min(w) AS w FROM e WHERE src >= dst GROUP BY src, dst")
def _(spark, sf):
    return E.one_way(V.session_edges(spark, sf), upper=False)


@query("index_to_mask", "SELECT p_partkey AS id, p_size > 25 AS mask FROM part")
def _(spark, sf):
    n = V.nodes(spark, sf)
    return E.index_to_mask(n, n.where("x[0] > 25"))


@query("random_splits", f"""WITH a AS (SELECT p_partkey AS id, p_partkey % 5 AS y, {draw_sql('p_partkey', '0', 42)} AS h FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, id) AS k FROM a), v AS (SELECT id, row_number() OVER (ORDER BY h, id) AS q FROM r WHERE k > 20) SELECT r.id, CASE WHEN r.k <= 20 THEN 'train' WHEN v.q <= 50 THEN 'val' ELSE 'test' END AS role FROM r LEFT JOIN v ON v.id = r.id""")
def _(spark, sf):
    from arcloom.operators.sampling import random_splits

    return random_splits(V.nodes(spark, sf), 20, 50, 42)


@query("drop_feature", f"""SELECT p_partkey AS id, c.pos, CASE WHEN {draw_sql('c.pos', '0', 3)} < 400013 THEN 0.0 ELSE v END AS v FROM (SELECT p_partkey, 0 AS pos, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 1, CAST(p_partkey % 7 AS DOUBLE) FROM part) c""")
def _(spark, sf):
    from arcloom.operators.sampling import drop_feature

    return long_form(drop_feature(V.nodes(spark, sf), 400_013, 3))


@query("mask_edge", f"{EDGES} SELECT src, dst, w FROM e WHERE {draw_sql('src', 'dst', 5)} >= 300010")
def _(spark, sf):
    return V.session_edges(spark, sf).where(draw(F.col("src"), F.col("dst"), 5) >= 300_010)


@query("preprocess_features", f"WITH {V.SQL_NODES} SELECT id, 0 AS pos, round(CASE WHEN x0 + x1 = 0 THEN 0 ELSE x0 / (x0 + x1) END, 6) AS v FROM n UNION ALL SELECT id, 1, round(CASE WHEN x0 + x1 = 0 THEN 0 ELSE x1 / (x0 + x1) END, 6) FROM n")
def _(spark, sf):
    n = V.nodes(spark, sf)
    return long_form(n.select("id", E.row_normalised(F.col("x")).alias("x"))).select("id", "pos", r6("v").alias("v"))


@query("normalize_features", f"WITH {V.SQL_NODES} SELECT id, 0 AS pos, round(x0 / greatest(x0 + x1, 1.0), 6) AS v FROM n UNION ALL SELECT id, 1, round(x1 / greatest(x0 + x1, 1.0), 6) FROM n")
def _(spark, sf):
    n = V.nodes(spark, sf)
    return long_form(n.select("id", E.row_normalised(F.col("x"), 1.0).alias("x"))).select("id", "pos", r6("v").alias("v"))


@query("sparse_to_tuple", f"WITH {V.SQL_FEATURES} SELECT id, pos, v FROM f WHERE v <> 0")
def _(spark, sf):
    return long_form(V.nodes(spark, sf)).where("v <> 0")


@query("cheby_scalar", "SELECT p_partkey AS id, round(x, 6) AS t1, round(2 * x * x - 1, 6) AS t2, round(4 * x * x * x - 3 * x, 6) AS t3 FROM (SELECT p_partkey, (p_size % 10) / 10.0 AS x FROM part)")
def _(spark, sf):
    n = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") % 10) / F.lit(10.0)).alias("x"))
    return n.select("id", *[r6(E.chebyshev(k, F.col("x"))).alias(f"t{k}") for k in (1, 2, 3)])


@query("even_quantile_labels", "WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT p_partkey AS id, CAST(p_retailprice >= a AS INTEGER) + CAST(p_retailprice >= b AS INTEGER) + CAST(p_retailprice >= c AS INTEGER) AS label FROM part, q")
def _(spark, sf):
    return E.quantile_labels(V.table(spark, sf, "part"), "p_retailprice", 4).select(F.col("p_partkey").alias("id"), "label")


@query("zero_based_ids", "SELECT p_partkey AS id, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def _(spark, sf):
    return E.encoded(V.table(spark, sf, "part"), "p_brand").select(F.col("p_partkey").alias("id"), "p_brand", "code")


@query("standardise_columns", "SELECT c_custkey AS id, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer")
def _(spark, sf):
    return E.standardised(V.table(spark, sf, "customer"), ["c_acctbal"]).select(F.col("c_custkey").alias("id"), r6("z_c_acctbal").alias("z"))


@query("normalize_adj", f"{EDGES}, d AS (SELECT src AS id, sum(w) AS d FROM e GROUP BY src) SELECT e.src, e.dst, round(pow(a.d, -0.5) * e.w * coalesce(pow(b.d, -0.5), 0), 6) AS w FROM e JOIN d a ON a.id = e.src LEFT JOIN d b ON b.id = e.dst")
def _(spark, sf):
    e = V.session_edges(spark, sf)
    d = E.degree(e, V.nodes(spark, sf), "src", F.col("w"))
    j = e.join(d.select(F.col("id").alias("src"), F.col("deg").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("b")), "dst")
    return j.select("src", "dst", r6(E.inverse_power(F.col("a"), -0.5) * F.col("w") * E.inverse_power(F.col("b"), -0.5)).alias("w"))


@query("degree", f"{EDGES} SELECT n.id, count(e.src) AS deg FROM n LEFT JOIN e ON e.dst = n.id GROUP BY n.id")
def _(spark, sf):
    return E.degree(V.session_edges(spark, sf), V.nodes(spark, sf))


@query("laplacian_positional_encoding")
def _(spark, sf):
    from arcloom.operators.spectral import positional_encoding

    return positional_encoding(V.session_edges(spark, sf), V.nodes(spark, sf), 2)


@query("flagship_two_hop", f"""{EDGES}, f AS (SELECT id, 0 AS pos, x0 AS v FROM n UNION ALL SELECT id, 1, x1 FROM n), {GCN}, {step('h1', 'a', 'f')}, {step('h2', 'a', 'h1')} SELECT id, round(v, 6) AS score FROM h2 WHERE pos = 0 ORDER BY round(v, 6) DESC, id LIMIT 10""")
def _(spark, sf):
    n = V.nodes(spark, sf)
    scores = P.hops(n, P.gcn_norm(V.session_edges(spark, sf), n), 2, 2)[-1]
    return scores.select("id", r6(F.get("x", 0)).alias("score")).orderBy(F.desc("score"), "id").limit(10)
