"""Queries for sampling, batching, partitions, graph transformers, geometry and self-supervision."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arcloom.functions.portable import draw, draw_sql, long_form, r6
from arcloom.operators import batching as B
from arcloom.operators import edges as E
from arcloom.operators import geometry as G
from arcloom.operators import propagate as P
from arcloom.operators import sampling as S
from arcloom.plans.registry import query
from arcloom.plans.sqltext import BASE, EDGES, GCN, mix, step
from arcloom.sources import views as V

# ---- sampling ----------------------------------------------------------------------------------------------------------
_RANK = f"{EDGES}, rk AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place, count(*) OVER (PARTITION BY src) AS size FROM e)"


@query("neighbor_sampler", f"{_RANK}, a AS (SELECT n.id, CAST(k AS INTEGER) AS pick FROM n, unnest(range(3)) t(k)) SELECT a.id, a.pick, rk.dst AS neighbour FROM a JOIN rk ON rk.src = a.id AND rk.place = {draw_sql('a.id', 'a.pick', 1)} % rk.size")
def _(spark, sf):
    return S.with_replacement(V.session_edges(spark, sf), V.nodes(spark, sf).select("id"), 3, 1).select("id", "pick", "neighbour")


_STEP = lambda a, b, s: f"{b} AS (SELECT {a}.start, rk.dst AS node FROM {a} JOIN rk ON rk.src = {a}.node AND rk.place = {draw_sql(f'{a}.start', f'{a}.node', s)} % rk.size)"


@query("random_walk", f"{_RANK}, w0 AS (SELECT id AS start, id AS node FROM n), {_STEP('w0', 'w1', 8)}, {_STEP('w1', 'w2', 9)}, {_STEP('w2', 'w3', 10)} SELECT start, 0 AS pos, node AS v FROM w0 UNION ALL SELECT start, 1, node FROM w1 UNION ALL SELECT start, 2, node FROM w2 UNION ALL SELECT start, 3, node FROM w3")
def _(spark, sf):
    return long_form(S.random_walks(V.session_edges(spark, sf), V.nodes(spark, sf).select("id"), 3, 8), "walk", ("start",))


@query("sample_fanout", f"{EDGES}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY {draw_sql('src', 'dst', 7)}, src) AS k FROM e JOIN n ON n.id = e.dst) SELECT src, dst FROM r WHERE k <= 5")
def _(spark, sf):
    return S.fan_out(V.session_edges(spark, sf), V.nodes(spark, sf), 5, 7)


_FAN = lambda name, seeds, k, s: f"{name} AS (SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.dst ORDER BY {draw_sql('e.src', 'e.dst', s)}, e.src) AS k FROM e JOIN {seeds} z ON z.id = e.dst) WHERE k <= {k})"


@query("minibatch_fanout", f"{EDGES}, b AS (SELECT id FROM n WHERE id % 10 = 3), {_FAN('l1', 'b', 4, 7)}, v1 AS (SELECT id FROM b UNION SELECT src FROM l1), {_FAN('l2', 'v1', 3, 8)}, v2 AS (SELECT id FROM v1 UNION SELECT src FROM l2), lo AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS local FROM v2), y AS (SELECT 1 AS layer, * FROM l1 UNION ALL SELECT 2, * FROM l2) SELECT CAST(y.layer AS INTEGER) AS layer, a.local AS src, c.local AS dst, round(1 / (sqrt(count(*) OVER (PARTITION BY y.layer, y.src)) * sqrt(count(*) OVER (PARTITION BY y.layer, y.dst))), 6) AS w FROM y JOIN lo a ON a.id = y.src JOIN lo c ON c.id = y.dst")
def _(spark, sf):
    """A batch (a tenth of the nodes), two layers of sampled senders, ids of the batch's own, and weights of each layer."""
    n = V.nodes(spark, sf)
    return S.layered_batch(V.session_edges(spark, sf), n.where("id % 10 = 3").select("id"), [(4, 7), (3, 8)]).select("layer", "src", "dst", r6("w").alias("w"))


@query("neighbor_loader_two_layers", f"{_RANK}, l1 AS (SELECT n.id, CAST(k AS INTEGER) AS pick FROM n, unnest(range(2)) t(k)), s1 AS (SELECT l1.id AS target, rk.dst AS source FROM l1 JOIN rk ON rk.src = l1.id AND rk.place = {draw_sql('l1.id', 'l1.pick', 3)} % rk.size), u AS (SELECT DISTINCT source AS id FROM s1), l2 AS (SELECT u.id, CAST(k AS INTEGER) AS pick FROM u, unnest(range(2)) t(k)), s2 AS (SELECT l2.id AS target, rk.dst AS source FROM l2 JOIN rk ON rk.src = l2.id AND rk.place = {draw_sql('l2.id', 'l2.pick', 4)} % rk.size) SELECT DISTINCT target, source FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)")
def _(spark, sf):
    e = V.session_edges(spark, sf)
    one = S.with_replacement(e, V.nodes(spark, sf).select("id"), 2, 3)
    two = S.with_replacement(e, one.select(F.col("neighbour").alias("id")).distinct(), 2, 4)
    return one.unionByName(two).select(F.col("id").alias("target"), F.col("neighbour").alias("source")).distinct()


@query("random_node_loader", f"{EDGES}, pt AS (SELECT id, {draw_sql('id', '0', 12)} % 4 AS part FROM n), lo AS (SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS local FROM pt) SELECT a.part, a.local AS src, b.local AS dst, e.w FROM e JOIN lo a ON a.id = e.src JOIN lo b ON b.id = e.dst AND b.part = a.part")
def _(spark, sf):
    parts = B.renumbered(V.nodes(spark, sf).select("id", (draw(F.col("id"), 0, 12) % 4).alias("part")))
    s, d = parts.select(F.col("id").alias("src"), F.col("part").alias("part"), F.col("local").alias("s")), parts.select(F.col("id").alias("dst"), F.col("part").alias("p2"), F.col("local").alias("d"))
    return V.session_edges(spark, sf).join(s, "src").join(d, "dst").where("part = p2").select("part", F.col("s").alias("src"), F.col("d").alias("dst"), "w")


@query("metis_like_partition")
def _(spark, sf):
    return B.label_propagation_parts(V.session_edges(spark, sf), V.nodes(spark, sf), 4, 2)


_SPLITS = f"{EDGES}, pt AS (SELECT id, CAST({draw_sql('id % 16', '3', 13)} % 4 AS BIGINT) AS batch FROM n), lo AS (SELECT id, batch, row_number() OVER (PARTITION BY batch ORDER BY id) - 1 AS local FROM pt)"


@query("cluster_loader", f"{_SPLITS} SELECT a.batch, a.id AS src_id, b.id AS dst_id, a.local AS src, b.local AS dst, e.w FROM e JOIN lo a ON a.id = e.src JOIN lo b ON b.id = e.dst AND b.batch = a.batch")
def _(spark, sf):
    """16 small parts (here by id; any (id, part) table serves) are merged into 4 batches by a draw; each batch is the
    graph that its nodes induce, under ids of its own."""
    parts = V.nodes(spark, sf).select("id", (F.col("id") % 16).alias("part"))
    return B.merged_parts(V.session_edges(spark, sf), parts, 4, 13)


@query("graphsaint_loader", f"{EDGES}, dg AS (SELECT dst, count(*) AS c FROM e GROUP BY dst), dr AS (SELECT e.src, e.dst, e.w, 1.0 / so.c + 1.0 / si.c AS p FROM e JOIN (SELECT src, count(*) AS c FROM e GROUP BY src) so ON so.src = e.src JOIN dg si ON si.dst = e.dst), z AS (SELECT sum(p) AS total FROM dr), k AS (SELECT src, dst, least(p / total * 2000, 1.0) AS q FROM dr, z), s AS (SELECT src, dst FROM k WHERE {draw_sql('src', 'dst', 19)} < floor(q * 1000033)), v AS (SELECT src AS id FROM s UNION SELECT dst FROM s) SELECT e.src, e.dst, round(1 / k.q, 5) AS norm FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst JOIN k ON k.src = e.src AND k.dst = e.dst")
def _(spark, sf):
    """The edge sampler: edges are drawn with odds 1/deg(src) + 1/deg(dst), about 2,000 of them; the batch is the graph
    that their ends induce, each edge with the inverse of its odds."""
    out = S.saint_edges(V.session_edges(spark, sf), 2000, 19)
    return out.select("src", "dst", F.round("norm", 5).alias("norm"))


@query("node2vec_transitions", f"{EDGES}, s AS (SELECT src, dst FROM e), t AS (SELECT a.src AS prev, a.dst AS cur, b.dst AS next, CASE WHEN b.dst = a.src THEN 2.0 WHEN c.src IS NOT NULL THEN 1.0 ELSE 0.5 END AS w FROM s a JOIN s b ON b.src = a.dst LEFT JOIN s c ON c.src = a.src AND c.dst = b.dst) SELECT prev, cur, next, round(w / sum(w) OVER (PARTITION BY prev, cur), 6) AS prob FROM t")
def _(spark, sf):
    e = V.session_edges(spark, sf)
    return S.second_order_weights(e, 0.5, 2.0).select("prev", "cur", "next", r6("prob").alias("prob"))


@query("skip_gram_pairs", f"{_RANK}, w0 AS (SELECT id AS start, id AS node FROM n), {_STEP('w0', 'w1', 8)}, {_STEP('w1', 'w2', 9)}, {_STEP('w2', 'w3', 10)}, x AS (SELECT start, 0 AS i, node FROM w0 UNION ALL SELECT start, 1, node FROM w1 UNION ALL SELECT start, 2, node FROM w2 UNION ALL SELECT start, 3, node FROM w3) SELECT a.start, a.i, b.i AS j, a.node AS centre, b.node AS context FROM x a JOIN x b ON b.start = a.start AND a.i <> b.i AND abs(a.i - b.i) <= 2")
def _(spark, sf):
    return S.skip_grams(S.random_walks(V.session_edges(spark, sf), V.nodes(spark, sf).select("id"), 3, 8), 2)


@query("line_edge_negatives", f"{EDGES}, c AS (SELECT id AS neg, row_number() OVER (ORDER BY id) - 1 AS place FROM n), z AS (SELECT count(*) AS size FROM c), h AS (SELECT src, count(*) AS d FROM e GROUP BY src), a AS (SELECT e.src, e.dst, x.t, ({draw_sql('e.src', 'e.dst', 21)} + x.t) % z.size AS place FROM e JOIN h ON h.src = e.src, z, unnest(range(least(h.d + 1, z.size))) x(t)), f AS (SELECT a.src, a.dst, c.neg, row_number() OVER (PARTITION BY a.src, a.dst ORDER BY a.t) AS k FROM a JOIN c ON c.place = a.place LEFT JOIN e ON e.src = a.src AND e.dst = c.neg WHERE e.src IS NULL) SELECT src, dst, neg FROM f WHERE k <= 1")
def _(spark, sf):
    p = V.session_edges(spark, sf).select(F.col("src").alias("user_id"), F.col("dst").alias("item_id"))
    return S.negatives(p, V.nodes(spark, sf).select(F.col("id").alias("item_id")), 1, 21).select(F.col("user_id").alias("src"), F.col("item_id").alias("dst"), "neg")


@query("evaluation_negative_pairs", f"{EDGES}, c AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM n), z AS (SELECT count(*) AS size FROM c), g AS (SELECT count(*) AS goal FROM e), d AS (SELECT k AS t, k % z.size AS pi, (k % z.size + 1 + {draw_sql('k % z.size', 'k // z.size', 31)} % (z.size - 1)) % z.size AS pj FROM z, g, unnest(range(8 * goal + 1000)) t(k)), f AS (SELECT a.id AS i, b.id AS j, min(d.t) AS t FROM d JOIN c a ON a.place = d.pi JOIN c b ON b.place = d.pj GROUP BY a.id, b.id), x AS (SELECT f.*, row_number() OVER (ORDER BY t) AS k FROM f LEFT JOIN e ON e.src = f.i AND e.dst = f.j WHERE e.src IS NULL) SELECT i, j FROM x, g WHERE k <= goal")
def _(spark, sf):
    """As many pairs as there are edges. The SQL draws eight times as many at once; the query in rounds, until it has them."""
    e = V.session_edges(spark, sf)
    return S.missing_pairs(e, V.nodes(spark, sf).select("id"), e.count(), 31)


@query("link_split", f"{EDGES}, h AS (SELECT src, dst, row_number() OVER (ORDER BY {draw_sql('src', 'dst', 51)}, src, dst) AS k, count(*) OVER () AS c FROM e WHERE src < dst) SELECT src, dst, CASE WHEN k <= floor(c * 0.05) THEN 'val' WHEN k <= floor(c * 0.05) + floor(c * 0.1) THEN 'test' ELSE 'train' END AS role FROM h")
def _(spark, sf):
    h = V.session_edges(spark, sf).where("src < dst").select("src", "dst", draw(F.col("src"), F.col("dst"), 51).alias("d"))
    return S.exact_split(h, "d", ["src", "dst"], (0.05, 0.1), ("val", "test", "train"))


@query("walk_corpus_vocabulary", f"WITH {V.SQL_ROWS}, c AS (SELECT dst AS symbol, count(*) AS cnt FROM rows_ GROUP BY dst) SELECT symbol, cnt, row_number() OVER (ORDER BY cnt DESC, symbol) + 2 AS idx FROM c")
def _(spark, sf):
    c = V.session_rows(spark, sf).groupBy(F.col("dst").alias("symbol")).agg(F.count("*").alias("cnt"))
    return E.ranked_by_count(c).select("symbol", "cnt", (F.col("rank") + 3).alias("idx"))


# ---- batches and partitions -----------------------------------------------------------------------------------------------
_LINES = "l AS (SELECT l_orderkey AS gid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS local FROM lineitem), s AS (SELECT gid, count(*) AS c FROM l GROUP BY gid), o AS (SELECT gid, coalesce(sum(c) OVER (ORDER BY gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)"


def _orders(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(*V.LINE_ORDER)
    n = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("gid"), (F.row_number().over(w) - 1).cast("long").alias("local"))
    e = n.select("gid", F.col("local").alias("src"), F.lead("local").over(Window.partitionBy("gid").orderBy("local")).alias("dst")).where("dst is not null")
    return n, e


@query("batch_disjoint_union", f"WITH {_LINES} SELECT l.gid, CAST(l.local + o.start AS BIGINT) AS src, CAST(l.local + o.start + 1 AS BIGINT) AS dst FROM l JOIN o ON o.gid = l.gid JOIN s ON s.gid = l.gid WHERE l.local + 1 < s.c")
def _(spark, sf):
    n, e = _orders(spark, sf)
    return B.disjoint_union(n, e)[1]


@query("unbatch_graph", f"WITH {_LINES} SELECT l.gid, l.local AS src, l.local + 1 AS dst FROM l JOIN s ON s.gid = l.gid WHERE l.local + 1 < s.c")
def _(spark, sf):
    n, e = _orders(spark, sf)
    _nodes, edges, start = B.disjoint_union(n, e)
    return B.unbatched(edges, start)


@query("graph_data_loader", "SELECT o_orderkey AS gid, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 32) AS BIGINT) AS batch FROM orders")
def _(spark, sf):
    labels = E.relabel(V.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return labels.select(F.col("id").alias("gid"), F.floor(F.col("new_id") / 32).alias("batch"))


@query("general_loader", f"{EDGES} SELECT src, dst, w FROM e")
def _(spark, sf):
    return V.session_edges(spark, sf)


@query("temporal_data_loader_negatives", f"WITH {V.SQL_PAIRS} SELECT user_id, item_id, {draw_sql('user_id', 'item_id', 17)} % (b.hi - b.lo + 1) + b.lo AS neg FROM p, (SELECT min(item_id) AS lo, max(item_id) AS hi FROM p) b")
def _(spark, sf):
    p = V.pairs(spark, sf)
    b = p.agg(F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
    return p.crossJoin(F.broadcast(b)).select("user_id", "item_id", (draw(F.col("user_id"), F.col("item_id"), 17) % (F.col("hi") - F.col("lo") + 1) + F.col("lo")).alias("neg"))


@query("csr_to_coo", f"{EDGES} SELECT src, dst FROM e")
def _(spark, sf):
    lists = V.session_edges(spark, sf).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("columns"))
    return lists.select("src", F.explode("columns").alias("dst"))


_PART = f"{EDGES}, pt AS (SELECT id, id % 4 AS part FROM n), lo AS (SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS local FROM pt)"


def _parts(spark, sf):
    return B.renumbered(V.nodes(spark, sf).select("id", (F.col("id") % 4).alias("part")))


@query("chunk_build", f"{_PART} SELECT a.part, a.local AS src, b.local AS dst, e.w FROM e JOIN lo a ON a.id = e.src JOIN lo b ON b.id = e.dst WHERE a.part = b.part")
def _(spark, sf):
    p = _parts(spark, sf)
    j = V.session_edges(spark, sf).join(p.select(F.col("id").alias("src"), "part", F.col("local").alias("s")), "src").join(p.select(F.col("id").alias("dst"), F.col("part").alias("p2"), F.col("local").alias("d")), "dst")
    return j.where("part = p2").select("part", F.col("s").alias("src"), F.col("d").alias("dst"), "w")


@query("distributed_chunk", f"{_PART} SELECT b.part, e.src, b.local AS dst, e.w FROM e JOIN lo b ON b.id = e.dst")
def _(spark, sf):
    p = _parts(spark, sf).select(F.col("id").alias("dst"), "part", F.col("local").alias("d"))
    return V.session_edges(spark, sf).join(p, "dst").select("part", "src", F.col("d").alias("dst"), "w")


@query("partition_cut_matrix", f"{_PART} SELECT a.part AS part_src, b.part AS part_dst, count(*) AS edges FROM e JOIN lo a ON a.id = e.src JOIN lo b ON b.id = e.dst GROUP BY a.part, b.part")
def _(spark, sf):
    p = _parts(spark, sf)
    return B.inside_parts(V.session_edges(spark, sf), parts=p.select("id", "part")).groupBy(F.col("ps").alias("part_src"), F.col("pd").alias("part_dst")).agg(F.count("*").alias("edges"))


@query("chunk_id_lookup", "SELECT p_partkey AS id, CASE WHEN p_partkey < 300 THEN 0 WHEN p_partkey < 900 THEN 1 WHEN p_partkey < 1500 THEN 2 ELSE 3 END AS chunk FROM part")
def _(spark, sf):
    bounds = F.array(F.lit(300), F.lit(900), F.lit(1500))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.size(F.filter(bounds, lambda b: b <= F.col("p_partkey"))).alias("chunk"))


# ---- graph transformers ----------------------------------------------------------------------------------------------------
_SMALL = "l AS (SELECT l_orderkey AS gid, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem), g AS (SELECT gid, src, dst FROM l WHERE src <> dst UNION SELECT gid, dst, src FROM l WHERE src <> dst)"


def _small(spark, sf):
    """A graph for each order: its parts, each joined both ways to that of the next line."""
    w = Window.partitionBy("l_orderkey").orderBy(*V.LINE_ORDER)
    lines = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("src <> dst")
    return lines.unionAll(lines.select("gid", "dst", "src")).distinct()


_PATHS = f"WITH RECURSIVE {_SMALL}, d0 AS (SELECT gid, src AS s FROM g UNION SELECT gid, dst FROM g), sz AS (SELECT gid, count(*) AS c FROM d0 GROUP BY gid), r AS (SELECT gid, s, s AS t, 0 AS dist FROM d0 UNION SELECT r.gid, r.s, g.dst, r.dist + 1 FROM r JOIN g ON g.gid = r.gid AND g.src = r.t JOIN sz ON sz.gid = r.gid WHERE r.dist < sz.c - 1), sp AS (SELECT gid, s, t, CAST(min(dist) AS INTEGER) AS dist FROM r GROUP BY gid, s, t)"


@query("all_pairs_shortest_paths", f"{_PATHS} SELECT gid, s, t, dist FROM sp")
def _(spark, sf):
    return B.shortest_paths(_small(spark, sf)).select("gid", "s", "t", "dist")


@query("centrality_encoding", f"{EDGES} SELECT n.id, CAST(least((SELECT count(*) FROM e WHERE e.dst = n.id), 9) AS BIGINT) AS deg_in, CAST(least((SELECT count(*) FROM e WHERE e.src = n.id), 9) AS BIGINT) AS deg_out FROM n")
def _(spark, sf):
    n, e = V.nodes(spark, sf), V.session_edges(spark, sf)
    i, o = E.degree(e, n, "dst"), E.degree(e, n, "src").withColumnRenamed("deg", "o")
    return i.join(o, "id").select("id", F.least("deg", F.lit(9)).alias("deg_in"), F.least("o", F.lit(9)).alias("deg_out"))


@query("spatial_encoding", f"{_PATHS} SELECT gid, s, t, CAST(CASE least(dist, 3) WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.125 END AS DOUBLE) AS bias FROM sp WHERE dist > 0")
def _(spark, sf):
    p = B.shortest_paths(_small(spark, sf)).where("dist > 0")
    return p.select("gid", "s", "t", F.get(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.125)), F.least("dist", F.lit(3)) - 1).alias("bias"))


@query("edge_encoding", f"{_PATHS}, pa AS (SELECT sp.gid, sp.s, sp.t, sp.dist, min(b.t) AS parent FROM sp JOIN sp b ON b.gid = sp.gid AND b.s = sp.s AND b.dist = sp.dist - 1 JOIN g ON g.gid = sp.gid AND g.src = b.t AND g.dst = sp.t GROUP BY sp.gid, sp.s, sp.t, sp.dist), w AS (SELECT gid, s, t, dist, CAST((parent * 3 + t) % 5 AS DOUBLE) AS c, parent, 1 AS k FROM pa UNION ALL SELECT w.gid, w.s, w.t, w.dist, w.c + CAST((p.parent * 3 + p.t) % 5 AS DOUBLE), p.parent, w.k + 1 FROM w JOIN pa p ON p.gid = w.gid AND p.s = w.s AND p.t = w.parent) SELECT gid, s, t, round(max(c) FILTER (WHERE k = dist) / dist, 6) AS c FROM w GROUP BY gid, s, t, dist")
def _(spark, sf):
    p = B.shortest_paths(_small(spark, sf), lambda a, b: (a * 3 + b) % 5).where("dist > 0")
    return p.select("gid", "s", "t", r6(F.col("c") / F.col("dist")).alias("c"))


@query("block_attention", f"WITH {_SMALL}, v AS (SELECT gid, src AS id FROM g UNION SELECT gid, dst FROM g), s AS (SELECT a.gid, a.id AS i, b.id AS j, (a.id * b.id) % 7 / 7.0 AS sc FROM v a JOIN v b ON b.gid = a.gid) SELECT gid, i, j, round(exp(sc) / sum(exp(sc)) OVER (PARTITION BY gid, i), 6) AS alpha FROM s")
def _(spark, sf):
    g = _small(spark, sf)
    v = g.select("gid", F.col("src").alias("i")).union(g.select("gid", "dst")).distinct()
    s = v.join(v.withColumnRenamed("i", "j"), "gid").withColumn("score", (F.col("i") * F.col("j")) % 7 / F.lit(7.0))
    return P.edge_softmax(s, ("gid", "i")).select("gid", "i", "j", r6("alpha").alias("alpha"))


@query("sequence_padding", "SELECT l_orderkey AS id, CAST(p AS INTEGER) AS pos, coalesce(v, -1.0) AS v FROM (SELECT DISTINCT l_orderkey FROM lineitem) CROSS JOIN unnest(range(6)) t(p) LEFT JOIN (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS r, l_quantity AS v FROM lineitem) ON k = l_orderkey AND r = p")
def _(spark, sf):
    from arcloom.operators.scatter import to_dense

    w = Window.partitionBy("l_orderkey").orderBy(*V.LINE_ORDER)
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(w).alias("r"), "l_quantity")
    return long_form(to_dense(rows, "l_orderkey", "r", "l_quantity", 6, -1.0))


# ---- geometry ----------------------------------------------------------------------------------------------------------------
_PTS = "pt AS (SELECT vec_id % 10 AS gid, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_NEAR = f"WITH {_PTS}, d AS (SELECT a.gid, a.id AS i, b.id AS j, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist FROM pt a JOIN pt b ON b.gid = a.gid AND b.id <> a.id), nr AS (SELECT * FROM d WHERE dist < 0.12)"


def _points(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 10).alias("gid"), F.col("vec_id").alias("id"), *[F.get("embedding", k).cast("double").alias(c) for k, c in enumerate("xyz")])


@query("radius_graph", f"{_NEAR} SELECT gid, i, j, round(dist, 6) AS dist FROM nr")
def _(spark, sf):
    return G.radius_graph(_points(spark, sf), 0.12).select("gid", "i", "j", r6("dist").alias("dist"))


@query("radius_graph_capped", f"{_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY gid, i ORDER BY j) AS k FROM d WHERE dist <= 0.12) SELECT gid, i, j, round(dist, 6) AS dist FROM k WHERE k <= 4")
def _(spark, sf):
    return G.radius_graph(_points(spark, sf), 0.12, True, False, 4).select("gid", "i", "j", r6("dist").alias("dist"))


_TRI = f"{_NEAR}, tr AS (SELECT a.gid, a.i AS k, a.j AS j, b.j AS i FROM nr a JOIN nr b ON b.gid = a.gid AND b.i = a.j WHERE a.i <> b.j)"


def _near(spark, sf):
    return G.radius_graph(_points(spark, sf), 0.12)


def _stars(spark, sf):
    return G.stars(_points(spark, sf), 0.12)


@query("triplets", f"{_TRI} SELECT gid, k, j, i FROM tr")
def _(spark, sf):
    return G.star_triplets(_stars(spark, sf)).select("gid", "k", "j", "i")


@query("triplet_angles", f"{_TRI}, c AS (SELECT tr.*, a.x-b.x AS ax, a.y-b.y AS ay, a.z-b.z AS az, d.x-b.x AS bx, d.y-b.y AS by_, d.z-b.z AS bz FROM tr JOIN pt a ON a.id = tr.k JOIN pt b ON b.id = tr.j JOIN pt d ON d.id = tr.i) SELECT gid, k, j, i, round(atan2(sqrt(pow(ay*bz-az*by_,2) + pow(az*bx-ax*bz,2) + pow(ax*by_-ay*bx,2)), ax*bx+ay*by_+az*bz), 5) AS angle FROM c")
def _(spark, sf):
    t = G.star_triplets(_stars(spark, sf))
    angle = G.angle([F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"])
    return t.select("gid", "k", "j", "i", angle.alias("angle")).select("gid", "k", "j", "i", G.rounded(F.col("angle"), 5).alias("angle"))


_CROSS = lambda u, v: [f"({u}y*{v}z-{u}z*{v}y)", f"({u}z*{v}x-{u}x*{v}z)", f"({u}x*{v}y-{u}y*{v}x)"]
_TOR = f"{_TRI.replace(' AS (', ' AS MATERIALIZED (')}, q AS MATERIALIZED (SELECT t.gid, t.k, t.j, t.i, m.i AS l FROM tr t JOIN tr m ON m.gid = t.gid AND m.k = t.j AND m.j = t.i AND m.i <> t.k), v AS (SELECT q.*, " + ", ".join(f"{b}.{c}-{a}.{c} AS {n}{c}" for n, a, b in (("f", "pk", "pj"), ("g", "pj", "pi_"), ("h", "pi_", "pl")) for c in "xyz") + " FROM q " + " ".join(f"JOIN pt {a} ON {a}.gid = q.gid AND {a}.id = q.{c}" for a, c in (("pk", "k"), ("pj", "j"), ("pi_", "i"), ("pl", "l"))) + "), w AS (SELECT *, " + ", ".join(f"{e} AS {n}{c}" for n, u, v in (("p", "f", "g"), ("q", "g", "h")) for c, e in zip("xyz", _CROSS(u, v), strict=True)) + " FROM v), t AS (SELECT gid, k, j, i, l, atan2((" + " + ".join(f"{e}*g{c}" for c, e in zip("xyz", _CROSS("p", "q"), strict=True)) + ") / sqrt(gx*gx + gy*gy + gz*gz), px*qx + py*qy + pz*qz) AS t FROM w)"


@query("torsion_angles", f"{_TOR} SELECT gid, k, j, i, l, round(CASE WHEN t < 0 THEN t + 6.283185307179586 ELSE t END, 5) AS torsion FROM t")
def _(spark, sf):
    return G.star_torsions(_stars(spark, sf)).select("gid", "k", "j", "i", "l", G.rounded(F.col("torsion"), 5).alias("torsion"))


@query("gaussian_smearing", f"{_NEAR} SELECT gid, i, j, CAST(p AS INTEGER) AS pos, round(exp(-0.5 / pow(0.12 / 3, 2) * pow(dist - p * (0.12 / 3), 2)), 5) AS v FROM nr, unnest(range(4)) t(p)")
def _(spark, sf):
    return long_form(_near(spark, sf).select("gid", "i", "j", G.gaussian_smearing(F.col("dist"), 0.0, 0.12, 4).alias("x")), key=("gid", "i", "j")).select("gid", "i", "j", "pos", F.round("v", 5).alias("v"))


@query("cosine_cutoff", f"{_NEAR} SELECT gid, i, j, round(0.5 * (cos(dist * pi() / 0.12) + 1), 5) AS c, round(ln(1 + exp(dist)) - ln(2), 5) AS softplus FROM nr")
def _(spark, sf):
    return _near(spark, sf).select("gid", "i", "j", F.round(G.cosine_cutoff(F.col("dist"), 0.12), 5).alias("c"), F.round(G.shifted_softplus(F.col("dist")), 5).alias("softplus"))


@query("bessel_radial_basis", f"{_NEAR}, s AS (SELECT gid, i, j, dist / 0.2 AS s FROM nr WHERE dist > 0), v AS (SELECT *, 1 / s - 28 * pow(s, 5) + 48 * pow(s, 6) - 21 * pow(s, 7) AS u FROM s) SELECT gid, i, j, CAST(p AS INTEGER) AS pos, round(u * sin((p + 1) * pi() * s), 4) + 0.0 AS v FROM v, unnest(range(3)) t(p)")
def _(spark, sf):
    # a row for each place first: the distance is then worked out once, and the code of a row stays small enough to be compiled
    rows = _near(spark, sf).where("dist > 0").select("gid", "i", "j", "dist", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos"))
    return rows.select("gid", "i", "j", "pos", (F.round(G.bessel(F.col("dist"), 0.2, F.col("pos"), 5), 4) + 0.0).alias("v"))


for _name, _weight in (("conformer_centre", None), ("dipole_centre_of_mass", "m")):
    @query(_name, f"WITH {_PTS}, q AS (SELECT *, {'1.0' if not _weight else 'CAST(id % 3 + 1 AS DOUBLE)'} AS m FROM pt), c AS (SELECT gid, sum(x*m)/sum(m) AS a, sum(y*m)/sum(m) AS b, sum(z*m)/sum(m) AS d FROM q GROUP BY gid) SELECT q.gid, q.id, round(x - a, 5) + 0.0 AS x, round(y - b, 5) + 0.0 AS y, round(z - d, 5) + 0.0 AS z FROM q JOIN c ON c.gid = q.gid")
    def _(spark, sf, weight=_weight):
        p = _points(spark, sf).withColumn("m", (F.col("id") % 3 + 1).cast("double"))
        return G.centred(p, weight).select("gid", "id", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


@query("molecule_readout", f"WITH {_PTS} SELECT gid, round(sum(x), 4) AS x, round(sum(y), 4) AS y FROM pt GROUP BY gid")
def _(spark, sf):
    return _points(spark, sf).groupBy("gid").agg(F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("y"), 4).alias("y"))


@query("egnn_coordinate_update", f"{_NEAR}, r AS (SELECT nr.gid, nr.i, (a.x-b.x) / (1 + dist*dist) AS dx, (a.y-b.y) / (1 + dist*dist) AS dy, (a.z-b.z) / (1 + dist*dist) AS dz FROM nr JOIN pt a ON a.id = nr.i JOIN pt b ON b.id = nr.j), m AS (SELECT gid, i, avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz FROM r GROUP BY gid, i) SELECT pt.gid, pt.id, round(x + coalesce(dx, 0), 5) + 0.0 AS x, round(y + coalesce(dy, 0), 5) + 0.0 AS y, round(z + coalesce(dz, 0), 5) + 0.0 AS z FROM pt LEFT JOIN m ON m.gid = pt.gid AND m.i = pt.id")
def _(spark, sf):
    return G.coordinate_update(_points(spark, sf), _near(spark, sf)).select("gid", "id", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


@query("fourier_features", f"{_NEAR} SELECT gid, i, j, round(sin(dist), 5) AS s1, round(cos(dist), 5) AS c1, round(sin(dist / 2), 5) AS s2, round(cos(dist / 2), 5) AS c2, round(dist / (1 + exp(-dist)), 5) AS silu FROM nr")
def _(spark, sf):
    d = F.col("dist")
    return _near(spark, sf).select("gid", "i", "j", F.round(F.sin(d), 5).alias("s1"), F.round(F.cos(d), 5).alias("c1"), F.round(F.sin(d / 2), 5).alias("s2"), F.round(F.cos(d / 2), 5).alias("c2"), F.round(d / (1 + F.exp(-d)), 5).alias("silu"))


@query("conformer_pair_distance", f"WITH {_PTS} SELECT a.gid, a.id AS i, b.id AS j, round(sqrt(pow(a.x-b.x,2) + pow(a.y-b.y,2) + pow(a.z-b.z,2)), 5) AS dist, (a.id % 4) * 4 + b.id % 4 AS pair_type FROM pt a JOIN pt b ON b.gid = a.gid")
def _(spark, sf):
    j = G.all_pairs(_points(spark, sf))
    d = F.sqrt(sum(((F.col(f"{c}i") - F.col(f"{c}j")) * (F.col(f"{c}i") - F.col(f"{c}j")) for c in "xyz"), F.lit(0.0)))
    return j.select("gid", "i", "j", F.round(d, 5).alias("dist"), (F.col("i") % 4 * 4 + F.col("j") % 4).alias("pair_type"))


# ---- self-supervision ----------------------------------------------------------------------------------------------------------
@query("dgi_corruption", f"WITH {V.SQL_NODES}, a AS (SELECT id, x0, x1, row_number() OVER (ORDER BY id) AS k FROM n), b AS (SELECT x0, x1, row_number() OVER (ORDER BY {draw_sql('id', '0', 61)}, id) AS k FROM n) SELECT a.id, b.x0, b.x1 FROM a JOIN b ON b.k = a.k")
def _(spark, sf):
    n = V.nodes(spark, sf)
    at = E.relabel(n.select("id"))
    key = n.select((draw(F.col("id"), 0, 61) * 10_000_000 + F.col("id")).alias("key"), F.get("x", 0).alias("x0"), F.get("x", 1).alias("x1"))
    order = E.relabel(key.select("key"), "key").select(F.col("id").alias("key"), "new_id")
    return at.join(order, "new_id").join(key, "key").select("id", "x0", "x1")


@query("dgi_summary", f"WITH {V.SQL_NODES} SELECT round(1 / (1 + exp(-avg(x0) / 100)), 6) AS s0, round(1 / (1 + exp(-avg(x1) / 100)), 6) AS s1 FROM n")
def _(spark, sf):
    return V.nodes(spark, sf).agg(*[r6(1 / (1 + F.exp(-F.avg(F.get("x", k)) / 100))).alias(f"s{k}") for k in (0, 1)])


@query("grace_views", f"{EDGES} SELECT src, dst, {draw_sql('src', 'dst', 71)} >= 200006 AS in_first, {draw_sql('src', 'dst', 72)} >= 400013 AS in_second FROM e")
def _(spark, sf):
    s, d = F.col("src"), F.col("dst")
    return V.session_edges(spark, sf).select("src", "dst", (draw(s, d, 71) >= 200_006).alias("in_first"), (draw(s, d, 72) >= 400_013).alias("in_second"))


@query("mvgrl_diffusion", f"{BASE}, {GCN}, {step('h1', 'a', 'f')}, {mix('o', [(0.2, 'f'), (0.16, 'h1')])}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM o) SELECT id, pos, round((v - lo) / (hi - lo), 5) AS v FROM o, b WHERE (v - lo) / (hi - lo) >= 0.1")
def _(spark, sf):
    n, e = V.nodes(spark, sf), V.session_edges(spark, sf)
    x = long_form(P.polynomial(P.hops(n, P.gcn_norm(e, n), 1, 2), [0.2, 0.16], 2))
    b = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    y = x.crossJoin(F.broadcast(b)).withColumn("s", (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return y.where("s >= 0.1").select("id", "pos", F.round("s", 5).alias("v"))


@query("hop_token_attention", f"{BASE}, {GCN}, {step('h1', 'a', 'f')}, t AS (SELECT id, 0 AS hop, max(CASE WHEN pos = 0 THEN v END) AS v FROM f GROUP BY id UNION ALL SELECT id, 1, max(CASE WHEN pos = 0 THEN v END) FROM h1 GROUP BY id) SELECT id, hop, round(exp(v / 50) / sum(exp(v / 50)) OVER (PARTITION BY id), 6) AS alpha FROM t")
def _(spark, sf):
    n, e = V.nodes(spark, sf), V.session_edges(spark, sf)
    t = P.hops(n, P.gcn_norm(e, n), 1, 2)
    rows = t[0].select("id", F.lit(0).alias("hop"), (F.get("x", 0) / 50).alias("score")).unionAll(t[1].select("id", F.lit(1), F.get("x", 0) / 50))
    return P.edge_softmax(rows, ("id",)).select("id", "hop", r6("alpha").alias("alpha"))


@query("logistic_probe")
def _(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = V.nodes(spark, sf).select("id", array_to_vector("x").alias("features"), (F.col("y") > 2).cast("double").alias("label"))
    return LogisticRegression(maxIter=5).fit(n).transform(n).select("id", "prediction")

