"""Queries for sparse kernels and convolution layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.functions.portable import dot, linear, long_form, r6, relu, scaled
from arcloom.operators import edges as E
from arcloom.operators import propagate as P
from arcloom.operators import sparse as S
from arcloom.plans import sqltext as T
from arcloom.plans.registry import query
from arcloom.plans.sqltext import BASE, EDGES, GCN, LAPLACIAN_SYM, mix, step
from arcloom.plans.sqltext import out as final
from arcloom.sources import views as V

W1, W2 = [[0.5, -0.25], [0.125, 1.0]], [[0.25, 0.5], [-0.5, 0.75]]


def _g(spark, sf):
    return V.nodes(spark, sf), V.session_edges(spark, sf)


def _out(df):
    return long_form(df).select("id", "pos", (r6("v") + 0.0).alias("v"))


# ---- sparse kernels ----------------------------------------------------------------------------------------------------
for _name, _key, _other in (("coo_to_csc", "dst", "src"), ("coo_to_csr", "src", "dst")):
    @query(_name, f"{EDGES}, c AS (SELECT n.id, count(e.src) AS cnt FROM n LEFT JOIN e ON e.{_key} = n.id GROUP BY n.id), o AS (SELECT id, coalesce(sum(cnt) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c) SELECT e.{_key} AS id, CAST(o.start + row_number() OVER (PARTITION BY e.{_key} ORDER BY e.{_other}) - 1 AS BIGINT) AS place, e.{_other} AS other, e.w FROM e JOIN o ON o.id = e.{_key}")
    def _(spark, sf, key=_key, other=_other):
        n, e = _g(spark, sf)
        return S.compressed(e, n, key, other)


@query("csc_to_csr_layer", f"{EDGES} SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place FROM e JOIN n a ON a.id = e.dst AND a.x0 <= 5 JOIN n b ON b.id = e.src AND b.x0 > 15")
def _(spark, sf):
    n, e = _g(spark, sf)
    return S.layer_csr(e, n.where("x[0] <= 5"), n.where("x[0] > 15"))


_SPMM = f"{BASE}, {step('h', 'e', 'f')} {final('h')}"
for _name in ("aggregate_with_weight", "spmm_coo", "message_passing_add"):
    @query(_name, _SPMM)
    def _(spark, sf):
        n, e = _g(spark, sf)
        return _out(P.spmm(n, e, 2))


@query("spmm_csr", _SPMM)
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.spmm_compressed(n, S.compressed(e, n, "dst", "src"), 2))


@query("dist_spmm", _SPMM)
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.spmm_blocks(n, e, 2, 4))


@query("propagate_nts", f"{BASE}, h0 AS (SELECT n.id, p.pos, coalesce(sum(e.w * x.v), 0) AS v FROM n CROSS JOIN {T.PLACES} LEFT JOIN e ON e.dst = n.id LEFT JOIN f x ON x.id = e.src AND x.pos = p.pos GROUP BY n.id, p.pos), h AS (SELECT id, pos, greatest(v - 20, 0) AS v FROM h0) {final('h')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.four_steps(n, e, 2, scaled, lambda x: relu(F.transform(x, lambda v: v - 20))))


@query("spmm_transpose", f"{BASE}, t AS (SELECT dst AS src, src AS dst, w FROM e), {step('h', 't', 'f')} {final('h')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.spmm(n, e, 2, transpose=False))


@query("message_passing_mean", f"{BASE}, h AS (SELECT n.id, p.pos, coalesce(avg(e.w * x.v), 0) AS v FROM n CROSS JOIN {T.PLACES} LEFT JOIN e ON e.dst = n.id LEFT JOIN f x ON x.id = e.src AND x.pos = p.pos GROUP BY n.id, p.pos) {final('h')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.propagate(n, e, 2, agg="mean"))


@query("message_passing_max", f"{BASE}, h AS (SELECT n.id, p.pos, coalesce(max(x.v - y.v), 0) AS v FROM n CROSS JOIN {T.PLACES} LEFT JOIN e ON e.dst = n.id LEFT JOIN f x ON x.id = e.src AND x.pos = p.pos LEFT JOIN f y ON y.id = e.dst AND y.pos = p.pos GROUP BY n.id, p.pos) {final('h')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.propagate(n, e, 2, lambda xj, xi, w: F.zip_with(xj, xi, lambda a, b: a - b), "max"))


_SOFT = f"{EDGES}, s AS (SELECT src, dst, w, (src * 7 + dst * 3) % 10 / 10.0 AS score FROM e)"


def _scored(spark, sf):
    return V.session_edges(spark, sf).withColumn("score", ((F.col("src") * 7 + F.col("dst") * 3) % 10) / F.lit(10.0))


@query("edge_softmax", f"{_SOFT} SELECT src, dst, round(exp(score - max(score) OVER (PARTITION BY dst)) / sum(exp(score)) OVER (PARTITION BY dst) * exp(max(score) OVER (PARTITION BY dst)), 6) AS alpha FROM s")
def _(spark, sf):
    return P.edge_softmax(_scored(spark, sf)).select("src", "dst", r6("alpha").alias("alpha"))


@query("edge_softmax_grad", f"{_SOFT}, a AS (SELECT src, dst, w, exp(score) / sum(exp(score)) OVER (PARTITION BY dst) AS y FROM s) SELECT src, dst, round(y * w - y * sum(y * w) OVER (PARTITION BY dst), 6) + 0.0 AS grad FROM a")
def _(spark, sf):
    y = P.edge_softmax(_scored(spark, sf))
    return S.softmax_gradient(y, "alpha", "w").select("src", "dst", (r6("grad") + 0.0).alias("grad"))


for _name, _end in (("scatter_to_edge_src", "src"), ("scatter_to_edge_dst", "dst")):
    @query(_name, f"{BASE} SELECT e.src, e.dst, f.pos, f.v FROM e JOIN f ON f.id = e.{_end}")
    def _(spark, sf, end=_end):
        n, e = _g(spark, sf)
        return long_form(S.to_edges(n, e, end), key=("src", "dst"))


for _name, _end in (("scatter_to_vertex_dst", "dst"), ("scatter_to_vertex_src", "src")):
    @query(_name, f"{EDGES} SELECT n.id, 0 AS pos, coalesce(sum(e.w), 0) AS v FROM n LEFT JOIN e ON e.{_end} = n.id GROUP BY n.id UNION ALL SELECT n.id, 1, coalesce(sum(CAST(e.src % 5 AS DOUBLE)), 0) FROM n LEFT JOIN e ON e.{_end} = n.id GROUP BY n.id")
    def _(spark, sf, end=_end):
        n, e = _g(spark, sf)
        return long_form(S.to_vertices(e.withColumn("x", F.array("w", (F.col("src") % 5).cast("double"))), n, 2, end))


for _name, _a, _b in (("in_neighbours", "dst", "src"), ("out_neighbours", "src", "dst")):
    @query(_name, f"{EDGES} SELECT e.{_a} AS id, e.{_b} AS neighbour FROM e JOIN n ON n.id = e.{_a} WHERE n.x0 = 1")
    def _(spark, sf, a=_a, b=_b):
        n, e = _g(spark, sf)
        return S.neighbours(e, n.where("x[0] = 1"), a, b)


@query("layer_weights", f"{EDGES} SELECT src, dst, round(1 / (sqrt(count(*) OVER (PARTITION BY src)) * sqrt(count(*) OVER (PARTITION BY dst))), 6) AS weight FROM e")
def _(spark, sf):
    return S.layer_weights(V.session_edges(spark, sf)).select("src", "dst", r6("weight").alias("weight"))


@query("sample_sizes", f"{EDGES} SELECT n.id, least(count(e.src), 15) AS size FROM n LEFT JOIN e ON e.dst = n.id GROUP BY n.id")
def _(spark, sf):
    n, e = _g(spark, sf)
    return E.degree(e, n).select("id", F.least("deg", F.lit(15)).alias("size"))


@query("repeat_interleave", "SELECT p_partkey AS id, CAST(k AS INTEGER) AS k FROM part, unnest(range(p_size % 4)) t(k)")
def _(spark, sf):
    return S.repeat_interleave(V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("times")), "times").select("id", "k")


# ---- normalisations and layers ------------------------------------------------------------------------------------------
@query("gcn_norm", f"{BASE}, {GCN} SELECT src, dst, round(w, 6) AS w FROM a")
def _(spark, sf):
    n, e = _g(spark, sf)
    return P.gcn_norm(e, n).select("src", "dst", r6("w").alias("w"))


_SAGE = "d2 AS (SELECT dst, sum(w) AS d FROM e GROUP BY dst), sn AS (SELECT e.src, e.dst, e.w / d2.d AS w FROM e JOIN d2 ON d2.dst = e.dst)"


@query("sage_norm", f"{EDGES}, {_SAGE} SELECT src, dst, round(w, 6) AS w FROM sn")
def _(spark, sf):
    return P.sage_norm(V.session_edges(spark, sf)).select("src", "dst", r6("w").alias("w"))


_CLUSTER = T.LOOPED + ", dc AS (SELECT dst AS id, sum(w) AS d FROM lo GROUP BY dst), cl AS (SELECT lo.src, lo.dst, lo.w / dc.d * CASE WHEN lo.src = lo.dst THEN 1.5 ELSE 1 END AS w FROM lo JOIN dc ON dc.id = lo.src)"


@query("clustergcn_norm", f"{EDGES}, {_CLUSTER} SELECT src, dst, round(w, 6) AS w FROM cl")
def _(spark, sf):
    n, e = _g(spark, sf)
    return P.cluster_norm(e, n, 0.5).select("src", "dst", r6("w").alias("w"))


_GCN_CONV = f"{BASE}, {GCN}, {T.linear('xw', 'f', W1)}, {step('h', 'a', 'xw')}, o AS (SELECT id, pos, v + CASE pos WHEN 0 THEN 0.1 ELSE -0.2 END AS v FROM h) {final('o')}"
for _name in ("gcn_conv", "gcn_acl_conv"):
    @query(_name, _GCN_CONV)
    def _(spark, sf):
        n, e = _g(spark, sf)
        return _out(P.gcn_conv(n, e, W1, [0.1, -0.2]))


@query("tensor_parallel_gcn", _GCN_CONV)
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.gcn_conv_columns(n, e, W1, [0.1, -0.2], 2))


@query("sg_conv", f"{BASE}, {GCN}, {step('h1', 'a', 'f')}, {step('h2', 'a', 'h1')}, {T.linear('o', 'h2', W1, [0.1, -0.2])} {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.sg_conv(n, e, 2, W1, [0.1, -0.2]))


@query("appnp", f"{BASE}, {GCN}, {step('h1', 'a', 'f')}, {mix('x1', [(0.9, 'h1'), (0.1, 'f')])}, {step('h2', 'a', 'x1')}, {mix('x2', [(0.9, 'h2'), (0.1, 'f')])} {final('x2')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.appnp(n, e, 2, 0.1, 2))


_H3 = f"{step('h1', 'a', 'f')}, {step('h2', 'a', 'h1')}, {step('h3', 'a', 'h2')}"


def _poly(c):
    return mix("o", [(v, t) for v, t in zip(c, ("f", "h1", "h2", "h3"), strict=False) if v])


for _name, _kind in (("gprgnn_ppr", "PPR"), ("gprgnn_nppr", "NPPR")):
    @query(_name, f"{BASE}, {GCN}, {_H3}, {_poly(P.gpr_coefficients(_kind, 0.2, 3))} {final('o')}")
    def _(spark, sf, kind=_kind):
        n, e = _g(spark, sf)
        return _out(P.gprgnn(n, e, 3, 0.2, 2, kind))


@query("even_net", f"{BASE}, {GCN}, {_H3}, {_poly([v if i % 2 == 0 else 0 for i, v in enumerate(P.gpr_coefficients('PPR', 0.2, 3))])} {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.even_net(n, e, 3, 0.2, 2))


_REST = LAPLACIAN_SYM + ", rest AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, -w AS w FROM lap UNION ALL SELECT id, id, 2.0 FROM n) GROUP BY src, dst)"
_THETA = [1.0, 0.5, 0.25]


@query("bernstein_filter", f"{BASE}, {_REST}, {step('r1', 'rest', 'f')}, {step('r2', 'rest', 'r1')}, {step('l1r1', 'lap', 'r1')}, {step('l1', 'lap', 'f')}, {step('l2', 'lap', 'l1')}, {mix('o', [(0.25, 'r2'), (0.25, 'l1r1'), (0.0625, 'l2')])} {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.bernstein(n, e, _THETA, 2))


_SCALED = LAPLACIAN_SYM + ", sl AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM lap UNION ALL SELECT id, id, -1.0 FROM n) GROUP BY src, dst)"
_CHEB = f"{BASE}, {_SCALED}, {step('t1', 'sl', 'f')}, {step('s2', 'sl', 't1')}, {mix('t2', [(2.0, 's2'), (-1.0, 'f')])}"


@query("cheb_conv", f"{_CHEB}, {mix('o', [(0.5, 'f'), (0.25, 't1'), (0.125, 't2')])} {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.cheb_conv(n, e, [0.5, 0.25, 0.125], 2))


_VALUES = [1.0, 0.5, 0.0]


for _name, _values in (("chebnet2", _VALUES), ("polygcl_low_pass", [1.0, 0.6, 0.2]), ("polygcl_high_pass", [0.2, 0.6, 1.0])):
    @query(_name, f"{_CHEB}, {mix('o', list(zip(P.interpolation_coefficients(_values), ('f', 't1', 't2'), strict=True)))} {final('o')}")
    def _(spark, sf, values=_values):
        n, e = _g(spark, sf)
        return _out(P.chebnet2(n, e, values, 2))


@query("opt_basis")
def _(spark, sf):
    n, e = _g(spark, sf)
    basis = P.opt_basis(n, e, 2, 2)
    out = _out(basis[0]).withColumn("order", F.lit(0))
    for k, b in enumerate(basis[1:], 1):
        out = out.unionAll(_out(b).withColumn("order", F.lit(k)))
    return out


@query("sage_conv", f"{BASE}, m AS (SELECT n.id, p.pos, coalesce(avg(x.v), 0) AS v FROM n CROSS JOIN {T.PLACES} LEFT JOIN e ON e.dst = n.id LEFT JOIN f x ON x.id = e.src AND x.pos = p.pos GROUP BY n.id, p.pos), {T.linear('a1', 'm', W1, [0.1003, -0.2007])}, {T.linear('a2', 'f', W2)}, {mix('o', [(1.0, 'a1'), (1.0, 'a2')])} SELECT id, CAST(pos AS INTEGER) AS pos, round(v, 3) + 0.0 AS v FROM o")
def _(spark, sf):
    n, e = _g(spark, sf)
    return long_form(P.sage_conv(n, e, W1, W2, [0.1003, -0.2007])).select("id", "pos", (F.round("v", 3) + 0.0).alias("v"))


@query("clustergcn_conv", f"{BASE}, {_CLUSTER}, {step('h', 'cl', 'f')}, {T.linear('a1', 'h', W1)}, {T.linear('a2', 'f', W2)}, {mix('o', [(1.0, 'a1'), (1.0, 'a2')])} {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.cluster_gcn_conv(n, e, 0.5, W1, W2))


@query("gat_conv", f"{BASE}, {T.linear('q', 'f', W1)}, hv AS (SELECT id, greatest(max(CASE WHEN pos = 0 THEN v END), 0) / 10 * 10 AS a, greatest(max(CASE WHEN pos = 1 THEN v END), 0) AS b FROM q GROUP BY id), s AS (SELECT e.src, e.dst, j.a, j.b, 0.03 * j.a - 0.02 * j.b + 0.01 * i.a + 0.04 * i.b AS r FROM e JOIN hv j ON j.id = e.src JOIN hv i ON i.id = e.dst), l AS (SELECT *, CASE WHEN r > 0 THEN r ELSE 0.2 * r END AS sc FROM s), x AS (SELECT *, exp(sc - max(sc) OVER (PARTITION BY dst)) AS ex FROM l), al AS (SELECT dst, a, b, ex / sum(ex) OVER (PARTITION BY dst) AS w FROM x), o AS (SELECT n.id, 0 AS pos, coalesce(sum(w * a), 0) AS v FROM n LEFT JOIN al ON al.dst = n.id GROUP BY n.id UNION ALL SELECT n.id, 1, coalesce(sum(w * b), 0) FROM n LEFT JOIN al ON al.dst = n.id GROUP BY n.id) {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.gat_conv(n, e, W1, [0.03, -0.02], [0.01, 0.04]))


@query("gcn2_conv", f"{BASE}, {GCN}, {step('h', 'a', 'f')}, {T.linear('l1', 'h', W1)}, {T.linear('l2', 'f', W2)}, {mix('o', [(0.7 * 0.9, 'h'), (0.3, 'l1'), (0.7 * 0.1, 'f'), (0.3, 'l2')])} {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.gcn2_conv(n, e, 0.1, 0.3, W1, W2))


@query("lightgcn_conv", f"{BASE}, {GCN}, {step('h', 'a', 'f')} {final('h')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.propagate(n, P.gcn_norm(e, n), 2))


_WQ, _WK = [[0.02, 0.01], [0.03, -0.02]], [[0.01, 0.02], [-0.01, 0.03]]


@query("transformer_conv", f"{BASE}, {T.linear('q', 'f', _WQ)}, {T.linear('k', 'f', _WK)}, {T.linear('vv', 'f', W1)}, s AS (SELECT e.src, e.dst, sum(q.v * k.v) / sqrt(2.0) AS sc FROM e JOIN q ON q.id = e.dst JOIN k ON k.id = e.src AND k.pos = q.pos GROUP BY e.src, e.dst), x AS (SELECT *, exp(sc - max(sc) OVER (PARTITION BY dst)) AS ex FROM s), al AS (SELECT src, dst, ex / sum(ex) OVER (PARTITION BY dst) AS w FROM x), {step('o', 'al', 'vv')} {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.transformer_conv(n, e, _WQ, _WK, W1, 2))


@query("srgnn_conv", f"{BASE}, r1 AS (SELECT src, dst, 1.0 AS w FROM e), r2 AS (SELECT dst AS src, src AS dst, 1.0 AS w FROM e), {step('i1', 'r1', 'f')}, {step('o1', 'r2', 'f')} SELECT id, CAST(pos AS INTEGER) AS pos, round(v, 6) AS v FROM i1 UNION ALL SELECT id, CAST(pos + 2 AS INTEGER), round(v, 6) FROM o1")
def _(spark, sf):
    n, e = _g(spark, sf)
    ones = e.select("src", "dst", F.lit(1.0).alias("w"))
    into, out = P.spmm(n, ones, 2), P.spmm(n, ones, 2, transpose=False)
    return _out(into.join(out.select("id", F.col("x").alias("y")), "id").select("id", F.concat("x", "y").alias("x")))


@query("compute_ppr", f"{BASE}, eu AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY src, dst), {GCN.replace('FROM e ', 'FROM eu ')}, {_H3}, {mix('o', [(0.2 * 0.8**i, t) for i, t in enumerate(('f', 'h1', 'h2', 'h3'))])} {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    return _out(P.ppr(n, e, 0.2, 3, 2))


for _name in ("hop_tokens", "polyformer_monomial"):
    @query(_name, f"{BASE}, {GCN}, {step('h1', 'a', 'f')}, {step('h2', 'a', 'h1')}, o AS (SELECT id, pos, v FROM f UNION ALL SELECT id, pos + 2, v FROM h1 UNION ALL SELECT id, pos + 4, v FROM h2) {final('o')}")
    def _(spark, sf):
        n, e = _g(spark, sf)
        t = P.hops(n, P.gcn_norm(e, n), 2, 2)
        whole = t[0].unionAll(t[0].limit(0))
        for k, x in enumerate(t[1:], 1):
            whole = whole.join(x.select("id", F.col("x").alias(f"x{k}")), "id")
        return _out(whole.select("id", F.concat("x", *[f"x{k}" for k in range(1, len(t))]).alias("x")))


@query("polyformer_chebyshev", f"{_CHEB}, o AS (SELECT id, pos, v FROM f UNION ALL SELECT id, pos + 2, v FROM t1 UNION ALL SELECT id, pos + 4, v FROM t2) {final('o')}")
def _(spark, sf):
    n, e = _g(spark, sf)
    basis = P.chebyshev_basis(n, P.scaled_laplacian(e, n), 2, 2)
    whole = basis[0]
    for k, x in enumerate(basis[1:], 1):
        whole = whole.join(x.select("id", F.col("x").alias(f"x{k}")), "id")
    return _out(whole.select("id", F.concat("x", "x1", "x2").alias("x")))


@query("linear_attention", f"{BASE}, c AS (SELECT sqrt(sum(v * v)) AS z, (SELECT count(*) FROM n) AS cnt FROM f), k AS (SELECT id, pos, v / z AS v FROM f, c), kv AS (SELECT a.pos AS p, b.pos AS q, sum(a.v * b.v) AS s FROM k a JOIN f b ON b.id = a.id GROUP BY a.pos, b.pos), ks AS (SELECT pos, sum(v) AS s FROM k GROUP BY pos), num AS (SELECT k.id, kv.q AS pos, sum(k.v * kv.s) AS v FROM k JOIN kv ON kv.p = k.pos GROUP BY k.id, kv.q), den AS (SELECT k.id, sum(k.v * ks.s) AS v FROM k JOIN ks ON ks.pos = k.pos GROUP BY k.id), o AS (SELECT f.id, f.pos, (num.v + cnt * f.v) / (den.v + cnt) AS v FROM f JOIN num ON num.id = f.id AND num.pos = f.pos JOIN den ON den.id = f.id, c) {final('o')}")
def _(spark, sf):
    return _out(S.linear_attention(V.nodes(spark, sf), 2))


@query("mlp_forward", f"{BASE}, {T.linear('a1', 'f', W1, [0.1, -0.2])}, r AS (SELECT id, pos, greatest(v, 0.0) AS v FROM a1), {T.linear('o', 'r', W2)} {final('o')}")
def _(spark, sf):
    return _out(P.mapped(V.nodes(spark, sf), lambda x: linear(relu(linear(x, W1, [0.1, -0.2])), W2)))


@query("merge_predictor", f"{BASE}, j AS (SELECT e.src, e.dst, a.x0, a.x1, b.x0 AS y0, b.x1 AS y1 FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst) SELECT src, dst, round(greatest(0.5 * x0 + 0.25 * y0, 0) - greatest(0.125 * x1 - y1, 0), 6) AS score FROM j")
def _(spark, sf):
    n, e = _g(spark, sf)
    j = e.join(n.select(F.col("id").alias("src"), F.col("x").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst")
    h = relu(linear(F.concat("a", "b"), [[0.5, 0.0], [0.0, 0.125], [0.25, 0.0], [0.0, -1.0]]))
    return j.select("src", "dst", r6(F.get(h, 0) - F.get(h, 1)).alias("score"))


@query("edge_score_bce", f"{EDGES}, s AS (SELECT e.src, (a.x0 * b.x0 + a.x1 * b.x1) / 1000.0 AS s, e.w > 1 AS y FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst) SELECT count(*) AS n, round(avg(CASE WHEN y THEN -ln(1 / (1 + exp(-s))) ELSE -ln(1 - 1 / (1 + exp(-s))) END), 6) AS loss FROM s")
def _(spark, sf):
    n, e = _g(spark, sf)
    j = e.join(n.select(F.col("id").alias("src"), F.col("x").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst")
    p = 1 / (1 + F.exp(-dot(F.col("a"), F.col("b")) / 1000.0))
    return j.agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("w") > 1, -F.log(p)).otherwise(-F.log(1 - p)))).alias("loss"))

