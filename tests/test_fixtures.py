"""Small graphs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from arcloom.operators import batching, geometry, propagate, sampling, scatter, sparse, temporal
from arcloom.operators import edges as E


def edges(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], "src long, dst long, w double")


def nodes(spark, xs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "id long, x array<double>")


def vectors(df):
    return {r["id"]: [round(v, 6) for v in r["x"]] for r in df.collect()}


F1 = [(0, 1, 1), (0, 2, 2), (1, 2, 3), (1, 3, 4), (2, 3, 5)]


def test_compressed_rows(spark):
    e, n = edges(spark, F1), spark.range(4)
    csr = sorted((r["place"], r["other"], r["w"]) for r in sparse.compressed(e, n, "src", "dst").collect())
    assert csr == [(0, 1, 1), (1, 2, 2), (2, 2, 3), (3, 3, 4), (4, 3, 5)]
    csc = sorted((r["place"], r["other"], r["w"]) for r in sparse.compressed(e, n, "dst", "src").collect())
    assert csc == [(0, 0, 1), (1, 0, 2), (2, 1, 3), (3, 1, 4), (4, 2, 5)]
    deg = E.degree(e, n, "src")
    assert [r["start"] for r in sparse.offsets(deg).orderBy("id").collect()] == [0, 2, 4, 5]


def test_undirected(spark):
    got = sorted((r["src"], r["dst"], r["w"]) for r in E.to_undirected(edges(spark, [(0, 2, 1), (1, 0, 3), (1, 2, 2)])).collect())
    assert got == [(0, 1, 3), (0, 2, 1), (1, 0, 3), (1, 2, 2), (2, 0, 1), (2, 1, 2)]


def test_edge_softmax(spark):
    e = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0), (2, 2, 4.0)], "src long, dst long, score double")
    got = {(r["src"], r["dst"]): round(r["alpha"], 6) for r in propagate.edge_softmax(e).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.268941, (1, 1): 0.731059, (2, 2): 1.0}


def test_edges_to_vertices(spark):
    e = spark.createDataFrame([(0, 0, [1.0] * 3), (0, 1, [2.0] * 3), (1, 1, [3.0] * 3), (2, 2, [3.0, 2.0, 1.0])], "src long, dst long, x array<double>")
    assert vectors(sparse.to_vertices(e, spark.range(3), 3)) == {0: [1, 1, 1], 1: [5, 5, 5], 2: [3, 2, 1]}


def test_spmm(spark):
    e = edges(spark, [(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 1, 1)])
    assert vectors(propagate.spmm(nodes(spark, [(3, 2, 1), (4, 2, 2), (1, 2, 3)]), e, 3)) == {0: [0, 0, 0], 1: [4, 4, 4], 2: [7, 4, 3]}
    e = edges(spark, [(0, 0, 3), (0, 1, 1), (1, 1, 4), (2, 2, 2)])
    assert vectors(propagate.spmm(nodes(spark, [(3, 2, 1)] * 3), e, 3)) == {0: [9, 6, 3], 1: [15, 10, 5], 2: [6, 4, 2]}


def test_neighbours_repeat(spark):
    e = edges(spark, [(0, 0, 1), (3, 0, 1), (1, 1, 1), (4, 1, 1), (0, 2, 1), (4, 3, 1), (2, 4, 1)])
    listed = spark.createDataFrame([(1,), (2,), (2,), (4,)], "id long")
    got = sorted((r["id"], r["neighbour"]) for r in sparse.neighbours(e, listed, "dst", "src").collect())
    assert got == [(1, 1), (1, 4), (2, 0), (2, 0), (4, 2)]


def test_layer_weights(spark):
    got = {(r["src"], r["dst"]): round(r["weight"], 6) for r in sparse.layer_weights(edges(spark, [(0, 0, 1), (0, 1, 1), (1, 2, 1), (2, 3, 1)])).collect()}
    assert got == {(0, 0): 0.707107, (0, 1): 0.707107, (1, 2): 1.0, (2, 3): 1.0}


def test_fan_out_keeps_true_neighbours(spark):
    e = edges(spark, [(s, d, 1) for d in range(4) for s in range(10) if s != d and s % (d + 1) == 0])
    got = sampling.fan_out(e, spark.range(4), 3, 5).collect()
    real = {(r["src"], r["dst"]) for r in e.collect()}
    assert {(r["src"], r["dst"]) for r in got} <= real and len({*got}) == len(got)
    deg = {r["id"]: r["deg"] for r in E.degree(e, spark.range(4)).collect()}
    for d in range(4):
        assert sum(r["dst"] == d for r in got) == min(3, deg[d])


def test_event_subgraphs_and_layers(spark):
    rows = [(0, 0, 1, 0), (1, 1, 2, 1), (2, 2, 3, 2), (3, 4, 5, 3), (4, 3, 1, 4)]
    ev = spark.createDataFrame(rows, "event_id long, src long, dst long, t long")
    sub = None
    for k in range(5):  # the adjacency grows with the events
        start = ev.where(f"event_id = {k}").select("event_id", F.explode(F.array("src", "dst")).alias("node"))
        one = temporal.frontier(start, ev.where(f"event_id <= {k}"), 1)
        sub = one if sub is None else sub.unionAll(one)
    got: dict = {}
    for r in sub.collect():
        got.setdefault(r["event_id"], set()).add(r["node"])
    assert got == {0: {0, 1}, 1: {0, 1, 2}, 2: {1, 2, 3}, 3: {4, 5}, 4: {0, 1, 2, 3}}
    deps = temporal.dependencies(ev, sub)
    assert {(r[0], r[1]) for r in deps.collect()} == {(0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)}
    assert {r["event_id"]: r["layer"] for r in temporal.layers(ev, deps).collect()} == {0: 0, 3: 0, 1: 1, 2: 2, 4: 3}


def test_invariants(spark):
    e, n = edges(spark, F1), nodes(spark, [(1, 2), (3, 4), (5, 6), (7, 8)])
    assert E.degree(e, n).agg(F.sum("deg")).first()[0] == len(F1)
    once = E.coalesce(e)
    assert sorted(once.collect()) == sorted(E.coalesce(once).collect())
    both = {(r["src"], r["dst"]): round(r["w"], 9) for r in propagate.gcn_norm(E.to_undirected(e), n).collect()}
    assert all(both[b, a] == w for (a, b), w in both.items())
    through = sparse.to_vertices(sparse.to_edges(n, e, "src").join(e, ["src", "dst"]).select("src", "dst", F.transform("x", lambda v: v * F.col("w")).alias("x")), n, 2)
    assert vectors(through) == vectors(propagate.spmm(n, e, 2))


def test_segments_and_dense(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], "place long, v double")
    ptr = spark.createDataFrame([(0, 0, 4), (1, 4, 4), (2, 4, 10)], "id long, start long, end long")
    assert {r["id"]: r["value"] for r in scatter.segment(rows, ptr, "place", "v").collect()} == {0: 6.0, 1: 0.0, 2: 39.0}
    d = spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0), (2, 1, 9.0)], "g long, o long, v double")
    assert vectors(scatter.to_dense(d, "g", "o", "v", 3)) == {1: [4, 5, 0], 2: [9, 0, 0]}


def test_recent_is_strict(spark):
    adj = spark.createDataFrame([(1, 10, 5, 1), (1, 11, 6, 2), (1, 12, 6, 3), (1, 13, 7, 4)], "node long, other long, t long, eid long")
    q = spark.createDataFrame([(100, 1, 6), (101, 1, 7), (102, 1, 5), (103, 9, 9)], "qid long, node long, t long")
    got = {(r["qid"], r["rank"]): r["other"] for r in temporal.recent(q, adj, 2).collect()}
    assert got == {(100, 1): 10, (101, 1): 12, (101, 2): 11}
    padded = {r["qid"]: r["neighbours"] for r in temporal.padded(temporal.recent(q, adj, 2), q, 2).collect()}
    assert padded == {100: [0, 10], 101: [11, 12], 102: [0, 0], 103: [0, 0]}


def test_batches(spark):
    n = spark.createDataFrame([(0, 0), (0, 1), (2, 0), (2, 1), (2, 2)], "gid long, local long")
    e = spark.createDataFrame([(0, 0, 1), (2, 1, 2)], "gid long, src long, dst long")
    _, joined, start = batching.disjoint_union(n, e)
    assert sorted((r["src"], r["dst"]) for r in joined.collect()) == [(0, 1), (3, 4)]
    assert [(r["src"], r["dst"]) for r in batching.unbatched(joined, start, 2).collect()] == [(1, 2)]


def test_torsion_and_angle(spark):
    one = spark.range(1)
    v = lambda *x: [F.lit(float(a)) for a in x]
    r = one.select(geometry.angle(v(1, 0, 0), v(0, 1, 0)).alias("a"), geometry.torsion(v(1, 0, 0), v(0, 1, 0), v(0, 0, 1)).alias("t")).first()
    assert r["a"] == pytest.approx(1.5707963) and 0 <= r["t"] < 6.2831854
