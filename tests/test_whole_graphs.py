"""Queries over whole graphs, samplers and memories against brute force."""

from collections import defaultdict

import pytest

from arcloom.plans import catalog


@pytest.fixture(scope="module")
def events(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "value").collect()
    return sorted((r[0], r[1], r[2], 900_000 + int(r[3] // 1) % 40) for r in rows)


def test_events_meet_across_batches(spark, sf, events):
    near = defaultdict(set)
    for _, _, u, v in events:
        near[u].add(v)
        near[v].add(u)
    sub = {i: {u, v} | near[u] | near[v] for i, _, u, v in events}
    got = catalog.QUERIES["event_subgraph"](spark, sf).collect()
    assert len(got) == sum(map(len, sub.values())) and all(r["node"] in sub[r["event_id"]] for r in got)
    matrix = [(r["src"], r["dst"], r["s"]) for r in catalog.QUERIES["attention_matrix_init"](spark, sf).collect()]
    assert sorted(matrix) == sorted((u, v, round(1 / len(near[u]), 6)) for u in near if u < 900_000 for v in near[u])
    before = {(a[0], b[0]) for b in events for a in events if a[0] // 50 == b[0] // 50 and a[1] < b[1] and {a[2], a[3]} & sub[b[0]]}
    deps = [(r["before_id"], r["after_id"]) for r in catalog.QUERIES["event_dependencies"](spark, sf).collect()]
    assert sorted(deps) == sorted(before)
    layer = {}
    for i, *_ in sorted(events, key=lambda e: e[1]):
        layer[i] = max((layer[a] + 1 for a, b in before if b == i), default=0)
    assert {r["event_id"]: r["layer"] for r in catalog.QUERIES["execution_layers"](spark, sf).collect()} == layer


def test_paths_of_any_length(spark, sf):
    from arcloom.plans.structure_plans import _small

    out = defaultdict(lambda: defaultdict(set))
    for r in _small(spark, sf).collect():
        out[r["gid"]][r["src"]].add(r["dst"])
    dist, cost = {}, {}
    for g, nodes in out.items():
        for s in {*nodes, *(x for v in nodes.values() for x in v)}:
            dist[g, s, s], cost[g, s, s], level = 0, 0.0, [s]
            while level:
                before = defaultdict(list)
                for u in level:
                    for v in nodes.get(u, ()):
                        if (g, s, v) not in dist:
                            before[v].append(u)
                for v, us in before.items():
                    dist[g, s, v] = dist[g, s, us[0]] + 1
                    cost[g, s, v] = cost[g, s, min(us)] + (min(us) * 3 + v) % 5
                level = list(before)
    assert max(dist.values()) > 4
    got = catalog.QUERIES["all_pairs_shortest_paths"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((*k, d) for k, d in dist.items())
    far = {k: d for k, d in dist.items() if d}
    bias = catalog.QUERIES["spatial_encoding"](spark, sf).collect()
    assert sorted(map(tuple, bias)) == sorted((*k, 0.5 ** min(d, 3)) for k, d in far.items())
    edge = catalog.QUERIES["edge_encoding"](spark, sf).collect()
    assert {tuple(r)[:3]: r["c"] for r in edge} == {k: pytest.approx(cost[k] / d, abs=1e-6) for k, d in far.items()} and len(edge) == len(far)


def test_vocabulary_has_every_symbol(spark, tmp_path):
    rows = spark.range(1400).selectExpr("id AS l_orderkey", "cast(1 AS int) AS k").crossJoin(spark.range(2).selectExpr("cast(id AS int) AS l_linenumber"))
    rows = rows.selectExpr("l_orderkey", "l_linenumber", "(l_orderkey + l_linenumber * 13) % 900 AS l_partkey", "l_orderkey AS l_suppkey", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "0.0D AS l_discount")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    from arcloom.sources import views

    count = defaultdict(int)
    for r in views.session_rows(spark, str(tmp_path)).collect():
        count[r["dst"]] += 1
    want = [(s, n, i + 3) for i, (s, n) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0])))]
    assert len(want) > 500
    got = catalog.QUERIES["walk_corpus_vocabulary"](spark, str(tmp_path)).select("symbol", "cnt", "idx").collect()
    assert sorted(map(tuple, got), key=lambda x: x[2]) == want


def test_negatives_are_whole_for_users_of_many_items(spark):
    from arcloom.operators import sampling

    items = spark.range(1, 41).withColumnRenamed("id", "item_id")
    have = [(1, i) for i in range(1, 38)] + [(2, 5)] + [(3, i) for i in range(1, 41)]
    own = {u: {i for v, i in have if v == u} for u in (1, 2, 3)}
    got = sampling.negatives(spark.createDataFrame(have, "user_id long, item_id long"), items, 4, 6).collect()
    by = defaultdict(list)
    for r in got:
        by[r["user_id"], r["item_id"]].append(r["neg"])
    assert all(not own[u] & {*n} and len({*n}) == len(n) for (u, _), n in by.items())
    assert all(len(by[1, i]) == 3 for i in own[1]) and len(by[2, 5]) == 4 and not any(u == 3 for u, _ in by)


def test_missing_pairs_end_where_there_are_no_more(spark):
    from arcloom.operators import sampling

    edges = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if (a + b) % 3], "src long, dst long")
    left = {(a, b) for a in range(5) for b in range(5) if a != b and (a + b) % 3 == 0}
    got = [tuple(r) for r in sampling.missing_pairs(edges, spark.range(5), 1000, 31).collect()]
    assert sorted(got) == sorted(left)
    assert len(sampling.missing_pairs(edges, spark.range(5), 3, 31).collect()) == 3


def test_paths_of_branching_graphs(spark):
    import random

    from arcloom.operators.batching import shortest_paths

    rng = random.Random(5)
    edges = {(g, rng.randrange(14), rng.randrange(14)) for g in range(6) for _ in range(22)}
    want = {}
    for g in range(6):
        nodes = {x for e in edges if e[0] == g for x in e[1:]}
        for s in nodes:
            found, level, d = {s: (0, None, 0.0)}, [s], 0
            while level:
                d += 1
                fresh = {v for u in level for h, a, v in edges if h == g and a == u and v not in found}
                parent = {v: min(u for u in level if (g, u, v) in edges) for v in fresh}
                found |= {v: (d, u, found[u][2] + (u * 3 + v) % 5) for v, u in parent.items()}
                level = list(fresh)
            want |= {(g, s, t): r for t, r in found.items()}
    rows = shortest_paths(spark.createDataFrame(sorted(edges) * 2, "gid long, src long, dst long"), lambda a, b: (a * 3 + b) % 5).collect()
    assert len(rows) == len(want) and {(r["gid"], r["s"], r["t"]): (r["dist"], r["parent"], r["c"]) for r in rows} == want
    assert max(r[0] for r in want.values()) > 3
    assert shortest_paths(spark.createDataFrame([], "gid long, src long, dst long")).count() == 0


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Events of users whose ids pass a million, at 40 hubs and among each other; brute force of what is near."""
    import random

    rng = random.Random(3)
    ids = [*range(12), *range(1_000_000, 1_000_012), *range(900_000, 900_006)]
    rows = [(i, rng.choice(ids), float(rng.randrange(60)), rng.randrange(90)) for i in range(260)]
    at = str(tmp_path_factory.mktemp("far"))
    spark.createDataFrame(rows, "event_id long, user_id long, value double, s long").selectExpr("event_id", "user_id", "value", "timestamp_seconds(s) AS ts").write.parquet(f"{at}/events.parquet")
    events = [(i, s, u, 900_000 + int(v) % 40) for i, u, v, s in rows]
    near = defaultdict(set)
    for _, _, u, v in events:
        near[u].add(v)
        near[v].add(u)
    return at, events, {i: {u, v} | near[u] | near[v] for i, _, u, v in events}


def test_dependencies_of_large_ids(spark, far):
    at, events, sub = far
    before = {(a[0], b[0]) for b in events for a in events if a[0] // 50 == b[0] // 50 and a[1] < b[1] and {a[2], a[3]} & sub[b[0]]}
    got = [tuple(r) for r in catalog.QUERIES["event_dependencies"](spark, at).select("before_id", "after_id").collect()]
    assert sorted(got) == sorted(before)


def test_layers_of_large_ids(spark, far):
    at, events, sub = far
    layer = {}
    for b in sorted(events, key=lambda e: e[1]):
        layer[b[0]] = max((layer[a[0]] + 1 for a in events if a[0] // 50 == b[0] // 50 and a[1] < b[1] and {a[2], a[3]} & sub[b[0]]), default=0)
    assert {r["event_id"]: r["layer"] for r in catalog.QUERIES["execution_layers"](spark, at).collect()} == layer


def test_subgraphs_by_runs(spark, far, monkeypatch):
    from arcloom.operators import temporal

    monkeypatch.setattr(temporal, "NEAR_RUN", 3)
    at, events, sub = far
    got = catalog.QUERIES["event_subgraph"](spark, at).collect()
    assert sorted((r["event_id"], r["node"]) for r in got) == sorted((i, n) for i, s in sub.items() for n in s)


@pytest.mark.parametrize("listed", [2, 1024])
def test_transitions_from_nodes_of_many_successors(spark, monkeypatch, listed):
    import random

    from arcloom.operators import sampling

    monkeypatch.setattr(sampling, "LISTED", listed)
    rng = random.Random(7)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(40)}
    want = {}
    for a, b in edges:
        w = {c: 2.0 if c == a else 1.0 if (a, c) in edges else 0.5 for x, c in edges if x == b}
        want |= {(a, b, c): v / sum(w.values()) for c, v in w.items()}
    got = sampling.second_order_weights(spark.createDataFrame(sorted(edges), "src long, dst long"), 0.5, 2.0).collect()
    assert {tuple(r)[:3]: r["prob"] for r in got} == pytest.approx(want) and len(got) == len(want)


def test_missing_pairs_are_cut_without_one_sort(spark):
    from arcloom.operators import sampling

    edges = spark.createDataFrame([(a, (a * 7 + j) % 60) for a in range(60) for j in range(1, 6)], "src long, dst long")
    df = sampling.missing_pairs(edges, spark.range(60), 300, 31)
    assert df.count() == 300 and "Limit" not in df._jdf.queryExecution().toString()
    ts = spark.createDataFrame([(t * t,) for t in range(50)], "t long")
    assert [sampling._bound(ts, 2402, g) for g in (0, 1, 2, 37, 50)] == [-1, 0, 1, 36 * 36, 49 * 49]


def test_negatives_across_arcs(spark, monkeypatch):
    from arcloom.functions.portable import MODULUS
    from arcloom.operators import sampling

    monkeypatch.setattr(sampling, "ARC", 4, raising=False)
    have = {(u, 10 * ((u * 5 + j * j) % 25)) for u in range(8) for j in range(u + 1)}
    got = sampling.negatives(spark.createDataFrame(sorted(have), "user_id long, item_id long"), spark.range(0, 250, 10).withColumnRenamed("id", "item_id"), 3, 6).collect()
    want = []
    for u, i in have:
        at = ((u * 1_000_003 + i * 7_919 + 6 * 104_729) * 69_069 + 12_345) % MODULUS
        free = [n for n in (10 * ((at + t) % 25) for t in range(25)) if (u, n) not in have]
        want += [(u, i, k + 1, n) for k, n in enumerate(free[:3])]
    assert sorted(map(tuple, got)) == sorted(want)
