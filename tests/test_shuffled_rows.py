"""How many rows the plans shuffle: in proportion to their input, however many rows they give."""

import pytest

from arcloom.plans import catalog


def shuffled(spark, df) -> int:
    """Rows that all stages of a run wrote to shuffles, where no table is small enough to be shared whole."""
    sc, jvm = spark.sparkContext, spark._jvm
    store = sc._jsc.sc().statusStore()

    def seen() -> dict:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        rows = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(r.stageId(), r.attemptId()): r.shuffleWriteRecords() for r in (rows.apply(k) for k in range(rows.size()))}

    before = seen()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df().write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for k, n in seen().items() if k not in before)


@pytest.fixture(scope="module")
def bought(spark, tmp_path_factory):
    """4,000 lines: 20 customers, 200 lines each on 50 days, of 400 parts."""
    at = str(tmp_path_factory.mktemp("bought"))
    o = spark.range(1000).selectExpr("id AS o_orderkey", "id % 20 AS o_custkey", "date_add(DATE'1995-01-01', cast(id div 20 AS int)) AS o_orderdate")
    o.write.parquet(f"{at}/orders.parquet")
    rows = spark.range(4000).selectExpr("id div 4 AS l_orderkey", "cast(id % 4 AS int) AS l_linenumber", "(id * 37 + id div 400) % 400 AS l_partkey", "id % 10 AS l_suppkey", "1.0D AS l_quantity", "1.0D AS l_extendedprice")
    rows.write.parquet(f"{at}/lineitem.parquet")
    spark.range(400).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").write.parquet(f"{at}/part.parquet")
    near = "array(cast(vec_id % 7 AS float) / 100, cast(vec_id % 11 AS float) / 200, cast(vec_id % 13 AS float) / 300)"
    spark.range(300).withColumnRenamed("id", "vec_id").selectExpr("vec_id", f"{near} AS embedding", "vec_id % 3 AS label").write.parquet(f"{at}/embeddings.parquet")
    return at


#: Most shuffled rows for each line item.
MOST = {
    "neighbour_cooccurrence": 16,
    "first_hop_history": 12,
    "recent_neighbours": 11,
    "recent_neighbours_padded": 11,
    "recent_neighbours_left_aligned": 11,
    "uniform_neighbours": 14,
    "two_hop_temporal_neighbours": 16,
    "patch_sequences": 11,
    "graphmixer_node_mean": 11,
    "lightgcn_propagation": 8,
    "laplacian_positional_encoding": 6,
    "triplets": 5,
    "triplet_angles": 5,
    "torsion_angles": 10,
}


@pytest.mark.parametrize("name", MOST)
def test_shuffles_in_proportion(spark, bought, name):
    assert 0 < shuffled(spark, lambda: catalog.QUERIES[name](spark, bought)) <= 4000 * MOST[name]


def test_negatives_shuffle_few_rows(spark):
    from arcloom.operators import sampling

    have = spark.range(4000).selectExpr("id div 20 AS user_id", "id * 7 % 3001 AS item_id")
    items = spark.range(3001).withColumnRenamed("id", "item_id")
    assert shuffled(spark, lambda: sampling.negatives(have, items, 2, 6)) <= 4000 * 14


def test_transitions_shuffle_edges_alone(spark):
    from arcloom.operators import sampling

    edges = spark.range(3000).selectExpr("id div 20 AS src", "(id * 7 + id div 20) % 150 AS dst").distinct()
    assert shuffled(spark, lambda: sampling.second_order_weights(edges, 0.5, 2.0)) <= 3000 * 12


def test_undirected_shuffles_a_pair_once(spark):
    from arcloom.operators import edges as E

    pairs = [(1, 2, 1.0), (2, 1, 2.0), (3, 3, 4.0), (None, 5, 8.0), (5, None, 16.0)]
    got = E.to_undirected(spark.createDataFrame(pairs, "src long, dst long, w double")).collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(1, 2): 3.0, (2, 1): 3.0, (3, 3): 8.0, (None, 5): 24.0, (5, None): 24.0} and len(got) == 5
    edges = spark.range(3000).selectExpr("id AS src", "id + 3000 AS dst", "1.0D AS w")
    assert shuffled(spark, lambda: E.to_undirected(edges)) <= 3000
