"""Small files of each layout."""

import gzip
import json
import pickle

import numpy as np
from pyspark.sql import functions as F

from arcloom.sources import readers as R


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") if path.suffix == ".gz" else open(path, "w") as f:
        f.write(text)
    return str(path)


def test_temporal(spark, tmp_path):
    p = put(tmp_path / "a.csv", "u,i,t,label,f\n0,0,1.5,0,0.1,0.2\n2,1,2.0,1,0.3,0.4\n")
    got = [tuple(r) for r in R.temporal_csv(spark, p).orderBy("eid").collect()]
    assert got == [(0, 3, 1.5, 0, [0.1, 0.2], 1), (2, 4, 2.0, 1, [0.3, 0.4], 2)]
    p = put(tmp_path / "b.csv", "src,dst,time,split\n1,2,3,0\n2,3,4.5,2\n")
    assert [tuple(r) for r in R.temporal_sequence_csv(spark, p).orderBy("eid").collect()] == [(1, 2, 3.0, 0, 1), (2, 3, 4.5, 2, 2)]


def test_recommendation(spark, tmp_path):
    p = put(tmp_path / "r.inter", "user_id:token\titem_id:token\trating:float\ttimestamp:float\nb\tx\t5\t1\na\ty\t3\t2\n")
    assert {(r["user_id"], r["item_id"], r["rating"]) for r in R.inter(spark, p).collect()} == {(1, 0, 5.0), (0, 1, 3.0)}
    pairs = spark.createDataFrame([(u, i) for u in range(3) for i in range(10)], "user_id long, item_id long")
    R.write_splits(pairs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in back} == {0: 24, 1: 3, 2: 3}


def test_graphs_of_text(spark, tmp_path):
    n, e = R.text_graph(spark, put(tmp_path / "n.txt", "id\tf\tl\n0\t1,0\t2\n1\t0,1\t3\n"), put(tmp_path / "e.txt", "a\tb\n0\t1\n0\t1\n"))
    assert [tuple(r) for r in n.orderBy("id").collect()] == [(0, [1.0, 0.0], 2), (1, [0.0, 1.0], 3)] and e.count() == 1
    put(tmp_path / "g/edge.csv.gz", "0,1\n1,2\n")
    put(tmp_path / "g/edge-feat.csv.gz", "5\n6\n")
    g = R.csv_gz_graph(spark, f"{tmp_path}/g", inverse=True)
    assert [tuple(r) for r in g["edge"].orderBy("place").collect()] == [(0, 0, 1), (1, 1, 0), (2, 1, 2), (3, 2, 1)]
    assert [r["x"] for r in g["edge-feat"].orderBy("place").collect()] == [[5.0], [5.0], [6.0], [6.0]] and "node-feat" not in g
    put(tmp_path / "h/relations/author___writes___paper/edge.csv.gz", "0,7\n")
    assert [tuple(r) for r in R.heterogeneous_csv_gz(spark, f"{tmp_path}/h").collect()] == [("author", "writes", "paper", 0, 7)]
    t = R.dataset_table(spark, put(tmp_path / "m.csv", ",one,two\nnum tasks,1,2\n"))
    assert {tuple(r) for r in t.select("dataset", "key", "value").collect()} == {("one", "num tasks", "1"), ("two", "num tasks", "2")}
    assert [r["x"] for r in R.text_array(spark, put(tmp_path / "x.txt", "1 2\n3 4\n")).orderBy("place").collect()] == [[1, 2], [3, 4]]


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "c.npz", adj_indptr=[0, 2, 2], adj_indices=[0, 1], adj_data=[1, 1], attr_indptr=[0, 1, 2], attr_indices=[0, 1], attr_data=[2.0, 0.0], attr_shape=[2, 2], labels=[4, 5])
    assert sorted((r["src"], r["dst"]) for r in R.npz_csr_edges(spark, f"{tmp_path}/c.npz").collect()) == [(0, 1), (1, 0)]
    assert [r["x"] for r in R.npz_csr_features(spark, f"{tmp_path}/c.npz").orderBy("id").collect()] == [[1, 0], [0, 0]]
    np.savez(tmp_path / "p.npz", node_features=np.eye(3), node_labels=[0, 1, 2], edges=[[0, 1], [1, 0]], train_masks=[[1, 0, 0]], val_masks=[[0, 1, 0]], test_masks=[[0, 0, 1]])
    n, e, m = R.npz_plain(spark, f"{tmp_path}/p.npz")
    assert n.count() == 3 and e.count() == 2 and {(r["id"], r["role"]) for r in m.collect()} == {(0, "train"), (1, "val"), (2, "test")}
    np.save(tmp_path / "neg.npy", np.arange(4).reshape(2, 2))
    assert [r["x"] for r in R.npy_rows(spark, f"{tmp_path}/neg.npy").orderBy("id").collect()] == [[0, 1], [2, 3]]
    np.savez(tmp_path / "t.npz", z=[1, 8], R=np.ones((3, 2, 3)), E=[1.0, 2.0, 3.0])
    assert R.trajectory(spark, f"{tmp_path}/t.npz").agg(F.sum("energy")).first()[0] == 12
    with open(tmp_path / "graph.pkl", "wb") as f:
        pickle.dump({0: [1, 2], 1: [0]}, f)
    assert R.pickled_adjacency(spark, f"{tmp_path}/graph.pkl").count() == 3


def test_molecules_social_and_cache(spark, tmp_path):
    m = R.molecule_csv(spark, put(tmp_path / "m.csv", 'smiles,a,b\nCCO,1,\nC,,0\n'), "smiles", ["a", "b"])
    assert {(r["smiles"], tuple(r["y"])) for r in m.collect()} == {("CCO", (1.0, None)), ("C", (None, 0.0))}
    skip = spark.createDataFrame([(1,)], "id long")
    q = R.property_csv(spark, put(tmp_path / "q.csv", "mol,a,b\nm0,1,2\nm1,3,4\nm2,5,6\n"), skip, [10.0, 1.0], [1, 0])
    assert [tuple(r) for r in q.orderBy("id").collect()] == [(0, [2.0, 10.0]), (2, [6.0, 50.0])]
    n, e = R.social_network(spark, put(tmp_path / "e.csv", "from,to\n0,1\n"), put(tmp_path / "f.json", json.dumps({"0": [1, 3], "1": [3]})), put(tmp_path / "t.csv", "new_id,mature\n0,True\n1,False\n"), "mature", 10)
    assert {(r["id"], tuple(r["x"]), r["y"]) for r in n.collect()} == {(0, (1.0, 1.0), 1), (1, (0.0, 1.0), 0)} and e.count() == 1
    calls = []
    for _ in range(2):
        assert R.cached(spark, f"{tmp_path}/cache", lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1
    parts = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "id long, part long")
    R.save_chunks(parts, parts, f"{tmp_path}/chunks")
    assert R.load_chunk(spark, f"{tmp_path}/chunks", 0)[0].count() == 2
    ev = spark.sql("SELECT timestamp'2020-01-01' AS time, 'follow' AS kind UNION ALL SELECT timestamp'2020-01-02', 'watch' UNION ALL SELECT timestamp'2021-01-02', 'watch'")
    assert {r["kind"] for r in R.event_log(ev, "2020-01-01", "2020-12-31", ["follow", "watch"]).collect()} == {"association", "watch"}
