"""Readers of graph and interaction file layouts, local or in any store that Spark reads, and the sinks that go with them.

Text is read by Spark's own readers. Array archives (.npz, .npy) and pickles are read as binary files and unpacked on
executors, a file a task; pickles through an unpickler that knows plain containers and arrays alone.
"""

from __future__ import annotations

import io
import os
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions.portable import draw
from arcloom.operators import edges as E
from arcloom.operators.ranking import ratio_split


def _numbers(column: Column, kind: str = "double") -> Column:
    return F.transform(F.split(F.trim(column), r"[,\s]+"), lambda v: v.cast(kind))


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """value and place of the lines of one text file: ids that grow with the place, made dense."""
    ids = lines.withColumn("id", F.monotonically_increasing_id())
    return ids.join(E.relabel(ids.select("id"), salt=256), "id").select(F.col("new_id").alias("place"), "value")


# ---- temporal interaction files ------------------------------------------------------------------------------------------
def temporal_csv(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, t, y, msg, eid of a CSV with a header line: source, target, time, label, then message numbers.

    Targets are moved past the largest source; eids count lines from 1.
    """
    lines = _numbered_lines(spark.read.text(path)).where("place > 0")
    part = F.split("value", ",")
    rows = lines.select(F.get(part, 0).cast("double").cast("long").alias("src"), F.get(part, 1).cast("double").cast("long").alias("d"), F.get(part, 2).cast("double").alias("t"), F.get(part, 3).cast("double").cast("int").alias("y"), F.transform(F.slice(part, 5, F.greatest(F.size(part) - 4, F.lit(0))), lambda v: v.cast("double")).alias("msg"), F.col("place").alias("eid"))
    top = rows.agg((F.max("src") + 1).alias("shift"))
    return rows.crossJoin(F.broadcast(top)).select("src", (F.col("d") + F.col("shift")).alias("dst"), "t", "y", "msg", "eid")


def temporal_sequence_csv(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, time, split (0 train, 1 validation, 2 test), eid from 1."""
    lines = _numbered_lines(spark.read.text(path)).where("place > 0")
    part = F.split("value", ",")
    return lines.select(F.get(part, 0).cast("long").alias("src"), F.get(part, 1).cast("long").alias("dst"), F.get(part, 2).cast("double").alias("time"), F.get(part, 3).cast("int").alias("split"), F.col("place").alias("eid"))


def event_log(events: DataFrame, since: str, until: str, kinds: list[str]) -> DataFrame:
    """Typed events of a period; the others are left out, follow events become associations."""
    inside = events.where((F.col("time") >= F.lit(since).cast("timestamp")) & (F.col("time") < F.lit(until).cast("timestamp")) & F.col("kind").isin(*kinds))
    return inside.withColumn("kind", F.when(F.col("kind") == "follow", "association").otherwise(F.col("kind")))


# ---- recommendation files ------------------------------------------------------------------------------------------------
def inter(spark: SparkSession, path: str, schema: str = "user_id string, item_id string, rating double, timestamp double") -> DataFrame:
    """Tab-separated interactions with a header; ids become codes from 0 in their order."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema)
    for c in ("user_id", "item_id"):
        rows = E.encoded(rows, c).drop(c).withColumnRenamed("code", c)
    return rows


def items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="item_id string, movie_title string, release_year string, genre string")


def users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="user_id string, age int, gender string, occupation string, zip_code string")


def write_splits(pairs: DataFrame, path: str, seed: int = 42) -> None:
    """train, validation and test edges by user (0.8, 0.1, the rest), as Parquet partitioned by part."""
    parts = ratio_split(pairs, "user_id", draw(F.col("user_id"), F.col("item_id"), seed), ["item_id"], (0.8, 0.1))
    parts.write.mode("overwrite").partitionBy("part").parquet(path)


# ---- text and CSV graphs ---------------------------------------------------------------------------------------------------
def text_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Tab-separated nodes (id, comma-separated features, label) and edges (src, dst), both with a header."""
    n = spark.read.csv(nodes, sep="\t", header=True, schema="id long, x string, y int").withColumn("x", _numbers(F.col("x")))
    e = spark.read.csv(edges, sep="\t", header=True, schema="src long, dst long")
    return n, E.coalesce(e.withColumn("w", F.lit(1.0)), "min")


def sparse_text_features(spark: SparkSession, path: str, width: int) -> DataFrame:
    """id, x of a file whose features are the places of ones."""
    n = spark.read.csv(path, sep="\t", header=True, schema="id long, x string, y int").withColumn("at", _numbers(F.col("x"), "int"))
    return n.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.array_contains("at", k).cast("double")).alias("x"), "y")


def csv_gz_graph(spark: SparkSession, folder: str, inverse: bool = False) -> dict[str, DataFrame]:
    """edge.csv.gz (and node-feat, edge-feat, node-label where there) of a large-graph folder.

    With `inverse`, each edge is followed by its swap: it stands at an even place, the swap at the next odd one, and
    both carry the edge's features.
    """
    rows = _numbered_lines(spark.read.text(f"{folder}/edge.csv.gz"))
    part = F.split("value", ",")
    e = rows.select("place", F.get(part, 0).cast("long").alias("src"), F.get(part, 1).cast("long").alias("dst"))
    out = {"edge": e}
    for name in ("node-feat", "edge-feat", "node-label"):
        try:
            out[name] = _numbered_lines(spark.read.text(f"{folder}/{name}.csv.gz")).select("place", F.transform(F.split("value", ","), lambda v: F.when(v != "", v.cast("double"))).alias("x"))
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    if inverse:
        out["edge"] = e.select((F.col("place") * 2).alias("place"), "src", "dst").unionAll(e.select(F.col("place") * 2 + 1, "dst", "src"))
        if "edge-feat" in out:
            f = out["edge-feat"]
            out["edge-feat"] = f.select((F.col("place") * 2).alias("place"), "x").unionAll(f.select(F.col("place") * 2 + 1, "x"))
    return out


def heterogeneous_csv_gz(spark: SparkSession, folder: str) -> DataFrame:
    """src_type, rel, dst_type, src, dst of a folder relations/head___rel___tail/edge.csv.gz; the path names the relation."""
    rows = spark.read.csv(f"{folder}/relations/*/edge.csv.gz", schema="src long, dst long").withColumn("_p", F.split(F.element_at(F.split(F.input_file_name(), "/"), -2), "___"))
    return rows.select(F.get("_p", 0).alias("src_type"), F.get("_p", 1).alias("rel"), F.get("_p", 2).alias("dst_type"), "src", "dst")


def dataset_table(spark: SparkSession, path: str) -> DataFrame:
    """dataset, key, value of a master table whose columns are data sets."""
    t = spark.read.csv(path, header=True)
    key, *names = t.columns
    return t.select(F.col(f"`{key}`").alias("key"), F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))).alias("dataset", "value"))


# ---- binary files ---------------------------------------------------------------------------------------------------------
class _Plain(pickle.Unpickler):
    """Knows numpy arrays, and nothing that could run."""

    def find_class(self, module: str, name: str):
        if (module, name) in {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("collections", "defaultdict"), ("builtins", "list"), ("_codecs", "encode"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar")}:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't read")


def from_files(spark: SparkSession, path: str, unpack: Callable[[bytes], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What `unpack` makes of each binary file."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield from unpack(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(each, schema)


def npz_csr_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, w of an archive with adj_indptr, adj_indices, adj_data: loops dropped, both directions."""

    def unpack(content: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(content)) as z:
            ptr, to = z["adj_indptr"], z["adj_indices"]
            yield pd.DataFrame({"src": np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), "dst": to, "w": np.ones(len(to))})

    return E.to_undirected(E.remove_self_loops(from_files(spark, path, unpack, "src long, dst long, w double")), "max")


def npz_csr_features(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y: attributes as 0 or 1 by whether they are above zero, and labels."""

    def unpack(content: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(content)) as z:
            shape, ptr = z["attr_shape"], z["attr_indptr"]
            x = np.zeros(shape)
            x[np.repeat(np.arange(shape[0]), np.diff(ptr)), z["attr_indices"]] = z["attr_data"] > 0
            yield pd.DataFrame({"id": np.arange(shape[0]), "x": list(x), "y": z["labels"]})

    return from_files(spark, path, unpack, "id long, x array<double>, y int")


def npz_plain(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (id, x, y), undirected edges, and (split_id, id, role) of an archive with node_features, node_labels, edges
    and masks."""

    def nodes(content: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(content)) as z:
            yield pd.DataFrame({"id": np.arange(len(z["node_labels"])), "x": list(z["node_features"].astype(float)), "y": z["node_labels"]})

    def edges(content: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(content)) as z:
            yield pd.DataFrame({"src": z["edges"][:, 0], "dst": z["edges"][:, 1], "w": 1.0})

    def masks(content: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(content)) as z:
            for role in ("train", "val", "test"):
                m = np.atleast_2d(z[f"{role}_masks"])
                s, i = np.nonzero(m)
                yield pd.DataFrame({"split_id": s, "id": i, "role": role})

    return from_files(spark, path, nodes, "id long, x array<double>, y int"), E.to_undirected(from_files(spark, path, edges, "src long, dst long, w double"), "min"), from_files(spark, path, masks, "split_id int, id long, role string")


def npz_arrays(spark: SparkSession, path: str, name: str) -> DataFrame:
    """id and x of one array of an archive: its rows, flattened."""

    def unpack(content: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(content)) as z:
            a = z[name].reshape(len(z[name]), -1).astype(float)
            yield pd.DataFrame({"id": np.arange(len(a)), "x": list(a)})

    return from_files(spark, path, unpack, "id long, x array<double>")


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """id and x of the rows of an .npy file: negatives, node or edge features."""

    def unpack(content: bytes) -> Iterator[pd.DataFrame]:
        a = np.load(io.BytesIO(content))
        yield pd.DataFrame({"id": np.arange(len(a)), "x": list(a.reshape(len(a), -1).astype(float))})

    return from_files(spark, path, unpack, "id long, x array<double>")


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """frame, atom, z, x, y, w and energy of an archive with (z, R, E) or (nuclear_charges, coords, energies)."""

    def unpack(content: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(content)) as f:
            z, r, e = (f["z"], f["R"], f["E"]) if "z" in f else (f["nuclear_charges"], f["coords"], f["energies"])
            frames, atoms = r.shape[:2]
            yield pd.DataFrame({"frame": np.repeat(np.arange(frames), atoms), "atom": np.tile(np.arange(atoms), frames), "z": np.tile(z, frames), "x": r[..., 0].ravel(), "y": r[..., 1].ravel(), "w": r[..., 2].ravel(), "energy": np.repeat(e.ravel(), atoms)})

    return from_files(spark, path, unpack, "frame long, atom long, z int, x double, y double, w double, energy double")


def pickled_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of a pickled dictionary of neighbour lists."""

    def unpack(content: bytes) -> Iterator[pd.DataFrame]:
        graph = _Plain(io.BytesIO(content), encoding="latin1").load()
        yield pd.DataFrame([(int(a), int(b)) for a, bs in graph.items() for b in bs], columns=["src", "dst"])

    return from_files(spark, path, unpack, "src long, dst long")


def citation_masks(nodes: DataFrame, test_index: DataFrame, per_class: int = 20, validation: int = 500) -> DataFrame:
    """id, role: the public split: first `per_class` of each class train, the next ids validate, listed ids test."""
    test = test_index.select(F.col("value").cast("long").alias("id"), F.lit(True).alias("listed"))
    own = nodes.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("id"))).join(test, "id", "left")
    top = own.where(F.col("listed").isNull() & (F.col("k") > per_class)).orderBy("id").limit(validation).select("id", F.lit(True).alias("v"))
    return own.join(top, "id", "left").select("id", F.when(F.col("listed"), "test").when(F.col("k") <= per_class, "train").when(F.col("v"), "val").otherwise("none").alias("role"))


# ---- molecules and social networks -------------------------------------------------------------------------------------------
def molecule_csv(spark: SparkSession, path: str, smiles: str, labels: list[str]) -> DataFrame:
    """smiles and y of a CSV; quoted text is dropped first, an empty label is null."""
    rows = spark.read.csv(path, header=True, quote='"')
    return rows.select(F.col(f"`{smiles}`").alias("smiles"), F.array(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`").cast("double")) for c in labels]).alias("y"))


def property_csv(spark: SparkSession, path: str, skipped: DataFrame, factors: list[float], order: list[int]) -> DataFrame:
    """id and properties in other units and order; listed ids are left out."""
    lines = _numbered_lines(spark.read.text(path)).where("place > 0")
    part = F.split("value", ",")
    y = F.array(*[F.get(part, k + 1).cast("double") * factors[k] for k in order])
    return lines.select((F.col("place") - 1).alias("id"), y.alias("y")).join(skipped.select("id"), "id", "left_anti")


def social_network(spark: SparkSession, edges: str, features: str, targets: str, target: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Edges from CSV; nodes with a one-hot of the feature places in a JSON file, columns that no node uses dropped, and
    a 0/1 label."""
    e = spark.read.csv(edges, header=True, schema="src long, dst long")
    raw = spark.read.text(features, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<int>>")).alias("id", "at"))
    used = raw.select(F.explode("at").alias("k")).distinct().agg(F.sort_array(F.collect_list("k")).alias("used"))  # at most `width` places
    x = raw.crossJoin(F.broadcast(used)).select(F.col("id").cast("long").alias("id"), F.transform(F.filter("used", lambda k: k < width), lambda k: F.array_contains("at", k).cast("double")).alias("x"))
    y = spark.read.csv(targets, header=True).select(F.col("new_id").cast("long").alias("id"), F.col(f"`{target}`").cast("boolean").cast("int").alias("y"))
    return x.join(y, "id"), e


def text_array(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """place and x of a text file with one row of numbers a line."""
    return _numbered_lines(spark.read.text(path)).select("place", _numbers(F.col("value"), kind).alias("x"))


# ---- caches ----------------------------------------------------------------------------------------------------------------
def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`; built and written there first if it is not there."""
    try:
        return spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def extracted(archive: str, folder: str) -> str:
    """A local .zip, .tar or .gz archive unpacked once into a local folder, entries outside of it refused."""
    import gzip
    import shutil
    import tarfile
    import zipfile

    os.makedirs(folder, exist_ok=True)
    if archive.endswith(".zip"):
        with zipfile.ZipFile(archive) as z:
            for n in z.namelist():
                if not os.path.realpath(os.path.join(folder, n)).startswith(os.path.realpath(folder)):
                    raise ValueError(n)
            z.extractall(folder)
    elif ".tar" in archive or archive.endswith(".tgz"):
        with tarfile.open(archive) as t:
            t.extractall(folder, filter="data")
    else:
        with gzip.open(archive) as a, open(os.path.join(folder, os.path.basename(archive).removesuffix(".gz")), "wb") as b:
            shutil.copyfileobj(a, b)
    return folder


def save_chunks(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges of a partitioned graph, a folder a part."""
    nodes.write.mode("overwrite").partitionBy("part").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("part").parquet(f"{path}/edges")


def load_chunk(spark: SparkSession, path: str, part: int) -> tuple[DataFrame, DataFrame]:
    """One part; the others' folders are not read."""
    return tuple(spark.read.parquet(f"{path}/{k}").where(F.col("part") == part) for k in ("nodes", "edges"))
