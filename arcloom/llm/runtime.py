"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; bounds the working memory of a Python worker.
STEP_BYTES = 1 << 20


#: Rows of an Arrow batch; the default of 10,000 whole texts is tens of MB on both sides of each worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows from now on in this session, unless someone has set their size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def trim() -> None:
    """Gives freed memory back to the system, which else keeps it in the worker."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """Gives native memory that the driver's Java process has freed back to the system. Each exchange of a plan has a
    thread of its own there, and what such threads have freed stays in their own pools. A Java that can't do it does
    nothing."""
    sc = spark.sparkContext
    jvm, array = sc._jvm, lambda kind, *v: _array(sc, kind, v)
    java = jvm.java.lang
    with contextlib.suppress(Py4JError):  # by reflection on the interface, as the server's own class is closed to calls
        kinds = [java.Class.forName(c) for c in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, *kinds))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), array(java.Object, command, "systemTrimNativeHeap", array(java.Object), array(java.String)))


def trim_executors(spark: SparkSession) -> None:
    """Asks each executor's Java process to collect its garbage now, after which it gives back what of its heap is free.
    It does not by itself while it has work, so that a heap which one stage has filled stands beside the Python workers
    of all later ones. A task for each core; where these miss an executor, it stays as it is."""
    spark.range(0, n := spark.sparkContext.defaultParallelism, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


#: Seconds after which Java too has let go of what Python no longer refers to: it is told of that once a second.
RELEASE_S = 1.2


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, after which the files of shuffles that nothing refers to any more are deleted.
    Else they stay beside those of later steps until its heap happens to fill."""
    gc.collect()
    time.sleep(RELEASE_S)
    spark.range(1)._jdf.queryExecution().toRdd().count()  # Java's listeners hold the last query until they hear of another
    spark.sparkContext._jvm.java.lang.System.gc()


def _array(sc, kind, values: tuple):
    """A Java array of these values."""
    out = sc._gateway.new_array(kind, len(values))
    for k, v in enumerate(values):
        out[k] = v
    return out


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns `names` alone, found by exact name; others, clashing ones included, are left behind."""
    small_batches(df.sparkSession)
    have = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return flat.select(*[F.col(f"_c{have.index(n)}").alias(n) for n in names])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table under the column names _c0, _c1, ..., which cannot clash, and its own names."""
    small_batches(df.sparkSession)
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), df.columns


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Where that is unset, a temporary folder, but only if all of Spark runs on
    this machine, as in tests."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="arcloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files that every executor can read."""
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    trim_driver(df.sparkSession)
    return done


#: Rows of a checkpoint's partition, about, and the fewest partitions.
FIT_ROWS, FIT_LEAST = 100_000, 12


def fitted(df: DataFrame) -> DataFrame:
    """A checkpointed table in as many partitions as its rows need, if it has more. A file for each partition of a
    shuffle, however little is in it, is what most of the disk goes to otherwise."""
    own = df.rdd.getNumPartitions()
    if own <= FIT_LEAST:
        return df
    rows = df._jdf.queryExecution().toRdd().count()  # of what is written already: no plan to make and compile
    parts = max(FIT_LEAST, -(-rows // FIT_ROWS))
    return df.coalesce(parts) if parts < own else df


_held: dict[str, object] = {}
_kept: dict[str, Callable[[], None]] = {}


def alone(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called as a task of `owner` begins in a Python worker: what other operators remember in this worker is dropped,
    and `forget` drops what this one will, when another comes. Workers outlive stages; their memories must not add up."""
    others = [k for k in _kept if k != owner]
    for k in others:
        _kept.pop(k)()
    if forget:
        _kept[owner] = forget
    if others:
        gc.collect()
        trim()


class Shared:
    """A value that each Python worker gets once, and what the worker makes of it, which it keeps while tasks use it."""

    def __init__(self, spark: SparkSession, value, make=None):
        self.key, self.value, self.make = uuid.uuid4().hex, spark.sparkContext.broadcast(value), make

    def get(self):
        if self.key not in _held:
            _held.clear()
            _held[self.key] = self.make(*self.value.value) if self.make else self.value.value
        return _held[self.key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, without copying, and the n+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes together; a longer row is a run of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end
