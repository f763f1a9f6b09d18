"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a local master, where that is unset, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "foliant-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut and lost executors cost nothing.

    The driver's garbage is collected then, which keeps its heap small and lets Spark delete shuffle files that no frame needs any more.
    """
    path, counted = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}", Observation()
    schema = df.schema
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.stashed_rows = counted.get["n"]  # the rows written, which saves counting them again
    release(df.sparkSession)
    return out


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows."""
    known = getattr(df, "stashed_rows", None)
    return (df.limit(rows + 1).count() if known is None else known) <= rows


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stashed frames that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            fs = folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
            if re.fullmatch(r"[0-9a-f]{32}", folder.getName()):
                fs.delete(folder, True)


def each_batch(fn: Callable[[dict], dict | None], schema: pa.Schema, rows: int = 1 << 20, size: float = 5e5) -> Callable:
    """A mapInArrow function from a function of columns; batches are cut to `rows` rows and about `size` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        WORKER_CACHE.clear()
        for batch in batches:
            n = batch.num_rows
            step = max(1, min(rows, n, int(n * size / max(batch.nbytes, 1)) + 1))
            for at in range(0, n, step):
                part = batch.slice(at, step)
                out = fn({name: part.column(i) for i, name in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in schema], schema=schema)
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    return run


def unused(columns: list[str], name: str) -> str:
    """A column name beginning with `name` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What this Python worker keeps from task to task, of one operator at a time.
WORKER_CACHE: dict = {}


def cached(key: tuple, make: Callable):
    """make() of an earlier task of this worker, if it was for the same key and no other operator ran since."""
    if key not in WORKER_CACHE:
        WORKER_CACHE.clear()
        WORKER_CACHE[key] = make()
    return WORKER_CACHE[key]


def pieces(column: pa.Array, size: float = 5e5) -> Iterator[pa.Array]:
    """The column in slices of about `size` bytes."""
    WORKER_CACHE.clear()
    step = max(1, min(len(column), int(len(column) * size / max(column.nbytes, 1)) + 1))
    for at in range(0, len(column), step):
        yield column.slice(at, step)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array with a space after each, and where each begins (one more entry at the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row's list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near keys get unrelated values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse, modulo 2**64; n is rounded up."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = (np.full(size, b, np.uint64) for b in (_BASE, _INVERSE))
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, equal for equal bytes wherever they lie.

    The spans come in order without overlap; about `block` bytes are worked on at a time.
    """
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        part, at = data[starts[i] : ends[j - 1]], starts[i]
        up, down = _powers(len(part) + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=prefix[1:])
            out[i:j] = mix((prefix[ends[i:j] - at] - prefix[starts[i:j] - at]) * down[starts[i:j] - at])
        i = j
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of anything but ASCII white space. data ends with a space."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def fold(df: DataFrame, modulus: int, held: int, key: str = "doc_id") -> DataFrame:
    """Adds held_out: crc32(key as text) modulo `modulus` is `held`; false for a null key."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == held, F.lit(False)))


#: A side of at most so many rows of a few numbers each is broadcast after counting it.
BROADCAST_ROWS = 1 << 20


def join_counted(df: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Joins with other, broadcast if a count shows that it is small; its rows hold a few numbers each."""
    return df.join(F.broadcast(other) if at_most(other, BROADCAST_ROWS) else other, on, how)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer referenced, and gives unused memory of the driver back."""
    gc.collect()
    spark._jvm.System.gc()
    trim_native_heap(spark)


def trim_native_heap(spark: SparkSession) -> None:
    """Runs the JVM's own command for it, if it has one.

    The driver's pools of short-lived threads leave freed native memory behind in many heaps, some hundred MB of a long session.
    """
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    kinds, values = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    values[0], values[1] = commands, "systemTrimNativeHeap"
    values[2], values[3] = new_array(jvm.java.lang.Object, 0), new_array(jvm.java.lang.String, 0)
    try:  # through the interface, as the server's own class is not open
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
    except Py4JJavaError:
        pass  # a JVM without the command keeps what it has
