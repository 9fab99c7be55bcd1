"""Shared plumbing of the training-data operators: rows, keys, shared storage, word hashing."""

from __future__ import annotations

import contextlib
import functools
import gc
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import settle, ship  # noqa: F401

# The white space of the token contracts: space and the five controls from tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Rows of an Arrow batch.
BATCH_ROWS = 500

#: Rows of ids and hashes that may be broadcast: a few tens of MB.
SMALL = 250_000

#: Multiplier of the polynomial word hash and its inverse modulo 2**64.
WORD_MUL = 0x9E3779B97F4A7C15
WORD_INV = pow(WORD_MUL, -1, 1 << 64)


def forget(settled: DataFrame, but: str = "", only: str = "") -> None:
    """Deletes the files of a settled table, except in the folder ``but``, or in the folder ``only`` alone."""
    sc = settled.sparkSession.sparkContext
    for name in settled.inputFiles():
        if but and f"/{but}/" in name or only and f"/{only}/" not in name:
            continue
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    # Bounded Arrow batches, unless the session has its own size: texts are long.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str = "text", ident: str = "doc_id"):
    """Identifies a row's content under its id, so that rows repeated under one id stay apart or equal."""
    return F.xxhash64(F.col(ident).cast("string"), F.col(text))


def without(docs: DataFrame, lost: DataFrame, small: int = SMALL) -> DataFrame:
    """The rows of ``docs`` whose doc_id and row key aren't among ``lost`` (doc_id, key); a null id equals itself.

    Up to ``small`` lost rows are told to every task, so no text is moved; beyond it both sides are shuffled.
    """
    gone = lost.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).distinct()
    told = gone.limit(small + 1).count() <= small
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (row_key() == F.col("__k"))
    return docs.join(F.broadcast(gone) if told else gone, same, "left_anti")


def mod_of_id(ident: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % n


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(batches) -> batches`` over Arrow record batches."""
    return df.mapInArrow(fn, schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 100, read: int = 512):
    """Queries that run inside move few rows at a time between Parquet, Spark and Python: theirs are long."""
    sizes = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.parquet.columnarReaderBatchSize": read}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def text_pieces(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 2_000_000):
    """Slices of a batch with about ``most_bytes`` of text each; one longer text makes a slice alone."""
    lens = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lens):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lens) > start:
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def let(value, body):
    """``body`` of a value that is computed once a row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Caches of models that a worker keeps between the tasks of an operator.
MODELS: list = []


def kept(load):
    """``load(path)`` with the models that it made kept in the worker, until a task that needs room clears them (see ``lean``)."""
    own = functools.lru_cache(2)(load)
    MODELS.append(own)
    return own


@functools.lru_cache(1)
def give_back():
    """From now on this worker gives arrays beyond 1 MB back to the system when they are freed.

    The C library and Arrow's own pool otherwise keep them, and a worker stays as large as its largest batch.
    Returns the call that gives back what lies free between.
    """
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        return libc.malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: None


def lean() -> None:
    """At a task's start: other operators' models and what lies free in this worker go back to the system."""
    trim = give_back()
    if any(m.cache_info().currsize for m in MODELS):
        for m in MODELS:
            m.cache_clear()
        gc.collect()
    trim(0)


class Powers:
    """Powers of the word multiplier and of its inverse, grown when a longer buffer comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = -(-n // (1 << 19)) << 19
            cls.up, cls.down = (np.cumprod(np.where(np.arange(n) > 0, np.uint64(m), np.uint64(1)), dtype=np.uint64) for m in (WORD_MUL, WORD_INV))
        return cls.up, cls.down


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """C with C[i] = sum of (buf[j] + 1) * M**j for j < i, modulo 2**64."""
    up, _ = Powers.of(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a buffer; white space separates them."""
    word = ~IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = prefix_hash(buf)
    _, down = Powers.of(len(buf) + 1)
    return starts, ends, mix64((sums[ends] - sums[starts]) * down[starts])


def lay_out(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, each after ``sep`` (and one at the end), with their starts and ends."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lens + len(sep)) - lens
    return np.frombuffer(sep + sep.join(texts) + sep, np.uint8), starts, starts + lens


def pack(vector: np.ndarray) -> bytes:
    """A vector for the shuffle: its size in bytes, then its bytes compressed (most counts are 0)."""
    raw = np.ascontiguousarray(vector).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(packed: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), "zstd", asbytes=True), dtype)


def sum_vectors(df: DataFrame, keys: list[str], dtype: str = "int64") -> DataFrame:
    """Sum packed vectors ``vec`` of type ``dtype`` by ``keys`` in a tree.

    ``df`` has the keys, ``vec`` and ``part`` (the writer's number). No task holds more than about
    the square root of the number of writers' vectors of one key.
    """
    spec = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name in keys]
    schema = ", ".join(f"{a} {b}" for a, b in spec) + ", part long, vec binary"

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for v in rows.column("vec"):
            x = unpack(v.as_py(), dtype)
            total = x.copy() if total is None else total + x
        one = rows.slice(0, 1).select([*keys, "part"])
        return one.append_column("vec", pa.array([pack(total)], pa.binary()))

    fan_in = max(4, math.isqrt(df.rdd.getNumPartitions()))
    parts = df.select(*keys, F.col("part").cast("long").alias("part"), "vec")
    level = parts.withColumn("part", F.col("part") % fan_in).groupBy(*keys, "part").applyInArrow(add, schema)
    return level.withColumn("part", F.lit(0).cast("long")).groupBy(*keys).applyInArrow(add, schema).drop("part")
