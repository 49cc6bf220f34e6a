"""Shared pieces of the text operators.

* ``table`` reads one of the supplied Parquet tables through Spark's reader, so
  any file system Spark can open works.
* ``stored`` cuts lineage by writing a table to the shared folder the cluster
  names in ``spark.checkpoint.dir``; executors may be lost afterwards.
* ``let`` binds an array expression once inside a native column expression.
* ``Words`` splits Arrow text batches into words and hashes them with numpy,
  without making a Python object for each word.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.functions.session import ship

#: White space that separates words: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}
#: Seconds between looks for shuffle files without a user, and the last look.
LOOK_S, _LOOKED = 3.0, [0.0]


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, and keep Arrow batches small: texts are long rows."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set (tests)."""
    prepare(spark)
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="nimbara-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return _LOCAL["dir"]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Shuffle files of the finished step have no user any more; the driver's
    cleaner drops them once the collector has seen that, so it is asked to look
    from time to time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if time.monotonic() - _LOOKED[0] > LOOK_S:
        spark._jvm.System.gc()
        _LOOKED[0] = time.monotonic()
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table made by ``stored`` once nothing reads it any more."""
    spark = df.sparkSession
    root = urlparse(shared_dir(spark)).path
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if root in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of variable-length columns that a broadcast side may have.
BYTES = 48 << 20


def small(df: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``most`` rows, else leave the plan to Spark.

    size: bytes of a row's variable-length columns; their sum must not exceed BYTES.
    """
    if size is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= BYTES else df


def shielded(f):
    """Let an operator's first table have columns whose names begin with an underscore, as its own columns do."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        away = {c: f"nb{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        return f(docs.withColumnsRenamed(away), *args, **kwargs).withColumnsRenamed({v: k for k, v in away.items()})

    return run


def ddl(df: DataFrame, *more: str) -> str:
    """The schema of ``df`` and further columns as DDL."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; no inlining copies it into lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text, split natively; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def doubled(x: Column, size: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` over every run of ``size`` consecutive elements of ``x`` (which has as many), pair by pair.

    Runs double in length at each step, and the last pair may overlap, so a
    result costs log2(size) joins.
    """

    def grown(h: Column, have: int) -> Column:
        if have == size:
            return h
        by = min(have, size - have)
        pairs = lambda a: F.zip_with(F.slice(a, 1, F.size(a) - by), F.slice(a, by + 1, F.size(a) - by), join)
        return grown(let(h, pairs), have + by)

    return grown(x, 1)


def run_hashes(w: Column, size: int) -> Column:
    """64-bit hash of every run of ``size`` consecutive words of ``w``; none if there are fewer.  Each word is hashed once."""
    every = doubled(F.transform(w, lambda x: F.xxhash64(x)), size, lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(w) >= size, every).otherwise(F.array().cast("array<bigint>"))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words of a slice of texts: byte bounds, document index and 64-bit hash of each.

    Polynomial prefix sums over the text buffer give every word's hash, so the
    cost is a few vector operations a byte.
    """

    def __init__(self, texts: pa.Array):
        if not pa.types.is_string(texts.type):
            texts = texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = texts.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.buf, self.docs, edges = buf, n, at - at[0]
        if len(buf) == 0:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
            return
        word = ~_IS_SPACE[buf]
        fresh = np.zeros(len(buf) + 1, bool)  # a text begins here
        fresh[edges] = True
        before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        self.start = np.flatnonzero(word & (~before | fresh[:-1]))
        self.end = np.flatnonzero(word & (~after | fresh[1:])) + 1
        self.first = np.searchsorted(self.start, edges)  # word index where each text begins
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        up, down = _powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def rolling(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of every run of ``size`` consecutive words (may span texts; mask those)."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    step = np.uint64(0x100000001B3 + 2 * seed)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        out = out * step + (h[j : j + len(out)] ^ np.uint64(seed))
    return mix(out)


def tidy() -> None:
    """Give freed memory back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about ``most`` bytes of text (one text stays whole)."""
    col = batch.column(column)
    if len(col) == 0:
        return
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, len(col)) - i)
        i = min(j, len(col))
    tidy()
