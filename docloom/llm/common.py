"""Helpers that the corpus operators share: scratch tables, word splitting, hashing and table access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary one does on a local master (tests); on a cluster it would be each machine's own: an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots written as __) that hold for a while and are then as they were before."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers the session's Arrow batches to so many rows, unless they are smaller: whole texts of 10,000 rows at a time would
    fill a Python worker. For operators that return a plan which runs later, so that it can't be put back here; each calls
    it, so that none depends on what ran before it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def relieved(spark: SparkSession) -> None:
    """Gives the driver's memory back, once its heap has grown past half of what it may.

    Hundreds of stages in a row leave plans, broadcasts and task results behind, and a heap that has grown to make room for
    them stays as large beside the driver's other memory. A collection shrinks it to a few times what it still holds, and
    lets Spark drop the broadcasts and shuffle files that nothing refers to any more."""
    jvm = spark._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        jvm.System.gc()


class Scratch:
    """Tables written to the shared folder, to cut lineage: a lost executor rereads them instead of recomputing.

    While a table is written, shuffle files of a finished job are released at once, so that the disk holds one job's
    shuffle at a time, and Arrow batches are a few thousand rows at most, so that several long texts in one keep a Python
    worker's memory small; the session's settings are then as before."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/docloom-{tag}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, batch: int = 2000) -> DataFrame:
        path = f"{self.root}/{name}"
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch=str(batch)):
            df.write.mode("overwrite").parquet(path)
        relieved(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; emptied at each task's start and when it has grown past ``bound`` words."""

    bound = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = WordHashes()


def give_back() -> None:
    """What this Python process freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def released(batches_of):
    """For a task's generator of batches: what it held, and the word cache, go back to the system when it ends.

    Python workers stay for the tasks of later stages, several of them beside an executor's heap; memory that a task
    freed but its allocator kept would add up over them."""

    @wraps(batches_of)
    def run(*args):
        try:
            yield from batches_of(*args)
        finally:
            WORDS.clear()
            give_back()

    return run


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased."""
    words = text.translate(ASCII_LOWER).split()
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; the whole sequence as one if there are fewer words, none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):  # a polynomial of the words' hashes, mixed once
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + n]
    return mix64(out)


def n_words(text: str = "text"):
    """Number of words ``[^\\x20\\x09-\\x0D]+`` as a Spark column; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
