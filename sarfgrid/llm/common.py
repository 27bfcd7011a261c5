"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, at most (one text may be longer).
ARROW_ROWS, ARROW_BYTES = 500, 32_000_000
#: What the word contracts call white space: blank, and tab to carriage return.
WS = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts that fit a worker beside its other work."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def beside(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session of the same application with these settings besides spark's; spark keeps its own."""
    out = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in conf.items():
        out.conf.set(k, v)
    return out


def tidy() -> None:
    """Give a worker's freed memory back to the system: workers live on, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader only, so any store works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sarfgrid-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where it is unset (local tests)."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_dir()


#: Spark's own setting: a query's shuffle files go when it ends, not when the driver happens to collect garbage.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that run meanwhile delete their shuffle files; spark keeps its own setting."""
    own = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREES) if own is None else spark.conf.set(FREES, own)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, outlives lost executors, and frees the disk of df's shuffles."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch[path] = ""
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths written by this session and not released, with their table's name, if any.
_scratch: dict[str, str] = {}


def scratch() -> list[str]:
    """Paths of what written() and written_in_buckets() left so far, oldest first."""
    return list(_scratch)


def release(spark: SparkSession, paths, labels: tuple[str, ...] = ("",)) -> None:
    """Delete scratch of these labels that nothing will read again, through the store's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if path in _scratch and path.rsplit("/", 1)[1].startswith(labels):
            name = _scratch.pop(path)
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def crc_mod_py(x, n: int) -> int:
    return zlib.crc32(str(x).encode()) % n


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow of a function from a dict of columns (Python lists) to a dict of columns, batch by batch."""

    def run(batches):
        types = None
        for b in batches:
            if b.num_rows:
                out = fn({n: b.column(i) for i, n in enumerate(b.schema.names)})
                types = types or list(out)
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n][0], out[n][1]) for n in types], names=types)
        tidy()

    return df.mapInArrow(run, schema)


def spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges a..b-1, range after range, and the ranges' lengths."""
    n = b - a
    return np.repeat(a - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum()), n

def written_in_buckets(df: DataFrame, label: str, key: str, n: int, reader: SparkSession | None = None) -> DataFrame:
    """As written(), but in n hash buckets of key: later work by key needs no shuffle of these rows. reader: the session that reads them, if another."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    n = min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))  # beyond, a bucket holds several keys' rows
    path = f"{shared_dir(spark)}/{name}"
    _scratch[path] = name
    with shuffles_freed(spark):
        df.write.format("parquet").option("compression", "zstd").bucketBy(n, key).option("path", path).saveAsTable(name)
    return (reader or spark).table(name)
