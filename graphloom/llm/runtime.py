"""Small helpers that every operator of this subpackage shares.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which executors and driver share;
only where that setting is absent, in a local session (tests), is a temporary local folder used.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a local one is made only if a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more and let Spark drop finished shuffle files."""
    for df in tables:
        spark, path = df.sparkSession, df._graphloom_path
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let the context cleaner see shuffles that are no longer reachable."""
    gc.collect()
    spark._jvm.System.gc()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame, megabytes: int = 8) -> DataFrame:
    """Let batches to Python be bounded by bytes, not by rows only, so long texts don't add up in a worker.

    Spark reads this bound from the session when a job runs, so it stays set; a bound that the user set is kept.
    """
    conf = df.sparkSession.conf
    if BATCH_BYTES not in conf.getAll:
        conf.set(BATCH_BYTES, str(megabytes << 20))
    return df


def _trim() -> None:
    """Give memory that a finished task used back to the system, as Spark keeps idle workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a libc that has it
        pass


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` over batches bounded by bytes, in workers that keep little when a task ends."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            _trim()

    return bounded_batches(df).mapInArrow(run, schema)


_kept_in_worker: dict = {}


def worker_cache(key, make):
    """What a Python worker keeps between tasks: one model at a time, so stages that share workers don't add up."""
    if key not in _kept_in_worker:
        _kept_in_worker.clear()
        _kept_in_worker[key] = make()
    return _kept_in_worker[key]


def row_key(doc_id="doc_id", text="text"):
    """A 128-bit content key of a row, 16 bytes; equal rows get equal keys, so joins on it need no row numbers."""
    tagged = lambda c, kind: F.coalesce(F.concat(F.lit(kind), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(tagged(doc_id, "i"), F.lit(":"), tagged(text, "t")).cast("binary")))


def one_of_each(docs: DataFrame, key) -> DataFrame:
    """(k, row): one whole row, as a struct, of each content key. Repeated rows meet as partial aggregates, so a row that
    is there very often is no single task's work, and no column's name can clash."""
    return docs.select(key.alias("k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).groupBy("k").agg(F.first("row").alias("row"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
