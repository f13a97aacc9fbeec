"""Session helpers: the shared folder, written tables that cut lineage, skew-safe joins."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_CONF, SPARK_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
BATCH_BYTES = 4 << 20
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset on a local master (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/seriatim-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    This cuts lineage, so a lost executor costs a read and not the plan below, and gives later joins an
    input of known size that adaptive execution can broadcast or split.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once everything that reads them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        mark = f"/{shared_dir(spark).rsplit('/', 1)[1]}/"
        for file in table.inputFiles()[:1]:
            folder = file[: file.index("/", file.index(mark) + len(mark))]
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the write that made them has ended, not when the driver happens to collect its garbage (Spark 4.1 or later)."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def hash_mod(column: Column, n: int) -> Column:
    """crc32 of the column as text, modulo n: the fold rule of the held-out contracts. Null: null."""
    return F.crc32(column.cast("string")) % n


def counted(df: DataFrame, keys: Sequence[str], name: str, least: int = 2) -> DataFrame:
    """The key values with ``least`` rows or more, as a written table, so that a join back can be split where skewed."""
    return stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), name)


def hashed_sample(df: DataFrame, bound: int, key: Column) -> DataFrame:
    """All rows, or where there are more than ``bound`` about that many, chosen by a hash of ``key``: the same rows on every run."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * bound / n))


def bounded_rows(rows: DataFrame, bound: int) -> DataFrame:
    """One row of those with equal doc_id and text, and of these the ``bound`` with the smallest hashes of both, kept as ``pick``: so many rows at most, however ids repeat."""
    picked = rows.withColumn("pick", F.xxhash64("doc_id", "text"))
    last = picked.select("doc_id", "pick").distinct().orderBy("pick").limit(bound).agg(F.max("pick")).first()[0]
    return picked.where(F.col("pick") <= F.lit(last).cast("long")).dropDuplicates(["doc_id", "pick"])


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``rows.mapInArrow``, with bounded batches, and workers that give memory back after each task.

    Batches are cut at ``BATCH_BYTES`` where the session has left Spark's own, far larger bound as it is: executors
    and their Python workers each hold several at once.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_CONF, SPARK_BATCH) == SPARK_BATCH:
        conf.set(BATCH_CONF, f"{BATCH_BYTES}b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return rows.mapInArrow(bounded, schema)
