"""Written intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_CONF, SPARK_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; where that is unset on a local master (tests), in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/series-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` as a Parquet table that is read again: computed once for all its readers, whose lineage starts here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written``, once all that reads them is written itself."""
    for table in tables:
        spark = table.sparkSession
        mark = f"/{shared_dir(spark).rsplit('/', 1)[1]}/"
        for file in table.inputFiles()[:1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file[: file.index("/", file.index(mark) + len(mark))])
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows.mapInArrow`` with batches of BATCH_BYTES where the session has Spark's own, far larger bound, and workers that give memory back after each task."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH_CONF, SPARK_BATCH) == SPARK_BATCH:
        conf.set(BATCH_CONF, f"{BATCH_BYTES}b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return rows.mapInArrow(bounded, schema)
