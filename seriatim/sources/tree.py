"""Reading and writing collections of series kept as CSV files, one file for each series, and result tables.

Layout: <root>/<generation type>/<variant>/**/<name with the id>.csv, the rows in order of time, with a static.csv of conditions
beside them where there is one. ``write_series`` and ``write_static`` lay out the same tree: a series is a file series=<name>.csv in one of
the folders part=<n>, which keep folders small, and static.csv is a folder as Spark writes it.

There are as many files as series, so nothing about single files goes through the driver: in folders that every node can open (scheme file), the driver
looks for folders only, and tasks list, read and write the files, each as one piece since a series is small. On other file systems Spark's
sources do both, and the driver holds their list of files.
"""

from __future__ import annotations

import csv
import io
import os
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import mapped, written
from .views import numbered

#: How file names hold the id of a series, the table of conditions, and cells that stand for a missing number.
NAME_WITH_ID = r"^(?:series_|sample_)?0*([0-9]+)$"
STATIC = "static.csv"
MISSING = ("", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>")


#: A series that was written here, as a file or as a folder of Spark's, and the conditions as a file or as a folder of files.
WRITTEN = r"/series=([^/]+?)(?:/[^/]+|\.csv)$"
IS_STATIC = r"/static\.csv(/[^/]+)?$"
#: Names, and cells, that a task hands over at once.
NAMES, CELLS = 10_000, 1 << 16


def csv_options(path_glob: str = "*.csv") -> dict[str, object]:
    return {"recursiveFileLookup": True, "pathGlobFilter": path_glob}


def unescaped(text: Column) -> Column:
    return F.url_decode(F.regexp_replace(text, r"\+", "%2B"))


def stem(file: Column) -> Column:
    """A file's name without its folder and ending, or the name in series=<name>, its percent signs resolved."""
    name = F.regexp_extract(file, WRITTEN, 1)
    return F.when(name != "", unescaped(name)).otherwise(F.regexp_extract(file, r"([^/]+)\.csv$", 1))


def local(spark: SparkSession, path: str) -> str | None:
    """The folder as every node can open it, or None for other file systems than ``file``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def seen(name: str) -> bool:
    """Whether Spark's sources would take a file or folder of that name."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name))


def tasks(spark: SparkSession) -> int:
    """A number of tasks of its own: it is files, not bytes, that take time, and small ones would be gathered in few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def folders(top: str) -> list[str]:
    """``top`` and the folders below it; names of files are passed over one by one."""
    found = [top]
    for folder in found:
        with os.scandir(folder) as entries:
            found += [e.path for e in entries if seen(e.name) and e.is_dir()]
    return found


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The column file: the paths of the CSV files below a folder."""
    top = local(spark, path)
    if top is None or not os.path.isdir(top):
        return spark.read.format("binaryFile").options(**csv_options()).load(path).select(F.col("path").alias("file"))
    names = folders(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                files: list[str] = []
                with os.scandir(folder) as entries:
                    for entry in entries:
                        if entry.name.endswith(".csv") and seen(entry.name) and not entry.is_dir():
                            files.append(entry.path)
                            if len(files) == NAMES:
                                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])
                                files = []
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    dealt = spark.createDataFrame([(n,) for n in names], "folder string").repartition(min(len(names), tasks(spark)), "folder")
    return mapped(dealt, run, "file string")


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, col_ord, column, cells): the columns that the header of a file names, from top to bottom, of files given by path or with their content."""
    csv.field_size_limit(sys.maxsize)
    schema = pa.schema([("file", pa.string()), ("col_ord", pa.int32()), ("column", pa.string()), ("cells", pa.list_(pa.string()))])
    out, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            file, content = batch.column("file")[i].as_py(), batch.column("content")[i].as_py()
            if content is None:
                with open(file, "rb") as f:
                    content = f.read()
            rows = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline="")) if r]
            for k, name in enumerate(rows[0] if rows else []):
                out.append((file, k, name, [r[k] if k < len(r) else None for r in rows[1:]]))
                size += len(rows)
                if size >= CELLS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_series(spark: SparkSession, path: str, stems: bool = False) -> DataFrame:
    """(file, series, t, column, col_ord, value) of the numeric cells; other columns are left out, missing cells are NULL.

    series is the number in the file's name, and files without one are left out; with ``stems`` it is the name itself, as text. A file
    without rows below its header gives nothing. Of columns that share a name in a file, each keeps its own col_ord.
    """
    top = local(spark, path)
    if top is None or not os.path.isdir(top):
        files = spark.read.format("binaryFile").options(**csv_options()).load(path).select(F.col("path").alias("file"), "content")
    else:
        files = listed(spark, path).repartition(tasks(spark), "file").withColumn("content", F.lit(None).cast("binary"))
    columns = mapped(files.where(~F.col("file").rlike(IS_STATIC)), columns_of, "file string, col_ord int, column string, cells array<string>")
    known = F.filter(F.transform("cells", F.trim), lambda c: c.isNotNull() & ~c.isin(*MISSING))
    values = F.transform("cells", lambda c: F.when(~F.trim(c).isin(*MISSING), F.trim(c).try_cast("double")))
    # a column that holds text is no measure
    numeric = columns.withColumn("values", values).withColumn("column", F.trim("column")).where(F.size(known) == F.size(F.filter("values", lambda v: v.isNotNull()))).where("column <> ''")
    name = stem(F.col("file"))
    named = numeric.withColumn("series", name if stems else F.regexp_extract(name, NAME_WITH_ID, 1).try_cast("long")).where("series is not null")
    body = named.select("file", "series", "column", "col_ord", F.posexplode("values").alias("t", "value"))
    return body.select("file", "series", "t", "column", "col_ord", F.when(F.isnan("value"), None).otherwise(F.col("value")).alias("value"))


def variants(spark: SparkSession, path: str) -> DataFrame:
    """Variants below a generation type's folder, sorted, with their number of series files."""
    files = listed(spark, path).where(~F.col("file").rlike(IS_STATIC))
    relative = F.regexp_extract(F.col("file"), r"([^/]+)/(?:time_series/|ts/)?(?:part=[0-9]+/)?(?:series=[^/]+/)?[^/]+\.csv$", 1)
    return files.groupBy(relative.alias("variant")).agg(F.count(F.lit(1)).alias("files")).orderBy("variant")


def load_pair(spark: SparkSession, original: str, synthetic: str, stems: bool = False) -> DataFrame:
    """points of an original and a synthetic folder; ``stems`` as in ``read_series``, for series without ids."""
    sides = [read_series(spark, path, stems).withColumn("variant", F.lit(variant)).drop("file") for variant, path in (("o", original), ("s", synthetic))]
    return numbered(written(sides[0].unionByName(sides[1]), "series"))


def summary(points: DataFrame) -> DataFrame:
    """Per variant: number of series, rows, numeric columns, and the shortest, mean and longest series."""
    per = points.groupBy("variant", "series").agg((F.max("t") + 1).alias("rows"))
    columns = points.groupBy("variant").agg(F.count_distinct("column").alias("columns"))
    return per.groupBy("variant").agg(F.count(F.lit(1)).alias("series"), F.sum("rows").alias("rows"), F.min("rows").alias("min_length"), F.avg("rows").alias("avg_length"), F.max("rows").alias("max_length")).join(columns, "variant")


def data_summary(spark: SparkSession, root: str) -> DataFrame:
    """Per generation type and variant below ``root``: number of series files and whether static conditions lie beside them.

    The folder of a generation type begins with its name.
    """
    files = listed(spark, root)
    folders_ = r"/(conditional|unconditional)[^/]*/([^/]+)/(?:[^/]+/)*[^/]+$"
    named = files.select("file", *(F.regexp_extract("file", folders_, k + 1).alias(c) for k, c in enumerate(("gen_type", "variant")))).where("variant <> ''")
    is_static = F.col("file").rlike(IS_STATIC)
    return named.groupBy("gen_type", "variant").agg(F.count(F.when(~is_static, 1)).alias("files"), F.max(is_static).alias("has_static"))


def write_series(points: DataFrame, path: str) -> None:
    """Writes the points of one side as CSV files, one for each series, with a header and the rows in order of time.

    All files have all columns of the side; a missing cell is NaN. Names are told apart as letters of one case; of columns with one name, later
    ones get their number, as does one named series. Steps without a row are not written, so steps are counted anew when the tree is read. Each (series, t, column) has one row.
    """
    columns = points.select("col_ord", "column").distinct().orderBy("col_ord", "column").collect()  # the header of a file
    taken = {"series": 0}
    names, cells = [], []
    for place, name in columns:
        k = taken[name.lower()] = taken.get(name.lower(), -1) + 1
        names.append(f"{name}.{k}" if k else name)
        cells.append(F.max(F.when((F.col("col_ord") == place) & (F.col("column") == name), F.col("value"))).alias(f"c{len(cells)}"))
    spark = points.sparkSession
    dealt = points.select(F.col("series").cast("string").alias("series"), "t", "col_ord", "column", "value").repartition(tasks(spark), "series")
    wide = dealt.groupBy("series", "t").agg(*cells).sortWithinPartitions("series", "t")
    top = local(spark, path)
    if top is None:
        wide.drop("t").toDF("series", *names).write.partitionBy("series").csv(path, header=True, nullValue="NaN", emptyValue="")
        return
    os.makedirs(top)  # as with Spark's writer, there must be none yet
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(names)
    first = header.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{top}/part={TaskContext.get().partitionId()}"
        hidden = f"{folder}/.{uuid.uuid4().hex}"  # a file gets its name when it is whole, so that a second attempt does no harm
        current, out, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                name = "__HIVE_DEFAULT_PARTITION__" if current is None else current.replace("%", "%25").replace("/", "%2F").replace("\0", "%00")
                os.replace(hidden, f"{folder}/series={name}.csv")

        for batch in batches:
            for series, line in zip(batch.column("series").to_pylist(), batch.column("line").to_pylist()):
                if out is None or series != current:
                    close()
                    os.makedirs(folder, exist_ok=True)
                    current, out, n = series, open(hidden, "w", encoding="utf-8", newline=""), n + 1
                    out.write(first)
                out.write(line + "\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["files"])

    line = F.to_csv(F.struct(*(f"c{k}" for k in range(len(cells)))), {"nullValue": "NaN", "emptyValue": ""})
    mapped(wide.select("series", line.alias("line")), run, "files long").agg(F.sum("files")).first()


def write_static(static: DataFrame, path: str) -> None:
    """Writes the conditions of a variant, with series as .id, as static.csv into its folder."""
    static.withColumnRenamed("series", ".id").write.csv(f"{path}/{STATIC}", header=True)


def read_static(spark: SparkSession, path: str) -> DataFrame:
    """The static conditions, with .id as series."""
    return spark.read.csv(path, header=True).withColumnRenamed(".id", "series").withColumn("series", F.expr("cast(try_cast(series as double) as long)"))


def missing_series(static: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of the static table without a series."""
    return static.join(points.select("series").distinct(), "series", "left_anti")


def structure(points: DataFrame) -> DataFrame:
    """Per variant: number of series and their mean length."""
    per = points.groupBy("variant", "series").agg((F.max("t") + 1).alias("rows"))
    return per.groupBy("variant").agg(F.count(F.lit(1)).alias("time_series_files"), F.avg("rows").alias("avg_ts_length"))


def save_results(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines under a time-stamped name."""
    metrics.write.mode("errorifexists").json(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gen_type string, variant string, variant_type string, dimension string, column string, metric string, value double").json(path)


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The last result folder by name; names hold the time."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select(F.max(F.regexp_replace("path", r"/[^/]+$", "")))
    return found.first()[0]
