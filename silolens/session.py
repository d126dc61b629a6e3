"""Session helpers: the shared folder, proven-size broadcasts, bounded collects."""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

# Largest table that may be broadcast or brought to the driver (rows, counted before use).
SMALL_ROWS = 100_000
# Bytes that such a table may hold in columns without a fixed width.
SMALL_BYTES = 64 << 20
# What a scan partition holds at most by default.
SCAN_BYTES = 128 << 20
# What a task should have to read before the layout of its files is looked at.
PART_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode, where the driver's disk is
    the executors' disk. On a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="silolens-")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Workers do not share the driver's import path. The archive is made on the
    driver only; Spark copies it to every executor, also to ones that join later.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='silolens-code-')}/silolens", "zip", root.parent, root.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


_shipped: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one run's table; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/silolens/{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """A few driver-side rows as a local relation: its size is known to the planner and no job makes it."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow), schema=schema)


def spread(df: DataFrame) -> DataFrame:
    """Give a compute-bound step a task per core when a small input has fewer files than cores.

    A table that fills a scan partition for every core is left as it lies, in
    however few files: its scan is spread already, and its files are not listed.
    So are few files whose parts keep the cores as busy as a shuffle would.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size >= cores * SCAN_BYTES:
        return df
    files = df.inputFiles()
    if not 0 < len(files) < cores or (size >= cores * PART_BYTES and _scanned_evenly(df, plan.toString(), files, cores)):
        return df
    return df.repartition(cores)


def _scanned_evenly(df: DataFrame, plan: str, files: list[str], cores: int) -> bool:
    """Whether ``df`` only reads and projects Parquet files whose fullest scan partition has at most 1.5 times a core's share of the rows.

    The rows of a partition are counted from the files' footers, without a column.
    """
    steps = [line.lstrip(" +-:") for line in plan.splitlines()]
    if not all(step.startswith(("Project ", "Filter ", "Relation ")) for step in steps if step) or not all(f.endswith(".parquet") for f in files):
        return False
    parts = df.sparkSession.read.parquet(*files).groupBy(F.spark_partition_id()).count().collect()
    return max(p["count"] for p in parts) * cores <= 1.5 * sum(p["count"] for p in parts) if parts else False


def bounded_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """All rows if there are at most ``limit``, else None. Never a truncated list.

    Rows with arrays, maps or binary values have no size of their own: those are
    summed up first, and more than ``SMALL_BYTES`` of them give None too.
    """
    if any(isinstance(f.dataType, (ArrayType, MapType, BinaryType)) for f in df.schema.fields):
        size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
        if (df.agg(size).first()[0] or 0) > SMALL_BYTES:
            return None
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` once its row count is proven; otherwise leave it to a shuffle join."""
    rows = bounded_rows(df, limit)
    if rows is None:
        return df
    return F.broadcast(local_table(df.sparkSession, rows, df.schema))
