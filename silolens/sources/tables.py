"""Reading raw tables, and the tables a run leaves behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from silolens.operators.scale import Preprocessor


def load_raw(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read a table with an explicit schema; a missing or empty one is an error.

    So is a CSV or JSON value that does not fit its column, unless ``mode`` says otherwise.
    """
    if fmt in ("csv", "json"):
        options.setdefault("mode", "FAILFAST")
    if fmt == "csv":
        options.setdefault("header", "true")
    try:
        df = spark.read.schema(schema).options(**options).format(fmt).load(path)
        empty = df.isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or e):
            raise FileNotFoundError(f"raw table not found at {path}") from e
        raise
    if empty:
        raise ValueError(f"raw table at {path} is empty")
    return df


def save_prepared(df: DataFrame, path: str, fitted: Preprocessor | None = None) -> None:
    """Prepared rows by split, and the fitted stats beside them.

    The rebalance hint lets adaptive execution cut a large split into several
    files and join small ones, so no split is written by one task.
    """
    df.hint("rebalance", "split").write.partitionBy("split").parquet(f"{path}/rows")
    if fitted is not None:
        fitted.to_table(df.sparkSession).coalesce(1).write.parquet(f"{path}/stats")


def load_prepared(spark: SparkSession, path: str, schema: StructType, split: str | None = None) -> DataFrame:
    df = spark.read.schema(schema).parquet(f"{path}/rows")
    return df.where(F.col("split") == split) if split else df


def load_fitted(spark: SparkSession, path: str, order: list[str]) -> Preprocessor:
    return Preprocessor.from_table(spark.read.parquet(f"{path}/stats"), order)


def write_client_partitions(df: DataFrame, path: str, client: str = "client_id") -> None:
    """One folder per client and split, written in one job; a hot client is cut into several files."""
    df.hint("rebalance", client, "split").write.partitionBy(client, "split").parquet(path)


def load_client(spark: SparkSession, path: str, schema: StructType, client_id: int, split: str | None = None,
                client: str = "client_id") -> DataFrame:
    """One client's rows: only its folders are read. An unknown or empty client is an error."""
    df = spark.read.schema(schema).parquet(path).where(F.col(client) == client_id)
    df = df.where(F.col("split") == split) if split else df
    if df.isEmpty():
        raise FileNotFoundError(f"no rows of client {client_id} under {path}")
    return df


def feature_columns(columns: Sequence[str], label: str = "target", aside: Sequence[str] = ("client_id", "split")) -> list[str]:
    """Every column of a client table that is not the label is a feature."""
    return [c for c in columns if c != label and c not in aside]


def save_checkpoints(params: DataFrame, path: str) -> None:
    """(round, idx, value) by round."""
    params.hint("rebalance", "round").write.partitionBy("round").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, round_no: int | None = None) -> DataFrame:
    """One round's parameters, the last round's by default."""
    table = spark.read.schema("idx int, value double, round int").parquet(path)
    if round_no is None:
        round_no = table.agg(F.max("round")).first()[0]
    return table.where(F.col("round") == round_no)
