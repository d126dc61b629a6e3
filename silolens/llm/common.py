"""Small helpers of the pipeline's operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.session import scratch_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str, group_bytes: int = 128 << 20) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    A writing task holds a row group in memory; ``group_bytes`` bounds it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", group_bytes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut a partition sorted by ``key`` into tables that never split a key.

    Only the last key of a batch is carried to the next one, so memory is one
    batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut == 0 and held and held[-1].column(key)[-1].as_py() == keys[0]:
            held.append(batch)
            continue
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of each run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.append(starts[1:], len(keys))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame) -> Column:
    """Hash of the whole row. Nulls count, so a value that moves to another column changes it."""
    parts = []
    for f in df.schema.fields:
        name = F.col(f"`{f.name}`")
        value = F.to_json(F.struct(name)) if "map<" in f.dataType.simpleString() else name
        parts += [F.isnull(name), value]
    return F.xxhash64(*parts)


def star_edges(linked: np.ndarray) -> np.ndarray:
    """The smallest member each row of a symmetric link matrix reaches, by index.

    Labels sink to the smallest neighbour until nothing moves; emitting (row,
    label) instead of all pairs keeps the output linear in the members.
    """
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        low = np.minimum(low, label)
        low = np.minimum(low, low[low])
        if np.array_equal(low, label):
            return label
        label = low
