"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine verification, components.

Vectors whose signs agree on all hyperplanes of a table share a bucket; every
pair inside a bucket is verified by its cosine in double precision. A pair that
meets in several tables is counted in the first of them only, which both ends
know from the signatures they carry, so no pair is ever written down. Buckets
above ``TILE_ROWS`` are dealt out as pairs of tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silolens.llm.common import groups, runs, star_edges, stored
from silolens.llm.components import components
from silolens.session import small

#: At cosine 0.95 a bit agrees with probability 0.899, 16 bits with 0.182 and one of 40 tables with 0.9997.
TABLES = 40
BITS = 16
THRESHOLD = 0.95
SEED = 20240607
TILE_ROWS = 4096
BLOCK_ROWS = 1024


def _planes(size: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((tables * bits, size))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's vector as bytes and their digest; null where it links with nothing."""
    for batch in batches:
        blobs, keys = [], []
        for ident, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = None if value.as_py() is None or ident is None else value.values.to_numpy(zero_copy_only=False)
            if v is None or v.dtype == object or not len(v) or not np.isfinite(v).all() or not v.any():
                blobs.append(None)
                keys.append(None)
                continue
            blob = (v + v.dtype.type(0)).tobytes()  # -0.0 becomes 0.0
            blobs.append(blob)
            keys.append(hashlib.md5(blob).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(keys, pa.binary())], names=["vec_id", "vec", "vkey"])


def _hashed(dtype: str, tables: int, bits: int):
    """Rows (cid, n, vec) to one row a table: (bucket, cid, n, vec, signs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = (1 << np.arange(bits)).astype(np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                blobs = batch.column("vec").to_pylist()
                signs = np.zeros((len(blobs), tables), np.int64)
                sizes = np.array([len(b) for b in blobs])
                for size in np.unique(sizes):
                    mine = np.flatnonzero(sizes == size)
                    x = _scaled(np.stack([np.frombuffer(blobs[i], dtype) for i in mine]))
                    plane = planes.setdefault(x.shape[1], _planes(x.shape[1], tables, bits))
                    signs[mine] = ((x @ plane.T) > 0).reshape(len(mine), tables, bits) @ powers
                rows = np.repeat(np.arange(len(blobs)), tables)
                bucket = (signs + (np.arange(tables, dtype=np.int64) << bits)).ravel()
                packed = signs.astype(np.uint32)
                marks = [packed[i].tobytes() for i in range(len(blobs))]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), batch.column("cid").take(take), batch.column("n").take(take), batch.column("vec").take(take), pa.array(marks, pa.binary()).take(take)],
                    names=["bucket", "cid", "n", "vec", "signs"])
    return run


def _verify(dtype: str, bits: int, threshold: float):
    """Buckets to rows (a, b, n): links counted for ``a``, and a star of links (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in groups(batches, "bucket"):
            starts, ends = runs(chunk.column("bucket").to_numpy())
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, ends):
                if e - s > 1:
                    out += _bucket_links(chunk.slice(s, e - s), dtype, bits, threshold)
            a, b, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])
    return run


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each by a power of two so that its greatest component lies under 1: squares cannot overflow."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _bucket_links(rows: pa.Table, dtype: str, bits: int, threshold: float) -> list:
    out = []
    cid, times, side = (rows.column(c).to_numpy() for c in ("cid", "n", "side"))
    table = int(rows.column("tab")[0].as_py())
    blobs = rows.column("vec").to_pylist()
    sizes = np.array([len(b) for b in blobs])
    signs = np.stack([np.frombuffer(s, np.uint32) for s in rows.column("signs").to_pylist()])
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        if len(mine) < 2:
            continue
        x = _scaled(np.stack([np.frombuffer(blobs[i], dtype) for i in mine]))
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        degree = np.zeros(len(mine), np.int64)
        for a in range(0, len(mine), BLOCK_ROWS):
            for c in range(a, len(mine), BLOCK_ROWS):
                left, right = np.arange(a, min(a + BLOCK_ROWS, len(mine))), np.arange(c, min(c + BLOCK_ROWS, len(mine)))
                near = (x[left] @ x[right].T) / norm[left, None] / norm[None, right] >= threshold
                i, j = np.nonzero(near)
                i, j = left[i], right[j]
                p, q = mine[i], mine[j]
                # a dealt bucket holds two tiles; pairs inside one tile belong to the pair of it with itself
                new = (i < j) & ((side[p] != side[q]) | (side[p] == 2))
                new[new] &= ~(signs[p[new], :table] == signs[q[new], :table]).any(axis=1) if table else True
                i, j, p, q = i[new], j[new], p[new], q[new]
                if not len(i):
                    continue
                np.add.at(degree, i, times[q])
                np.add.at(degree, j, times[p])
                ends, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                link = np.zeros((len(ends),) * 2, bool)
                link[back[: len(i)], back[len(i) :]] = True
                label = star_edges(link | link.T)
                moved = np.flatnonzero(label != np.arange(len(ends)))
                out.append((cid[mine[ends[moved]]], cid[mine[ends[label[moved]]]], np.zeros(len(moved), np.int64)))
        some = np.flatnonzero(degree)
        out.append((cid[mine[some]], cid[mine[some]], degree[some]))
    return out


def _dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Members of large buckets once for every pair of tiles they are compared in."""
    tiles = large.selectExpr("bucket", f"cast(ceil(count / {TILE_ROWS // 2}) AS int) AS tiles")
    cut = rows.join(small(tiles), "bucket").withColumn("t", F.expr("cast(pmod(xxhash64(cid, vec), tiles) AS int)"))
    dealt = cut.withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)")))
    pair = "xxhash64(bucket, least(t, o), greatest(t, o))"
    return dealt.selectExpr(f"{pair} AS bucket", "tab", "cast(CASE WHEN t = o THEN 2 WHEN t < o THEN 0 ELSE 1 END AS int) AS side", "cid", "n", "vec", "signs")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Links are pairs that share a bucket of some table and whose cosine, in double
    precision, reaches the threshold; lower ones never link. Equal vectors are
    one class with a count, so copies are not expanded. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are
    their own component; so does a row with a null id, whose component is null
    and which is not kept. Rows that repeat an id are vectors of their own for
    the count and share one node. Vectors of different lengths never link. An
    empty table gives an empty result; other columns are not read.
    """
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    rows = stored(source.mapInArrow(_vectors, "vec_id long, vec binary, vkey binary"), "vectors")
    classes = rows.where("vkey IS NOT NULL").groupBy("vkey").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = stored(classes, "classes")
    buckets = classes.select("cid", "n", "vec").mapInArrow(_hashed(dtype, tables, bits), "bucket long, cid long, n long, vec binary, signs binary")
    large = stored(classes.select("cid", "n", "vec").mapInArrow(_hashed(dtype, tables, bits), "bucket long, cid long, n long, vec binary, signs binary")
                   .groupBy("bucket").count().where(f"count > {TILE_ROWS}"), "large")
    buckets = buckets.withColumn("tab", F.expr(f"cast(shiftright(bucket, {bits}) AS int)"))
    usual = buckets.join(small(large.select("bucket")), "bucket", "left_anti").selectExpr("bucket", "tab", "2 AS side", "cid", "n", "vec", "signs")

    def verified(part: DataFrame) -> DataFrame:
        return part.repartition("bucket").sortWithinPartitions("bucket", "cid").mapInArrow(_verify(dtype, bits, threshold), "a long, b long, n long")

    found = verified(usual)
    if not large.isEmpty():
        found = found.union(verified(_dealt(buckets, large)))
    found = stored(found, "links")
    degrees = found.where("a = b").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "cid")
    roots = stored(components(found.where("a <> b").select("a", "b")), "roots").withColumnRenamed("node", "cid")
    named = classes.join(degrees, "cid", "left").join(roots, "cid", "left")
    named = stored(named.selectExpr("vkey", "n - 1 + coalesce(links, 0) AS n_links", "coalesce(root, cid) AS component_id"), "named")
    out = rows.select("vec_id", "vkey").join(named, "vkey", "left")
    return out.selectExpr("vec_id", "coalesce(n_links, 0) AS n_links", "coalesce(component_id, vec_id) AS component_id", "coalesce(component_id, vec_id) <=> vec_id AND vec_id IS NOT NULL AS kept")
