"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Two fingerprints that differ in at most three bits agree on at least two of
five bit blocks, so every link lies inside a bucket of equal (block, block)
values. Buckets are sorted by population count, cut into tiles and compared by
numpy exclusive-or and bit counts; tile pairs whose counts are further apart
than the radius are skipped. A bucket above ``TILE_ROWS`` is dealt out as pairs
of tiles, so no task holds it whole. Every bucket returns a star per component
in place of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silolens.llm.common import fresh, groups, row_hash, runs, star_edges, stored
from silolens.llm.components import components
from silolens.session import small

RADIUS = 3
SHINGLE_WORDS = 3
HASH_SEED = 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (lowest bit, bits): radius + 2 blocks
TILE_ROWS = 4096
BLOCK_ROWS = 512


def text_fingerprint(text: str | None) -> int:
    """Fingerprint of one text, unsigned; no words: zero."""
    words = (text or "").encode().lower().split()
    n = len(words) - SHINGLE_WORDS + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        cut = zip(starts[:n].tolist(), ends[SHINGLE_WORDS - 1 :].tolist())
        hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in cut), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        # eight one-byte counters to a word: sums of up to 255 rows cannot overflow
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((text_fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: a fingerprint (as a signed long) for every row; null text counts as empty."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _links(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (index, lower index) among fingerprints sorted by population count."""
    n, left, right = len(x), [], []
    tiles = [(a, min(a + BLOCK_ROWS, n)) for a in range(0, n, BLOCK_ROWS)]
    for i, (a, b) in enumerate(tiles):
        for c, d in tiles[i:]:
            if int(counts[c]) - int(counts[b - 1]) > RADIUS:
                break  # later tiles are further away still
            near = np.bitwise_count(x[a:b, None] ^ x[None, c:d]) <= RADIUS
            if a == c:
                if near.sum() == b - a:
                    continue
                label = star_edges(near)
                moved = np.flatnonzero(label != np.arange(b - a))
                left.append(moved + a)
                right.append(label[moved] + a)
            elif near.any():
                whole = np.zeros((b - a + d - c,) * 2, bool)
                whole[: b - a, b - a :], whole[b - a :, : b - a] = near, near.T
                at = np.concatenate([np.arange(a, b), np.arange(c, d)])
                label = star_edges(whole)
                moved = np.flatnonzero(label != np.arange(len(at)))
                left.append(at[moved])
                right.append(at[label[moved]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp) sorted by bucket and population count: the star edges of each bucket."""
    for chunk in groups(batches, "bucket"):
        bucket = chunk.column("bucket").to_numpy()
        fp = chunk.column("fp").to_numpy().view(np.uint64)
        counts = np.bitwise_count(fp)
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        starts, ends = runs(bucket)
        for i in np.flatnonzero(ends - starts > 1):
            s, e = starts[i], ends[i]
            left, right = _links(fp[s:e], counts[s:e])
            a.append(fp[s:e][left])
            b.append(fp[s:e][right])
        edges = np.unique(np.stack([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])


def _bucketed(distinct: DataFrame) -> DataFrame:
    """``bucket, fp``: ten rows a fingerprint, one for each pair of blocks."""
    keys = []
    for n, ((p, pw), (q, qw)) in enumerate(combinations(BLOCKS, 2)):
        first = f"(shiftrightunsigned(fp, {p}) & {(1 << pw) - 1}L)"
        second = f"(shiftrightunsigned(fp, {q}) & {(1 << qw) - 1}L)"
        keys.append(f"shiftleft({n}L, 26) | shiftleft({first}, 13) | {second}")
    return distinct.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("bucket"), "fp")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", F.bit_count("fp"), "fp").select("bucket", "fp")


def _dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Members of large buckets, dealt to pairs of tiles: (pair of tiles as bucket, fp).

    A tile is a slice of the members with one population count; pairs further
    apart than the radius do not exist.
    """
    members = rows.join(large.select("bucket"), "bucket").withColumn("ones", F.bit_count("fp"))
    sizes = members.groupBy("bucket", "ones").count().selectExpr("bucket", "ones", f"cast(ceil(count / {TILE_ROWS // 2}) AS int) AS tiles")
    sizes = stored(sizes, "tile_sizes")
    ahead = sizes.selectExpr("bucket", "ones AS ones2", "tiles AS tiles2")
    pairs = (
        sizes.join(ahead, "bucket").where(f"ones2 BETWEEN ones AND ones + {RADIUS}")
        .withColumn("s", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("s2", F.explode(F.expr("sequence(0, tiles2 - 1)")))
        .where("ones < ones2 OR s <= s2").withColumn("pair", F.expr("xxhash64(bucket, ones, s, ones2, s2)"))
    )
    ends = pairs.selectExpr("bucket", "ones", "s", "pair").union(pairs.selectExpr("bucket", "ones2", "s2", "pair")).distinct()
    cut = members.join(sizes, ["bucket", "ones"]).withColumn("s", F.expr("cast(pmod(xxhash64(fp), tiles) AS int)"))
    return cut.join(ends, ["bucket", "ones", "s"]).selectExpr("pair AS bucket", "fp")


def linked(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that connect all fingerprints within the radius, not every pair of them."""
    rows = stored(_bucketed(distinct), "buckets")
    large = small(rows.groupBy("bucket").count().where(f"count > {TILE_ROWS}").select("bucket"))
    usual = rows.join(large, "bucket", "left_anti")
    return _sorted(usual).mapInArrow(_compare, "a long, b long").union(_sorted(_dealt(rows, large)).mapInArrow(_compare, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most three
    differing bits. Texts without words, null and empty ones alike, have
    fingerprint zero and link like any other. Equal fingerprints are one node,
    so copies cost one row. Rows that repeat an id stay and get the same
    component; rows with a null id count as members, but name a component only
    if it has no other id (then null). An empty table gives an empty result.
    Other columns of ``docs`` are not read, whatever they are called.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = stored(components(linked(nodes.select("fp"))), "roots")
    member = roots.withColumnRenamed("node", "fp").join(nodes, "fp")
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = stored(roots.withColumnRenamed("node", "fp").join(stored(named, "named"), "root").select("fp", "component_id"), "moved")
    found = nodes.join(moved, "fp", "left").selectExpr("fp", "coalesce(component_id, first_id) AS component_id")
    return prints.join(stored(found, "components"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns unchanged: the one with the smallest id.

    Null ids come last. Where several rows share that id, the one whose row hash
    is lowest stays; rows that are equal throughout count once.
    """
    key, mark = fresh(docs, "id"), fresh(docs, "mark")
    rows = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(mark, row_hash(docs))
    prints = stored(rows.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"), F.col(mark).alias("mark"))
                    .mapInArrow(_marked_batches, "doc_id long, mark long, fp long"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")).alias("first"))
    nodes = stored(nodes, "nodes")
    roots = stored(components(linked(nodes.select("fp"))), "roots").withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).selectExpr("first.doc_id AS _d", "first.mark AS _m")
    times = prints.groupBy("doc_id", "mark").count()
    first = first.join(times, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_m") == F.col("mark")))
    first = stored(first.selectExpr("_d", "_m", "count > 1 AS _again"), "first")

    def met(which: DataFrame) -> DataFrame:
        return rows.join(which, rows[key].eqNullSafe(which["_d"]) & (rows[mark] == which["_m"]), "left_semi")

    kept, again = met(first.where("NOT _again")), first.where("_again")
    if not again.isEmpty():
        kept = kept.union(met(again).dropDuplicates([key, mark]))
    return kept.drop(key, mark)


def _marked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((text_fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(found.view(np.int64))], names=["doc_id", "mark", "fp"])
