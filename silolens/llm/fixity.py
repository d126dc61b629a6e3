"""Merkle fixity audit of replicated WARC files.

Records lie in files at offsets. Record digests are hashed into digests of
offset ranges, those into nodes of a fixed fan-out up to one root a file. Two
replicas compare roots first and descend into differing branches only, so what
they exchange follows the damage, not the archive. Every group that is hashed
is bounded: by the bytes of a range, or by the fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silolens.llm.common import stored

FILE_BYTES = 64 << 20
RANGE_BYTES = 256 << 10
FANOUT = 16
LEVELS = 3  # of nodes above the ranges, the last being the root


def records(table: DataFrame, id_col: str, parts: list[str]) -> DataFrame:
    """``record_id, digest, damaged, size, copies``: each distinct record with its digest.

    A field is written with its length in bytes before it and a null as a dash,
    so no two rows share a payload; equal rows are one record that is stored so
    many times. ``damaged`` is the digest of the payload with one byte more:
    what a damaged copy would give.
    """
    fields = [F.col(f"`{c}`").cast("string") for c in (id_col, *parts)]
    body = F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields])
    each = table.select(F.col(f"`{id_col}`").alias("record_id"), F.sha2(body, 256).alias("digest"), F.sha2(F.concat(body, F.lit("#")), 256).alias("damaged"), F.octet_length(body).cast("long").alias("size"))
    return each.groupBy("record_id", "digest", "damaged", "size").agg(F.count("*").alias("copies"))


def laid_out(found: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Records with ``file`` and ``start``: files of about ``file_bytes``, dealt by digest.

    The digest covers the record's id, so no source or key can fill a file; each
    file's running sum sees a bounded number of records.
    """
    total = found.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    dealt = found.withColumn("file", F.expr(f"conv(substring(digest, 1, 12), 16, 10) % {files}").cast("long"))
    before = F.expr("sum(size * copies) OVER (PARTITION BY file ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return dealt.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def tree(leaves: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Node tables ``file, node, digest`` from the ranges (first) up to the roots (last).

    A node's digest is over its children in order, with their places, so a
    record that is lost or moved changes it like one that is altered.
    """
    at = leaves.withColumn("node", F.expr(f"start div {range_bytes}"))
    listed = F.expr("array_join(transform(array_sort(collect_list(struct(start, size, digest))), x -> concat_ws(':', x.start, x.size, x.digest)), ',')")
    nodes = [stored(at.groupBy("file", "node").agg(F.sha2(listed, 256).alias("digest")), "ranges")]
    for level in range(levels):
        up = F.lit(0) if level == levels - 1 else F.expr(f"node div {fanout}")
        below = nodes[-1].withColumn("up", up.cast("long"))
        listed = F.expr("array_join(transform(array_sort(collect_list(struct(node, digest))), x -> concat_ws(':', x.node, x.digest)), ',')")
        nodes.append(stored(below.groupBy("file", "up").agg(F.sha2(listed, 256).alias("digest")).withColumnRenamed("up", "node"), "nodes"))
    return nodes


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, levels: int = LEVELS,
          trees: tuple[list[DataFrame], list[DataFrame]] | None = None) -> DataFrame:
    """``file, start, size, expected, found, status``: the records in which two replicas differ.

    Both are ``file, start, size, digest``; ``trees`` are theirs, if the caller has built them. ``status`` is altered, missing or
    added. Equal replicas, or two empty ones, give an empty result; a file that
    one side lacks is reported whole. A last level gathers at most the nodes of
    one file: raise ``levels`` for files over range_bytes * fanout ** levels.
    """
    ours, theirs = trees or (tree(primary, range_bytes, fanout, levels), tree(replica, range_bytes, fanout, levels))
    branch = None
    for level in range(levels, -1, -1):
        up = F.lit(0) if level == levels - 1 else F.expr(f"node div {fanout}")
        sides = []
        for side in (ours[level], theirs[level]):
            if branch is not None:
                side = side.withColumn("up", up.cast("long")).join(branch, ["file", "up"], "left_semi").drop("up")
            sides.append(side)
        a, b = sides[0].withColumnRenamed("digest", "x"), sides[1].withColumnRenamed("digest", "y")
        differing = a.join(b, ["file", "node"], "full").where("NOT (x <=> y)")
        branch = stored(differing.selectExpr("file", "node AS up"), "differing")
    sides = [s.withColumn("up", F.expr(f"start div {range_bytes}")).join(branch, ["file", "up"], "left_semi").drop("up") for s in (primary, replica)]
    a, b = sides[0].withColumnRenamed("digest", "expected"), sides[1].withColumnRenamed("digest", "found")
    met = a.join(b, ["file", "start", "size"], "full").where("NOT (expected <=> found)")
    return met.withColumn("status", F.expr("CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'added' ELSE 'altered' END"))
