"""Exact cuts and exact ranks in hash order, without a global sort.

``cut_by_hash`` answers "which rows are among the first r of their stratum" by
finding the hash of the r-th row with a radix search: count rows per leading
hash digits, locate the bucket that holds rank r, refine that bucket only, and
rank the few rows left. The rows themselves are then labelled by comparing
their hash with the found thresholds, a projection without a shuffle.

``hash_rank`` gives every row its exact rank. It shuffles the rows once, by
(stratum, hash bucket), so that even a stratum with a third of all rows is
spread over thousands of window groups.

The row key must be unique; :func:`assert_unique_key` checks that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from silolens.functions.hashing import hash_hex
from silolens.session import SMALL_ROWS, bounded_rows, local_table, small

# A located bucket is ranked by a window once it holds at most this many rows.
EDGE_ROWS = 1_000_000
DIGITS = 3
MAX_DIGITS = 12


def key_hash(keys: list[str], seed: int, salt: str) -> Column:
    return hash_hex(seed, salt, *[F.col(k) for k in keys])


def assert_unique_key(df: DataFrame, keys: list[str]) -> None:
    clash = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"row key {keys} is not unique, e.g. {clash[0].asDict()}")


def hash_rank(
    df: DataFrame, strata: list[str], keys: list[str], seed: int, salt: str = "", digits: int = 4,
    out: str = "rank", carry: DataFrame | None = None,
) -> DataFrame:
    """Exact 1-based rank in hash order within each stratum.

    ``carry`` holds columns per stratum to attach to its rows. They ride on the
    bucket table, so rows never meet on the stratum alone, however large it is.
    """
    hashed = df.withColumn("_h", key_hash(keys, seed, salt)).withColumn("_b", F.substring("_h", 1, digits))
    group = [*strata, "_b"]
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*group).count()
        .withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    if carry is not None:
        starts = starts.join(carry, strata, "left")
    inside = Window.partitionBy(*group).orderBy("_h", *keys)
    return (
        hashed.join(small(starts), group)
        .withColumn(out, F.col("_start") + F.row_number().over(inside))
        .drop("_h", "_b", "_start")
    )


def bucket_counts(df: DataFrame, strata: list[str], keys: list[str], seed: int, salt: str = "") -> DataFrame:
    """(strata..., bucket, n): rows per leading hash digits, the first step of every cut."""
    hashed = df.select(*strata, key_hash(keys, seed, salt).alias("h"))
    return hashed.groupBy(*strata, F.substring("h", 1, DIGITS).alias("bucket")).agg(F.count("*").alias("n"))


def _locate(counts: DataFrame, marks: DataFrame, group: list[str]) -> DataFrame:
    """Find the bucket that holds the ``need``-th row of each group.

    Buckets and marks are merged on one axis of row positions, so the work per
    group is buckets + marks, never their product.
    """
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    null_int = F.lit(None).cast("bigint")
    buckets = counts.select(
        *group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pos"), F.lit(0).alias("kind"),
        "bucket", "n", null_int.alias("cut"), null_int.alias("need"),
    )
    wanted = marks.select(
        *group, (F.col("need") - 1).alias("pos"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("bucket"), null_int.alias("n"), "cut", "need",
    )
    upto = Window.partitionBy(*group).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("kind") == 0, F.col("pos")), ignorenulls=True).over(upto)
    return (
        buckets.unionByName(wanted)
        .select(
            *group, "cut", (F.col("need") - start).alias("need"),
            F.last("bucket", ignorenulls=True).over(upto).alias("bucket"),
            F.last("n", ignorenulls=True).over(upto).alias("n"),
        )
        .where("cut is not null and bucket is not null and need <= n")
    )


def _locate_rows(counts: list[Row], marks: list, strata: list[str]) -> list[tuple]:
    """:func:`_locate` over counts that the driver holds: (strata..., cut, need, bucket, n)."""
    of: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
    for r in counts:
        of[tuple(r[s] for s in strata)].append((r["bucket"], r["n"]))
    upto = {k: list(accumulate(n for _, n in sorted(v))) for k, v in of.items()}
    out = []
    for m in marks:
        *stratum, cut, need = m
        ends = upto.get(tuple(stratum), [])
        at = bisect_left(ends, need)
        if at < len(ends):
            bucket, n = sorted(of[tuple(stratum)])[at]
            out.append((*stratum, cut, need - (ends[at] - n), bucket, n))
    return out


def _thresholds(df: DataFrame, marks: list, strata: list[str], keys: list[str], seed: int, salt: str,
                schema: StructType, counts: DataFrame | list[Row]) -> list:
    """(strata..., cut, h) where h is the hash of the wanted row."""
    spark = df.sparkSession
    hashed = df.select(*strata, key_hash(keys, seed, salt).alias("h"))
    todo = F.broadcast(local_table(spark, marks, schema))
    group, digits = list(strata), DIGITS
    while True:
        if isinstance(counts, list):
            found = _locate_rows(counts, marks, strata)
            fields = StructType([*[schema[s] for s in strata], *StructType.fromDDL("cut bigint, need bigint, bucket string, n bigint").fields])
        else:
            table = _locate(counts, todo, group)
            found, fields = [tuple(r) for r in table.collect()], table.schema
        if not found:
            return []
        located = local_table(spark, found, fields)
        if max(r[-1] for r in found) <= EDGE_ROWS or digits >= MAX_DIGITS:
            break
        # Refine: only rows inside a located bucket are counted again.
        todo = F.broadcast(located.select(*strata, F.col("bucket").alias("inside"), "cut", "need"))
        scope = (
            hashed.withColumn("inside", F.substring("h", 1, digits))
            .join(F.broadcast(todo.select(*strata, "inside").distinct()), [*strata, "inside"])
        )
        group, digits = [*strata, "inside"], digits + DIGITS
        counts = scope.groupBy(*group, F.substring("h", 1, digits).alias("bucket")).agg(F.count("*").alias("n"))
    edges = F.broadcast(located.select(*strata, "bucket").distinct())
    rank = F.row_number().over(Window.partitionBy(*strata, "bucket").orderBy("h")).cast("bigint")
    ranked = (
        hashed.withColumn("bucket", F.substring("h", 1, digits))
        .join(edges, [*strata, "bucket"])
        .withColumn("need", rank)
    )
    wanted = F.broadcast(located.select(*strata, "bucket", "need", "cut"))
    return ranked.join(wanted, [*strata, "bucket", "need"]).select(*strata, "cut", "h").collect()


def _passed(cuts: str, h: str, most: int) -> Column:
    """How many sorted thresholds lie below ``h``."""
    if most <= 16:
        return F.expr(" + ".join(f"coalesce(cast(get({cuts}, {i}) < {h} as int), 0)" for i in range(most)))
    return F.expr(f"size(filter({cuts}, c -> c < {h}))")


def cut_by_hash(
    df: DataFrame, cuts: DataFrame, strata: list[str], keys: list[str], seed: int, salt: str = "",
    out: str = "part", counts: DataFrame | None = None,
) -> DataFrame:
    """Number the parts of each stratum: part = how many cuts lie before the row.

    ``cuts`` has (strata..., cut, need): the first ``need`` rows of the stratum,
    in hash order, are in parts up to ``cut``. Exact for any number of cuts: up
    to SMALL_ROWS of them the thresholds are broadcast, beyond that rows are
    ranked and joined with their stratum's cuts. ``counts`` are the table's
    :func:`bucket_counts`, if the caller has them already.
    """
    cuts = cuts.select(*strata, F.col("cut").cast("bigint"), F.col("need").cast("bigint"))
    marks = bounded_rows(cuts)
    if marks is not None:
        return cut_at(df, [tuple(m) for m in marks], cuts.schema, strata, keys, seed, salt, out, counts)
    return _cut_by_rank(df, cuts, strata, keys, seed, salt, out)


def _cut_by_rank(df: DataFrame, cuts: DataFrame, strata: list[str], keys: list[str], seed: int, salt: str, out: str) -> DataFrame:
    """Any number of cuts: rows and cuts are merged on one axis of ranks inside each hash bucket.

    A bucket's rows see the number of cuts before it, and the cuts inside it as
    rows between theirs: no row carries a list of cuts.
    """
    hashed = df.withColumn("_h", key_hash(keys, seed, salt)).withColumn("_b", F.substring("_h", 1, 4))
    group = [*strata, "_b"]
    starts = hashed.groupBy(*group).agg(F.count("*").alias("n"))
    located = _locate(starts.withColumnRenamed("_b", "bucket"), cuts.where("need > 0"), list(strata))
    inside = located.select(*strata, F.col("bucket").alias("_b"), "need")
    tally = inside.groupBy(*group).agg(F.count("*").alias("_in"))
    zero = cuts.where("need <= 0").groupBy(*strata).agg(F.count("*").alias("_zero"))
    passed = _attach(starts.drop("n"), tally, group)
    passed = _attach(passed, zero, strata) if strata else passed.withColumn("_zero", F.lit(zero.first()[0]))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_in").over(before), F.lit(0)) + F.coalesce("_zero", F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_h", *keys)).cast("bigint")
    ranked = hashed.withColumns({"_rank": rank, "_mark": F.lit(0)})
    marks = inside.select(*group, F.col("need").alias("_rank"), F.lit(1).alias("_mark"))
    upto = Window.partitionBy(*group).orderBy("_rank", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    axis = ranked.unionByName(marks, allowMissingColumns=True).withColumn("_over", F.sum("_mark").over(upto)).where("_mark = 0")
    labelled = _attach(axis, small(passed.select(*group, base.cast("int").alias("_base"))), group)
    return labelled.withColumn(out, (F.coalesce("_base", F.lit(0)) + F.col("_over")).cast("int")).select(*df.columns, out)


def _attach(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Left join on columns that may be null; right rows are unique on them."""
    renamed = right.withColumnsRenamed({c: f"_of_{c}" for c in names})
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names])
    return left.join(renamed, on, "left").drop(*[f"_of_{c}" for c in names])


def cut_at(df: DataFrame, marks: list[tuple], schema: StructType, strata: list[str], keys: list[str], seed: int, salt: str,
           out: str, counts: DataFrame | list[Row] | None = None) -> DataFrame:
    """:func:`cut_by_hash` at marks (strata..., cut, need) that the driver holds, at most SMALL_ROWS of them.

    With collected ``counts`` one job finds the thresholds; the labels are a projection.
    """
    spark = df.sparkSession
    if not marks:
        return df.withColumn(out, F.lit(0))
    real = [m for m in marks if m[-1] > 0]
    if counts is None:
        counts = bucket_counts(df, strata, keys, seed, salt)
    found = _thresholds(df, real, strata, keys, seed, salt, schema, counts) if real else []
    by_stratum: dict[tuple, list[str]] = defaultdict(list)
    for m in marks:  # a cut at rank 0 lies before every row; one past the end lies after all
        if m[-1] <= 0:
            by_stratum[tuple(m[: len(strata)])].append("")
    for t in found:
        by_stratum[tuple(t[s] for s in strata)].append(t["h"])
    fields = ", ".join(f"`{s}` {schema[s].dataType.simpleString()}" for s in strata)
    lead = f"{fields}, " if fields else ""
    most = max((len(v) for v in by_stratum.values()), default=0)
    if most == 0:
        return df.withColumn(out, F.lit(0))
    hashed = df.withColumn("_h", key_hash(keys, seed, salt))
    if most > 16 and len(by_stratum) * 16**DIGITS <= SMALL_ROWS:
        # Many cuts per stratum: look up the row's bucket, compare inside it only.
        table = []
        for stratum, hashes in by_stratum.items():
            hashes.sort()
            split: dict[str, list[str]] = defaultdict(list)
            for h in hashes:
                split[h[:DIGITS]].append(h)
            base = len(split.pop("", []))
            for b in range(16**DIGITS):
                prefix = f"{b:0{DIGITS}x}"
                table.append((*stratum, prefix, base, split.get(prefix, [])))
                base += len(split.get(prefix, []))
        lookup = local_table(spark, table, f"{lead}_b string, _base int, _cuts array<string>")
        hashed = hashed.withColumn("_b", F.substring("_h", 1, DIGITS))
        joined = hashed.join(F.broadcast(lookup), [*strata, "_b"], "left")
        inside = F.size(F.filter("_cuts", lambda c: c < F.col("_h")))
        part = F.coalesce(F.col("_base") + inside, F.lit(0))
        return joined.withColumn(out, part.cast("int")).drop("_h", "_b", "_base", "_cuts")
    table = [(*stratum, sorted(hashes)) for stratum, hashes in by_stratum.items()]
    if strata:
        lookup = local_table(spark, table, f"{lead}_cuts array<string>")
        joined = hashed.join(F.broadcast(lookup), strata, "left")
    else:
        joined = hashed.withColumn("_cuts", F.array(*[F.lit(h) for h in table[0][-1]]))
    part = F.coalesce(_passed("_cuts", "_h", most), F.lit(0))
    return joined.withColumn(out, part.cast("int")).drop("_h", "_cuts")
