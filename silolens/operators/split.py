"""Stratified splits and client partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from silolens.functions.hashing import gaussian, hash_hex, uniform
from silolens.operators.hashcut import DIGITS, EDGE_ROWS, bucket_counts, cut_at, cut_by_hash, hash_rank, key_hash
from silolens.session import SMALL_ROWS, bounded_rows, cut_lineage, local_table


def largest_remainder(counts: DataFrame, by: list[str], label: str, want: Column, n: str = "n", total: str = "total",
                      out: str = "quota") -> DataFrame:
    """Share ``want`` units among the labels of a group in proportion to ``n``.

    Floors first, then one unit each to the largest remainders, ties to the
    lowest label. Integer arithmetic, wide enough for 1e12 x 1e12.
    """
    based = counts.withColumn("_want", want).withColumns({
        "_product": F.col("_want").cast("decimal(19,0)") * F.col(n).cast("decimal(19,0)"),
        "_of": F.nullif(F.col(total), F.lit(0)).cast("decimal(19,0)"),
    })
    # `div` is exact; a decimal `/` would round its last digits.
    based = based.withColumn("_base", F.coalesce(F.expr("_product div _of"), F.lit(0)))
    based = based.withColumn("_rest", F.col("_product") - F.col("_base").cast("decimal(19,0)") * F.col("_of"))
    group = Window.partitionBy(*by)
    order = group.orderBy(F.col("_rest").desc(), F.col(label))
    left = F.col("_want") - F.sum("_base").over(group)
    return (
        based.withColumn("_left", left)
        .withColumn(out, F.col("_base") + (F.row_number().over(order) <= F.col("_left")).cast("bigint"))
        .drop("_want", "_product", "_of", "_base", "_rest", "_left")
    )


def split_quotas(buckets: DataFrame, by: list[str], label: str, test_fraction: float | None = None,
                 n_train: int | None = None, n_test: int | None = None) -> DataFrame:
    """(by..., label, n, train, test): exact rows of each class on each side, from rows per hash bucket."""
    counts = buckets.groupBy(*by, label).agg(F.sum("n").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    if test_fraction is not None:
        counts = counts.withColumn("_test", F.ceil(F.col("total") * F.lit(float(test_fraction))).cast("bigint"))
        counts = counts.withColumn("_train", F.col("total") - F.col("_test"))
    else:
        counts = counts.withColumns({"_train": F.lit(n_train).cast("bigint"), "_test": F.lit(n_test).cast("bigint")})
    train = largest_remainder(counts, by, label, F.col("_train"), out="train")
    left = train.withColumns({"_n": F.col("n") - F.col("train"), "_t": F.col("total") - F.col("_train")})
    return largest_remainder(left, by, label, F.col("_test"), n="_n", total="_t", out="test").drop(
        "_n", "_t", "_train", "_test", "total"
    )


def _split(df: DataFrame, by: list[str], label: str, keys: list[str], seed: int, salt: str, **sizes) -> DataFrame:
    """Quotas and cuts both come from one count of rows per stratum and hash bucket.

    Few strata: the counts come to the driver, so that one more job finds the
    edges. Many: everything stays distributed, and strata that a window can hold
    are ranked whole, with one shuffle of the rows.
    """
    strata = [*by, label]
    if by:
        sizes_of = df.groupBy(*strata).agg(F.count("*").alias("n")).persist()
        try:
            many = sizes_of.agg(F.count("*").alias("strata"), F.max("n").alias("most")).first()
            if many["strata"] > SMALL_ROWS // 16**DIGITS and many["most"] <= EDGE_ROWS:
                cuts = cut_lineage(split_quotas(sizes_of, by, label, **sizes).select(*strata, "train", "test"), "quotas")
                return _named_sides(_ranked_sides(df, cuts, strata, keys, seed, salt), sizes)
        finally:
            sizes_of.unpersist()
    buckets = bucket_counts(df, strata, keys, seed, salt).persist()
    try:
        rows = bounded_rows(buckets)
        if rows is not None:
            marks = _split_marks(rows, by, label, **sizes)
            schema = StructType([*[buckets.schema[s] for s in strata], *StructType.fromDDL("cut bigint, need bigint").fields])
            if len(marks) <= SMALL_ROWS:
                return _named_sides(cut_at(df, marks, schema, strata, keys, seed, salt, "_part", rows), sizes)
        parts = cut_by_hash(df, _split_cuts(split_quotas(buckets, by, label, **sizes), strata), strata, keys, seed, salt, "_part", buckets)
    finally:
        buckets.unpersist()
    return _named_sides(parts, sizes)


def _ranked_sides(df: DataFrame, cuts: DataFrame, strata: list[str], keys: list[str], seed: int, salt: str) -> DataFrame:
    """``_part`` from each row's rank in its stratum, whose quotas come as its first row: one shuffle, and no join."""
    rows = df.withColumns({"_h": F.unhex(key_hash(keys, seed, salt)), "_row": F.lit(1)})
    first = cuts.withColumn("_row", F.lit(0))
    order = Window.partitionBy(*strata).orderBy("_row", "_h", *keys)
    rank, train, test = F.row_number().over(order) - 1, F.first("train").over(order), F.first("test").over(order)
    part = F.when(rank <= train, 0).when(rank <= train + test, 1).otherwise(2)
    return rows.unionByName(first, allowMissingColumns=True).withColumn("_part", part).where("_row = 1").drop("_h", "_row", "train", "test")


def _named_sides(parts: DataFrame, sizes: dict) -> DataFrame:
    named = F.when(F.col("_part") == 0, F.lit("train")).when(F.col("_part") == 1, F.lit("test"))
    named_rows = parts.withColumn("split", named).drop("_part")
    return named_rows if sizes.get("test_fraction") is not None else named_rows.where("split is not null")


def _quotas(counts: dict, want: int) -> dict:
    """:func:`largest_remainder` of one group whose counts the driver holds."""
    total = sum(counts.values())
    if not total:
        return dict.fromkeys(counts, 0)
    base = {c: want * n // total for c, n in counts.items()}
    left = want - sum(base.values())
    order = sorted(counts, key=lambda c: (-(want * counts[c] % total), c is not None, c))
    return {c: base[c] + (i < left) for i, c in enumerate(order)}


def _split_marks(rows: list[Row], by: list[str], label: str, test_fraction: float | None = None,
                 n_train: int | None = None, n_test: int | None = None) -> list[tuple]:
    """(by..., label, cut, need) of each class, from collected bucket counts: as :func:`split_quotas`."""
    groups: dict[tuple, dict] = {}
    for r in rows:
        counts = groups.setdefault(tuple(r[b] for b in by), {})
        counts[r[label]] = counts.get(r[label], 0) + r["n"]
    marks = []
    for group, counts in groups.items():
        total = sum(counts.values())
        test = math.ceil(total * float(test_fraction)) if test_fraction is not None else n_test
        train = _quotas(counts, total - test if test_fraction is not None else n_train)
        held = _quotas({c: n - train[c] for c, n in counts.items()}, test)
        for c, n in counts.items():
            marks.append((*group, c, 0, train[c]))
            if train[c] + held[c] < n:
                marks.append((*group, c, 1, train[c] + held[c]))
    return marks


def _split_cuts(quotas: DataFrame, strata: list[str]) -> DataFrame:
    return quotas.select(
        *strata, F.explode(F.array(
            F.struct(F.lit(0).alias("cut"), F.col("train").alias("need")),
            F.struct(F.lit(1).alias("cut"), (F.col("train") + F.col("test")).alias("need")),
        )).alias("c"), "n",
    ).select(*strata, "c.cut", "c.need", "n").where("cut = 0 or need < n").drop("n")


def stratified_split(df: DataFrame, label: str, keys: list[str], n_train: int | None = None,
                     n_test: int | None = None, test_fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Add ``split`` (train/test) with exact sizes and the class ratio kept.

    Give ``n_train`` and ``n_test``, or ``test_fraction`` (rounded up to whole
    rows). Rows beyond n_train + n_test are left out.
    """
    if test_fraction is None:
        if n_train is None or n_test is None:
            raise ValueError("give n_train and n_test, or test_fraction")
        have = df.count()
        if have < n_train + n_test:
            raise ValueError(f"the table has {have} rows; {n_train + n_test} are asked for")
    return _split(df, [], label, keys, seed, "split", test_fraction=test_fraction, n_train=n_train, n_test=n_test)


def client_split(df: DataFrame, label: str, keys: list[str], test_fraction: float, client: str = "client_id",
                 seed: int = 42) -> DataFrame:
    """A stratified train/test split inside every client; ceil(n x fraction) test rows."""
    return _split(df, [client], label, keys, seed, "client_split", test_fraction=test_fraction)


def _class_counts(df: DataFrame, label: str) -> dict:
    rows = bounded_rows(df.groupBy(label).agg(F.count("*").alias("n")))
    if rows is None:
        raise ValueError(f"{label} has more than {SMALL_ROWS} distinct values; it is not a class label")
    return {r[label]: r["n"] for r in sorted(rows, key=lambda r: r[label])}


def _no_empty_clients(sizes: list[int]) -> None:
    empty = [c for c, n in enumerate(sizes) if n == 0]
    if empty:
        raise ValueError(f"{len(empty)} clients would receive no rows: {empty[:20]}")


def partition_iid(df: DataFrame, n_clients: int, label: str, keys: list[str], seed: int = 42) -> DataFrame:
    """Deal each class, in hash order, in runs of ceil(n_class / n_clients) rows to clients 0, 1, ..."""
    counts = _class_counts(df, label)
    run = {c: math.ceil(n / n_clients) for c, n in counts.items()}
    filled = max(math.ceil(n / run[c]) for c, n in counts.items())
    if filled < n_clients:
        _no_empty_clients([1] * filled + [0] * (n_clients - filled))
    if n_clients * len(counts) > SMALL_ROWS:
        runs = local_table(df.sparkSession, list(run.items()), f"`{label}` {df.schema[label].dataType.simpleString()}, _run bigint")
        ranked = hash_rank(df, [label], keys, seed, "iid", out="_rank", carry=runs)
        return ranked.withColumn("client_id", F.floor((F.col("_rank") - 1) / F.col("_run")).cast("int")).drop("_rank", "_run")
    cuts = [(c, i, i * run[c] + run[c]) for c, n in counts.items() for i in range(n_clients - 1) if (i + 1) * run[c] < n]
    schema = f"`{label}` {df.schema[label].dataType.simpleString()}, cut bigint, need bigint"
    return cut_by_hash(df, local_table(df.sparkSession, cuts, schema), [label], keys, seed, "iid", out="client_id")


#: Draws of a gamma value; the chance that all are rejected is below 1e-15, and the mode stands in then.
GAMMA_DRAWS = 12
UNIT = 1 << 30
#: Clients whose sizes are summed up in one window.
CLIENT_BUCKET = 4096


def gamma_units(alpha: float, seed: int, label: str, client: str) -> Column:
    """A Gamma(``alpha``) value of (label, client) in whole units, 1 at least.

    Rejection with a hash counter: draw k takes its normal and its uniform from
    the hash of (label, client, k); the first accepted draw counts.
    """
    shape = alpha if alpha >= 1 else alpha + 1
    d = shape - 1 / 3
    c = 1 / math.sqrt(9 * d)
    key = [F.col(f"`{label}`"), F.col(client)]

    def draw(k: Column) -> Column:
        digest = hash_hex(seed, "gamma", *key, k)
        return F.struct(gaussian(digest).alias("x"), F.log(uniform(digest, 2)).alias("u"))

    def cubed(s: Column) -> Column:
        return F.struct(s["x"].alias("x"), s["u"].alias("u"), F.pow(F.lit(1.0) + F.lit(c) * s["x"], F.lit(3.0)).alias("v"))

    def accepted(s: Column) -> Column:
        return (s["v"] > 0) & (s["u"] < F.lit(0.5) * s["x"] * s["x"] + F.lit(d) - F.lit(d) * s["v"] + F.lit(d) * F.log(s["v"]))

    draws = F.transform(F.transform(F.sequence(F.lit(0), F.lit(GAMMA_DRAWS - 1)), draw), cubed)
    value = F.lit(d) * F.coalesce(F.get(F.filter(draws, accepted), F.lit(0))["v"], F.lit(1.0))
    if alpha < 1:
        value = value * F.pow(uniform(hash_hex(seed, "boost", *key)), F.lit(1 / alpha))
    return F.floor(value * F.lit(float(UNIT))).cast("bigint") + F.lit(1)


def dirichlet_sizes(spark: SparkSession, counts: dict, n_clients: int, alpha: float, seed: int, label: str, kind: str) -> DataFrame:
    """(label, client_id, units, size): each class's rows dealt by its own Dirichlet shares.

    Shares are units over the class's units, sizes their floors in exact
    integers; the rounding rest goes to client 0. Clients are rows: none passes
    through the driver.
    """
    classes = F.explode(F.array(*[F.struct(F.lit(c).cast(kind).alias(label), F.lit(n).cast("bigint").alias("_n")) for c, n in counts.items()]))
    drawn = spark.range(n_clients).select(F.col("id").cast("int").alias("client_id"), classes.alias("_c")).select("client_id", "_c.*")
    drawn = cut_lineage(drawn.withColumn("units", gamma_units(alpha, seed, label, "client_id")), "dirichlet")
    totals = drawn.groupBy(label).agg(F.sum("units").cast("decimal(19,0)").alias("_all"))  # a row a class
    product = F.col("_n").cast("decimal(19,0)") * F.col("units").cast("decimal(19,0)")
    floors = drawn.withColumn("_product", product).join(F.broadcast(totals), label).withColumn("size", F.expr("_product div _all"))
    rest = floors.groupBy(label).agg((F.first("_n") - F.sum("size")).alias("_rest"))
    first = F.when(F.col("client_id") == 0, F.col("_rest")).otherwise(F.lit(0))
    return floors.join(F.broadcast(rest), label).select(F.col(f"`{label}`"), "client_id", "units", (F.col("size") + first).alias("size"))


def running_sizes(sizes: DataFrame, label: str) -> DataFrame:
    """``sizes`` with ``upto``: rows of the class dealt to clients up to this one.

    Sums of client buckets first, then within a bucket: no window holds more
    than ``CLIENT_BUCKET`` clients or a class's buckets.
    """
    dealt = sizes.withColumn("_bucket", F.floor(F.col("client_id") / F.lit(CLIENT_BUCKET)).cast("bigint"))
    sums = dealt.groupBy(label, "_bucket").agg(F.sum("size").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(label).orderBy("_bucket")) - F.col("_size")
    inside = F.sum("size").over(Window.partitionBy(label, "_bucket").orderBy("client_id"))
    offsets = sums.select(F.col(f"`{label}`"), "_bucket", before.alias("_before"))
    return dealt.withColumn("_inside", inside).join(offsets, [label, "_bucket"]).withColumn("upto", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_bucket")


def partition_dirichlet(df: DataFrame, n_clients: int, alpha: float, label: str, keys: list[str],
                        seed: int = 42) -> DataFrame:
    """Clients with skewed class mixes: each class is dealt by its own Dirichlet shares."""
    kind = df.schema[label].dataType.simpleString()
    sizes = cut_lineage(dirichlet_sizes(df.sparkSession, _class_counts(df, label), n_clients, alpha, seed, label, kind), "sizes")
    empty = sizes.groupBy("client_id").agg(F.sum("size").alias("n")).where("n = 0").orderBy("client_id")
    some = [r["client_id"] for r in empty.limit(20).collect()]
    if some:
        raise ValueError(f"{empty.count()} clients would receive no rows: {some}")
    ends = running_sizes(sizes, label).where(F.col("client_id") < n_clients - 1)
    cuts = ends.select(F.col(f"`{label}`"), F.col("client_id").alias("cut"), F.col("upto").alias("need"))
    return cut_by_hash(df, cuts, [label], keys, seed, "dirichlet", out="client_id")


def partition_rows(df: DataFrame, strategy: str, n_clients: int, label: str, keys: list[str], alpha: float = 0.5,
                   seed: int = 42) -> DataFrame:
    if strategy == "iid":
        return partition_iid(df, n_clients, label, keys, seed)
    if strategy == "non_iid":
        return partition_dirichlet(df, n_clients, alpha, label, keys, seed)
    raise ValueError(f"unknown partition strategy {strategy!r}; use 'iid' or 'non_iid'")


def partition_summary(df: DataFrame, label: str = "target", client: str = "client_id") -> DataFrame:
    """Rows and positives per client and side, and the failure rate of the train side."""
    def tally(side: str, what: Column) -> Column:
        return F.sum(F.when(F.col("split") == side, what).otherwise(F.lit(0))).cast("bigint")

    out = df.groupBy(client).agg(
        tally("train", F.lit(1)).alias("n_train"), tally("test", F.lit(1)).alias("n_test"),
        tally("train", F.col(label)).alias("train_positives"), tally("test", F.col(label)).alias("test_positives"),
    )
    rate = F.col("train_positives") / F.nullif(F.col("n_train"), F.lit(0))
    return out.withColumn("train_failure_rate", F.round(rate, 4))


def dataset_metadata(df: DataFrame, label: str = "target") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum(label).cast("bigint").alias("n_failures"))
