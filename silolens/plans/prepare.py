"""Queries over sources, schema work, splits and partitions (A1-A5, B, C)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.operators import scale, schema, split
from silolens.operators.hashcut import hash_rank
from silolens.plans import fixtures as fx
from silolens.plans.fixtures import FEATURES, K, KEYS, NUMERIC, r, rounded
from silolens.plans.registry import query
from silolens.session import scratch_path
from silolens.sources import tables

RAW = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag"
ROUNDED_FEATURES = ", ".join(r(f'"{c}"') for c in FEATURES)


@query("a1_load_raw", f"SELECT {RAW} FROM lineitem")
def load_raw(spark: SparkSession, sf: str) -> DataFrame:
    return fx.lineitem(spark, sf)


@query("a1b_load_csv", f"SELECT {RAW} FROM lineitem")
def load_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "raw_csv")
    fx.lineitem(spark, sf).write.option("header", "true").csv(path)
    return tables.load_raw(spark, path, fx.LINEITEM, "csv")


@query("a2_prepared_roundtrip", f"WITH {fx.PREPARED} SELECT {K}, client_id, target, {ROUNDED_FEATURES}, split FROM prep")
def prepared_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, fitted = fx.prepared(spark, sf)
    path = scratch_path(spark, "prepared")
    tables.save_prepared(rows, path, fitted)
    again = tables.load_fitted(spark, path, [*NUMERIC, "type"])
    if again != fitted:
        raise ValueError("stats table does not restore the fitted preprocessor")
    return rounded(tables.load_prepared(spark, path, rows.schema))


@query("a3_dataset_metadata", f"WITH {fx.SPLIT} SELECT split, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS n_failures FROM rows_split GROUP BY split")
def dataset_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return split.dataset_metadata(fx.split_readings(spark, sf))


def client_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.readings(spark, sf)
    return split.client_split(rows, "target", KEYS, fx.TEST_FRACTION, seed=fx.SEED)


CLIENT_COLS = f"{K}, x1, x2, x3, x4, target, client_id, split"


def _saved_clients(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    rows = client_rows(spark, sf).select(*[c.strip() for c in CLIENT_COLS.split(",")])
    path = scratch_path(spark, "clients")
    tables.write_client_partitions(rows, path)
    return path, rows


@query("a4_client_partitions", f"WITH {fx.CLIENT_SPLIT} SELECT {CLIENT_COLS} FROM client_rows")
def client_partitions(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = _saved_clients(spark, sf)
    return spark.read.schema(rows.schema).parquet(path)


# Reading a single client's folders is the operator itself; the write covers every client.
@query("a5_load_client", f"WITH {fx.CLIENT_SPLIT} SELECT {CLIENT_COLS} FROM client_rows WHERE client_id = 2")
def load_client(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = _saved_clients(spark, sf)
    return tables.load_client(spark, path, rows.schema, 2)


@query("b1_normalize_schema", f"WITH {fx.READINGS} SELECT x1 AS a, x2 AS b, type, target FROM readings")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    # The first alias in column order wins; the later one is another table's leftover.
    raw = fx.readings(spark, sf).select(
        F.col("k1").alias(" UDI "), F.col("x1").alias(" a"), F.col("x2").alias("b "), F.col("type").alias(" type "),
        F.col("target").cast("double").alias(" Machine failure "),
    )
    return schema.drop_identifiers(schema.normalize_columns(raw))


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.readings(spark, sf)
    return rows.select(*KEYS, "target", F.col("twf").alias("TWF"), F.col("hdf").alias("HDF"), F.col("pwf").alias("PWF"), F.col("osf").alias("OSF"))


TYPE_CASE = (
    "CASE WHEN twf = 1 THEN 'Tool Wear Failure' WHEN hdf = 1 THEN 'Heat Dissipation Failure' "
    "WHEN pwf = 1 THEN 'Power Failure' WHEN osf = 1 THEN 'Overstrain Failure' ELSE 'No Failure' END"
)


@query("b2_failure_type", f"WITH {fx.READINGS} SELECT {K}, target, {TYPE_CASE} AS failure_type FROM readings")
def failure_type(spark: SparkSession, sf: str) -> DataFrame:
    typed = schema.derive_failure_type(_flagged(spark, sf))
    return typed.select(*KEYS, "target", F.col("Failure Type").alias("failure_type"))


@query("b3_drop_ids", f"WITH {fx.READINGS} SELECT x1, x2, x3, x4, type, target FROM readings")
def drop_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.readings(spark, sf).select("x1", "x2", "x3", "x4", "type", "target", F.col("k1").alias("UDI"), F.col("k2").alias("Product ID"))
    return schema.drop_identifiers(rows)


@query("b5_missing_counts", f"""WITH {fx.READINGS} SELECT CAST(0 AS BIGINT) AS x1, count(*) FILTER (WHERE x3 = 0) AS x3,
    count(*) FILTER (WHERE x4 = 0) AS x4, count(*) FILTER (WHERE type = 'A') AS type FROM readings""")
def missing(spark: SparkSession, sf: str) -> DataFrame:
    holed = fx.readings(spark, sf).select(
        "x1", F.nullif(F.col("x3"), F.lit(0.0)).alias("x3"),
        F.when(F.col("x4") == 0, F.lit(float("nan"))).otherwise(F.col("x4")).alias("x4"),
        F.nullif(F.col("type"), F.lit("A")).alias("type"),
    )
    return schema.missing_counts(holed, ["x1", "x3", "x4", "type"])


@query("b8_failure_rules", f"WITH {fx.READINGS} SELECT {K}, twf, hdf, pwf, osf, target, {TYPE_CASE} AS failure_type FROM readings")
def rules(spark: SparkSession, sf: str) -> DataFrame:
    return fx.readings(spark, sf).select(*KEYS, "twf", "hdf", "pwf", "osf", "target", "failure_type")


@query("b9_explain_subset", f"WITH {fx.SPLIT} SELECT {K}, target FROM rows_split WHERE split = 'test' ORDER BY {K} LIMIT 50")
def explain_subset(spark: SparkSession, sf: str) -> DataFrame:
    held_out = fx.split_readings(spark, sf).where("split = 'test'")
    return schema.first_rows(held_out.select(*KEYS, "target"), KEYS, 50)


@query("c1_stratified_split", f"WITH {fx.SPLIT} SELECT {K}, target, split FROM rows_split")
def stratified(spark: SparkSession, sf: str) -> DataFrame:
    return fx.split_readings(spark, sf).select(*KEYS, "target", "split")


N_TRAIN, N_TEST = 4000, 1000


def exact_sizes_sql() -> str:
    """Rows of each class on each side: largest remainders of the train side, then of the test side among the rest."""
    def shared(source: str, want: int, n: str, total: str, out: str, name: str) -> str:
        return f"""{name}_b AS (SELECT *, ({want} * ({n})) // ({total}) AS base, ({want} * ({n})) % ({total}) AS rest FROM {source}),
          {name} AS (SELECT * EXCLUDE (base, rest), base + CASE WHEN row_number() OVER (ORDER BY rest DESC, target) <= {want} - sum(base) OVER () THEN 1 ELSE 0 END AS {out} FROM {name}_b)"""

    return f"""{fx.READINGS}, cn AS (SELECT target, CAST(count(*) AS HUGEINT) AS n, CAST(sum(count(*)) OVER () AS HUGEINT) AS total FROM readings GROUP BY target),
      {shared('cn', N_TRAIN, 'n', 'total', 'n_train', 'tr')}, {shared('tr', N_TEST, 'n - n_train', f'total - {N_TRAIN}', 'n_test', 'te')},
      ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {fx.key_md5('split')}, {K}) AS rn FROM readings)"""


# Sizes given as rows; the rest of the table is left out, and the split checks that it has enough rows.
@query("c1c_exact_sizes", f"""WITH {exact_sizes_sql()} SELECT {K}, ranked.target, CASE WHEN rn <= n_train THEN 'train' ELSE 'test' END AS split
    FROM ranked JOIN te ON ranked.target = te.target WHERE rn <= n_train + n_test""")
def exact_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = split.stratified_split(fx.readings(spark, sf), "target", KEYS, n_train=N_TRAIN, n_test=N_TEST, seed=fx.SEED)
    return rows.select(*KEYS, "target", "split")


@query("c2_scaler_stats", f"""WITH {fx.SPLIT}, t AS (SELECT * FROM rows_split WHERE split = 'train')
    {' UNION ALL '.join(f"SELECT '{c}' AS feature, {r(f'avg({c})', 'mean')}, {r(f'stddev_pop({c})', 'std')} FROM t" for c in NUMERIC)}""")
def scaler_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scale.scaler_stats(fx.split_readings(spark, sf).where("split = 'train'"), NUMERIC))


@query("c3_scaled_features", f"WITH {fx.PREPARED} SELECT {K}, split, target, {', '.join(r(c) for c in NUMERIC)} FROM prep")
def scaled(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = fx.prepared(spark, sf)
    return rounded(rows.select(*KEYS, "split", "target", *NUMERIC))


@query("c4_one_hot", f"""WITH {fx.READINGS} SELECT {K}, CAST(type = 'N' AS DOUBLE) AS "type_N", CAST(type = 'R' AS DOUBLE) AS "type_R" FROM readings""")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.readings(spark, sf)
    encoded = scale.one_hot("type", scale.sorted_categories(rows, "type"))
    return rows.select(*KEYS, *[e.alias(n) for n, e in encoded.items()])


SNAP = "CASE WHEN 0 <= 1 - 2 * n AND 0 <= 1 - 2 * rr THEN 0 WHEN 1 - 2 * n <= 1 - 2 * rr THEN 1 ELSE 2 END"


@query("c6_inverse_transform", f"""WITH {fx.FEAT}, soft AS (SELECT *, (x3 * x3) / 4 AS n, (x4 * x4) / 3 AS rr FROM feat),
    snapped AS (SELECT soft.*, {SNAP} AS best, m_x1, s_x1, m_x2, s_x2, m_x3, s_x3, m_x4, s_x4 FROM soft CROSS JOIN feat_st)
    SELECT {K}, {', '.join(r(f'{c} * s_{c} + m_{c}', c) for c in NUMERIC)}, CAST(best = 1 AS DOUBLE) AS "type_N",
    CAST(best = 2 AS DOUBLE) AS "type_R" FROM snapped""")
def inverse(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.readings(spark, sf)
    fitted = scale.fit(rows, NUMERIC, ["type"])
    # Soft category scores in place of clean one-hots, so that snapping has work to do.
    soft = scale.transform(rows, fitted, KEYS).withColumns({
        "type_N": F.col("x3") * F.col("x3") / 4.0, "type_R": F.col("x4") * F.col("x4") / 3.0,
    })
    return rounded(scale.inverse_transform(soft, fitted, KEYS))


N_CLIENTS = 5


@query("c7_partition_iid", f"""WITH {fx.READINGS}, n AS (SELECT target, count(*) AS n FROM readings GROUP BY target),
    rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {fx.key_md5('iid')}, {K}) AS rn FROM readings)
    SELECT {', '.join('rk.' + k for k in KEYS)}, rk.target, CAST((rn - 1) // CAST(ceil(n.n / CAST({N_CLIENTS} AS DOUBLE)) AS BIGINT) AS INTEGER) AS client_id
    FROM rk JOIN n ON rk.target = n.target""")
def iid(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.readings(spark, sf).select(*KEYS, "target")
    return split.partition_rows(rows, "iid", N_CLIENTS, "target", KEYS, seed=fx.SEED)


ALPHA = 0.5


def dirichlet_sql(n_clients: int, source: str = "readings") -> str:
    """Views ``un`` (target, cid, units) and ``sz`` (target, cid, n, size): gamma values by rejection, floors of shares, the rest to client 0."""
    shape = ALPHA + 1
    d = fx.lit(shape - 1 / 3)
    c = fx.lit(1 / math.sqrt(9 * (shape - 1 / 3)))
    draw = fx.md5(fx.SEED, "'gamma'", "target", "cid", "k")
    boost = fx.uniform(fx.md5(fx.SEED, "'boost'", "target", "cid"))
    return f"""n AS (SELECT target, count(*) AS n FROM {source} GROUP BY target),
    cl AS (SELECT target, n, cid FROM n, (SELECT unnest(range(0, {n_clients})) AS cid)),
    dr AS (SELECT target, n, cid, k, {draw} AS h FROM cl, (SELECT unnest(range(0, {split.GAMMA_DRAWS})) AS k)),
    xu AS (SELECT target, n, cid, k, {fx.gaussian('h')} AS x, ln({fx.uniform('h', 2)}) AS u FROM dr),
    vs AS (SELECT *, pow(1 + {c} * x, 3) AS v FROM xu),
    ok AS (SELECT target, cid, any_value(n) AS n, min_by(v, k) FILTER (v > 0 AND u < {fx.lit(0.5)} * x * x + {d} - {d} * v + {d} * ln(CASE WHEN v > 0 THEN v ELSE 1 END)) AS v FROM vs GROUP BY target, cid),
    un AS (SELECT target, cid, n, CAST(floor({d} * coalesce(v, 1) * pow({boost}, {fx.lit(1 / ALPHA)}) * {fx.lit(float(split.UNIT))}) AS BIGINT) + 1 AS units FROM ok),
    fl AS (SELECT *, CAST((CAST(n AS HUGEINT) * units) // sum(units) OVER (PARTITION BY target) AS BIGINT) AS base FROM un),
    sz AS (SELECT target, cid, units, base + CASE WHEN cid = 0 THEN n - sum(base) OVER (PARTITION BY target) ELSE 0 END AS size FROM fl)"""


@query("c8_partition_dirichlet", f"""WITH {fx.READINGS}, {dirichlet_sql(N_CLIENTS)},
    ends AS (SELECT target, cid, sum(size) OVER (PARTITION BY target ORDER BY cid) AS upto, size FROM sz),
    rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {fx.key_md5('dirichlet')}, {K}) AS rn FROM readings)
    SELECT {', '.join('rk.' + k for k in KEYS)}, rk.target, CAST(ends.cid AS INTEGER) AS client_id
    FROM rk JOIN ends ON rk.target = ends.target AND rn > upto - size AND rn <= upto""")
def dirichlet(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.readings(spark, sf).select(*KEYS, "target")
    return split.partition_rows(rows, "non_iid", N_CLIENTS, "target", KEYS, ALPHA, fx.SEED)


MANY_CLIENTS = 200_000


@query("c8b_dirichlet_sizes", f"""WITH {fx.READINGS}, {dirichlet_sql(MANY_CLIENTS)}
    SELECT target, CAST(cid AS INTEGER) AS client_id, units, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER (PARTITION BY target ORDER BY cid) AS BIGINT) AS upto FROM sz""")
def dirichlet_table(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of 200,000 clients, and the rows of a class dealt up to each."""
    rows = fx.readings(spark, sf).select("target")
    counts = split._class_counts(rows, "target")
    return split.running_sizes(split.dirichlet_sizes(spark, counts, MANY_CLIENTS, ALPHA, fx.SEED, "target", rows.schema["target"].dataType.simpleString()), "target")


@query("c9_client_split", f"WITH {fx.CLIENT_SPLIT} SELECT {K}, client_id, target, split FROM client_rows")
def per_client_split(spark: SparkSession, sf: str) -> DataFrame:
    return client_rows(spark, sf).select(*KEYS, "client_id", "target", "split")


MANY = fx.READINGS.replace("l_suppkey % 5 AS INTEGER", "l_suppkey AS INTEGER")


@query("c9b_client_split_many", f"""WITH {MANY}, {fx.split_view('client_rows', 'readings', ['client_id'], 'client_split')}
    SELECT {K}, client_id, target, split FROM client_rows""")
def many_client_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier a client: strata grow with the data."""
    rows = fx.readings(spark, sf).withColumn("client_id", F.col("k3").cast("int"))
    return split.client_split(rows, "target", KEYS, fx.TEST_FRACTION, seed=fx.SEED).select(*KEYS, "client_id", "target", "split")


SUMMARY = """SELECT client_id, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
    count(*) FILTER (WHERE split = 'train' AND target = 1) AS train_positives,
    count(*) FILTER (WHERE split = 'test' AND target = 1) AS test_positives,
    round(count(*) FILTER (WHERE split = 'train' AND target = 1) / CAST(nullif(count(*) FILTER (WHERE split = 'train'), 0) AS DOUBLE), 4) AS train_failure_rate
    FROM client_rows GROUP BY client_id"""


@query("c10_partition_summary", f"WITH {fx.CLIENT_SPLIT} {SUMMARY}")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return split.partition_summary(client_rows(spark, sf))


@query("c1b_hash_rank", f"""WITH {fx.READINGS} SELECT {K}, type, row_number() OVER (PARTITION BY type ORDER BY {fx.key_md5('rank')}, {K}) AS rank FROM readings""")
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The exact hash rank that splits beyond the broadcast bound rest on."""
    rows = fx.readings(spark, sf).select(*KEYS, "type")
    return hash_rank(rows, ["type"], KEYS, fx.SEED, "rank")
