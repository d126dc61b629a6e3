"""Views over the test tables, in Spark and as the same views in SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from silolens.functions.text import ident, nearest
from silolens.operators import scale, split
from silolens.operators.schema import FLAG_NAMES, failure_rules
from silolens.sources.tables import load_raw

KEYS = ["k1", "k2", "k3", "k4", "k5"]
NUMERIC = ["x1", "x2", "x3", "x4"]
FEATURES = [*NUMERIC, "type_N", "type_R"]
SEED = 42
TEST_FRACTION = 0.2

RULES = {
    "twf": "x1 >= 50",
    "hdf": "x3 < 0.005 and x4 > 0.075",
    "pwf": "x2 < 1500",
    "osf": "x1 * x3 > 4.4 and x4 < 0.015",
}
RULE_NAMES = {c: FLAG_NAMES[c.upper()] for c in RULES}

LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
)

# A fixed logistic model over FEATURES (weights, then bias), and a small net's layout.
LOGIT = [1.5, -0.25, 0.75, -1.0, 0.5, -0.5, -2.0]
LOGIT4 = [1.25, -0.5, 0.75, -1.0, -1.5]  # over NUMERIC only
NET = (6, 3, 2, 1)


# --- Spark side ------------------------------------------------------------------------------


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return load_raw(spark, f"{sf}/lineitem.parquet", LINEITEM)


def sensor_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Readings before rules: five key parts, four sensors, a type."""
    return spark.read.schema(LINEITEM).parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_orderkey").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"),
        F.col("l_linenumber").cast("bigint").alias("k4"),
        F.expr(f"cast({nearest('(l_extendedprice * 100D)', 0)} as bigint)").alias("k5"),
        F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("x2"), F.col("l_discount").alias("x3"),
        F.col("l_tax").alias("x4"), F.col("l_returnflag").alias("type"),
        F.pmod(F.col("l_suppkey"), F.lit(5)).cast("int").alias("client_id"),
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return failure_rules(sensor_rows(spark, sf), RULES, RULE_NAMES)


def features(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Scaled and encoded readings, scaler fitted on all of them: a prepared table for model queries."""
    rows = readings(spark, sf)
    fitted = scale.fit(rows, NUMERIC, ["type"])
    return scale.transform(rows, fitted, [*KEYS, "client_id", "target", *extra])


def split_readings(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(readings(spark, sf), "target", KEYS, test_fraction=TEST_FRACTION, seed=SEED)


def prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, scale.Preprocessor]:
    """The full preparation: exact split, scaler fitted on the train side only."""
    rows = split_readings(spark, sf)
    fitted = scale.fit(rows.where("split = 'train'"), NUMERIC, ["type"])
    return scale.transform(rows, fitted, [*KEYS, "client_id", "target", "split"]), fitted


def updates(spark: SparkSession, sf: str) -> DataFrame:
    """Client updates made of each (round, supplier)'s means."""
    return readings(spark, sf).groupBy(F.col("k4").cast("int").alias("round"), F.col("k3").alias("client_id")).agg(
        F.count("*").alias("n_examples"), F.avg(F.abs(F.col("x1") - 25.0) / 25.0).alias("loss"),
        F.array(F.avg("x1") / 50.0, F.avg("x2") / 100000.0, F.avg("x3"), F.avg("x4"), F.avg("target")).alias("params"),
    )


UPDATE_WIDTH = 5


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, as the SQL side rounds them."""
    cols = [
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


def rounded_rows(df: DataFrame, digits: int = 6) -> DataFrame:
    """:func:`rounded` of a table with many numbers a reading, without a decimal number for each."""
    cols = [F.expr(nearest(ident(f.name), digits)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(ident(f.name)) for f in df.schema.fields]
    return df.select(*cols)


# --- SQL side --------------------------------------------------------------------------------


def lit(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({expr}, {digits}) END AS {name or expr}"


def md5(*parts: str | int) -> str:
    return f"md5(concat_ws(':', {', '.join(str(p) for p in parts)}))"


def word(h: str, i: int = 0) -> str:
    return f"CAST('0x' || substr({h}, {1 + 8 * i}, 8) AS BIGINT)"


def uniform(h: str, i: int = 0) -> str:
    return f"((CAST({word(h, i)} AS DOUBLE) + {lit(0.5)}) / {lit(4294967296.0)})"


def gaussian(h: str) -> str:
    return f"(sqrt({lit(-2.0)} * ln({uniform(h, 0)})) * cos({lit(2.0 * math.pi)} * {uniform(h, 1)}))"


def key_md5(salt: str, keys: Sequence[str] = KEYS, seed: int = SEED) -> str:
    return md5(seed, f"'{salt}'", *keys)


def logit(cols: Sequence[str], params: Sequence[float]) -> str:
    return "(" + " + ".join([f"{c} * {lit(w)}" for c, w in zip(cols, params)] + [lit(params[-1])]) + ")"


def sigmoid(z: str) -> str:
    return f"({lit(1)} / ({lit(1)} + exp(-least(greatest({z}, {lit(-30)}), {lit(30)}))))"


def log_loss(p: str, y: str) -> str:
    q = f"least(greatest({p}, {lit(1e-7)}), {lit(1 - 1e-7)})"
    return f"(-({y} * ln({q}) + (1 - {y}) * ln(1 - {q})))"


K = ", ".join(KEYS)

READINGS = f"""readings AS (
  SELECT *, greatest(twf, hdf, pwf, osf) AS target FROM (
    SELECT *, CAST({RULES['twf']} AS INTEGER) AS twf, CAST({RULES['hdf']} AS INTEGER) AS hdf,
           CAST({RULES['pwf']} AS INTEGER) AS pwf, CAST({RULES['osf']} AS INTEGER) AS osf
    FROM (SELECT l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3, CAST(l_linenumber AS BIGINT) AS k4,
                 CAST(round(l_extendedprice * 100) AS BIGINT) AS k5, l_quantity AS x1, l_extendedprice AS x2,
                 l_discount AS x3, l_tax AS x4, l_returnflag AS type, CAST(l_suppkey % 5 AS INTEGER) AS client_id
          FROM lineitem) s0) s1)"""


def scaled_view(name: str, source: str, fit_on: str, keep: Sequence[str]) -> str:
    """Stats over ``fit_on`` and the scaled, encoded rows of ``source``."""
    stats = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in NUMERIC
    )
    cols = ", ".join(f"(f.{c} - st.m_{c}) / st.s_{c} AS {c}" for c in NUMERIC)
    onehot = ", ".join(f'CAST(f.type = \'{t}\' AS DOUBLE) AS "type_{t}"' for t in ("N", "R"))
    kept = ", ".join(f"f.{c}" for c in keep)
    return f"""{name}_st AS (SELECT {stats} FROM {fit_on}),
{name} AS (SELECT {kept}, {cols}, {onehot} FROM {source} f CROSS JOIN {name}_st st)"""


FEAT = READINGS + ",\n" + scaled_view("feat", "readings", "readings", [*KEYS, "client_id", "target", "type"])


def quotas(name: str, source: str, by: Sequence[str], fraction: float) -> str:
    """Largest-remainder train rows per (by..., target)."""
    group = ", ".join([*by, "target"])
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""{name}_n AS (SELECT {group}, count(*) AS n FROM {source} GROUP BY {group}),
{name}_t AS (SELECT *, CAST(sum(n) OVER ({part}) AS HUGEINT) AS total FROM {name}_n),
{name}_w AS (SELECT *, total - CAST(ceil(CAST(total AS DOUBLE) * {lit(fraction)}) AS HUGEINT) AS want FROM {name}_t),
{name}_b AS (SELECT *, (want * n) // total AS base, (want * n) % total AS rest FROM {name}_w),
{name} AS (SELECT {group}, n, base + CASE WHEN row_number() OVER ({part} ORDER BY rest DESC, target)
    <= want - sum(base) OVER ({part}) THEN 1 ELSE 0 END AS n_train FROM {name}_b)"""


def split_view(name: str, source: str, by: Sequence[str], salt: str, fraction: float = TEST_FRACTION) -> str:
    group = [*by, "target"]
    on = " AND ".join(f"a.{c} = q.{c}" for c in group)
    over = f"PARTITION BY {', '.join(group)} ORDER BY {key_md5(salt)}, {K}"
    return f"""{quotas(name + '_q', source, by, fraction)},
{name} AS (SELECT a.* EXCLUDE (rn), CASE WHEN a.rn <= q.n_train THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER ({over}) AS rn FROM {source}) a JOIN {name}_q q ON {on})"""


SPLIT = READINGS + ",\n" + split_view("rows_split", "readings", [], "split")
PREPARED = (
    SPLIT + ",\nrows_train AS (SELECT * FROM rows_split WHERE split = 'train'),\n"
    + scaled_view("prep", "rows_split", "rows_train", [*KEYS, "client_id", "target", "split", "type"])
)
CLIENT_SPLIT = READINGS + ",\n" + split_view("client_rows", "readings", ["client_id"], "client_split")

UPDATES = READINGS + f""",
upd AS (SELECT CAST(k4 AS INTEGER) AS round, k3 AS client_id, count(*) AS n_examples,
    avg(abs(x1 - {lit(25)}) / {lit(25)}) AS loss, avg(x1) / {lit(50)} AS p0, avg(x2) / {lit(100000)} AS p1,
    avg(x3) AS p2, avg(x4) AS p3, avg(target) AS p4 FROM readings GROUP BY 1, 2),
updl AS ({' UNION ALL '.join(f'SELECT round, client_id, n_examples, loss, {i} AS idx, p{i} AS value FROM upd' for i in range(UPDATE_WIDTH))})"""


def scored(source: str, params: Sequence[float] = LOGIT, cols: Sequence[str] = FEATURES, name: str = "sc") -> str:
    return f"{name} AS (SELECT *, {sigmoid(logit(cols, params))} AS p1 FROM {source})"


def metric_select(y: str = "target", pred: str = "y_pred") -> dict[str, str]:
    tp, tn = f"sum(CASE WHEN {y} = 1 AND {pred} = 1 THEN 1 ELSE 0 END)", f"sum(CASE WHEN {y} = 0 AND {pred} = 0 THEN 1 ELSE 0 END)"
    fp, fn = f"sum(CASE WHEN {y} = 0 AND {pred} = 1 THEN 1 ELSE 0 END)", f"sum(CASE WHEN {y} = 1 AND {pred} = 0 THEN 1 ELSE 0 END)"

    def ratio(a: str, b: str) -> str:
        return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"

    return {
        "accuracy": ratio(f"({tp} + {tn})", f"({tp} + {tn} + {fp} + {fn})"), "precision": ratio(tp, f"({tp} + {fp})"),
        "recall": ratio(tp, f"({tp} + {fn})"), "f1": ratio(f"(2 * {tp})", f"(2 * {tp} + {fp} + {fn})"),
    }


def metrics_sql(y: str = "target", pred: str = "y_pred", digits: int = 6) -> str:
    return ", ".join(r(e, f'"{n}"', digits) for n, e in metric_select(y, pred).items())
