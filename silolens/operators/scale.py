"""Scaling and one-hot encoding, forward and back.

Fitted state is a stats table: one row per numeric feature with mean and
population standard deviation, one row per category column with its sorted
categories. It is a handful of rows, collected once and folded into the plan
as literals, so transforming is a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.functions.text import ident, num
from silolens.session import bounded_rows, local_table

MAX_CATEGORIES = 1000


@dataclass(frozen=True)
class Preprocessor:
    """mean/std per numeric column and sorted categories per category column."""

    numeric: dict[str, tuple[float, float]]
    categories: dict[str, list[str]]

    @property
    def feature_names(self) -> list[str]:
        onehot = [f"{c}_{v}" for c, vals in self.categories.items() for v in vals[1:]]
        return [*self.numeric, *onehot]

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, m, s, None) for c, (m, s) in self.numeric.items()]
        rows += [(c, None, None, vals) for c, vals in self.categories.items()]
        return local_table(spark, rows, "feature string, mean double, std double, categories array<string>")

    @staticmethod
    def from_table(table: DataFrame, order: list[str]) -> Preprocessor:
        by_name = {r["feature"]: r for r in table.collect()}
        numeric = {c: (by_name[c]["mean"], by_name[c]["std"]) for c in order if by_name[c]["categories"] is None}
        cats = {c: list(by_name[c]["categories"]) for c in order if by_name[c]["categories"] is not None}
        return Preprocessor(numeric, cats)


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean, std): one aggregate pass; a constant column gets std 1."""
    both = ", ".join(
        f"struct({i} AS pos, avg({ident(c)}) AS mean, coalesce(nullif(stddev_pop({ident(c)}), 0D), 1D) AS std)" for i, c in enumerate(cols)
    )
    names = F.array(*[F.lit(c) for c in cols])
    rows = df.agg(F.expr(f"array({both})").alias("stats")).selectExpr("inline(stats)")
    return rows.select(F.get(names, F.col("pos")).alias("feature"), "mean", "std")


def sorted_categories(df: DataFrame, col: str, limit: int = MAX_CATEGORIES) -> list[str]:
    rows = bounded_rows(df.select(f"`{col}`").where(F.col(f"`{col}`").isNotNull()).distinct(), limit)
    if rows is None:
        raise ValueError(f"{col} has more than {limit} distinct values; one-hot encoding would not be bounded")
    return sorted(r[0] for r in rows)


def fit(df: DataFrame, numeric: list[str], categorical: list[str]) -> Preprocessor:
    """One pass: moments per combination of categories, merged on the driver while they are few."""
    moments = [F.expr(f"{f}({ident(c)})").alias(f"{f}{i}") for i, c in enumerate(numeric) for f in ("count", "avg", "var_pop")]
    groups = df.groupBy(*[F.col(ident(c)).alias(f"t{i}") for i, c in enumerate(categorical)]).agg(*moments)
    rows = bounded_rows(groups) if categorical else groups.collect()
    if rows is None or not categorical:
        stats = {r["feature"]: (r["mean"], r["std"]) for r in scaler_stats(df, numeric).collect()} if rows is None else _merged(rows, numeric)
        return Preprocessor({c: stats[c] for c in numeric}, {c: sorted_categories(df, c) for c in categorical})
    seen = {c: sorted({r[f"t{i}"] for r in rows} - {None}) for i, c in enumerate(categorical)}
    for c, values in seen.items():
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} distinct values; one-hot encoding would not be bounded")
    return Preprocessor(_merged(rows, numeric), seen)


def _merged(rows: list, numeric: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std of a whole from the moments of its groups."""
    out = {}
    for i, c in enumerate(numeric):
        parts = [(r[f"count{i}"], r[f"avg{i}"], r[f"var_pop{i}"]) for r in rows if r[f"count{i}"]]
        n = sum(k for k, _, _ in parts)
        if not n:
            raise ValueError(f"{c} has no values to fit")
        mean = math.fsum(k * m for k, m, _ in parts) / n
        variance = math.fsum(k * (v + (m - mean) ** 2) for k, m, v in parts) / n
        out[c] = (mean, math.sqrt(variance) or 1.0)
    return out


def scaled(col: str, mean: float, std: float) -> Column:
    return F.expr(f"({ident(col)} - {num(mean)}) / {num(std)}")


def one_hot(col: str, categories: list[str]) -> dict[str, Column]:
    """0/1 columns named by the fitted category, first category dropped; an unseen one fails the query."""
    value = F.col(f"`{col}`")
    unseen = F.raise_error(F.concat(F.lit(f"unseen category in {col}: "), F.coalesce(value, F.lit("null"))))
    known = F.when(value.isin(categories), value).otherwise(unseen.cast("string"))
    return {f"{col}_{v}": (known == v).cast("double") for v in categories[1:]}


def transform(df: DataFrame, fitted: Preprocessor, keep: list[str]) -> DataFrame:
    """Scaled features in the fixed order, with the kept columns in front."""
    numeric = [scaled(c, m, s).alias(c) for c, (m, s) in fitted.numeric.items()]
    onehot = [e.alias(n) for c, vals in fitted.categories.items() for n, e in one_hot(c, vals).items()]
    return df.select(*[F.col(f"`{c}`") for c in keep], *numeric, *onehot)


def inverse_transform(df: DataFrame, fitted: Preprocessor, keep: list[str]) -> DataFrame:
    """Back to original units; one-hot blocks snap to the nearest valid pattern, the first on ties."""
    numeric = [F.expr(f"{ident(c)} * {num(s)} + {num(m)}").alias(c) for c, (m, s) in fitted.numeric.items()]
    snapped = []
    for col, vals in fitted.categories.items():
        names = [f"{col}_{v}" for v in vals[1:]]
        if not names:
            continue
        # |x - e_j|^2 = |x|^2 - 2 x_j + 1, so only x_j separates the patterns.
        gaps = ", ".join(["0D"] + [f"1D - 2D * {ident(n)}" for n in names])
        missing = " OR ".join(f"{ident(n)} IS NULL" for n in names)
        best = f"CASE WHEN NOT ({missing}) THEN array_position(array({gaps}), array_min(array({gaps}))) END"
        snapped += [F.expr(f"cast({best} = {i + 2} as double)").alias(n) for i, n in enumerate(names)]
    return df.select(*[F.col(f"`{c}`") for c in keep], *numeric, *snapped)
