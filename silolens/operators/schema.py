"""Column names, labels and row checks (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted names of the label column.
TARGET_ALIASES = ("Target", "Machine failure", "target", "machine failure")

# Failure flag columns and the type each one stands for.
FLAG_NAMES = {
    "TWF": "Tool Wear Failure",
    "HDF": "Heat Dissipation Failure",
    "PWF": "Power Failure",
    "OSF": "Overstrain Failure",
    "RNF": "Random Failure",
}
NO_FAILURE = "No Failure"
ID_COLUMNS = ("UDI", "Product ID")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim names, rename the first label alias (in column order) to ``target``, cast it to int."""
    trimmed = df.toDF(*[c.strip() for c in df.columns])
    alias = next((c for c in trimmed.columns if c in TARGET_ALIASES), None)
    if alias is None:
        raise ValueError(f"no label column among {trimmed.columns}; expected one of {TARGET_ALIASES}")
    # A later alias that already reads "target" would make the name ambiguous.
    if alias != "target" and "target" in trimmed.columns:
        trimmed = trimmed.drop("target")
    return trimmed.withColumnRenamed(alias, "target").withColumn("target", F.col("target").cast("int"))


def first_true(flags: dict[str, str], otherwise: Column) -> Column:
    """The name of the first raised flag, in the order given."""
    if not flags:
        return otherwise
    return F.coalesce(*[F.when(F.col(c) != 0, F.lit(name)) for c, name in flags.items()], otherwise)


def derive_failure_type(df: DataFrame, flag_names: dict[str, str] = FLAG_NAMES, out: str = "Failure Type") -> DataFrame:
    """Add the failure type unless the table has one. Flags count even where the label is 0."""
    if "Failure Type" in df.columns or "Failure type" in df.columns:
        return df
    present = {c: flag_names[c] for c in df.columns if c in flag_names}
    if present:
        return df.withColumn(out, first_true(present, F.lit(NO_FAILURE)))
    return df.withColumn(out, F.when(F.col("target") == 1, F.lit("Failure")).otherwise(F.lit(NO_FAILURE)))


def drop_identifiers(df: DataFrame, ids: tuple[str, ...] = ID_COLUMNS) -> DataFrame:
    return df.drop(*ids)


def missing_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null (and, for floating columns, NaN) counts of every column in one pass."""
    kinds = dict(df.dtypes)

    def missing(c: str) -> Column:
        gone = F.col(f"`{c}`").isNull()
        return gone | F.isnan(F.col(f"`{c}`")) if kinds[c] in ("float", "double") else gone

    return df.agg(*[F.coalesce(F.sum(missing(c).cast("bigint")), F.lit(0)).alias(c) for c in cols])


def assert_no_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    found = {c: n for c, n in missing_counts(df, cols).first().asDict().items() if n}
    if found:
        raise ValueError(f"missing values in feature columns: {found}")
    return df


def normalize_schema(df: DataFrame, features: list[str]) -> DataFrame:
    """The whole canonicalisation: names, failure type, identifiers, label, missing check."""
    clean = drop_identifiers(derive_failure_type(normalize_columns(df)))
    return assert_no_missing(clean, features)


def failure_rules(df: DataFrame, rules: dict[str, str], names: dict[str, str], label: str = "target",
                  type_col: str = "failure_type") -> DataFrame:
    """Boolean SQL rules over sensor columns become 0/1 flags, a label and a type."""
    flagged = df.withColumns({flag: F.expr(rule).cast("int") for flag, rule in rules.items()})
    raised = F.greatest(*[F.col(f) for f in rules]) if len(rules) > 1 else F.col(next(iter(rules)))
    named = {f: names[f] for f in rules}
    return flagged.withColumn(label, raised).withColumn(type_col, first_true(named, F.lit(NO_FAILURE)))


def first_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows by key: the subset that explanations are made for."""
    return df.orderBy(*keys).limit(n)
