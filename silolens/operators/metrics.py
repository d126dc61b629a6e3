"""Confusion cells and the four classification metrics (G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silolens.functions.net import row_log_loss
from silolens.functions.text import ident

METRICS = ("accuracy", "precision", "recall", "f1")
CELLS = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}


def confusion(df: DataFrame, y: str = "y_true", pred: str = "y_pred", by: list[str] | None = None,
              extra: list[Column] | None = None) -> DataFrame:
    """All four cells per group, zeros kept; one map-side combined aggregate."""
    cells = [
        F.expr(f"count_if({ident(y)} = {t} AND {ident(pred)} = {p})").alias(name) for name, (t, p) in CELLS.items()
    ]
    return df.groupBy(*(by or [])).agg(*cells, *(extra or []))


def metric_columns(prefix: str = "") -> dict[str, Column]:
    """Accuracy, precision, recall and F1 of class 1 from the cells; 0 where undefined."""
    ratios = (("tp + tn", "tp + tn + fp + fn"), ("tp", "tp + fp"), ("tp", "tp + fn"), ("2 * tp", "2 * tp + fp + fn"))
    return {f"{prefix}{m}": F.expr(f"coalesce(({a}) / nullif({b}, 0), 0D)") for m, (a, b) in zip(METRICS, ratios)}


def classification_metrics(df: DataFrame, y: str = "y_true", pred: str = "y_pred", by: list[str] | None = None,
                           prefix: str = "") -> DataFrame:
    cells = confusion(df, y, pred, by)
    return cells.select(*(by or []), *[v.alias(n) for n, v in metric_columns(prefix).items()])


def evaluate(df: DataFrame, y: str = "y_true", pred: str = "y_pred", p: str = "p1",
             by: list[str] | None = None) -> DataFrame:
    """Loss, row count and the four metrics per group from one aggregate."""
    loss = [F.avg(row_log_loss(p, y)).alias("loss"), F.count("*").alias("n_rows")]
    cells = confusion(df, y, pred, by, extra=loss)
    return cells.select(*(by or []), "n_rows", "loss", *[v.alias(n) for n, v in metric_columns().items()])


def weighted_average_metrics(df: DataFrame, weight: str, metrics: tuple[str, ...] = METRICS,
                             by: list[str] | None = None) -> DataFrame:
    """Weighted mean of metric columns; a missing metric counts as 0, a total weight <= 0 is an error."""
    total = F.sum(weight)
    guard = F.when(total > 0, total).otherwise(F.raise_error(F.lit("total weight must be positive")).cast("double"))
    means = [(F.sum(F.coalesce(F.col(m), F.lit(0.0)) * F.col(weight)) / guard).alias(m) for m in metrics]
    return df.groupBy(*(by or [])).agg(*means)


def metric_text(names: tuple[str, ...] = METRICS, decimals: int = 4) -> Column:
    # Half-even first: the formatter alone would round exact halves up.
    return F.format_string(", ".join(f"{n}=%.{decimals}f" for n in names), *[F.bround(n, decimals) for n in names])
