"""Combining client updates (F1-F8) and sampling participants.

An update is a row (round, client_id, n_examples, params ARRAY<DOUBLE>, loss).
Averages run in long form, one row per position, so that partial sums combine
before the shuffle and no task ever holds all updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silolens.operators.hashcut import cut_by_hash
from silolens.operators.metrics import weighted_average_metrics


def long_updates(updates: DataFrame, keep: list[str]) -> DataFrame:
    return updates.select(*keep, F.posexplode("params").alias("idx", "value"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean of a group; negative weights or a total of 0 fail the query."""
    bad = F.min(weight) < 0
    total = F.sum(weight)
    guard = (
        F.when(bad, F.raise_error(F.lit("weights must be non-negative")).cast("double"))
        .when(total <= 0, F.raise_error(F.lit("total weight must be positive")).cast("double"))
        .otherwise(total)
    )
    return F.sum(value * weight) / guard


def fedavg(updates: DataFrame, weight: str | None = "n_examples", by: list[str] = ["round"]) -> DataFrame:  # noqa: B006
    """(by..., idx, value): the mean of all updates, weighted by ``weight`` or uniform with None."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    keep = [*by, *([weight] if weight else [])]
    return long_updates(updates, keep).groupBy(*by, "idx").agg(weighted_mean(F.col("value"), w).alias("value"))


def aggregate_round(updates: DataFrame, weighted: bool = True, masked: bool = False) -> DataFrame:
    """A round's global parameters; masked updates force the uniform mean."""
    return fedavg(updates, "n_examples" if weighted and not masked else None)


def communication(updates: DataFrame, bytes_per_value: int = 4) -> DataFrame:
    """Uploads per round: clients, parameters of one update and bytes of all of them."""
    return updates.groupBy("round").agg(
        F.count("*").alias("n_clients"),
        F.max(F.size("params")).cast("bigint").alias("n_params"),
        F.sum(F.size("params").cast("bigint") * bytes_per_value).alias("comm_bytes"),
    )


def sample_clients(clients: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Participants of each round: the first max(1, round(n x fraction)) clients in hash order."""
    wanted = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(float(fraction)))).cast("bigint")
    counts = clients.groupBy("round").agg(F.count("*").alias("n"))
    cuts = counts.select("round", F.lit(0).alias("cut"), wanted.alias("need"))
    drawn = cut_by_hash(clients, cuts, ["round"], ["round", "client_id"], seed, "sample", out="_part")
    return drawn.where("_part = 0").drop("_part")


def fit_metrics(updates: DataFrame) -> DataFrame:
    """The n-weighted training loss of each round."""
    return weighted_average_metrics(updates, "n_examples", ("loss",), by=["round"])


def eval_metrics(client_metrics: DataFrame, by: list[str] = ["round"]) -> DataFrame:  # noqa: B006
    """The n-weighted mean of each client's four metrics."""
    return weighted_average_metrics(client_metrics, "n_rows", by=by)


def round_summary(rounds: DataFrame, run: str = "run_id") -> DataFrame:
    """Add the running total of uploaded bytes. One row per round and run: a short window."""
    upto = Window.partitionBy(run).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumn("total_bytes", F.sum("comm_bytes").over(upto))
