"""Clipped, noised gradients per client (D6-D9) and the distributed full-batch mode.

The logistic case is column arithmetic: per-row gradients exist only inside the
partial aggregate of a scan. Wide nets sum gradients in Arrow batches, one
vector per client seen in a task, flushed before the held vectors outgrow their
budget; the vectors are then added up by (client, position).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silolens.functions import net
from silolens.functions.hashing import gaussian, hash_hex
from silolens.functions.text import ident, num, squares
from silolens.session import spread

# Bytes of gradient vectors one task may hold before it emits them.
HELD_BYTES = 64 << 20


def residual(p: str, y: str, pos_weight: float = 0.0) -> Column:
    """d loss / d logit of the weighted log loss; a weight of 0 or 1 means unweighted."""
    q, label = net.clipped_probability(p), f"cast({ident(y)} as double)"
    if pos_weight in (0.0, 1.0):
        return F.expr(f"{q} - {label}")
    w = num(pos_weight)
    return F.expr(f"{q} * ({w} * {label} + 1D - {label}) - {w} * {label}")


def logistic_gradients(df: DataFrame, params: Sequence[float], features: Sequence[str], label: str = "target",
                       pos_weight: float = 0.0, prefix: str = "g") -> DataFrame:
    """Add g0..g{d-1} for the weights and g{d} for the bias."""
    scored = net.score(df, params, (len(features), 1), features, "_p")
    scored = scored.withColumn("_e", residual("_p", label, pos_weight))
    grads = [F.expr(f"_e * {ident(c)}").alias(f"{prefix}{i}") for i, c in enumerate(features)]
    return scored.select("*", *grads, F.col("_e").alias(f"{prefix}{len(features)}")).drop("_p", "_e")


def clip_factor(cols: Sequence[str], clip: float) -> Column:
    """min(1, C / |g|); a clip of 0 or less leaves gradients alone."""
    if clip <= 0:
        return F.lit(1.0)
    return F.expr(f"least(1D, {num(clip)} / greatest(sqrt({squares(cols)}), 1e-12D))")


def clipped_sums(df: DataFrame, cols: Sequence[str], clip: float, by: list[str]) -> DataFrame:
    """Sum of clipped gradients and the count of rows that have one, per group; partial sums before the shuffle."""
    factored = df.withColumn("_f", clip_factor(cols, clip))
    return factored.groupBy(*by).agg(
        *[F.expr(f"sum({ident(c)} * _f)").alias(c) for c in cols], F.count(F.col(f"`{cols[-1]}`")).alias("n_examples")
    )


def noise_std(clip: float, multiplier: float, n: Column, scale: str = "documented") -> Column:
    """Noise of the summed gradient: C x sigma as documented, or divided by the batch size as coded."""
    if scale == "documented":
        return F.lit(float(clip * multiplier))
    if scale == "as_coded":
        return F.lit(float(clip * multiplier)) / n
    raise ValueError(f"noise scale {scale!r}: use 'documented' or 'as_coded'")


def add_noise(df: DataFrame, cols: Sequence[str], clip: float, multiplier: float, seed: int, round_no: int,
              step: int = 0, client: str = "client_id", scale: str = "documented") -> DataFrame:
    """Gaussian noise keyed by (seed, round, client, step, position)."""
    if clip * multiplier <= 0:
        return df
    std = noise_std(clip, multiplier, F.col("n_examples"), scale)
    return df.withColumns({
        c: F.col(c) + std * gaussian(hash_hex(seed, "noise", round_no, F.col(client), step, i))
        for i, c in enumerate(cols)
    })


def mean_gradient(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.col("n_examples") for c in cols})


def adam_first_step(theta: float, g: Column, lr: float) -> Column:
    """One Adam step from a fresh state: the bias corrections cancel the decay rates."""
    return F.lit(float(theta)) - F.lit(float(lr)) * g / (F.abs(g) + F.lit(1e-8))


def net_gradient_sums(df: DataFrame, params: Sequence[float], sizes: Sequence[int], features: Sequence[str],
                      label: str = "target", client: str = "client_id", pos_weight: float = 0.0,
                      clip: float | None = None) -> DataFrame:
    """(client, idx, g, n_examples): summed gradients of a net of any width."""
    theta, layout, names = np.asarray(params, dtype=np.float64), tuple(sizes), list(features)
    width = net.n_params(layout)
    held_clients = max(1, HELD_BYTES // (8 * width))

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({
                client: list(held), "n_examples": [n for n, _ in held.values()], "g": [g for _, g in held.values()],
            })
            held.clear()
            return out

        # Rows per gradient call, so that activations stay within the budget too.
        step = max(1, HELD_BYTES // (8 * 3 * sum(layout)))
        for batch in batches:
            for cid, rows in batch.groupby(client, sort=False):
                x, y = net.complete_rows(rows[names].to_numpy(dtype=np.float64), rows[label].to_numpy(dtype=np.float64))
                for i in range(0, len(x), step):
                    g = net.gradient_sum(theta, layout, x[i : i + step], y[i : i + step], pos_weight, clip)
                    n, acc = held.get(cid, (0, 0.0))
                    held[cid] = (n + len(x[i : i + step]), acc + g)
                if len(held) >= held_clients:
                    yield flush()
        if held:
            yield flush()

    kind = df.schema[client].dataType.simpleString()
    partials = spread(df.select(client, *[F.col(f"`{c}`") for c in names], label)).mapInPandas(
        partial_sums, f"`{client}` {kind}, n_examples bigint, g array<double>"
    )
    long = partials.select(client, "n_examples", F.posexplode("g").alias("idx", "g"))
    return long.groupBy(client, "idx").agg(F.sum("g").alias("g"), F.sum("n_examples").alias("n_examples"))
