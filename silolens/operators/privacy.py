"""Update-level clipping and noise, and pairwise masks that cancel exactly (P).

Masks are integers modulo 2^48, so a sum of masked updates equals the sum of
the fixed-point updates to the last bit. Pairs come from a ring over the
round's participants in hash order: every client shares a mask with the
``reach`` clients on either side, so a round costs clients x 2 x reach masks
instead of all pairs. With at most 2 x reach + 1 participants the ring is the
complete graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silolens.functions.hashing import gaussian, hash_hex
from silolens.operators.hashcut import hash_rank
from silolens.session import small

RING = 1 << 48
SCALE = float(1 << 20)


def norm(params: Column) -> Column:
    return F.sqrt(F.aggregate(params, F.lit(0.0), lambda acc, v: acc + v * v))


def clip_update(updates: DataFrame, clip: float, col: str = "params") -> DataFrame:
    """Scale a whole update down to L2 norm ``clip``; shorter ones stay as they are."""
    size = norm(F.col(col))
    factor = F.when(size > clip, F.lit(float(clip)) / size).otherwise(F.lit(1.0))
    return (
        updates.withColumn("_factor", factor)
        .withColumn(col, F.transform(col, lambda v: v * F.col("_factor")))
        .drop("_factor")
    )


def noise_update(updates: DataFrame, clip: float, multiplier: float, seed: int, col: str = "params") -> DataFrame:
    """Add N(0, (C sigma)^2) to every position, keyed by (seed, round, client, position)."""
    std = F.lit(float(clip * multiplier))
    draw = lambda i: gaussian(hash_hex(seed, "update", F.col("round"), F.col("client_id"), i))
    return updates.withColumn(col, F.transform(col, lambda v, i: v + std * draw(i)))


def dp_update(updates: DataFrame, clip: float, multiplier: float, seed: int, enabled: bool = True) -> DataFrame:
    return noise_update(clip_update(updates, clip), clip, multiplier, seed) if enabled else updates


def privacy_status(updates: DataFrame, dp_enabled: bool, clip: float, multiplier: float, masked: bool) -> DataFrame:
    """The privacy settings beside what they do to a run: how many updates the clip shortens."""
    return updates.groupBy("round").agg(
        F.count("*").alias("n_updates"),
        F.sum((norm(F.col("params")) > clip).cast("bigint")).alias("n_clipped"),
    ).withColumns({
        "differential_privacy": F.lit(dp_enabled),
        "noise_multiplier": F.lit(float(multiplier)),
        "clipping_norm": F.lit(float(clip)),
        "noise_std": F.lit(float(clip * multiplier) if dp_enabled else 0.0),
        "formal_epsilon": F.lit("not claimed"),
        "secure_aggregation": F.lit(masked),
    })


def pair_seed(secret: str, a: Column, b: Column) -> Column:
    """The first 4 bytes of sha256(secret:low:high), the same on both sides of a pair."""
    text = F.concat_ws(":", F.lit(secret), F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def mask_pairs(clients: DataFrame, secret: str, reach: int = 2, seed: int = 42) -> DataFrame:
    """(round, client_a, client_b, pair_seed) with client_a < client_b, each pair once."""
    members = clients.select("round", "client_id")
    sizes = members.groupBy("round").agg(F.count("*").alias("n"))
    alone = F.raise_error(F.lit("masks need at least 2 participants")).cast("bigint")
    ranked = hash_rank(members, ["round"], ["round", "client_id"], seed, "ring", digits=3)
    ranked = ranked.join(small(sizes), "round").withColumn("n", F.when(F.col("n") >= 2, F.col("n")).otherwise(alone))
    # Offset d links position r to r + d. Beyond half the ring it would repeat a
    # pair; at exactly half, only the first half of the ring opens it.
    opened = ranked.select(
        "round", "client_id", "n", (F.col("rank") - 1).alias("r"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("d")
    ).where("2 * d < n or (2 * d = n and r < d)")
    far = ranked.select("round", (F.col("rank") - 1).alias("other_r"), F.col("client_id").alias("other"))
    linked = opened.withColumn("other_r", (F.col("r") + F.col("d")) % F.col("n")).join(far, ["round", "other_r"])
    return linked.select(
        "round", F.least("client_id", "other").alias("client_a"), F.greatest("client_id", "other").alias("client_b"),
        pair_seed(secret, F.col("client_id"), F.col("other")).alias("pair_seed"),
    )


def _ring(value: Column) -> Column:
    return F.pmod(value, F.lit(RING))


def mask_word(round_no: Column, seed: Column, idx: Column) -> Column:
    """48 bits of md5(round:seed:position)."""
    return F.conv(F.substring(hash_hex("mask", round_no, seed, idx), 1, 12), 16, 10).cast("bigint")


def client_masks(pairs: DataFrame, width: int) -> DataFrame:
    """(round, client_id, mask ARRAY<BIGINT>): plus for the lower id of a pair, minus for the higher.

    A client collects its at most 2 x reach seeds, a bounded list; the words are
    made in place, so the shuffle carries seeds and not masks.
    """
    ends = F.array(
        F.struct(F.col("client_a").alias("client_id"), F.lit(1).cast("bigint").alias("sign")),
        F.struct(F.col("client_b").alias("client_id"), F.lit(-1).cast("bigint").alias("sign")),
    )
    sides = pairs.select("round", "pair_seed", F.explode(ends).alias("e")).select("round", "e.client_id", "e.sign", "pair_seed")
    held = sides.groupBy("round", "client_id").agg(F.collect_list(F.struct("sign", "pair_seed")).alias("_s"))
    # Words are below 2^48, so fewer than 2^15 signed ones add up inside BIGINT.
    mask = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: _ring(F.aggregate(
            "_s", F.lit(0).cast("bigint"),
            lambda acc, s: acc + s["sign"] * mask_word(F.col("round"), s["pair_seed"], i),
        )),
    )
    return held.select("round", "client_id", mask.alias("mask"))


def quantise(value: Column) -> Column:
    return F.round(value * F.lit(SCALE)).cast("bigint")


def apply_mask(updates: DataFrame, masks: DataFrame, how: str = "left", expected: DataFrame | None = None) -> DataFrame:
    """Fixed-point params plus the client's mask, modulo 2^48.

    A participant without a mask, or with one of another length, fails the query:
    an unmasked update must never leave its client. ``expected`` (round, n) gives
    the number of participants: a value that could make their sum leave the ring
    then fails the query at its client. Without it, a value over the ring's half fails.
    """
    joined = updates.join(masks, ["round", "client_id"], how)
    if expected is None:
        joined = joined.withColumn("_room", F.lit(RING // 2))
    else:
        joined = joined.join(small(expected.select("round", F.floor(F.lit(RING // 2) / F.col("n")).alias("_room"))), "round")
    too_large = F.raise_error(F.concat(
        F.lit("an update of client "), F.col("client_id").cast("string"), F.lit(" is too large for the ring of masks"),
    )).cast("bigint")
    inside = lambda q: F.when(F.abs(q) < F.col("_room"), q).otherwise(too_large)
    wrong = F.raise_error(F.concat(
        F.lit("mask does not match the update of client "), F.col("client_id").cast("string"),
    )).cast("array<bigint>")
    fits = F.col("mask").isNotNull() & (F.size("mask") == F.size("params"))
    masked = F.transform("params", lambda v, i: _ring(inside(quantise(v)) + F.get("mask", i)))
    return joined.withColumn("masked", F.when(fits, masked).otherwise(wrong)).drop("mask", "params", "_room")


def secure_mean(masked: DataFrame, expected: DataFrame) -> DataFrame:
    """(round, idx, value): the uniform mean; masks cancel only if every participant reports.

    ``expected`` has (round, n): the participants the masks were made for.
    """
    long = masked.select("round", F.posexplode("masked").alias("idx", "m"))
    sums = long.groupBy("round", "idx").agg(F.sum(F.col("m").cast("decimal(38,0)")).alias("s"), F.count("*").alias("got"))
    ring = F.lit(RING).cast("decimal(38,0)")
    joined = sums.withColumn("s", F.pmod(F.col("s"), ring).cast("bigint")).join(small(expected), "round")
    absent = F.raise_error(F.lit("a participant is missing; its masks would not cancel")).cast("bigint")
    signed = F.when(F.col("s") >= RING // 2, F.col("s") - F.lit(RING)).otherwise(F.col("s"))
    n = F.when(F.col("got") == F.col("n"), F.col("n")).otherwise(absent)
    return joined.select("round", "idx", (signed / F.lit(SCALE) / n).alias("value"))
