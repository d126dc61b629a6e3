"""Training in synchronous steps: one model over all tasks, or one model a client over many tasks.

An epoch has a fixed number of steps whatever the table's size. A row's batch is
a slot that follows from its key's hash, so it does not depend on where the row
lies; slots are visited in another order each epoch. A step reads the rows of
its slot only, every task sums the gradients of its rows, and the sums move the
parameters once.

``central_steps`` keeps one model and its moments on the driver. For clients,
``client_steps`` keeps a table (client, theta, m, v): each client's rows are
dealt into slices and packed into blocks that meet the client's state by key, so
no task holds more than some blocks and the number of slices does not change the
result. Every step's
state is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool
from typing import TYPE_CHECKING, Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from silolens.functions import net
from silolens.functions.hashing import hash_hex, stream_seed, uniform_value, word
from silolens.session import cut_lineage, local_table, scratch_path, small, spread

if TYPE_CHECKING:
    from silolens.operators.train import TrainConfig

ADAM = (0.9, 0.999, 1e-8)  # fixed values: decay rates and epsilon
#: Partial sums that the driver adds up itself; more of them are first added by tasks.
DRIVER_SUMS = 64
#: Rows that a slice of a client's batch had better not exceed, since one task packs it; memory does not depend on it.
GROUP_ROWS = 2_000_000
#: Examples of a block.
BLOCK_ROWS = 4096
#: Bytes of activations that one gradient call may hold.
HELD_BYTES = 64 << 20
#: Rows that one held gradient call takes: the arrays of usual nets stay in a core's cache.
CACHED_ROWS = 256
#: Bytes of noise that are drawn at once: what a core's cache holds.
NOISE_BYTES = 256 << 10
#: Bytes of noise that a thread draws ahead at once.
AHEAD_BYTES = 2 << 20
VECTOR = ArrayType(DoubleType())


def batch_slot(keys: Sequence[str], steps: int, seed: int) -> Column:
    """The batch of a row: 0 to ``steps`` - 1, from its key."""
    return F.pmod(word(hash_hex(seed, "batch", *[F.col(f"`{k}`") for k in keys])), F.lit(steps)).cast("int")


def slot_order(steps: int, epoch: int, seed: int) -> list[int]:
    """The order in which an epoch visits its batches."""
    return sorted(range(steps), key=lambda s: (uniform_value(seed, "order", epoch, s), s))


def adam_move(theta: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, step: int, rate: float, spare: np.ndarray) -> None:
    """Move parameters and moments in place by the ``step``-th mean gradient, counted from 1; ``spare`` is (2, width).

    The moments are decayed sums, not means: the factors 1 - decay and the bias
    corrections of a step are two numbers, so they cost no pass over the arrays.
    """
    b1, b2, eps = ADAM
    a, b = spare
    m *= b1
    m += g
    np.multiply(g, g, out=a)
    v *= b2
    v += a
    size = math.sqrt((1 - b2**step) / (1 - b2))
    np.sqrt(v, out=a)
    a += eps * size
    np.divide(m, a, out=b)
    b *= rate * size * (1 - b1) / (1 - b1**step)
    theta -= b


def adam_step(theta: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, step: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters and moments after the ``step``-th mean gradient, as new arrays."""
    theta, m, v = theta.copy(), m.copy(), v.copy()
    adam_move(theta, m, v, g, step, rate, np.empty((2, len(theta))))
    return theta, m, v


def noisy_mean(g: np.ndarray, n: int, cfg: TrainConfig, *stream: object) -> np.ndarray:
    """The mean of a batch's summed gradient, with the noise of the step that ``stream`` names."""
    std = cfg.clipping_norm * cfg.noise_multiplier if cfg.dp_enabled else 0.0
    if std <= 0:
        return g / n
    noise = np.random.default_rng(stream_seed("noise", *stream)).standard_normal(g.shape)
    noise *= std if cfg.noise_scale == "documented" else std / n
    noise += g
    noise /= n
    return noise


def step_noise(width: int, cfg: TrainConfig, *stream: object) -> Iterator[np.ndarray]:
    """The noise of one step after the other, C x sigma, from one generator that ``stream`` names; drawn for several steps at once."""
    rng, block = np.random.default_rng(stream_seed("noise", *stream)), np.empty((max(1, NOISE_BYTES // (8 * width)), width))
    while True:
        rng.standard_normal(out=block)
        block *= cfg.clipping_norm * cfg.noise_multiplier
        yield from block


def noise_blocks(at: np.ndarray, width: int, size: int, cfg: TrainConfig, *stream: object) -> Iterator[np.ndarray]:
    """The numbers of :func:`step_noise`, for many steps at a time and for the mean of ``size`` rows; at the places ``at`` of rows of ``width``."""
    rng, steps = np.random.default_rng(stream_seed("noise", *stream)), max(1, AHEAD_BYTES // (8 * width))
    raw, scale = np.empty((steps, len(at))), cfg.clipping_norm * cfg.noise_multiplier / (size if cfg.noise_scale == "documented" else size * size)
    held = [np.zeros((steps, width)) for _ in range(3)]  # one is used, one waits, one is filled
    for k in itertools.count():
        rng.standard_normal(out=raw)
        raw *= scale
        held[k % 3][:, at] = raw
        yield held[k % 3]


def drawn_ahead(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Row after row of ``blocks``; a thread makes the next block while the rows of one are used."""
    with ThreadPool(1) as pool:
        coming = pool.apply_async(next, (blocks,))
        while True:
            block = coming.get()
            coming = pool.apply_async(next, (blocks,))
            yield from block


def gradient_rows(sizes: Sequence[int]) -> int:
    """Rows that one gradient call may take."""
    return max(1, HELD_BYTES // (8 * 3 * sum(sizes)))


def held_gradient(model: net.HeldNet, x: np.ndarray, y: np.ndarray, pos_weight: float, clip: float | None, total: np.ndarray) -> None:
    """Add the summed gradient of any number of rows to ``total``, in the form of ``model.held``; some rows at a time, whose arrays stay in a core's cache."""
    y = np.ascontiguousarray(y)
    rows = len(model.inputs)
    for at in range(0, len(x), rows):
        total += model.gradient_of(model.inputs_of(x[at : at + rows], model.inputs), y[at : at + rows], pos_weight, clip)


def _gradient(theta: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, pos_weight: float, clip: float | None) -> np.ndarray:
    total = np.zeros(net.n_params(sizes))
    rows = gradient_rows(sizes)
    for at in range(0, len(x), rows):
        total += net.gradient_sum(theta, sizes, x[at : at + rows], y[at : at + rows], pos_weight, clip)
    return total


def _batches(rows: DataFrame, steps: int, name: str, names: Sequence[str], label: str, by: Sequence[str] = ()) -> list[DataFrame]:
    """The examples of each slot as (by..., block): a step lists and reads its own folder only.

    Rows meet once by (by..., slice, slot) and stream into blocks of at most
    ``BLOCK_ROWS`` examples, the numbers' bytes: what a step then moves is a
    buffer, and no task holds more than it reads at a time.
    """
    spark = rows.sparkSession
    columns = [*names, label]
    schema = StructType([*[rows.schema[c] for c in by], StructField("slot", IntegerType()), StructField("block", BinaryType())])

    def pack(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *owner, _, slot = key
        for part in parts:
            x = part[columns].to_numpy(np.float64)
            x = x[~np.isnan(x).any(axis=1)]
            blocks = [x[at : at + BLOCK_ROWS].tobytes() for at in range(0, len(x), BLOCK_ROWS)]
            if blocks:
                yield pd.DataFrame({**{c: [k] * len(blocks) for c, k in zip(by, owner)}, "slot": [slot] * len(blocks), "block": blocks})

    path = scratch_path(spark, name)
    rows.groupBy(*by, "slice", "slot").applyInPandas(pack, schema).write.partitionBy("slot").parquet(path)
    kept = StructType([f for f in schema.fields if f.name != "slot"])
    present = {r["slot"]: r["count"] for r in spark.read.schema(schema).parquet(path).groupBy("slot").count().collect()}  # ``steps`` values at most
    out = []
    for s in range(steps):
        held = spark.read.schema(kept).parquet(f"{path}/slot={s}") if s in present else local_table(spark, [], kept)
        tasks = min(present.get(s, 0), spark.sparkContext.defaultParallelism)
        if held.rdd.getNumPartitions() < tasks:  # a slot lies in few files, and its steps would leave cores idle
            held = held.repartition(tasks)
        out.append(held.persist(StorageLevel.MEMORY_AND_DISK))
    return out


def _numbers(block: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    held = np.frombuffer(block, dtype=np.float64).reshape(-1, width)
    return held[:, :-1], held[:, -1]


def _examples(df: DataFrame, features: Sequence[str], label: str) -> list[Column]:
    return [*[F.col(f"`{c}`").cast("double").alias(c) for c in features], F.col(f"`{label}`").cast("double").alias(label)]


def added(partials: DataFrame, tasks: int, width: int) -> tuple[np.ndarray, int]:
    """Sum of (g, n) rows, one for each of ``tasks``; many of them are first added up in groups."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, n = np.zeros(width), 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                g, n = g + np.asarray(r.g), n + r.n
        if n:
            yield pd.DataFrame({"g": [g], "n": [n]})

    if tasks > DRIVER_SUMS:
        partials = partials.repartition(math.isqrt(tasks)).mapInPandas(add, partials.schema)
    g, n = np.zeros(width), 0
    for r in partials.collect():
        g, n = g + np.asarray(r["g"]), n + r["n"]
    return g, n


def central_steps(train: DataFrame, params: Sequence[float], sizes: Sequence[int], features: Sequence[str], keys: Sequence[str],
                  label: str, epochs: int, steps: int, rate: float, seed: int, pos_weight: float = 0.0) -> Iterator[list[float]]:
    """The parameters after every epoch of mini-batch Adam over the whole table.

    Rows that miss a feature or the label are no examples; a batch without
    examples is no step.
    """
    theta = np.asarray(params, dtype=np.float64)
    layout, names, width = tuple(sizes), list(features), len(params)
    net.check_params(params, sizes)
    m, v, step = np.zeros(width), np.zeros(width), 0
    parts = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")) // steps, 1)
    salt = F.pmod(word(hash_hex(seed, "slice", *[F.col(f"`{k}`") for k in keys])), F.lit(parts)).cast("int")
    rows = spread(train).select(salt.alias("slice"), batch_slot(keys, steps, seed).alias("slot"), *_examples(train, features, label))
    batches = _batches(rows, steps, "batches", names, label)
    tasks = [b.rdd.getNumPartitions() for b in batches]
    try:
        for epoch in range(epochs):
            for s in slot_order(steps, epoch, seed):

                def partial(parts: Iterator[pd.DataFrame], now: np.ndarray = theta) -> Iterator[pd.DataFrame]:
                    model = net.HeldNet(now, layout, CACHED_ROWS)
                    g, n = np.zeros(len(model.held)), 0
                    for part in parts:
                        for block in part["block"]:
                            x, y = _numbers(block, len(names) + 1)
                            held_gradient(model, x, y, pos_weight, None, g)
                            n += len(x)
                    if n:
                        yield pd.DataFrame({"g": [g[model.at]], "n": [n]})

                g, n = added(batches[s].mapInPandas(partial, "g array<double>, n long"), tasks[s], width)
                if n:
                    step += 1
                    theta, m, v = adam_step(theta, m, v, g / n, step, rate)
            yield [float(t) for t in theta]
    finally:
        for b in batches:
            b.unpersist()


def client_steps(train: DataFrame, params: Sequence[float], features: Sequence[str], keys: Sequence[str], label: str, client: str,
                 cfg: TrainConfig, round_no: int) -> DataFrame:
    """(round, client, n_examples, loss, params): every client's ``local_epochs`` of ``local_steps`` steps, in ``slices``.

    Equal, up to the order of sums, to training each client in one group with
    the same batches. ``loss`` is the mean over the last epoch's batches, each
    measured after its step.
    """
    theta, sizes, names = np.asarray(params, dtype=np.float64), cfg.sizes(features), list(features)
    net.check_params(params, sizes)
    clip = cfg.clipping_norm if cfg.dp_enabled else None
    salt = F.pmod(word(hash_hex(cfg.seed, "slice", *[F.col(f"`{k}`") for k in keys])), F.lit(cfg.slices)).cast("int")
    owner = StructField(client, train.schema[client].dataType)
    rows = spread(train).select(F.col(f"`{client}`"), salt.alias("slice"), batch_slot(keys, cfg.local_steps, cfg.seed).alias("slot"), *_examples(train, features, label))
    batches = _batches(rows, cfg.local_steps, "client_batches", names, label, [client])

    state_schema = StructType([owner, *[StructField(c, VECTOR) for c in ("theta", "m", "v")], StructField("step", IntegerType())])
    zeros = F.array_repeat(F.lit(0.0), len(params))
    first = F.from_json(F.lit(str([float(t) for t in theta])), VECTOR)
    state = rows.select(client).distinct().select(client, first.alias("theta"), zeros.alias("m"), zeros.alias("v"), F.lit(0).alias("step"))
    state = cut_lineage(state, "state")

    def met(s: int, now: DataFrame) -> DataFrame:
        """Every block of a slot beside its client's parameters."""
        held = small(now.select(F.col(f"`{client}`").alias("_owner"), "theta"))
        return batches[s].join(held, F.col(f"`{client}`").eqNullSafe(F.col("_owner"))).drop("_owner")

    def gradients(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for part in parts:
            for owner_key, block, now in zip(part[client].astype(object), part["block"], part["theta"]):
                x, y = _numbers(block, len(names) + 1)
                n, g = sums.get(owner_key, (0, 0.0))
                sums[owner_key] = n + len(x), g + _gradient(np.asarray(now), sizes, x, y, cfg.pos_weight, clip)
            if len(sums) * len(params) * 8 > HELD_BYTES:
                yield told(sums)
                sums = {}
        if sums:
            yield told(sums)

    def told(sums: dict) -> pd.DataFrame:
        n, g = zip(*sums.values())
        part = TaskContext.get().partitionId()
        return pd.DataFrame({client: pd.Series(list(sums), dtype=object), "part": [part] * len(sums), "n": n, "g": pd.Series(list(g), dtype=object)})

    def moved(key: tuple, sums: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(sums):  # no example of the client in this batch: no step
            return held
        n, step = int(sums["n"].sum()), int(held["step"].iloc[0]) + 1
        g = np.sum(np.stack(sums.sort_values("part", kind="stable")["g"].to_numpy()), axis=0)
        old = [np.asarray(held[c].iloc[0]) for c in ("theta", "m", "v")]
        new = adam_step(*old, noisy_mean(g, n, cfg, cfg.seed, round_no, key[0], step), step, cfg.learning_rate)
        return pd.DataFrame({client: [key[0]], "theta": [new[0]], "m": [new[1]], "v": [new[2]], "step": [step]})

    def losses(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, total = [], []
            for block, now in zip(part["block"], part["theta"]):
                x, y = _numbers(block, len(names) + 1)
                n.append(len(x))
                total.append(net.mean_log_loss(net.probabilities(np.asarray(now), sizes, x), y) * len(x))
            yield pd.DataFrame({client: part[client].astype(object), "n": n, "total": total})

    sum_schema = StructType([owner, StructField("part", IntegerType()), StructField("n", LongType()), StructField("g", VECTOR)])
    loss_schema = StructType([owner, StructField("n", LongType()), StructField("total", DoubleType())])
    measured = None
    try:
        for epoch in range(cfg.local_epochs):
            for s in slot_order(cfg.local_steps, epoch, cfg.seed):
                sums = met(s, state).mapInPandas(gradients, sum_schema)
                state = cut_lineage(sums.groupBy(client).cogroup(state.groupBy(client)).applyInPandas(moved, state_schema), "state")
                if epoch == cfg.local_epochs - 1:
                    after = met(s, state).mapInPandas(losses, loss_schema)
                    each = after.groupBy(client).agg((F.sum("total") / F.sum("n")).alias("loss"), F.sum("n").alias("n"))
                    measured = each if measured is None else measured.unionAll(each)
        total = measured.groupBy(client).agg(F.avg("loss").alias("loss"), F.sum("n").alias("n_examples"))
        out = state.join(total, client, "left").select(
            F.lit(round_no).alias("round"), client, F.coalesce("n_examples", F.lit(0)).alias("n_examples"), "loss", F.col("theta").alias("params"))
        return cut_lineage(out, "client_updates")
    finally:
        for b in batches:
            b.unpersist()
