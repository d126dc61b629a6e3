"""Local training and federated rounds.

A client is a grouping key. ``fedavg`` mode trains every client in a group of
its own, in batches of ``batch_size``. Its rows stream into one array of numbers,
past ``HELD_ROWS`` into a mapped file of the worker; a client above
``GROUP_ROWS`` is refused.
With ``local_steps`` an epoch has that many batches, drawn by row hash, and
``slices`` above 1 trains the same batches with each client dealt over many
groups (:mod:`synchronous`): the result does not depend on ``slices``. ``fed_sgd``
mode takes one clipped full-batch gradient per client and round and has no
per-client state at all. Nothing follows from the number of rows.

Training rows are laid out by client once and reused by every round; a round's
plan is that table plus the parameters as a closure, so plans do not grow with
rounds. A round's updates are written to the run's folder: the mean, the client
losses and the byte counts all read that one table. A round is committed by the
row that is written last; a run over a folder that holds committed rounds goes
on after them.
"""

from __future__ import annotations

import math
import os
import tempfile
import time
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.functions import net
from silolens.functions.hashing import hash_hex, order_word, stream_seed
from silolens.operators import gradients
from silolens.operators.aggregate import aggregate_round, sample_clients
from silolens.operators.metrics import METRICS, evaluate
from silolens.operators.privacy import apply_mask, client_masks, mask_pairs, secure_mean
from silolens.operators.synchronous import ADAM, adam_move, batch_slot, client_steps, drawn_ahead, gradient_rows, noise_blocks, noisy_mean, slot_order, step_noise  # noqa: F401
from silolens.session import bounded_rows, local_table, scratch_path, small, spread

#: Rows of a client that is trained in one task: what its steps take in time, since memory is bounded by ``HELD_ROWS``.
GROUP_ROWS = 100_000_000
#: Clients up to which the number of partitions is chosen so that they lie apart; more of them even out.
FEW_CLIENTS = 200
#: Rows of a client that a task keeps in memory; more lie in a mapped file.
HELD_ROWS = 2_000_000
#: Steps whose rows are gathered at once.
STEPS_AHEAD = 64


@dataclass(frozen=True)
class TrainConfig:
    """Everything a run needs; defaults are the usual federated settings."""

    hidden: tuple[int, ...] = (64, 32)
    rounds: int = 10
    local_epochs: int = 10
    batch_size: int = 64
    learning_rate: float = 0.01
    client_fraction: float = 1.0
    weighted: bool = True
    pos_weight: float = 0.0
    dp_enabled: bool = False
    noise_multiplier: float = 1.0
    clipping_norm: float = 1.0
    noise_scale: str = "documented"
    secure_aggregation: bool = False
    mask_secret: str = "simulation-only"
    mask_reach: int = 2
    local_steps: int | None = None
    slices: int = 1
    bytes_per_value: int = 4
    mode: str = "fedavg"
    seed: int = 42

    def sizes(self, features: Sequence[str]) -> tuple[int, ...]:
        return (len(features), *self.hidden, 1)


@dataclass
class FederatedRun:
    """Final parameters plus the tables a run leaves behind."""

    config: TrainConfig
    sizes: tuple[int, ...]
    params: list[float]
    rounds: list[dict] = field(default_factory=list)
    clients: DataFrame | None = None
    updates_path: str = ""
    checkpoint_path: str = ""
    seconds: float = 0.0

    def round_table(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, [tuple(r.get(c) for c in ROUND_COLUMNS) for r in self.rounds], ROUND_SCHEMA)


ROUND_SCHEMA = "round int, n_clients bigint, fit_loss double, comm_bytes bigint, n_rows bigint, loss double, " + ", ".join(f"{m} double" for m in METRICS)
ROUND_COLUMNS = [c.split()[0] for c in ROUND_SCHEMA.split(", ")]


def apart(clients: Sequence[Any], least: int) -> int:
    """Partitions, from ``least`` to twice as many, whose fullest one has the fewest rows of the given (hash, count).

    A round lasts as long as its slowest task, and a task trains its clients one
    after the other: of few clients, two that meet in a partition double it.
    """
    def fullest(parts: int) -> int:
        held: dict[int, int] = {}
        for c in clients:
            held[c["hash"] % parts] = held.get(c["hash"] % parts, 0) + c["count"]
        return max(held.values())

    return min(range(least, 2 * least + 1), key=lambda parts: (fullest(parts), parts))


def layout_clients(df: DataFrame, features: Sequence[str], label: str, keys: list[str], client: str, cfg: TrainConfig) -> DataFrame:
    """Training rows hash-partitioned and sorted by client: every round reads this without a shuffle.

    ``_order`` fixes the order of a client's rows, ``slot`` its batches under ``local_steps``.
    Rows are sorted by it here, where a sort may spill, so that no task sorts them again.
    Where every client's rows are one batch they have no order, and none is made.
    """
    spark = df.sparkSession
    counted = df.groupBy(F.col(f"`{client}`").alias("client")).agg(F.count("*").alias("count"))
    few = bounded_rows(counted.withColumn("hash", F.hash("client")), FEW_CLIENTS)
    large = counted.where(F.col("count") > GROUP_ROWS).limit(1).collect() if few is None else [r for r in few if r["count"] > GROUP_ROWS]
    if large:
        raise ValueError(f"client {large[0]['client']} has {large[0]['count']} rows, over {GROUP_ROWS}: set local_steps and slices, or use mode='fed_sgd'")
    whole = bool(few) and cfg.local_steps is None and all(r["count"] <= cfg.batch_size for r in few)
    digest = F.lit(0).cast("long") if whole else order_word(hash_hex(cfg.seed, "shard", *[F.col(f"`{k}`") for k in keys]))
    slot = batch_slot(keys, cfg.local_steps, cfg.seed) if cfg.local_steps else F.lit(0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    parts = apart(few, parts) if few else parts
    return (
        df.select(F.col(f"`{client}`"), digest.alias("_order"), slot.alias("slot"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features], F.col(f"`{label}`").cast("double").alias(label))
        .repartition(parts, client).sortWithinPartitions(client, *([] if whole else ["_order"])).persist(StorageLevel.MEMORY_AND_DISK)
    )


def epoch_batches(n: int, cfg: TrainConfig, epoch: int, order: np.random.Generator, slots: np.ndarray | None = None) -> Iterator[np.ndarray | range]:
    """The rows of each batch: runs of a shuffled order, or the slots in the epoch's order, empty ones left out.

    One batch of all rows needs no order: it is a range, whose rows are read as they lie.
    """
    if cfg.local_steps is None and 0 < n <= cfg.batch_size:
        yield range(n)
        return
    if cfg.local_steps is None:
        drawn = order.permutation(n)
        yield from (drawn[at : at + cfg.batch_size] for at in range(0, n, cfg.batch_size))
        return
    for s in slot_order(cfg.local_steps, epoch, cfg.seed):
        rows = np.flatnonzero(slots == s)
        if len(rows):
            yield rows


def _taken(held: np.ndarray, part: np.ndarray | range) -> np.ndarray:
    return held[part.start : part.stop] if isinstance(part, range) else held[part]


def adam_epochs(theta: np.ndarray, sizes: Sequence[int], held: np.ndarray, cfg: TrainConfig,
                stream: tuple, slots: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Mini-batch Adam from a fresh state over ``held`` (features, then the label); returns parameters and the last epoch's mean batch loss.

    Batch order and noise come from generators seeded by the stream key
    (seed, round, client), so a retried task repeats itself. Under ``local_steps``
    each step's noise has a generator of its own, as the slices of a client need it.
    """
    order = np.random.default_rng(stream_seed("order", *stream))
    sizes, clip = tuple(sizes), cfg.clipping_norm if cfg.dp_enabled else None
    most = gradient_rows(sizes)
    if cfg.local_steps is None and cfg.batch_size <= most:  # every batch fits one gradient call
        return _small_steps(theta, sizes, held, cfg, stream, order)
    theta = theta.copy()
    m, v, spare = np.zeros_like(theta), np.zeros_like(theta), np.empty((2, len(theta)))
    step, losses = 0, []
    private = clip is not None and clip * cfg.noise_multiplier > 0
    noise = step_noise(len(theta), cfg, *stream) if private and cfg.local_steps is None else None
    for epoch in range(cfg.local_epochs):
        for rows in epoch_batches(len(held), cfg, epoch, order, slots):
            parts = [rows[at : at + most] for at in range(0, len(rows), most)]
            step += 1
            g = 0.0
            for part in parts:
                z = _taken(held, part)
                g = g + net.gradient_sum(theta, sizes, z[:, :-1], z[:, -1], cfg.pos_weight, clip)
            if noise is None:
                g = noisy_mean(g, len(rows), cfg, *stream, step)
            else:
                g += next(noise) if cfg.noise_scale == "documented" else next(noise) / len(rows)
                g /= len(rows)
            adam_move(theta, m, v, g, step, cfg.learning_rate, spare)
            if epoch == cfg.local_epochs - 1:
                total = 0.0
                for part in parts:
                    z = z if len(parts) == 1 else _taken(held, part)
                    total += net.mean_log_loss(net.probabilities(theta, sizes, z[:, :-1]), z[:, -1]) * (len(part) / len(rows))
                losses.append(total)
    return theta, float(np.mean(losses)) if losses else math.nan


def _small_steps(theta: np.ndarray, sizes: tuple[int, ...], held: np.ndarray, cfg: TrainConfig, stream: tuple,
                 order: np.random.Generator) -> tuple[np.ndarray, float]:
    """The steps of :func:`adam_epochs` whose batches fit one gradient call.

    A step costs some hundred calls on small arrays, so what does not depend on
    the parameters is done for ``STEPS_AHEAD`` steps at once: rows are gathered
    here, noise is drawn by a thread while steps are taken.
    """
    clip, n, size = cfg.clipping_norm if cfg.dp_enabled else None, len(held), max(min(cfg.batch_size, len(held)), 1)
    model = net.HeldNet(theta, sizes, size)
    now = model.held
    m, v, spare = np.zeros_like(now), np.zeros_like(now), np.empty((2, len(now)))
    stride = STEPS_AHEAD * size
    inputs, labels, rows = np.zeros((min(stride, n), model.widths[0])), np.empty(min(stride, n)), np.empty((min(stride, n), held.shape[1]))
    step, losses = 0, []
    noise = None
    if clip is not None and clip * cfg.noise_multiplier > 0:
        noise = drawn_ahead(noise_blocks(model.at, len(now), size, cfg, *stream))
    try:
        for epoch in range(cfg.local_epochs):
            drawn = order.permutation(n)
            for at in range(0, n, stride):
                block = np.take(held, drawn[at : at + stride], axis=0, out=rows[: n - at], mode="clip")
                x_all, y_all = model.inputs_of(block[:, :-1], inputs), labels[: len(block)]
                y_all[:] = block[:, -1]
                for lo in range(0, len(block), size):
                    x, y = x_all[lo : lo + size], y_all[lo : lo + size]
                    step += 1
                    whole = len(x) == size and size & (size - 1) == 0  # then dividing first rounds nothing
                    g = model.gradient_of(x, y, cfg.pos_weight, clip, 1.0 / size if whole else 1.0)
                    if noise is not None:
                        drawn_now = next(noise)
                        if not whole:
                            drawn_now *= size if cfg.noise_scale == "documented" else size * (size / len(x))
                        g += drawn_now
                    if not whole:
                        g /= len(x)
                    adam_move(now, m, v, g, step, cfg.learning_rate, spare)
                    if epoch == cfg.local_epochs - 1:
                        losses.append(net.mean_log_loss(model.probabilities_of(x), y))
    finally:
        if noise is not None:
            noise.close()
    return model.theta, float(np.mean(losses)) if losses else math.nan


class _Rows:
    """Blocks of rows put together: in memory up to ``HELD_ROWS``, past that in a file that is mapped, not read."""

    def __init__(self, width: int, dtype: type):
        self.width, self.dtype = width, dtype
        self.blocks: list[np.ndarray] = []
        self.count, self.file = 0, None

    def add(self, block: np.ndarray) -> None:
        self.blocks.append(np.ascontiguousarray(block, dtype=self.dtype))
        self.count += len(block)
        if self.count > HELD_ROWS:
            if self.file is None:
                folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            for held in self.blocks:
                self.file.write(held)
            self.blocks.clear()

    def whole(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.blocks) if self.blocks else np.empty((0, self.width), self.dtype)
        self.file.flush()
        return np.asarray(np.memmap(self.file, self.dtype, "r", shape=(self.count, self.width)))


def held_rows(batches: Iterator[pd.DataFrame], names: Sequence[str], label: str, with_slots: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """A client's examples as (features..., label) in the order of ``_order``, and their slots.

    Rows that miss a feature or the label are no examples.
    """
    numbers, orders, slots = _Rows(len(names) + 1, np.float64), _Rows(1, np.int64), _Rows(1, np.int32)
    last, ordered = None, True
    for batch in batches:
        table = batch[[*names, label]].to_numpy(dtype=np.float64)
        whole = ~np.isnan(table).any(axis=1)
        order = batch["_order"].to_numpy(dtype=np.int64)[whole]
        numbers.add(table[whole])
        orders.add(order[:, None])
        if with_slots:
            slots.add(batch["slot"].to_numpy(dtype=np.int32)[whole][:, None])
        if len(order):
            ordered = ordered and (last is None or last <= order[0]) and bool((order[1:] >= order[:-1]).all())
            last = order[-1]
    held, dealt = numbers.whole(), slots.whole()[:, 0] if with_slots else None
    if ordered:  # as the layout has them
        return held, dealt
    by = np.argsort(orders.whole()[:, 0], kind="stable")
    return held[by], dealt[by] if with_slots else None


def local_updates(rows: DataFrame, params: Sequence[float], features: Sequence[str], label: str, client: str,
                  cfg: TrainConfig, round_no: int) -> DataFrame:
    """One update row per client: (round, client, n_examples, loss, params), from the laid out rows."""
    theta, sizes, names = np.asarray(params, dtype=np.float64), cfg.sizes(features), list(features)
    net.check_params(params, sizes)

    def train_group(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, slots = held_rows(batches, names, label, cfg.local_steps is not None)
        new, loss = adam_epochs(theta, sizes, held, cfg, (cfg.seed, round_no, *key), slots)
        yield pd.DataFrame({"round": [round_no], client: [key[0]], "n_examples": [len(held)], "loss": [loss], "params": [new]})

    kind = rows.schema[client].dataType.simpleString()
    return rows.groupBy(client).applyInPandas(train_group, f"round int, `{client}` {kind}, n_examples bigint, loss double, params array<double>")


def _param_vector(mean: DataFrame, width: int) -> list[float]:
    """The model: ``width`` numbers, the only vector a round brings to the driver."""
    values = {r["idx"]: r["value"] for r in mean.collect()}
    if len(values) != width:
        raise ValueError(f"aggregated {len(values)} of {width} parameters")
    return [values[i] for i in range(width)]


def mean_update(updates: DataFrame, width: int, cfg: TrainConfig) -> list[float]:
    """The model after a round of ``updates``: their mean, weighted by examples unless ``cfg`` asks for the uniform one."""
    return _param_vector(aggregate_round(updates, weighted=cfg.weighted), width)


def secure_round(updates: DataFrame, participants: DataFrame, width: int, cfg: TrainConfig) -> DataFrame:
    """Mask every update, then take the uniform mean of the masked ones.

    Masks are made for the ``participants`` (round, client_id) drawn before
    training; an update that does not arrive fails the round.
    """
    expected = participants.groupBy("round").agg(F.count("*").alias("n"))
    pairs = mask_pairs(participants, cfg.mask_secret, cfg.mask_reach, cfg.seed)
    return secure_mean(apply_mask(updates, client_masks(pairs, width), expected=expected), expected)


def gradient_round(train: DataFrame, params: Sequence[float], features: Sequence[str], label: str, client: str,
                   cfg: TrainConfig, round_no: int) -> tuple[list[float], int]:
    """fed_sgd: every client's clipped mean gradient, noised, averaged, one step. Also counts the clients.

    The average is weighted by rows, uniform without ``weighted`` and under masks.
    """
    sizes = cfg.sizes(features)
    clip = cfg.clipping_norm if cfg.dp_enabled else 0.0
    weight = F.col("n_examples") if cfg.weighted else F.lit(1)
    if len(sizes) == 2:
        rows = logistic_client_gradients(train, params, features, label, client, cfg, round_no)
        if cfg.secure_aggregation:
            vectors = rows.select(F.col(client).alias("client_id"), F.array(*[f"g{i}" for i in range(len(params))]).alias("params"))
            return _masked_step(vectors, train, params, client, cfg, round_no)
        means = [(F.sum(F.col(f"g{i}") * weight) / F.sum(weight)).alias(f"g{i}") for i in range(len(params))]
        mean = rows.agg(F.count("*").alias("n"), *means).first()
        g, n_clients = [mean[f"g{i}"] for i in range(len(params))], mean["n"]
    else:
        long = gradients.net_gradient_sums(train, params, sizes, features, label, client, cfg.pos_weight, clip or None)
        if cfg.dp_enabled and cfg.clipping_norm * cfg.noise_multiplier > 0:
            std = gradients.noise_std(clip, cfg.noise_multiplier, F.col("n_examples"), cfg.noise_scale)
            draw = gradients.gaussian(hash_hex(cfg.seed, "noise", round_no, F.col(client), 0, F.col("idx")))
            long = long.withColumn("g", F.col("g") + std * draw)
        if cfg.secure_aggregation:
            entries = F.array_sort(F.collect_list(F.struct("idx", (F.col("g") / F.col("n_examples")).alias("v"))))
            vectors = long.groupBy(F.col(client).alias("client_id")).agg(F.transform(entries, lambda s: s["v"]).alias("params"))
            return _masked_step(vectors, train, params, client, cfg, round_no)
        mean = long.groupBy("idx").agg(
            (F.sum(F.col("g") / F.col("n_examples") * weight) / F.sum(weight)).alias("value"), F.count("*").alias("n")
        ).persist()
        g, n_clients = _param_vector(mean, len(params)), mean.agg(F.max("n")).first()[0]
        mean.unpersist()
    return [float(t - cfg.learning_rate * d) for t, d in zip(params, g)], n_clients


def _masked_step(vectors: DataFrame, train: DataFrame, params: Sequence[float], client: str, cfg: TrainConfig,
                 round_no: int) -> tuple[list[float], int]:
    """One step along the uniform mean of the clients' masked mean gradients."""
    spark = train.sparkSession
    path = scratch_path(spark, "gradients")  # read by the masking and by the count
    vectors.select(F.lit(round_no).alias("round"), "client_id", "params").write.parquet(path)
    members = _members(train, client, round_no)
    mean = secure_round(spark.read.parquet(path), members, len(params), cfg)
    g = _param_vector(mean, len(params))
    return [float(t - cfg.learning_rate * d) for t, d in zip(params, g)], spark.read.parquet(path).count()


def _members(rows: DataFrame, client: str, round_no: int) -> DataFrame:
    """(round, client_id): the clients that a round was asked of."""
    return rows.select(F.lit(round_no).alias("round"), F.col(client).alias("client_id")).distinct()


def logistic_client_gradients(train: DataFrame, params: Sequence[float], features: Sequence[str], label: str,
                              client: str, cfg: TrainConfig, round_no: int) -> DataFrame:
    """(client, n_examples, g0..): the mean clipped, noised gradient of each client."""
    cols = [f"g{i}" for i in range(len(params))]
    clip = cfg.clipping_norm if cfg.dp_enabled else 0.0
    rows = gradients.logistic_gradients(train, params, features, label, cfg.pos_weight)
    sums = gradients.clipped_sums(rows, cols, clip, [client])
    if cfg.dp_enabled:
        sums = gradients.add_noise(sums, cols, clip, cfg.noise_multiplier, cfg.seed, round_no, 0, client, cfg.noise_scale)
    return gradients.mean_gradient(sums, cols)


def client_evaluate(df: DataFrame, params: Sequence[float], sizes: Sequence[int], features: Sequence[str],
                    label: str = "target", by: list[str] | None = None) -> DataFrame:
    """Loss and the four metrics of one model on every group's rows."""
    scored = net.predict(net.score(df, params, sizes, features))
    return evaluate(scored.withColumn("y_true", F.col(f"`{label}`")), by=by)


def train_federated(train: DataFrame, test: DataFrame, features: Sequence[str], keys: list[str], cfg: TrainConfig,
                    label: str = "target", client: str = "client_id", client_test: DataFrame | None = None,
                    run_path: str | None = None, laid: DataFrame | None = None) -> FederatedRun:
    """Rounds of local training and averaging; the model is evaluated on ``test`` after each.

    Round 0 is the untrained model. Checkpoints (round, idx, value) of every
    round, round 0 included, lie under ``checkpoint_path``. With ``run_path`` the
    run is kept in that folder: called again over it, with the same settings or
    more rounds, it takes committed rounds as they are and goes on after the
    last; a round that was broken off is done anew. ``laid`` is a table of
    :func:`layout_clients` that the caller keeps for several runs.
    """
    spark = train.sparkSession
    started = time.time()
    sizes = cfg.sizes(features)
    run = FederatedRun(cfg, sizes, net.init_params(sizes, cfg.seed))
    folder = run_path or scratch_path(spark, "run")
    run.updates_path, run.checkpoint_path = f"{folder}/updates", f"{folder}/checkpoints"
    done = committed_rounds(spark, folder, _settings(cfg, features, label)) if run_path else {}
    run.rounds = [done[r] for r in range(cfg.rounds + 1) if r in done]
    if done:
        run.params = load_params(spark, run.checkpoint_path, len(run.rounds) - 1)
    eval_rows = spread(test.select(*[F.col(f"`{c}`") for c in features], label)).persist()
    rows = members = None
    if len(run.rounds) <= cfg.rounds:
        rows = _training_rows(train, features, label, keys, client, cfg) if laid is None else laid
        members = train.select(F.col(client).alias("client_id")).distinct().persist() if cfg.client_fraction < 1.0 else None
    try:
        for r in range(len(run.rounds), cfg.rounds + 1):
            record: dict = {"round": r, "comm_bytes": 0, "n_clients": 0, "fit_loss": None}
            if r:
                part = _participants(rows, members, cfg, client, r)
                record.update(_round(part, run, features, keys, label, client, r))
            save_params(spark, run.params, run.checkpoint_path, r)
            record.update(client_evaluate(eval_rows, run.params, sizes, features, label).first().asDict())
            run.rounds.append({c: record.get(c) for c in ROUND_COLUMNS})
            _commit_round(spark, folder, run.rounds[-1], _settings(cfg, features, label))
        if client_test is not None:
            run.clients = client_evaluate(client_test, run.params, sizes, features, label, by=[client])
    finally:
        for held in (eval_rows, rows if laid is None else None, members):
            if held is not None:
                held.unpersist()
    run.seconds = time.time() - started
    return run


def _training_rows(train: DataFrame, features: Sequence[str], label: str, keys: list[str], client: str, cfg: TrainConfig) -> DataFrame:
    if cfg.slices > 1 and not cfg.local_steps:
        raise ValueError("slices need local_steps: batches that do not depend on where rows lie")
    if cfg.mode == "fedavg" and cfg.slices == 1:
        return layout_clients(train, features, label, keys, client, cfg)
    kept = dict.fromkeys([client, *(keys if cfg.mode == "fedavg" else []), *features, label])
    return spread(train.select(*[F.col(f"`{c}`") for c in kept])).persist()


def _settings(cfg: TrainConfig, features: Sequence[str], label: str) -> str:
    """What must be equal for a run to go on: all but the number of rounds and how the work is dealt."""
    kept = {k: v for k, v in asdict(cfg).items() if k not in ("rounds", "slices")}
    return repr((sorted(kept.items()), list(features), label))


def _commit_round(spark: SparkSession, folder: str, record: dict, settings: str) -> None:
    """The row that makes a round count: written after its updates and parameters."""
    row = (*[record[c] for c in ROUND_COLUMNS], settings)
    local_table(spark, [row], f"{ROUND_SCHEMA}, settings string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/rounds/r{record['round']}")


def committed_rounds(spark: SparkSession, folder: str, settings: str | None = None) -> dict[int, dict]:
    """The records of a run's whole rounds, without a gap from round 0 on; of other ``settings`` an error."""
    try:
        rows = spark.read.schema(f"{ROUND_SCHEMA}, settings string").parquet(f"{folder}/rounds/*").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    if settings is not None and any(r["settings"] != settings for r in rows):
        raise ValueError(f"{folder} holds a run with other settings")
    found = {r["round"]: {c: r[c] for c in ROUND_COLUMNS} for r in rows}
    whole = next(n for n in range(len(found) + 1) if n not in found)
    return {n: found[n] for n in range(whole)}


def _participants(rows: DataFrame, members: DataFrame | None, cfg: TrainConfig, client: str, r: int) -> DataFrame:
    if members is None:
        return rows
    drawn = sample_clients(members.withColumn("round", F.lit(r)), cfg.client_fraction, cfg.seed)
    return rows.join(small(drawn.select(F.col("client_id").alias(client))), client, "left_semi")


def _round(rows: DataFrame, run: FederatedRun, features: Sequence[str], keys: list[str], label: str, client: str, r: int) -> dict:
    cfg, spark = run.config, rows.sparkSession
    if cfg.mode == "fed_sgd":
        run.params, n_clients = gradient_round(rows, run.params, features, label, client, cfg, r)
        return {"n_clients": n_clients, "comm_bytes": n_clients * len(run.params) * cfg.bytes_per_value}
    path = f"{run.updates_path}/r{r}"
    if cfg.slices > 1:
        made = client_steps(rows, run.params, features, keys, label, client, cfg, r)
    else:
        made = local_updates(rows, run.params, features, label, client, cfg, r)
    made.withColumnRenamed(client, "client_id").write.mode("overwrite").parquet(path)
    updates = spark.read.parquet(path)
    totals = updates.agg(
        F.count("client_id").alias("n_clients"),
        F.sum(F.col("loss") * F.col("n_examples")).alias("l"), F.sum("n_examples").alias("n"),
    ).first()
    if cfg.secure_aggregation:
        run.params = _param_vector(secure_round(updates, _members(rows, client, r), len(run.params), cfg), len(run.params))
    else:
        run.params = mean_update(updates, len(run.params), cfg)
    return {
        "n_clients": totals["n_clients"], "fit_loss": totals["l"] / totals["n"],
        "comm_bytes": totals["n_clients"] * len(run.params) * cfg.bytes_per_value,
    }


def save_params(spark: SparkSession, params: Sequence[float], path: str, round_no: int) -> None:
    table = local_table(spark, [(i, float(v)) for i, v in enumerate(params)], "idx int, value double")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/round={round_no}")


def load_params(spark: SparkSession, path: str, round_no: int | None = None) -> list[float]:
    """A round's parameters; the last round's without a number."""
    table = spark.read.schema("idx int, value double, round int").parquet(path)
    if round_no is None:
        round_no = table.agg(F.max("round")).first()[0]
    return [r["value"] for r in table.where(F.col("round") == round_no).orderBy("idx").collect()]


def without_privacy(cfg: TrainConfig) -> TrainConfig:
    return replace(cfg, dp_enabled=False, secure_aggregation=False)
