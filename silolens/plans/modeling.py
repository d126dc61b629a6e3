"""Queries over scoring, gradients, local training, baselines and metrics (D, F9, F10, G)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.functions import net
from silolens.operators import baselines, gradients, metrics, report, synchronous, train
from silolens.operators.aggregate import fedavg
from silolens.plans import fixtures as fx
from silolens.plans.fixtures import FEATURES, K, KEYS, LOGIT, NET, r, rounded
from silolens.plans.registry import query
from silolens.session import cut_lineage, local_table, scratch_path
from silolens.sources import tables, track

P = len(LOGIT)
GRADS = [f"g{i}" for i in range(P)]
NET_PARAMS = net.init_params(NET, fx.SEED)
COLS = [f'"{c}"' for c in FEATURES]
LOSS = r(f"avg({fx.log_loss('p1', 'target')})", "loss")
EVAL = f"count(*) AS n_rows, {LOSS}, {fx.metrics_sql()}"
CLIP = 0.8
SIGMA = 1.1
LR = 0.05


def scored(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return net.predict(net.score(fx.features(spark, sf, *extra), LOGIT, (6, 1), FEATURES))


SCORED = fx.FEAT + ",\n" + fx.scored("feat") + ",\npr AS (SELECT *, CAST(p1 >= 0.5 AS INTEGER) AS y_pred, greatest(p1, 1 - p1) AS confidence FROM sc)"


def net_sql(source: str, weights: list[list[list[str]]], biases: list[list[str]], inputs: list[str]) -> str:
    """Nested selects, one per layer; weights[layer][input][unit] as SQL expressions."""
    view, cols = source, inputs
    for depth, (w, b) in enumerate(zip(weights[:-1], biases[:-1])):
        units = [f"greatest({' + '.join(f'{c} * {w[i][j]}' for i, c in enumerate(cols))} + {b[j]}, 0) AS h{depth}_{j}" for j in range(len(b))]
        view = f"(SELECT *, {', '.join(units)} FROM {view})"
        cols = [f"h{depth}_{j}" for j in range(len(b))]
    z = " + ".join(f"{c} * {weights[-1][i][0]}" for i, c in enumerate(cols)) + f" + {biases[-1][0]}"
    return f"(SELECT *, {fx.sigmoid('(' + z + ')')} AS p1 FROM {view})"


def _literal_net() -> tuple[list, list]:
    stack = net.layers(np.asarray(NET_PARAMS), NET)
    return [[[fx.lit(v) for v in row] for row in w] for w, _ in stack], [[fx.lit(v) for v in b] for _, b in stack]


def _hashed_net() -> tuple[list, list]:
    weights, i = [], 0
    for a, b in zip(NET, NET[1:]):
        layer = []
        for _ in range(a):
            layer.append([])
            for _ in range(b):
                layer[-1].append(f"(sqrt({fx.lit(2.0 / a)}) * {fx.gaussian(fx.md5(fx.SEED, "'init'", i))})")
                i += 1
        weights.append(layer)
    return weights, [["0"] * b for b in NET[1:]]


ROUND0 = net_sql("feat", *_hashed_net(), COLS)


# Initial weights come from hashes in both engines; the query is the untrained model's round-0 evaluation.
@query("d1_init_params", f"""WITH {fx.FEAT}, pr AS (SELECT *, CAST(p1 >= 0.5 AS INTEGER) AS y_pred FROM {ROUND0})
    SELECT {EVAL} FROM pr""")
def init_params(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(train.client_evaluate(fx.features(spark, sf), net.init_params(NET, fx.SEED), NET, FEATURES))


@query("d3_mlp_score", f"WITH {fx.FEAT} SELECT {K}, {r('p1')}, {r('1 - p1', 'p0')} FROM {net_sql('feat', *_literal_net(), COLS)}")
def mlp_score(spark: SparkSession, sf: str) -> DataFrame:
    out = net.score(fx.features(spark, sf), NET_PARAMS, NET, FEATURES)
    return rounded(out.select(*KEYS, "p1", (F.lit(1.0) - F.col("p1")).alias("p0")))


WIDE_NET = (6, 64, 32, 1)


def _literal_stack(sizes: tuple[int, ...]) -> tuple[list, list]:
    stack = net.layers(np.asarray(net.init_params(sizes, fx.SEED)), sizes)
    return [[[fx.lit(v) for v in row] for row in w] for w, _ in stack], [[fx.lit(v) for v in b] for _, b in stack]


@query("d3b_wide_net_score", f"WITH {fx.FEAT} SELECT {K}, {r('p1')} FROM {net_sql('feat', *_literal_stack(WIDE_NET), COLS)}")
def wide_score(spark: SparkSession, sf: str) -> DataFrame:
    """Past the unrolling limit: Arrow batches."""
    out = net.score(fx.features(spark, sf), net.init_params(WIDE_NET, fx.SEED), WIDE_NET, FEATURES)
    return rounded(out.select(*KEYS, "p1"))


# A row with a null or NaN feature has no probability, class or confidence, and is no example of a gradient.
@query("d3c_missing_features", f"""WITH {SCORED} SELECT {K}, CASE WHEN k1 % 7 > 1 THEN {r('p1').rsplit(' AS ', 1)[0]} END AS p1,
    CASE WHEN k1 % 7 > 1 THEN y_pred ELSE -1 END AS y_pred, k1 % 7 < 2 AS no_logistic, k1 % 7 < 2 AS no_narrow, k1 % 7 < 2 AS no_wide, k1 % 7 < 2 AS no_gradient FROM pr""")
def missing_features(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.expr(f"CASE WHEN k1 % 7 = 0 THEN NULL WHEN k1 % 7 = 1 THEN double('NaN') ELSE `{FEATURES[0]}` END")
    rows = fx.features(spark, sf).withColumn(FEATURES[0], gap)
    out = net.predict(net.score(rows, LOGIT, (6, 1), FEATURES))
    out = net.score(out, NET_PARAMS, NET, FEATURES, "narrow")
    out = net.score(out, net.init_params(WIDE_NET, fx.SEED), WIDE_NET, FEATURES, "wide")
    out = gradients.logistic_gradients(out, LOGIT, FEATURES)
    none = {"no_logistic": "p1", "no_narrow": "narrow", "no_wide": "wide", "no_gradient": "g0"}
    return rounded(out.select(*KEYS, "p1", F.coalesce("y_pred", F.lit(-1)).alias("y_pred"), *[F.isnull(c).alias(n) for n, c in none.items()]))


@query("d4_predict", f"WITH {SCORED} SELECT {K}, y_pred, {r('confidence')} FROM pr")
def predict(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(spark, sf).select(*KEYS, "y_pred", "confidence"))


@query("d5_log_loss", f"WITH {SCORED} SELECT client_id, {LOSS} FROM pr GROUP BY client_id")
def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    out = scored(spark, sf).groupBy("client_id").agg(F.avg(net.row_log_loss("p1", "target")).alias("loss"))
    return rounded(out)


POS_WEIGHT = 3.0


def gradient_view(params: list[str], source: str = "feat", name: str = "gr", weight: float = 0.0) -> str:
    z = "(" + " + ".join([f"{c} * {w}" for c, w in zip(COLS, params)] + [params[-1]]) + ")"
    q = f"least(greatest(p1, {fx.lit(1e-7)}), {fx.lit(1 - 1e-7)})"
    err = f"({q} * ({fx.lit(weight)} * target + 1 - target) - {fx.lit(weight)} * target)" if weight not in (0.0, 1.0) else f"({q} - target)"
    grads = ", ".join([f"e * {c} AS g{i}" for i, c in enumerate(COLS)] + [f"e AS g{P - 1}"])
    return f"{name} AS (SELECT *, {grads} FROM (SELECT *, {err} AS e FROM (SELECT *, {fx.sigmoid(z)} AS p1 FROM {source})))"


LITERALS = [fx.lit(v) for v in LOGIT]


@query("d6_logistic_gradients", f"WITH {fx.FEAT}, {gradient_view(LITERALS, weight=POS_WEIGHT)} SELECT {K}, {', '.join(r(g) for g in GRADS)} FROM gr")
def logistic_gradients(spark: SparkSession, sf: str) -> DataFrame:
    out = gradients.logistic_gradients(fx.features(spark, sf), LOGIT, FEATURES, pos_weight=POS_WEIGHT)
    return rounded(out.select(*KEYS, *GRADS))


def clipped_view(source: str = "gr", name: str = "cl", clip: float = CLIP) -> str:
    norm = "sqrt(" + " + ".join(f"{g} * {g}" for g in GRADS) + ")"
    factor = f"least({fx.lit(1)}, {fx.lit(clip)} / greatest({norm}, {fx.lit(1e-12)}))"
    sums = ", ".join(f"sum({g} * f) AS {g}" for g in GRADS)
    return f"{name} AS (SELECT client_id, count(*) AS n_examples, {sums} FROM (SELECT *, {factor} AS f FROM {source}) GROUP BY client_id)"


GRAD = f"{fx.FEAT}, {gradient_view(LITERALS)}, {clipped_view()}"
SUM_COLS = f"client_id, n_examples, {', '.join(r(g, g, 4) for g in GRADS)}"


def clipped(spark: SparkSession, sf: str) -> DataFrame:
    rows = gradients.logistic_gradients(fx.features(spark, sf), LOGIT, FEATURES)
    return gradients.clipped_sums(rows, GRADS, CLIP, ["client_id"])


@query("d7_clipped_gradient_sum", f"WITH {GRAD} SELECT {SUM_COLS} FROM cl")
def clipped_sum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clipped(spark, sf), 4)


NOISED = ", ".join(
    f"{g} + {fx.lit(CLIP * SIGMA)} * {fx.gaussian(fx.md5(fx.SEED, "'noise'", 1, 'client_id', 0, i))} AS {g}"
    for i, g in enumerate(GRADS)
)


@query("d8_noised_gradient_sum", f"WITH {GRAD}, nz AS (SELECT client_id, n_examples, {NOISED} FROM cl) SELECT {SUM_COLS} FROM nz")
def noised_sum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gradients.add_noise(clipped(spark, sf), GRADS, CLIP, SIGMA, fx.SEED, 1), 4)


@query("d9_client_mean_gradient", f"""WITH {GRAD}, nz AS (SELECT client_id, n_examples, {NOISED} FROM cl)
    SELECT client_id, n_examples, {', '.join(r(f'{g} / n_examples', g) for g in GRADS)} FROM nz""")
def client_mean_gradient(spark: SparkSession, sf: str) -> DataFrame:
    noised = gradients.add_noise(clipped(spark, sf), GRADS, CLIP, SIGMA, fx.SEED, 1)
    return rounded(gradients.mean_gradient(noised, GRADS))


@query("d9b_net_gradient_sums", f"""WITH {fx.FEAT}, {gradient_view(LITERALS)}, {clipped_view()}
    {' UNION ALL '.join(f"SELECT client_id, {i} AS idx, {r(g, 'g', 4)}, n_examples FROM cl" for i, g in enumerate(GRADS))}""")
def net_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The batch gradient of any net, checked on the layout that SQL can follow."""
    return rounded(gradients.net_gradient_sums(fx.features(spark, sf), LOGIT, (6, 1), FEATURES, clip=CLIP), 4)


USUAL = train.TrainConfig(seed=fx.SEED)  # hidden layers (64, 32), ten rounds of ten epochs, batches of 64


@query("d10_fedavg_local_train")
def local_train(spark: SparkSession, sf: str) -> DataFrame:
    """One FedAvg round: every client's local training, and beside each update ``mean_params``, the new model averaged by examples."""
    rows = train.layout_clients(fx.features(spark, sf), FEATURES, "target", KEYS, "client_id", USUAL)
    start = net.init_params(USUAL.sizes(FEATURES), USUAL.seed)
    updates = cut_lineage(train.local_updates(rows, start, FEATURES, "target", "client_id", USUAL, 1), "updates")  # trained once, read twice
    rows.unpersist()
    mean = train.mean_update(updates, len(start), USUAL)
    return updates.crossJoin(F.broadcast(local_table(spark, [(mean,)], "mean_params array<double>")))


@query("d10b_adam_step", f"""WITH {GRAD} SELECT client_id,
    {', '.join(r(f'{fx.lit(t)} - {fx.lit(LR)} * (g{i} / n_examples) / (abs(g{i} / n_examples) + {fx.lit(1e-8)})', f't{i}') for i, t in enumerate(LOGIT))} FROM cl""")
def adam_step(spark: SparkSession, sf: str) -> DataFrame:
    means = gradients.mean_gradient(clipped(spark, sf), GRADS)
    steps = [gradients.adam_first_step(t, F.col(f"g{i}"), LR).alias(f"t{i}") for i, t in enumerate(LOGIT)]
    return rounded(means.select("client_id", *steps))


LOCAL = train.TrainConfig(hidden=(), local_epochs=2, batch_size=1 << 30, learning_rate=LR, seed=fx.SEED)


def _adam_sql(n: int, theta: list[str], moments: str) -> str:
    """Step ``n`` of every client from its mean gradient ``a0..``: moments, then parameters ``t0..``."""
    b1, b2, eps = (fx.lit(v) for v in train.ADAM)
    old = [(f"{fx.lit(0)}", f"{fx.lit(0)}")] * P if n == 1 else [(f"m{i}", f"v{i}") for i in range(P)]
    moved = ", ".join(f"{b1} * {m} + (1 - {b1}) * a{i} AS nm{i}, {b2} * {v} + (1 - {b2}) * a{i} * a{i} AS nv{i}" for i, (m, v) in enumerate(old))
    step = ", ".join(
        f"{theta[i]} - {fx.lit(LR)} * (nm{i} / (1 - {b1} ** {n})) / (sqrt(nv{i} / (1 - {b2} ** {n})) + {eps}) AS t{i}, nm{i} AS m{i}, nv{i} AS v{i}" for i in range(P))
    return f"(SELECT client_id, n_examples, {step} FROM (SELECT *, {moved} FROM {moments}))"


def _local_sql() -> str:
    """Two full-batch steps of every client, unrolled."""
    def mean(n: int) -> str:
        keep = "" if n == 1 else ", " + ", ".join(f"any_value({c}{i}) AS {c}{i}" for c in "tmv" for i in range(P))
        return f"mg{n} AS (SELECT client_id, count(*) AS n_examples, {', '.join(f'avg(g{i}) AS a{i}' for i in range(P))}{keep} FROM gr{n} GROUP BY client_id)"

    second = "(SELECT feat.*, " + ", ".join(f"s1.{c}{i}" for c in "tmv" for i in range(P)) + " FROM feat JOIN s1 ON feat.client_id = s1.client_id)"
    names = [f"t{i}" for i in range(P)]
    return f"""{fx.FEAT}, {gradient_view(START_SQL, name='gr1')}, {mean(1)}, s1 AS {_adam_sql(1, START_SQL, 'mg1')},
      {gradient_view(names, second, 'gr2')}, {mean(2)}, s2 AS {_adam_sql(2, names, 'mg2')}"""


START_SQL = [fx.lit(v) for v in net.init_params((6, 1), fx.SEED)]


TWO_LOCAL_STEPS = f"""WITH {_local_sql()} {' UNION ALL '.join(f"SELECT client_id, n_examples, {i} AS idx, {r(f't{i}', 'value')} FROM s2" for i in range(P))}"""


@query("d10c_two_local_steps", TWO_LOCAL_STEPS)
def two_local_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The training that rounds call, on the layout that SQL can follow: two Adam steps over all rows of a client."""
    rows = train.layout_clients(fx.features(spark, sf), FEATURES, "target", KEYS, "client_id", LOCAL)
    start = net.init_params((6, 1), fx.SEED)
    out = train.local_updates(rows, start, FEATURES, "target", "client_id", LOCAL, 1)
    return rounded(out.select("client_id", "n_examples", F.posexplode("params").alias("idx", "value")))


@query("d10d_sliced_local_steps", TWO_LOCAL_STEPS)
def sliced_local_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The same two steps with every client dealt over five groups and its optimiser state in a table."""
    cfg = train.replace(LOCAL, local_steps=1, slices=5)
    out = synchronous.client_steps(fx.features(spark, sf), net.init_params((6, 1), fx.SEED), FEATURES, KEYS, "target", "client_id", cfg, 1)
    return rounded(out.select("client_id", "n_examples", F.posexplode("params").alias("idx", "value")))


@query("d12_client_evaluate", f"WITH {SCORED} SELECT client_id, {EVAL} FROM pr GROUP BY client_id")
def client_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(train.client_evaluate(fx.features(spark, sf), LOGIT, (6, 1), FEATURES, by=["client_id"]))


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, _ = fx.prepared(spark, sf)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


_RUNS: dict[tuple[str, str, str], train.FederatedRun] = {}


def trained_run(spark: SparkSession, sf: str, kind: str, held: tuple[DataFrame, DataFrame] | None = None) -> train.FederatedRun:
    """The ``central`` or the private ``federated`` run with the usual settings, trained once per application and table.

    ``held`` are the two :func:`sides`, if the caller has them already.
    """
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _RUNS:
        tr, te = held or sides(spark, sf)
        if kind == "central":
            _RUNS[key] = baselines.central_net(tr, te, FEATURES, KEYS, USUAL)
        else:
            _RUNS[key] = train.train_federated(tr, te, FEATURES, KEYS, train.replace(USUAL, dp_enabled=True))
    return _RUNS[key]


@query("d13_baseline_ann")
def baseline_ann(spark: SparkSession, sf: str) -> DataFrame:
    return trained_run(spark, sf, "central").round_table(spark)


def _central_sql(steps: int) -> str:
    """An epoch of ``steps`` logistic steps over the batches that row hashes make."""
    b1, b2, eps = (fx.lit(v) for v in train.ADAM)
    slot = f"{fx.word(fx.md5(fx.SEED, "'batch'", *KEYS))} % {steps}"
    views, before = [fx.FEAT, f"slotted AS (SELECT *, {slot} AS slot FROM feat)"], None
    for n, s in enumerate(synchronous.slot_order(steps, 0, fx.SEED), 1):
        names = START_SQL if before is None else [f"t{i}" for i in range(P)]
        batch = f"(SELECT * FROM slotted WHERE slot = {s})" if before is None else f"(SELECT slotted.*, {', '.join(f't{i}' for i in range(P))} FROM slotted CROSS JOIN {before} WHERE slot = {s})"
        views.append(gradient_view(names, batch, f"cg{n}"))
        old = ", ".join(f"{fx.lit(0)} AS om{i}, {fx.lit(0)} AS ov{i}, {names[i]} AS ot{i}" if before is None else f"m{i} AS om{i}, v{i} AS ov{i}, t{i} AS ot{i}" for i in range(P))
        source = f"(SELECT {', '.join(f'avg(g{i}) AS a{i}' for i in range(P))} FROM cg{n}) a CROSS JOIN (SELECT {old}{'' if before is None else f' FROM {before}'}) o"
        moved = ", ".join(f"{b1} * om{i} + (1 - {b1}) * a{i} AS m{i}, {b2} * ov{i} + (1 - {b2}) * a{i} * a{i} AS v{i}, ot{i}" for i in range(P))
        step = ", ".join(f"m{i}, v{i}, ot{i} - {fx.lit(LR)} * (m{i} / (1 - {b1} ** {n})) / (sqrt(v{i} / (1 - {b2} ** {n})) + {eps}) AS t{i}" for i in range(P))
        views.append(f"cs{n} AS (SELECT {step} FROM (SELECT {moved} FROM {source}))")
        before = f"cs{n}"
    return f"WITH {', '.join(views)} {' UNION ALL '.join(f"SELECT {i} AS idx, {r(f't{i}', 'value')} FROM {before}" for i in range(P))}"


@query("d13b_three_central_steps", _central_sql(3))
def three_central_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of the central net, on the layout that SQL can follow: gradients summed over tasks, batches by hash."""
    rows = fx.features(spark, sf)
    *_, params = synchronous.central_steps(rows, net.init_params((6, 1), fx.SEED), (6, 1), FEATURES, KEYS, "target", 1, 3, LR, fx.SEED)
    return rounded(local_table(spark, [(i, v) for i, v in enumerate(params)], "idx int, value double"))


@query("d14_baseline_rf")
def baseline_rf(spark: SparkSession, sf: str) -> DataFrame:
    return latest_models(spark, sf, "rf").select(*metrics.METRICS, "train_time_s")


@query("d15_baseline_svm")
def baseline_svm(spark: SparkSession, sf: str) -> DataFrame:
    return latest_models(spark, sf, "svm").select(*metrics.METRICS, "train_time_s")


N_MAPS = 8
GAMMA = 1.0 / 6.0
FREQ, PHASE = baselines.fourier_draws(6, N_MAPS, GAMMA, fx.SEED)


def _fourier_sql() -> str:
    out = []
    for k in range(N_MAPS):
        w = [f"{fx.lit((2.0 * GAMMA) ** 0.5)} * {fx.gaussian(fx.md5(fx.SEED, "'fourier'", k, j))}" for j in range(6)]
        phase = f"{fx.lit(2.0 * math.pi)} * {fx.uniform(fx.md5(fx.SEED, "'phase'", k))}"
        z = " + ".join(f"{c} * ({v})" for c, v in zip(COLS, w)) + f" + {phase}"
        out.append(r(f"{fx.lit((2.0 / N_MAPS) ** 0.5)} * cos({z})", f"f{k}"))
    return ", ".join(out)


@query("d15b_fourier_features", f"WITH {fx.FEAT} SELECT {K}, {_fourier_sql()} FROM feat")
def fourier(spark: SparkSession, sf: str) -> DataFrame:
    cols = baselines.fourier_features(FEATURES, FREQ, PHASE)
    return rounded(fx.features(spark, sf).select(*KEYS, *[c.alias(f"f{k}") for k, c in enumerate(cols)]))


_LOGS: dict[tuple[str, str], tuple[str, set[str]]] = {}


def model_log(spark: SparkSession, sf: str, *wanted: str) -> str:
    """An experiment log that holds the ``wanted`` baselines and the federated run, each trained once per application and table."""
    path, held = _LOGS.setdefault((spark.sparkContext.applicationId, sf), (scratch_path(spark, "model_log"), set()))
    for name in wanted:
        if name in held:
            continue
        if name == "federated":
            run = trained_run(spark, sf, "federated")
            last = run.rounds[-1]
            track.log_experiment(spark, path, "federated", "federated", {m: last[m] for m in metrics.METRICS},
                                 {"train_time_s": round(run.seconds, 2), "comm_mb": sum(x["comm_bytes"] for x in run.rounds) / report.MB})
        else:
            ann = trained_run(spark, sf, "central") if name == "ann" else None
            baselines.run_baselines(*sides(spark, sf), FEATURES, KEYS, USUAL, log=path, ann=ann, models=[name])
        held.add(name)
    return path


def latest_models(spark: SparkSession, sf: str, *wanted: str) -> DataFrame:
    """(model, mode, metrics..., train_time_s, comm_mb): the newest whole run of each of the ``wanted`` models, or of all."""
    wanted = wanted or (*baselines.MODELS, "federated")
    logged = track.latest_runs(track.read_log(spark, model_log(spark, sf, *wanted))).withColumnRenamed("name", "model")
    return logged.where(F.col("model").isin(*wanted))


@query("d16_baseline_comparison")
def baseline_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return latest_models(spark, sf, *baselines.MODELS).select("model", *metrics.METRICS, "train_time_s")


# --- federated runs --------------------------------------------------------------------------


@query("f9_global_evaluate", f"""WITH {fx.PREPARED}, {fx.scored('prep')}, pr AS (SELECT *, CAST(p1 >= 0.5 AS INTEGER) AS y_pred FROM sc WHERE split = 'test')
    SELECT {EVAL} FROM pr""")
def global_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = fx.prepared(spark, sf)
    return rounded(train.client_evaluate(rows.where("split = 'test'"), LOGIT, (6, 1), FEATURES))


@query("f10_federated_rounds")
def federated_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return trained_run(spark, sf, "federated").round_table(spark)


@query("f10c_masked_rounds")
def masked_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Uniform means of masked updates; the same run unmasked differs only by the fixed-point step."""
    tr, te = sides(spark, sf)
    return train.train_federated(tr, te, FEATURES, KEYS, train.replace(USUAL, secure_aggregation=True)).round_table(spark)


ROUND_LR = 2.0
SGD = train.TrainConfig(
    hidden=(), rounds=2, mode="fed_sgd", learning_rate=ROUND_LR, dp_enabled=True, clipping_norm=CLIP, noise_multiplier=0.0, seed=fx.SEED,
)


def sgd_round_sql(n: int, params: list[str]) -> str:
    """One full-batch round: clipped client means, averaged by rows, one step."""
    source = "feat" if n == 1 else f"(SELECT feat.*, {', '.join(f't{i}' for i in range(P))} FROM feat CROSS JOIN th{n - 1})"
    step = ", ".join(
        f"{fx.lit(0) if n == 1 else f'max(t{i})'} + {init} - {fx.lit(ROUND_LR)} * sum(g{i} / n_examples * n_examples) / sum(n_examples) AS t{i}"
        for i, init in enumerate(params)
    )
    clip_rows = f"cl{n}" if n == 1 else f"(SELECT * FROM cl{n} CROSS JOIN th{n - 1})"
    names = [f"t{i}" for i in range(P)] if n > 1 else params
    return f"{gradient_view(names, source, f'gr{n}')}, {clipped_view(f'gr{n}', f'cl{n}')}, th{n} AS (SELECT {step} FROM {clip_rows})"


START = [fx.lit(v) for v in net.init_params((6, 1), fx.SEED)]
TWO_ROUNDS = f"{fx.FEAT}, {sgd_round_sql(1, START)}, {sgd_round_sql(2, ['0'] * P)}"


TWO_ROUND_PARAMS = f"""WITH {TWO_ROUNDS}
    {' UNION ALL '.join([f"SELECT 0 AS round, {i} AS idx, {r(v, 'value')}" for i, v in enumerate(START)]
                        + [f"SELECT {n} AS round, {i} AS idx, {r(f't{i}', 'value')} FROM th{n}" for n in (1, 2) for i in range(P)])}"""


@query("f10b_two_gradient_rounds", TWO_ROUND_PARAMS)
def two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.features(spark, sf)
    run = train.train_federated(rows, rows, FEATURES, KEYS, SGD)
    return rounded(spark.read.schema("idx int, value double, round int").parquet(run.checkpoint_path))


@query("f10e_resumed_rounds", TWO_ROUND_PARAMS)
def resumed_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same two rounds by two runs over one folder: the second goes on after the first one's last round."""
    rows, folder = fx.features(spark, sf), scratch_path(spark, "resumed")
    train.train_federated(rows, rows, FEATURES, KEYS, train.replace(SGD, rounds=1), run_path=folder)
    run = train.train_federated(rows, rows, FEATURES, KEYS, SGD, run_path=folder)
    return rounded(spark.read.schema("idx int, value double, round int").parquet(run.checkpoint_path))


SECURE_SGD = train.replace(SGD, secure_aggregation=True)


def masked_sql(n: int, params: list[str]) -> str:
    """One round whose client means are rounded to the fixed-point step and averaged without weights."""
    source = "feat" if n == 1 else f"(SELECT feat.*, {', '.join(f't{i}' for i in range(P))} FROM feat CROSS JOIN th{n - 1})"
    scale = fx.lit(1 << 20)
    old = params if n == 1 else [f"max(t{i})" for i in range(P)]
    step = ", ".join(f"{old[i]} - {fx.lit(ROUND_LR)} * (sum(round(g{i} / n_examples * {scale})) / {scale} / count(*)) AS t{i}" for i in range(P))
    clip_rows = f"cl{n}" if n == 1 else f"(SELECT * FROM cl{n} CROSS JOIN th{n - 1})"
    names = [f"t{i}" for i in range(P)] if n > 1 else params
    return f"{gradient_view(names, source, f'gr{n}')}, {clipped_view(f'gr{n}', f'cl{n}')}, th{n} AS (SELECT {step} FROM {clip_rows})"


# The check never sees a mask: masked rounds must follow the plain fixed-point means.
@query("f10d_masked_gradient_rounds", f"""WITH {fx.FEAT}, {masked_sql(1, START)}, {masked_sql(2, START)}
    {' UNION ALL '.join(f"SELECT {n} AS round, {i} AS idx, {r(f't{i}', 'value')} FROM th{n}" for n in (1, 2) for i in range(P))}""")
def masked_gradient_rounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.features(spark, sf)
    run = train.train_federated(rows, rows, FEATURES, KEYS, SECURE_SGD)
    return rounded(spark.read.schema("idx int, value double, round int").parquet(run.checkpoint_path).where("round > 0"))


@query("a6_checkpoints", f"""WITH {fx.UPDATES}, m AS (SELECT round, idx, sum(value * n_examples) / sum(n_examples) AS value FROM updl GROUP BY round, idx)
    SELECT round, idx, {r('value')}, CAST(round = (SELECT max(round) FROM m) AS INTEGER) AS is_final FROM m""")
def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "checkpoints")
    tables.save_checkpoints(fedavg(fx.updates(spark, sf)), path)
    final = tables.load_checkpoint(spark, path).withColumn("is_final", F.lit(1))
    stored = spark.read.schema("idx int, value double, round int").parquet(path)
    marked = stored.join(F.broadcast(final.select("round", "is_final").distinct()), "round", "left")
    return rounded(marked.withColumn("is_final", F.coalesce("is_final", F.lit(0))))


# --- metrics ---------------------------------------------------------------------------------

CELLS = ", ".join(
    f"count(*) FILTER (WHERE {{y}} = {t} AND {{p}} = {q}) AS {n}" for n, (t, q) in metrics.CELLS.items()
)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, quality int, toxic int").parquet(f"{sf}/labels.parquet")


@query("g1_confusion", f"SELECT {CELLS.format(y='quality', p='toxic')} FROM labels")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(labelled(spark, sf), "quality", "toxic")


@query("g2_metrics", f"SELECT {fx.metrics_sql('quality', 'toxic')} FROM labels")
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.classification_metrics(labelled(spark, sf), "quality", "toxic"))


@query("g2b_metrics_by_client", f"""WITH {fx.PREPARED}, {fx.scored('prep')}, pr AS (SELECT *, CAST(p1 >= 0.5 AS INTEGER) AS y_pred FROM sc)
    SELECT client_id, split, count(*) AS n_rows, {r('avg(target)', 'failure_rate')}, {fx.metrics_sql()} FROM pr GROUP BY client_id, split""")
def metrics_by_client(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows to rules, exact split, scaling, scoring and metrics per client and side."""
    rows, _ = fx.prepared(spark, sf)
    pred = net.predict(net.score(rows, LOGIT, (6, 1), FEATURES))
    cells = metrics.confusion(pred, "target", "y_pred", ["client_id", "split"],
                              extra=[F.count("*").alias("n_rows"), F.avg("target").alias("failure_rate")])
    cols = [v.alias(n) for n, v in metrics.metric_columns().items()]
    return rounded(cells.select("client_id", "split", "n_rows", "failure_rate", *cols))


BY_SUPPLIER = f"cm AS (SELECT CAST(k4 AS INTEGER) AS round, k3 AS client_id, count(*) AS n_rows, {', '.join(f'{e} AS {n}' for n, e in fx.metric_select().items())} FROM pr GROUP BY 1, 2)"
WEIGHTED = ", ".join(r(f"sum({m} * n_rows) / sum(n_rows)", m) for m in metrics.METRICS)


def client_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """(round, client_id, n_rows, metrics): line numbers as rounds, suppliers as clients."""
    rows = scored(spark, sf).withColumns({"round": F.col("k4").cast("int"), "client_id": F.col("k3"), "y_true": F.col("target")})
    return metrics.evaluate(rows, by=["round", "client_id"])


@query("g3_weighted_metrics", f"WITH {SCORED}, {BY_SUPPLIER} SELECT {WEIGHTED} FROM cm")
def weighted_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.weighted_average_metrics(client_metrics(spark, sf), "n_rows"))


TEXT = "printf('accuracy=%.4f, precision=%.4f, recall=%.4f, f1=%.4f', accuracy, precision, recall, f1)"


@query("g4_metric_text", f"WITH {SCORED}, {BY_SUPPLIER} SELECT round, client_id, {TEXT} AS text FROM cm")
def metric_text(spark: SparkSession, sf: str) -> DataFrame:
    return client_metrics(spark, sf).select("round", "client_id", metrics.metric_text().alias("text"))
