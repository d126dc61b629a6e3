"""The network, its gradients and federated training."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silolens.functions import net
from silolens.operators import baselines, gradients, metrics, synchronous, train
from silolens.plans import fixtures as fx
from silolens.plans.fixtures import FEATURES, KEYS
from silolens.session import scratch_path

SIZES = (3, 4, 2, 1)
CFG = train.TrainConfig(hidden=(4,), rounds=2, local_epochs=2, batch_size=32)


def batch(n=40, d=3, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)), (rng.random(n) < 0.4).astype(float)


def theta(sizes=SIZES):
    return np.array(net.init_params(sizes, 5)) + 0.05


def loss(t, x, y, weight):
    p = np.clip(net.probabilities(t, SIZES, x), 1e-7, 1 - 1e-7)
    return float(-(weight * y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


@pytest.mark.parametrize("weight", [0.0, 3.0])
def test_gradient_against_finite_differences(weight):
    x, y = batch()
    t = theta()
    g = net.gradient_sum(t, SIZES, x, y, weight)
    for i in range(len(t)):
        step = np.zeros_like(t)
        step[i] = 1e-6
        numeric = (loss(t + step, x, y, weight or 1.0) - loss(t - step, x, y, weight or 1.0)) / 2e-6
        assert g[i] == pytest.approx(numeric, abs=1e-4)


def test_clipping_equals_row_by_row():
    x, y = batch()
    rows = np.array([net.gradient_sum(theta(), SIZES, x[i : i + 1], y[i : i + 1]) for i in range(len(x))])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    want = (rows * np.minimum(1.0, 0.3 / norms)).sum(axis=0)
    assert np.allclose(net.gradient_sum(theta(), SIZES, x, y, clip=0.3), want)


def test_column_score_equals_numpy(spark, monkeypatch):
    x, _ = batch()
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ["a", "b", "c"])
    want = net.probabilities(theta(), SIZES, x)
    unrolled = [r["p1"] for r in net.score(df, theta(), SIZES, ["a", "b", "c"]).collect()]
    monkeypatch.setattr(net, "UNROLL_LIMIT", 0)
    batches = [r["p1"] for r in net.score(df, theta(), SIZES, ["a", "b", "c"]).collect()]
    assert np.allclose(unrolled, want) and np.allclose(batches, want)


def test_parameter_count_and_shape_check(spark):
    assert net.n_params((7, 64, 32, 1)) == 2625
    with pytest.raises(ValueError, match="parameters"):
        net.check_params([0.0] * 5, (3, 1))
    with pytest.raises(ValueError, match="features"):
        net.score(spark.range(1), [0.0] * 4, (3, 1), ["id"])


def test_empty_cells_and_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y_true int, y_pred int")
    assert metrics.confusion(df).first().asDict() == {"tn": 1, "fp": 0, "fn": 1, "tp": 0}
    assert metrics.classification_metrics(df, prefix="m_").first().asDict() == {"m_accuracy": 0.5, "m_precision": 0.0, "m_recall": 0.0, "m_f1": 0.0}
    with pytest.raises(Exception, match="total weight"):
        metrics.weighted_average_metrics(spark.createDataFrame([(0, 1.0)], "w int, m double"), "w", ("m",)).collect()


def test_noise_scales(spark):
    one = spark.createDataFrame([(1, 4, 0.0)], "client_id int, n_examples bigint, g0 double")
    a = gradients.add_noise(one, ["g0"], 1.0, 2.0, 7, 1).first()["g0"]
    b = gradients.add_noise(one, ["g0"], 1.0, 2.0, 7, 1, scale="as_coded").first()["g0"]
    assert a == pytest.approx(4 * b)
    with pytest.raises(ValueError, match="noise scale"):
        gradients.add_noise(one, ["g0"], 1.0, 2.0, 7, 1, scale="other")


@pytest.fixture(scope="module")
def rows(spark, sf):
    return fx.features(spark, sf).persist()


def run(rows, cfg, test=None):
    return train.train_federated(rows, test if test is not None else rows, FEATURES, KEYS, cfg)


def test_partitioning_does_not_change_training(rows):
    a, b = run(rows.repartition(1), CFG), run(rows.repartition(13), CFG)
    assert np.allclose(a.params, b.params, atol=1e-12)


def test_one_client_equals_local_training(rows):
    cfg = replace(CFG, rounds=1)
    one = rows.withColumn("client_id", F.lit(0))
    got = run(one, cfg).params
    laid = train.layout_clients(one, FEATURES, "target", KEYS, "client_id", cfg)
    alone = train.local_updates(laid, net.init_params(cfg.sizes(FEATURES), cfg.seed), FEATURES, "target", "client_id", cfg, 1).collect()
    laid.unpersist()
    assert len(alone) == 1 and np.allclose(got, alone[0]["params"])


def test_zero_noise_with_a_huge_clip_is_plain_training(rows):
    plain = run(rows, CFG).params
    private = run(rows, replace(CFG, dp_enabled=True, noise_multiplier=0.0, clipping_norm=1e9)).params
    assert np.allclose(plain, private, atol=1e-9)


def test_noise_is_repeatable_and_changes_with_the_round(rows):
    cfg = replace(CFG, dp_enabled=True)
    assert np.allclose(run(rows, cfg).params, run(rows, cfg).params)


def test_masked_rounds_equal_uniform_ones(rows):
    masked = run(rows, replace(CFG, secure_aggregation=True)).params
    plain = run(rows, replace(CFG, weighted=False)).params
    assert np.allclose(masked, plain, atol=1e-4)


@pytest.mark.parametrize("dp", [False, True])
def test_slices_do_not_change_training(rows, dp):
    """A client in one group and the same client dealt over groups, its optimiser state in a table, take the same steps."""
    cfg = replace(CFG, rounds=2, local_epochs=2, local_steps=3, dp_enabled=dp, noise_multiplier=0.3)
    whole = run(rows, cfg)
    for slices in (2, 7):
        dealt = run(rows.repartition(5), replace(cfg, slices=slices))
        assert np.abs(np.array(whole.params) - dealt.params).max() < 1e-9
        for a, b in zip(whole.rounds, dealt.rounds):
            assert {k: a[k] for k in ("n_clients", "comm_bytes", "n_rows")} == {k: b[k] for k in ("n_clients", "comm_bytes", "n_rows")}
            assert a["fit_loss"] == pytest.approx(b["fit_loss"], abs=1e-9)


def test_slices_need_batches_by_hash(rows):
    with pytest.raises(ValueError, match="local_steps"):
        run(rows, replace(CFG, slices=2))


def test_batches_without_examples_are_no_steps(spark):
    names = ["a"]
    table = spark.createDataFrame([(i, 0, float(i), i % 2) for i in range(6)] + [(9, 1, None, 1)], "id int, client_id int, a double, target int")
    cfg = replace(CFG, hidden=(), rounds=1, local_epochs=2, local_steps=8)
    whole = train.train_federated(table, table, names, ["id"], cfg)
    dealt = train.train_federated(table, table, names, ["id"], replace(cfg, slices=3))
    assert np.allclose(whole.params, dealt.params, atol=1e-12)
    ups = spark.read.parquet(f"{dealt.updates_path}/r1").orderBy("client_id").collect()
    assert [u.n_examples for u in ups] == [6, 0] and ups[1].params == net.init_params((1, 1), cfg.seed)


def test_central_steps_do_not_depend_on_partitions(rows, monkeypatch):
    def trained(n):
        start = net.init_params((6, 5, 1), 3)
        *_, last = synchronous.central_steps(rows.repartition(n), start, (6, 5, 1), FEATURES, KEYS, "target", 2, 3, 0.05, 7)
        return np.array(last)

    one = trained(1)
    assert np.abs(one - trained(4)).max() < 1e-9
    monkeypatch.setattr(synchronous, "DRIVER_SUMS", 3)  # sums of many tasks are added up in groups
    assert np.abs(one - trained(64)).max() < 1e-9


def test_central_steps_equal_one_group(spark, rows):
    """The whole table as one client with the same batches."""
    cfg = replace(CFG, rounds=1, local_epochs=2, local_steps=4)
    group = run(rows.withColumn("client_id", F.lit(0)), cfg).params
    *_, params = synchronous.central_steps(rows, net.init_params(cfg.sizes(FEATURES), cfg.seed), cfg.sizes(FEATURES), FEATURES, KEYS, "target", 2, 4, cfg.learning_rate, cfg.seed)
    assert np.abs(np.array(group) - params).max() < 1e-9


@pytest.mark.parametrize("mode", ["fedavg", "fed_sgd"])
def test_broken_run_goes_on_after_its_last_whole_round(spark, rows, monkeypatch, mode):
    cfg = replace(CFG, rounds=4, local_epochs=1, dp_enabled=True, noise_multiplier=0.2, mode=mode, client_fraction=0.6)
    whole = run(rows, cfg)
    folder = scratch_path(spark, "broken")
    commit = train._commit_round

    def breaks(spark_, path, record, settings):
        if record["round"] == 3:
            raise RuntimeError("lost")
        commit(spark_, path, record, settings)

    monkeypatch.setattr(train, "_commit_round", breaks)
    with pytest.raises(RuntimeError):
        train.train_federated(rows, rows, FEATURES, KEYS, cfg, run_path=folder)
    assert sorted(train.committed_rounds(spark, folder)) == [0, 1, 2]  # round 3 left parameters, but no mark
    monkeypatch.undo()
    again = train.train_federated(rows, rows, FEATURES, KEYS, cfg, run_path=folder)
    assert np.allclose(whole.params, again.params, atol=1e-12)
    assert [r["f1"] for r in again.rounds] == pytest.approx([r["f1"] for r in whole.rounds])
    done = train.train_federated(rows, rows, FEATURES, KEYS, cfg, run_path=folder)
    assert done.rounds == again.rounds and done.params == again.params
    with pytest.raises(ValueError, match="other settings"):
        train.train_federated(rows, rows, FEATURES, KEYS, replace(cfg, learning_rate=0.5), run_path=folder)


def test_rounds_are_laid_out_once(rows):
    laid = train.layout_clients(rows, FEATURES, "target", KEYS, "client_id", CFG)
    laid.count()
    plan = train.local_updates(laid, net.init_params(CFG.sizes(FEATURES), 1), FEATURES, "target", "client_id", CFG, 1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    laid.unpersist()
    assert "Exchange" not in text.split("InMemoryRelation")[0] and "Sort" not in text.split("InMemoryTableScan")[0]


def test_round_zero_checkpoint_and_summary(spark, rows):
    got = run(rows, CFG)
    assert train.load_params(spark, got.checkpoint_path, 0) == net.init_params(got.sizes, CFG.seed)
    assert train.load_params(spark, got.checkpoint_path) == pytest.approx(got.params)
    assert [r["round"] for r in got.rounds] == [0, 1, 2]
    assert got.round_table(spark).where("comm_bytes > 0").count() == 2


def test_client_fraction_samples_participants(rows):
    got = run(rows, replace(CFG, client_fraction=0.4))
    assert [r["n_clients"] for r in got.rounds] == [0, 2, 2]


def test_gradient_mode_agrees_between_engines(spark, rows):
    long = {(r["client_id"], r["idx"]): r["g"] for r in gradients.net_gradient_sums(rows, fx.LOGIT, (6, 1), FEATURES, clip=0.5).collect()}
    cols = [f"g{i}" for i in range(7)]
    wide = gradients.clipped_sums(gradients.logistic_gradients(rows, fx.LOGIT, FEATURES), cols, 0.5, ["client_id"]).collect()
    for r in wide:
        assert [long[r["client_id"], i] for i in range(7)] == pytest.approx([r[c] for c in cols])


def test_gradient_mode_trains_a_net(rows):
    got = run(rows, replace(CFG, mode="fed_sgd", learning_rate=0.5, rounds=4))
    assert got.rounds[-1]["loss"] < got.rounds[0]["loss"]
    assert got.rounds[1]["n_clients"] == 5


def test_held_vectors_are_flushed(rows, monkeypatch):
    monkeypatch.setattr(gradients, "HELD_BYTES", 8 * 7)
    got = gradients.net_gradient_sums(rows, fx.LOGIT, (6, 1), FEATURES)
    assert got.count() == 35
    assert got.where("idx = 0").agg(F.sum("n_examples")).first()[0] == rows.count()


def test_central_net_learns(rows):
    got = baselines.central_net(rows, rows, FEATURES, KEYS, replace(CFG, hidden=(16, 8)), epochs=10, steps=64)
    assert got.rounds[-1]["accuracy"] >= 0.97


def test_forest_and_svm_learn_the_rules(rows):
    forest = metrics.evaluate(baselines.forest(rows, rows, FEATURES, trees=10, max_depth=12)).first()
    assert forest["f1"] > 0.9
    svm = metrics.evaluate(baselines.rbf_svm(rows, rows, FEATURES, n_maps=60, max_iter=30)).first()
    assert svm["accuracy"] > 0.95 and svm["loss"] < 0.3


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    rows = spark.range(100).withColumn("of", (F.col("id") % 5).cast("int"))
    fit = lambda df: {r.id for r in df.collect()}
    seen = {}

    def apply(model, df):
        seen.update({r.id: model for r in df.collect()})
        return df

    out, whole = baselines.cross_fitted(rows, F.col("of"), 5, fit, apply)
    assert len(whole) == 100
    assert out.count() == 100 and all(i not in model and len(model) == 80 for i, model in seen.items()) and len(seen) == 100


def test_fourier_features_approach_the_kernel():
    x, _ = batch(6)
    w, b = baselines.fourier_draws(3, 4000, 0.5, 3)
    z = np.sqrt(2.0 / len(b)) * np.cos(x @ w.T + b)
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_large_client_is_mapped_and_kept_in_order(monkeypatch):
    """Past ``HELD_ROWS`` the same examples in the same order, from a file; no client of some millions of rows is refused."""
    assert train.GROUP_ROWS > 36_000_000 // 5
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"a": rng.random(50), "b": rng.random(50), "y": rng.integers(0, 2, 50), "slot": rng.integers(0, 3, 50), "_order": rng.permutation(50)})
    table.loc[7, "b"] = np.nan
    want = table.drop(7).sort_values("_order")
    for bound in (100, 10):
        monkeypatch.setattr(train, "HELD_ROWS", bound)
        for rows in (table, table.sort_values("_order")):
            held, slots = train.held_rows(iter([rows[:20], rows[20:20], rows[20:]]), ["a", "b"], "y", True)
            assert np.array_equal(held, want[["a", "b", "y"]].to_numpy()) and np.array_equal(slots, want["slot"])


def test_batches_are_blocks_of_bounded_size(rows):
    """A step moves buffers of some thousand rows; none is lost and none grows with the table."""
    tagged = rows.crossJoin(rows.sparkSession.range(20).withColumnRenamed("id", "copy")).withColumns({"slice": F.lit(0), "slot": F.lit(0)})
    (held,) = synchronous._batches(tagged, 1, "bounded", FEATURES, "target", ["client_id"])
    sizes = [len(r.block) // 8 // (len(FEATURES) + 1) for r in held.collect()]
    held.unpersist()
    assert sum(sizes) == tagged.count() and max(sizes) <= synchronous.BLOCK_ROWS


@pytest.mark.parametrize("clip", [None, 0.3])
@pytest.mark.parametrize("sizes", [SIZES, (6, 1), (6, 64, 32, 1)])
def test_held_arrays_give_the_same_gradient(sizes, clip):
    rng = np.random.default_rng(4)
    start = np.array(net.init_params(sizes, 3))
    model = net.HeldNet(start, sizes, 64)
    for n in (64, 7, 64, 0):
        x, y = rng.normal(size=(n, sizes[0])), (rng.random(n) < 0.4).astype(float)
        assert np.allclose(model.probabilities(x), net.probabilities(start, sizes, x), rtol=1e-12)
        assert np.allclose(model.gradient(x, y, 2.0, clip), net.gradient_sum(start, sizes, x, y, 2.0, clip), rtol=1e-10, atol=1e-13)


def test_steps_on_held_parameters_leave_what_is_not_a_parameter():
    """The ones and zeros beside the parameters have no gradient; ``scale`` scales, privacy's share included."""
    rng = np.random.default_rng(5)
    sizes = (6, 7, 3, 1)
    start = np.array(net.init_params(sizes, 3)) + 0.1
    model = net.HeldNet(start, sizes, 20)
    x, y = rng.normal(size=(20, 6)), (rng.random(20) < 0.4).astype(float)
    rest = np.setdiff1d(np.arange(len(model.held)), model.at)
    for clip in (None, 0.3):
        g = model.gradient_of(model.inputs_of(x), y, 0.0, clip, 0.05)
        assert not g[rest].any() and np.allclose(g[model.at], 0.05 * net.gradient_sum(start, sizes, x, y, 0.0, clip), rtol=1e-10, atol=1e-13)
    assert np.array_equal(model.theta, start)


@pytest.mark.parametrize("scale", ["documented", "as_coded"])
def test_noise_drawn_ahead_is_the_noise_of_the_steps(monkeypatch, scale):
    """Blocks made by a thread give each step's noise, for the mean of a batch, at the places of the parameters."""
    cfg = replace(CFG, dp_enabled=True, noise_multiplier=0.7, noise_scale=scale)
    monkeypatch.setattr(synchronous, "AHEAD_BYTES", 8 * 9 * 3)
    ahead, steps = synchronous.drawn_ahead(synchronous.noise_blocks(np.array([1, 2, 5, 7]), 9, 8, cfg, 1, 2)), synchronous.step_noise(4, cfg, 1, 2)
    for _ in range(20):
        want, got = next(steps) / (8 if scale == "documented" else 64), next(ahead)
        assert np.allclose(got[[1, 2, 5, 7]], want) and not got[[0, 3, 4, 6, 8]].any()
    ahead.close()


@pytest.mark.parametrize("scale", ["documented", "as_coded"])
def test_gathered_steps_equal_single_ones(monkeypatch, scale):
    """Whatever number of steps is gathered at once, a client trains as by one gradient, one noise and one Adam step after the other."""
    rng = np.random.default_rng(6)
    held = np.column_stack([rng.normal(size=(50, 3)), rng.random(50) < 0.4])
    cfg = train.TrainConfig(hidden=(5,), local_epochs=3, batch_size=8, dp_enabled=True, noise_multiplier=0.5, noise_scale=scale)
    sizes, stream = (3, 5, 1), (1, 1, 0)
    start = np.array(net.init_params(sizes, 1))
    theta, m, v, step, losses = start, 0.0 * start, 0.0 * start, 0, []
    order, noise = np.random.default_rng(train.stream_seed("order", *stream)), train.step_noise(len(start), cfg, *stream)
    for epoch in range(3):
        drawn, losses = order.permutation(50), []
        for at in range(0, 50, 8):
            x, y = held[drawn[at : at + 8], :-1], held[drawn[at : at + 8], -1]
            step += 1
            g = net.gradient_sum(theta, sizes, x, y, 0.0, 1.0) + next(noise) / (1 if scale == "documented" else len(x))
            theta, m, v = synchronous.adam_step(theta, m, v, g / len(x), step, cfg.learning_rate)
            losses.append(net.mean_log_loss(net.probabilities(theta, sizes, x), y))
    for ahead in (1, 3, 64):
        monkeypatch.setattr(train, "STEPS_AHEAD", ahead)
        got, loss = train.adam_epochs(start, sizes, held, cfg, stream)
        assert np.allclose(got, theta, atol=1e-9) and loss == pytest.approx(np.mean(losses))
    none, loss = train.adam_epochs(start, sizes, held[:0], cfg, stream)
    assert np.array_equal(none, start) and np.isnan(loss)


def test_clients_of_one_batch_are_not_ordered(rows):
    """Two full steps give the same with and without an order; none is hashed or sorted."""
    cfg = replace(CFG, hidden=(), local_epochs=2, batch_size=1 << 30)
    laid = train.layout_clients(rows, FEATURES, "target", KEYS, "client_id", cfg)
    plan = laid._jdf.queryExecution().analyzed().toString()
    assert "md5" not in plan
    start = net.init_params((6, 1), 3)
    got = {r["client_id"]: r for r in train.local_updates(laid, start, FEATURES, "target", "client_id", cfg, 1).collect()}
    laid.unpersist()
    for k, r in got.items():
        held = np.array([tuple(x) for x in rows.where(F.col("client_id") == k).select(*FEATURES, "target").collect()], dtype=float)
        theta, m, v = np.array(start), np.zeros(7), np.zeros(7)
        for step in (1, 2):
            theta, m, v = synchronous.adam_step(theta, m, v, net.gradient_sum(theta, (6, 1), held[:, :-1], held[:, -1]) / len(held), step, cfg.learning_rate)
        assert r["n_examples"] == len(held) and np.allclose(r["params"], theta, atol=1e-12)


def test_a_step_of_the_central_net_uses_all_cores(spark, rows):
    """A slot's blocks lie in as many partitions as there are cores, however few files hold them."""
    cores = spark.sparkContext.defaultParallelism
    tagged = rows.crossJoin(spark.range(20 * cores).withColumnRenamed("id", "copy")).withColumns({"slice": F.lit(0), "slot": F.lit(0)})
    (held,) = synchronous._batches(tagged.coalesce(1), 1, "spread", FEATURES, "target")
    parts = held.groupBy(F.spark_partition_id().alias("p")).count().collect()
    held.unpersist()
    assert len(parts) == cores


def test_svm_passes_read_blocks(spark):
    """A pass moves buffers: the numbers of some thousand rows with their labels and folds."""
    table = spark.createDataFrame([(0.5 * i, -float(i), float(i % 2), i % 3) for i in range(50)], "a double, b double, t double, _of int").coalesce(1)
    (got,) = baselines._blocks(table, ["a", "b"], "t", "_of").collect()
    x = np.frombuffer(got["block"], np.float64, 100).reshape(50, 2)
    codes = np.frombuffer(got["block"], np.int16, offset=x.nbytes).reshape(50, 2)
    assert got["n"] == 50 and np.array_equal(x[:, 0] * -2, x[:, 1]) and np.array_equal(codes[:, 0], np.arange(50) % 2) and np.array_equal(codes[:, 1], np.arange(50) % 3)


def test_few_clients_lie_apart(spark):
    """Two clients that meet in a partition are trained one after the other."""
    table = spark.range(500).selectExpr("id", "cast(id % 5 as int) AS client_id", "cast(id as double) AS x", "0D AS target")
    laid = train.layout_clients(table, ["x"], "target", ["id"], "client_id", train.TrainConfig())
    met = laid.groupBy(F.spark_partition_id().alias("part")).agg(F.countDistinct("client_id").alias("n")).collect()
    laid.unpersist()
    assert [r["n"] for r in met] == [1] * 5


def test_svm_stores_no_mapped_rows(rows, monkeypatch):
    """What is written and held of a row does not grow with the number of maps."""
    written = []
    real = baselines.cut_lineage
    monkeypatch.setattr(baselines, "cut_lineage", lambda df, name: written.append(df.columns) or real(df, name))
    baselines.rbf_svm(rows, rows, FEATURES, n_maps=30, max_iter=2)
    assert written == [[*FEATURES, "target", "_of"], ["target", "_v"]]


def test_svms_of_all_folds_reach_the_least_hinge_loss(spark):
    """Each fit by itself: subgradient steps of falling size over its rows come no lower."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] * x[:, 1] + 0.2 * rng.normal(size=120) > 0).astype(float)
    of = np.arange(120) % 3
    table = spark.createDataFrame([(float(a), float(b), float(t), int(k)) for (a, b), t, k in zip(x, y, of)], "a double, b double, t double, _of int")
    w, b = baselines.fourier_draws(2, 8, 0.5, 1)
    found = baselines.linear_svms(table, ["a", "b"], "t", "_of", 3, w, b, 1.0, 100)
    z, sign = baselines._map_rows(x, w, b), 2 * y - 1
    for k, point in enumerate(found):
        mine = of != k

        def loss(p):
            return np.maximum(0, 1 - sign[mine] * (z[mine] @ p[:-1] + p[-1])).mean() + p[:-1] @ p[:-1] / (2 * mine.sum())

        p, low = np.zeros(9), math.inf
        for step in range(1, 4001):
            wrong = mine & (sign * (z @ p[:-1] + p[-1]) < 1)
            g = np.append(-(sign[wrong, None] * z[wrong]).sum(axis=0) + p[:-1], -sign[wrong].sum()) / mine.sum()
            p = p - 3.0 / math.sqrt(step) * g
            low = min(low, loss(p))
        assert loss(point) <= low * 1.002


def test_mapped_blocks_equal_mapped_columns(rows):
    w, b = baselines.fourier_draws(len(FEATURES), 12, 0.3, 5)
    both = rows.limit(200).select(F.array(*FEATURES).alias("x"), F.array(*baselines.fourier_features(FEATURES, w, b)).alias("z")).collect()
    got = baselines._map_rows(np.array([r["x"] for r in both]), w, b)
    assert np.abs(got - np.array([r["z"] for r in both])).max() < 2e-7


def test_noise_of_many_steps_has_one_generator(monkeypatch):
    """A private step draws from its client's generator: making one took longer than drawing."""
    rng = np.random.default_rng(5)
    held, made, real = rng.normal(size=(640, 7)), [], np.random.default_rng
    cfg = replace(CFG, hidden=(4,), local_epochs=3, batch_size=64, dp_enabled=True)
    start = np.array(net.init_params(cfg.sizes(FEATURES), 3))
    first, _ = train.adam_epochs(start, cfg.sizes(FEATURES), held, cfg, (1, 1, 0))
    monkeypatch.setattr(np.random, "default_rng", lambda *a: made.append(a) or real(*a))
    again, _ = train.adam_epochs(start, cfg.sizes(FEATURES), held, cfg, (1, 1, 0))
    assert len(made) == 2 and (first == again).all()  # the order of batches and the noise
    other, _ = train.adam_epochs(start, cfg.sizes(FEATURES), held, cfg, (1, 2, 0))
    assert np.abs(other - again).max() > 1e-3


def test_step_noise_has_the_documented_size():
    cfg = replace(CFG, dp_enabled=True, clipping_norm=0.5, noise_multiplier=3.0)
    noise = synchronous.step_noise(1000, cfg, 4, 1, 0)
    drawn = np.array([next(noise).copy() for _ in range(100)])
    assert drawn.std() == pytest.approx(1.5, rel=0.02) and abs(drawn.mean()) < 0.02
    assert len(np.unique(drawn)) == drawn.size


def test_adam_moves_as_published():
    rng = np.random.default_rng(6)
    theta, m, v = rng.normal(size=9), np.zeros(9), np.zeros(9)
    moved, own_m, own_v = theta.copy(), np.zeros(9), np.zeros(9)
    for step in range(1, 30):
        g = rng.normal(size=9) * 10.0 ** rng.integers(-9, 2, 9)
        own_m, own_v = 0.9 * own_m + 0.1 * g, 0.999 * own_v + 0.001 * g * g
        moved -= 0.05 * (own_m / (1 - 0.9**step)) / (np.sqrt(own_v / (1 - 0.999**step)) + 1e-8)
        theta, m, v = synchronous.adam_step(theta, m, v, g, step, 0.05)
        assert np.allclose(theta, moved, rtol=1e-12, atol=1e-13)
