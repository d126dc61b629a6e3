"""Missing features, masks, large clients and the log: cases that the SQL comparison does not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silolens import session
from silolens.functions import hashing, net
from silolens.operators import explain, gradients, privacy, synchronous, train
from silolens.session import scratch_path
from silolens.sources import track

NAMES = ["a", "b"]
LAYOUTS = [(2, 1), (2, 3, 1), (2, 64, 32, 1)]


def rows(spark):
    data = [(1, 0.5, 1.0, 1), (2, None, 1.0, 0), (3, float("nan"), 1.0, 1), (4, 0.1, None, 0), (5, -0.2, 0.3, 0)]
    return spark.createDataFrame([(i, a, b, y, 0) for i, a, b, y in data], "id int, a double, b double, target int, client_id int")


@pytest.mark.parametrize("sizes", LAYOUTS)
def test_missing_features_have_no_score(spark, sizes):
    out = net.predict(net.score(rows(spark), net.init_params(sizes, 1), sizes, NAMES)).orderBy("id").collect()
    assert [r.p1 is None for r in out] == [False, True, True, True, False]
    assert [r.y_pred is None for r in out] == [r.confidence is None for r in out] == [r.p1 is None for r in out]


@pytest.mark.parametrize("sizes", LAYOUTS)
def test_missing_features_are_no_examples(spark, sizes):
    params = net.init_params(sizes, 1)
    whole = rows(spark).where("id IN (1, 5)")
    a, b = (gradients.net_gradient_sums(t, params, sizes, NAMES, clip=1.0).orderBy("idx").collect() for t in (rows(spark), whole))
    assert [(r.n_examples, pytest.approx(r.g)) for r in b] == [(r.n_examples, r.g) for r in a]


def test_logistic_sums_count_complete_rows(spark):
    cols = ["g0", "g1", "g2"]
    made = gradients.clipped_sums(gradients.logistic_gradients(rows(spark), [0.1, 0.2, 0.3], NAMES), cols, 0.5, ["client_id"]).first()
    assert made.n_examples == 2 and all(np.isfinite(made[c]) for c in cols)


def updates(spark, value, n):
    return spark.createDataFrame([(1, i, [value]) for i in range(n)], "round int, client_id long, params array<double>")


@pytest.mark.parametrize("value, fits", [(1e6, True), (-1e6, True), (1.4e7, False), (-1.4e7, False)])
def test_ring_refuses_what_could_wrap(spark, value, fits):
    n = 10  # 2^47 / 2^20 / 10 is 13.4 million
    table = updates(spark, value, n)
    expected = table.groupBy("round").agg(F.count("*").alias("n"))
    masks = privacy.client_masks(privacy.mask_pairs(table, "s"), 1)
    mean = privacy.secure_mean(privacy.apply_mask(table, masks, expected=expected), expected)
    if fits:
        assert mean.first().value == pytest.approx(value)
    else:
        with pytest.raises(Exception, match="too large for the ring"):
            mean.collect()


def test_absent_participant_fails(spark):
    table = updates(spark, 1.0, 6)
    cfg = train.TrainConfig(secure_aggregation=True)
    members = table.select("round", "client_id")
    assert train.secure_round(table, members, 1, cfg).first().value == 1.0
    with pytest.raises(Exception, match="missing"):
        train.secure_round(table.where("client_id <> 3"), members, 1, cfg).collect()


@pytest.mark.parametrize("hidden", [(), (3,)])
def test_masked_gradient_rounds_follow_plain_ones(spark, hidden):
    table = spark.range(60).selectExpr("id", "cos(id) AS a", "sin(id) AS b", "cast(id % 3 = 0 AS int) AS target", "id % 4 AS client_id")
    cfg = train.TrainConfig(hidden=hidden, rounds=2, mode="fed_sgd", weighted=False, learning_rate=0.5)
    plain = train.train_federated(table, table, NAMES, ["id"], cfg)
    masked = train.train_federated(table, table, NAMES, ["id"], train.replace(cfg, secure_aggregation=True))
    gap = np.abs(np.array(plain.params) - masked.params).max()
    assert 0 < gap < 1e-5


def test_large_client_is_refused_unless_sliced(spark, monkeypatch):
    monkeypatch.setattr(train, "GROUP_ROWS", 20)
    monkeypatch.setattr(synchronous, "GROUP_ROWS", 20)
    table = rows(spark).crossJoin(spark.range(10).withColumnRenamed("id", "copy"))
    cfg = train.TrainConfig(hidden=(), rounds=1, local_epochs=1)
    with pytest.raises(ValueError, match="slices"):
        train.train_federated(table, table, NAMES, ["id", "copy"], cfg)
    assert train.train_federated(table, table, NAMES, ["id", "copy"], train.replace(cfg, local_steps=2, slices=8)).rounds[-1]["n_clients"] == 1


def test_method_is_the_callers_choice(spark):
    wide = [f"f{i}" for i in range(13)]
    table = spark.range(1).select(*[F.lit(float(i)).alias(c) for i, c in enumerate(wide)])
    score = explain.net_score_fn([0.1] * 14, (13, 1))
    with pytest.raises(ValueError, match="sampled"):
        explain.shapley_values(table, score, np.zeros((2, 13)), wide)
    with pytest.raises(ValueError, match="method"):
        explain.shapley_values(table, score, np.zeros((2, 13)), wide, method="fast")
    got = explain.shapley_values(table, score, np.zeros((2, 13)), wide, method="sampled").first().phi
    assert sum(got) == pytest.approx(score(np.arange(13.0)[None])[0] - score(np.zeros((1, 13)))[0])


def test_log_reads_whole_after_fractional_numbers(spark):
    path = scratch_path(spark, "log")
    track.log_experiment(spark, path, "x", "m", {"f1": 1})
    track.log_experiment(spark, path, "x", "m", {"f1": 0.5}, {"on": True, "note": "n", "sizes": [1, 2]})
    log = track.read_log(spark, path)
    assert dict(log.dtypes)["f1"] == "double" and sorted(r.f1 for r in log.collect()) == [0.5, 1.0]


def test_null_keys_keep_their_place(spark):
    table = spark.createDataFrame([(1, None, 2), (1, 2, None), (1, None, 2)], "a int, b int, c int")
    a, b, c = (r[0] for r in table.select(hashing.hash_hex(1, F.col("a"), F.col("b"), F.col("c"))).collect())
    assert a == c != b


def test_empty_weight_lists_count_as_explained_rows(spark):
    table = spark.createDataFrame([([("a", 2.0)],), ([],), ([("a", -4.0), ("b", 1.0)],)], "weights array<struct<feature: string, weight: double>>")
    assert {r.feature: r.importance for r in explain.global_weights(table).collect()} == {"a": 2.0, "b": pytest.approx(1 / 3)}


def test_wide_rows_are_bounded_by_bytes(spark, monkeypatch):
    table = spark.range(5).selectExpr("id", "sequence(1, 100) AS v")
    assert len(session.bounded_rows(table)) == 5 and session.bounded_rows(table, 4) is None
    monkeypatch.setattr(session, "SMALL_BYTES", 1000)
    assert session.bounded_rows(table) is None
    assert len(session.bounded_rows(table.drop("v"))) == 5
    assert session.small(table).count() == 5


def test_cuts_past_the_bound_with_null_strata(spark, monkeypatch):
    from silolens.operators import hashcut

    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id % 3 END AS s")
    cuts = spark.createDataFrame([(s, c, n) for s in (1, 2, None) for c, n in enumerate((0, 5, 40, 41, 120))], "s long, cut long, need long")
    want = hashcut.cut_by_hash(rows, cuts, ["s"], ["id"], 7).where("s IS NOT NULL").collect()
    ranked = hashcut._cut_by_rank(rows, cuts.selectExpr("s", "cut", "need"), ["s"], ["id"], 7, "", "part")
    got = {r.id: r.part for r in ranked.collect()}
    assert {r.id: r.part for r in want} == {i: p for i, p in got.items() if i % 3}
    counts = {}
    for i, p in got.items():
        if i % 3 == 0:
            counts[p] = counts.get(p, 0) + 1
    assert counts == {1: 5, 2: 35, 3: 1, 4: 79, 5: 47}
