"""Every registered query against its SQL, and the driver contract."""

import functools
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from silolens.plans import fixtures as fx
from silolens.session import scratch_path
from tools.check_oracle import TABLES, verdict

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got) > 0
    assert verdict(got, duck.execute(ORACLES[name]).df()) == "ok"


@functools.cache
def collected(spark, sf, name):
    rows = entry.queries()[name](spark, sf).collect()
    assert rows
    for r in rows:
        for c, v in r.asDict().items():
            assert not isinstance(v, float) or math.isfinite(v), (c, r)
    return rows


METRICS = ("accuracy", "precision", "recall", "f1")


@pytest.mark.parametrize("name, rows", [("d13_baseline_ann", 7), ("d14_baseline_rf", 1), ("d15_baseline_svm", 1), ("d16_baseline_comparison", 3),
                                        ("f10_federated_rounds", 11), ("f10c_masked_rounds", 11)])
def test_trained_models_are_measured(spark, sf, name, rows):
    got = collected(spark, sf, name)
    assert len(got) == rows
    assert all(0 <= r[m] <= 1 for r in got for m in METRICS)
    assert max(r.accuracy for r in got) > 0.9  # most readings are no failures


def test_local_training_returns_one_update_a_client(spark, sf):
    got = collected(spark, sf, "d10_fedavg_local_train")
    assert len({r.client_id for r in got}) == len(got) and len({len(r.params) for r in got}) == 1
    assert sum(r.n_examples for r in got) == entry.queries()["d12_client_evaluate"](spark, sf).selectExpr("sum(n_rows)").first()[0]


def test_a_fedavg_round_ends_with_the_mean_of_its_updates(spark, sf):
    """Local training alone is no FedAvg round: the updates are averaged, weighted by examples."""
    got = collected(spark, sf, "d10_fedavg_local_train")
    total = sum(r.n_examples for r in got)
    want = [sum(r.n_examples * r.params[i] for r in got) / total for i in range(len(got[0].params))]
    assert all(r.mean_params == pytest.approx(want) for r in got)


def test_ablation_explains_every_held_out_row(spark, sf):
    got = {r.variant: r for r in collected(spark, sf, "r2_ablation")}
    for v in ("D_fl_dp_shap", "E_full"):
        assert got[v].shap_samples == got[v].lime_samples > 1000 and got[v].shap_max_error < 1e-6
        assert len(json.loads(got[v].shap_importance)) == 6 and json.loads(got[v].lime_importance)
    assert sum(json.loads(got["E_full"].cluster_counts)) > 0


def test_shapley_values_of_a_net_add_up(spark, sf):
    got = collected(spark, sf, "x3b_shapley_mlp")
    keys = [c for c in got[0].asDict() if c not in ("feature", "phi")]
    totals = {}
    for r in got:
        k = tuple(r[c] for c in keys)
        totals[k] = totals.get(k, 0.0) + r.phi
    assert len(totals) * 6 == len(got) and all(-1 <= v <= 1 for v in totals.values())


def test_surrogate_weights_are_ranked(spark, sf):
    got = collected(spark, sf, "x7_lime")
    by_row = {}
    for r in got:
        by_row.setdefault(tuple(r[c] for c in r.asDict() if c not in ("feature", "weight", "pos")), []).append((r.pos, abs(r.weight)))
    for weights in by_row.values():
        sizes = [w for _, w in sorted(weights)]
        assert len(sizes) == 4 and sizes == sorted(sizes, reverse=True)


def test_reports_follow_the_logged_runs(spark, sf):
    models = {r.model: r for r in collected(spark, sf, "d16_baseline_comparison")}
    shown = {r.model: r for r in collected(spark, sf, "r8_model_comparison")}
    assert set(models) == {"ann", "rf", "svm"} and set(shown) == {*models, "federated"}
    assert all(shown[m].f1 == models[m].f1 and shown[m].label for m in models)
    gaps = {(r.model, r.metric): r for r in collected(spark, sf, "r9_vs_reference")}
    assert len(gaps) == 16
    for (m, k), r in gaps.items():
        assert r.measured == pytest.approx(100 * shown[m][k]) and r.difference == pytest.approx(r.measured - r.published)
    ladder = {r.variant: r for r in collected(spark, sf, "r2_ablation")}
    table = {r.variant: r for r in collected(spark, sf, "r10_ablation_table")}
    assert set(table) == set(ladder)
    for v, r in table.items():
        assert r.f1 == pytest.approx(ladder[v].f1, abs=1e-4) and r.comm_mb == pytest.approx(ladder[v].comm_mb or 0, abs=1e-2)


def test_surrogate_reports_agree(spark, sf):
    rows = collected(spark, sf, "x8_lime_topk")
    by_row = {}
    for r in rows:
        by_row.setdefault((r.k1, r.k2, r.k3, r.k4, r.k5), {})[r.feature] = (r.pos, r.weight)
    assert all(len(w) == 3 and sorted(p for p, _ in w.values()) == [1, 2, 3] for w in by_row.values())
    want = {}
    for w in by_row.values():
        for f, (_, x) in w.items():
            want[f] = want.get(f, 0.0) + abs(x) / len(by_row)
    got = {r.feature: r.importance for r in collected(spark, sf, "x9_lime_importance")}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f]) for f in want)
    shown = collected(spark, sf, "r7_lime_rows")
    assert len(shown) == len(rows) and {r.predicted for r in shown} <= {"Failure", "No failure"}
    for r in shown:
        assert r.weight == pytest.approx(by_row[(r.k1, r.k2, r.k3, r.k4, r.k5)][r.feature][1], abs=1e-4)


def test_principal_axes_and_explanations(spark, sf):
    assert len(collected(spark, sf, "k10_pca_projection")) == len(collected(spark, sf, "k2_assign"))
    assert all(r.shap_importance >= 0 for r in collected(spark, sf, "x11_explain_report"))


def test_contract(spark):
    assert set(ORACLES) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_reading_keys_are_rounded_without_decimal_numbers(spark):
    """Prices in cents as SQL rounds them, halves away from zero, nulls kept."""
    prices = [901.0, 1234.565, 0.285, 0.005, -0.005, 1.005, -2.675, 104949.5, 0.0, 12345.675, None, *[round(900 + i * 37.123, 2) for i in range(300)]]
    table = spark.createDataFrame([(i, i, i, 1, 1.0, p, 0.0, 0.0, "A") for i, p in enumerate(prices)], fx.LINEITEM)
    folder = scratch_path(spark, "prices")
    table.write.parquet(f"{folder}/lineitem.parquet")
    made = fx.sensor_rows(spark, folder)
    want = table.select(F.col("l_orderkey").alias("k1"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("w"))
    both = made.join(want, "k1").select("k5", "w").collect()
    assert len(both) == len(prices) and all(r.k5 == r.w for r in both)
    assert "round(" not in made._jdf.queryExecution().optimizedPlan().toString()
