"""Aggregation, masks, clustering and the experiment log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silolens.operators import aggregate, cluster, privacy, report
from silolens.operators.train import TrainConfig
from silolens.session import scratch_path, shared_dir, small
from silolens.sources import tables, track

UPDATES = "round int, client_id bigint, n_examples bigint, loss double, params array<double>"


def updates(spark, rows):
    return spark.createDataFrame(rows, UPDATES)


def many(spark, n, rounds=1, width=3):
    return spark.range(n).crossJoin(spark.range(1, rounds + 1).withColumnRenamed("id", "r")).select(
        F.col("r").cast("int").alias("round"), F.col("id").alias("client_id"), (F.col("id") + 1).alias("n_examples"),
        F.lit(0.5).alias("loss"), F.array(*[F.sin(F.col("id") * (j + 1)) for j in range(width)]).alias("params"),
    )


def values(df):
    return [r["value"] for r in df.orderBy("round", "idx").collect()]


def test_equal_updates_average_to_themselves(spark):
    rows = [(1, c, 10 * c + 1, 0.1, [1.5, -2.0]) for c in range(4)]
    assert values(aggregate.fedavg(updates(spark, rows))) == pytest.approx([1.5, -2.0])
    assert values(aggregate.fedavg(updates(spark, rows), weight=None)) == pytest.approx([1.5, -2.0])


def test_weights(spark):
    rows = [(1, 0, 1, 1.0, [0.0]), (1, 1, 3, 2.0, [4.0])]
    assert values(aggregate.fedavg(updates(spark, rows))) == [3.0]
    assert values(aggregate.aggregate_round(updates(spark, rows), masked=True)) == [2.0]
    assert aggregate.fit_metrics(updates(spark, rows)).first()["loss"] == 1.75


@pytest.mark.parametrize("weights, message", [((-1, 3), "non-negative"), ((0, 0), "positive")])
def test_bad_weights_fail(spark, weights, message):
    rows = [(1, i, w, 1.0, [1.0]) for i, w in enumerate(weights)]
    with pytest.raises(Exception, match=message):
        aggregate.fedavg(updates(spark, rows)).collect()


def test_sampling_keeps_at_least_one(spark):
    got = aggregate.sample_clients(many(spark, 7, rounds=3), 0.01)
    assert [r["count"] for r in got.groupBy("round").count().collect()] == [1, 1, 1]
    assert aggregate.sample_clients(many(spark, 7), 1.0).count() == 7


@pytest.mark.parametrize("n, pairs", [(2, 1), (3, 3), (4, 6), (5, 10), (6, 12), (9, 18)])
def test_ring_pairs(spark, n, pairs):
    """Up to five participants every pair is linked; beyond, two neighbours on either side."""
    got = privacy.mask_pairs(many(spark, n), "s", reach=2)
    assert got.count() == pairs == got.select("client_a", "client_b").distinct().count()
    assert got.where("client_a >= client_b").count() == 0


@pytest.mark.parametrize("n", [2, 5, 12])
def test_masks_cancel_exactly(spark, n):
    ups = many(spark, n, rounds=2)
    masks = privacy.client_masks(privacy.mask_pairs(ups, "s"), 3)
    sums = masks.select("round", F.posexplode("mask").alias("i", "m")).groupBy("round", "i").agg(F.sum(F.col("m").cast("decimal(38,0)")).alias("s"))
    assert all(int(r["s"]) % privacy.RING == 0 for r in sums.collect())
    mean = privacy.secure_mean(privacy.apply_mask(ups, masks), ups.groupBy("round").agg(F.count("*").alias("n")))
    assert values(mean) == pytest.approx(values(aggregate.fedavg(ups, weight=None)), abs=1e-6)


def test_masks_differ_between_rounds(spark):
    masks = privacy.client_masks(privacy.mask_pairs(many(spark, 3, rounds=2), "s"), 3)
    assert masks.select("mask").distinct().count() == 6


def test_missing_participant_and_lone_client_fail(spark):
    ups = many(spark, 5)
    masked = privacy.apply_mask(ups, privacy.client_masks(privacy.mask_pairs(ups, "s"), 3))
    expected = ups.groupBy("round").agg(F.count("*").alias("n"))
    with pytest.raises(Exception, match="would not cancel"):
        privacy.secure_mean(masked.where("client_id <> 2"), expected).collect()
    with pytest.raises(Exception, match="at least 2"):
        privacy.mask_pairs(many(spark, 1), "s").collect()
    with pytest.raises(Exception, match="does not match"):
        privacy.apply_mask(ups, privacy.client_masks(privacy.mask_pairs(ups, "s"), 2)).collect()


def test_update_clipping(spark):
    ups = updates(spark, [(1, 0, 1, 0.0, [3.0, 4.0]), (1, 1, 1, 0.0, [0.3, 0.4]), (1, 2, 1, 0.0, [0.0, 0.0])])
    got = {r["client_id"]: r["params"] for r in privacy.clip_update(ups, 1.0).collect()}
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.3, 0.4] and got[2] == [0.0, 0.0]
    assert privacy.clip_update(ups, 0.0).where("client_id = 0").first()["params"] == [0.0, 0.0]
    assert privacy.dp_update(ups, 1.0, 1.0, 1, enabled=False).first()["params"] == [3.0, 4.0]


# --- clustering ------------------------------------------------------------------------------


def points(spark, n=300, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    return x, spark.createDataFrame([(i, i % 3, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, client_id int, a double, b double")


def test_fit_equals_plain_iterations(spark):
    x, df = points(spark)
    start = cluster.init_centroids(3, 2, 1)
    centers, moves = cluster.fit(df, start, ["a", "b"], 4)
    want = np.array(start)
    for _ in range(4):
        nearest = ((x[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[nearest == k].mean(axis=0) if (nearest == k).any() else want[k] for k in range(3)])
        shift, want = np.linalg.norm(new - want, axis=1).mean(), new
    assert np.allclose(centers, want) and moves[-1] == pytest.approx(shift)


def test_ties_and_empty_clusters(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 1.0)], "client_id int, a double, b double")
    centers = [[1.0, 0.0], [-1.0, 0.0], [99.0, 99.0]]
    assigned = cluster.assign(df, centers, ["a", "b"])
    assert [r["cluster"] for r in assigned.collect()] == [0, 0]
    pooled = {r["cluster"]: (r["n"], r["c0"], r["c1"]) for r in cluster.pool(cluster.client_partials(assigned, ["a", "b"]), centers).collect()}
    assert pooled == {0: (2, 0.0, 0.5), 1: (0, -1.0, 0.0), 2: (0, 99.0, 99.0)}
    assert [r["n_rows"] for r in cluster.cluster_counts(assigned, 3).orderBy("cluster").collect()] == [2, 0, 0]
    dist = cluster.client_distribution(assigned, 3).orderBy("client_id").first()
    assert (dist["n_c0"], dist["n_c2"], dist["f_c0"], dist["f_c2"]) == (1, 0, 1.0, 0.0)


def test_vector_assignment_equals_columns(spark):
    _, df = points(spark)
    centers = cluster.init_centroids(4, 2, 3)
    both = cluster.assign_vectors(cluster.assign(df, centers, ["a", "b"]).withColumn("v", F.array("a", "b")), centers, "v", "other")
    assert both.where("cluster <> other").count() == 0


def test_vector_rounds_equal_column_rounds(spark):
    _, df = points(spark)
    vectors = df.withColumn("v", F.array("a", "b"))
    start = cluster.init_centroids(4, 2, 3)
    odd = spark.createDataFrame([(900, 0, None), (901, 0, [1.0]), (902, 1, [float("nan"), 0.0]), (903, 1, [None, 0.0])], "id int, client_id int, v array<double>")
    got = cluster.fit_vectors(vectors.select("id", "client_id", "v").unionByName(odd), start, "v", 3)
    want = cluster.fit(df, start, ["a", "b"], 3)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    parts = cluster.vector_partials(vectors, start, "v")
    columns = cluster.client_partials(cluster.assign(df, start, ["a", "b"]), ["a", "b"])
    a = {(r.client_id, r.cluster): (r.n, *r.sums) for r in parts.collect()}
    b = {(r.client_id, r.cluster): (r.n, r.s0, r.s1) for r in columns.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_vector_axes_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 5)
    x = np.random.default_rng(5).normal(size=(200, 12)) @ np.diag(np.arange(1, 13))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None)], "id int, v array<double>").repartition(6)
    n, mean, cov = cluster.vector_moments(df, "v", 12)
    assert n == 200 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    axes = cluster.leading_axes(cov, 3)
    got = {r.id: r.pcs for r in cluster.project_vectors(df, mean, axes, "v", ["id"]).collect()}
    assert got.pop(900) is None and len(got) == 200
    assert np.allclose([got[i] for i in range(200)], (x - x.mean(axis=0)) @ axes.T)
    with pytest.raises(ValueError, match="no row"):
        cluster.vector_moments(df.where("id > 800"), "v", 12)


def test_projection_equals_numpy(spark):
    x, df = points(spark)
    means, axes = cluster.principal_axes(df, ["a", "b"])
    got = np.array([[r["pc1"], r["pc2"]] for r in cluster.project(df, means, axes, ["a", "b"], ["id"]).orderBy("id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ vt.T
    assert np.allclose(np.abs(got), np.abs(want))
    assert all(max(a, key=abs) > 0 for a in axes)


# --- tables and log --------------------------------------------------------------------------


def test_log_keeps_the_union_of_columns(spark):
    path = scratch_path(spark, "log")
    first = track.log_experiment(spark, path, "Data preparation", "prepare", {"n": 3}, timestamp="2024-01-02T03:04:05")
    second = track.log_experiment(spark, path, "Data preparation", "prepare", {"acc": 0.5}, {"tags": ["a"]}, "2024-01-02T03:04:05")
    assert first != second and first.startswith("20240102_030405_data_preparation_")
    log = track.read_log(spark, path)
    assert log.columns[:4] == list(track.LEADING) and set(log.columns[4:]) == {"n", "acc", "tags"}
    assert log.where("n is null").first()["tags"] == '["a"]'
    assert track.latest_experiments(log, 1).first()["experiment_id"] == max(first, second)


def test_latest_run_of_each_name(spark):
    path = scratch_path(spark, "log")
    for k, (name, f1) in enumerate([("ann", 0.1), ("rf", 0.2), ("ann", 0.3)]):
        track.log_experiment(spark, path, name, "baseline", {"f1": f1}, {"extra": 1} if k == 0 else {}, f"2024-01-0{k + 1}T00:00:00")
    got = {r.name: (r.f1, r.extra) for r in track.latest_runs(track.read_log(spark, path)).collect()}
    assert got == {"ann": (0.3, None), "rf": (0.2, None)}


def test_config_rows(spark):
    rows = track.config_rows(spark, {"a": {"x": 1, "y": [2]}, "skipped": 3})
    assert {(r["key"], r["value"]) for r in rows.collect()} == {("a.x", "1"), ("a.y", "[2]")}


def test_union_of_different_columns(spark):
    a, b = spark.createDataFrame([(1,)], ["p"]), spark.createDataFrame([(2,)], ["q"])
    assert track.union_records(a, b).columns == ["p", "q"]


def test_load_raw_errors(spark):
    with pytest.raises(FileNotFoundError):
        tables.load_raw(spark, "/nonexistent/table.parquet", "a int")
    path = scratch_path(spark, "empty")
    spark.createDataFrame([], "a int").write.parquet(path)
    with pytest.raises(ValueError, match="empty"):
        tables.load_raw(spark, path, "a int")


def test_malformed_cells_are_errors(spark):
    path = scratch_path(spark, "bad_csv")
    spark.createDataFrame([("1", "2.5"), ("x", "3.5")], "a string, b string").coalesce(1).write.option("header", "true").csv(path)
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.load_raw(spark, path, "a int, b double", "csv").collect()
    lenient = tables.load_raw(spark, path, "a int, b double", "csv", mode="PERMISSIVE").collect()
    assert sorted((r.a or 0, r.b) for r in lenient) == [(0, 3.5), (1, 2.5)]


def test_load_client_reads_only_its_folder(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("target"), (F.col("id") % 4).cast("int").alias("client_id"), F.lit("train").alias("split"))
    path = scratch_path(spark, "clients")
    tables.write_client_partitions(df, path)
    one = tables.load_client(spark, path, df.schema, 3)
    assert one.count() == 25
    assert {r[0].split("client_id=")[1][0] for r in one.select(F.input_file_name()).distinct().collect()} == {"3"}
    assert "PartitionFilters: [isnotnull(client_id" in one._jdf.queryExecution().executedPlan().toString()
    assert tables.feature_columns(one.columns) == ["id"]
    with pytest.raises(FileNotFoundError, match="client 9"):
        tables.load_client(spark, path, df.schema, 9)


def test_shared_dir_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(50).select("id")
    assert "ResolvedHint" in small(df, 100)._jdf.queryExecution().analyzed().toString()
    assert small(df, 10) is df


def test_variant_switches():
    names = [v.name for v in report.enabled_variants({"C_fl_dp": False, "A_centralized": False})]
    assert names == ["A_centralized", "B_fl_only", "D_fl_dp_shap", "E_full"]


def test_ablation_ladder(spark, sf):
    from silolens.plans import fixtures as fx

    rows = fx.features(spark, sf)
    cfg = TrainConfig(hidden=(4,), rounds=1, local_epochs=1, noise_multiplier=0.1)
    got = report.run_ablation(rows, rows, fx.FEATURES, fx.KEYS, cfg, epochs=1, cluster_rounds=1, lime_samples=50, shap_rows=7, lime_rows=3)
    by_name = {r["variant"]: r for r in got.collect()}
    assert list(by_name) == [v.name for v in report.VARIANTS]
    assert by_name["A_centralized"]["comm_mb"] is None and by_name["B_fl_only"]["comm_mb"] is not None
    assert (by_name["D_fl_dp_shap"]["shap_samples"], by_name["D_fl_dp_shap"]["lime_samples"]) == (7, 3)
    assert sum(by_name["E_full"]["cluster_counts"]) == rows.count()


def test_variants_of_one_run_share_it(spark, sf, monkeypatch):
    """C, D and E differ in what is shown of a run: it is trained and explained once."""
    from silolens.plans import fixtures as fx

    rows, made = fx.features(spark, sf), []
    for name in ("train_federated", "explain_run"):
        monkeypatch.setattr(report, name, lambda *a, _name=name, _real=getattr(report, name), **k: made.append(_name) or _real(*a, **k))
    cfg = TrainConfig(hidden=(), rounds=1, local_epochs=1, noise_multiplier=0.1)
    got = report.run_ablation(rows, rows, fx.FEATURES, fx.KEYS, cfg, epochs=1, cluster_rounds=1, lime_samples=50, shap_rows=7, lime_rows=3).collect()
    assert sorted(made) == ["explain_run", "train_federated", "train_federated"]
    by_name = {r["variant"]: r for r in got}
    assert by_name["C_fl_dp"]["f1"] == by_name["D_fl_dp_shap"]["f1"] == by_name["E_full"]["f1"]
    assert by_name["D_fl_dp_shap"]["shap_importance"] == by_name["E_full"]["shap_importance"] and by_name["C_fl_dp"]["shap_importance"] is None


def test_counting_clusters_writes_the_assignment_once(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 1.0), (1, None, 1.0)], "client_id int, a double, b double")
    counts = cluster.cluster_counts(cluster.assign(df, [[1.0, 0.0], [-1.0, 0.0], [99.0, 99.0]], ["a", "b"]), 3)
    assert sorted(tuple(r) for r in counts.collect()) == [(0, 2), (1, 0), (2, 0)]  # a row without a cluster is in none
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 1
