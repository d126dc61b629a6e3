"""Hash cuts, ranks, splits and partitions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from silolens.operators import hashcut, split


def table(spark, n=2000, positives=70, parts=4):
    return spark.range(n, numPartitions=parts).select(
        "id", (F.col("id") < positives).cast("int").alias("target"), (F.col("id") % 3).cast("int").alias("g")
    )


def exact(df, strata, salt, seed=42):
    h = hashcut.key_hash(["id"], seed, salt)
    return df.withColumn("want", F.row_number().over(Window.partitionBy(*strata).orderBy(h, "id")))


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rank_equals_global_window(spark):
    df = table(spark)
    got = hashcut.hash_rank(exact(df, ["g"], "s"), ["g"], ["id"], 42, "s", digits=2)
    assert got.where("rank <> want").count() == 0
    assert got.count() == 2000


@pytest.mark.parametrize("edge_rows, small_rows", [(1_000_000, 100_000), (3, 100_000), (1_000_000, 0)])
def test_cuts_equal_ranks_on_every_path(spark, monkeypatch, edge_rows, small_rows):
    monkeypatch.setattr(hashcut, "EDGE_ROWS", edge_rows)
    if small_rows == 0:
        monkeypatch.setattr(hashcut, "bounded_rows", lambda df: None)
    df = exact(table(spark), ["target"], "s")
    cuts = spark.createDataFrame([(0, 0, 0), (0, 1, 10), (0, 2, 1900), (0, 3, 5000), (1, 0, 1), (1, 1, 69)], "target int, cut int, need bigint")
    got = hashcut.cut_by_hash(df, cuts, ["target"], ["id"], 42, "s")
    expected = {0: [0, 10, 1900, 5000], 1: [1, 69]}
    for r in got.collect():
        assert r["part"] == sum(c < r["want"] for c in expected[r["target"]])


def test_many_cuts_use_the_bucket_lookup(spark):
    df = exact(table(spark), [], "m")
    cuts = spark.createDataFrame([(i, 25 * i) for i in range(60)], "cut int, need bigint")
    got = hashcut.cut_by_hash(df, cuts, [], ["id"], 42, "m")
    for r in got.collect():
        assert r["part"] == sum(25 * i < r["want"] for i in range(60))


def test_no_cuts_is_one_part(spark):
    cuts = spark.createDataFrame([], "target int, cut int, need bigint")
    assert hashcut.cut_by_hash(table(spark), cuts, ["target"], ["id"], 42).where("part = 0").count() == 2000


def test_unique_key_check(spark):
    with pytest.raises(ValueError, match="not unique"):
        hashcut.assert_unique_key(table(spark), ["g"])
    hashcut.assert_unique_key(table(spark), ["id"])


def test_published_sizes(spark):
    """10,000 rows with 339 failures: the published split and client sizes."""
    df = table(spark, 10_000, 339)
    parts = split.stratified_split(df, "target", ["id"], n_train=8000, n_test=2000)
    meta = {r["split"]: (r["n_rows"], r["n_failures"]) for r in split.dataset_metadata(parts).collect()}
    assert meta == {"train": (8000, 271), "test": (2000, 68)}
    clients = split.partition_rows(parts.where("split = 'train'").drop("split"), "iid", 5, "target", ["id"])
    rows = split.partition_summary(split.client_split(clients, "target", ["id"], 0.2)).orderBy("client_id").collect()
    assert [tuple(r) for r in rows[:4]] == [(c, 1280, 321, 44, 11, 0.0344) for c in range(4)]
    assert tuple(rows[4]) == (4, 1276, 320, 41, 10, 0.0321)


def test_split_leaves_surplus_rows_out(spark):
    parts = split.stratified_split(table(spark), "target", ["id"], n_train=1000, n_test=300)
    assert parts.where("split = 'train'").count() == 1000
    assert parts.where("split = 'test'").count() == 300
    with pytest.raises(ValueError, match="2000 rows"):
        split.stratified_split(table(spark), "target", ["id"], n_train=1900, n_test=300)


def test_split_does_not_depend_on_partitioning(spark):
    a = split.stratified_split(table(spark, parts=1), "target", ["id"], test_fraction=0.2)
    b = split.stratified_split(table(spark).repartition(64), "target", ["id"], test_fraction=0.2)
    assert pairs(a, "id", "split") == pairs(b, "id", "split")


def test_iid_paths_agree(spark, monkeypatch):
    df = table(spark)
    a = pairs(split.partition_iid(df, 40, "target", ["id"]), "id", "client_id")
    monkeypatch.setattr(split, "SMALL_ROWS", 1)
    monkeypatch.setattr(split, "_class_counts", lambda *_: {0: 1930, 1: 70})
    b = pairs(split.partition_iid(df, 40, "target", ["id"]), "id", "client_id")
    assert a == b


def test_every_row_gets_one_client(spark):
    got = split.partition_rows(table(spark), "non_iid", 4, "target", ["id"], alpha=0.8)
    sizes = {(r.target, r.client_id): r.size for r in split.dirichlet_sizes(spark, {0: 1930, 1: 70}, 4, 0.8, 42, "target", "int").collect()}
    counts = {(r["target"], r["client_id"]): r["count"] for r in got.groupBy("target", "client_id").count().collect()}
    assert counts == {k: n for k, n in sizes.items() if n}
    assert sum(counts.values()) == 2000


def test_partition_errors(spark):
    with pytest.raises(ValueError, match="unknown partition strategy"):
        split.partition_rows(table(spark), "random", 4, "target", ["id"])
    with pytest.raises(ValueError, match="no rows"):
        split.partition_iid(table(spark, 10, 2), 20, "target", ["id"])


def test_hot_client_and_single_row_client(spark):
    df = table(spark).withColumn("client_id", F.when(F.col("id") == 1999, 1).otherwise(0))
    got = split.partition_summary(split.client_split(df, "target", ["id"], 0.2)).orderBy("client_id").collect()
    assert (got[0]["n_train"], got[0]["n_test"]) == (1599, 400)
    assert (got[1]["n_train"], got[1]["n_test"], got[1]["train_failure_rate"]) == (0, 1, None)


def test_two_rows_and_one_class(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "id bigint, target int")
    got = split.stratified_split(df, "target", ["id"], test_fraction=0.5)
    assert sorted(r["split"] for r in got.collect()) == ["test", "train"]


def test_labelling_rows_needs_no_shuffle(spark):
    got = split.stratified_split(table(spark), "target", ["id"], test_fraction=0.2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("alpha", [0.3, 0.5, 1.0, 4.0])
def test_hash_gammas_have_the_moments_of_gammas(spark, alpha):
    rows = spark.range(40_000).selectExpr("cast(id AS int) AS client_id", "0 AS target")
    value = split.gamma_units(alpha, 7, "target", "client_id") / split.UNIT
    mean, var, low = rows.select(value.alias("g")).selectExpr("avg(g)", "var_pop(g)", "min(g)").first()
    assert mean == pytest.approx(alpha, rel=0.03) and var == pytest.approx(alpha, rel=0.08) and low > 0


def test_running_sizes_past_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(split, "CLIENT_BUCKET", 7)
    sizes = split.dirichlet_sizes(spark, {0: 5000, 1: 3}, 50, 0.5, 9, "target", "int")
    got = {}
    for r in split.running_sizes(sizes, "target").orderBy("target", "client_id").collect():
        got.setdefault(r.target, []).append((r.size, r.upto))
    for target, n in ((0, 5000), (1, 3)):
        total = 0
        for size, upto in got[target]:
            total += size
            assert upto == total and size >= 0
        assert total == n and len(got[target]) == 50


def test_empty_clients_are_named(spark):
    with pytest.raises(ValueError, match="would receive no rows"):
        split.partition_rows(table(spark, 10, 2), "non_iid", 30, "target", ["id"])


def test_many_strata_meet_once_and_split_alike(spark, monkeypatch):
    """Small strata are ranked whole, with no join of the rows; the sides are those that the cuts give."""
    table = spark.range(3000).selectExpr("id", "cast(id % 41 AS int) AS client_id", "cast(id % 11 = 0 AS int) AS target")
    ranked = split.client_split(table, "target", ["id"], 0.2)
    assert "Join" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(split, "EDGE_ROWS", 0)
    cut = split.client_split(table, "target", ["id"], 0.2)
    assert sorted(map(tuple, ranked.select("id", "split").collect())) == sorted(map(tuple, cut.select("id", "split").collect()))
