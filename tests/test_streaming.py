"""Uploads as a stream."""

from datetime import datetime

from silolens.session import scratch_path
from silolens.streaming import rounds


def upload(spark, path, rows):
    spark.createDataFrame([(r, c, n, p, datetime(2024, 1, 1, h, m)) for r, c, n, p, h, m in rows], rounds.UPLOAD).coalesce(1).write.mode("append").parquet(path)


def test_a_round_across_the_hour_is_one_mean_and_a_client_counts_once(spark):
    path = scratch_path(spark, "uploads")
    upload(spark, path, [(1, 0, 1, [0.0], 1, 50), (1, 1, 1, [4.0], 2, 5), (1, 0, 1, [0.0], 2, 6), (1, 1, 1, [4.0], 2, 7)])
    upload(spark, path, [(9, 9, 0, [0.0], 12, 0)])
    means = rounds.round_means(rounds.read_uploads(spark, path), "1 hour", "30 minutes")
    got = spark.read.parquet(rounds.run_available(means, "means"))
    assert [(r["round"], r["value"], r["n_clients"]) for r in got.where("round = 1").collect()] == [(1, 2.0, 2)]


def test_late_uploads_miss_their_round(spark):
    path = scratch_path(spark, "uploads")
    upload(spark, path, [(1, 0, 1, [0.0], 1, 0), (1, 1, 3, [4.0], 1, 30)])
    upload(spark, path, [(2, 0, 1, [8.0], 2, 0), (3, 9, 0, [0.0], 4, 0)])  # the clock is past round 1's timeout now
    upload(spark, path, [(4, 9, 0, [0.0], 5, 0)])  # lateness is judged by the batch before
    upload(spark, path, [(1, 2, 100, [99.0], 1, 10), (9, 9, 0, [0.0], 9, 0)])
    means = rounds.round_means(rounds.read_uploads(spark, path, files_per_batch=1), "1 hour", "30 minutes")
    got = spark.read.parquet(rounds.run_available(means, "means"))
    assert {(r["round"], r["value"], r["n_clients"]) for r in got.collect()} == {(1, 3.0, 2), (2, 8.0, 1), (3, None, 1), (4, None, 1)}
