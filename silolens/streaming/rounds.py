"""Rounds whose updates arrive as a stream.

Clients upload whenever they finish; a round opens with its first upload and
stays open while the next one comes within the round's length, so no hour or
day boundary can cut it. Its mean is published once, when a timeout has passed.
The watermark is the timeout: updates later than that are left out, as a server
that gave up waiting would. A client counts once a round, with the first upload
that arrived. State is one partial sum per open round and position, and the ids
of the clients that a round has counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.session import scratch_path

UPLOAD = "round int, client_id bigint, n_examples bigint, params array<double>, sent_at timestamp"


def read_uploads(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(UPLOAD)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def round_means(uploads: DataFrame, round_length: str, timeout: str, weighted: bool = True) -> DataFrame:
    """(round, idx, value, n_clients) of every round, published when its timeout has passed."""
    weight = F.col("n_examples").cast("double") if weighted else F.lit(1.0)
    once = uploads.withWatermark("sent_at", timeout).dropDuplicatesWithinWatermark(["round", "client_id"])
    long = once.select(
        "round", "sent_at", weight.alias("w"), F.posexplode("params").alias("idx", "v")
    )
    sums = long.groupBy(F.session_window("sent_at", round_length), "round", "idx").agg(
        F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("t"), F.count("*").alias("n_clients")
    )
    return sums.select("round", "idx", (F.col("s") / F.nullif(F.col("t"), F.lit(0.0))).alias("value"), "n_clients")


def run_available(stream: DataFrame, name: str) -> str:
    """Process what has arrived, append the closed rounds to a table in the shared folder, return its path."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", path).option("checkpointLocation", scratch_path(spark, f"{name}_progress")).start()
    )
    query.awaitTermination()
    return path
