"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from silolens.plans import QUERIES  # noqa: E402

HEADLINE = (
    "c1_stratified_split", "c3_scaled_features", "c7_partition_iid", "c9_client_split", "c10_partition_summary",
    "d3_mlp_score", "d3b_wide_net_score", "d7_clipped_gradient_sum", "d10_fedavg_local_train", "d12_client_evaluate",
    "f1_fedavg_weighted", "f10_federated_rounds", "f10b_two_gradient_rounds", "g2b_metrics_by_client", "k3_client_partials",
    "k6_fit_rounds", "k7_client_distribution", "p8_secure_aggregate", "r6_batch_scoring", "x3_shapley_logistic",
    "x4_shap_importance", "x5_waterfall", "x7_lime", "x7c_weighted_moments", "x10_predictions",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-shared-")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{path}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the engine
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": path.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
