"""Queries over client updates, privacy, the experiment log and run reports (A7-A10, F1-F8, F11, P, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.functions import net
from silolens.operators import aggregate, metrics, privacy, report, scale, split, train
from silolens.plans import fixtures as fx
from silolens.plans import modeling, prepare
from silolens.plans.fixtures import FEATURES, K, KEYS, LOGIT, NUMERIC, r, rounded
from silolens.plans.modeling import SCORED
from silolens.plans.registry import query
from silolens.session import scratch_path
from silolens.sources import track
from silolens.streaming import rounds as rounds_stream

WIDTH = fx.UPDATE_WIDTH
IDX_VALUE = f"round, idx, {r('value')}"

# --- aggregation -----------------------------------------------------------------------------

MEAN = "m AS (SELECT round, idx, sum(value * n_examples) / sum(n_examples) AS value FROM updl GROUP BY round, idx)"


@query("f1_fedavg_weighted", f"WITH {fx.UPDATES}, {MEAN} SELECT {IDX_VALUE} FROM m")
def fedavg_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aggregate.fedavg(fx.updates(spark, sf)))


@query("f2_fedavg_uniform", f"WITH {fx.UPDATES} SELECT round, idx, {r('avg(value)', 'value')} FROM updl GROUP BY round, idx")
def fedavg_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aggregate.fedavg(fx.updates(spark, sf), weight=None))


@query("f3_comm_bytes", f"WITH {fx.UPDATES} SELECT round, count(*) AS n_clients, CAST({WIDTH} AS BIGINT) AS n_params, count(*) * {WIDTH} * 4 AS comm_bytes FROM upd GROUP BY round")
def comm_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.communication(fx.updates(spark, sf))


FRACTION = 0.3
SAMPLED = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY {fx.md5(fx.SEED, "'sample'", 'round', 'client_id')}) AS rn,
    count(*) OVER (PARTITION BY round) AS n FROM upd),
    drawn AS (SELECT * FROM rk WHERE rn <= greatest(1, round_even(CAST(n AS DOUBLE) * {fx.lit(FRACTION)}, 0)))"""


@query("f5_client_sampling", f"WITH {fx.UPDATES}, {SAMPLED} SELECT round, client_id FROM drawn")
def client_sampling(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.sample_clients(fx.updates(spark, sf).select("round", "client_id"), FRACTION, fx.SEED)


@query("f6_round_aggregate", f"""WITH {fx.UPDATES}, {SAMPLED},
    dl AS (SELECT updl.* FROM updl JOIN drawn ON updl.round = drawn.round AND updl.client_id = drawn.client_id)
    SELECT round, idx, {r('sum(value * n_examples) / sum(n_examples)', 'value')}, count(*) AS n_clients FROM dl GROUP BY round, idx""")
def round_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Sample participants, then average what they sent."""
    ups = fx.updates(spark, sf)
    drawn = aggregate.sample_clients(ups, FRACTION, fx.SEED)
    counts = drawn.groupBy("round").agg(F.count("*").alias("n_clients"))
    return rounded(aggregate.aggregate_round(drawn).join(counts, "round"))


@query("f7_fit_metrics", f"WITH {fx.UPDATES} SELECT round, {r('sum(loss * n_examples) / sum(n_examples)', 'loss')} FROM upd GROUP BY round")
def fit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aggregate.fit_metrics(fx.updates(spark, sf)))


@query("f8_eval_metrics", f"WITH {SCORED}, {modeling.BY_SUPPLIER} SELECT round, {modeling.WEIGHTED} FROM cm GROUP BY round")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aggregate.eval_metrics(modeling.client_metrics(spark, sf)))


ROUND_ROWS = f"""{SCORED}, upd AS (SELECT CAST(k4 AS INTEGER) AS round, k3 AS client_id FROM readings GROUP BY 1, 2),
    cb AS (SELECT round, count(*) AS n_clients, count(*) * {WIDTH} * 4 AS comm_bytes FROM upd GROUP BY round),
    ev AS (SELECT CAST(k4 AS INTEGER) AS round, count(*) AS n_rows, avg({fx.log_loss('p1', 'target')}) AS loss,
      {', '.join(f'{e} AS {n}' for n, e in fx.metric_select().items())} FROM pr GROUP BY 1),
    rounds AS (SELECT ev.*, n_clients, comm_bytes FROM ev JOIN cb ON ev.round = cb.round)"""


def rounds(spark: SparkSession, sf: str) -> DataFrame:
    """One row per round: line numbers as rounds, each evaluated with the fixed model."""
    scored = modeling.scored(spark, sf).withColumns({"round": F.col("k4").cast("int"), "y_true": F.col("target")})
    comm = aggregate.communication(fx.updates(spark, sf)).drop("n_params")
    return metrics.evaluate(scored, by=["round"]).join(comm, "round")


METRIC_R = ", ".join(r(m) for m in metrics.METRICS)


@query("f11_round_summary", f"""WITH {ROUND_ROWS} SELECT round, n_clients, n_rows, {r('loss')}, {METRIC_R}, comm_bytes,
    CAST(sum(comm_bytes) OVER (ORDER BY round) AS BIGINT) AS total_bytes FROM rounds""")
def round_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregate.round_summary(rounds(spark, sf).withColumn("run_id", F.lit("run")))
    return rounded(out.drop("run_id"))


# --- privacy ---------------------------------------------------------------------------------

CLIP, SIGMA = 0.8, 0.5
SECRET = "fixture-secret"
NORM = "sqrt(p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3 + p4 * p4)"
NORMS = f"nm AS (SELECT round, client_id, {NORM} AS size FROM upd)"
CLIPPED = f"""{NORMS}, cp AS (SELECT updl.round, updl.client_id, idx,
    value * CASE WHEN size > {fx.lit(CLIP)} THEN {fx.lit(CLIP)} / size ELSE 1 END AS value
    FROM updl JOIN nm ON updl.round = nm.round AND updl.client_id = nm.client_id)"""
NOISE = f"{fx.lit(CLIP * SIGMA)} * {fx.gaussian(fx.md5(fx.SEED, "'update'", 'round', 'client_id', 'idx'))}"
LONG = f"round, client_id, idx, {r('value')}"


def long(df: DataFrame, col: str = "params") -> DataFrame:
    return df.select("round", "client_id", F.posexplode(col).alias("idx", "value"))


@query("p1_clip_update", f"WITH {fx.UPDATES}, {CLIPPED} SELECT {LONG} FROM cp")
def clip_update(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(long(privacy.clip_update(fx.updates(spark, sf), CLIP)))


@query("p2_noise_update", f"WITH {fx.UPDATES} SELECT round, client_id, idx, {r(f'value + {NOISE}', 'value')} FROM updl")
def noise_update(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(long(privacy.noise_update(fx.updates(spark, sf), CLIP, SIGMA, fx.SEED)))


@query("p3_dp_update", f"WITH {fx.UPDATES}, {CLIPPED} SELECT round, client_id, idx, {r(f'value + {NOISE}', 'value')} FROM cp")
def dp_update(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(long(privacy.dp_update(fx.updates(spark, sf), CLIP, SIGMA, fx.SEED)))


@query("p4_privacy_status", f"""WITH {fx.UPDATES}, {NORMS} SELECT round, count(*) AS n_updates,
    count(*) FILTER (WHERE size > {fx.lit(CLIP)}) AS n_clipped, TRUE AS differential_privacy, {fx.lit(SIGMA)} AS noise_multiplier,
    {fx.lit(CLIP)} AS clipping_norm, {fx.lit(CLIP * SIGMA)} AS noise_std, 'not claimed' AS formal_epsilon,
    FALSE AS secure_aggregation FROM nm GROUP BY round""")
def privacy_status(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.privacy_status(fx.updates(spark, sf), True, CLIP, SIGMA, False)


REACH = 2
# Both neighbours within reach on the ring; a pair seen from both ends is kept once.
RING = f"""mem AS (SELECT round, client_id, row_number() OVER (PARTITION BY round ORDER BY {fx.md5(fx.SEED, "'ring'", 'round', 'client_id')}) - 1 AS pos,
    count(*) OVER (PARTITION BY round) AS n FROM upd),
  pr AS (SELECT DISTINCT a.round, least(a.client_id, b.client_id) AS client_a, greatest(a.client_id, b.client_id) AS client_b
    FROM mem a CROSS JOIN (SELECT unnest(range(1, {REACH} + 1)) AS d) o JOIN mem b ON a.round = b.round AND b.pos = (a.pos + d) % a.n
    WHERE a.client_id <> b.client_id),
  ps AS (SELECT *, CAST('0x' || substr(sha256('{SECRET}:' || client_a || ':' || client_b), 1, 8) AS BIGINT) AS pair_seed FROM pr)"""


def stored_updates(spark: SparkSession, sf: str) -> DataFrame:
    """The updates as a table: pairs, masks and counts all read it."""
    path = scratch_path(spark, "updates")
    fx.updates(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def pairs(updates: DataFrame) -> DataFrame:
    return privacy.mask_pairs(updates, SECRET, REACH, fx.SEED)


@query("p5_pair_seeds", f"WITH {fx.UPDATES}, {RING} SELECT round, client_a, client_b, pair_seed FROM ps")
def pair_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(stored_updates(spark, sf))


WORD = "CAST('0x' || substr(" + fx.md5("'mask'", "round", "pair_seed", "idx") + ", 1, 12) AS BIGINT)"
RING_SIZE = 1 << 48
MASKS = f"""{RING}, wd AS (SELECT *, {WORD} AS w FROM ps CROSS JOIN (SELECT unnest(range(0, {WIDTH})) AS idx) i),
  mk AS (SELECT round, client_id, idx, CAST(((sum(w) % {RING_SIZE}) + {RING_SIZE}) % {RING_SIZE} AS BIGINT) AS mask FROM (
    SELECT round, client_a AS client_id, idx, CAST(w AS HUGEINT) AS w FROM wd UNION ALL
    SELECT round, client_b AS client_id, idx, -CAST(w AS HUGEINT) AS w FROM wd) s GROUP BY round, client_id, idx)"""


@query("p6_client_masks", f"WITH {fx.UPDATES}, {MASKS} SELECT round, client_id, idx, mask FROM mk")
def client_masks(spark: SparkSession, sf: str) -> DataFrame:
    masks = privacy.client_masks(pairs(stored_updates(spark, sf)), WIDTH)
    return masks.select("round", "client_id", F.posexplode("mask").alias("idx", "mask"))


FIXED = f"CAST(round(value * {fx.lit(privacy.SCALE)}) AS BIGINT)"


def masked(updates: DataFrame, expected: DataFrame) -> DataFrame:
    return privacy.apply_mask(updates, privacy.client_masks(pairs(updates), WIDTH), expected=expected)


def participants(updates: DataFrame) -> DataFrame:
    return updates.groupBy("round").agg(F.count("*").alias("n"))


@query("p7_masked_updates", f"""WITH {fx.UPDATES}, {MASKS} SELECT mk.round, mk.client_id, mk.idx,
    CAST(((CAST({FIXED} AS HUGEINT) + mask) % {RING_SIZE} + {RING_SIZE}) % {RING_SIZE} AS BIGINT) AS masked
    FROM mk JOIN updl ON mk.round = updl.round AND mk.client_id = updl.client_id AND mk.idx = updl.idx""")
def masked_updates(spark: SparkSession, sf: str) -> DataFrame:
    updates = stored_updates(spark, sf)
    return masked(updates, participants(updates)).select("round", "client_id", F.posexplode("masked").alias("idx", "masked"))


# The check never sees a mask: masked updates must average to the plain fixed-point mean.
@query("p8_secure_aggregate", f"""WITH {fx.UPDATES} SELECT round, idx,
    {r(f'CAST(sum({FIXED}) AS DOUBLE) / {fx.lit(privacy.SCALE)} / count(*)', 'value', 9)} FROM updl GROUP BY round, idx""")
def secure_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    updates = stored_updates(spark, sf)
    expected = participants(updates)
    return rounded(privacy.secure_mean(masked(updates, expected), expected), 9)


# --- log and reports -------------------------------------------------------------------------

BY_TYPE = f"""{fx.FEAT}, {fx.scored('feat')}, prd AS (SELECT *, CAST(p1 >= 0.5 AS INTEGER) AS y_pred FROM sc),
    bt AS (SELECT type, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS n_failures, {', '.join(f'{e} AS {n}' for n, e in fx.metric_select().items())}
    FROM prd GROUP BY type)"""


def by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = net.predict(net.score(fx.features(spark, sf, "type"), LOGIT, (6, 1), FEATURES))
    extra = [F.count("*").alias("n_rows"), F.sum("target").alias("n_failures")]
    cells = metrics.confusion(rows, "target", "y_pred", ["type"], extra)
    return cells.select("type", "n_rows", "n_failures", *[v.alias(n) for n, v in metrics.metric_columns().items()])


@query("a7_experiment_log", f"""WITH {BY_TYPE}, c AS (SELECT client_id, CAST(count(*) AS DOUBLE) AS n_clients_rows FROM feat GROUP BY client_id)
    SELECT 'prepare-' || type AS experiment_id, 'data-preparation' AS name, 'prepare' AS mode, CAST(n_rows AS DOUBLE) AS n_rows, CAST(n_failures AS DOUBLE) AS n_failures, NULL AS accuracy, NULL AS f1, NULL AS client_rows FROM bt
    UNION ALL SELECT 'baseline-' || type, 'baseline', 'baseline', NULL, NULL, {r('accuracy').rsplit(' AS ', 1)[0]}, {r('f1').rsplit(' AS ', 1)[0]}, NULL FROM bt
    UNION ALL SELECT 'client-' || client_id, 'clients', 'federated', NULL, NULL, NULL, NULL, n_clients_rows FROM c""")
def experiment_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three kinds of runs with different columns, appended to one log and read back as one table."""
    path = scratch_path(spark, "log")
    kinds = by_type(spark, sf)
    track.append_log(kinds.select(
        F.concat(F.lit("prepare-"), "type").alias("experiment_id"), F.lit("data-preparation").alias("name"), F.lit("prepare").alias("mode"),
        F.col("n_rows").cast("double"), F.col("n_failures").cast("double")), path)
    track.append_log(kinds.select(
        F.concat(F.lit("baseline-"), "type").alias("experiment_id"), F.lit("baseline").alias("name"), F.lit("baseline").alias("mode"),
        "accuracy", "f1"), path)
    clients = fx.readings(spark, sf).groupBy("client_id").agg(F.count("*").cast("double").alias("client_rows"))
    track.append_log(clients.select(
        F.concat(F.lit("client-"), "client_id").alias("experiment_id"), F.lit("clients").alias("name"), F.lit("federated").alias("mode"),
        "client_rows"), path)
    return rounded(track.read_log(spark, path))


@query("a8_latest_experiments", f"""WITH {fx.UPDATES} SELECT printf('%03d_%08d', round, client_id) AS experiment_id, 'update' AS name,
    'federated' AS mode, n_examples, {r('loss')} FROM upd ORDER BY experiment_id DESC LIMIT 5""")
def latest_experiments(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.updates(spark, sf).select(
        "n_examples", "loss", F.format_string("%03d_%08d", "round", "client_id").alias("experiment_id"),
        F.lit("update").alias("name"), F.lit("federated").alias("mode"),
    )
    return rounded(track.latest_experiments(log, 5))


@query("a8b_latest_runs", f"""WITH {fx.UPDATES} SELECT 'update' AS mode, CAST(client_id AS VARCHAR) AS name, max(printf('%03d_%08d', round, client_id)) AS experiment_id,
    max_by(n_examples, round) AS n_examples, {r('max_by(loss, round)', 'loss')} FROM upd GROUP BY client_id""")
def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Each client's newest run, from a log whose runs were appended round by round under different columns."""
    path = scratch_path(spark, "log")
    ups = fx.updates(spark, sf).select(
        F.format_string("%03d_%08d", "round", "client_id").alias("experiment_id"), F.col("client_id").cast("string").alias("name"),
        F.lit("update").alias("mode"), "n_examples", "loss", (F.col("round") % 2).alias("odd"))
    track.append_log(ups.where("odd = 0").drop("odd"), path)
    track.append_log(ups.where("odd = 1"), path)
    return rounded(track.latest_runs(track.read_log(spark, path)).drop("odd"))


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@query("a9_config_snapshot", """SELECT event_id, event_type || '.' || k AS key, CAST(json_extract_string(props, '$."' || k || '"') AS VARCHAR) AS value
    FROM (SELECT event_id, event_type, props, unnest(json_keys(props)) AS k FROM events) e""")
def config_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's settings under its type as the section, flattened to dotted keys."""
    events = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet")
    return track.flatten_config(events, "event_type", F.from_json("props", "map<string,string>"), ["event_id"])


@query("a10_json_report", f"""WITH {fx.CLIENT_SPLIT}, s AS ({prepare.SUMMARY}) SELECT client_id,
    CAST(json_object('client_id', client_id, 'n_train', n_train, 'n_test', n_test, 'train_positives', train_positives,
    'test_positives', test_positives, 'train_failure_rate', train_failure_rate) AS VARCHAR) AS report FROM s""")
def json_report(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines and read back as text."""
    path = scratch_path(spark, "report")
    track.write_json_report(split.partition_summary(prepare.client_rows(spark, sf)), path)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.client_id").cast("int").alias("client_id"), F.col("value").alias("report"))


PLANNED = train.TrainConfig(hidden=(16, 8), rounds=3)
UPLOAD = PLANNED.rounds * net.n_params(PLANNED.sizes(FEATURES)) * PLANNED.bytes_per_value


@query("r1_variants", f"""WITH {fx.READINGS}, s AS (SELECT count(*) AS n_rows, count(DISTINCT client_id) AS n_clients FROM readings),
    v AS ({' UNION ALL '.join(f"SELECT '{v.name}' AS variant, {v.federated} AS federated, {v.dp} AS dp, {v.explain} AS explain, {v.cluster} AS cluster" for v in report.VARIANTS)})
    SELECT n_rows, n_clients, variant, federated, dp, explain, cluster, CAST(CASE WHEN federated THEN n_clients * {UPLOAD} ELSE 0 END AS BIGINT) AS planned_bytes
    FROM s CROSS JOIN v""")
def variants(spark: SparkSession, sf: str) -> DataFrame:
    return report.variant_plan(fx.readings(spark, sf), PLANNED, len(FEATURES))




_ABLATIONS: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def ablation_runs(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The log and the rows of the ablation ladder, run once per application and table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ABLATIONS:
        path, (tr, te) = scratch_path(spark, "ablation_log"), modeling.sides(spark, sf)
        _ABLATIONS[key] = path, report.run_ablation(tr, te, FEATURES, KEYS, modeling.USUAL, log=path)
    return _ABLATIONS[key]


@query("r2_ablation")
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    return ablation_runs(spark, sf)[1].withColumns({c: F.to_json(c) for c in ("cluster_counts", "shap_importance", "lime_importance")})


SHOWN = ", ".join(r(m, m, 4) for m in metrics.METRICS)
MB_SQL = fx.lit(report.MB)


@query("r3_round_table", f"WITH {ROUND_ROWS} SELECT round, {r('loss', 'loss', 4)}, {SHOWN}, {r(f'comm_bytes / {MB_SQL}', 'comm_mb', 4)} FROM rounds")
def round_table(spark: SparkSession, sf: str) -> DataFrame:
    return report.round_table(rounds(spark, sf))


@query("r4_client_table", f"""WITH {SCORED}, {modeling.BY_SUPPLIER} SELECT client_id, n_rows AS n_test, {SHOWN} FROM cm
    WHERE round = (SELECT max(round) FROM cm)""")
def client_table(spark: SparkSession, sf: str) -> DataFrame:
    return report.client_table(modeling.client_metrics(spark, sf))


@query("r5_client_view", f"""WITH {fx.CLIENT_SPLIT}, s AS ({prepare.SUMMARY}) SELECT client_id, n_train, n_test, train_positives,
    printf('%.2f%%', train_failure_rate * 100) AS failure_rate FROM s""")
def client_view(spark: SparkSession, sf: str) -> DataFrame:
    return report.client_view(split.partition_summary(prepare.client_rows(spark, sf)))


@query("r6_batch_scoring", f"""WITH {SCORED} SELECT {K}, CASE WHEN p1 >= 0.5 THEN 'FAILURE' ELSE 'No failure' END AS label,
    {r('p1')}, {r('confidence')} FROM pr""")
def batch_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Raw units to label and confidence in one projection."""
    raw = fx.readings(spark, sf)
    fitted = scale.fit(raw, NUMERIC, ["type"])
    scored = net.predict(net.score(scale.transform(raw, fitted, KEYS), LOGIT, (6, 1), FEATURES))
    return rounded(report.prediction_labels(scored).select(*KEYS, "label", "p1", "confidence"))


@query("r8_model_comparison")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    found = modeling.latest_models(spark, sf)
    return report.model_comparison(found.where("mode = 'baseline'"), found.where("mode = 'federated'"))


@query("r9_vs_reference")
def vs_published(spark: SparkSession, sf: str) -> DataFrame:
    return report.against_published(modeling.latest_models(spark, sf).select("model", *metrics.METRICS))


@query("r10_ablation_table")
def ablation_table(spark: SparkSession, sf: str) -> DataFrame:
    runs = track.latest_runs(track.read_log(spark, ablation_runs(spark, sf)[0]))
    return report.ablation_table(runs.withColumnRenamed("name", "variant"))


@query("r11_kpis", f"""WITH {ROUND_ROWS} SELECT {r('max_by(accuracy, round)', 'accuracy')}, {r('max_by(f1, round)', 'f1')}, max(round) AS n_rounds,
    {r(f'sum(comm_bytes) / {MB_SQL}', 'total_mb')} FROM rounds""")
def kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.run_kpis(rounds(spark, sf)))


@query("f6b_streamed_rounds", f"""WITH {fx.UPDATES} SELECT round, idx, {r('sum(value * n_examples) / sum(n_examples)', 'value')}, count(*) AS n_clients
    FROM updl GROUP BY round, idx""")
def streamed_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same means from uploads read as a stream; a much later mark closes the last round and stays open itself.

    Uploads of a round are spread over half an hour that crosses the full hour, and every client sends twice.
    """
    path = scratch_path(spark, "uploads")
    sent = F.timestamp_seconds(F.col("round") * 7200 + 2700 + F.pmod(F.col("client_id") * 7, F.lit(1800)))
    ups = fx.updates(spark, sf).select("round", "client_id", "n_examples", "params", sent.alias("sent_at"))
    ups.withColumn("sent_at", F.explode(F.array("sent_at", F.expr("sent_at + interval 1 minute")))).write.parquet(path)
    spark.sql("SELECT 0 AS round, 0L AS client_id, 0L AS n_examples, array(0D) AS params, "
              "timestamp_seconds(1000 * 7200) AS sent_at").write.mode("append").parquet(path)
    means = rounds_stream.round_means(rounds_stream.read_uploads(spark, path), "40 minutes", "30 minutes")
    done = rounds_stream.run_available(means, "streamed_rounds")
    return rounded(spark.read.schema(means.schema).parquet(done))
