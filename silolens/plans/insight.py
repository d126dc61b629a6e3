"""Queries over clustering and explanations (K, X, R7)."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.functions import net
from silolens.operators import cluster, explain, report, scale, surrogate
from silolens.plans import fixtures as fx
from silolens.plans import modeling
from silolens.plans.fixtures import FEATURES, K, KEYS, LOGIT, LOGIT4, NUMERIC, r, rounded, rounded_rows
from silolens.plans.modeling import COLS
from silolens.plans.registry import query
from silolens.session import cut_lineage, local_table

N_CLUSTERS = 3
D = len(FEATURES)
START = cluster.init_centroids(N_CLUSTERS, D, fx.SEED)

# --- clustering ------------------------------------------------------------------------------


def start_sql(k: int, d: int, name: str) -> str:
    """Initial centroids from hashes, made in SQL."""
    cols = ", ".join(f"{fx.lit(2)} * {fx.uniform(fx.md5(fx.SEED, "'centroid'", 'cluster', j))} - 1 AS c{j}" for j in range(d))
    return f"{name} AS (SELECT cluster, {cols} FROM (SELECT unnest(range(0, {k})) AS cluster) q)"


def assign_sql(centers: str, name: str, k: int = N_CLUSTERS) -> str:
    """Nearest centroid, the lowest on ties."""
    wide = ", ".join(f"max(c{j}) FILTER (WHERE cluster = {c}) AS c{c}_{j}" for c in range(k) for j in range(D))
    dist = ", ".join("(" + " + ".join(f"({col} - c{c}_{j}) * ({col} - c{c}_{j})" for j, col in enumerate(COLS)) + f") AS d{c}" for c in range(k))
    best = f"least({', '.join(f'd{c}' for c in range(k))})"
    pick = "CASE " + " ".join(f"WHEN d{c} = {best} THEN {c}" for c in range(k)) + " END"
    return f"{name} AS (SELECT *, {pick} AS cluster FROM (SELECT feat.*, {dist} FROM feat CROSS JOIN (SELECT {wide} FROM {centers}) w) z)"


def pool_sql(assigned: str, old: str, name: str) -> str:
    sums = ", ".join(f"sum({c}) AS s{j}" for j, c in enumerate(COLS))
    cols = ", ".join(f"CASE WHEN p.n > 0 THEN s{j} / p.n ELSE o.c{j} END AS c{j}" for j in range(D))
    return f"""{name} AS (SELECT o.cluster, coalesce(p.n, 0) AS n, {cols} FROM {old} o
        LEFT JOIN (SELECT cluster, count(*) AS n, {sums} FROM {assigned} GROUP BY cluster) p ON o.cluster = p.cluster)"""


BASE = f"{fx.FEAT}, {start_sql(N_CLUSTERS, D, 'ct0')}, {assign_sql('ct0', 'as0')}"
CENTER_COLS = ", ".join(r(f"c{j}") for j in range(D))


def first_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.assign(fx.features(spark, sf), START, FEATURES)


@query("k1_init_centroids", f"""WITH {BASE}, n AS (SELECT cluster, count(*) AS n_rows FROM as0 GROUP BY cluster)
    SELECT CAST(ct0.cluster AS INTEGER) AS cluster, {CENTER_COLS}, coalesce(n_rows, 0) AS n_rows FROM ct0 LEFT JOIN n ON ct0.cluster = n.cluster""")
def init_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed centroids beside the rows each one attracts."""
    counts = cluster.cluster_counts(first_assignment(spark, sf), N_CLUSTERS)
    picks = [F.expr(f"get(array({', '.join(f'{c[j]!r}D' for c in START)}), cluster)").alias(f"c{j}") for j in range(D)]
    return rounded(counts.select("cluster", *picks, "n_rows"))


@query("k2_assign", f"WITH {BASE} SELECT {K}, cluster FROM as0")
def assign(spark: SparkSession, sf: str) -> DataFrame:
    return first_assignment(spark, sf).select(*KEYS, "cluster")


VECTOR_K = 4
VECTOR_D = 64
VECTORS = "vec_id bigint, embedding array<float>, label int"


@query("k2b_assign_vectors", f"""WITH e AS (SELECT vec_id, unnest(range(0, {VECTOR_D})) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    c AS (SELECT cluster, j, {fx.lit(2)} * {fx.uniform(fx.md5(fx.SEED, "'centroid'", 'cluster', 'j'))} - 1 AS v
      FROM (SELECT unnest(range(0, {VECTOR_K})) AS cluster) a CROSS JOIN (SELECT unnest(range(0, {VECTOR_D})) AS j) b),
    d AS (SELECT vec_id, cluster, sum((e.v - c.v) * (e.v - c.v)) AS dist FROM e JOIN c ON e.j = c.j GROUP BY vec_id, cluster)
    SELECT vec_id, CAST(arg_min(cluster, dist) AS INTEGER) AS cluster FROM d GROUP BY vec_id""")
def assign_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.schema(VECTORS).parquet(f"{sf}/embeddings.parquet")
    centers = cluster.init_centroids(VECTOR_K, VECTOR_D, fx.SEED)
    return cluster.assign_vectors(vectors, centers, "embedding").select("vec_id", "cluster")


def _vector_rounds(n: int) -> str:
    """Views ``c0``..``cn``: centroids (cluster, j, v) after each round over the vectors."""
    views = [f"e AS (SELECT vec_id, unnest(range(0, {VECTOR_D})) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
             f"""c0 AS (SELECT cluster, j, {fx.lit(2)} * {fx.uniform(fx.md5(fx.SEED, "'centroid'", 'cluster', 'j'))} - 1 AS v
      FROM (SELECT unnest(range(0, {VECTOR_K})) AS cluster) a CROSS JOIN (SELECT unnest(range(0, {VECTOR_D})) AS j) b)"""]
    for i in range(n):
        views.append(f"d{i} AS (SELECT vec_id, cluster, sum((e.v - c.v) * (e.v - c.v)) AS dist FROM e JOIN c{i} c ON e.j = c.j GROUP BY vec_id, cluster)")
        views.append(f"a{i} AS (SELECT vec_id, arg_min(cluster, dist) AS cluster FROM d{i} GROUP BY vec_id)")
        views.append(f"m{i} AS (SELECT cluster, j, avg(v) AS v FROM e JOIN a{i} USING (vec_id) GROUP BY cluster, j)")
        views.append(f"c{i + 1} AS (SELECT c.cluster, c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster AND m.j = c.j)")
    return ", ".join(views)


VECTOR_ROUNDS = 3


@query("k6b_fit_vectors", f"""WITH {_vector_rounds(VECTOR_ROUNDS)} SELECT CAST(cluster AS INTEGER) AS cluster, CAST(j AS INTEGER) AS j, {r('v', 'value')} FROM c{VECTOR_ROUNDS}""")
def fit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of pooled k-means over wide vectors; labels are the clients."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").alias("client_id"), "embedding")
    centers, _ = cluster.fit_vectors(vectors, cluster.init_centroids(VECTOR_K, VECTOR_D, fx.SEED), "embedding", VECTOR_ROUNDS)
    return rounded(local_table(spark, [(c, j, v) for c, row in enumerate(centers) for j, v in enumerate(row)], "cluster int, j int, value double"))


# Axes have no covariance between them, and all of them together keep the trace.
@query("k10d_vector_axes", f"""WITH e AS (SELECT vec_id, unnest(range(0, {VECTOR_D})) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS n_rows, CAST(0 AS DOUBLE) AS cross, TRUE AS ordered,
    {r(f"(SELECT sum(t) FROM (SELECT var_pop(v) AS t FROM e GROUP BY j) s)", 'trace')}""")
def vector_axes(spark: SparkSession, sf: str) -> DataFrame:
    """All principal axes of the vectors, judged by their projections."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    _, mean, cov = cluster.vector_moments(vectors, "embedding", VECTOR_D)
    pcs = cluster.project_vectors(vectors, mean, cluster.leading_axes(cov, VECTOR_D), "embedding", ["vec_id"])
    total = " + ".join(f"var_pop(pcs[{i}])" for i in range(VECTOR_D))
    return rounded(pcs.selectExpr("count(*) AS n_rows", "abs(covar_pop(pcs[0], pcs[1])) AS cross", "var_pop(pcs[0]) >= var_pop(pcs[1]) AS ordered", f"{total} AS trace"))


@query("k3_client_partials", f"""WITH {BASE} SELECT client_id, cluster, count(*) AS n, {', '.join(r(f'sum({c})', f's{j}', 3) for j, c in enumerate(COLS))}
    FROM as0 GROUP BY client_id, cluster""")
def client_partials(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cluster.client_partials(first_assignment(spark, sf), FEATURES), 3)


POOLED = f"{BASE}, {pool_sql('as0', 'ct0', 'ct1')}"


@query("k4_pooled_centroids", f"WITH {POOLED} SELECT CAST(cluster AS INTEGER) AS cluster, n, {CENTER_COLS} FROM ct1")
def pooled_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cluster.pool(cluster.client_partials(first_assignment(spark, sf), FEATURES), START))


FAR = [[50.0] * D, *START[1:]]


@query("k4b_empty_cluster", f"""WITH {fx.FEAT}, far AS (SELECT * FROM ({' UNION ALL '.join('SELECT ' + str(c) + ' AS cluster, ' + ', '.join(f'{fx.lit(v)} AS c{j}' for j, v in enumerate(row)) for c, row in enumerate(FAR))})),
    {assign_sql('far', 'asf')}, {pool_sql('asf', 'far', 'ctf')} SELECT cluster, n, {CENTER_COLS} FROM ctf""")
def empty_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """A centroid no row is near keeps its place."""
    assigned = cluster.assign(fx.features(spark, sf), FAR, FEATURES)
    return rounded(cluster.pool(cluster.client_partials(assigned, FEATURES), FAR))


ROUNDS = 5
FIT = POOLED + "".join(f", {assign_sql(f'ct{i}', f'as{i}')}, {pool_sql(f'as{i}', f'ct{i}', f'ct{i + 1}')}" for i in range(1, ROUNDS))
SHIFT = "sqrt(" + " + ".join(f"(a.c{j} - b.c{j}) * (a.c{j} - b.c{j})" for j in range(D)) + ")"


def fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, cluster.Centroids, list[float]]:
    rows = fx.features(spark, sf)
    centers, moves = cluster.fit(rows, START, FEATURES, ROUNDS)
    return rows, centers, moves


@query("k5_movement", f"WITH {FIT} " + " UNION ALL ".join(
    f"SELECT {i + 1} AS round, {r(f'avg({SHIFT})', 'movement')} FROM ct{i} a JOIN ct{i + 1} b ON a.cluster = b.cluster" for i in range(ROUNDS)))
def movement(spark: SparkSession, sf: str) -> DataFrame:
    _, _, moves = fitted(spark, sf)
    return rounded(spark.createDataFrame([(i + 1, m) for i, m in enumerate(moves)], "round int, movement double"))


LAST = f"ct{ROUNDS}"


# The full five rounds, unrolled on the SQL side.
@query("k6_fit_rounds", f"WITH {FIT} SELECT CAST(cluster AS INTEGER) AS cluster, {CENTER_COLS} FROM {LAST}")
def fit_rounds(spark: SparkSession, sf: str) -> DataFrame:
    _, centers, _ = fitted(spark, sf)
    schema = "cluster int, " + ", ".join(f"c{j} double" for j in range(D))
    return rounded(spark.createDataFrame([(i, *c) for i, c in enumerate(centers)], schema))


FINAL = f"{FIT}, {assign_sql(LAST, 'asz')}"


@query("k7_client_distribution", f"""WITH {FINAL} SELECT client_id, count(*) AS n,
    {', '.join(f'count(*) FILTER (WHERE cluster = {c}) AS n_c{c}, round(count(*) FILTER (WHERE cluster = {c}) / CAST(count(*) AS DOUBLE), 4) AS f_c{c}' for c in range(N_CLUSTERS))}
    FROM asz GROUP BY client_id""")
def client_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows, centers, _ = fitted(spark, sf)
    return cluster.client_distribution(cluster.assign(rows, centers, FEATURES), N_CLUSTERS)


@query("k8_cluster_counts", f"WITH {FINAL} SELECT CAST(ct.cluster AS INTEGER) AS cluster, count(asz.cluster) AS n_rows FROM {LAST} ct LEFT JOIN asz ON ct.cluster = asz.cluster GROUP BY ct.cluster")
def cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows, centers, _ = fitted(spark, sf)
    return cluster.cluster_counts(cluster.assign(rows, centers, FEATURES), N_CLUSTERS)


NEAR = "CASE WHEN 0 <= 1 - 2 * c4 AND 0 <= 1 - 2 * c5 THEN 0 WHEN 1 - 2 * c4 <= 1 - 2 * c5 THEN 1 ELSE 2 END"


@query("k9_centroid_profiles", f"""WITH {FIT} SELECT CAST(cluster AS INTEGER) AS cluster, {', '.join(r(f'c{j} * s_{c} + m_{c}', c) for j, c in enumerate(NUMERIC))},
    CAST({NEAR} = 1 AS DOUBLE) AS "type_N", CAST({NEAR} = 2 AS DOUBLE) AS "type_R" FROM {LAST} CROSS JOIN feat_st""")
def centroid_profiles(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.readings(spark, sf)
    stats = scale.fit(raw, NUMERIC, ["type"])
    centers, _ = cluster.fit(scale.transform(raw, stats, [*KEYS, "client_id"]), START, FEATURES, ROUNDS)
    return rounded(cluster.centroid_profiles(raw, centers, stats))


@query("k10_pca_projection")
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.features(spark, sf)
    means, axes = cluster.principal_axes(rows, FEATURES)
    return cluster.project(rows, means, axes, FEATURES, KEYS)


# Axes are unit vectors without cross products, and projections have no covariance; the variances add up below the trace.
@query("k10c_axes_quality", f"""WITH {fx.FEAT} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS DOUBLE) AS mean1, CAST(0 AS DOUBLE) AS mean2,
    CAST(0 AS DOUBLE) AS cross, TRUE AS ordered, TRUE AS below_trace,
    {r(f"{' + '.join(f'var_pop({c})' for c in COLS)}", 'trace')} FROM feat""")
def axes_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.features(spark, sf)
    means, axes = cluster.principal_axes(rows, FEATURES, D)
    out = cluster.project(rows, means, axes, FEATURES, KEYS)
    total = " + ".join(f"var_pop(pc{i + 1})" for i in range(D))
    checked = out.selectExpr(
        "count(*) AS n_rows", "avg(pc1) AS mean1", "avg(pc2) AS mean2", "covar_pop(pc1, pc2) AS cross", "var_pop(pc1) >= var_pop(pc2) AS ordered",
        f"var_pop(pc1) + var_pop(pc2) < {total} AS below_trace", f"{total} AS trace")
    return rounded(checked).withColumns({c: F.abs(F.col(c)) for c in ("mean1", "mean2", "cross")})


@query("k11_clustering_report", f"""WITH {FINAL},
    mv AS ({' UNION ALL '.join(f"SELECT {i + 1} AS round, avg({SHIFT}) AS movement FROM ct{i} a JOIN ct{i + 1} b ON a.cluster = b.cluster" for i in range(ROUNDS))}),
    cl AS (SELECT client_id, count(*) AS n FROM asz GROUP BY client_id)
    SELECT 'movement' AS section, CAST(round AS VARCHAR) AS item, CAST(-1 AS INTEGER) AS cluster, {r('movement', 'value')} FROM mv
    UNION ALL {' UNION ALL '.join(f"SELECT 'centroid', '{j}', CAST(cluster AS INTEGER), {r(f'c{j}', 'value')} FROM {LAST}" for j in range(D))}
    UNION ALL SELECT 'rows', 'all', CAST(ct.cluster AS INTEGER), CAST(count(asz.cluster) AS DOUBLE) FROM {LAST} ct LEFT JOIN asz ON ct.cluster = asz.cluster GROUP BY ct.cluster
    UNION ALL SELECT 'share', CAST(cl.client_id AS VARCHAR), CAST(ct.cluster AS INTEGER), round(count(asz.cluster) / CAST(max(cl.n) AS DOUBLE), 4)
      FROM cl CROSS JOIN {LAST} ct LEFT JOIN asz ON asz.client_id = cl.client_id AND asz.cluster = ct.cluster GROUP BY cl.client_id, ct.cluster""")
def clustering_report(spark: SparkSession, sf: str) -> DataFrame:
    rows, centers, moves = fitted(spark, sf)
    return rounded(cluster.report(rows, centers, moves, FEATURES))


@query("k10b_covariance", f"WITH {fx.FEAT} " + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, {r(f'covar_pop({COLS[i]}, {COLS[j]})', 'cov')} FROM feat" for i in range(D) for j in range(i, D)))
def covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cluster.covariance(fx.features(spark, sf), FEATURES))


# --- Shapley values --------------------------------------------------------------------------

BACKGROUND = 60
D4 = len(NUMERIC)
SAMPLE = f"bg AS (SELECT {K}, x1, x2, x3, x4 FROM feat ORDER BY {fx.key_md5('background')}, {K} LIMIT {BACKGROUND})"


@query("x1_background", f"WITH {fx.FEAT}, {SAMPLE} SELECT {K}, {', '.join(r(c) for c in NUMERIC)} FROM bg")
def background(spark: SparkSession, sf: str) -> DataFrame:
    sample = explain.background_sample(fx.features(spark, sf), KEYS, BACKGROUND, fx.SEED)
    return rounded(sample.select(*KEYS, *NUMERIC))


@query("x2_base_value", f"WITH {fx.FEAT}, {SAMPLE} SELECT {r(f'avg({fx.sigmoid(fx.logit(NUMERIC, LOGIT4))})', 'base_value')} FROM bg")
def base_value(spark: SparkSession, sf: str) -> DataFrame:
    sample = explain.background_sample(fx.features(spark, sf), KEYS, BACKGROUND, fx.SEED)
    return rounded(net.score(sample, LOGIT4, (D4, 1), NUMERIC).agg(F.avg("p1").alias("base_value")))


def shapley_sql() -> str:
    """All 2^4 coalition means per row, then the weighted differences."""
    def coalition(bits: int) -> str:
        return fx.sigmoid(fx.logit([f"{'f' if bits >> j & 1 else 'g'}.{c}" for j, c in enumerate(NUMERIC)], LOGIT4))

    keys = ", ".join("f." + k for k in KEYS)
    means = ", ".join(f"avg({coalition(b)}) AS v{b}" for b in range(1 << D4))
    phis = []
    for j in range(D4):
        terms = []
        for b in range(1 << D4):
            if not b >> j & 1:
                s = b.bit_count()
                w = math.factorial(s) * math.factorial(D4 - 1 - s) / math.factorial(D4)
                terms.append(f"{fx.lit(w)} * (v{b | 1 << j} - v{b})")
        phis.append(f"({' + '.join(terms)}) AS phi{j}")
    return f"""{fx.FEAT}, {SAMPLE}, co AS (SELECT {keys}, {means} FROM feat f CROSS JOIN bg g GROUP BY {keys}),
    ph AS (SELECT {K}, v0 AS base, v{(1 << D4) - 1} AS pred, {', '.join(phis)} FROM co),
    phl AS ({' UNION ALL '.join(f"SELECT {K}, '{c}' AS feature, phi{j} AS phi, base FROM ph" for j, c in enumerate(NUMERIC))})"""


SHAP = shapley_sql()


def attributed(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    rows = net.score(fx.features(spark, sf), LOGIT4, (D4, 1), NUMERIC)
    ground = explain.collect_background(rows, NUMERIC, KEYS, BACKGROUND, fx.SEED)
    score = explain.net_score_fn(LOGIT4, (D4, 1))
    return explain.shapley_values(rows, score, ground, NUMERIC), float(score(ground).mean())


@query("x3_shapley_logistic", f"WITH {SHAP} SELECT {K}, feature, {r('phi')} FROM phl")
def shapley_logistic(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = attributed(spark, sf)
    return rounded_rows(explain.long_attributions(rows, NUMERIC, KEYS))


MLP = (6, 8, 4, 1)


@query("x3b_shapley_mlp")
def shapley_mlp(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.features(spark, sf)
    ground = explain.collect_background(rows, FEATURES, KEYS, BACKGROUND, fx.SEED)
    score = explain.net_score_fn(net.init_params(MLP, fx.SEED), MLP)
    return explain.long_attributions(explain.shapley_values(rows, score, ground, FEATURES), FEATURES, KEYS)


# All 14 coalitions of four features fit the budget, so the regression gives the exact values.
@query("x3c_kernel_shapley", f"WITH {SHAP} SELECT {K}, feature, {r('phi')} FROM phl")
def kernel_shapley(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.features(spark, sf)
    ground = explain.collect_background(rows, NUMERIC, KEYS, BACKGROUND, fx.SEED)
    out = explain.shapley_values(rows, explain.net_score_fn(LOGIT4, (D4, 1)), ground, NUMERIC, method="kernel", seed=fx.SEED)
    return rounded_rows(explain.long_attributions(out, NUMERIC, KEYS))


WIDE = [f"e{j}" for j in range(VECTOR_D)]
WIDE_WEIGHTS = [(-1) ** j * (j + 1) / VECTOR_D for j in range(VECTOR_D)]


# An additive score has known values, weight x (value - background mean), which drawn coalitions must give too.
@query("x3d_wide_shapley", f"""WITH e AS (SELECT vec_id, unnest(range(0, {VECTOR_D})) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    ids AS (SELECT vec_id FROM embeddings ORDER BY {fx.md5(fx.SEED, "'background'", 'vec_id')}, vec_id LIMIT {BACKGROUND}),
    m AS (SELECT j, avg(v) AS v FROM e JOIN ids USING (vec_id) GROUP BY j)
    SELECT vec_id, 'e' || CAST(e.j AS VARCHAR) AS feature, {r(f"CASE WHEN e.j % 2 = 0 THEN 1 ELSE -1 END * (e.j + 1) / {fx.lit(VECTOR_D)} * (e.v - m.v)", 'phi')} FROM e JOIN m ON e.j = m.j""")
def wide_shapley(spark: SparkSession, sf: str) -> DataFrame:
    """Kernel regression over 64 features, for every vector."""
    vectors = spark.read.schema(VECTORS).parquet(f"{sf}/embeddings.parquet")
    rows = vectors.select("vec_id", *[F.expr(f"cast(get(embedding, {j}) AS double)").alias(c) for j, c in enumerate(WIDE)])
    ground = explain.collect_background(rows, WIDE, ["vec_id"], BACKGROUND, fx.SEED)
    out = explain.shapley_values(rows, explain.linear_score(WIDE_WEIGHTS), ground, WIDE, method="kernel", seed=fx.SEED)
    return rounded(explain.long_attributions(out, WIDE, ["vec_id"]))


@query("x4_shap_importance", f"WITH {SHAP} SELECT feature, {r('avg(abs(phi))', 'importance')} FROM phl GROUP BY feature")
def shap_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = attributed(spark, sf)
    return rounded(explain.mean_abs_importance(rows, NUMERIC)).orderBy(F.col("importance").desc(), "feature")


WATERFALL = f"""wf AS (SELECT *, row_number() OVER w AS pos, sum(phi) OVER w AS run FROM phl
    WINDOW w AS (PARTITION BY {K} ORDER BY abs(phi) DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("x5_waterfall", f"""WITH {SHAP}, {WATERFALL} SELECT {K}, CAST(pos AS INTEGER) AS pos, feature, {r('phi')},
    {r('base + run - phi', 'bar_start')}, {r('base + run', 'bar_end')} FROM wf""")
def waterfall(spark: SparkSession, sf: str) -> DataFrame:
    rows, base = attributed(spark, sf)
    return rounded_rows(explain.waterfall(rows, NUMERIC, base, KEYS))


@query("x6_additivity", f"""WITH {SHAP} SELECT count(*) AS n_rows, {r('max(abs(base + phi0 + phi1 + phi2 + phi3 - pred))', 'max_error', 9)} FROM ph""")
def additivity(spark: SparkSession, sf: str) -> DataFrame:
    rows, base = attributed(spark, sf)
    return rounded(explain.additivity_error(rows, base, "p1"), 9)


# --- local surrogates ------------------------------------------------------------------------

SURROGATE_SAMPLES = 5000


@query("x7_lime")
def lime(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.features(spark, sf).select(*KEYS, *FEATURES)
    score = explain.net_score_fn(LOGIT, (6, 1))
    out = surrogate.lime(rows, rows, score, FEATURES, SURROGATE_SAMPLES, 4, fx.SEED)
    return explain.weight_rows(explain.top_weights(out, FEATURES, 4, [*KEYS, "predicted_class"]), [*KEYS, "predicted_class"])


CUTS = ", ".join(f"quantile_cont({c}, {q}) AS q_{c}_{i}" for c in NUMERIC for i, q in enumerate(surrogate.QUARTILES))
BINS = ", ".join("(" + " + ".join(f"CAST({c} > q_{c}_{i} AS INTEGER)" for i in range(3)) + f") AS b_{c}" for c in NUMERIC)
BINNED = f"{fx.READINGS}, qs AS (SELECT {CUTS} FROM readings), bn AS (SELECT readings.*, {BINS} FROM readings CROSS JOIN qs)"


@query("x7b_quartile_bins", f"""WITH {BINNED} {' UNION ALL '.join(
    f"SELECT '{c}' AS feature, b_{c} AS bin, count(*) AS n, {r(f'avg({c})', 'mean')}, {r(f'stddev_pop({c})', 'std')}, {r(f'min({c})', 'lo')}, {r(f'max({c})', 'hi')} FROM bn GROUP BY b_{c}"
    for c in NUMERIC)}""")
def quartile_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.readings(spark, sf)
    cuts = surrogate.quartile_cuts(rows, NUMERIC)
    stats = surrogate.bin_stats(rows, NUMERIC, cuts)
    n = rows.count()
    table = [(c, b, round(s[0] * n), *s[1:]) for c in NUMERIC for b, s in enumerate(stats.bins[c])]
    return rounded(spark.createDataFrame(table, "feature string, bin int, n bigint, mean double, std double, lo double, hi double"))


DRAWS = 64


def drawn_sql() -> str:
    """Drawn bins of every perturbed sample: hash-uniforms against the bins' cumulative shares."""
    shares = ", ".join(f"avg(CAST(b_{c} <= {b} AS DOUBLE)) AS e_{c}_{b}" for c in NUMERIC for b in range(3))
    cols = ", ".join(
        "(" + " + ".join(f"CAST({fx.uniform(fx.md5(fx.SEED, "'bin'", 'i', j))} >= e_{c}_{b} AS INTEGER)" for b in range(3)) + f") AS d_{c}"
        for j, c in enumerate(NUMERIC)
    )
    return f"sh AS (SELECT {shares} FROM bn), dr AS (SELECT i, {cols} FROM (SELECT unnest(range(0, {DRAWS - 1})) AS i) s CROSS JOIN sh)"


SAME = ", ".join(f"CAST(b_{c} = d_{c} AS INTEGER) AS z{j}" for j, c in enumerate(NUMERIC))
KERNEL = f"sqrt(exp(-({D4} - z0 - z1 - z2 - z3) / {fx.lit((0.75 * math.sqrt(D4)) ** 2)}))"
PAIRS = list(itertools.combinations_with_replacement(range(D4), 2))


# Moments depend on a row's bins only, so the SQL sums them per bin pattern too.
@query("x7c_weighted_moments", f"""WITH {BINNED}, {drawn_sql()},
    pt AS (SELECT DISTINCT {', '.join(f'b_{c}' for c in NUMERIC)} FROM bn),
    zz AS (SELECT *, {KERNEL} AS w FROM (SELECT pt.*, {SAME} FROM pt CROSS JOIN dr) s),
    mo AS (SELECT {', '.join(f'b_{c}' for c in NUMERIC)}, 1 + sum(w) AS m, {', '.join(f'1 + sum(w * z{a} * z{b}) AS m{a}{b}' for a, b in PAIRS)}
      FROM zz GROUP BY {', '.join(f'b_{c}' for c in NUMERIC)})
    SELECT {', '.join('bn.' + k for k in KEYS)}, {r('m')}, {', '.join(r(f'm{a}{b}') for a, b in PAIRS)}
    FROM bn JOIN mo ON {' AND '.join(f'bn.b_{c} = mo.b_{c}' for c in NUMERIC)}""")
def weighted_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.readings(spark, sf).select(*KEYS, *NUMERIC)
    flat = explain.net_score_fn([0.0] * (D4 + 1), (D4, 1))
    out = surrogate.row_moments(rows, rows, flat, NUMERIC, DRAWS, fx.SEED)
    d = D4 + 2
    cols = [F.expr(f"moments[{(a + 1) * d + b + 1}]").alias(f"m{a}{b}") for a, b in PAIRS]
    return rounded(out.select(*KEYS, F.expr("moments[0]").alias("m"), *cols))


TOP_K = 3


def surrogates(spark: SparkSession, sf: str) -> DataFrame:
    """Every row's surrogate of the logistic model: its predicted class and one weight a feature."""
    rows = fx.features(spark, sf).select(*KEYS, *FEATURES)
    return surrogate.lime(rows, rows, explain.net_score_fn(LOGIT, (6, 1)), FEATURES, SURROGATE_SAMPLES, len(FEATURES), fx.SEED)


@query("x8_lime_topk")
def lime_topk(spark: SparkSession, sf: str) -> DataFrame:
    return explain.weight_rows(explain.top_weights(surrogates(spark, sf), FEATURES, TOP_K, KEYS), KEYS)


@query("x9_lime_importance")
def lime_importance(spark: SparkSession, sf: str) -> DataFrame:
    return explain.global_weights(explain.top_weights(surrogates(spark, sf), FEATURES, TOP_K, KEYS))


@query("r7_lime_rows")
def lime_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.lime_table(explain.top_weights(surrogates(spark, sf), FEATURES, TOP_K, [*KEYS, "predicted_class"]), KEYS)


# A linear model's exact contributions w * x: what SQL can follow of ranking and averaging attributions.
CONTRIB = f"""cw AS ({' UNION ALL '.join(f"SELECT {K}, '{c}' AS feature, {col} * {fx.lit(w)} AS weight FROM feat" for c, col, w in zip(FEATURES, COLS, LOGIT))}),
    cr AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY abs(weight) DESC, feature) AS pos FROM cw)"""


def contributions(spark: SparkSession, sf: str) -> DataFrame:
    terms = ", ".join(f"`{c}` * {w!r}D" for c, w in zip(FEATURES, LOGIT))
    return fx.features(spark, sf).withColumn("weights", F.expr(f"array({terms})"))


@query("x8b_top_contributions", f"WITH {fx.FEAT}, {CONTRIB} SELECT {K}, CAST(pos AS INTEGER) AS pos, feature, {r('weight')} FROM cr WHERE pos <= {TOP_K}")
def top_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(explain.weight_rows(explain.top_weights(contributions(spark, sf), FEATURES, TOP_K, KEYS), KEYS))


@query("x9b_mean_contributions", f"""WITH {fx.FEAT}, {CONTRIB} SELECT feature, {r('sum(abs(weight)) / (SELECT count(*) FROM feat)', 'importance')}
    FROM cr WHERE pos <= {TOP_K} GROUP BY feature""")
def mean_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(explain.global_weights(explain.top_weights(contributions(spark, sf), FEATURES, TOP_K, KEYS)))


@query("x10_predictions", f"""WITH {fx.FEAT}, {fx.scored('feat')} SELECT {K}, target AS y_true, CAST(p1 >= 0.5 AS INTEGER) AS y_pred, {r('p1', 'prob_failure')} FROM sc""")
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(explain.prediction_table(fx.features(spark, sf), LOGIT, (6, 1), FEATURES, KEYS))


@query("x11_explain_report")
def explain_report(spark: SparkSession, sf: str) -> DataFrame:
    """A trained model's explanation run over every held-out row, summarised per feature."""
    rows = cut_lineage(fx.prepared(spark, sf)[0], "prepared")  # read by some twenty jobs, none of which splits and scales anew
    tr, te = rows.where("split = 'train'"), rows.where("split = 'test'")
    run = modeling.trained_run(spark, sf, "federated", (tr, te))
    tables = report.explain_run(te, tr, run, FEATURES, KEYS)
    local = explain.global_weights(tables["lime"]).withColumnRenamed("importance", "lime_importance")
    return tables["shap_importance"].withColumnRenamed("importance", "shap_importance").join(local, "feature", "left")

