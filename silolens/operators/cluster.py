"""Federated k-means by pooled sums and counts (K).

Each client ships a vector sum and a count per cluster; centroids are the pooled
means. The driver holds k x d numbers; rows are assigned in place against
literal centroids, so a round is one projection and a two-step aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from silolens.functions.hashing import uniform_value
from silolens.functions.text import ident, squares, weighted
from silolens.operators.scale import Preprocessor, inverse_transform
from silolens.session import local_table, spread

Centroids = list[list[float]]


def init_centroids(k: int, d: int, seed: int = 42) -> Centroids:
    """Uniform in (-1, 1), from hashes; data is never seen."""
    return [[2.0 * uniform_value(seed, "centroid", c, j) - 1.0 for j in range(d)] for c in range(k)]


def assign(df: DataFrame, centroids: Centroids, features: Sequence[str], out: str = "cluster") -> DataFrame:
    """Nearest centroid by squared distance, as column arithmetic."""
    gaps = F.expr("array(" + ", ".join(squares(features, c) for c in centroids) + ")")
    nearest = F.expr("cast(array_position(_d, array_min(_d)) - 1 as int)")  # the lowest index on ties
    return df.withColumn("_d", gaps).withColumn(out, nearest).drop("_d")


def assign_vectors(df: DataFrame, centroids: Centroids, vector: str, out: str = "cluster") -> DataFrame:
    """The same for a wide array column, in Arrow batches."""
    centers = np.asarray(centroids, dtype=np.float64)

    @F.pandas_udf(IntegerType())
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype="int32")
                continue
            x = np.stack(batch.to_numpy()).astype(np.float64)
            gaps = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)
            yield pd.Series(gaps.argmin(axis=1).astype(np.int32))

    return spread(df).withColumn(out, nearest(F.col(vector)))


def client_partials(assigned: DataFrame, features: Sequence[str], client: str = "client_id") -> DataFrame:
    """(client, cluster, n, s0..): all that leaves a client."""
    sums = [F.expr(f"sum({ident(c)})").alias(f"s{j}") for j, c in enumerate(features)]
    return assigned.groupBy(client, "cluster").agg(F.count("*").alias("n"), *sums)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _usable(df: DataFrame, vector: str, d: int) -> DataFrame:
    """Rows whose vector has ``d`` finite components: the others belong to no cluster and no moment."""
    finite = F.forall(F.col(f"`{vector}`"), lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(math.inf)))
    return df.where((F.size(F.col(f"`{vector}`")) == d) & finite)


def vector_partials(df: DataFrame, centroids: Centroids, vector: str, client: str = "client_id") -> DataFrame:
    """(client, cluster, n, sums): the partials of a wide array column, rows assigned and summed in Arrow batches.

    A task ships one array for each client and cluster of a batch; they are
    added up by client, cluster and position. Vectors that are null, of another
    length or not finite are left out.
    """
    centers = np.asarray(centroids, dtype=np.float64)
    k, d = centers.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _stacked(batch["_x"])
            nearest = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1).argmin(axis=1)
            owners, codes = np.unique(batch[client].to_numpy(), return_inverse=True)
            cells, back = np.unique(codes * k + nearest, return_inverse=True)
            sums = np.zeros((len(cells), d))
            np.add.at(sums, back, x)
            yield pd.DataFrame({client: owners[cells // k], "cluster": (cells % k).astype(np.int32), "n": np.bincount(back), "sums": list(sums)})

    owner = StructField(client, df.schema[client].dataType)
    schema = StructType([owner, StructField("cluster", IntegerType()), StructField("n", LongType()), StructField("sums", ArrayType(DoubleType()))])
    parts = spread(_usable(df, vector, d).select(F.col(f"`{client}`"), F.col(f"`{vector}`").alias("_x"))).mapInPandas(partial, schema)
    each = parts.select(client, "cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy(client, "cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "s")))
    return each.groupBy(client, "cluster").agg(F.max("n").alias("n"), F.transform(ordered, lambda e: e["s"]).alias("sums"))


def pool_vectors(partials: DataFrame, centroids: Centroids) -> DataFrame:
    """(cluster, n, center): pooled means; an empty cluster keeps its old centroid."""
    old = local_table(partials.sparkSession, [(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "cluster int, old array<double>")
    each = partials.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("v"))))
    means = each.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(ordered, lambda e: e["v"]).alias("center"))
    return old.join(means, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("center", "old").alias("center"))


def fit_vectors(df: DataFrame, centroids: Centroids, vector: str, rounds: int, client: str = "client_id") -> tuple[Centroids, list[float]]:
    """:func:`fit` over a wide array column."""
    wanted = spread(df.select(F.col(f"`{client}`"), F.col(f"`{vector}`"))).persist()
    moves = []
    try:
        for _ in range(rounds):
            rows = pool_vectors(vector_partials(wanted, centroids, vector, client), centroids).collect()
            new = [[float(v) for v in r["center"]] for r in sorted(rows, key=lambda r: r["cluster"])]
            moves.append(movement(centroids, new))
            centroids = new
    finally:
        wanted.unpersist()
    return centroids, moves


def pool(partials: DataFrame, centroids: Centroids) -> DataFrame:
    """(cluster, n, c0..): pooled means; an empty cluster keeps its old centroid.

    The old centroids join the partials as rows without weight, so pooling is one group-by.
    """
    d = len(centroids[0])
    old = local_table(
        partials.sparkSession, [(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "cluster int, old array<double>"
    )
    none = F.lit(None).cast("array<double>")
    sums = [f"s{j}" for j in range(d)]
    shipped = partials.select("cluster", "n", *sums, none.alias("old"))
    kept = old.select("cluster", F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(s) for s in sums], "old")
    centers = [F.expr(f"coalesce(sum(s{j}) / nullif(sum(n), 0), max(old)[{j}])").alias(f"c{j}") for j in range(d)]
    return shipped.unionByName(kept).groupBy("cluster").agg(F.sum("n").alias("n"), *centers)


def movement(old: Centroids, new: Centroids) -> float:
    """Mean distance the centroids moved in a round."""
    return sum(math.dist(a, b) for a, b in zip(old, new)) / len(old)


def fit(df: DataFrame, centroids: Centroids, features: Sequence[str], rounds: int, client: str = "client_id") -> tuple[Centroids, list[float]]:
    """A fixed number of rounds; k x d numbers come back per round, and the input is reused."""
    wanted = spread(df.select(client, *[F.col(f"`{c}`") for c in features])).persist()
    moves = []
    try:
        for _ in range(rounds):
            pooled = pool(client_partials(assign(wanted, centroids, features), features, client), centroids)
            rows = sorted(pooled.collect(), key=lambda r: r["cluster"])
            new = [[float(r[f"c{j}"]) for j in range(len(features))] for r in rows]
            moves.append(movement(centroids, new))
            centroids = new
    finally:
        wanted.unpersist()
    return centroids, moves


def client_distribution(assigned: DataFrame, k: int, client: str = "client_id") -> DataFrame:
    """Rows and share of every cluster per client, dense over the k clusters."""
    counts = assigned.groupBy(client).agg(
        F.count("*").alias("n"), *[F.expr(f"count_if(cluster = {c})").alias(f"n_c{c}") for c in range(k)]
    )
    return counts.select("*", *[F.expr(f"round(n_c{c} / n, 4)").alias(f"f_c{c}") for c in range(k)])


def cluster_counts(assigned: DataFrame, k: int) -> DataFrame:
    """(cluster, n_rows) with zeros for empty clusters.

    The clusters join the counts as rows without weight: an outer join would
    test every row's cluster for null beneath the grouping, with the whole
    assignment written out a second time.
    """
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"), F.lit(0).cast("bigint").alias("n_rows"), F.lit(True).alias("known"))
    counts = assigned.groupBy("cluster").agg(F.count("*").alias("n_rows")).withColumn("known", F.lit(False))
    both = counts.unionByName(every).groupBy("cluster").agg(F.sum("n_rows").alias("n_rows"), F.max("known").alias("known"))
    return both.where("known").drop("known")


def centroid_profiles(df: DataFrame, centroids: Centroids, fitted: Preprocessor) -> DataFrame:
    """Centroids in original units; ``df`` only gives the session."""
    names = fitted.feature_names
    schema = "cluster int, " + ", ".join(f"`{n}` double" for n in names)
    table = local_table(df.sparkSession, [(i, *map(float, c)) for i, c in enumerate(centroids)], schema)
    return inverse_transform(table, fitted, ["cluster"])


def report(df: DataFrame, centroids: Centroids, moves: Sequence[float], features: Sequence[str], client: str = "client_id") -> DataFrame:
    """One clustering run as rows (section, item, cluster, value).

    Sections: ``movement`` by round (cluster -1), ``centroid`` by feature position and
    cluster, ``rows`` of each cluster, ``share`` of each cluster in a client's
    rows (item is the client as text). The assigned rows are counted once, by
    client and cluster; sections that the driver knows are a few literals.
    """
    spark, k = df.sparkSession, len(centroids)
    known = [("movement", str(i + 1), -1, float(m)) for i, m in enumerate(moves)]
    known += [("centroid", str(j), c, float(v)) for c, row in enumerate(centroids) for j, v in enumerate(row)]
    schema = "section string, item string, cluster int, value double"
    shares = client_distribution(assign(df, centroids, features), k, client)
    parts = F.expr("inline(array(" + ", ".join(f"struct({c} AS cluster, n_c{c} AS rows, f_c{c} AS share)" for c in range(k)) + "))")
    each = shares.select(F.col(client).cast("string").alias("item"), parts)
    counts = each.groupBy("cluster").agg(F.sum("rows").cast("double").alias("value"))
    return (
        local_table(spark, known, schema)
        .unionByName(counts.select(F.lit("rows").alias("section"), F.lit("all").alias("item"), "cluster", "value"))
        .unionByName(each.select(F.lit("share").alias("section"), "item", "cluster", F.col("share").alias("value")))
    )


def covariance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(i, j, cov) for i <= j: the population covariance, from one aggregate pass."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    rows = ", ".join(
        f"struct({i} AS i, {j} AS j, covar_pop({ident(features[i])}, {ident(features[j])}) AS cov)" for i, j in pairs
    )
    return df.agg(F.expr(f"array({rows})").alias("rows")).selectExpr("inline(rows)")


def principal_axes(df: DataFrame, features: Sequence[str], k: int = 2) -> tuple[list[float], Centroids]:
    """Column means and the k leading axes, each with its largest loading positive."""
    d = len(features)
    matrix = np.zeros((d, d))
    for r in covariance(df, features).collect():
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["cov"]
    means = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(features)]).first()
    return [float(m) for m in means], leading_axes(matrix, k).tolist()


#: Components up to which a vector's whole moment matrix is summed.
WIDE = 2_000
#: Rows of a moment matrix that one row of partial sums holds.
BLOCK = 64


def vector_moments(df: DataFrame, vector: str, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and population covariance of ``d`` components: each task sums x and x'x, in blocks of rows that Spark adds up.

    Vectors that are null, of another length or not finite are left out. The
    driver receives d x d numbers.
    """
    if d > WIDE:
        raise ValueError(f"{d} components have {d * d} moments; at most {WIDE} components are supported")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, gram = 0, np.zeros((d + 1, d + 1))
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.ones(len(batch)), _stacked(batch["_x"])])
                n, gram = n + len(x), gram + x.T @ x
        if n:
            yield pd.DataFrame({"block": range(0, d + 1, BLOCK), "sums": [gram[i : i + BLOCK].ravel() for i in range(0, d + 1, BLOCK)]})

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "sums": [np.sum(np.stack(parts["sums"].to_numpy()), axis=0)]})

    schema = "block int, sums array<double>"
    tasks = spread(_usable(df, vector, d).select(F.col(f"`{vector}`").alias("_x"))).mapInPandas(partial, schema)
    rows = sorted(tasks.groupBy("block").applyInPandas(add, schema).collect())
    if not rows:
        raise ValueError("no row has a usable vector")
    gram = np.concatenate([np.asarray(r["sums"]).reshape(-1, d + 1) for r in rows])
    n, mean = int(gram[0, 0]), gram[0, 1:] / gram[0, 0]
    return n, mean, gram[1:, 1:] / n - np.outer(mean, mean)


def leading_axes(covariances: np.ndarray, k: int) -> np.ndarray:
    """The k axes of largest variance as rows, each with its largest loading positive."""
    _, vectors = np.linalg.eigh(covariances)
    axes = vectors[:, ::-1][:, :k].T
    return axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def project_vectors(df: DataFrame, mean: np.ndarray, axes: np.ndarray, vector: str, keep: Sequence[str]) -> DataFrame:
    """Centred vectors on the axes as an array ``pcs``, in Arrow batches; null where the vector is not usable."""
    d = len(mean)

    @F.pandas_udf(ArrayType(DoubleType()))
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list((_stacked(batch) - mean) @ axes.T) if len(batch) else [], dtype=object)

    usable = spread(_usable(df, vector, d)).select(*keep, scores(F.col(f"`{vector}`")).alias("pcs"))
    rest = df.join(usable.select(*keep), list(keep), "left_anti").select(*keep, F.lit(None).cast("array<double>").alias("pcs"))
    return usable.unionByName(rest)


def project(df: DataFrame, means: Sequence[float], axes: Centroids, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Centred rows on the principal axes, as pc1, pc2, ..."""
    pcs = [
        F.expr(weighted(features, axis, -sum(m * a for m, a in zip(means, axis)))).alias(f"pc{i + 1}") for i, axis in enumerate(axes)
    ]
    return df.select(*keep, *pcs)
