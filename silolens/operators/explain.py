"""Shapley values (X1-X6) and the tables of an explanation run.

Background and model are bounded (tens of rows, one parameter vector) and
travel in the closure; rows to explain stay where they are, so explaining is a
projection in Arrow batches whose working set is cut to a byte budget.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from silolens.functions import net
from silolens.functions.hashing import stream_seed
from silolens.functions.text import ident, num
from silolens.operators.hashcut import key_hash
from silolens.session import spread

ScoreFn = Callable[[np.ndarray], np.ndarray]
BATCH_BYTES = 32 << 20
#: Bytes of mixtures that are scored at once: what a core's cache holds.
TILE_BYTES = 256 << 10
EXACT_FEATURES = 12
#: Sigmoids that share a division; products of so many factors up to e^30 are far from the largest double.
POOLED = 6
#: Rows whose powers are made at once, for a core's cache.
POOLED_ROWS = 4096


class LayeredScore:
    """A score that starts with a linear step, tail(x @ w + b); without a tail the first unit itself.

    The linear step of a mixture of a row and a background row is a sum of two
    parts, each made once: the mixtures are never built.
    """

    def __init__(self, w: np.ndarray, b: np.ndarray, tail: ScoreFn | None = None, logistic: bool = False):
        self.w, self.b, self.tail, self.logistic = w, b, tail, logistic

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.asarray(x, dtype=np.float64) @ self.w + self.b
        return z[:, 0] if self.tail is None else self.tail(z)

    def mixture_means(self, x: np.ndarray, background: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """(rows, masks): the mean over the background of the row's features inside a mask, the background's outside."""
        n, units = len(x), self.w.shape[1]
        share = np.full(len(background), 1.0 / len(background))
        levels, codes = ([], x) if self.logistic or self.tail is None else _value_codes(x)
        if self.tail is None:
            outside = (share @ background) * self.w[:, 0]
            return x @ (masks * self.w[:, 0]).T + ((~masks) @ outside + self.b[0])
        out = np.empty((n, len(masks)))
        at_once = max(1, TILE_BYTES // (8 * units * len(background)))
        held = np.empty((at_once, len(background), units))
        for k, inside in enumerate(masks):
            if levels and inside.any() and not inside.all():
                out[:, k] = self._distinct_means(x, background, inside, levels, codes)
                continue
            own = x[:, inside] @ self.w[inside]
            rest = background[:, ~inside] @ self.w[~inside] + self.b
            if inside.all():
                out[:, k] = self.tail(own + self.b)
                continue
            if not inside.any():
                out[:, k] = share @ self.tail(rest)
                continue
            if self.logistic and np.abs(own).max(initial=0.0) + np.abs(rest).max() <= net.LOGIT_LIMIT:
                out[:, k] = logistic_means(own[:, 0], rest[:, 0])
                continue
            for i in range(0, n, at_once):
                z = np.add(own[i : i + at_once, None, :], rest, out=held[: min(at_once, n - i)])
                out[i : i + at_once, k] = self.tail(z.reshape(-1, units)).reshape(len(z), -1) @ share
        return out

    def _distinct_means(self, x: np.ndarray, background: np.ndarray, inside: np.ndarray, levels: Sequence[int], codes: np.ndarray) -> np.ndarray:
        """A mask's means from its distinct mixtures: rows that agree inside it, background rows that agree outside it, meet once."""
        first, back = _distinct_rows(codes, levels, inside)
        others, counts = np.unique(background[:, ~inside], axis=0, return_counts=True)
        own = x[first][:, inside] @ self.w[inside]
        rest = others @ self.w[~inside] + self.b
        share, units = counts / len(background), self.w.shape[1]
        means = np.empty(len(own))
        at_once = max(1, TILE_BYTES // (8 * units * len(rest)))
        held = np.empty((at_once, len(rest), units))
        for i in range(0, len(own), at_once):
            z = np.add(own[i : i + at_once, None, :], rest, out=held[: min(at_once, len(own) - i)])
            means[i : i + at_once] = self.tail(z.reshape(-1, units)).reshape(len(z), -1) @ share
        return means[back]


def logistic_means(own: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The mean over c in ``rest`` of the sigmoid of a + c, for every a in ``own``; |a| + |c| is within the logit's limit.

    With d = e^-a and r = e^-c a term is 1 / (1 + d r), and ``POOLED`` terms
    together are a fraction of two polynomials in d. All their coefficients are
    positive, so nothing cancels; a row takes one division for that many terms.
    """
    groups = -(-len(rest) // POOLED)
    r = np.zeros((groups, POOLED))
    r.ravel()[: len(rest)] = np.exp(-rest)
    here = r > 0.0  # the last group may be short
    above, below = np.zeros((2, groups, POOLED + 1))
    below[:, 0] = 1.0
    for j in range(POOLED):
        ratio = r[:, j : j + 1]
        above[:, 1:] += ratio * above[:, :-1]
        above += below * here[:, j : j + 1]
        below[:, 1:] += ratio * below[:, :-1]
    both = np.concatenate([above, below])
    means, share = np.empty(len(own)), np.full(groups, 1.0 / len(rest))
    powers, values = np.ones((POOLED + 1, POOLED_ROWS)), np.empty((2 * groups, POOLED_ROWS))
    for i in range(0, len(own), POOLED_ROWS):
        n = min(POOLED_ROWS, len(own) - i)
        np.exp(-own[i : i + n], out=powers[1, :n])
        for j in range(2, POOLED + 1):
            np.multiply(powers[j // 2, :n], powers[j - j // 2, :n], out=powers[j, :n])
        z = np.matmul(both, powers[:, :n], out=values[:, :n])
        z[:groups] /= z[groups:]
        np.matmul(share, z[:groups], out=means[i : i + n])
    return means


def _value_codes(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Per column the number of its distinct values, and every value's place among them."""
    found = [np.unique(column, return_inverse=True) for column in x.T]
    return [len(values) for values, _ in found], np.stack([place for _, place in found], axis=1)


def _distinct_rows(codes: np.ndarray, levels: Sequence[int], inside: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray | slice]:
    """The first row of each combination of the columns ``inside``, and every row's combination; all rows if most differ."""
    taken = np.flatnonzero(inside)
    if max(levels[j] for j in taken) * 2 > len(codes):
        return slice(None), slice(None)
    one = np.zeros(len(codes), np.int64)
    for j in taken:  # numbered anew after each column, so that no number grows past rows x rows
        one = np.unique(one * levels[j] + codes[:, j], return_inverse=True)[1]
    _, first, back = np.unique(one, return_index=True, return_inverse=True)
    return first, back


def net_score_fn(params: Sequence[float], sizes: Sequence[int]) -> LayeredScore:
    net.check_params(params, sizes)
    (w, b), *rest = net.layers(np.asarray(params, dtype=np.float64), tuple(sizes))

    def tail(z: np.ndarray) -> np.ndarray:
        """The rest of the net, in the place of ``z``."""
        for w_next, b_next in rest:
            z = net.relu(z) @ w_next
            z += b_next
        return net.logistic(z[:, 0])

    return LayeredScore(w, b, tail, logistic=not rest)


def linear_score(weights: Sequence[float]) -> LayeredScore:
    """The additive score x . weights."""
    return LayeredScore(np.asarray(weights, dtype=np.float64)[:, None], np.zeros(1))


def background_sample(df: DataFrame, keys: list[str], n: int = 60, seed: int = 42) -> DataFrame:
    """n rows without replacement: the smallest hashes, kept per task and merged."""
    return df.withColumn("_h", key_hash(keys, seed, "background")).orderBy("_h", *keys).limit(n).drop("_h")


def collect_background(df: DataFrame, features: Sequence[str], keys: list[str], n: int = 60, seed: int = 42) -> np.ndarray:
    rows = background_sample(df.select(*dict.fromkeys([*keys, *features])), keys, n, seed).collect()
    return np.array([[float(r[c]) for c in features] for r in rows], dtype=np.float64)


def shapley_weights(d: int) -> np.ndarray:
    """Weight of a coalition of size s that a feature joins: s! (d-1-s)! / d!."""
    return np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])


def mixture_means(score: ScoreFn, x: np.ndarray, background: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """v[row, mask]: mean score with the mask's features from the row, the rest from the background."""
    if isinstance(score, LayeredScore):
        return score.mixture_means(x, background, masks)
    values = np.empty((len(x), len(masks)))
    for k, inside in enumerate(masks):
        mixed = np.where(inside, x[:, None, :], background[None, :, :]).reshape(-1, x.shape[1])
        values[:, k] = score(mixed).reshape(len(x), -1).mean(axis=1)
    return values


def exact_shapley(score: ScoreFn, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    masks = np.array([[bits >> j & 1 for j in range(d)] for bits in range(1 << d)], dtype=bool).reshape(-1, d)
    members, weights = masks.sum(axis=1), shapley_weights(d)
    # a coalition with the feature counts for it, the same one without it against it
    effect = np.where(masks, weights[np.maximum(members - 1, 0)][:, None], -weights[np.minimum(members, d - 1)][:, None])
    return mixture_means(score, x, background, masks) @ effect


def sampled_shapley(score: ScoreFn, x: np.ndarray, background: np.ndarray, permutations: int, seed: int) -> np.ndarray:
    """Antithetic permutation sampling; every permutation's terms add up to prediction - base."""
    n, d = x.shape
    rng = np.random.default_rng(stream_seed(seed, "permutations"))
    phi = np.zeros((n, d))
    base = score(background).mean()
    for _ in range(permutations):
        order = rng.permutation(d)
        for path in (order, order[::-1]):
            mixed = np.repeat(background[None, :, :], n, axis=0)
            before = np.full(n, base)
            for j in path:
                mixed[:, :, j] = x[:, j : j + 1]
                after = score(mixed.reshape(-1, d)).reshape(n, -1).mean(axis=1)
                phi[:, j] += after - before
                before = after
    return phi / (2 * permutations)


def coalitions(d: int, budget: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(masks, weights) of the kernel regression over d features: at most ``budget`` coalitions (but always sizes 1 and d - 1).

    Sizes s and d - s come together, the smallest first, whole while they fit;
    their weights are the kernel's. The rest of the budget draws coalitions of
    the sizes left over, each with its complement, which share those sizes' weight.
    """
    sizes = np.arange(1, d)
    total = (d - 1) / (sizes * (d - sizes))  # the kernel's weight of all coalitions of a size
    weights: dict[bytes, float] = {}
    low = 1
    while low <= d - low:
        pair = {low, d - low}
        count = len(pair) * math.comb(d, low)
        if low > 1 and len(weights) + count > budget:
            break
        for size in pair:
            for members in itertools.combinations(range(d), size):
                mask = np.zeros(d, bool)
                mask[list(members)] = True
                weights[mask.tobytes()] = total[size - 1] / math.comb(d, size)
        low += 1
    left = sizes[low - 1 : d - low]
    draws = (budget - len(weights)) // 2
    if len(left) and draws > 0:
        rng = np.random.default_rng(stream_seed(seed, "coalitions"))
        share = total[left - 1]
        for size in rng.choice(left, draws, p=share / share.sum()):
            mask = np.zeros(d, bool)
            mask[rng.permutation(d)[:size]] = True
            for drawn in (mask, ~mask):
                weights[drawn.tobytes()] = weights.get(drawn.tobytes(), 0.0) + share.sum() / (2 * draws)
    masks = np.array([np.frombuffer(m, bool) for m in weights]).reshape(-1, d)
    return masks, np.array(list(weights.values()))


def kernel_solver(masks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(B, c) such that B y + c t is the weighted least-squares fit to coalition gains y whose terms add up to t."""
    z = masks.astype(np.float64)
    d = z.shape[1]
    if not len(z):
        return np.zeros((d, 0)), np.ones(d) / d
    weighted = z.T * weights
    inverse = np.linalg.inv(weighted @ z)
    c = inverse.sum(axis=1) / inverse.sum()
    return (np.eye(d) - c[:, None]) @ inverse @ weighted, c


def kernel_shapley(score: ScoreFn, x: np.ndarray, background: np.ndarray, masks: np.ndarray, solver: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Kernel regression over the given coalitions; exact when they are all, and for additive scores."""
    base = score(background).mean()
    gains = mixture_means(score, x, background, masks) - base
    return gains @ solver[0].T + np.outer(score(x) - base, solver[1])


def shapley_values(df: DataFrame, score: ScoreFn, background: np.ndarray, features: Sequence[str],
                   out: str = "phi", permutations: int = 64, seed: int = 42, method: str = "exact", budget: int | None = None) -> DataFrame:
    """Add an array of attributions per row by the caller's ``method``: "exact" (up to 12 features), "kernel" or "sampled".

    "kernel" fits at most ``budget`` coalitions (2048 + 2 d unless given), the
    same ones for every row, so they are chosen and solved once.
    """
    d = len(features)
    if method not in ("exact", "kernel", "sampled"):
        raise ValueError(f"method {method!r}: use 'exact', 'kernel' or 'sampled'")
    if method == "exact" and d > EXACT_FEATURES:
        raise ValueError(f"exact values of {d} features need 2^{d} coalitions a row; choose method='kernel' or 'sampled' above {EXACT_FEATURES}")
    masks, solver = np.zeros((0, d), bool), None
    if method == "kernel":
        masks, weights = coalitions(d, 2048 + 2 * d if budget is None else budget, seed)
        solver = kernel_solver(masks, weights)
    # a layered score makes no mixtures; many rows at once then have many parts in common
    mixed = d * 4 if isinstance(score, LayeredScore) else len(background) * d * 4
    rows_per_slice = max(1, BATCH_BYTES // (8 * (mixed + max(len(masks), 1 << min(d, EXACT_FEATURES)))))

    def attributions(x: np.ndarray) -> np.ndarray:
        if method == "exact":
            return exact_shapley(score, x, background)
        if method == "kernel":
            return kernel_shapley(score, x, background, masks, solver)
        return sampled_shapley(score, x, background, permutations, seed)

    # a struct of doubles travels as d flat buffers; an array would be a Python object per row
    names = [f"p{j}" for j in range(d)]

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in names]))
    def attribute(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in batch])
            parts = [attributions(x[i : i + rows_per_slice]) for i in range(0, len(x), rows_per_slice)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.empty((0, d)), columns=names)

    made = spread(df).withColumn("_phi", attribute(*[F.col(f"`{c}`") for c in features]))
    return made.withColumn(out, F.array(*[F.col(f"_phi.{n}") for n in names])).drop("_phi")


def long_attributions(df: DataFrame, features: Sequence[str], keep: list[str], col: str = "phi") -> DataFrame:
    """(keep..., feature, phi), one row per feature."""
    names = F.array(*[F.lit(f) for f in features])
    # the outer form: the other one first filters by the array's size, which would compute the attributions twice
    long = df.select(*keep, F.posexplode_outer(col).alias("_i", "phi"))
    return long.select(*keep, F.get(names, F.col("_i")).alias("feature"), "phi")


def mean_abs_importance(df: DataFrame, features: Sequence[str], col: str = "phi") -> DataFrame:
    """(feature, importance): one aggregate over the wide rows, then d rows."""
    means = ", ".join(f"struct({i} AS _i, avg(abs({ident(col)}[{i}])) AS importance)" for i in range(len(features)))
    names = F.array(*[F.lit(f) for f in features])
    rows = df.agg(F.expr(f"array({means})").alias("rows")).selectExpr("inline(rows)")
    return rows.select(F.get(names, F.col("_i")).alias("feature"), "importance")


def ranked_features(phi: Column, features: Sequence[str]) -> Column:
    """Structs (size, feature, value) by falling |phi|, then name; sorted inside the row."""
    entries = F.array(*[
        F.struct((-F.abs(phi[i])).alias("neg"), F.lit(f).alias("feature"), phi[i].alias("value")) for i, f in enumerate(features)
    ])
    return F.array_sort(entries)


#: Features up to which a row's attributions are ranked by comparing all pairs, in plain numbers.
PAIRED = 16


def _ranked(df: DataFrame, features: Sequence[str], k: int, keep: list[str], col: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``keep`` with the first ``k`` of :func:`ranked_features`, and expressions (feature, value) for each.

    Few features are ranked without an array: a feature's place is one more than
    the number of those before it, and a place's feature is the one ranked there.
    """
    d = len(features)
    if d > PAIRED:
        return df.select(*keep, ranked_features(F.col(col), features).alias("_w")), [(f"_w[{i}].feature", f"_w[{i}].value") for i in range(min(k, d))]
    held = [F.col(ident(c)) for c in keep]
    value = [f"_p{i}" for i in range(d)]
    taken = df.select(*held, *[F.expr(f"{ident(col)}[{i}]").alias(v) for i, v in enumerate(value)])
    # without a value first, as an array is sorted
    sizes = taken.select(*held, *value, *[F.expr(f"coalesce(-abs({v}), double('-Infinity'))").alias(f"_s{i}") for i, v in enumerate(value)])
    before = [[f"cast(_s{j} {'<=' if features[j] < features[i] else '<'} _s{i} as int)" for j in range(d) if j != i] for i in range(d)]
    places = sizes.select(*held, *value, *[F.expr(" + ".join(["0", *b])).alias(f"_r{i}") for i, b in enumerate(before)])

    def at(place: int, choices: Sequence[str]) -> str:
        *first, last = choices
        return " ".join(["CASE", *[f"WHEN _r{i} = {place} THEN {c}" for i, c in enumerate(first)], f"ELSE {last} END"])

    names = F.array(*[F.lit(f) for f in features])
    found = [(at(p, [str(i) for i in range(d)]), at(p, value)) for p in range(min(k, d))]
    ordered = places.select(*held, *[e for p, (i, v) in enumerate(found) for e in (F.get(names, F.expr(i)).alias(f"_f{p}"), F.expr(v).alias(f"_v{p}"))])
    return ordered, [(f"_f{p}", f"_v{p}") for p in range(min(k, d))]


def waterfall(df: DataFrame, features: Sequence[str], base_value: float, keep: list[str], col: str = "phi") -> DataFrame:
    """Bars of a row's waterfall: (keep..., pos, feature, phi, bar_start, bar_end), running from the base value.

    The running sum is taken over the row's own ranked values, so no shuffle.
    """
    ordered, ranked = _ranked(df, features, len(features), keep, col)
    ends = [" + ".join([num(base_value), *[v for _, v in ranked[: i + 1]]]) for i in range(len(ranked))]
    bars = ", ".join(
        f"struct({i + 1} AS pos, {f} AS feature, {v} AS phi, {end} - {v} AS bar_start, {end} AS bar_end)" for i, ((f, v), end) in enumerate(zip(ranked, ends))
    )
    return ordered.select(*keep, F.expr(f"inline(array({bars}))"))


def additivity_error(df: DataFrame, base_value: float, prediction: str, col: str = "phi") -> DataFrame:
    """(n_rows, max_error) of base + sum of attributions against the prediction."""
    total = F.aggregate(col, F.lit(float(base_value)), lambda acc, v: acc + v)
    return df.agg(F.count("*").alias("n_rows"), F.max(F.abs(total - F.col(prediction))).alias("max_error"))


def top_weights(df: DataFrame, features: Sequence[str], k: int, keep: list[str], col: str = "weights") -> DataFrame:
    """The k largest weights by size as an array of (feature, weight), cut inside the row."""
    ordered, ranked = _ranked(df, features, k, keep, col)
    entries = ", ".join(f"struct({f} AS feature, {v} AS weight)" for f, v in ranked)
    return ordered.select(*keep, F.expr(f"array({entries})").alias(col))


def weight_rows(df: DataFrame, keep: list[str], col: str = "weights") -> DataFrame:
    """(keep..., pos, feature, weight), flat."""
    # the outer form here too; a row without weights has no position
    flat = df.select(*keep, F.posexplode_outer(col).alias("pos", "_e")).where("pos IS NOT NULL")
    return flat.select(*keep, (F.col("pos") + 1).alias("pos"), F.col("_e.feature").alias("feature"), F.col("_e.weight").alias("weight"))


def global_weights(df: DataFrame, col: str = "weights") -> DataFrame:
    """(feature, importance): sum of |weight| over the number of explained rows; absent counts as 0."""
    entries = df.select(F.posexplode_outer(col).alias("_i", "_e"))
    first = F.count_if(F.coalesce(F.col("_i"), F.lit(0)) == 0).alias("rows")  # each explained row has one first entry, even if empty
    sums = entries.groupBy(F.col("_e.feature").alias("feature")).agg(F.sum(F.abs(F.col("_e.weight"))).alias("total"), first)
    # as many rows as there are features, so the total is a short window
    n = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    return sums.select("feature", (F.col("total") / n).alias("importance")).where("feature IS NOT NULL")


def prediction_table(df: DataFrame, params: Sequence[float], sizes: Sequence[int], features: Sequence[str],
                     keep: list[str], label: str = "target") -> DataFrame:
    """(keep..., y_true, y_pred, prob_failure)."""
    scored = net.predict(net.score(df, params, sizes, features, "prob_failure"), "prob_failure")
    return scored.select(*keep, F.col(f"`{label}`").cast("int").alias("y_true"), "y_pred", "prob_failure")
