"""A small ReLU network with a sigmoid output, as Columns and as NumPy batches.

Parameters are one flat vector: the weights of every layer (input-major), then
the biases of every layer. ``sizes`` is (inputs, hidden..., 1); no hidden layer
gives logistic regression.

Narrow nets become column arithmetic inside whole-stage codegen; wide ones are
scored in Arrow batches. The NumPy gradient never builds one vector per row:
a row's gradient norm is the sum over layers of |delta|^2 (|a|^2 + 1), so rows
are clipped by rescaling their deltas before the one matrix product per layer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from silolens.functions.hashing import gaussian_value
from silolens.functions.text import ident, num, weighted
from silolens.session import spread

LOGIT_LIMIT = 30.0
PROB_FLOOR = 1e-7
# Multiply-adds up to which a net is unrolled into column expressions.
UNROLL_LIMIT = 400
_ZEROS = np.zeros(1 << 20)


def n_params(sizes: Sequence[int]) -> int:
    return sum(a * b + b for a, b in zip(sizes, sizes[1:]))


def init_params(sizes: Sequence[int], seed: int) -> list[float]:
    """He-normal weights from hashes, zero biases."""
    weights, i = [], 0
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        for _ in range(fan_in * fan_out):
            weights.append(math.sqrt(2.0 / max(fan_in, 1)) * gaussian_value(seed, "init", i))
            i += 1
    return weights + [0.0] * sum(sizes[1:])


def check_params(params: Sequence[float], sizes: Sequence[int]) -> None:
    if len(params) != n_params(sizes):
        raise ValueError(f"layers {tuple(sizes)} need {n_params(sizes)} parameters, got {len(params)}")


@lru_cache(maxsize=64)
def _spans(sizes: tuple[int, ...]) -> list[tuple[slice, tuple[int, int], slice]]:
    """Where each layer's weights (with their shape) and biases lie in the flat vector."""
    shapes = list(zip(sizes, sizes[1:]))
    w_ends = np.cumsum([a * b for a, b in shapes])
    b_ends = w_ends[-1] + np.cumsum([b for _, b in shapes])
    return [(slice(int(we) - a * b, int(we)), (a, b), slice(int(be) - b, int(be))) for (a, b), we, be in zip(shapes, w_ends, b_ends)]


def layers(theta: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views (W, b) per layer into the flat vector."""
    check_params(theta, sizes)
    return [(theta[w].reshape(shape), theta[b]) for w, shape, b in _spans(tuple(sizes))]


# --- NumPy batches ---------------------------------------------------------------------------


def forward(theta: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Inputs of every layer and P(class 1)."""
    inputs = []
    *hidden, (w_out, b_out) = layers(theta, sizes)
    for w, b in hidden:
        inputs.append(x)
        x = x @ w
        x += b
        relu(x)
    inputs.append(x)
    p = (x @ w_out)[:, 0] + b_out
    return inputs, logistic(p)


def relu(z: np.ndarray) -> np.ndarray:
    """max(z, 0) in the place of ``z``; NumPy's loop over two arrays is several times faster than that with a scalar."""
    return np.maximum(z, _ZEROS[: z.size].reshape(z.shape) if z.size <= len(_ZEROS) else 0.0, out=z)


def logistic(z: np.ndarray) -> np.ndarray:
    """The sigmoid of bounded logits, in the place of ``z``."""
    if not (z.min(initial=0.0) >= -LOGIT_LIMIT and z.max(initial=0.0) <= LOGIT_LIMIT):  # NaN too: the others are bounded
        np.minimum(np.maximum(z, -LOGIT_LIMIT, out=z), LOGIT_LIMIT, out=z)
    np.exp(np.negative(z, out=z), out=z)
    z += 1.0
    return np.divide(1.0, z, out=z)


def probabilities(theta: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> np.ndarray:
    return forward(theta, sizes, x)[1]


def mean_log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.minimum(np.maximum(p, PROB_FLOOR), 1.0 - PROB_FLOOR)
    return float(-np.mean(np.where(y > 0.5, np.log(p), np.log1p(-p))))


def _output_delta(p: np.ndarray, y: np.ndarray, pos_weight: float) -> np.ndarray:
    """The loss's slope in the output's logit, of every row."""
    p = np.minimum(np.maximum(p, PROB_FLOOR), 1.0 - PROB_FLOOR)
    return p * (pos_weight * y + 1.0 - y) - pos_weight * y if pos_weight not in (0.0, 1.0) else p - y


def gradient_sum(theta: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray,
                 pos_weight: float = 0.0, clip: float | None = None) -> np.ndarray:
    """Sum over rows of the (optionally norm-clipped) gradient of the weighted log loss."""
    inputs, p = forward(theta, sizes, x)
    delta = _output_delta(p, y, pos_weight)[:, None]
    params = layers(theta, sizes)
    deltas = [delta]
    for depth in range(len(params) - 1, 0, -1):
        delta = delta @ params[depth][0].T
        delta *= inputs[depth] > 0.0
        deltas.append(delta)
    deltas.reverse()
    if clip is not None and clip > 0:
        squares = sum(np.einsum("ij,ij->i", d, d) * (np.einsum("ij,ij->i", a, a) + 1.0) for d, a in zip(deltas, inputs))
        factor = np.minimum(1.0, clip / np.maximum(np.sqrt(squares), 1e-12))[:, None]
        deltas = [d * factor for d in deltas]
    out = np.empty(n_params(sizes))
    for (w, shape, b), a, d in zip(_spans(tuple(sizes)), inputs, deltas):
        np.matmul(a.T, d, out=out[w].reshape(shape))
        np.add.reduce(d, axis=0, out=out[b])
    return out


class HeldNet:
    """A net whose parameters move in place, with the working arrays of batches of at most ``rows`` rows.

    Small batches spend most of their time on making arrays and on matrix
    products of odd sizes. Here arrays are made once, and each layer's inputs are
    followed by a one, whose weights are the biases, and by zeros up to a
    multiple of four: a bias costs no pass of its own. ``held`` has the
    parameters in this form. The weight that passes the one on to the next layer
    and the zeros have no gradient, so steps on ``held`` leave them as they are.
    """

    def __init__(self, theta: np.ndarray, sizes: Sequence[int], rows: int):
        self.sizes = tuple(sizes)
        widths = self.widths = [4 * (units // 4 + 1) for units in self.sizes[:-1]]
        shapes = [*zip(widths, widths[1:]), (widths[-1], 1)]
        ends = np.cumsum([0, *[a * b for a, b in shapes]])
        self.spans = [(slice(int(at), int(to)), shape) for at, to, shape in zip(ends, ends[1:], shapes)]
        places = self._stack(np.arange(ends[-1]))
        layouts = list(zip(places, self.sizes, self.sizes[1:]))
        self.at = np.concatenate([p[:a, :b].ravel() for p, a, b in layouts] + [p[a, :b] for p, a, b in layouts])
        self.held, self.grad = np.zeros(ends[-1]), np.zeros(ends[-1])
        self.held[self.at] = theta
        self.stack, self.grad_stack = self._stack(self.held), self._stack(self.grad)
        for w, a, b in list(zip(self.stack, self.sizes, self.sizes[1:]))[:-1]:
            w[a, b] = 1.0
        self.back = [np.zeros(shape[::-1]) for shape in shapes]  # weights without biases, transposed
        self.inputs, units = np.zeros((rows, widths[0])), widths[1:]
        self.acts, self.deltas, self.masks = ([np.empty(rows * u) for u in units] for _ in range(3))
        self.positive, self.zeros = np.empty(rows * max(widths), bool), np.zeros(rows * max(widths))
        self.bounds = np.array([[-LOGIT_LIMIT], [LOGIT_LIMIT], [PROB_FLOOR], [1.0 - PROB_FLOOR], [1.0], [1e-12]]) * np.ones(rows)
        self.squares = np.empty((2, rows * len(shapes)))  # lengths of a layer's inputs and of its deltas
        self.views: dict[int, tuple] = {}

    def _stack(self, flat: np.ndarray) -> list[np.ndarray]:
        return [flat[span].reshape(shape) for span, shape in self.spans]

    @property
    def theta(self) -> np.ndarray:
        """The parameters as one flat vector, as everywhere else."""
        return self.held[self.at]

    def inputs_of(self, x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The rows of ``x`` as the first layer's inputs."""
        out = np.zeros((len(x), self.widths[0])) if out is None else out[: len(x)]
        out[:, : self.sizes[0]] = x
        out[:, self.sizes[0]] = 1.0
        return out

    def _arrays(self, n: int) -> tuple:
        """The working arrays cut to ``n`` rows: batches have few sizes."""
        if n not in self.views:
            if len(self.views) > 8:
                self.views.clear()
            shaped = [[a[: n * u].reshape(n, u) for a, u in zip(held, self.widths[1:])] for held in (self.acts, self.deltas, self.masks)]
            flat = [[a[: n * u].reshape(n, u) for u in self.widths[1:]] for a in (self.positive, self.zeros)]
            depths = len(self.stack)
            self.views[n] = (*shaped, *flat, self.bounds[:, :n], *self.squares[:, : depths * n].reshape(2, depths, n))
        return self.views[n]

    def probabilities_of(self, inputs: np.ndarray) -> np.ndarray:
        """P(class 1) of rows given as :meth:`inputs_of`."""
        acts, _, _, _, zeros, (low, high, _, _, one, _), _, _ = self._arrays(len(inputs))
        x = inputs
        for w, z, zero in zip(self.stack, acts, zeros):
            np.matmul(x, w, z)
            x = np.maximum(z, zero, z)
        z = np.matmul(x, self.stack[-1][:, 0])
        np.maximum(z, low, z)
        np.minimum(z, high, z)
        np.exp(np.negative(z, z), z)
        z += one
        return np.divide(one, z, z)

    def gradient_of(self, inputs: np.ndarray, y: np.ndarray, pos_weight: float = 0.0, clip: float | None = None, scale: float = 1.0) -> np.ndarray:
        """``scale`` times the summed gradient over :meth:`inputs_of` rows, in the form of ``held``; the next call overwrites it."""
        acts, deltas, masks, positive, _, (_, _, floor, ceiling, one, least), own, back = self._arrays(len(inputs))
        last = self.probabilities_of(inputs)
        np.maximum(last, floor, last)
        np.minimum(last, ceiling, last)
        if pos_weight in (0.0, 1.0):
            last -= y
        else:
            last = last * (pos_weight * y + 1.0 - y) - pos_weight * y
        private = clip is not None and clip > 0
        if not private and scale != 1.0:
            last *= scale
        above = last
        for depth in range(len(acts) - 1, -1, -1):
            delta, units, weights = deltas[depth], self.sizes[depth + 1], self.back[depth + 1]
            weights[:, :units] = self.stack[depth + 1][:units].T
            if above is last:
                np.multiply(last[:, None], weights[0], delta)
            else:
                np.matmul(above, weights, delta)
            np.copyto(masks[depth], np.greater(acts[depth], 0.0, positive[depth]))
            delta *= masks[depth]
            above = delta
        sources, deltas = [inputs, *acts], [*deltas, last]
        if private:
            for a, n_a, units in zip(sources, own, self.sizes):
                np.vecdot(a[:, :units], a[:, :units], n_a)
            for d, n_d in zip(deltas[:-1], back):
                np.vecdot(d, d, n_d)
            np.multiply(last, last, back[-1])
            own += 1.0
            own *= back
            share = np.add.reduce(own, 0)
            np.sqrt(share, share)
            np.maximum(share, least, share)
            np.divide(clip, share, share)
            np.minimum(share, one, share)
            if scale != 1.0:
                share *= scale
            last *= share
            for i, a in enumerate(sources[:-1]):  # a row's share goes to the narrower side of the product
                if a.shape[1] < deltas[i].shape[1]:
                    sources[i] = a * share[:, None]
                else:
                    deltas[i] *= share[:, None]
        for g, a, d in zip(self.grad_stack, sources[:-1], deltas):
            np.matmul(a.T, d, g)
        np.matmul(last, sources[-1], self.grad_stack[-1][:, 0])
        return self.grad

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities_of(self.inputs_of(x, self.inputs))

    def gradient(self, x: np.ndarray, y: np.ndarray, pos_weight: float = 0.0, clip: float | None = None) -> np.ndarray:
        """What :func:`gradient_sum` gives."""
        return self.gradient_of(self.inputs_of(x, self.inputs), y, pos_weight, clip)[self.at]


# --- Columns ---------------------------------------------------------------------------------


def sigmoid(logit: str) -> Column:
    """Of an expression text, with the logit bounded."""
    return F.expr(f"1D / (1D + exp(-least(greatest({logit}, {num(-LOGIT_LIMIT)}), {num(LOGIT_LIMIT)})))")


def complete(*names: str) -> str:
    """Whether no named column is null or NaN, as expression text."""
    return "NOT (" + " OR ".join(f"{ident(c)} IS NULL OR isnan({ident(c)})" for c in names) + ")"


def complete_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows without a missing feature or label: the others are no examples."""
    whole = ~(np.isnan(x).any(axis=1) | np.isnan(y))
    return (x, y) if whole.all() else (x[whole], y[whole])


def score(df: DataFrame, params: Sequence[float], sizes: Sequence[int], features: Sequence[str],
          out: str = "p1") -> DataFrame:
    """Add P(class 1); null where a feature is null or NaN, whatever the net's width."""
    check_params(params, sizes)
    if len(features) != sizes[0]:
        raise ValueError(f"the net takes {sizes[0]} features, got {len(features)}")
    if n_params(sizes) > UNROLL_LIMIT:
        return _score_batches(df, params, sizes, features, out)
    inputs, made = list(features), []
    stack = layers(np.asarray(params, dtype=np.float64), sizes)
    for depth, (w, b) in enumerate(stack[:-1]):
        names = [f"_h{depth}_{j}" for j in range(w.shape[1])]
        df = df.select("*", *[F.expr(f"greatest({weighted(inputs, w[:, j], b[j])}, 0D)").alias(n) for j, n in enumerate(names)])
        inputs, made = names, made + names
    w, b = stack[-1]
    return df.withColumn(out, F.when(F.expr(complete(*features)), sigmoid(weighted(inputs, w[:, 0], b[0])))).drop(*made)


def _score_batches(df: DataFrame, params: Sequence[float], sizes: Sequence[int], features: Sequence[str],
                   out: str) -> DataFrame:
    theta = np.asarray(params, dtype=np.float64)
    layout = tuple(sizes)

    @F.pandas_udf(DoubleType())
    def p1(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in batch])
            yield pd.Series(probabilities(theta, layout, x))

    return spread(df).withColumn(out, p1(*[F.col(f"`{c}`") for c in features]))


def predict(df: DataFrame, p: str = "p1") -> DataFrame:
    """y_pred = 1 from probability 0.5 on; confidence is the larger of both probabilities."""
    return df.withColumns({
        "y_pred": F.expr(f"cast({ident(p)} >= 0.5D as int)"),
        "confidence": F.expr(f"greatest({ident(p)}, 1D - {ident(p)})"),
    })


def clipped_probability(p: str) -> str:
    # least and greatest skip nulls, so a missing probability is kept apart
    return f"(CASE WHEN {ident(p)} IS NOT NULL THEN least(greatest({ident(p)}, {num(PROB_FLOOR)}), {num(1.0 - PROB_FLOOR)}) END)"


def row_log_loss(p: str, y: str) -> Column:
    """Unweighted log loss of a row, from column names."""
    q = clipped_probability(p)
    return F.expr(f"-({ident(y)} * ln({q}) + (1D - {ident(y)}) * ln(1D - {q}))")

