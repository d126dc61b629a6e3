"""SQL expression text for wide arithmetic: one parse instead of one call per operator."""

from __future__ import annotations

import math
from collections.abc import Sequence


def num(x: float) -> str:
    """A DOUBLE literal."""
    x = float(x)
    if not math.isfinite(x):
        raise ValueError(f"{x} is not a finite parameter")
    return f"{x!r}D"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def weighted(names: Sequence[str], weights: Sequence[float], bias: float = 0.0) -> str:
    """sum of name * weight, plus bias."""
    return "(" + " + ".join([f"{ident(c)} * {num(w)}" for c, w in zip(names, weights)] + [num(bias)]) + ")"


def squares(names: Sequence[str], center: Sequence[float] | None = None) -> str:
    """Squared length of the named columns, about ``center`` if given."""
    if center is None:
        return "(" + " + ".join(f"{ident(c)} * {ident(c)}" for c in names) + ")"
    return "(" + " + ".join(f"({ident(c)} - {num(v)}) * ({ident(c)} - {num(v)})" for c, v in zip(names, center)) + ")"


def nearest(value: str, digits: int) -> str:
    """Rounded to ``digits``, halves away from zero and without negative zero, in doubles: SQL's round takes a decimal number's detour a value."""
    y = f"({value} * {num(10.0**digits)})"
    half = f"CASE WHEN {y} > 0D AND {y} - rint({y}) = 0.5D THEN 1D WHEN {y} < 0D AND {y} - rint({y}) = -0.5D THEN -1D ELSE 0D END"
    # past 2^51 units of the last digit nothing is left to round
    return f"(CASE WHEN abs({y}) < {num(2.0**51)} THEN (rint({y}) + {half}) / {num(10.0**digits)} ELSE {value} END)"
