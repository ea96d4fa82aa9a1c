"""Numeric column functions: likelihoods, rates, weights, masks.

All are built-in expressions except the likelihood interval, which is a vectorised pandas function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bits


def NEG_INF() -> Column:
    return F.lit(float("-inf"))


def log_factorial(n: Column) -> Column:
    """ln(n!) by the Stirling series at n + 10, shifted back by the ten factors in between (FN1)."""
    x = n.cast("double") + 10
    inv, inv2 = 1 / x, 1 / (x * x)
    series = inv * (F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * (F.lit(1 / 1680) - inv2 * (5 / 5940)))))
    big = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + series
    steps = F.lit(0.0)
    for k in range(1, 11):
        steps = steps + F.log(n.cast("double") + k)
    return F.when(n < 2, F.lit(0.0)).otherwise(big - steps)


def log_binomial(p: Column, n: Column, hits: Column) -> Column:
    """Log-likelihood of ``hits`` out of ``n`` at probability p, exact at the ends (FN2)."""
    q = F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))
    misses = n - hits
    hit_part = F.when(q == 0, F.when(hits == 0, F.lit(0.0)).otherwise(NEG_INF())).otherwise(F.log(q) * hits)
    miss_part = F.when(q == 1, F.when(misses == 0, F.lit(0.0)).otherwise(NEG_INF())).otherwise(F.log1p(-q) * misses)
    return hit_part + miss_part + log_factorial(n) - log_factorial(misses) - log_factorial(hits)


_GRID = 100  # interval ends are found on a grid of 1/(100 n)


def _log_likelihood(x: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Log-likelihood at grid point x, i.e. p = x / (100 n), without the binomial coefficient."""
    p = x / (_GRID * n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h == 0, 0.0, np.log(p) * h) + np.where(n == h, 0.0, np.log1p(-p) * (n - h))


def _grid_search(lo: np.ndarray, hi: np.ndarray, rising: bool, n: np.ndarray, h: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Grid point whose likelihood is nearest to the goal, by bisection of all rows together."""
    while (open_ := hi > lo + 1).any():
        mid = (lo + hi) // 2
        short = _log_likelihood(mid, n, h) < goal if rising else _log_likelihood(mid, n, h) > goal
        lo, hi = np.where(open_ & short, mid, lo), np.where(open_ & ~short, mid, hi)
    gaps = []
    for x in (lo, hi):
        v = _log_likelihood(x, n, h)
        with np.errstate(invalid="ignore"):
            gaps.append(np.where(v == goal, 0.0, np.abs(v - goal)))
    return np.where(gaps[1] < gaps[0], hi, lo) / (_GRID * n)


def fit_binomial(shots: Column, hits: Column, factor: float) -> Column:
    """Best ratio and the lowest and highest ratio whose likelihood is within ``factor`` of the best (FN3).

    Bisection on the integer grid, over whole Arrow batches: the same search as a fold over a sequence runs
    interpreted and took over ten times as long on 100,000 rows.
    """
    if factor < 1:
        raise ValueError(f"likelihood factor {factor} is below 1")
    log_factor = math.log(factor)

    @F.pandas_udf("low double, best double, high double")
    def fit(shots: pd.Series, hits: pd.Series) -> pd.DataFrame:
        empty = (shots == 0).to_numpy()
        n, h = np.where(empty, 1, shots.to_numpy()), hits.to_numpy()
        goal = _log_likelihood(_GRID * h, n, h) - log_factor
        low = _grid_search(np.zeros_like(h), _GRID * h, True, n, h, goal)
        high = _grid_search(_GRID * h, _GRID * n, False, n, h, goal)
        pick = lambda v, default: np.where(empty, default, v)
        return pd.DataFrame({"low": pick(low, 0.0), "best": pick(h / n, 0.5), "high": pick(high, 1.0)})

    return fit(shots.cast("long"), hits.cast("long"))


def piece_rate(shot_rate: Column, pieces: Column | float, values: Column | float = 1) -> Column:
    """Failure rate per piece when a shot's failure is an OR over ``values`` of XORs over ``pieces`` (FN4).

    A rate outside 0 to 1, or a number of pieces that is not positive, raises.
    """
    n = pieces if isinstance(pieces, Column) else F.lit(float(pieces))
    v = values if isinstance(values, Column) else F.lit(float(values))
    s = shot_rate.cast("double")

    def split_or(p: Column) -> Column:
        return F.when(p == 1, F.lit(1.0)).otherwise(-F.expm1(F.log1p(-p) / v))

    def xor_root(p: Column) -> Column:
        small = F.least(p, 1 - p)
        root = F.when(small == 0.5, F.lit(0.5)).otherwise(-F.expm1(F.log1p(-2 * small) / n) / 2)
        root = F.when(root == 0, small / n).otherwise(root)
        return F.when(p > 0.5, 1 - root).otherwise(root)

    def join_or(p: Column) -> Column:
        return F.when(p == 1, F.lit(1.0)).otherwise(-F.expm1(F.log1p(-p) * v))

    refuse = F.raise_error(F.lit("a rate must lie between 0 and 1 and the number of pieces be positive")).cast("double")
    return F.when((s < 0) | (s > 1) | (n <= 0), refuse).when(n == 1, s).when(v == 1, xor_root(s)).otherwise(join_or(xor_root(split_or(s))))


def fit_line(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates: least-squares slope and intercept (FN5)."""
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x)}


def fit_line_slope(x: Column, y: Column, extra: float) -> dict[str, Column]:
    """Aggregates: best slope and the slopes whose squared error, intercept re-fitted, grows by ``extra`` (FN6).

    The cost of slope s is cost* + Sxx (s - s*)^2.
    """
    half = F.sqrt(F.lit(float(extra)) / F.nullif(F.regr_sxx(y, x), F.lit(0.0)))
    best = F.regr_slope(y, x)
    return {"low": best - half, "best": best, "high": best + half}


def fit_line_y_at_x(x: Column, y: Column, x0: float, extra: float) -> dict[str, Column]:
    """Aggregates: fitted y at x0 and its range over lines whose squared error grows by ``extra`` (FN7)."""
    spread = 1 / F.regr_count(y, x) + F.pow(F.regr_avgx(y, x) - x0, 2) / F.nullif(F.regr_sxx(y, x), F.lit(0.0))
    half = F.sqrt(F.lit(float(extra)) * spread)
    best = F.regr_slope(y, x) * x0 + F.regr_intercept(y, x)
    return {"low": best - half, "best": best, "high": best + half}


def rescale(v: Column, scale: str, invert: bool = False) -> Column:
    """Axis transform: linear, log or sqrt, and back (FN8). The logarithm of 0 is -inf, below it NaN."""
    if scale == "linear":
        return v.cast("double")
    if scale == "log":
        # F.log gives NULL at 0 and below, which would pass for a missing value.
        return F.exp(v) if invert else F.when(v == 0, NEG_INF()).when(v < 0, F.lit(float("nan"))).otherwise(F.log(v))
    if scale == "sqrt":
        return F.pow(v, 2) if invert else F.sqrt(v)
    raise ValueError(f"unknown scale {scale!r}")


def round_half_away(v: Column, digits: int) -> Column:
    """ROUND as DuckDB has it on doubles: the value times a power of ten, as a double, goes to the nearest whole number, halves away from zero.

    F.round goes by the shortest decimal of the value, and differs where that product meets a half or leaves one.
    """
    scaled = F.round(v * 10.0**digits) / 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(v)


def combine_limits(a: Column, b: Column) -> Column:
    """Smaller of two limits; NULL stands for no limit (FN11)."""
    return F.least(a, b)


def weight_from_p(p: Column) -> Column:
    """Log odds ln((1-p)/p), signed infinity at the ends (FN12)."""
    return F.when(p == 0, F.lit(float("inf"))).when(p == 1, NEG_INF()).otherwise(
        F.log1p(-p) - F.log(p)
    )


def p_from_weight(w: Column) -> Column:
    return 1 / (1 + F.exp(w))


def quantize_neg_log(p: Column) -> Column:
    """round(-100 ln p) (FN14)."""
    return F.round(-100 * F.log(p)).cast("smallint")


def quantize_weight(w: Column, max_abs: Column, all_integer: Column, levels: int) -> Column:
    """Even integers: scale the weights onto ``levels`` - 1 steps, round half away from zero, double (FN13)."""
    return (F.round(w * weight_scale(max_abs, all_integer, levels) / 2) * 2).cast("long")


def weight_scale(max_abs: Column, all_integer: Column, levels: int) -> Column:
    """What a quantised weight is divided by to get back to the units of the model."""
    factor = F.when(all_integer, F.lit(1.0)).otherwise((levels - 1) / F.nullif(max_abs, F.lit(0.0)))
    return 2 * F.coalesce(factor, F.lit(1.0))


def mask_pack(idx: Column, n_bits: int = bits.NARROW) -> Column:
    """Aggregate: set bits ``idx`` of a mask (FN15): one BIGINT for up to 63 bits, an array of words for more."""
    n_words = bits.words_for(n_bits)
    return bits.or_of(idx, n_words) if n_words else F.bit_or(bit(idx))


def bit(idx: Column) -> Column:
    """BIGINT mask with one bit set, 0 to 62; another index raises instead of wrapping around (see ``bits`` for more)."""
    outside = F.raise_error(F.concat(F.lit("masks hold observables 0 to 62, not "), idx.cast("string"))).cast("bigint")
    return F.when(idx.between(0, 62), F.call_function("shiftleft", F.lit(1).cast("bigint"), idx.cast("int"))).when(idx.isNotNull(), outside)


def mask_unpack(mask: Column, n_bits: int) -> Column:
    """Indices of the set bits, lowest first."""
    return bits.Masks(bits.words_for(n_bits) > 0).indices(mask, n_bits)


def mask_of(idx: Column, n_bits: int) -> Column:
    """Mask of the kind that ``mask_pack`` makes, with one bit set."""
    n_words = bits.words_for(n_bits)
    return bits.single(idx, n_words) if n_words else bit(idx)


def fixed_text(x: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, rounding the exact binary value half to even.

    The decision compares the double with the exact midpoint: x is split into two halves whose products
    with the scale are exact.
    """
    s = 10**digits
    k = F.floor(x * s)
    wide = x * 134217729.0
    head = wide - (wide - x)
    tail = x - head
    side = (head * (2 * s) - (2 * k + 1)) + tail * (2 * s)
    n = F.when(side > 0, k + 1).when(side < 0, k).otherwise(k + F.pmod(k, F.lit(2)))
    whole = F.floor(n / s).cast("long")
    part = F.lpad((n - whole * s).cast("long").cast("string"), digits, "0")
    return F.concat(whole.cast("string"), F.lit("."), part) if digits else whole.cast("string")
