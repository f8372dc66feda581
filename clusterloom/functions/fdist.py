"""Quantiles of the F distribution, which Spark has no function for.

With z = ln F the density is proportional to
``exp(d1/2 * z - (d1+d2)/2 * log1p(d1/(d1+d2) * expm1(z)))``: smooth, with its
top at z = 0, and free of cancellation for the degrees of freedom of very large
groups.  The probability is integrated numerically and inverted by bisection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Beyond this log density (relative to the top) the tails are below rounding.
TAIL = -45.0
PANELS = 32
NODES, WEIGHTS = np.polynomial.legendre.leggauss(16)


def _log_density(z: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    # for large z, log1p(r * expm1(z)) is about z + ln(r); expm1 would overflow
    r = d1 / (d1 + d2)
    with np.errstate(over="ignore"):
        bent = np.where(z < 500.0, np.log1p(r * np.expm1(np.minimum(z, 500.0))), z + np.log(r))
    return d1 / 2.0 * z - (d1 + d2) / 2.0 * bent


def _tail_end(d1: np.ndarray, d2: np.ndarray, sign: float) -> np.ndarray:
    """Where the density has fallen to ``TAIL`` on one side of the top."""
    width = np.sqrt(2.0 / d1 + 2.0 / d2)
    far = width.copy()
    while np.any(high := _log_density(sign * far, d1, d2) > TAIL):
        far = np.where(high, far * 1.5, far)
    return sign * far


def _mass(lo: np.ndarray, hi: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Integral of the unnormalised density between ``lo`` and ``hi``."""
    step = (hi - lo) / PANELS
    total = np.zeros_like(lo)
    for panel in range(PANELS):
        middle = lo + (panel + 0.5) * step
        z = middle[:, None] + step[:, None] / 2.0 * NODES
        total += np.exp(_log_density(z, d1[:, None], d2[:, None])) @ WEIGHTS
    return total * step / 2.0


def f_quantile(p, d1, d2) -> np.ndarray:
    """x with P(F(d1, d2) <= x) = p, elementwise; NaN outside the domain."""
    p, d1, d2 = (np.atleast_1d(np.asarray(a, dtype=np.float64)) for a in (p, d1, d2))
    p, d1, d2 = np.broadcast_arrays(p, d1, d2)
    result = np.full(p.shape, np.nan)
    ok = (p > 0) & (p < 1) & (d1 > 0) & (d2 > 0)
    if ok.any():
        p, d1, d2 = p[ok], d1[ok], d2[ok]
        lo, hi = _tail_end(d1, d2, -1.0), _tail_end(d1, d2, 1.0)
        start, end = lo.copy(), hi.copy()
        total = _mass(start, np.zeros_like(start), d1, d2) + _mass(np.zeros_like(end), end, d1, d2)
        for _ in range(64):
            z = (lo + hi) / 2.0
            # integrate the nearer tail, which keeps small probabilities exact
            left = z < 0
            part = _mass(np.where(left, start, z), np.where(left, z, end), d1, d2) / total
            below = np.where(left, part < p, part > 1.0 - p)
            lo, hi = np.where(below, z, lo), np.where(below, hi, z)
        result[ok] = np.exp((lo + hi) / 2.0)
    return result


@F.arrow_udf(T.DoubleType())
def f_quantile_udf(p: pa.Array, d1: pa.Array, d2: pa.Array) -> pa.Array:
    """Column form of :func:`f_quantile`; null in, null out."""
    values = [
        np.asarray(a.to_numpy(zero_copy_only=False), dtype=np.float64) for a in (p, d1, d2)
    ]
    quantiles = f_quantile(*values)
    return pa.array(quantiles, mask=np.isnan(quantiles))
