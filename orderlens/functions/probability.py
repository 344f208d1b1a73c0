"""Tail probabilities and intervals as column expressions (no Python workers)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import column

_SERIES_TERMS = 120
_FRACTION_DEPTH = 80
_GAMMA_STEPS = 12
_TAIL_PANELS = [0.0, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]


def wald_interval(pct: Column | str, n: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Normal-approximation confidence bounds, in percent, of a percentage over ``n`` rows."""
    p = column(pct) / F.lit(100.0)
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / column(n))
    return (p - margin) * 100.0, (p + margin) * 100.0


def two_proportion_z(hits0: Column, n0: Column, hits1: Column, n1: Column) -> Column:
    """Pooled z statistic of the change from ``hits0/n0`` to ``hits1/n1``."""
    h0, m0, h1, m1 = (c.cast("double") for c in (hits0, n0, hits1, n1))
    pooled = (h0 + h1) / (m0 + m1)
    spread = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / m0 + F.lit(1.0) / m1))
    return (h1 / m1 - h0 / m0) / F.nullif(spread, F.lit(0.0))


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic, accurate far into the tail.

    Small |z| sums the positive series of the error function; larger |z| uses
    the continued fraction of its complement, so p does not underflow to zero
    through cancellation.
    """
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    bell = F.exp(-x * x)
    # erf(x) = 2/sqrt(pi) * exp(-x^2) * sum 2^k x^(2k+1) / (1*3*...*(2k+1))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * 2.0 * x * x / (2.0 * k + 1.0)).alias("term"),
            (acc["total"] + acc["term"] * 2.0 * x * x / (2.0 * k + 1.0)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    near = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * bell * series
    # erfc(x) = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + (2/2)/(x + (3/2)/...)))
    fraction = F.aggregate(
        F.sequence(F.lit(_FRACTION_DEPTH), F.lit(1), F.lit(-1)),
        x,
        lambda acc, k: x + (k / F.lit(2.0)) / acc,
    )
    far = bell / F.lit(math.sqrt(math.pi)) / fraction
    return F.when(x < 2.0, near).otherwise(far)


def _gauss_legendre(panels: list[float]) -> list[tuple[float, float]]:
    """Nodes and weights of 12-point rules on neighbouring panels."""
    nodes, weights = np.polynomial.legendre.leggauss(12)
    found = []
    for low, high in zip(panels, panels[1:]):
        half = (high - low) / 2.0
        found += [(low + half * (x + 1.0), half * w) for x, w in zip(nodes, weights)]
    return [(float(x), float(w)) for x, w in found]


def _integral(of: Callable[[Column], Column], panels: list[float]) -> Column:
    rule = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _gauss_legendre(panels)])
    return F.aggregate(rule, F.lit(0.0), lambda total, node: total + node["w"] * of(node["x"]))


def _half_step_gamma(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) by its asymptotic series, moved up to a + 12 where that is exact."""
    moved = a + float(_GAMMA_STEPS)
    series = (
        F.lit(-1.0 / 8.0) / moved
        + F.lit(1.0 / 192.0) / F.pow(moved, 3.0)
        - F.lit(1.0 / 640.0) / F.pow(moved, 5.0)
        + F.lit(17.0 / 14336.0) / F.pow(moved, 7.0)
    )
    ratio = F.sqrt(moved) * F.exp(series)
    for i in range(_GAMMA_STEPS):
        ratio = ratio * (a + float(i)) / (a + i + 0.5)
    return ratio


def student_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of a Student t statistic, in the same number of steps for any size.

    Near the centre p is large and one less the middle part loses nothing. Further
    out the tail itself is integrated, its decay taken out, so p stays exact in
    relative terms however small it is.
    """
    nu, t = dof.cast("double"), F.abs(t)
    scale = _half_step_gamma(nu / 2.0) / F.sqrt(nu * math.pi)
    power = (nu + 1.0) / 2.0
    middle = t * _integral(lambda y: F.exp(-power * F.log1p(y * y * t * t / nu)), [0.0, 0.25, 0.5, 1.0])
    # u^2 = (nu + t^2) e^(v / power) - nu, the density falls as e^-v, and v = w (nu + 1) / nu
    stretch = (nu + 1.0) / nu

    def falling(w: Column) -> Column:
        grown = (nu + t * t) * F.exp(w * stretch / power)
        u = F.sqrt(t * t + (nu + t * t) * F.expm1(w * stretch / power))
        return F.exp(-w * stretch) * grown / (2.0 * power * u) * stretch

    tail = F.exp(-power * F.log1p(t * t / nu)) * _integral(falling, _TAIL_PANELS)
    return F.when(t < 2.0, F.lit(1.0) - 2.0 * scale * middle).otherwise(2.0 * scale * tail)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation over ``n`` pairs.

    Two pairs always lie on a line, so p is 1; a perfect correlation of more has p 0.
    """
    return (
        F.when(n == 2, F.when(r.isNotNull(), F.lit(1.0)))
        .when((n > 2) & (F.abs(r) >= 1.0), F.lit(0.0))
        .when(n > 2, student_two_sided_p(pearson_t(r, n), n - 2))
    )


def pearson_t(r: Column, n: Column) -> Column:
    """t statistic of a Pearson correlation over ``n`` pairs."""
    return r * F.sqrt((n - 2).cast("double") / F.nullif(F.lit(1.0) - r * r, F.lit(0.0)))
