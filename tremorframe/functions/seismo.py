"""Classic aftershock laws as column expressions.

Times are hours after the mainshock unless a name says days.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tremorframe.functions.scalar import clip

# The published defaults the forecasts must agree with.
BATH_DELTA = -1.2
OMORI_FALLBACK = (50.0, 0.01, 1.0)  # K, c (days), p
OMORI_K_BOUNDS = (1e-3, 1e6)
OMORI_C_BOUNDS = (1e-5, 5.0)
OMORI_P_BOUNDS = (0.3, 2.5)


@dataclass(frozen=True)
class RjParams:
    """Reasenberg-Jones parameters; defaults are the global averages."""

    a: float = -1.67
    b: float = 0.91
    p: float = 1.08
    c_days: float = 0.05


@dataclass(frozen=True)
class EtasParams:
    mu: float = 0.01
    k: float = 0.03
    alpha: float = 1.0
    c_days: float = 0.01
    p: float = 1.1
    b: float = 0.91
    m_min: float = 3.0


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def bath(mag: Column, delta: float = BATH_DELTA) -> Column:
    return mag + F.lit(delta)


def omori_rate(t_days: Column | float, k: Column | float, c: Column | float, p: Column | float) -> Column:
    """Aftershocks per day."""
    return _col(k) / F.pow(F.greatest(_col(t_days) + _col(c), F.lit(1e-9)), _col(p))


def omori_integral(
    t1_days: Column | float,
    t2_days: Column | float,
    c: Column | float,
    p: float,
    lower_floor: float = 1e-9,
) -> Column:
    """Integral of ``(t+c)^-p`` over a window; the logarithm where p is one."""
    upper = _col(t2_days) + _col(c)
    lower = F.greatest(_col(t1_days), F.lit(lower_floor)) + _col(c)
    if abs(p - 1.0) < 1e-6:
        return F.log(upper / lower)
    q = 1.0 - p
    return (F.pow(upper, F.lit(q)) - F.pow(lower, F.lit(q))) / F.lit(q)


def rj_expected_count(
    main_mag: Column, min_mag: float, t1_h: Column, t2_h: Column, a: Column | float, rj: RjParams
) -> Column:
    """Expected number of aftershocks of at least ``min_mag`` in a window."""
    integral = omori_integral(t1_h / 24.0, t2_h / 24.0, rj.c_days, rj.p)
    productivity = F.pow(F.lit(10.0), _col(a) + F.lit(rj.b) * (main_mag - F.lit(min_mag)))
    return productivity * F.greatest(integral, F.lit(0.0))


def rj_max_mag(
    main_mag: Column, t1_h: Column, t2_h: Column, a: Column | float, rj: RjParams, floor: float = 3.0
) -> Column:
    """Median largest aftershock: the magnitude expected ln 2 times in the window."""
    integral = F.greatest(
        omori_integral(t1_h / 24.0, t2_h / 24.0, rj.c_days, rj.p), F.lit(1e-10)
    )
    target = F.log10(F.lit(math.log(2.0)) / integral)
    return clip(main_mag - (target - _col(a)) / F.lit(rj.b), floor, main_mag - 0.1)


def etas_weight(mag: Column, etas: EtasParams) -> Column:
    """Productivity of an event of magnitude ``mag``."""
    return F.lit(etas.k) * F.exp(F.lit(etas.alpha) * (mag - F.lit(etas.m_min)))


def etas_decay(lag_days: Column, etas: EtasParams) -> Column:
    """Share of its productivity an event still has ``lag_days`` later."""
    return F.pow(lag_days + F.lit(etas.c_days), F.lit(-etas.p))


# Terms of the sum over hours that are added one by one, and what follows them: the
# even Bernoulli numbers over their factorials (fixed values).
NEAR_HOURS = 16
EULER_MACLAURIN = (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600)


def etas_decay_sum(lag_days: Column, n_hours: Column, etas: EtasParams) -> Column:
    """``etas_decay`` at ``lag_days`` and each full hour after it, ``n_hours`` values in all, added up.

    The first ``NEAR_HOURS`` are added as they are; the rest is the integral with the
    corrections of Euler and Maclaurin, so the cost does not depend on the number of
    hours. The first term left out bounds the error: with these lags below 1e-12 of the term
    the far part starts with, for any exponent up to 2.
    """
    step, p = 1.0 / 24.0, etas.p
    first = lag_days + F.lit(etas.c_days)

    def at(hours: Column | int) -> Column:
        return first + F.lit(step) * hours

    near = F.lit(0.0)
    for i in range(NEAR_HOURS):
        near = near + F.when(F.lit(i) < n_hours, F.pow(at(i), F.lit(-p))).otherwise(0.0)
    u, v = at(NEAR_HOURS), at(n_hours)
    fu, fv = F.pow(u, F.lit(-p)), F.pow(v, F.lit(-p))
    area = F.log(v / u) if abs(p - 1.0) < 1e-9 else (fv * v - fu * u) / F.lit(1.0 - p)
    far = area / F.lit(step) + (fu - fv) / 2.0
    rising = 1.0
    for k, share in enumerate(EULER_MACLAURIN):
        order = 2 * k + 1
        rising *= p if k == 0 else (p + order - 2) * (p + order - 1)
        scale = share * step**order * rising
        far = far + F.lit(scale) * (fu / F.pow(u, F.lit(order)) - fv / F.pow(v, F.lit(order)))
    return near + F.when(n_hours > NEAR_HOURS, far).otherwise(0.0)


def etas_max_from_total(total: Column, etas: EtasParams) -> Column:
    """Largest magnitude expected from a summed rate."""
    grown = F.lit(etas.m_min) + F.log(total) / F.lit(etas.b * math.log(10.0))
    return F.when(total < 0.01, F.lit(etas.m_min)).otherwise(clip(grown, etas.m_min, 9.5))


def error_credit(error: Column, full_below: float, zero_above: float) -> Column:
    """One up to ``full_below``, zero from ``zero_above``, linear between."""
    size = F.abs(error)
    return clip((F.lit(zero_above) - size) / F.lit(zero_above - full_below), 0.0, 1.0)
