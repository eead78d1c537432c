"""Seeded draws: every draw is a pure function of its key parts, so partitioning never changes it."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from transitloom import constants as C

TWO_PI = 6.283185307179586


def stable_hash(*parts: Column) -> Column:
    """First 13 hex digits of SHA-256 over the parts joined by a bar, as BIGINT (52 bits)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def pick(n: Column, *parts: Column) -> Column:
    """The first 16 hex digits of the same digest, as an unsigned number, modulo ``n`` (under 2 ** 31)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    half = lambda start: F.conv(F.substring(F.sha2(text, 256), start, 8), 16, 10).cast("bigint")
    return F.pmod(F.pmod(half(1), n) * F.pmod(F.lit(1 << 32), n) + half(9), n)


def uniform(*parts: Column) -> Column:
    return (stable_hash(*parts) + 0.5) / float(2**52)


def clamped_normal(mean: float, std: float, low: float, high: float, *parts: Column) -> Column:
    u1, u2 = uniform(*parts, F.lit("a")), uniform(*parts, F.lit("b"))
    z = F.sqrt(-2.0 * F.ln(u1)) * F.cos(TWO_PI * u2)
    return F.greatest(F.lit(low), F.least(F.lit(high), mean + std * z))


def poisson_cdf(lam: float) -> list[float]:
    """Cumulative probabilities P(X<=0), P(X<=1), ... until they no longer grow in double arithmetic."""
    total, term, k, steps = 0.0, math.exp(-lam), 0, []
    while True:
        grown = total + term
        if grown == total and k > lam:
            return steps
        total = grown
        steps.append(total)
        k += 1
        term *= lam / k


def _place(u: Column, cdf: list[float], low: int = 0, high: int | None = None) -> Column:
    """Number of steps below ``u``, by halving: a nested comparison over the sorted literals."""
    high = len(cdf) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(u > cdf[mid], _place(u, cdf, mid + 1, high)).otherwise(_place(u, cdf, low, mid))


def places(uniforms: Column, cdf: list[float]) -> Column:
    """Draws for an array of uniforms; each is evaluated once, as it is the argument of a lambda."""
    return F.transform(uniforms, lambda u: _place(u, cdf))


def places_for_weight(weight: Column, uniforms: Column) -> Column:
    """Poisson(weight * scale) for an array of uniforms and a weight that is one of the band weights; null for any other."""
    picked = None
    for w in sorted({band[3] for band in C.TIME_BANDS}):
        drawn = places(uniforms, poisson_cdf(w * C.POISSON_SCALE))
        picked = F.when(weight == w, drawn) if picked is None else picked.when(weight == w, drawn)
    return picked


def poisson(lam: float, *parts: Column) -> Column:
    return F.get(places(F.array(uniform(*parts)), poisson_cdf(lam)), F.lit(0))
