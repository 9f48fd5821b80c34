"""Transfer bounds between Balanced Forman and lazy transport curvature, as columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, functions as F

from . import params as P

#: Slack allowed when a curvature is compared with its envelope (fixed value).
ENVELOPE_TOLERANCE = 1e-12
#: Two lines closer than this in slope are treated as parallel (fixed value).
PARALLEL_TOLERANCE = 1e-15


def chosen_laziness(du, dv, plain: Column | None) -> Column:
    """Smaller of the two kept masses; the larger one where the plain curvature is negative."""
    au, av = P.laziness(du), P.laziness(dv)
    small = F.least(au, av)
    if plain is None:
        return small
    return F.when(plain >= 0, small).otherwise(F.greatest(au, av))


def lazy_lower_from_forman(zeta, du, dv, quad, plain: Column | None = None) -> Column:
    """Lower bound on the lazy curvature given a Balanced Forman value.

    Pass ``plain`` (the non-lazy curvature) for the sign-sharpened form.
    """
    zeta, quad = P._c(zeta), P._c(quad)
    small, large = P.deg_min(du, dv), P.deg_max(du, dv)
    over_base = zeta - P.base_term(du, dv)
    weight = P.tri_weight(du, dv)
    need = P.positive_part((over_base - quad) / weight)
    surplus = P.positive_part(over_base - weight * (small - 1))
    floor = F.lit(0.5) * F.greatest(quad, surplus)
    spread = P.spread_term(du, dv)
    near, far = need / large, need / small
    phi = (-P.positive_part(spread - near - floor) - P.positive_part(spread - far - floor) + near)
    return (F.lit(1.0) - chosen_laziness(du, dv, plain)) * phi - P.mass_gap(du, dv)


def lazy_upper_from_forman(zeta, du, dv) -> Column:
    """Upper bound on the lazy curvature given a Balanced Forman value.

    The bound is the maximum over a relaxed triangle count t of a function built from four
    falling lines; it peaks at an end of the range or where two of the lines cross, so it is
    evaluated at those points only.
    """
    du, dv = P._c(du), P._c(dv)
    over_base = P.positive_part(P._c(zeta) - P.base_term(du, dv))
    weight = P.tri_weight(du, dv)
    scale = P.mass_scale(du, dv)
    mu, mv = P.neighbor_mass(du), P.neighbor_mass(dv)
    large = P.deg_max(du, dv).cast("double")
    quad_rate = large * (large - 1.0) / scale
    gap = F.abs(mu - mv)
    # (value at t = 0, fall per unit of t)
    lines = [
        (mu * (du - 1), mu),
        (mv * (dv - 1), mv),
        (quad_rate * over_base, quad_rate * weight),
        ((du + dv - 2) / scale, F.lit(2.0) / scale),
    ]
    t_max = F.least(P.deg_min(du, dv) - 1.0, over_base / weight)
    points = [F.lit(0.0), t_max]
    for (a0, a1), (b0, b1) in combinations(lines, 2):
        turn = a1 - b1
        points.append(F.when(F.abs(turn) > PARALLEL_TOLERANCE, F.try_divide(a0 - b0, turn)))
    points.append((mu * (du - 1) + mv * (dv - 1)) / (mu + mv + gap))

    def value(t: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(t_max, t))
        heights = [start - fall * t for start, fall in lines]
        return (F.lit(2.0) * t * F.least(mu, mv) + P.positive_part(F.least(*heights))
                + F.least(t * gap, heights[0] + heights[1]))

    # A missing crossing is read as the end of the range, which is tried anyway.
    best = F.greatest(*[value(t) for t in points])
    start = F.lit(-1.0) + F.lit(4.0) * P.shared_mass(du, dv) + F.lit(2.0) * gap
    return start + best


def forman_lower_from_lazy(theta, du, dv, tri=None) -> Column:
    """Lower bound on Balanced Forman given a lazy curvature.

    With the triangle count the robust form is used: leaf edges give 0, and a value above the
    linear envelope gives the bound at the true count.
    """
    theta = P._c(theta)
    base, weight = P.base_term(du, dv), P.tri_weight(du, dv)
    const, slope = P.envelope_const(du, dv), P.envelope_slope(du, dv)
    need = F.when(slope > 0, P.positive_part((theta - const) / slope)).otherwise(0.0)
    need = F.least(need, P.deg_min(du, dv) - 1.0)
    if tri is None:
        return base + weight * need
    tri = P._c(tri)
    inside = (slope > ENVELOPE_TOLERANCE) & (theta <= const + slope * tri + ENVELOPE_TOLERANCE)
    return (
        F.when(P.deg_min(du, dv) <= 1, F.lit(0.0))
        .when(~inside, base + weight * tri)
        .otherwise(base + weight * F.least(need, tri.cast("double")))
    )


def plain_tradeoff(du, dv, t, floor) -> Column:
    """Smallest plain curvature compatible with t triangles and a 4-cycle floor."""
    t = P._c(t)
    spread = P.positive_part(P.spread_term(du, dv) - P.positive_part(P._c(floor)))
    near, far = t / P.deg_max(du, dv), t / P.deg_min(du, dv)
    return -P.positive_part(spread - near) - P.positive_part(spread - far) + near


def tradeoff_inverse(du, dv, level, floor) -> Column:
    """Largest t in [0, min degree - 1] whose tradeoff stays at or below ``level``.

    The tradeoff is the minimum of three rising lines, so its inverse is the maximum of theirs.
    """
    level = P._c(level)
    spread = P.positive_part(P.spread_term(du, dv) - P.positive_part(P._c(floor)))
    large = P.deg_max(du, dv)
    t = F.greatest(
        (level + 2.0 * spread) / P.tri_weight(du, dv),
        (level + spread) * large / 2.0,
        level * large,
    )
    return F.greatest(F.lit(0.0), F.least(t, P.deg_min(du, dv) - 1.0))


def forman_upper_from_lazy(theta, du, dv, quad, plain: Column | None = None) -> Column:
    """Upper bound on Balanced Forman given a lazy curvature.

    Pass ``plain`` (the non-lazy curvature) for the sign-sharpened form.
    """
    quad = P._c(quad)
    level = (P._c(theta) + P.mass_gap(du, dv)) / (F.lit(1.0) - chosen_laziness(du, dv, plain))
    t = tradeoff_inverse(du, dv, level, F.lit(0.5) * quad)
    return P.base_term(du, dv) + P.tri_weight(du, dv) * t + quad
