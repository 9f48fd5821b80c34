"""Column expressions over the degrees and triangle count of an edge.

Every function takes and returns Columns, so a whole report stays one projection. Degrees are at
least 1 on an edge, which keeps every divisor positive.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def deg_min(du, dv) -> Column:
    return F.least(_c(du), _c(dv))


def deg_max(du, dv) -> Column:
    return F.greatest(_c(du), _c(dv))


def positive_part(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def base_term(du, dv) -> Column:
    """Degree-only part of Balanced Forman: ``2/du + 2/dv - 2``."""
    return F.lit(2.0) / _c(du) + F.lit(2.0) / _c(dv) - F.lit(2.0)


def tri_weight(du, dv) -> Column:
    """Weight of one triangle in Balanced Forman: ``2/max + 1/min``."""
    return F.lit(2.0) / deg_max(du, dv) + F.lit(1.0) / deg_min(du, dv)


def spread_term(du, dv) -> Column:
    """``1 - 1/min - 1/max``; negative only when one end is a leaf."""
    return F.lit(1.0) - F.lit(1.0) / deg_min(du, dv) - F.lit(1.0) / deg_max(du, dv)


def tri_share_max(du, dv, tri) -> Column:
    """Triangles relative to the larger degree."""
    return _c(tri) / deg_max(du, dv)


def tri_share_min(du, dv, tri) -> Column:
    """Triangles relative to the smaller degree."""
    return _c(tri) / deg_min(du, dv)


def laziness(d) -> Column:
    """Mass a lazy walk keeps at a node of degree d: ``1/(d+1)``."""
    return F.lit(1.0) / (_c(d) + F.lit(1))


#: Mass the lazy walk puts on each neighbour; equal to the mass it keeps.
neighbor_mass = laziness


def mass_scale(du, dv) -> Column:
    """``du + dv + 2``."""
    return _c(du) + _c(dv) + F.lit(2)


def shared_mass(du, dv) -> Column:
    """Overlap of the two lazy measures at either end."""
    return F.least(laziness(du), laziness(dv))


def mass_excess(du, dv) -> list[Column]:
    """The four positive parts of the mass differences at the ends; they sum to ``2|au - av|``."""
    au, av = laziness(du), laziness(dv)
    return [positive_part(au - av), positive_part(av - au),
            positive_part(av - au), positive_part(au - av)]


def mass_gap(du, dv) -> Column:
    """``|1/(du+1) - 1/(dv+1)|``."""
    return F.abs(laziness(du) - laziness(dv))


def quad_term(n_quad, quad_cap) -> Column:
    """4-cycle contribution: ``n_quad / quad_cap`` where both are positive, else 0."""
    num, den = _c(n_quad), _c(quad_cap)
    return F.when((num > 0) & (den > 0), F.try_divide(num.cast("double"), den)).otherwise(0.0)


def balanced_forman(du, dv, tri, quad) -> Column:
    """Balanced Forman curvature; 0 when one end is a leaf."""
    return F.when(deg_min(du, dv) <= 1, F.lit(0.0)).otherwise(
        base_term(du, dv) + tri_weight(du, dv) * _c(tri) + _c(quad)
    )


def envelope_const(du, dv) -> Column:
    """Value of the linear envelope without triangles."""
    return (F.lit(-1.0) + F.lit(4.0) * shared_mass(du, dv) + F.lit(2.0) * mass_gap(du, dv)
            + (_c(du) + _c(dv) - F.lit(2)) / mass_scale(du, dv))


def envelope_slope(du, dv) -> Column:
    """Gain of the linear envelope per triangle."""
    return laziness(du) + laziness(dv) - F.lit(2.0) / mass_scale(du, dv)


def linear_envelope(du, dv, t) -> Column:
    """``const + slope * t``; pass the triangle column for the value at the true count."""
    return envelope_const(du, dv) + envelope_slope(du, dv) * _c(t)


def transport_envelope(du, dv, tri, n_quad) -> Column:
    """Closed-form cap on the lazy transport curvature, with its parts as a struct."""
    du, dv, tri, n_quad = _c(du), _c(dv), _c(tri), _c(n_quad)
    mu, mv = neighbor_mass(du), neighbor_mass(dv)
    own_u = (du - 1 - tri) * mu
    own_v = (dv - 1 - tri) * mv
    quad_part = positive_part(F.least(own_u, own_v, n_quad / mass_scale(du, dv)))
    tri_part = F.least(tri * F.abs(mu - mv), own_u + own_v)
    shared = shared_mass(du, dv)
    ru, ru_rev, rv, rv_rev = mass_excess(du, dv)
    upper = (F.lit(-1.0) + F.lit(4.0) * shared + (ru + ru_rev + rv + rv_rev)
             + F.lit(2.0) * tri * F.least(mu, mv) + quad_part + tri_part)
    return F.struct(
        upper.alias("upper"), shared.alias("shared_u"), shared.alias("shared_v"),
        ru.alias("excess_u"), ru_rev.alias("excess_u_rev"),
        rv.alias("excess_v"), rv_rev.alias("excess_v_rev"),
        quad_part.alias("quad_part"), tri_part.alias("tri_part"),
        mass_scale(du, dv).cast("double").alias("scale"),
        mu.alias("mass_u"), mv.alias("mass_v"),
    )
