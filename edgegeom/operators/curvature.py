"""Balanced Forman and transport curvatures of every edge."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import params as P
from .local import HEAVY_DEGREE, local_structure
from .transport import with_transport


def forman_table(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Local structure plus ``quad_term`` and ``bf``."""
    return (
        local_structure(degreed, heavy_degree)
        .withColumn("quad_term", P.quad_term("n_quad", "quad_cap"))
        .withColumn("bf", P.balanced_forman("deg_u", "deg_v", "n_tri", "quad_term"))
    )


def curvature_table(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Local structure, Balanced Forman and both transport curvatures."""
    return with_transport(forman_table(degreed, heavy_degree), degreed, heavy_degree)
