"""Random draws that depend only on a seed and the ids of a row.

A draw never depends on partitioning, so a lost task gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(*parts) -> Column:
    """Uniform number in [0, 1) from the MD5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[
        (p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts
    ])
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return digits.cast("double") / float(2**52)
