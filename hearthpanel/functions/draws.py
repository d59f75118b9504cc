"""Reproducible random draws that depend on a key and a seed, never on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int | str | Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Uniform draw in (lo, hi): the first 32 bits of md5(key|seed)."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digits = F.substring(F.md5(F.concat_ws("|", key.cast("string"), seed.cast("string"))), 1, 8)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return unit * (hi - lo) + lo


def normal(key: Column, seed: int | str | Column) -> Column:
    """Standard normal draw from two uniforms (Box-Muller)."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    radius = F.sqrt(-2.0 * F.ln(uniform(key, F.concat(seed, F.lit("a")))))
    return radius * F.cos(2.0 * math.pi * uniform(key, F.concat(seed, F.lit("b"))))
