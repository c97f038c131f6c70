"""Seeded uniform and Laplace columns that do not depend on partitioning.

``u(seed, key)`` takes 52 bits of ``md5(seed|key...)`` and centres them in
(0, 1).  The same key always gets the same draw, however the rows are spread
over tasks, so splits survive task retries and can be repeated by any engine
that has md5.

A *known* seed voids a differential-privacy guarantee: production calls leave
``seed=None`` and get a fresh secret one that is never written anywhere.
"""

from __future__ import annotations

import hashlib
import math
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(1 << 52)


def fresh_seed() -> str:
    return secrets.token_hex(16)


def digest(seed: str | int, *keys: str | Column) -> Column:
    """md5 of the seed and the key columns as hex digits; a null key part reads as ''."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def uniform(seed: str | int, *keys: str | Column) -> Column:
    """Uniform double in (0, 1) for the key columns; a null key part reads as ''."""
    bits = F.conv(F.substring(digest(seed, *keys), 1, 13), 16, 10).cast("bigint").cast("double")
    return (bits + F.lit(0.5)) / F.lit(_SCALE)


def uniform_value(seed: str | int, *keys: object) -> float:
    """Driver-side twin of :func:`uniform` for a handful of coefficients."""
    digest = hashlib.md5("|".join([str(seed), *map(str, keys)]).encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / _SCALE


def laplace(u: Column, scale: float | Column) -> Column:
    """Inverse-CDF Laplace draw from a uniform column."""
    centred = u - F.lit(0.5)
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -scale * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def laplace_value(u: float, scale: float) -> float:
    centred = u - 0.5
    return -scale * math.copysign(1.0, centred) * math.log(1.0 - 2.0 * abs(centred))
