"""Differential-privacy noise as columns of a number drawn from a key, so that reruns and layouts give the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed only: 52 bits of a digest."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def laplace(value: Column, key: Column, epsilon: float, sensitivity: float = 1.0, seed: int = 0) -> Column:
    """``value`` plus Laplace noise of scale sensitivity / epsilon; rows of one key get the same noise."""
    if not 0.01 <= epsilon <= 10 or not 1e-10 <= sensitivity <= 1e6:
        raise ValueError("epsilon must be in 0.01..10 and sensitivity in 1e-10..1e6")
    u = uniform(key, seed) - 0.5
    return value - sensitivity / epsilon * F.signum(u) * F.log(F.greatest(1 - 2 * F.greatest(F.abs(u), F.lit(1e-10)), F.lit(1e-12)))


def randomised_response(value: Column, key: Column, epsilon: float, seed: int = 0) -> Column:
    """The truth with probability e^epsilon / (1 + e^epsilon), else its opposite; null stays null."""
    p = F.exp(F.lit(epsilon)) / (1 + F.exp(F.lit(epsilon)))
    return F.when(uniform(key, seed) < p, value).otherwise(~value)
