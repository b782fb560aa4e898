"""Searches for the cheapest segment length, held against the full sweep of the cost table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profiles import cheapest


def sampled(costs: DataFrame, evaluations: int, seed: int) -> DataFrame:
    """The cheapest of a number of segments drawn by hash order."""
    drawn = costs.orderBy(F.xxhash64(F.lit(seed), "segment"), "segment").limit(evaluations)
    return cheapest(drawn)


def herded(cost, low: int, high: int, herd: int = 12, rounds: int = 5, lead: float = 1.0, seed: int = 0) -> dict:
    """A herd that moves members worse than the mean halfway to the best one; ``cost`` takes an array of segments.

    Midpoints never leave the interval of the first positions, so a better length
    outside it cannot be reached; the interval is given out as ``reach``.
    """
    rng = np.random.default_rng(seed)
    at = rng.uniform(max(low, lead * low), high, herd)
    reach = (float(at.min()), float(at.max()))
    best, best_cost = None, np.inf
    for _ in range(rounds):
        values = cost(np.rint(at))
        i = int(values.argmin())
        if values[i] < best_cost:
            best, best_cost = int(round(at[i])), float(values[i])
        at = np.where(values > values.mean() * lead, (at + best) / 2, at)
    return {"segment": best, "total_s": best_cost, "evaluations": herd * rounds, "reach": reach}


def gap(found: float, optimum: float) -> float:
    """How much dearer than the optimum, in percent."""
    return 100 * (found - optimum) / optimum
