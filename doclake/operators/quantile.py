"""Exact quantiles of a numeric column without sorting it or gathering it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

BINS = 1024


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The ``q`` quantile with linear interpolation between neighbours.

    Every pass counts the values of the current range in ``BINS`` equal bins (one combinable
    aggregate, at most ``BINS`` result rows) and goes on in the bin that holds the wanted
    rank. It ends when the two neighbouring ranks fall in two bins or on one value.
    """
    x = F.col(column)
    df = df.where(x.isNotNull())
    total = df.agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if not total["n"]:
        return None
    position = q * (total["n"] - 1)
    k = math.floor(position)
    lo, hi, below = total["lo"], total["hi"], 0

    def mix(a: float, b: float) -> float:
        return a + (b - a) * (position - k)

    while lo < hi:
        bin_ = F.least(F.floor((x - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        bins = sorted(
            df.where(x.between(lo, hi)).groupBy(bin_.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect(),
            key=lambda r: r["bin"],
        )
        for i, r in enumerate(bins):
            if below + r["n"] > k:
                break
            below += r["n"]
        if below + r["n"] == k + 1:  # rank k closes its bin, rank k + 1 opens the next one
            return mix(r["hi"], bins[i + 1]["lo"] if i + 1 < len(bins) else hi) if position > k else r["hi"]
        lo, hi = r["lo"], r["hi"]
    return lo
