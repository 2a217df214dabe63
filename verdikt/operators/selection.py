"""Exact order statistics of a whole column by refinement of histograms: no task ever holds the values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, and values left at which the rest is sorted.
BINS, FEW = 4096, 10_000


def order_statistics(df: DataFrame, value: Column, ranks: list[int]) -> list[float]:
    """The values at ``ranks`` (from 0, among the values that are neither null nor NaN) in ascending order.

    Each pass counts the values between two bounds in bins and keeps the least and greatest value of the bin that holds
    the rank; a handful of passes leaves one value, or few. Every pass is one grouping with map-side counts.
    """
    v = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    inf = float("inf")
    held = v.agg(F.count("*").alias("n"), F.count_if(F.col("v") == -inf).alias("low"), F.count_if(F.col("v") == inf).alias("high"), *[f(F.when(F.abs("v") < inf, F.col("v"))).alias(c) for f, c in ((F.min, "least"), (F.max, "most"))]).first()
    out: dict[int, float] = {}
    open_ = {}  # rank: least and greatest value it can be, its place among the values between, how many those are
    for r in set(ranks):
        if not 0 <= r < held["n"]:
            raise ValueError(f"rank {r} of {held['n']} values")
        if r < held["low"] or r >= held["n"] - held["high"]:
            out[r] = -inf if r < held["low"] else inf
        else:
            open_[r] = (held["least"], held["most"], r - held["low"], held["n"] - held["low"] - held["high"])
    while open_:
        for r in [r for r, (a, b, _, _) in open_.items() if a == b]:
            out[r] = open_.pop(r)[0]
        for r in [r for r, (_, _, _, n) in open_.items() if n <= FEW]:
            a, b, at, _ = open_.pop(r)
            out[r] = v.filter(F.col("v").between(a, b)).sort("v").offset(at).limit(1).first()["v"]
        spans = sorted({(a, b) for a, b, _, _ in open_.values()})
        if not spans:
            break
        # Halves keep the difference of two great numbers finite.
        bin_ = lambda a, b: F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BINS)).cast("int")
        some = v.withColumn("s", F.explode(F.filter(F.array(*[F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("k"), bin_(a, b).alias("bin"))) for k, (a, b) in enumerate(spans)]), lambda x: x.isNotNull())))
        bins: dict[int, list] = {}
        for row in some.groupBy("s.k", "s.bin").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).sort("k", "bin").collect():  # BINS rows for each rank
            bins.setdefault(row["k"], []).append(row)
        for r, (a, b, at, _) in list(open_.items()):
            for row in bins[spans.index((a, b))]:
                if at < row["n"]:
                    open_[r] = (row["a"], row["b"], at, row["n"])
                    break
                at -= row["n"]
    return [out[r] for r in ranks]


def exact_quantile(df: DataFrame, value: Column, share: float) -> float | None:
    """The quantile, between two values in proportion to their distance; null where there is no value."""
    n = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)").count()
    if not n:
        return None
    at = share * (n - 1)
    low, high = order_statistics(df, value, [math.floor(at), math.ceil(at)])
    return low if low == high else low + (high - low) * (at - math.floor(at))
