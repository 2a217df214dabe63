"""Significance on counts. Spark reduces any number of items to counts; helpers finish on rows as small as the report.

Resampling binary outcomes is drawing binomials, swapping paired outcomes only moves discordant ones, and shuffling
labels with fixed margins is a multivariate hypergeometric, so no item is ever resampled. Seeds come from the group's
key: results don't depend on partitioning.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

DRAWS = 10_000


def _with(df: DataFrame, *names: str) -> T.StructType:
    """The schema of ``df`` and more doubles."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """``log(n!)`` less Stirling's approximation of it."""
    n = np.asarray(n, dtype=np.float64)
    small = np.array([0.0, *[math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)]])
    s = 1.0 / np.maximum(n, 1.0) ** 2
    series = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / np.maximum(n, 1.0)
    return np.where(n < 16, small[np.minimum(n, 15).astype(np.int64)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """``x log(x / mean) + mean - x`` without cancellation."""
    d = (x - mean) / np.maximum(mean, 1e-300)
    near = np.abs(d) < 0.1
    e = np.where(near, d, 0.0)
    # mean * ((1 + d) log(1 + d) - d) as a series in d
    series, power = np.zeros_like(e), e * e
    for k in range(2, 20):
        series += power * ((-1) ** k / (k * (k - 1)))
        power = power * e
    far = np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0) / np.maximum(mean, 1e-300)), 0.0) + mean - x
    return np.where(near, mean * series, far)


def binomial_mass(k: np.ndarray, n: int, p: float) -> np.ndarray:
    """Probabilities of ``k`` hits, each to nearly all digits at any ``n``; no array is as long as ``n``."""
    k = np.asarray(k, dtype=np.float64)
    if p <= 0 or p >= 1:
        return (k == (n if p >= 1 else 0)).astype(np.float64)
    rest = n - k
    inside = (k > 0) & (rest > 0)
    x, y = np.where(inside, k, 1.0), np.where(inside, rest, 1.0)
    log = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(y) - _deviance(x, np.float64(n * p)) - _deviance(y, np.float64(n * (1 - p)))
    middle = np.exp(log) * np.sqrt(n / (2 * math.pi * x * y))
    return np.where(inside, middle, np.where(k == 0, math.exp(n * math.log1p(-p)), math.exp(n * math.log(p))) * ((k >= 0) & (rest >= 0)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the regularised incomplete beta function, evaluated forwards (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h, m = d, 1
    while True:
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + step * d, 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16 or m > 10_000_000:
            return h
        m += 1


def binomial_tail(right: int, n: int, p: float) -> float:
    """Probability of ``right`` hits or more: the regularised incomplete beta function of p at (right, n - right + 1)."""
    if right <= 0:
        return 1.0
    if right > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    a, b = float(right), float(n - right + 1)
    if p <= (a + 1) / (a + b + 2):  # else the fraction of the other tail is the short one
        return float(min(1.0, binomial_mass(right, n, p) * (1 - p) * _beta_fraction(a, b, p)))
    return float(min(1.0, max(0.0, 1.0 - binomial_mass(right - 1, n, p) * p * _beta_fraction(b, a, 1 - p))))


def exact_binomial_p(won: int, lost: int) -> float:
    """Two-sided exact p of ``won`` against ``lost`` discordant pairs."""
    return min(1.0, 2.0 * binomial_tail(max(won, lost), won + lost, 0.5)) if won + lost else 1.0


def chance_p(options: list[tuple[int, int]], right: int) -> float:
    """Exact probability of ``right`` or more hits of a uniform guesser; ``options``: (number of options, items) pairs.

    With one number of options it is a binomial tail. Several are convolved, each on a window around its mean; far out
    in the tail their odds are first raised together so that ``right`` is the mean, which the sum takes back.
    """
    sure = sum(n for k, n in options if k <= 1)
    right -= sure
    groups = [(n, 1.0 / k) for k, n in options if k > 1 and n > 0]
    if right <= 0:
        return 1.0
    if right > sum(n for n, _ in groups):
        return 0.0
    if len({p for _, p in groups}) == 1:
        return binomial_tail(right, sum(n for n, _ in groups), groups[0][1])
    raised = lambda t: [p * math.exp(t) / (1 - p + p * math.exp(t)) for _, p in groups]
    mean = lambda t: sum(n * q for (n, _), q in zip(groups, raised(t), strict=True))
    low, high = 0.0, 700.0
    if right > mean(0.0):
        for _ in range(200):
            low, high = (low, (low + high) / 2) if mean((low + high) / 2) >= right else ((low + high) / 2, high)
    tilt = low
    first, size, parts = 0, 1, []
    for (n, _), q in zip(groups, raised(tilt), strict=True):
        reach = 12 * math.sqrt(n * q * (1 - q)) + 40
        begin, end = max(0, math.floor(n * q - reach)), min(n, math.ceil(n * q + reach))
        parts.append(binomial_mass(np.arange(begin, end + 1), n, q))
        first, size = first + begin, size + end - begin
    length = 1 << size.bit_length()
    spectrum = np.ones(length // 2 + 1, dtype=np.complex128)
    for part in parts:
        spectrum *= np.fft.rfft(part, length)
    mass = np.maximum(np.fft.irfft(spectrum, length)[:size], 0.0)
    at = np.arange(first, first + size)
    if tilt == 0.0:
        return float(min(1.0, max(0.0, 1.0 - mass[at < right].sum())))
    log = sum(n * math.log1p(p * math.expm1(tilt)) for n, p in groups) - tilt * right
    kept = at >= right
    return float(min(1.0, math.exp(log) * (mass[kept] * np.exp(-tilt * (at[kept] - right))).sum()))


@pandas_udf(T.DoubleType())
def mcnemar_exact(won: pd.Series, lost: pd.Series) -> pd.Series:
    return pd.Series([exact_binomial_p(int(w), int(l)) for w, l in zip(won, lost, strict=True)], dtype="float64")


def holm(df: DataFrame, p: str, partition: list[str], out: str = "holm") -> DataFrame:
    """Step-down adjusted p-values inside each partition (as many rows as a report has arms); null p stay null."""
    w = Window.partitionBy(*partition).orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(Window.partitionBy(*partition))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn(out, F.when(F.col(p).isNotNull(), F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr(key).encode()))


def bootstrap_interval(right: int, n: int, key: object, draws: int = DRAWS) -> tuple[float, float]:
    if n == 0:
        return 0.0, 0.0
    x = _rng("boot", key).binomial(n, right / n, draws) / n * 100
    return float(np.percentile(x, 2.5)), float(np.percentile(x, 97.5))


def bootstrap_ci(rows: DataFrame, by: list[str]) -> DataFrame:
    """95 % percentile interval of accuracy per group, from (n, right)."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ci = [bootstrap_interval(r, n, tuple(k)) for k, r, n in zip(pdf[by].itertuples(index=False), pdf["right"], pdf["n"], strict=True)]
            yield pdf.assign(low=[a for a, _ in ci], high=[b for _, b in ci])

    return counts.mapInPandas(run, _with(counts, "low", "high"))


def stratified_interval(right: list[int], n: list[int], key: object, draws: int = DRAWS) -> tuple[float, float]:
    """Interval of balanced accuracy: each class is resampled on its own."""
    if not n:
        return 0.0, 0.0
    r = _rng("strata", key)
    x = np.mean([r.binomial(m, k / m, draws) / m for k, m in zip(right, n, strict=True)], axis=0) * 100
    return float(np.percentile(x, 2.5)), float(np.percentile(x, 97.5))


def permutation_p(won: list[int], lost: list[int], n: list[int], key: object, draws: int = DRAWS) -> float:
    """Two-sided p of a difference in balanced accuracy when each item's pair of outcomes may be swapped."""
    n_, won_, lost_ = (np.array(x, dtype=np.int64) for x in (n, won, lost))
    ok = n_ > 0
    if not ok.any():
        return 1.0
    n_, won_, lost_ = n_[ok], won_[ok], lost_[ok]
    seen = abs(((won_ - lost_) / n_).mean())
    r = _rng("swap", key)
    moved = (won_ - 2 * r.binomial(won_, 0.5, (draws, len(n_)))) - (lost_ - 2 * r.binomial(lost_, 0.5, (draws, len(n_))))
    return float((np.sum(np.abs((moved / n_).mean(axis=1)) >= seen - 1e-12) + 1) / (draws + 1))


def paired_permutation(paired: DataFrame, by: list[str], label: str = "category", after: str = "correct", before: str = "base") -> DataFrame:
    """Balanced accuracy of both sides over shared items and the swap test's p, per group; from counts per class."""
    a, b = F.col(after), F.col(before)
    cells = paired.filter(a.isNotNull() & b.isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a & ~b).alias("won"), F.count_if(~a & b).alias("lost"))
    cells = cells.groupBy(*by).agg((F.avg(F.col("a") / F.col("n")) * 100).alias("ba"), (F.avg(F.col("b") / F.col("n")) * 100).alias("base_ba"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(label, "n", "won", "lost"))).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = [permutation_p([c["won"] for c in cs], [c["lost"] for c in cs], [c["n"] for c in cs], tuple(k)) for k, cs in zip(pdf[by].itertuples(index=False), pdf["cells"], strict=True)]
            yield pdf.drop(columns="cells").assign(p=p)

    return cells.mapInPandas(run, _with(cells.drop("cells"), "p"))


def stratified_bootstrap(rows: DataFrame, by: list[str], label: str = "category") -> DataFrame:
    """Balanced accuracy with its 95 % interval per group."""
    cells = rows.groupBy(*by, label).agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    cells = cells.groupBy(*by).agg((F.avg(F.col("right") / F.col("n")) * 100).alias("ba"), F.array_sort(F.collect_list(F.struct(label, "n", "right"))).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ci = [stratified_interval([c["right"] for c in cs], [c["n"] for c in cs], tuple(k)) for k, cs in zip(pdf[by].itertuples(index=False), pdf["cells"], strict=True)]
            yield pdf.drop(columns="cells").assign(low=[a for a, _ in ci], high=[b for _, b in ci])

    return cells.mapInPandas(run, _with(cells.drop("cells"), "low", "high"))


def with_intervals(arms: DataFrame, by: list[str]) -> DataFrame:
    """Adds intervals and the swap test's p to rows of counts: ``low, high, ba_low, ba_high, p_ba``.

    ``arms``: n, right; cells (category, n, right) for balanced accuracy; paired (shared, won, lost of each category).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = list(map(tuple, pdf[by].itertuples(index=False)))
            own = [bootstrap_interval(r, n, k) for k, r, n in zip(keys, pdf["right"], pdf["n"], strict=True)]
            strata = [stratified_interval([c["right"] for c in cs], [c["n"] for c in cs], k) if len(cs) else (None, None) for k, cs in zip(keys, pdf["cells"], strict=True)]
            p = [permutation_p([c["won"] for c in cs], [c["lost"] for c in cs], [c["shared"] for c in cs], k) if len(cs) else None for k, cs in zip(keys, pdf["paired"], strict=True)]
            yield pdf.drop(columns=["cells", "paired"]).assign(low=[a for a, _ in own], high=[b for _, b in own], ba_low=[a for a, _ in strata], ba_high=[b for _, b in strata], p_ba=p)

    kept = arms.drop("cells", "paired")
    return arms.select(*kept.columns, "cells", "paired").mapInPandas(run, _with(kept, "low", "high", "ba_low", "ba_high", "p_ba"))


def label_shuffle(rows: DataFrame, by: list[str], truth: str, predicted: str, stratum: str | None = None) -> DataFrame:
    """p of balanced accuracy against shuffled labels (inside each stratum, if given), from confusion counts."""
    s = F.col(stratum) if stratum else F.lit("")
    cells = rows.groupBy(*by, s.cast("string").alias("s"), F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    cells = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("s", "t", "p", "n"))).alias("cells"))

    def one(cs: list, key: object) -> tuple[float, float]:
        truths = sorted({c["t"] for c in cs})
        total = {t: sum(c["n"] for c in cs if c["t"] == t) for t in truths}
        seen = np.mean([sum(c["n"] for c in cs if c["t"] == c["p"] == t) / total[t] for t in truths])
        hits = np.zeros((DRAWS, len(truths)))
        r = _rng("shuffle", key)
        for name in sorted({c["s"] for c in cs}):
            own = [c for c in cs if c["s"] == name]
            left = np.tile(np.array([sum(c["n"] for c in own if c["t"] == t) for t in truths]), (DRAWS, 1))
            for p in sorted({c["p"] for c in own}):
                n = sum(c["n"] for c in own if c["p"] == p)
                got, draw, rest = np.zeros_like(left), np.full(DRAWS, n), left.sum(axis=1)
                for t in range(len(truths)):  # one label after the other, all draws at once
                    rest = rest - left[:, t]
                    some = draw > 0
                    got[some, t] = r.hypergeometric(left[some, t], rest[some], draw[some])
                    draw = draw - got[:, t]
                if p in truths:
                    hits[:, truths.index(p)] += got[:, truths.index(p)]
                left = left - got
        ba = (hits / np.array([total[t] for t in truths])).mean(axis=1)
        return float(seen * 100), float((np.sum(ba >= seen - 1e-12) + 1) / (DRAWS + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(list(cs), tuple(k)) for k, cs in zip(pdf[by].itertuples(index=False), pdf["cells"], strict=True)]
            yield pdf.drop(columns="cells").assign(ba=[a for a, _ in got], p=[b for _, b in got])

    return cells.mapInPandas(run, _with(cells.drop("cells"), "ba", "p"))


def above_chance(rows: DataFrame, by: list[str], options: Column) -> DataFrame:
    """Exact one-sided p of the number right against a uniform guesser, from counts per number of options."""
    cells = rows.groupBy(*by, options.cast("long").alias("_k")).agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    cells = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.array_sort(F.collect_list(F.struct("_k", "n"))).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="cells").assign(p=[chance_p([(c["_k"], c["n"]) for c in cs], int(r)) for cs, r in zip(pdf["cells"], pdf["right"], strict=True)])

    return cells.mapInPandas(run, _with(cells.drop("cells"), "p"))
