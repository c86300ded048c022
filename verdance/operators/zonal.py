"""Zonal aggregation: pixels to zones.

Everything is grouped aggregation with map-side combining. Exact percentiles keep
one counted map a zone; where zones hold too many different values for that,
``percentiles(approx=...)`` uses a mergeable sketch. Second passes (deviations
from a zone's median) join the small zone table back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.operators.ordering import quantiles

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def zonal(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Count, and sum and mean of each value."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(f(v).alias(f"{name}_{v}") for v in values for name, f in (("sum", F.sum), ("mean", F.avg))))


def moments(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Population moments: deviation, variance, skewness, excess kurtosis and coefficient of variation."""
    return df.groupBy(*by).agg(
        F.stddev_pop(v).alias("sd"), F.var_pop(v).alias("var"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"), F.try_divide(F.stddev_pop(v), F.avg(v)).alias("cv")
    )


def percentiles(df: DataFrame, by: list[str], v: str, at: tuple[float, ...] = QUANTILES, approx: int | None = None) -> DataFrame:
    """p10..p90 and the interquartile range; exact with linear interpolation, or by a sketch of accuracy ``approx``."""
    probs = F.array(*(F.lit(float(q)) for q in at))
    q = F.percentile(v, probs) if approx is None else F.percentile_approx(v, probs, approx)
    out = df.groupBy(*by).agg(q.alias("_q"))
    named = {round(p * 100): F.get("_q", F.lit(i)).cast("double") for i, p in enumerate(at)}
    out = out.select(*by, *(c.alias(f"p{p}") for p, c in named.items()))
    return out.withColumn("iqr", F.col("p75") - F.col("p25")) if {25, 75} <= set(named) else out


def fractions(df: DataFrame, by: list[str], v: str, above: tuple[float, ...], area: Column | None = None) -> DataFrame:
    """Share of values over each threshold, and their number a unit of ``area``."""
    area = F.count(v) if area is None else area
    return df.groupBy(*by).agg(*(c for i, t in enumerate(above) for c in (F.avg((F.col(v) > t).cast("double")).alias(f"frac_{i}"), F.try_divide(F.count_if(F.col(v) > t).cast("double"), area).alias(f"dens_{i}"))))


def robust_mean(df: DataFrame, by: list[str], channels: list[str], values: list[str], limit: float = 3.5, least: int = 5) -> DataFrame:
    """Means of rows whose modified z-score is at most ``limit`` on every channel; of all rows, if fewer than ``least`` are left.

    Also pct_out, the share left out in percent.
    """
    mid = df.groupBy(*by).agg(*(F.median(c).alias(f"_m_{c}") for c in channels))
    near = df.join(mid, by)
    mad = near.groupBy(*by).agg(*(F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in channels))
    near = near.join(mad, by)
    keep = F.lit(True)
    for c in channels:
        z = F.when(F.col(f"_d_{c}") < 1e-9, 0.0).otherwise(0.6745 * (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}"))
        keep = keep & (F.abs(z) <= limit)
    kept = F.count_if(keep)
    return near.groupBy(*by).agg(*(F.when(kept >= least, F.avg(F.when(keep, F.col(v)))).otherwise(F.avg(v)).alias(f"{v}_robust") for v in values), (100.0 * (F.count(F.lit(1)) - kept) / F.count(F.lit(1))).alias("pct_out"))


def trimmed_mean(df: DataFrame, by: list[str], light: Column, values: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Means of rows whose brightness lies between two percentiles of their zone."""
    own = df.withColumn("_light", light)
    cut = own.groupBy(*by).agg(F.percentile("_light", low).alias("_lo"), F.percentile("_light", high).alias("_hi"))
    inside = own.join(cut, by).filter(F.col("_light").between(F.col("_lo"), F.col("_hi")))
    return inside.groupBy(*by).agg(*(F.avg(v).alias(f"{v}_trim") for v in values))


def otsu(df: DataFrame, by: list[str], v: str, bins: int = 256) -> DataFrame:
    """(by, threshold): centre of the first of ``bins`` equal bins that maximises the variance between classes.

    The histogram has at most ``bins`` rows a group; windows run over those.
    """
    ends = df.filter(F.col(v).isNotNull()).groupBy(*by).agg(F.min(v).alias("_a"), F.max(v).alias("_z"))
    width = (F.col("_z") - F.col("_a")) / bins
    bin_ = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col("_a")) / width)))
    hist = df.filter(F.col(v).isNotNull()).join(ends, by).groupBy(*by, "_a", "_z", bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    hist = hist.withColumn("mid", F.col("_a") + (F.col("bin") + 0.5) * width)
    run = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    w0, s0 = F.sum("c").over(run), F.sum(F.col("c") * F.col("mid")).over(run)
    n, s = F.sum("c").over(all_), F.sum(F.col("c") * F.col("mid")).over(all_)
    between = F.when((w0 > 0) & (n - w0 > 0), w0 * (n - w0) * F.pow(s0 / w0 - (s - s0) / (n - w0), 2)).otherwise(0.0)
    scored = hist.select(*by, "bin", "mid", F.round(between / F.greatest(n * n, F.lit(1.0)), 6).alias("score"))
    return scored.groupBy(*by).agg(F.min_by("mid", F.struct((-F.col("score")).alias("s"), "bin")).alias("threshold"))


def pivot_years(df: DataFrame, key: str, year: str, v: str, years: list[int], prefix: str = "y") -> DataFrame:
    """One row a key, one column a year; missing counts as 0."""
    wide = df.groupBy(key).pivot(year, years).agg(F.sum(v))
    return wide.select(key, *(F.coalesce(F.col(str(y)), F.lit(0)).alias(f"{prefix}{y}") for y in years))


def scene_stats(df: DataFrame, masks: dict[str, Column], channels: list[str], by: list[str]) -> DataFrame:
    """Mean, population deviation and count of channels under each mask; one scan for all masks."""
    labels = F.array(*(F.when(m, F.lit(name)) for name, m in masks.items()))
    own = df.withColumn("scope", F.explode(F.array_compact(labels)))
    return own.groupBy("scope", *by).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}_{c}") for c in channels for name, f in (("mean", F.avg), ("sd", F.stddev_pop))))


def radiometric_match(df: DataFrame, channels: list[str], year: str, reference: int, by_mask: Column | None = None) -> DataFrame:
    """Channels moved and scaled to the reference season: one scale a year for all channels, results at least 0.

    Year statistics are one row a year, joined back; they are taken over ``by_mask``.
    """
    base = df if by_mask is None else df.filter(by_mask)
    stats = base.groupBy(year).agg(*(F.avg(c).alias(f"_mu_{c}") for c in channels), *(F.stddev_pop(c).alias(f"_sd_{c}") for c in channels))
    mean_sd = lambda p: sum((F.col(f"{p}sd_{c}") for c in channels[1:]), F.col(f"{p}sd_{channels[0]}")) / len(channels)
    ref = stats.filter(F.col(year) == reference).select(*(F.col(f"_mu_{c}").alias(f"_ref_mu_{c}") for c in channels), mean_sd("_").alias("_ref_sd"))
    scale = stats.crossJoin(F.broadcast(ref.limit(1))).withColumn("_s", F.col("_ref_sd") / F.greatest(mean_sd("_"), F.lit(1e-6)))
    out = df.join(F.broadcast(scale), year)  # one row a year
    return out.select(*df.columns, *(F.greatest(F.lit(0.0), (F.col(c) - F.col(f"_mu_{c}")) * F.col("_s") + F.col(f"_ref_mu_{c}")).alias(f"{c}_matched") for c in channels))


def winsorised(df: DataFrame, v: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``df`` with v clipped to two of its percentiles, as {v}_w."""
    a, b = (F.lit(q).cast("double") for q in quantiles(df, v, (low, high)))
    return df.withColumn(f"{v}_w", F.greatest(a, F.least(b, F.col(v))))
