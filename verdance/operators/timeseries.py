"""Ordered series: resampling, station features, chill models, runs and crossings."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constants of the dynamic chill model.
E0, E1, A0, A1, SLOPE, MELT = 4153.5, 12888.8, 139_500.0, 2.567e18, 1.6, 277.0


def hourly(df: DataFrame, by: list[str], ts: str, rules: dict[str, tuple[str, str]], need: str | None = None) -> DataFrame:
    """Hourly rows; ``rules`` maps a result to (column, avg | sum | max | min). Hours without ``need`` are dropped.

    Sums of no values are 0, other aggregates null.
    """
    made = {"avg": F.avg, "max": F.max, "min": F.min, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}
    out = df.groupBy(*by, F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("hour")).agg(*(made[f](c).alias(n) for n, (c, f) in rules.items()))
    return out.filter(F.col(need).isNotNull()) if need else out


def _folded(df: DataFrame, by: list[str], order: str, v: str, start: Column, step, finish) -> DataFrame:
    """An ordered fold a group; what meets in one row is one group's series (a station and season)."""
    series = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, v))), lambda s: s[v]).alias("_s"))
    return series.select(*by, F.aggregate("_s", start, step, finish).alias("portions"))


def _state(x: Column, p: Column) -> Column:
    return F.struct(x.alias("x"), p.alias("p"))


def chill_portions(df: DataFrame, by: list[str], order: str, t: str) -> DataFrame:
    """Dynamic model, whole portions: when the intermediate product reaches 1, one portion is added and 1 taken off."""

    def step(s: Column, c: Column) -> Column:
        k = c + 273.15
        k0, k1 = A0 * F.exp(-E0 / k), A1 * F.exp(-E1 / k)
        x = F.when(k1 != 0, s["x"] * F.exp(-k1) + k0 / k1 * (1 - F.exp(-k1))).otherwise(s["x"] + k0)
        return F.when(x >= 1, _state(x - 1, s["p"] + 1)).otherwise(_state(x, s["p"]))

    return _folded(df, by, order, t, _state(F.lit(0.0), F.lit(0.0)), step, lambda s: s["p"])


def chill_portions_partial(df: DataFrame, by: list[str], order: str, t: str) -> DataFrame:
    """Dynamic model with partial conversion: the share xi of the product becomes portions, the rest stays."""

    def step(s: Column, c: Column) -> Column:
        k = c + 273.0
        sr = F.exp(SLOPE * MELT * (k - MELT) / k)
        xi, xs, ak = sr / (1 + sr), A0 / A1 * F.exp((E1 - E0) / k), A1 * F.exp(-E1 / k)
        x = xs - (xs - s["x"]) * F.exp(-ak)
        return F.when(x >= 1, _state(x - x * xi, s["p"] + x * xi)).otherwise(_state(x, s["p"]))

    return _folded(df, by, order, t, _state(F.lit(0.0), F.lit(0.0)), step, lambda s: s["p"])


def utah(t: Column) -> Column:
    """Chill units of one hour, by seven bands."""
    return F.when(t <= 1.4, 0.0).when(t <= 2.4, 0.5).when(t <= 9.1, 1.0).when(t <= 12.4, 0.5).when(t <= 15.9, 0.0).when(t <= 18.0, -0.5).otherwise(-1.0)


def daily(df: DataFrame, by: list[str], hour: str, high: str, low: str) -> DataFrame:
    """(day, high, low, gdd, dtr): degree days over 4.5 and the day's range."""
    out = df.groupBy(*by, F.to_date(hour).alias("day")).agg(F.max(high).alias("high"), F.min(low).alias("low"))
    return out.withColumns({"gdd": F.greatest((F.col("high") + F.col("low")) / 2 - 4.5, F.lit(0.0)), "dtr": F.col("high") - F.col("low")})


def longest_run(df: DataFrame, by: list[str], order: str, holds: Column) -> DataFrame:
    """Longest run of rows for which ``holds`` is true; null breaks a run; 0 where there is none."""
    ok = F.coalesce(holds, F.lit(False))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.select(*by, order, ok.alias("_ok")).withColumn("_g", F.sum((~F.col("_ok")).cast("int")).over(w))
    return own.groupBy(*by, "_g").agg(F.count_if(F.col("_ok")).alias("n")).groupBy(*by).agg(F.max("n").alias("longest"))


def crossing(df: DataFrame, by: list[str], x: str, y: str, level: float) -> DataFrame:
    """First x at which y reaches ``level``, linearly interpolated; the first x if y starts there; null if it never does."""
    w = Window.partitionBy(*by).orderBy(x)
    own = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).alias("_y"), F.lag(x).over(w).cast("double").alias("_px"), F.lag(y).over(w).alias("_py"))
    at = F.when(F.col("_px").isNull() & (F.col("_y") >= level), F.col("_x")).when((F.col("_py") < level) & (F.col("_y") >= level), F.col("_px") + (level - F.col("_py")) / (F.col("_y") - F.col("_py")) * (F.col("_x") - F.col("_px")))
    return own.groupBy(*by).agg(F.min(at).alias("at"))


def interpolate_at(df: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """y at x = ``at``, linear between neighbours, clamped at the ends."""
    low = F.max(F.when(F.col(x) <= at, F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y"))))
    high = F.min(F.when(F.col(x) >= at, F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y"))))
    out = df.groupBy(*by).agg(low.alias("_l"), high.alias("_h"))
    between = F.col("_l.y") + (at - F.col("_l.x")) / (F.col("_h.x") - F.col("_l.x")) * (F.col("_h.y") - F.col("_l.y"))
    return out.select(*by, F.when(F.col("_l").isNull(), F.col("_h.y")).when(F.col("_h").isNull() | (F.col("_l.x") == F.col("_h.x")), F.col("_l.y")).otherwise(between).alias("y"))


def gaps(df: DataFrame, by: list[str], ts: str, seconds: float) -> DataFrame:
    """Gaps of more than ``seconds`` between successive rows: start, end, length."""
    w = Window.partitionBy(*by).orderBy(ts)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    own = df.select(*by, F.lag(ts).over(w).alias("start"), F.col(ts).alias("end"))
    return own.withColumn("seconds", (micros(F.col("end")) - micros(F.col("start"))) / 1e6).filter(F.col("seconds") > seconds)


def gaussian_kernel(sigma: float, half: int) -> list[float]:
    w = [exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    return [v / sum(w) for v in w]


def smoothed(df: DataFrame, by: list[str], order: str, v: str, sigma: float = 1.0, half: int = 2) -> DataFrame:
    """Gaussian smoothing over neighbouring rows; missing neighbours at the ends count as 0."""
    w = Window.partitionBy(*by).orderBy(order)
    total = F.lit(0.0)
    for i, k in zip(range(-half, half + 1), gaussian_kernel(sigma, half), strict=True):
        total = total + F.coalesce(F.lag(v, -i).over(w), F.lit(0.0)) * k
    return df.withColumn("smooth", total)


def local_maxima(df: DataFrame, by: list[str], order: str, v: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({"_a": F.lag(v).over(w), "_b": F.lead(v).over(w)}).filter((F.col(v) > F.col("_a")) & (F.col(v) >= F.col("_b"))).drop("_a", "_b")
