"""Scalar rules: scaling, flags, text and dates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, so that aggregates skip it."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*(F.when(~F.isnan(n), F.col(n)).alias(n) if n in floats else F.col(n) for n in df.columns))


def clip(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def zscore(v: str, *by: str) -> Column:
    """(v - mean) / population deviation within ``by``; a deviation of 0 counts as 1."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(v).over(w)
    return (F.col(v) - F.avg(v).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)


def demeaned(v: str, *by: str) -> Column:
    return F.col(v) - F.avg(v).over(Window.partitionBy(*by))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def piecewise(x: Column, anchors: list[tuple[float, float]]) -> Column:
    """Linear between sorted anchors, constant beyond them."""
    out = F.when(x <= anchors[0][0], F.lit(anchors[0][1]))
    for (x1, y1), (x2, y2) in zip(anchors, anchors[1:], strict=False):
        out = out.when(x <= x2, y1 + (x - x1) * ((y2 - y1) / (x2 - x1)))
    return out.otherwise(F.lit(anchors[-1][1]))


#: Flower coverage in percent at stages 0..10.
COVERAGE = [(0.0, 0.0), (1.0, 2.0), (2.0, 5.0), (3.0, 10.0), (4.0, 20.0), (5.0, 35.0), (6.0, 50.0), (7.0, 65.0), (8.0, 80.0), (9.0, 60.0), (10.0, 30.0)]


def peak_factor(coverage: Column, peak: float = 80.0, least: float = 30.0) -> tuple[Column, Column]:
    """(correction to peak bloom, whether it is reliable)."""
    return F.try_divide(F.lit(peak), coverage), coverage >= least


def tree_id(n: Column) -> Column:
    return F.format_string("Tree_%04d", n.cast("long"))


def cultivar(name: Column) -> Column:
    low = F.upper(name)
    return F.when(low.contains("UEF"), "UEF").when(low.contains("53"), "53").when(low.contains("54"), "54")


def day_of_year(text: Column) -> Column:
    return F.dayofyear(F.to_date(text, "dd/MM/yyyy"))


def products(names: list[str], prefix: str = "") -> dict[str, Column]:
    """All pairwise interaction terms."""
    return {f"{prefix}{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(names, 2)}


def powers(name: str, most: int) -> dict[str, Column]:
    return {f"{name}_{k}": F.pow(F.col(name), k) for k in range(2, most + 1)}


def imputed(v: str, *by: str) -> Column:
    return F.coalesce(F.col(v), F.avg(v).over(Window.partitionBy(*by)))
