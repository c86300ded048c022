"""Colour indices of red, green and blue values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 256.0


def ratio0(num: Column, den: Column) -> Column:
    """num / den, and 0 where den is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def bloom(r: Column, g: Column, b: Column, eps: float = EPS) -> Column:
    """Enhanced bloom index; 0 where its denominator is."""
    return ratio0(r + g + b, g / (b + F.lit(eps)) * (r - b + F.lit(eps)))


def bloom_of_means(r: Column, g: Column, b: Column, eps: float = EPS) -> Column:
    """The bloom index of means: null where its denominator is 0."""
    return F.try_divide(r + g + b, g / (b + F.lit(eps)) * (r - b + F.lit(eps)))


def greenness(r: Column, g: Column) -> Column:
    """Normalised green-red difference; 0 where both are 0."""
    return ratio0(g - r, g + r)


def greenness_of_means(r: Column, g: Column, eps: float = EPS) -> Column:
    return (g - r) / (g + r + F.lit(eps))


def blueness(r: Column, g: Column, b: Column) -> Column:
    """2B - (R + G), as a short integer."""
    return (2 * b - (r + g)).cast("smallint")


def saturation(r: Column, g: Column, b: Column, eps: float = 1e-6) -> Column:
    top = F.greatest(r, g, b)
    return (top - F.least(r, g, b)) / (top + F.lit(eps))


def brightness(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0)


def whiteness(r: Column, g: Column, b: Column) -> Column:
    return brightness(r, g, b) * (1 - saturation(r, g, b))


def indices(r: Column, g: Column, b: Column, eps: float = 1e-6) -> dict[str, Column]:
    """Eight indices by name."""
    total = r + g + b + F.lit(eps)
    rn, gn, bn = r / total, g / total, b / total
    exg = 2 * gn - rn - bn
    return {
        "exg": exg,
        "exgr": exg - (1.4 * rn - gn),
        "vari": (g - r) / (g + r - b + F.lit(eps)),
        "gli": (2 * g - r - b) / (2 * g + r + b + F.lit(eps)),
        "cive": 0.441 * r - 0.811 * g + 0.385 * b + 18.78745,
        "rgbvi": (g * g - r * b) / (g * g + r * b + F.lit(eps)),
        "unsat": 1 - saturation(r, g, b),
        "white": whiteness(r, g, b),
    }


def stretch(v: Column, low: Column, high: Column) -> Column:
    """To 0..255 between two bounds."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), ratio0(v - low, high - low) * 255.0))).cast("int")
