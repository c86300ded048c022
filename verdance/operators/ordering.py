"""Order statistics and row numbers without a task that holds the whole table."""

from __future__ import annotations

import math
import sys
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.session import checkpointed

#: Values that are fetched at most to read an order statistic off, and the rank error that is allowed for.
FETCHED, SLACK = 50_000, 3e-4


def numbered(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """``df`` with its row number from 1 in the order of ``order`` (unique) as ``name``, and ``_part``, its range.

    Rows are dealt into ranges and numbered there; ranges start after the counts
    of those in front, of which there is one row a partition.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + here).cast("long")).drop("_start")


def beside(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``_p`` and ``_n``: the last ``value`` in front of a row and the first behind it, in its group, nulls left out.

    Rows are dealt into ranges of group and order, so a group of any size spreads over many tasks; what its other ranges
    hold comes as one more row at either end of a range. Rows that tie in ``order`` stand in no set order, so their
    values should be the same. Groups of null keys are groups; a group without values gives nulls.
    """
    ranged = checkpointed(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = ranged.groupBy("_part", *by).agg(F.max_by(value, place).alias("_l"), F.min_by(value, place).alias("_f"))
    # At most one row a range and group.
    up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_part"), F.col("_part").desc()))
    ends = ends.select("_part", *by, F.last("_l", True).over(up).alias("_before"), F.last("_f", True).over(down).alias("_after"))
    edge = lambda c, rank: ends.filter(F.col(c).isNotNull()).select("_part", *by, F.col(c).alias(value), F.lit(rank).alias("_rank"))
    rows = ranged.withColumn("_rank", F.lit(1)).unionByName(edge("_before", 0).unionByName(edge("_after", 2)), allowMissingColumns=True)
    here = Window.partitionBy("_part", *by)
    front = here.orderBy("_rank", *order).rowsBetween(Window.unboundedPreceding, -1)
    back = here.orderBy(F.col("_rank").desc(), *(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_p": F.last(value, True).over(front), "_n": F.last(value, True).over(back)})
    return rows.filter("_rank = 1").drop("_rank", "_part")


def middle(df: DataFrame, value: Column, bins: int = 4096) -> float | None:
    """The exact median of ``value`` over a table that is cheap to read again, without writing the values out; None where there are none.

    A pass counts the values by equal bins between the ends, and the bins that hold the middle are counted anew until few enough
    values to fetch are in them; a bin that holds one value, however often, is done.
    """
    most = F.lit(sys.float_info.max)  # stands for what is beyond it, and for NaN
    v = F.least(F.greatest(value.cast("double"), -most), most)
    own = df.filter(value.isNotNull()).select(v.alias("v"))
    first = own.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    n, below, low, high, held = first["n"], 0, first["low"], first["high"], first["n"]
    if not n:
        return None
    a, b = (n - 1) // 2, n // 2
    while True:
        inside = own.filter(F.col("v").between(low, high))
        if low == high:
            return low
        if held <= FETCHED:
            values = sorted(r["v"] for r in inside.collect())
            return (values[a - below] + values[b - below]) / 2
        by = 1.0 if math.isfinite(high - low) else 2.0  # the range may be more than a double holds
        at = F.floor((F.col("v") / by - low / by) / (high / by - low / by) * bins).cast("int")
        counts = inside.groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        ends, found = below, []
        for r in sorted(counts, key=lambda r: r["bin"]):
            ends += r["n"]
            if ends > a and not found or ends > b and found and found[-1][1] <= b:
                found.append((ends - r["n"], ends, r["low"], r["high"]))
            if ends > b:
                break
        if len(found) == 2:
            # The two values in the middle are the last of a bin and the first of the next that has any.
            return (found[0][3] + found[1][2]) / 2
        (below, upto, low, high) = found[0]
        held = upto - below


def quantiles(df: DataFrame, v: str | Column, at: tuple[float, ...]) -> list[float | None]:
    """Exact percentiles with linear interpolation; None where there are no values.

    Each is an order statistic or lies between two. The values are written once. One mergeable summary brackets all order
    statistics, one pass counts below and inside of all brackets, and one fetches what lies in them; brackets
    that hold too many values shrink by another summary first (a value that repeats closes its bracket).
    """
    own = checkpointed(df.select((F.col(v) if isinstance(v, str) else v).cast("double").alias("v")).filter("v is not null"))
    shares = sorted({min(1.0, max(0.0, p + d)) for p in at for d in (-SLACK, SLACK)})
    first = own.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", F.array(*map(F.lit, shares)), 10_000).alias("q")).first()
    n = first["n"]
    if not n:
        return [None for _ in at]
    found: dict[int, float] = {}
    bracket: dict[int, tuple[float, float]] = {}
    for p in at:
        low, high = (first["q"][shares.index(min(1.0, max(0.0, p + d)))] for d in (-SLACK, SLACK))
        for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
            # Ranks of two percentiles may be the same; either bracket serves.
            bracket[rank] = (first["low"] if p <= SLACK else low, first["high"] if p >= 1 - SLACK else high) if n > FETCHED else (first["low"], first["high"])
    while bracket:
        inside = lambda ends: F.col("v").between(*ends)
        counts = own.agg(*(F.count_if(c) for low, high in bracket.values() for c in (F.col("v") < low, inside((low, high))))).first()
        ready, wide = {}, {}
        for i, (rank, (low, high)) in enumerate(bracket.items()):
            below, held = counts[2 * i], counts[2 * i + 1]
            if not below <= rank < below + held:  # the summary was off by more than it states
                wide[rank] = (-math.inf, low, 0.0) if rank < below else (high, math.inf, 0.0)
            elif low == high:
                found[rank] = low
            elif held <= FETCHED:
                ready[rank] = (low, high, below)
            else:
                wide[rank] = (low, high, (rank - below) / held)
        if ready:
            any_of = F.lit(False)
            for low, high, _ in ready.values():
                any_of = any_of | inside((low, high))
            values = sorted(r["v"] for r in own.filter(any_of).collect())
            found |= {rank: values[bisect_left(values, low) + rank - below] for rank, (low, _, below) in ready.items()}
        bracket = {}
        if wide:
            part = lambda low, high, s: F.percentile_approx(F.when(inside((low, high)), F.col("v")), F.array(F.lit(max(0.0, s - SLACK)), F.lit(min(1.0, s + SLACK))), 10_000)
            ends = own.agg(*(x for low, high, s in wide.values() for x in (part(low, high, s), F.min(F.when(inside((low, high)), F.col("v"))), F.max(F.when(inside((low, high)), F.col("v")))))).first()
            for i, (rank, (_, _, s)) in enumerate(wide.items()):
                q, least, most = ends[3 * i : 3 * i + 3]
                off = wide[rank][0] == -math.inf or wide[rank][1] == math.inf
                bracket[rank] = (least, most) if off else (least if s <= SLACK else q[0], most if s >= 1 - SLACK else q[1])
    out: list[float | None] = []
    for p in at:
        k = p * (n - 1)
        a, b = found[math.floor(k)], found[math.ceil(k)]
        out.append(a + (k - math.floor(k)) * (b - a))
    return out
