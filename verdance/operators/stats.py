"""Statistical aggregates and tests.

Sums are distributed aggregates; what is left for tail probabilities are result
rows. Tests return one row (or one a group) with their statistic, degrees of
freedom and p.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.functions.special import f_pvalue, r_pvalue, t_pvalue
from verdance.operators.deals import MODULUS, mixed, places, poisson
from verdance.operators.match import circle, vectors
from verdance.operators.ordering import numbered
from verdance.session import checkpointed

C = F.col
#: Rows of groups that are ranked in a task, on average.
RANKED = 250_000


def dbl(c: str | Column) -> Column:
    return (C(c) if isinstance(c, str) else c).cast("double")


def pearson(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """n, r, p over rows with both values; r is null under ``least`` rows or without spread."""
    both = C(x).isNotNull() & C(y).isNotNull()
    n, a, b = F.count_if(both), F.when(both, C(x)), F.when(both, C(y))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    out = df.groupBy(*by).agg(n.alias("n"), F.when((n >= least) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    return out.withColumn("p", r_pvalue(C("r"), dbl("n")))


def ranked(df: DataFrame, v: str, by: tuple[str, ...] = (), ties: str = "average", order: str | None = None) -> Column:
    w = Window.partitionBy(*by).orderBy(v)
    if ties == "average":
        return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, v)) - 1) / 2
    return F.row_number().over(Window.partitionBy(*by).orderBy(v, order)).cast("double")


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), ties: str = "average", order: str | None = None) -> DataFrame:
    """Rank correlation with average or ordinal ties. Ranks need a group's rows in order, so ``by`` is what spreads the work.

    Groups are dealt over as many tasks as keep a task's rows at about ``RANKED``, however many there are.
    """
    both = df.filter(C(x).isNotNull() & C(y).isNotNull()).select(*dict.fromkeys([*by, x, y, *([order] if order else [])]))
    parts = -(-both.count() // RANKED) if by else 1
    if parts > 1:
        both = both.repartition(parts, *by)
    own = both.select(*by, ranked(both, x, by, ties, order).alias("_x"), ranked(both, y, by, ties, order).alias("_y"))
    return pearson(own, "_x", "_y", by).withColumnRenamed("r", "rho")


def inversions(a: np.ndarray) -> tuple[np.ndarray, int]:
    """``a`` in order, and how many pairs were out of it; by halves that are merged."""
    if len(a) <= 64:
        return np.sort(a), int(np.triu(a[:, None] > a[None, :], 1).sum())
    (low, i), (high, j) = inversions(a[: len(a) // 2]), inversions(a[len(a) // 2 :])
    return np.sort(np.concatenate([low, high]), kind="stable"), i + j + int((len(low) - np.searchsorted(low, high, side="right")).sum())


def sign_sum(x: np.ndarray, y: np.ndarray) -> int:
    """Sum over all pairs of sign(dx) * sign(dy), in n log n."""
    order = np.lexsort((y, x))
    tied = lambda *c: sum(k * (k - 1) // 2 for k in np.unique(np.stack(c), axis=1, return_counts=True)[1].tolist())
    m = len(x)
    return m * (m - 1) // 2 - tied(x) - tied(y) + tied(x, y) - 2 * inversions(y[order])[1]


def kendall(df: DataFrame, x: str, y: str, order: str, by: tuple[str, ...] = (), ranges: int = 64, least: int = 20_000) -> DataFrame:
    """(by, pairs, tau): concordant less discordant pairs over all pairs, for groups of any size; ties count as neither.

    A group of fewer than ``least`` rows is sorted and merged in a task. Of others x and y are cut into ranges, at values of a summary; such a value is a range of its own, so a value that
    many rows share is never sorted. Pairs that differ in both ranges are counted from the table of (x range, y
    range); those that share their x range, or their y range, are counted there by merging, less those that share both and so
    were counted twice. What a task holds is a range, or one group's table. Rows without either value are left out; ``order`` is not needed for that.
    """
    keys = list(by)
    own = df.select(*keys, dbl(x).alias("_x"), dbl(y).alias("_y")).filter("_x is not null and _y is not null")
    cuts = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    ends = own.groupBy(*keys).agg(*(F.sort_array(F.array_distinct(F.when(F.count(F.lit(1)) >= least, F.percentile_approx(c, cuts, 1000)).otherwise(F.array().cast("array<double>")))).alias(f"{c}_cuts") for c in ("_x", "_y")), F.count(F.lit(1)).alias("_n"))
    joined = own.join(ends, keys) if keys else own.crossJoin(F.broadcast(ends))  # one row
    # Twice the cuts below a value, and one more if it is a cut itself.
    at = lambda c: F.size(F.filter(f"{c}_cuts", lambda e: e < C(c))) * 2 + F.array_contains(f"{c}_cuts", C(c)).cast("int")
    placed = checkpointed(joined.select(*keys, "_x", "_y", at("_x").alias("_a"), at("_y").alias("_b"), (C("_n") >= least).alias("_big")))

    def inner(group: list[str]) -> DataFrame:
        open_range = F.lit(True) if group == ["_a"] else C("_big")
        for c in group:
            open_range = open_range & (C(c) % 2 == 0)
        count = lambda pdf: pd.DataFrame({"s": [sign_sum(pdf["_x"].to_numpy(), pdf["_y"].to_numpy())]} | {k: [pdf[k].iloc[0]] for k in keys})
        return placed.filter(open_range).groupBy(*keys, *group).applyInPandas(count, ", ".join(["s bigint", *(f"{k} {placed.schema[k].dataType.simpleString()}" for k in keys)])).select(*keys, "s")

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((pdf["_a"].max() + 1, pdf["_b"].max() + 1), dtype=object if pdf["n"].sum() > 2**31 else np.int64)
        grid[pdf["_a"], pdf["_b"]] = pdf["n"]
        before = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), dtype=grid.dtype)
        before[1:, 1:] = grid.cumsum(0).cumsum(1)
        # For each cell: those below it in both, less those below in x and above in y.
        less, above = before[:-1, :-1], before[:-1, -1:] - before[:-1, 1:]
        return pd.DataFrame({"s": [int((grid * (less - above)).sum())]} | {k: [pdf[k].iloc[0]] for k in keys})

    cells = placed.filter("_big").groupBy(*keys, "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    kinds = "".join(f", {k} {placed.schema[k].dataType.simpleString()}" for k in keys)
    far = cells.groupBy(*keys).applyInPandas(table, f"s bigint{kinds}").select(*keys, "s")
    parts = far.unionByName(inner(["_a"])).unionByName(inner(["_b"])).unionByName(inner(["_a", "_b"]).withColumn("s", -C("s")))
    n = F.count(F.lit(1))
    every = placed.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("s"), F.floor(n * (n - 1) / 2).alias("pairs"))
    both = parts.withColumn("pairs", F.lit(0).cast("bigint")).unionByName(every)
    return both.groupBy(*keys).agg(F.sum("pairs").alias("pairs"), F.sum("s").alias("s")).filter("pairs > 0").select(*keys, "pairs", (C("s") / C("pairs")).alias("tau"))


def paired_t(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    d = C(a) - C(b)
    out = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    out = out.withColumn("t", F.when(C("n") >= least, F.try_divide(C("mean"), C("sd") / F.sqrt(dbl("n")))))
    return out.withColumn("p", t_pvalue(C("t"), dbl("n") - 1))


def pooled_t(df: DataFrame, group: str, one: str, two: str, v: str) -> DataFrame:
    """Two samples with a common variance."""
    pick = lambda g: F.when(C(group) == g, C(v))
    out = df.agg(F.count(pick(one)).alias("n1"), F.count(pick(two)).alias("n2"), (F.avg(pick(one)) - F.avg(pick(two))).alias("diff"), F.var_samp(pick(one)).alias("v1"), F.var_samp(pick(two)).alias("v2"))
    sp = ((C("n1") - 1) * C("v1") + (C("n2") - 1) * C("v2")) / (C("n1") + C("n2") - 2)
    out = out.withColumn("t", F.try_divide(C("diff"), F.sqrt(sp * (1 / C("n1") + 1 / C("n2")))))
    return out.select("n1", "n2", "diff", "t", t_pvalue(C("t"), dbl(C("n1") + C("n2") - 2)).alias("p"))


def anova(df: DataFrame, group: str, v: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One-way: f, df1, df2, p, eta2."""
    g = df.filter(C(v).isNotNull()).groupBy(*by, group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    w = g.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(C("n") * C("s")).alias("within"), F.sum(C("n") * C("m")).alias("t"), F.sum(C("n") * C("m") * C("m")).alias("q"))
    between = C("q") - C("t") * C("t") / C("n")
    out = w.select(*by, (C("k") - 1).alias("df1"), (C("n") - C("k")).alias("df2"), between.alias("between"), "within")
    out = out.withColumn("f", F.try_divide(C("between") / C("df1"), C("within") / C("df2")))
    return out.select(*by, "f", "df1", "df2", f_pvalue(C("f"), dbl("df1"), dbl("df2")).alias("p"), F.try_divide(C("between"), C("between") + C("within")).alias("eta2"))


def levene(df: DataFrame, group: str, v: str) -> DataFrame:
    """Brown-Forsythe: one-way test of distances from the group medians."""
    med = df.groupBy(group).agg(F.median(v).alias("_m"))
    return anova(df.join(med, group).withColumn("_d", F.abs(C(v) - C("_m"))), group, "_d")


def split_plot(df: DataFrame, subject: str, between: str, within: str, v: str) -> DataFrame:
    """Between, within and interaction rows of a mixed design, with two error strata.

    Each subject counts with all levels of ``within`` (K) whether it has them or
    not, and the second error is what is left of the total, as the formula for balanced designs has it.
    """
    d = df.filter(C(v).isNotNull())
    gm = d.agg(F.avg(v).alias("gm"), F.var_pop(v).alias("vp"), F.count(v).alias("nn"), F.count_distinct(within).alias("kk"))
    subj = d.groupBy(subject).agg(F.avg(v).alias("m"), F.min(between).alias(between))
    nj = subj.groupBy(between).agg(F.count(F.lit(1)).alias("nj"))
    bm, tm = d.groupBy(between).agg(F.avg(v).alias("bm")), d.groupBy(within).agg(F.avg(v).alias("tm"))
    cells = d.groupBy(between, within).agg(F.avg(v).alias("cm")).join(bm, between).join(tm, within).join(nj, between).crossJoin(F.broadcast(gm))
    one = bm.join(nj, between).crossJoin(F.broadcast(gm)).agg(F.sum(C("kk") * C("nj") * F.pow(C("bm") - C("gm"), 2)).alias("ssb"), F.count(F.lit(1)).alias("b"), F.sum("nj").alias("n"), F.first("kk").alias("k"), F.first(C("vp") * C("nn")).alias("sst"))
    err = subj.join(bm, between).crossJoin(F.broadcast(gm)).agg(F.sum(C("kk") * F.pow(C("m") - C("bm"), 2)).alias("sse"))
    tim = tm.crossJoin(F.broadcast(gm)).agg(F.sum(F.pow(C("tm") - C("gm"), 2)).alias("sw1"))
    inter = cells.agg(F.sum(C("nj") * F.pow(C("cm") - C("bm") - C("tm") + C("gm"), 2)).alias("ssi"))
    a = one.crossJoin(err).crossJoin(tim).crossJoin(inter).withColumn("ssw", C("n") * C("sw1"))
    a = a.withColumn("ss2", C("sst") - C("ssb") - C("sse") - C("ssw") - C("ssi"))
    e1, e2 = C("n") - C("b"), (C("n") - C("b")) * (C("k") - 1)
    row = lambda name, ss, d1, es, d2: F.struct(F.lit(name).alias("effect"), F.try_divide(ss / d1, es / d2).alias("f"), d1.cast("bigint").alias("df1"), d2.cast("bigint").alias("df2"), (ss / C("sst")).alias("eta2"))
    rows = F.array(row("between", C("ssb"), C("b") - 1, C("sse"), e1), row("within", C("ssw"), C("k") - 1, C("ss2"), e2), row("interaction", C("ssi"), (C("b") - 1) * (C("k") - 1), C("ss2"), e2))
    out = a.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("p", f_pvalue(C("f"), dbl("df1"), dbl("df2")))


def repeated_measures(df: DataFrame, subject: str, within: str, v: str) -> DataFrame:
    """Effect of ``within`` with subjects as blocks."""
    d = df.filter(C(v).isNotNull())
    tot = d.agg((F.var_pop(v) * F.count(v)).alias("sst"), F.avg(v).alias("gm"))
    part = lambda c, name: d.groupBy(c).agg(F.count(v).alias("n"), F.avg(v).alias("m")).crossJoin(F.broadcast(tot)).agg(F.sum(C("n") * F.pow(C("m") - C("gm"), 2)).alias(f"ss_{name}"), F.count(F.lit(1)).alias(f"k_{name}"))
    a = tot.crossJoin(part(subject, "s")).crossJoin(part(within, "w"))
    df1, df2 = C("k_w") - 1, (C("k_w") - 1) * (C("k_s") - 1)
    f = F.try_divide(C("ss_w") / df1, (C("sst") - C("ss_s") - C("ss_w")) / df2)
    out = a.select(f.alias("f"), df1.alias("df1"), df2.alias("df2"))
    return out.withColumn("p", f_pvalue(C("f"), dbl("df1"), dbl("df2")))


def variance_shares(df: DataFrame, group: str, v: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Within and between variance, the between share in percent and the coefficient of variation; groups under two rows are left out."""
    g = df.groupBy(*by, group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s")).filter("n >= 2")
    a = g.groupBy(*by).agg(F.sum("n").alias("n"), F.sum((C("n") - 1) * C("s")).alias("w"), F.sum(C("n") * C("m")).alias("t"), F.sum(C("n") * C("m") * C("m")).alias("q"))
    within, between = C("w") / (C("n") - 1), (C("q") - C("t") * C("t") / C("n")) / (C("n") - 1)
    return a.select(*by, within.alias("within"), between.alias("between"), (100 * between / (within + between)).alias("share"), (100 * F.sqrt(within + between) / (C("t") / C("n"))).alias("cv"))


def moran(points: DataFrame, v: str, radius: float) -> DataFrame:
    """Moran's I with binary weights in a distance band, its expectation and n. Points are (id, x, y, v).

    Points at one place have the same neighbours, so their values are summed first; products are summed in tiles.
    """
    own = points.filter(C(v).isNotNull() & C("x").isNotNull() & C("y").isNotNull())
    mean = own.agg(F.avg(v).alias("_mu"), F.var_pop(v).alias("_vp"), F.count(v).alias("n"))
    spots = own.crossJoin(F.broadcast(mean)).groupBy(dbl("x").alias("x"), dbl("y").alias("y")).agg(F.array(dbl(F.count(F.lit(1))), F.sum(C(v) - C("_mu"))).alias("v"))
    spots = checkpointed(spots)
    s = circle(spots, spots, radius, 2, total=True, apart=True).select(C("v")[0].alias("s0"), C("v")[1].alias("num"))
    return s.crossJoin(mean).select(F.try_divide(C("n") * C("num"), C("s0") * C("_vp") * C("n")).alias("i"), F.try_divide(F.lit(-1.0), C("n") - 1).alias("expected"), "n")


#: Places that a task gathers the values of, and rows whose values are dealt at once.
BLOCK, DEALT = 4096, 16_384


def _batches(tables: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for t in tables:
        held.append(t)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def moran_permuted(points: DataFrame, v: str, radius: float, rounds: int = 199, seed: int = 42) -> DataFrame:
    """Moran's I with a one-sided permutation p.

    Points are numbered once. In round j number i sends its value to the place a keyed permutation has for it, so
    no round sorts. Values are sent packed, by block of places; a block makes one array a point, of its values in all rounds. Arrays of
    points at one position are summed, and the products of neighbours are matrix products in tiles.
    """
    own = points.filter(C(v).isNotNull() & C("x").isNotNull() & C("y").isNotNull())
    mean = own.agg(F.avg(v).alias("_mu"))
    z = numbered(own, ["id"]).crossJoin(F.broadcast(mean)).select((C("i") - 1).alias("i"), dbl("x").alias("x"), dbl("y").alias("y"), (C(v) - C("_mu")).alias("z"))
    z = checkpointed(z)
    n = z.count()
    if not n:
        return moran(points, v, radius).select("i", "expected", "n", F.lit(None).cast("double").alias("p"))
    keys, size = [j + seed * 100_003 for j in range(1, rounds + 1)], rounds + 2  # the last value counts

    def send(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(tables, DEALT):
            i, value = t.column("i").to_numpy(), t.column("z").to_numpy()
            to = np.concatenate([i, *(places(i, n, k) for k in keys)])
            order = np.argsort(to // BLOCK, kind="stable")
            blocks, starts = np.unique((to // BLOCK)[order], return_index=True)
            at, j, sent = (to % BLOCK)[order].astype(np.int16), (order // len(i)).astype(np.int16), value[order % len(i)]
            for block, a, b in zip(blocks, starts, [*starts[1:], len(order)], strict=True):
                one = [pa.array([x[a:b].tobytes()], pa.binary()) for x in (at, j, sent)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *one], names=["block", "at", "j", "z"])

    def gather(_key: tuple, own: pa.Table, sent: pa.Table) -> pa.Table:
        made = np.zeros((BLOCK, size))
        made[:, -1] = 1.0
        for at, j, value in zip(*(sent.column(c) for c in ("at", "j", "z")), strict=True):
            made[np.frombuffer(at.as_py(), np.int16), np.frombuffer(j.as_py(), np.int16)] = np.frombuffer(value.as_py())
        made = made[own.column("i").to_numpy() % BLOCK]
        return pa.table({"x": own.column("x"), "y": own.column("y"), "v": pa.FixedSizeListArray.from_arrays(made.ravel(), size).cast(pa.list_(pa.float64()))})

    def summed(_key: tuple, t: pa.Table) -> pa.Table:
        x, y, values = vectors(t)
        at, back = np.unique(np.stack([x, y], 1), axis=0, return_inverse=True)
        made = np.zeros((len(at), size))
        np.add.at(made, back.ravel(), values)
        return pa.table({"x": at[:, 0], "y": at[:, 1], "v": pa.FixedSizeListArray.from_arrays(made.ravel(), size).cast(pa.list_(pa.float64()))})

    spread = max(2 * z.sparkSession.sparkContext.defaultParallelism, ceil(n / (4 * DEALT)))
    sent = z.select("i", "z").repartition(spread, "i").mapInArrow(send, "block bigint, at binary, j binary, z binary")
    kind = "x double, y double, v array<double>"
    arrays = z.select(C("i").alias("i"), "x", "y", F.floor(C("i") / BLOCK).alias("block")).groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(gather, kind)
    if z.select("x", "y").distinct().count() < n:
        arrays = arrays.groupBy(F.pmod(F.xxhash64("x", "y"), F.lit(ceil(n / BLOCK))).alias("_b")).applyInArrow(summed, kind)
    arrays = checkpointed(arrays)
    num = circle(arrays, arrays, radius, size, total=True, apart=True).select(C("v")[0].alias("own"), F.when(C("v")[rounds + 1] > 0, F.slice("v", 2, rounds)).otherwise(F.array().cast("array<double>")).alias("others"))
    return moran(points, v, radius).crossJoin(num).select("i", "expected", "n", ((F.size(F.filter("others", lambda x: x >= C("own"))) + 1) / F.lit(rounds + 1)).alias("p"))


def slope_permuted(df: DataFrame, x: str, y: str, group: str, key: str, rounds: int = 5000, seed: int = 42) -> DataFrame:
    """(difference, p): difference of the slopes of y on x between rows with ``group`` and others, with a permutation p, both-sided.

    In each round as many rows as are in the group are drawn anew, by a keyed permutation of the row numbers. The rounds of a
    task's rows are made and summed in the task; only sums by round are shuffled. Those of the rest are what the group leaves of the whole.
    """
    own = checkpointed(numbered(df.select(key, dbl(x).alias("x"), dbl(y).alias("y"), C(group).alias("g")), [key], "_i").withColumn("_i", C("_i") - 1))
    both = C("x").isNotNull() & C("y").isNotNull()
    pick = lambda yes: F.regr_slope(F.when(C("g") == yes, C("y")), F.when(C("g") == yes, C("x")))
    one = own.agg(F.count(F.lit(1)).alias("n"), F.count_if("g").alias("m"), F.avg(F.when(both, C("x"))).alias("x"), F.avg(F.when(both, C("y"))).alias("y"), (pick(True) - pick(False)).alias("d")).first()
    n, m = one["n"], one["m"]
    keys = [j + seed * 100_003 for j in range(1, rounds + 1)]
    names = ["n", "x", "y", "xx", "xy"]
    mid_x, mid_y = one["x"] or 0.0, one["y"] or 0.0

    def sums(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, whole = np.zeros((rounds, 5)), np.zeros(5)
        for t in _batches(tables, DEALT):
            i, a, b = t.column("_i").to_numpy(), t.column("x").to_numpy() - mid_x, t.column("y").to_numpy() - mid_y
            known = ~(t.column("x").is_null().to_numpy() | t.column("y").is_null().to_numpy())
            a, b = np.where(known, a, 0.0), np.where(known, b, 0.0)
            v = np.stack([known.astype(float), a, b, a * a, a * b], 1)
            whole += v.sum(axis=0)
            for j, k in enumerate(keys):
                made[j] += (places(i, n, k) < m).astype(float) @ v
        rows = np.vstack([whole, made])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds + 1)), *(pa.array(rows[:, c].copy()) for c in range(5))], names=["j", *names])

    spread = max(2 * own.sparkSession.sparkContext.defaultParallelism, ceil(n / (4 * DEALT)))
    part = own.select("_i", "x", "y").repartition(spread, "_i").mapInArrow(sums, "j bigint, " + ", ".join(f"{c} double" for c in names))
    part = part.groupBy("j").agg(*(F.sum(c).alias(c) for c in names))  # one row a round
    whole = F.broadcast(part.filter("j = 0").select(*(C(c).alias(f"_{c}") for c in names)))
    # As in regr_slope, a side without rows or without spread has no slope.
    slope = lambda n, x, y, xx, xy: F.try_divide(xy - x * y / n, xx - x * x / n)
    d = part.filter("j > 0").join(whole).withColumn("d", slope(*(C(c) for c in names)) - slope(*(C(f"_{c}") - C(c) for c in names)))
    out = d.agg(F.count_if(F.abs("d") >= F.abs(F.lit(one["d"])) - 1e-12).alias("c"))
    return out.select(F.lit(one["d"]).cast("double").alias("difference"), ((1 + C("c")) / F.lit(float(rounds + 1))).alias("p"))


def fdr(df: DataFrame, p: str, order: str) -> DataFrame:
    """Benjamini-Hochberg: q of each row; null p gives null q."""
    known = df.filter(C(p).isNotNull())
    own = numbered(known, [p, order], "_i").crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("_m")))).withColumn("_b", C(p) * C("_m") / C("_i"))
    # The smallest bound from a row on: within its range, and of the ranges behind, which are one row each.
    ahead = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    behind = own.groupBy("_part").agg(F.min("_b").alias("_low")).select("_part", F.min("_low").over(ahead).alias("_behind"))
    here = F.min("_b").over(Window.partitionBy("_part").orderBy("_i").rowsBetween(0, Window.unboundedFollowing))
    q = own.withColumn("_here", here).join(F.broadcast(behind), "_part").withColumn("q", F.least(F.lit(1.0), "_here", "_behind"))
    return q.select(*df.columns, "q").unionByName(df.filter(C(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def simple_regression(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Slope, intercept, r2, standard error, t and p."""
    n = F.regr_count(y, x)
    out = df.groupBy(*by).agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    out = out.withColumn("se", F.sqrt((1 - C("r2")) * C("syy") / (C("n") - 2) / C("sxx"))).withColumn("t", F.try_divide(C("slope"), C("se")))
    return out.select(*by, "n", "slope", "intercept", "r2", "se", "t", t_pvalue(C("t"), dbl("n") - 2).alias("p"))


def agreement(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """RMSE, MAE, bias, Lin's concordance (population moments), means."""
    d = C(a) - C(b)
    return df.filter(C(a).isNotNull() & C(b).isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
        F.try_divide(2 * F.covar_pop(a, b), F.var_pop(a) + F.var_pop(b) + F.pow(F.avg(a) - F.avg(b), 2)).alias("ccc"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
    )


def fisher_interval(r: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    half = z / F.sqrt(n - 3)
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)


def icc(df: DataFrame, group: str, v: str) -> DataFrame:
    """Variance components of an unbalanced one-way design and their ratio."""
    g = df.filter(C(v).isNotNull()).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    a = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("nn"), F.sum(C("n") * C("n")).alias("n2"), F.sum(C("n") * C("s")).alias("w"), F.sum(C("n") * C("m")).alias("t"), F.sum(C("n") * C("m") * C("m")).alias("q"))
    msw = C("w") / (C("nn") - C("k"))
    n0 = (C("nn") - C("n2") / C("nn")) / (C("k") - 1)
    sb = F.greatest(F.lit(0.0), ((C("q") - C("t") * C("t") / C("nn")) / (C("k") - 1) - msw) / n0)
    return a.select(sb.alias("between"), msw.alias("within"), F.try_divide(sb, sb + msw).alias("icc"))


def bootstrap_ratio(df: DataFrame, cluster: str, num: str, den: str, rounds: int = 2000) -> DataFrame:
    """Interval of a pooled ratio when whole clusters are drawn anew, with replacement.

    Clusters are summed and numbered first. How often a cluster is in a round is a Poisson count with mean 1, by a hash of
    its number and the round: what drawing as many clusters as there are comes to, without drawing across clusters. So
    a cluster's rounds are made and summed in its task, and only sums by round are shuffled.
    """
    own = df.groupBy(cluster).agg(F.sum(num).alias("a"), F.sum(den).alias("b"))
    own = checkpointed(numbered(own, [cluster]).select("i", "a", "b"))
    draws = own.select("a", "b", "i", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    draws = draws.select("a", "b", "round", poisson(mixed(C("i"), C("round")) / F.lit(float(MODULUS))).alias("w"))
    per = draws.groupBy("round").agg(F.try_divide(F.sum(C("w") * C("a")), F.sum(C("w") * C("b"))).alias("ratio"))
    q = F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))  # one value a round
    return per.agg(q.alias("q")).select(*(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("low", "mid", "high"))))
