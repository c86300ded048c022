"""Mixing to target weights by soft membership (DataFrame functions only).

A Bayes classifier over hashed word endings, learned from a labelled table
by aggregation, gives each document a posterior over domains. Document rates r
between zero and ``most`` are then fitted so that the expected tokens of each
domain, sum of r_i * tokens_i * p_id, come as close as can be to their targets
(least squares, weighted by one over a domain's natural share, so that small
domains count), by projected gradient steps

    r_i <- min(most, max(0, r_i - step * p_i . e)),   e = (expected - target) / natural

which is the gradient scaled by 1 / tokens_i; all it needs from the corpus in a
step is one sum a domain. Rates depend on a document through its posterior
only, so documents are first grouped by their posteriors in ``GRID`` steps.

A document is kept ``floor(r)`` times and once more by a hash of its id with the
chance of what is left, so a run that is repeated decides alike.

Targets may be out of reach (rates have a largest value, posteriors are soft):
the fit reports what it reaches and the largest gap, ``drawn`` warns of it.

Edge cases: null and empty texts have no tokens and the classes' shares as
posterior; a very long text is one row and counts with all its words; ties of likelihoods
give equal posteriors; rows that repeat are rated each, and alike; an empty table gives an
empty one; without labelled rows there are no domains and every rate is one; rows with a null key are
kept once by ``drawn``; columns but the keys and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import SPACE, bounded_sample, chance, materialise, named

#: Posteriors are rounded to multiples of 1 / GRID.
GRID = 250
#: Log likelihoods are kept as whole numbers of 1 / UNIT.
UNIT = 256


@dataclass(frozen=True)
class Mix:
    domains: tuple[str, ...]
    target: tuple[float, ...]
    reached: tuple[float, ...]
    natural: tuple[float, ...]
    errors: tuple[tuple[float, ...], ...]
    step: float
    most: float
    missing: tuple[str, ...] = ()
    gap: float = 0.0  # largest distance of a reached share from its target, as a share of all tokens


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Characters of a word's end that stand for it, and steps of the share of different words.
ENDING, REPEATS = 3, 10


def bucket_counts(docs: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``keys``, _n (words) and _b: the different buckets of a text.

    There is a bucket for each hashed word ending (``buckets`` of them), which tells languages, case and marks
    apart without a list of words, and one for how many of the words differ.
    """
    own = docs.select(*keys, words(F.col("text")).alias("_w"))
    ends = F.transform("_w", lambda w: F.pmod(F.xxhash64(F.right(w, F.lit(ENDING))), F.lit(buckets)).cast("int"))
    ratio = F.floor(F.lit(REPEATS) * F.size(F.array_distinct("_w")) / F.greatest(F.size("_w"), F.lit(1))).cast("int")
    return own.select(*keys, F.size("_w").cast("long").alias("_n"), F.array_append(F.array_distinct(ends), ratio + buckets).alias("_b"))


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    prior: tuple[float, ...]
    table: np.ndarray  # buckets x domains, log likelihoods
    buckets: int


def fit_domains(docs: DataFrame, labelled: DataFrame, rows: int = 2000, buckets: int = 4096, most_domains: int = 64, smooth: float = 0.5) -> DomainModel:
    """Learn from ``labelled`` (doc_id, domain), at most about ``rows`` documents a domain.

    Ids are sampled before texts are read: what is broadcast to the scan are at
    most about ``rows * most_domains`` ids, and what is collected are counts by
    bucket and domain, at most ``buckets * most_domains``. More domains than
    ``most_domains`` are an error: none is dropped.
    """
    own = materialise(labelled.filter(F.col("domain").isNotNull()).select("doc_id", "domain"), "domains")
    shares = {r["domain"]: r["n"] for r in own.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).limit(most_domains + 1).collect()}
    if len(shares) > most_domains:
        raise ValueError(f"more than {most_domains} domains; raise most_domains or merge some")
    domains = tuple(sorted(shares))
    if not domains:
        return DomainModel((), (), np.zeros((buckets + REPEATS + 1, 0)), buckets)
    picked = bounded_sample(own.filter(F.col("domain").isin(list(domains))), "doc_id", ["domain"], rows)
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    # Outer, though no array is empty: else a filter on its size goes in front of the join, and all texts are cut into words.
    counts = bucket_counts(sample, ["domain"], buckets).select("domain", F.explode_outer("_b").alias("b")).groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    table = np.full((buckets + REPEATS + 1, len(domains)), smooth)
    at = {d: i for i, d in enumerate(domains)}
    for r in counts:
        table[r["b"], at[r["domain"]]] += r["n"]
    total = float(sum(shares.values()))
    return DomainModel(domains, tuple(float(np.log(shares[d] / total)) for d in domains), np.log(table / table.sum(0)), buckets)


def posteriors(docs: DataFrame, model: DomainModel, keys: list[str], temper: float = 0.5) -> DataFrame:
    """``keys``, tokens (words) and p: one posterior a domain, in steps of 1 / GRID, that sum to one.

    The log likelihood is averaged over a document's different buckets and taken
    ``temper`` times their number to the power 1/2, since words are not independent.
    """
    d = len(model.domains)
    own = bucket_counts(docs, keys, model.buckets)
    # Constants that are parsed once when the plan is made; their size is the model's, buckets x domains.
    tables = [F.from_json(F.lit(json.dumps([int(v) for v in (model.table[:, j] * UNIT).round()])), "array<int>") for j in range(d)]
    own = own.select(*keys, F.col("_n").alias("tokens"), F.size("_b").alias("_k"), *((_looked_up(t) / UNIT).alias(f"_s{j}") for j, t in enumerate(tables)))
    scale = F.lit(temper) / F.sqrt(F.greatest(F.col("_k"), F.lit(1)).cast("double"))
    z = F.array(*(F.lit(model.prior[j]) + F.col(f"_s{j}") * scale for j in range(d))) if d else F.array().cast("array<double>")
    own = own.select(*keys, "tokens", z.alias("_z")).select(*keys, "tokens", F.transform("_z", lambda x: F.exp(x - F.array_max("_z"))).alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    own = own.select(*keys, "tokens", F.transform("_e", lambda x: F.round(x / total * GRID).cast("double")).alias("_g"))
    whole = F.aggregate("_g", F.lit(0.0), lambda a, x: a + x)
    return own.select(*keys, "tokens", F.transform("_g", lambda x: F.round(x / whole, 9)).alias("p"))


def _looked_up(table: Column) -> Column:
    """Sum of the table's entries for a document's buckets."""
    return F.aggregate("_b", F.lit(0).cast("bigint"), lambda a, b: a + F.get(table, b))


def rate(p: Column, errors: tuple[tuple[float, ...], ...], step: float, most: float, start: float = 1.0) -> Column:
    """The rate after the projected steps for ``errors``."""
    if not errors:
        return F.lit(start)
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in e)) for e in errors))

    def one(r: Column, e: Column) -> Column:
        dot = F.aggregate(F.zip_with(p, e, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.least(F.lit(most), F.greatest(F.lit(0.0), r - F.lit(step) * dot))

    return F.aggregate(steps, F.lit(start), one)


def fit_rates(docs: DataFrame, domains: tuple[str, ...], weights: dict[str, float], budget: float = 1.0, most: float = 4.0, steps: int = 40, tolerance: float = 2e-4, missing: str = "raise") -> Mix:
    """Rates for documents (tokens, p) whose expected tokens match ``weights`` of ``budget`` times all tokens.

    Weights that name domains nobody has learned are an error, or, with
    ``missing="skip"``, are left unfilled: the others keep their shares, and the fit names
    what is missing and counts it in its gap. A document's rate is recomputed from the
    steps' errors, so nothing is kept for it between steps.
    """
    absent = tuple(sorted(k for k, v in weights.items() if v > 0 and k not in domains))
    if absent and missing != "skip":
        raise ValueError(f"no labelled documents of {', '.join(absent)}; known domains: {', '.join(domains) or 'none'}")
    d = len(domains)
    w = np.array([max(0.0, weights.get(k, 0.0)) for k in domains])
    groups = materialise(docs.groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0"), "mix")
    sums = lambda df, r: df.agg(*(F.sum(r * F.col("tokens") * F.get("p", F.lit(j))).alias(f"s{j}") for j in range(d)), F.sum("tokens").alias("all")).first()
    every = sum(max(0.0, v) for v in weights.values())
    lost = max((weights[k] / every * budget for k in absent), default=0.0)
    if not d or w.sum() <= 0:
        return Mix(domains, tuple(w), tuple(w), tuple(w), (), 1.0, most, absent, lost)
    first = sums(groups, F.lit(1.0))
    total = float(first["all"] or 0.0)
    if total <= 0:
        return Mix(domains, tuple(w / every * budget), (0.0,) * d, (0.0,) * d, (), 1.0, most, absent, max(lost, float(w.max() / every * budget)))
    natural = np.array([first[f"s{j}"] for j in range(d)]) / total
    target = w / every * budget
    weight = 1 / np.maximum(natural, 1e-4)
    errors, reached = [], natural
    gram = groups.agg(*(F.sum(F.get("p", F.lit(i)) * F.get("p", F.lit(j)) * F.col("tokens")).alias(f"g{i}_{j}") for i in range(d) for j in range(d))).first()
    # The step is one over the curvature's largest eigenvalue.
    curve = np.array([[gram[f"g{i}_{j}"] for j in range(d)] for i in range(d)]) / total
    step = 1.0 / max(float(np.linalg.eigvalsh(np.sqrt(weight)[:, None] * curve * np.sqrt(weight)[None]).max()), 1e-6)
    for _ in range(steps):
        e = reached - target
        if np.abs(e).max() < tolerance:
            break
        errors.append(tuple(float(x) for x in e * weight))
        row = sums(groups, rate(F.col("p"), tuple(errors), step, most))
        reached = np.array([row[f"s{j}"] for j in range(d)]) / total
    gap = max(lost, float(np.abs(reached - target).max()))
    return Mix(domains, tuple(target), tuple(reached), tuple(natural), tuple(errors), step, most, absent, gap)


def copies(key: Column, rates: Column, seed: int = 11) -> Column:
    """How often a document is kept: the whole part of its rate, and one more with the chance of the rest."""
    return (F.floor(rates) + F.when(chance(key, seed) < rates - F.floor(rates), 1).otherwise(0)).cast("long")


def labelled_domains(docs: DataFrame, labels: DataFrame, low: str = "low") -> DataFrame:
    """(doc_id, domain) of labelled documents: the language of good ones, ``low`` for those of quality 0."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = docs.select("doc_id", "lang").join(own, "doc_id")
    return own.select("doc_id", F.when(F.col("quality") == 0, F.lit(low)).otherwise(F.col("lang")).alias("domain"))


def drawn(docs: DataFrame, labels: DataFrame, weights: dict[str, float], key: str = "doc_id", budget: float = 1.0, most: float = 1.0, missing: str = "raise", warn_at: float = 0.005) -> DataFrame:
    """Rows of ``docs``, each as often as the mix has it; rows with a null key are kept once.

    The fit needs tokens and posteriors only, which are written; the draw works
    them out again beside the row, so that whole texts are never joined.
    """
    _, fit, model = mixed(docs, labels, weights, [key], budget, most, missing)
    if fit.gap > warn_at:
        reached = {d: (round(float(r), 4), round(float(t), 4)) for d, r, t in zip(fit.domains, fit.reached, fit.target, strict=True)}
        warnings.warn(f"the mix misses a target by {fit.gap:.4f} of all tokens; reached and target: {reached}, missing: {fit.missing}", stacklevel=2)
    row = docs.select(F.struct(*named(docs)).alias("_row"), F.col(key).alias("_key"), "text")
    times = F.when(F.col("_key").isNull(), 1).otherwise(copies(F.col("_key"), F.col("_rate")))
    own = posteriors(row, model, ["_row", "_key"]).withColumn("_rate", rate(F.col("p"), fit.errors, fit.step, fit.most))
    # Generated, not filtered: a filter on the count would be pushed down and work the posterior out many times.
    own = own.select("_row", F.explode_outer(F.array_repeat(F.lit(1), times.cast("int"))).alias("_once")).filter("_once is not null")
    return own.select(*named(docs, "_row."))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], keys: list[str], budget: float = 1.0, most: float = 4.0, missing: str = "raise") -> tuple[DataFrame, Mix, DomainModel]:
    """``keys``, tokens, p, rate and copies of every row, with the fit behind them; the first key may have any type."""
    model = fit_domains(docs, labelled_domains(docs, labels))
    own = materialise(posteriors(docs, model, keys), "posteriors")
    fit = fit_rates(own, model.domains, weights, budget, most, missing=missing)
    rated = own.withColumn("rate", rate(F.col("p"), fit.errors, fit.step, fit.most))
    return rated.withColumn("copies", copies(F.col(keys[0]), F.col("rate"))), fit, model
