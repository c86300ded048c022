"""Quality rules with adaptive thresholds (DataFrame functions only).

``measure`` turns each whole text into counts. ``thresholds`` keeps one
mergeable quantile sketch (KLL) of each rule's value for every language and
source and derives a fence from its quantiles; ``verdicts`` joins the fences
back and filters.

Junk must not widen its own fence: the spread is the smaller of the distances of
the two quartiles from the median, and a source's fence never lets through what
its language's does not. Rules whose values do not depend on the language are
held to the fence of the whole table as well.

Sketches merge on the map side, so a hot source costs no skew.

Edge cases: null and empty texts have no words; null languages and sources form groups of
their own; a very long text is one row (with many repeated windows they are found by
sorting); a value equal to its fence passes; rows that repeat are measured each; an empty
table gives empty ones; a group without rows that pass the base rule has no fence of its own and
fails none; only ``text`` and the keys are read, so columns of other names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import SPACE

#: Up to so many different repeated windows, membership is tested in a list; beyond it, by sorting.
LISTED = 48


@dataclass(frozen=True)
class Rule:
    """Reject values beyond median +- ``times`` * max(spread, ``floor``); spread: the distance of the nearer quartile from the median.

    ``spoken``: the values depend on the language, so no fence goes beyond the first group column.
    """

    name: str
    times: float
    floor: float
    low: bool = False
    spoken: bool = False


RULES = (
    Rule("symbols_a_word", 6.0, 0.02),
    Rule("repeated_share", 6.0, 0.05),
    Rule("duplicate_lines_share", 6.0, 0.06),
    Rule("word_length", 8.0, 0.8, spoken=True),
    Rule("word_length_low", 8.0, 0.5, low=True, spoken=True),
)


def measure(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """One row of counts for each row of ``docs``; one narrow pass, no shuffle.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*keys, text.alias("_t"))
    step = step.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    step = step.withColumn("_l", F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    step = step.select(
        *keys,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "_w",
    )
    three = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    step = step.withColumn("_g", F.when(F.size("_w") >= 3, three).otherwise(F.array().cast("array<bigint>"))).drop("_w")
    step = step.withColumn("_s", F.sort_array("_g")).withColumn(
        "_d", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (x == F.get("_s", i - 1))))).otherwise(F.array().cast("array<bigint>"))
    ).drop("_s")
    listed = F.filter(F.sequence(F.lit(0), F.size("_g") - 1), lambda i: F.array_contains("_d", F.get("_g", i)))
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    step = step.withColumn("_p", F.when(F.size("_d") > LISTED, pairs)).withColumn(
        "_at",
        F.when(F.size("_d") == 0, F.array().cast("array<int>"))
        .when(F.size("_d") <= LISTED, listed)
        .otherwise(F.sort_array(F.transform(F.filter("_p", lambda x, i: ((i > 0) & (x.g == F.get("_p", i - 1).g)) | F.coalesce(x.g == F.get("_p", i + 1).g, F.lit(False))), lambda x: x.i))),
    )
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return step.select(*keys, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def failed_base() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_a_word": F.col("n_symbols") / words,
        "repeated_share": F.col("n_repeat_words") / words,
        "duplicate_lines_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "word_length": F.col("word_chars") / words,
        "word_length_low": F.col("word_chars") / words,
    }


def _fence(rule: Rule) -> Column:
    low, mid, high = (F.kll_sketch_get_quantile_double(f"_k_{rule.name}", F.lit(q)) for q in (0.25, 0.5, 0.75))
    spread = F.greatest(F.least(mid - low, high - mid), F.lit(rule.floor))
    return mid - rule.times * spread if rule.low else mid + rule.times * spread


def thresholds(counts: DataFrame, rules: tuple[Rule, ...] = RULES, groups: tuple[str, ...] = ("lang", "source"), size: int = 400) -> DataFrame:
    """A fence for each rule and group, from one KLL sketch each (``size``: its accuracy, k).

    It is the strictest of the group's own and those of its parents (the leading
    columns of ``groups``, at last none), whose sketches are merged from the groups'.
    """
    own = values()
    sketches = counts.groupBy(*groups).agg(*(F.kll_sketch_agg_double(own[r.name], F.lit(size)).alias(f"_k_{r.name}") for r in rules))
    out = sketches.select(*groups, *(_fence(r).alias(f"fence_{r.name}") for r in rules))
    for depth in range(len(groups) - 1, -1, -1):
        held = [r for r in rules if depth or not r.spoken]
        merged = sketches.groupBy(*groups[:depth]).agg(*(F.kll_merge_agg_double(f"_k_{r.name}", F.lit(size)).alias(f"_k_{r.name}") for r in held))
        above = merged.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups[:depth])), *(_fence(r).alias(f"_above_{r.name}") for r in held))
        same = F.lit(True)
        for i, g in enumerate(groups[:depth]):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        out = out.join(F.broadcast(above), same, "left")
        out = out.withColumns({f"fence_{r.name}": (F.greatest if r.low else F.least)(f"fence_{r.name}", f"_above_{r.name}") for r in held}).drop(*above.columns)
    return out


def verdicts(counts: DataFrame, fences: DataFrame, rules: tuple[Rule, ...] = RULES, groups: tuple[str, ...] = ("lang", "source"), least_words: int = 50) -> DataFrame:
    """``counts`` with one fail_ column a rule; texts under ``least_words`` words are left to other rules."""
    own, right = values(), fences.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), *(c for c in fences.columns if c.startswith("fence_")))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = counts.join(right, same, "left")
    for r in rules:
        beyond = own[r.name] < F.col(f"fence_{r.name}") if r.low else own[r.name] > F.col(f"fence_{r.name}")
        joined = joined.withColumn(f"fail_{r.name}", F.coalesce(beyond, F.lit(False)) & (F.col("n_words") >= least_words))
    return joined.drop(*(c for c in right.columns))
