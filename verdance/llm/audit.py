"""Audit of how filters interact: what each removes at every place in every order.

Texts are read once and turned into one small row a document: its part, the
filters it fails, and a digest of the text that finds repeats. A partition of these rows
becomes packed bitsets, one a filter, one a label and one a part; for every set of
filters that may stand in front, AND-NOT and a population count give what is
left and what the next filter takes. Counts of partitions add up, and the orders are
read off the sums: 80 (set in front, filter) pairs serve all 120 orders.

Null and empty texts are empty (no words: only the length filter fails, and the repeat
filter for all but the smallest id); null languages and empty ones are one part; texts of any
length are read whole; a null doc_id has no labels and is no repeat, and is nobody's earlier copy; rows that
repeat with their id count each, none as a copy of the other; of several labels of an id the larger counts;
no documents give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.llm.common import SPACE, UPPER, arrow_rows, materialise

#: Filters in the order of their bits.
FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1
#: The filter that needs the whole table.
REPEAT = 16
#: (set in front, filter) pairs, and what is counted of each.
PAIRS = [(done, f) for done in range(ALL + 1) for f in range(len(FILTERS)) if not done >> f & 1]
COUNTS = ("alive", "removed", "redundant", "good_lost", "toxic_lost")
#: Parts whose counts a task holds before it hands them on; the sums do not depend on it.
HELD = 4096


def failed_alone(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; each needs that text only."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))
    n, kinds = F.get(counted, F.lit(0))["n"], F.get(counted, F.lit(0))["kinds"]
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = (n < 200, 100 * kinds.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each document: the filters it fails, the last of them by all texts of the table.

    A text's smallest doc_id is found by its SHA-256 digest, an aggregate that combines
    in the scan. A row is no repeat if (doc_id, digest) is among these firsts: a join on
    ids, in which a text of which there are many copies is no hot key.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failed_alone(text).cast("int").alias("mask"))
    own = materialise(own, "audit")
    keyed, others = own.filter("doc_id is not null"), own.filter("doc_id is null")
    firsts = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    seen = keyed.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + REPEAT).alias("mask"))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    no = F.lit(False)
    out = seen.join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return out.unionByName(others.select("part", "mask", no.alias("good"), no.alias("toxic")))


def popcount(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def tallied(mask: np.ndarray, good: np.ndarray, toxic: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """COUNTS by part and pair, from packed bitsets of the rows."""
    order = np.argsort(part, kind="stable")
    mask, good, toxic, part = mask[order], good[order], toxic[order], part[order]
    fails = [np.packbits(mask >> f & 1) for f in range(len(FILTERS))]
    labels = [np.packbits(good), np.packbits(toxic)]
    any_of = [np.zeros_like(labels[0])]
    for done in range(1, ALL + 1):
        low = (done & -done).bit_length() - 1
        any_of.append(any_of[done & (done - 1)] | fails[low])
    out = np.zeros((parts, len(PAIRS), len(COUNTS)), np.int64)
    starts = np.searchsorted(part, np.arange(parts + 1))
    for p, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        # Rows lie by part, so a part's bitset is all ones between its ends; bytes beyond them are not looked at.
        span = slice(a >> 3, (b + 7) >> 3)
        bits = np.zeros((span.stop - span.start) * 8, np.uint8)
        bits[a - 8 * span.start : b - 8 * span.start] = 1
        member = np.packbits(bits)
        for k, (done, f) in enumerate(PAIRS):
            gone, fail = any_of[done][span], fails[f][span]
            alive = member & ~gone
            removed = alive & fail
            out[p, k] = (popcount(alive), popcount(removed), popcount(member & fail & gone), *(popcount(removed & x[span]) for x in labels))
    return out


def index_counts(rows: DataFrame) -> DataFrame:
    """(part, done, filter, and COUNTS) summed over all partitions; ``done`` is the set of filters in front."""
    schema = pa.schema([("part", pa.string()), ("done", pa.int32()), ("filter", pa.int32()), *((c, pa.int64()) for c in COUNTS)])

    def handed(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(PAIRS)
        counts = np.concatenate(list(held.values()))
        done, filters = zip(*PAIRS, strict=True)
        return arrow_rows(schema, {"part": [p for p in held for _ in range(n)], "done": done * len(held), "filter": filters * len(held)} | {c: counts[:, i] for i, c in enumerate(COUNTS)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            part = batch.column("part").dictionary_encode()
            names = part.dictionary.to_pylist()
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            for name, counts in zip(names, tallied(column("mask"), column("good"), column("toxic"), part.indices.to_numpy(), len(names)), strict=True):
                held[name] = held[name] + counts if name in held else counts
            if len(held) > HELD:
                yield handed(held)
                held = {}
        if held:
            yield handed(held)

    kinds = "part string, done int, filter int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.mapInArrow(run, kinds).groupBy("part", "done", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    counts = index_counts(marked(docs, labels))
    # A set of k filters stands in front of the next one in k! (4 - k)! of the orders.
    size = F.bit_count("done")
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), size + 1)
    own = Window.partitionBy("part", "filter")  # 16 rows each
    whole = counts.withColumns({
        "shapley": F.sum(ways * F.col("removed")).over(own),
        "unique_fails": F.sum(F.when(size == len(FILTERS) - 1, F.col("removed")).otherwise(0)).over(own),
    })
    steps = [("".join(FILTERS[f] for f in order), i + 1, sum(1 << f for f in order[:i]), f) for order in permutations(range(len(FILTERS))) for i, f in enumerate(order)]
    orders = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, done int, filter int"))  # 600 rows
    out = whole.join(orders, ["done", "filter"])
    return out.select("part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = r"""WITH l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM f GROUP BY part, mask),
x AS (SELECT chr(65 + i::INTEGER) AS c, i AS b FROM range(5) r(i)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS s FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
p AS (SELECT filter_order, CAST(k AS INTEGER) AS step, s[k] AS f, CAST(list_sum([0] || list_transform(s[1:k - 1], lambda v: 1 << v)) AS BIGINT) AS done FROM o, range(1, 6) q(k)),
r AS (SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (done | (1 << f)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & done = 0 AND mask & (1 << f) <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & done <> 0 AND mask & (1 << f) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & done = 0 AND mask & (1 << f) <> 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & done = 0 AND mask & (1 << f) <> 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM g, p GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
