"""License scan by diagonal voting (DataFrame functions only).

All rolling word k-grams of a text are hashed and joined with the hashed k-grams
of license templates. A hit votes for the diagonal ``position in the text -
position in the template``; votes are counted by diagonal, neighbouring
diagonals (a word put in or left out) are merged, and a merged span counts if
the words its grams cover are a large enough part of the template.

Base phrases are templates too: a place is a diagonal on which every gram of
the phrase voted. Hits carry their words, so a hash alone never decides.

Templates are a parameter. Up to ``MOST_GRAMS`` grams, their hashes are tested
inside the scan (as a semi-join) before hits are joined with a broadcast, so that
texts are never shuffled. Beyond it, the text's grams are joined with the
templates' by hash in a shuffle, spread over ``SALTS`` so that a frequent gram is
not one task's; the hits are the same.

Edge cases: null and empty texts have no words, no labels and score 0; a very long
text is one row, and its hits are counted by diagonal; ties do not arise, as labels are sets
in order; rows that repeat are scanned each; an empty table gives an empty one; only
``doc_id`` and ``text`` are read, so columns of other names do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import ascii_lower

K = 3
MOST_GRAMS, SALTS = 20_000, 16
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    base: bool = False


#: Phrases of the contract, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences by which licenses are named or granted.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
)
TEMPLATES = tuple(Template(label, tuple(t.split()), True) for t, label in BASE.items()) + tuple(Template(label, tuple(t.split())) for label, t in NOTICES)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def templates_from(texts: dict[str, str] | list[tuple[str, str]]) -> tuple[Template, ...]:
    """Templates from (label, license text), such as a folder of full license texts."""
    own = []
    for label, text in texts.items() if isinstance(texts, dict) else texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        own.append(Template(label, tuple(w for w in re.split(_NOT_WORD, lowered) if w)))
    return tuple(own)


def _gram_table(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[DataFrame, int]:
    """(template, label, is_base, n, at, gram, hash), one row a template k-gram, and their number."""
    if any(len(t.words) < K for t in templates):
        raise ValueError(f"a template needs {K} words")
    rows = [(i, t.label, t.base, len(t.words), at, list(t.words[at : at + K])) for i, t in enumerate(templates) for at in range(len(t.words) - K + 1)]
    made = docs.sparkSession.createDataFrame(rows, "template int, label string, is_base boolean, n int, at int, gram array<string>")
    return made.withColumn("hash", F.xxhash64(*(F.get("gram", F.lit(j)) for j in range(K)))), len(rows)


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(doc_id, _row, n_words, template, label, is_base, n, at, pos): a row for each gram hit, and one with null template for each document."""
    grams, n_grams = _gram_table(docs, templates)
    step = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), words_of(F.col("text")).alias("_w"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("_w") - K), lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get("_w", i + j) for j in range(K))).alias("hash")))
    if n_grams <= most_grams:
        known = sorted({r["hash"] for r in grams.select("hash").collect()})  # bounded by most_grams
        hashes = F.filter(hashes, lambda x: x.hash.isin(known))
    step = step.withColumn("_h", F.when(F.size("_w") >= K, hashes).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>")))
    found = F.transform("_h", lambda x: F.struct(x.pos.alias("pos"), x.hash.alias("hash"), F.slice(F.col("_w"), x.pos + 1, K).alias("gram")))
    step = step.select("doc_id", "_row", F.size("_w").cast("long").alias("n_words"), found.alias("_h"))
    out = ["doc_id", "_row", "n_words", "template", "label", "is_base", "n", "at", "pos"]
    if n_grams <= most_grams:
        each = step.select("doc_id", "_row", "n_words", F.explode_outer("_h").alias("_h")).select("doc_id", "_row", "n_words", "_h.pos", "_h.hash", F.col("_h.gram").alias("_words"))
        own = F.broadcast(grams)  # at most most_grams rows
        return each.join(own, (each.hash == own.hash) & (F.col("_words") == own.gram), "left").select(*out)
    each = step.select("doc_id", "_row", "n_words", F.explode("_h").alias("_h"))
    each = each.select("doc_id", "_row", "n_words", "_h.pos", F.col("_h.hash").alias("_hash"), F.col("_h.gram").alias("_words"), F.pmod(F.col("_h.pos") + F.col("_row"), F.lit(SALTS)).alias("_salt"))
    own = grams.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = each.join(own, (each["_hash"] == own["hash"]) & (each["_salt"] == own["_salt"]) & (F.col("_words") == F.col("gram"))).select(*out)
    kinds = {f.name: f.dataType for f in met.schema}
    return met.unionByName(step.select("doc_id", "_row", "n_words", *(F.lit(None).cast(kinds[c]).alias(c) for c in out[3:])))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = 0.75, exact_below: int = 20, slack: int = 3, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row a document row.

    A merged span covers the template words that grams of up to ``slack``
    neighbouring diagonals vouch for; words put in between count against it.
    It is verified if it covers ``least`` of the template, or all of it for
    templates under ``exact_below`` words, which one word can tell apart.

    Hits are dealt once by document, and the three groupings below use that
    partitioning. What meets in a task is one document's hits.
    """
    own = hits(docs, templates, most_grams).repartition("_row")
    keys = ["_row", "doc_id", "n_words"]
    named = [*keys, "template", "label", "is_base", "n"]
    votes = own.groupBy(*named, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.sort_array(F.collect_list("at")).alias("ats"))
    lines = votes.groupBy(*named).agg(F.sort_array(F.collect_list(F.struct("diagonal", "ats"))).alias("ds"))
    whole = F.transform(F.filter("ds", lambda d: F.size(d.ats) == F.col("n") - K + 1), lambda d: d.diagonal)

    def covered(ats: Column) -> Column:
        """Template words under the sorted gram starts ``ats``."""
        return F.aggregate(F.transform(ats, lambda a, i: F.least(F.lit(K), F.coalesce(F.get(ats, i + 1) - a, F.lit(K)))), F.lit(0), lambda s, x: s + x)

    def merged(d: Column, i: Column) -> Column:
        run = F.filter(F.slice(F.col("ds"), i + 1, slack + 1), lambda e: e.diagonal - d.diagonal <= slack)
        ats = F.sort_array(F.array_distinct(F.flatten(F.transform(run, lambda e: e.ats))))
        put_in = F.element_at(run, -1).diagonal - d.diagonal
        return covered(ats) / (F.col("n") + put_in)

    lines = lines.withColumn("places", F.when(F.col("is_base"), whole)).withColumn("cover", F.when(~F.col("is_base"), F.array_max(F.transform("ds", merged))))
    n_base = F.when(F.col("is_base"), F.size("places")).otherwise(0)
    proven = (F.col("is_base") & (F.size("places") > 0)) | (F.col("cover") >= F.when(F.col("n") < exact_below, 1.0).otherwise(least))
    out = lines.groupBy(*keys).agg(
        F.coalesce(F.sum(n_base), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"),
        F.max(F.array_max("places")).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("is_base") & (F.size("places") > 0), F.col("label"))).alias("b"),
        F.collect_set(F.when(proven, F.col("label"))).alias("l"),
        F.coalesce(F.max(F.when(F.col("is_base") & (F.size("places") > 0), 1.0).otherwise(F.col("cover"))), F.lit(0.0)).cast("double").alias("score"),
    )
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("b").alias("base_labels"), joined("l").alias("labels"), "score")
