"""A corpus pipeline of five stages over ``documents``.

Each stage is one operator of ``verdance.llm`` with its decisions put into
effect; its result is written as Parquet and read again as the next one's input.
All but the last return the columns of ``documents``, and extra columns of the
input go along, whatever their names.

Every stage takes null and empty texts (clean, in no near-duplicate group, without spans,
without tokens but for packing's end mark), very long texts, ties (decided by
doc_id), rows that repeat (decided alike; near copies of one doc_id stay together), null
doc_ids (kept by the filters) and empty tables (no rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import mixing, near, packing, pii, toxicity
from verdance.llm.common import materialise, named, table

#: Scores from here on are rejected.
TOXIC = 0.5
#: Words in a shingle of the near-duplicate stage.
WIDTH = 5
#: Shares of the tokens by domain, and the part of all tokens that is kept.
WEIGHTS = {"en": 0.585, "de": 0.15, "fr": 0.15, "es": 0.10, "low": 0.015}
BUDGET = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC; without labels of both classes all rows have the labels' share as score."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.below(docs, model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; texts without words and null ids stay."""
    return near.kept(docs, width=WIDTH)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind; null texts stay null, n_chars follows the text."""
    keyed = docs.select(F.struct(*named(docs)).alias("_row"), F.col("text"))
    found = pii.candidates(keyed, ("_row",))
    kept = materialise(found, "private")
    model = pii.fit(kept)
    masked = pii.decide(kept, model).select("_row", pii.redact(F.col("_row.text"), F.col("all")).alias("_masked"))
    new = {"text": F.col("_masked"), "n_chars": F.length("_masked").cast("long")}
    return masked.select(*(new.get(c, own).alias(c) for c, own in zip(docs.columns, named(docs, "_row."), strict=True)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the domains' expected tokens match WEIGHTS; none is repeated, and a gap that stays is warned of."""
    return mixing.drawn(docs, table(spark, sf_dir, "labels"), WEIGHTS, "doc_id", BUDGET, most=1.0, missing="skip")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as the packing operator gives them, without the ids themselves; an empty text is one id."""
    return packing.pack(docs).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_private),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned models and components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
