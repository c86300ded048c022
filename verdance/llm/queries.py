"""The queries of this subpackage, as thin uses of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import audit, extract, language, licenses, mixing, near, packing, pii, quality, rules, search, toxicity, variants
from verdance.llm.common import crc_mod, materialise, table
from verdance.plans.registry import Registry


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every row. Null or empty text: the score without evidence; null doc_id: held_out false; repeats scored alike; no documents: no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, crc_mod("doc_id", 4) != 2)
    return quality.score(docs, model).select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all rows. Null or empty text: one piece of one id; a long text: several; repeats packed each; no documents: no rows."""
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of every row. Null or empty text: zero counts, null places, empty labels; repeats scanned each; no documents: no rows."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every row. Null or empty text: its own group; null doc_id: no group, kept false; rows of one doc_id agree; no documents: no rows."""
    return near.groups(table(spark, sf_dir, "documents")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


#: Shares of the tokens that the mix is to have, by domain: languages of good documents, and documents of low quality.
WEIGHTS = {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.12, "low": 0.02}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, rate and copies of every row, and the largest gap of the mix. Null or empty text: no tokens; repeats alike; no documents: no rows."""
    own, fit, model = mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WEIGHTS, ["doc_id"], missing="skip")
    shares = (F.get("p", F.lit(j)).alias(f"p_{name}") for j, name in enumerate(model.domains))
    return own.select("doc_id", "tokens", *shares, "rate", "copies", F.lit(fit.gap).alias("gap"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every row. Null or empty text: the score of zero features; null doc_id: held_out false; repeats alike; no documents: no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every row. Null or empty text: none; repeats alike; spans at one start by kind; no documents: no rows."""
    found, _ = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{pii.KINDS[k]}") for k in (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)),
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("all")).alias("spans"),
    )


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row. Null or empty text: zero words, base_failed; null lang and source: a group; no documents: no rows."""
    counts = materialise(rules.measure(table(spark, sf_dir, "documents")), "rules")
    own = rules.verdicts(counts, rules.thresholds(counts.filter(~rules.failed_base())))
    failed = F.lit(False)
    for r in rules.RULES:
        failed = failed | F.col(f"fail_{r.name}")
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules.failed_base().alias("base_failed"), (~rules.failed_base() & ~failed).alias("kept"))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of every query vector. Null or broken vectors take no part; ties to smaller ids; repeated ids once; no vectors: no rows."""
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every row. Null, empty or letterless text: und, score 0; null doc_id: held_out false; repeats alike; no documents: no rows."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, crc_mod("doc_id", 3) != 1)
    return language.predict(docs, model).select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter audit of all rows, 600 a part. Null or empty text: no words; null lang: part of the empty string; repeats count each; no documents: no rows."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null or empty html, or none in it: empty text; long pages whole; repeats read each; no pages: no rows."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their forms. Null or empty text: no words; ties to the smaller word; repeats count each; no words: no rows."""
    return variants.variants(table(spark, sf_dir, "documents"))


R = Registry()
for _query, _sql in (
    (op1_quality, None),
    (op2_packing, None),
    (op3_licenses, None),
    (op4_near, None),
    (op5_mixing, None),
    (op6_toxicity, None),
    (op7_pii, None),
    (op8_rules, None),
    (op9_search, search.ORACLE),
    (op10_language, None),
    (op11_audit, audit.ORACLE),
    (op12_extract, None),
    (op13_variants, None),
):
    R.add(_query.__name__, _sql)(_query)
