"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of learned lexicon words and word stems
(overall and in the densest window of ``WINDOW`` words, so that a short passage
in a long text is seen), hits close to second-person words, hits that appear
only once a word's obfuscation is undone, capitals, punctuation, and words
with digits or punctuation inside.

The lexicon, trees and calibration are learned from at most about ``rows``
labelled rows of each class; the lexicon has at most ``lexicon`` entries.

Edge cases: null and empty texts have all features zero and get the model's score
for that; a very long text is one row, whose densest window still shows a short passage; equal
features give equal scores; of several labels of one id the larger counts; rows that repeat are
scored each, and alike; an empty table gives an empty one; without labels of both classes the
score is the share of toxic labels; only ``doc_id`` and ``text`` are read, so columns of
other names do not matter (``below`` returns them all).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.boost import Trees, fit_trees, isotonic
from verdance.llm.common import SPACE, class_counts, labelled_sample, map_arrow, small_batches, texts

WINDOW, NEAR, STEM = 40, 6, 4
#: Second-person words of some languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro su sus"
#: Signs that stand for letters, in order.
LEET_FROM, LEET_TO = "013457@$!|", "oieastasil"
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UNDO = bytes.maketrans(LEET_FROM.encode(), LEET_TO.encode())
#: A bound on what a worker remembers of words it has met.
CACHE = 120_000
LEX, STEMMED, HIDDEN, SECOND, CAPS, INNER, DIGIT = 1, 2, 4, 8, 16, 32, 64
N_FEATURES = 16
#: Part of the texts of class 1 in which a word of the lexicon occurs at least.
PART = 0.01


@dataclass(frozen=True)
class ToxicityModel:
    words: frozenset
    stems: frozenset
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]


def undo(word: bytes) -> bytes:
    """Letters that a disguised word stands for: signs read as letters, other signs and repeats dropped."""
    plain = word.translate(_UNDO).translate(None, _PUNCT + b"0123456789")
    return bytes(c for i, c in enumerate(plain) if i < 2 or not c == plain[i - 1] == plain[i - 2])


class Words(dict):
    """Flags of a word (bytes between white space), worked out once while it is remembered."""

    def __init__(self, words: frozenset, stems: frozenset):
        self.words, self.stems = words, stems
        self.second = {w.encode() for w in SECOND_PERSON.split()}

    def __missing__(self, raw: bytes) -> int:
        core = raw.strip(_PUNCT)
        low = core.decode("utf-8", "replace").lower().encode()
        flags = 0
        if low in self.words:
            flags |= LEX
        if stem_of(low) in self.stems:
            flags |= STEMMED
        if low in self.second:
            flags |= SECOND
        inner = core.translate(None, _PUNCT) != core
        digit = any(48 <= c < 58 for c in core) and any(c >= 65 for c in core)
        if not flags & LEX and (inner or digit or low != raw.lower()):
            if undo(raw.decode("utf-8", "replace").lower().encode()) in self.words and (inner or digit or undo(raw.lower()) != low):
                flags |= HIDDEN
        if len(core) > 2 and core.isupper():
            flags |= CAPS
        if inner:
            flags |= INNER
        if digit:
            flags |= DIGIT
        if len(self) >= CACHE:
            self.clear()
        self[raw] = flags
        return flags


def stem_of(low: bytes) -> bytes:
    return low.decode("utf-8", "replace")[:STEM].encode()


def features(text: str | None, words: Words) -> list[float]:
    """The N_FEATURES dense features of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts = raw.split()
    n = len(parts)
    if not n:
        return [0.0] * N_FEATURES
    code = np.fromiter(map(words.__getitem__, parts), np.int16, n)
    hit = (code & (LEX | HIDDEN)) > 0
    stem = (code & STEMMED) > 0
    any_hit = hit | stem
    you = (code & SECOND) > 0

    def densest(x: np.ndarray) -> float:
        if not x.any():
            return 0.0
        s = np.concatenate([[0], np.cumsum(x)])
        return float((s[WINDOW:] - s[:-WINDOW]).max() if n > WINDOW else s[-1])

    near = 0
    if any_hit.any() and you.any():
        s = np.concatenate([[0], np.cumsum(you)])
        at = np.flatnonzero(any_hit)
        near = int((s[np.minimum(at + NEAR + 1, n)] - s[np.maximum(at - NEAR, 0)] > 0).sum())
    size = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(size[65:91].sum() + size[97:123].sum()))
    marks = int(size[33:48].sum() + size[58:65].sum() + size[91:97].sum() + size[123:127].sum())
    count = float(hit.sum())
    return [
        count / n, float(np.log1p(count)), densest(hit), float(stem.sum()) / n, float(np.log1p(stem.sum())), densest(stem),
        float(((code & HIDDEN) > 0).sum()), near / n, float(np.log1p(near)), float(size[65:91].sum()) / letters,
        float(((code & CAPS) > 0).mean()), marks / len(raw), float(size[33]) / n, float(((code & INNER) > 0).mean()),
        float(((code & DIGIT) > 0).mean()), float(np.log1p(n)),
    ]


def signature(text: Column) -> Column:
    """The smallest hash of three words in a row (of all words, if fewer): near copies nearly always share it, other texts hardly ever."""
    words = F.array_remove(F.split(F.lower(text), SPACE), "")

    def smallest(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) < 3, F.xxhash64(F.array_join(w, " "))).otherwise(F.array_min(runs))

    # In an array of one, so that a text is cut into words once and not for each of its runs.
    return F.get(F.transform(F.array(words), smallest), F.lit(0))


def learn_lexicon(sample: DataFrame, most: int, least: int, odds: float) -> tuple[frozenset, frozenset]:
    """Words and stems that texts of class 1 have far more often, at most ``most`` of either.

    What counts are different texts, by their signatures, so copies of one text support a word once. A word
    needs ``least`` texts of class 1 and PART of all of them, and some in both halves into which signatures fall.
    """
    low = F.lower("text")
    tokens = F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    out = []
    base = sample.select("label", signature(F.col("text")).alias("g"), tokens.alias("t")).groupBy("label", "g").agg(F.array_distinct(F.flatten(F.collect_set("t"))).alias("t"))
    share = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = max(least, PART * share.get(1, 0))
    for made in (F.col("t"), F.transform("t", lambda w: F.substring(w, 1, STEM))):
        own = base.select("label", (F.pmod("g", F.lit(2)) == 0).alias("half"), F.explode(F.array_distinct(made)).alias("w"))
        counts = own.groupBy("w").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"), F.sum(F.when(F.col("half"), F.col("label")).otherwise(0)).alias("here"))
        ratio = F.log((F.col("pos") + 0.5) / F.lit(share.get(1, 0) + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(share.get(0, 0) + 1.0))
        both = (F.col("here") > 0) & (F.col("here") < F.col("pos"))
        best = counts.filter((F.col("pos") >= least) & both & (ratio >= odds) & (F.length("w") >= STEM)).orderBy((ratio * F.log1p("pos")).desc(), "w").limit(most)
        out.append(frozenset(r["w"].encode() for r in best.collect()))
    return out[0], out[1]


def _measure(docs: DataFrame, words: frozenset, stems: frozenset, finish, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    state: dict[str, Words] = {}

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = state.setdefault("words", Words(words, stems))
        x = np.array([features(t, known) for t in texts(batch)])
        made = finish(x)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *more)), made], names=[c.split()[0] for c in schema.split(", ")])

    return map_arrow(docs.select("doc_id", "text", *more), make, schema, state)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 3000, lexicon: int = 400, least: int = 3, odds: float = 3.0) -> ToxicityModel:
    """Learn from at most about ``rows`` rows of each class for which ``learn`` holds.

    The lexicon comes from one half of the sample (by a hash of the id) and the
    trees from the other half, so trees do not trust words that only fit by chance.
    The calibration is fitted on scores of rows that the scoring trees have not seen.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", learn, rows)
    kept = sample.withColumn("half", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(2)))
    counts = class_counts(labels, "toxic", learn)
    words, stems = learn_lexicon(kept.filter("half = 0"), lexicon, least, odds)
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = _measure(kept.filter("half = 1"), words, stems, lambda x: pa.array(list(x), pa.list_(pa.float64())), f"doc_id {kind}, label int, x array<double>", ("label",)).orderBy("doc_id").collect()
    y = np.array([r["label"] for r in got], float)
    total = max(1, sum(counts.values()))
    if len(set(y)) < 2:
        share = counts.get(1, 0) / total
        none = Trees(0.0, np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 2)))
        return ToxicityModel(words, stems, none, (np.zeros(1), np.array([share])))
    x = np.array([r["x"] for r in got])
    w = np.where(y == 1, counts[1] / total / (y == 1).sum(), counts[0] / total / (y == 0).sum()) * len(y)
    fold = np.arange(len(y)) % 3
    raw = np.zeros(len(y))
    for f in range(3):
        raw[fold == f] = fit_trees(x[fold != f], y[fold != f], w[fold != f]).raw(x[fold == f])
    return ToxicityModel(words, stems, fit_trees(x, y, w), isotonic(raw, y, w))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row; one narrow pass over whole texts."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(x: np.ndarray) -> pa.Array:
        return pa.array(np.clip(np.interp(model.trees.raw(x), *model.knots), 0.0, 1.0), pa.float64())

    return _measure(docs, model.words, model.stems, finish, f"doc_id {kind}, score double")


def below(docs: DataFrame, model: ToxicityModel, threshold: float) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose score is under ``threshold``; one narrow pass."""
    small_batches(docs.sparkSession)
    state: dict[str, Words] = {}

    # Numbered columns on the way, since the step takes columns by names that may hold dots.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = state.setdefault("words", Words(model.words, model.stems))
        x = np.array([features(t, known) for t in texts(batch, text)])
        return batch.filter(pa.array(np.interp(model.trees.raw(x), *model.knots) < threshold))

    return map_arrow(plain, make, plain.schema, state).toDF(*docs.columns)
