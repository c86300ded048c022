"""Language identification by hierarchical discrimination.

A text's character 1- to 3-grams (of the lower-cased UTF-8 bytes, digits and
ASCII signs read as one blank) are hashed into ``DIM`` buckets; square roots
of the counts, scaled to length one, are the features. First linear support
vector machines, one against the rest, choose the family; then one-versus-one
machines vote among the family's languages.

The models are learned from at most about ``rows`` rows of each language, on the
driver, in one product a step for all machines of a level.

Edge cases: texts that are null, empty or without a letter get ``und`` and score 0;
a very long text counts with all its grams; of families with one margin the first by
name wins, of languages with as many votes the surer; rows that repeat are predicted each, and alike; an
empty table gives an empty one; without rows to learn from all is ``und``; only ``doc_id``,
``text`` and, in fitting, ``lang`` are read, so columns of other names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import bounded_sample, map_arrow, small_batches, texts

DIM = 4096
#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi ur bn mr ne pa gu",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


@dataclass(frozen=True)
class LanguageModel:
    families: tuple[str, ...]
    members: tuple[tuple[str, ...], ...]
    family_w: np.ndarray  # DIM + 1 rows
    pairs: tuple[tuple[int, int, int], ...]  # family, member, member
    pair_w: np.ndarray


def vector(text: str) -> np.ndarray:
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_BLANK) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    blank = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    b = b[keep]
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(65_599) + b[2:]
    mix = [(v * np.uint32(2_654_435_761)) >> np.uint32(20) for v in (b + np.uint32(7), two + np.uint32(70_001), three + np.uint32(9_000_011))]
    counts = np.bincount(np.concatenate(mix), minlength=DIM).astype(np.float32)
    counts = np.sqrt(counts)
    return counts / max(1e-9, float(np.linalg.norm(counts)))


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200, settled: float = 1e-4) -> np.ndarray:
    """Linear machines with squared hinge loss, class-balanced, by accelerated gradient steps; bias last.

    ``y`` has one column a machine, of 1, -1 and 0 for rows that are not its own:
    all machines share the products with ``x``, which stays in single precision and is not copied.
    """
    up, down = np.maximum((y > 0).sum(0), 1), np.maximum((y < 0).sum(0), 1)
    w = np.where(y > 0, 0.5 / up, np.where(y < 0, 0.5 / down, 0)).astype(np.float32)
    y = y.astype(np.float32)
    beta = look = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    rate = np.float32(1 / (2 * 2.0 + ridge))
    for t in range(steps):
        pull = w * y * np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        slope = np.float32(ridge) * look - 2 * np.vstack([x.T @ pull, pull.sum(0, keepdims=True)])
        new = look - rate * slope
        look, beta = new + np.float32(t / (t + 3)) * (new - beta), new
        if np.abs(slope).max() < settled:
            break
    return beta


def fit(docs: DataFrame, learn: Column, rows: int = 700, most_rows: int = 8_000) -> LanguageModel:
    """Learn from at most about ``rows`` rows a language (``most_rows`` in all) for which ``learn`` holds."""
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    langs = max(1, own.select("lang").distinct().count())
    sample = bounded_sample(own, "doc_id", ["lang"], max(1, min(rows, most_rows // langs)))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = [(i, lang, t) for i, lang, t in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts(batch), strict=True) if _LETTER.search(t)]
        return pa.RecordBatch.from_arrays(
            [pa.array([str(k[0]) for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.string()), pa.array([vector(k[2]).astype(np.float16).tobytes() for k in keep], pa.binary())],
            names=["id", "lang", "x"],
        )

    got = map_arrow(sample, make, "id string, lang string, x binary").toArrow()
    lang = np.array(got.column("lang").to_pylist(), object)
    family = np.array([FAMILY_OF.get(c, c) for c in lang], object)
    # Rows of a family, and of a language in it, lie together, so that a family's rows are a slice.
    ids = got.column("id").to_pylist()
    order = sorted(range(len(lang)), key=lambda i: (family[i], lang[i], ids[i]))
    lang, family = lang[order], family[order]
    x, raw = np.empty((len(order), DIM), np.float32), got.column("x")
    for to, at in enumerate(order):
        x[to] = np.frombuffer(raw[at].as_buffer(), np.float16)
    families = tuple(dict.fromkeys(family))
    members = tuple(tuple(dict.fromkeys(lang[family == f])) for f in families)
    sign = lambda yes: np.where(yes, 1, -1)
    family_w = fit_svm(x, np.stack([sign(family == f) for f in families], 1)) if families else np.zeros((DIM + 1, 0), np.float32)
    pairs, pair_w = [], [np.zeros((DIM + 1, 0), np.float32)]
    for k, own_codes in enumerate(members):
        at = np.flatnonzero(family == families[k])
        here = list(combinations(range(len(own_codes)), 2))
        if here:
            part = lang[at[0] : at[-1] + 1]
            y = np.stack([np.where(part == own_codes[i], 1, np.where(part == own_codes[j], -1, 0)) for i, j in here], 1)
            pair_w.append(fit_svm(x[at[0] : at[-1] + 1], y))
            pairs += [(k, i, j) for i, j in here]
    return LanguageModel(families, members, family_w, tuple(pairs), np.hstack(pair_w))


def decide(model: LanguageModel, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores for rows of features."""
    if not model.families:
        return ["und"] * len(x), np.zeros(len(x))
    sure = lambda z: 1 / (1 + np.exp(-np.clip(4 * z, -30, 30)))
    z = x @ model.family_w[:-1] + model.family_w[-1]
    top = z.argmax(1)
    second = np.where(z.shape[1] > 1, np.partition(z, -2, axis=1)[:, -2] if z.shape[1] > 1 else 0, -1.0)
    score = sure((z[np.arange(len(x)), top] - second) / 2)
    zp = x @ model.pair_w[:-1] + model.pair_w[-1] if model.pairs else np.zeros((len(x), 0))
    out = []
    for r, k in enumerate(top):
        codes = model.members[k]
        votes = np.zeros(len(codes))
        for p, (f, i, j) in enumerate(model.pairs):
            if f == k:
                s = float(sure(zp[r, p]))
                votes[i] += (s > 0.5) + 1e-3 * s
                votes[j] += (s <= 0.5) + 1e-3 * (1 - s)
        best = int(votes.argmax())
        against = [float(sure(zp[r, p] if i == best else -zp[r, p])) for p, (f, i, j) in enumerate(model.pairs) if f == k and best in (i, j)]
        score[r] *= min(against, default=1.0)
        out.append(codes[best])
    return out, score


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; one narrow pass over whole texts."""
    small_batches(docs.sparkSession)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_texts = texts(batch)
        at = [i for i, t in enumerate(all_texts) if t and _LETTER.search(t)]
        names, scores = ["und"] * len(all_texts), np.zeros(len(all_texts))
        if at:
            found, sure = decide(model, np.array([vector(all_texts[i]) for i in at]))
            scores[at] = sure
            for i, code in zip(at, found, strict=True):
                names[i] = code
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, lang_pred string, score double")
