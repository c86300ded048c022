"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on pieces of good and one on pieces
of bad labelled text. A text is cut into pieces of ``piece`` bytes, each is
compressed with either dictionary, and the normalised difference of the summed
sizes goes through a logistic calibration fitted on labelled rows that the
dictionaries have not seen.

Every piece of a whole text counts for its score, so the cost is
linear and the score does not depend on where in the text something stands. The
model (two dictionaries, two numbers) is fitted on at most about ``rows``
labelled rows a class and has a size fixed by ``dict_bytes``.

Edge cases: null and empty texts get the calibrated score at difference zero; a
very long text is cut into more pieces; of several labels of one id the larger
counts; rows that repeat are scored each, and alike; an empty table gives an empty one; without
labels of both classes the score is the smoothed share of good labels; only ``doc_id`` and
``text`` are read, so columns of other names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import class_counts, labelled_sample, map_arrow, small_batches, texts


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float]
    piece: int
    level: int


class Compressors:
    """A pair of compressors, made once in each Python worker."""

    def __init__(self, good: bytes, bad: bytes, piece: int, level: int):
        def one(raw: bytes):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.good, self.bad, self.piece = one(good), one(bad), piece

    def difference(self, text: str | None) -> float:
        """Normalised difference of the compressed sizes: positive where the good dictionary fits better."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        g = b = 0
        for i in range(0, len(raw), self.piece):
            part = raw[i : i + self.piece]
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
        return (b - g) / (b + g)


def _spread_pieces(text: str | None, piece: int, most: int) -> list[bytes]:
    """At most ``most`` pieces, evenly spread over the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // piece))
    at = sorted({i * n // min(n, most) for i in range(min(n, most))})
    return [raw[i * piece : (i + 1) * piece] for i in at if raw]


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary of segments of 200 bytes; the raw pieces where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, pieces, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:size] or b" " * 8


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression with intercept first, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 1500, piece: int = 512, train_bytes: int = 3 << 19, dict_bytes: int = 1 << 18, level: int = 3) -> QualityModel:
    """Learn from at most about ``rows`` rows of each class for which ``learn`` holds.

    Half of the rows (by a hash of the id) train the dictionaries; the others
    the calibration, which is weighted back to the classes' true shares. A class
    trains its dictionary on about ``train_bytes``, of which each of its rows
    gives an equal share in pieces spread evenly over its whole text: a long text must not
    fill a dictionary with its own repetitions. That sample is what is collected.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", learn, rows)
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(2)).alias("half")

    counts = class_counts(labels, "quality", learn)
    share_of = {c: max(1, int(2 * train_bytes / piece / max(1, min(rows, counts.get(c, 0))))) for c in (0, 1)}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [_spread_pieces(t, piece, share_of[c]) for c, t in zip(batch.column("label").to_pylist(), texts(batch), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(got, pa.list_(pa.binary()))], names=["label", "pieces"])

    bags: dict[int, list[bytes]] = {0: [], 1: []}
    kept = sample.select("doc_id", "text", "label", half)
    for r in map_arrow(kept.filter("half = 0").orderBy("doc_id"), cut, "label int, pieces array<binary>").collect():
        bags[r["label"]] += [bytes(p) for p in r["pieces"]]
    good, bad = _dictionary(bags[1], dict_bytes), _dictionary(bags[0], dict_bytes)
    raw = QualityModel(good, bad, (0.0, 0.0), piece, level)
    got = _measure(kept.filter("half = 1"), raw, "label int").orderBy("doc_id").collect()
    y = np.array([r["label"] for r in got], float)
    if not len(y) or len(set(y)) < 2:
        share = min(max((counts.get(1, 0) + 1) / (sum(counts.values()) + 2), 0.01), 0.99)
        return QualityModel(good, bad, (float(np.log(share / (1 - share))), 0.0), piece, level)
    x = np.array([[r["diff"]] for r in got])
    total = sum(counts.values())
    w = np.where(y == 1, counts[1] / total / max(1, (y == 1).sum()), counts[0] / total / max(1, (y == 0).sum())) * len(y)
    return QualityModel(good, bad, tuple(float(v) for v in logistic(x, y, w)), piece, level)


_OPEN: dict[tuple, Compressors] = {}


def _measure(docs: DataFrame, model: QualityModel, more: str = "") -> DataFrame:
    """(doc_id, more columns, diff)."""
    key = (model.good, model.bad, model.piece, model.level)
    names = [c.split()[0] for c in more.split(",") if c]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Compressors(*key)
        got = pa.array([_OPEN[key].difference(t) for t in texts(batch)], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in names), got], names=["doc_id", *names, "diff"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text", *names), make, f"doc_id {kind}, {more + ', ' if more else ''}diff double")


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, diff, score) of every row; one narrow pass over whole texts."""
    small_batches(docs.sparkSession)
    b0, b1 = model.weights
    z = F.lit(b0) + F.lit(b1) * F.col("diff")
    return _measure(docs, model).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
