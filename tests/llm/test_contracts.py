"""The ten queries on a folder of odd tables: names, types, rows, and scores worked out again by hand."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_llm import ODD
from verdance.llm import language, quality, queries, search, toxicity

COLUMNS = {
    "op1_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op2_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op3_licenses": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
    "op4_near": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op5_mixing": "doc_id:bigint tokens:bigint rate:double copies:bigint gap:double",
    "op6_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op7_pii": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op8_rules": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op9_search": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op10_language": "doc_id:bigint held_out:boolean lang_pred:string score:double",
}
BASE = {
    "op3_licenses": (("n_words", "n_base", "first_word", "last_word", "base_labels"), brute.licenses),
    "op7_pii": (("n_email", "n_ip", "n_card", "n_phone", "base_sha256"), lambda t: brute.pii(t)[:5]),
    "op8_rules": (("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), brute.rules),
}
HELD = {"op1_quality": (4, 2), "op6_toxicity": (5, 0), "op10_language": (3, 1)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of odd tables, and one of empty tables."""
    out = []
    for name, keep in (("odd", True), ("empty", False)):
        to = tmp_path_factory.mktemp(name)
        docs = spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
        labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (8, 1, 0), (9, 1, 0), (None, 1, 1), (77, None, 1)], "doc_id bigint, quality int, toxic int")
        rows = [(i, [0.1 * (i % 7), -0.5, 0.25]) for i in range(120)] + [(50, [1.0, 1.0, 1.0]), (None, [0.1]), (200, None), (201, [None]), (250, [float("nan")])]
        vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
        for n, df in (("documents", docs), ("labels", labels), ("embeddings", vectors)):
            (df if keep else df.limit(0)).write.parquet(f"{to}/{n}.parquet")
        out.append(str(to))
    return out


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, tables, name):
    query = getattr(queries, name)
    odd = query(spark, tables[0])
    types = dict(odd.dtypes)
    for column in COLUMNS[name].split():
        c, kind = column.split(":")
        assert types[c] == kind
    rows = odd.collect()
    assert query(spark, tables[1]).count() == 0
    if name == "op9_search":
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tables[0]}/embeddings.parquet/*.parquet'")
        assert sorted(tuple(r) for r in odd.select("query_id", "rank", "vec_id", "score").collect()) == sorted(con.execute(search.ORACLE).fetchall())
        return
    if name == "op2_packing":
        assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(d for d, *_ in ODD)
        return
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, *_ in ODD)
    assert len({tuple(r) for r in rows if r["doc_id"] == 8}) == 1
    if name in BASE:
        columns, by_hand = BASE[name]
        assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in rows) == Counter((d, *by_hand(t)) for d, t, *_ in ODD)
    if name == "op4_near":
        keyed = [r for r in ODD if r[0] is not None]
        want = brute.components([r[0] for r in keyed], [r[1] for r in keyed])
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
        assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    if name in HELD:
        mod, rest = HELD[name]
        for r in rows:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == rest)
            assert 0 <= r["score"] <= 1


def test_quality_scores_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    tools = quality.Compressors(model.good, model.bad, model.piece, model.level)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        parts = [raw[i : i + model.piece] for i in range(0, len(raw), model.piece)]
        g, b = (sum(len(c.compress(p)) for p in parts) for c in (tools.good, tools.bad))
        z = model.weights[0] + model.weights[1] * ((b - g) / (b + g) if raw else 0.0)
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_scores_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    every, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs, model = every.limit(200), toxicity.fit(every, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(every, model).collect()}
    words, t = toxicity.Words(model.words, model.stems), model.trees
    for r in docs.select("doc_id", "text").collect():
        x = toxicity.features(r["text"], words)
        raw = t.base
        for f, cut, value in zip(t.feature, t.threshold, t.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(f[node] >= 0 and x[f[node]] > cut[node])
            raw += value[node - len(f)]
        assert abs(got[r["doc_id"]] - np.interp(raw, *model.knots)) < 1e-9
        # The plain lexicon words are among the hits that are counted.
        low = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower().encode() for w in brute.words(r["text"])]
        assert sum(w in model.words for w in low) <= round(np.expm1(x[1]))
        assert x[15] == pytest.approx(np.log1p(len(low)) if low else 0.0)


def test_language_predictions_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert got[r["doc_id"]] == "und"
            continue
        x = language.vector(r["text"]).astype(float)
        k = int(np.argmax([float(x @ model.family_w[:-1, k] + model.family_w[-1, k]) for k in range(len(model.families))]))
        wins = Counter()
        for p, (f, i, j) in enumerate(model.pairs):
            if f == k:
                wins[i if x @ model.pair_w[:-1, p] + model.pair_w[-1, p] > 0 else j] += 1
        best = max(wins.values(), default=0)
        assert got[r["doc_id"]] in {model.members[k][i] for i in range(len(model.members[k])) if wins[i] == best}
