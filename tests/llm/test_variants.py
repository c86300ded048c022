"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from verdance.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def counted(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def found(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def edited(rng, w):
    kind, i = rng.randrange(3), rng.randrange(len(w) + 1)
    c = rng.choice("abé")
    return w[:i] + c + w[i:] if kind == 0 else w[:i] + w[i + 1 :] if kind == 1 else w[:i] + c + w[i + 1 :]


def test_near_words_of_all_lengths(spark):
    rng = random.Random(5)
    words = set()
    for length in (7, 8, 9, 10, 13, 16, 31):
        for _ in range(12):
            w = "".join(rng.choice("abé") for _ in range(length))
            words |= {w, *(e for _ in range(8) if len(e := edited(rng, w)) >= 7)}
    # Every place of an edit in one word, and repeats of a letter.
    base = "abcdefghijk"
    words |= {base[:i] + base[i + 1 :] for i in range(11)} | {base[:i] + "z" + base[i:] for i in range(12)} | {base[:i] + "z" + base[i + 1 :] for i in range(11)} | {"a" * k for k in range(7, 14)}
    n = {w: rng.choice([1, 2, 20, 300, 4000, 50_000]) for w in words}
    df = variants.grouped(spark.createDataFrame(list(n.items()), "word string, n bigint"))
    assert found(df) == grouped(n)
    assert df.count() == len(n)


def test_chains_of_forms(spark):
    chain = {"a" * (7 + k): 10 ** (k + 1) for k in range(17)}
    assert found(variants.grouped(spark.createDataFrame(list(chain.items()), "word string, n bigint"))) == grouped(chain)


def test_texts(spark):
    rng = random.Random(2)
    stems = ["straße" + x for x in ("nbahn", "nbau", "nname")] + ["received", "recieved", "recieveds", "ACCOMMODATE", "acommodate", "naïveté", "naïvetés", "short", "kelvinK", "xy×ab÷cd", "ÀÉÎÕÜß" * 2]
    docs = [(i, " ".join(rng.choice(stems) for _ in range(rng.choice((3, 400))))) for i in range(150)]
    docs += [(None, "received received"), (7, None), (8, ""), (9, "1234567 ------- \n"), (10, "x" * 70_000 + " " + "x" * 70_000), (10, "x" * 70_001 + " " + "x" * 70_001), (11, "received " * 3000), (11, "received " * 3000)]
    df = variants.variants(spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id bigint, text string, word string, `a.b` int"))
    assert found(df) == grouped(counted(docs))
    assert dict(df.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    assert variants.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    n = counted(rows)
    assert {r["word"]: r["n"] for r in variants.word_counts(docs).collect()} == n
    few = {w: k for w, k in n.items() if zlib.crc32(w.encode()) % 2}
    assert found(variants.grouped(spark.createDataFrame(list(few.items()), "word string, n bigint").repartition(3, F.col("word")))) == grouped(few)
