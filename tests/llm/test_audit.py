"""The filter audit against a loop over all orders."""

from __future__ import annotations

from collections import defaultdict
from itertools import permutations

import numpy as np

from tests.llm.brute import words
from verdance.llm import audit

DOCS = [
    (1, "a b c", "en"), (2, "a b c", "en"), (3, "a b c", None), (3, "a b c", ""), (4, None, "de"), (5, "", "de"), (6, " \t\n", None),
    (7, "AB CD " * 150, "en"), (8, "x# " * 300, "en"), (9, " ".join(f"w{i}" for i in range(250)), "fr"), (10, " ".join(f"w{i}" for i in range(250)), "fr"),
    (None, "a b c", "en"), (None, "unique $ text", "xx"), (11, "ÄÖÜ É " * 120, "de"), (12, "word " * 100_000, "de"), (11, "another of one id", "de"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (4, 1, 1), (7, 0, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (10, None, None)]


def by_hand(docs, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = defaultdict(list)
    for d, t, lang in docs:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > first[t]}
        rows[lang or ""].append(({f for f in fails if fails[f]}, d in good, d in toxic))
    out = {}
    for part, own in rows.items():
        taken = defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                out_now = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in own)
                taken[f] += len(out_now)
                out[part, "".join(order), i + 1] = [len(left), len(out_now), failing - len(out_now), sum(r[0] == {f} for r in own), sum(r[1] for r in out_now), sum(r[2] for r in out_now), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = taken[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def found(spark, docs, labels):
    df = audit.audit(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, digest string, `a.b` int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}, df


def test_audit_by_hand(spark):
    got, df = found(spark, [(*r, "clash", 1) for r in DOCS], LABELS)
    assert got == by_hand(DOCS, LABELS)
    assert dict(df.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")


def test_audit_without_documents_or_labels(spark):
    assert found(spark, [], LABELS)[0] == {}
    assert found(spark, [(*r, "clash", 1) for r in DOCS], [])[0] == by_hand(DOCS, [])


def test_tally_with_many_parts():
    rng = np.random.default_rng(3)
    n, parts = 5000, 700
    mask, good, toxic, part = rng.integers(0, 32, n), rng.random(n) < 0.3, rng.random(n) < 0.1, rng.integers(0, parts, n)
    got = audit.tallied(mask, good, toxic, part, parts)
    for k, (done, f) in enumerate(audit.PAIRS):
        alive, fail = mask & done == 0, mask >> f & 1 == 1
        for i, rows in enumerate((alive, alive & fail, ~alive & fail, alive & fail & good, alive & fail & toxic)):
            assert (got[:, k, i] == np.bincount(part[rows], minlength=parts)).all()
