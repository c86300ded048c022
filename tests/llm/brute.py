"""Plain Python forms of the contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rules(text):
    w, t = words(text), text or ""
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    at = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(at), n < 50 or 100 * len(at) > 50 * n


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def _luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    t, digits = text or "", lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    spans, counts = [], []
    for k, (kind, p, ok) in enumerate(kinds):
        own = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if ok(m[0])]
        counts.append(len(own))
        spans += own
    listed = ",".join(s[2] for s in sorted(spans))
    return (*counts, hashlib.sha256(listed.encode()).hexdigest(), listed)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def components(ids, texts):
    """doc_id -> (n_shingles, smallest reachable id), from all pairs."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    up[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: (len(sets[i]), least[top(i)]) for i, d in enumerate(ids)}


def planted_spans(n=1500, seed=5):
    """(texts, spans): spans are (kind, start, end, is personal data), look-alikes among them."""
    rnd = random.Random(seed)
    w = "the and of to in on for with all some near river stone green walk door light seven paper lamp".split()
    prose = lambda k: " ".join(rnd.choice(w) for _ in range(k))
    num = lambda a, b: str(rnd.randrange(a, b))
    hexed = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    name = lambda: rnd.choice(["ann", "bob", "kim", "lee"]) + num(1, 999)
    ip = lambda: ".".join([num(11, 99), num(1, 255), num(1, 255), num(1, 255)])
    local = lambda: f"({num(201, 989)}) {num(201, 989)}-{num(1000, 9999)}"
    dotted = lambda d: ".".join((d[:4], d[4:8], d[8:12], d[12:]))

    def card(good):
        while True:
            d = ("4" if good else rnd.choice("018793")) + "".join(rnd.choice("0123456789") for _ in range(15))
            if _luhn(d) == good:
                return d

    made = {
        "email": [
            (True, lambda: ("write to ", f"{name()}@mail{num(1, 9)}.example.com")),
            (True, lambda: ("contact ", f"{name()} [at] host{num(1, 9)} [dot] org")),
            (False, lambda: ("user ", f"{name()}@host{num(1, 99)}")),
        ],
        "ip": [
            (True, lambda: ("server ", ip())),
            (True, lambda: ("host ", ip().replace(".", "[.]"))),
            (False, lambda: ("version ", f"{num(1, 9)}.{num(300, 999)}.{num(256, 999)}.{num(300, 4000)}")),
        ],
        "card": [
            (True, lambda: ("visa ", card(True))),
            (True, lambda: ("card ", dotted(card(True)))),
            (False, lambda: ("order ", card(False))),
            (False, lambda: ("serial ", num(10**21, 10**22))),
            (False, lambda: ("item ", dotted(card(False)))),
        ],
        "phone": [
            (True, lambda: ("call ", "+1 " + local())),
            (True, lambda: ("phone ", local())),
            (True, lambda: ("tel ", f"{num(201, 989)}-{num(201, 989)}-{num(1000, 9999)}")),
            (False, lambda: ("order ", num(10**8, 10**10))),
            (False, lambda: ("total ", f"{num(100, 199)} {num(100, 199)} {num(1000, 9999)}")),
            (False, lambda: ("page ", "+" + num(10, 99) + "-" + num(1, 9))),
        ],
        "secret": [
            (True, lambda: ("config ", f'token = "{hexed(40)}"')),
            (True, lambda: ("bearer ", f"sk-{hexed(30)}")),
            (False, lambda: ("file ", "_".join(rnd.choice(w) for _ in range(8)))),
            (False, lambda: ("the ", "password: changeme-example")),
        ],
    }
    texts, spans = [], []
    for _ in range(n):
        text, own = prose(rnd.randrange(5, 40)), []
        for _ in range(rnd.randrange(0, 3)):
            kind = rnd.choice(list(made))
            good, form = rnd.choice(made[kind])
            before, value = form()
            text += " " + (before if rnd.random() < 0.7 else "")
            own.append((kind, len(text), len(text) + len(value), good))
            text += value + rnd.choice([" ", ", ", ". "]) + prose(rnd.randrange(3, 12))
        texts.append(text)
        spans.append(own)
    return texts, spans


def license_scan(text, licenses):
    """(n_words, n_base, base_labels, labels, score) by plain diagonals."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base, labels, n_base, score = set(), set(), 0, 0.0
    for t in licenses.TEMPLATES:
        n, k = len(t.words), licenses.K
        lines: dict = {}
        for pos in range(len(w) - k + 1):
            for at in range(n - k + 1):
                if tuple(w[pos : pos + k]) == t.words[at : at + k]:
                    lines.setdefault(pos - at, set()).add(at)
        if t.base:
            places = [d for d, ats in lines.items() if len(ats) == n - k + 1]
            n_base += len(places)
            if places:
                base.add(t.label)
                labels.add(t.label)
                score = 1.0
            continue
        best = 0.0
        for d in lines:
            run = [e for e in lines if d <= e <= d + 3]
            words = {at + j for e in run for at in lines[e] for j in range(k)}
            best = max(best, len(words) / (n + max(run) - d))
        score = max(score, best)
        if best >= (1.0 if n < 20 else 0.75):
            labels.add(t.label)
    return len(w), n_base, ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def posterior(text, model, mixing):
    """(tokens, p) of the mixing model, from the text's words."""
    w = words(text)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    found = {signed(xxhash.xxh64_intdigest(x[-mixing.ENDING :].encode(), seed=42)) % model.buckets for x in w}
    share = int(mixing.REPEATS * len(set(w)) / max(1, len(w)))
    cells = sorted(found) + [share + model.buckets]
    units = np.round(model.table * mixing.UNIT)
    z = np.array(model.prior) + units[cells].sum(0) / mixing.UNIT * 0.5 / len(cells) ** 0.5
    e = np.exp(z - z.max())
    return len(w), e / e.sum()


def rule_verdicts(m, rules):
    """doc_id -> kept, from exact quantiles of every group and its parents."""
    words_ = m["n_words"].clip(lower=1)
    value = {
        "symbols_a_word": m["n_symbols"] / words_,
        "repeated_share": m["n_repeat_words"] / words_,
        "duplicate_lines_share": m["n_dup_lines"] / m["n_lines"].clip(lower=1),
        "word_length": m["word_chars"] / words_,
        "word_length_low": m["word_chars"] / words_,
    }
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    out = failed.copy()
    fine = m[~failed]
    for r in rules:
        v = value[r.name]
        for depth in (2, 1, 0):
            if r.spoken and not depth:
                continue
            keys = [m[c].fillna("\0") for c in ("lang", "source")[:depth]]
            group = keys[0] + "|" + keys[1] if depth == 2 else keys[0] if depth else m["doc_id"] * 0
            for g in set(group):
                here, learned = group == g, v[fine.index][group[fine.index] == g]
                if not len(learned):
                    continue
                low, mid, high = np.quantile(learned, [0.25, 0.5, 0.75], method="inverted_cdf")
                spread = max(min(mid - low, high - mid), r.floor)
                fence = mid - r.times * spread if r.low else mid + r.times * spread
                out |= here & ((v < fence) if r.low else (v > fence)) & (m["n_words"] >= 50)
    return dict(zip(m["doc_id"], ~out, strict=True))
