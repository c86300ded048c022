"""Personal data by weak supervision (DataFrame functions only).

Candidates of a kind are all spans that look like it: what the base patterns
match, whether or not it passes the kind's own check, other ways of writing it
(disguised addresses, cards with other separators, national telephone numbers,
secrets behind a key word), and look-alikes (hosts without a dot, bare runs of
digits, bare tokens). Labelers that can disagree vote for, against or not at
all: the span's shape, the kind's own check, gazetteers (issuers, countries,
top-level domains, prefixes, placeholders), words in front of it, and the
characters around it.

Expectation maximisation over the counted vote patterns estimates how reliable
each labeler is for each kind, and a posterior for each pattern of votes; a
logistic span classifier is trained on the posteriors, with the votes by kind
and span features. Base spans (a base pattern that passes its check) stay;
another candidate is added where the classifier gives ``least`` or more. So of two hits of
one pattern one may be added and the other rejected.

What reaches the driver are counts by (kind, votes, features), whose number is
bounded by the model and not by the corpus. Texts are scanned once: the found
candidates are written and both passes read them. Patterns are possessive and
anchored, so they are linear on long texts.

Edge cases: null and empty texts have no spans; a very long text is one row, and
its work grows with its length times the square root of its number of matches;
spans at one start are listed by kind; rows that repeat are found each; an empty
table gives an empty one and a model without evidence; columns of other names do not
matter, since only the keys and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import materialise

#: In the order in which spans at one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
LABELERS = ("shape", "check", "gazetteer", "context", "edges")
#: Base patterns: possessive forms that match what the plain ones do. A match is a base span if it passes its check.
STRICT = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Other ways of writing a kind, and look-alikes. Values are of any length; dots at the end of a secret are the sentence's.
LOOSE = {
    EMAIL: r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++(?: ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]++(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z0-9-]++)++|@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-]))",
    IP: r"(?<![0-9.])[0-9]{1,3}+(?: ?[\[({](?:\.|dot)[\])}] ?[0-9]{1,3}+){3}(?![0-9])",
    CARD: r"(?<![0-9])(?<![0-9][\x20._/-])(?:[0-9]{4}(?:[._/]|[\x20-]{2})[0-9]{4}(?:[._/]|[\x20-]{2})[0-9]{4}(?:[._/]|[\x20-]{2})[0-9]{1,7}+|[0-9]{20,}+)(?![\x20-]?[0-9])",
    PHONE: r"(?<![0-9+(.-])(?<![0-9+][\x20-])(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{0,2}[ -][0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{2,4}|[0-9]{9,11}+)(?![0-9])(?![.\x20-][0-9])",
    SECRET: r"(?i)(?<![a-z0-9_])(?:password|passwd|pwd|secret|api_?key|token)\s{0,2}[=:]\s{0,2}[\"']?(?=[a-z0-9_/+=~.-]{7}\.*+[a-z0-9_/+=~-])[a-z0-9_/+=~-]*+(?:\.++[a-z0-9_/+=~-]++)*+[\"']?|(?<![a-z0-9_/+=.@-])[a-z0-9_+-]{24,}+={0,2}+(?![a-z0-9_/+=@-]|\.[a-z0-9])",
}
#: What must be in a text for a base pattern to match at all.
NEEDS = {EMAIL: "@", PHONE: "+"}
#: Words that announce a kind, and words that announce something else that looks like it.
CONTEXT = {
    EMAIL: "e-?mail|mail|contact|write|correo|courriel|adresse|from|to",
    IP: "ip|host|server|address|login|client|adresse",
    CARD: "card|visa|mastercard|credit|tarjeta|carte|karte|pay",
    PHONE: "phone|tel|call|mobile|fax|cell|telefon|t.l.phone|whatsapp",
    SECRET: "login|key|secret|credentials|config|bearer",
}
COUNTER = {
    EMAIL: "user|handle|follow|git",
    IP: "version|release|section|chapter|build|v",
    CARD: "order|invoice|serial|tracking|isbn|item|reference",
    PHONE: "order|invoice|serial|tracking|isbn|item|reference|id|total|page",
    SECRET: "sha|md5|commit|checksum|hash|digest|uuid|file|url",
}
TOP_LEVEL = "com|org|net|edu|gov|io|de|fr|es|uk|eu|us|info|biz|co|ch|at|it|nl|mx|ar|example"
#: First digits and lengths of card issuers.
ISSUERS = r"^(?:3[47][0-9]{13}|4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|6(?:011|5[0-9]{2}|4[4-9][0-9]|2[0-9]{2})[0-9]{12})$"
#: Steps of the two span features.
SIZES, DIGITS = 4, 4


@dataclass(frozen=True)
class PiiModel:
    reliability: dict  # kind -> labeler -> (P(+1 | span), P(-1 | span), P(+1 | none), P(-1 | none))
    weights: tuple[float, ...]
    least: float


def _located(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start,end,m>> of a pattern's matches, in code points.

    Starts are prefix sums of the pieces between matches; they are summed in two
    levels, so that a text with many matches costs m * sqrt(m) and not m * m.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        found = F.when(F.instr(text, needs) > 0, found).otherwise(F.array().cast("array<string>"))
    return found


def _starts(text: Column, found: Column, pattern: str) -> Column:
    pieces = F.split(text, pattern, -1)
    steps = F.transform(found, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"), m.alias("m")))
    return F.when(F.size(found) > 0, steps).otherwise(F.array().cast("array<struct<gap:int,len:int,m:string>>"))


def _sum(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x.gap + x.len)


def _placed(steps: Column) -> Column:
    width = F.greatest(F.ceil(F.sqrt(F.size(steps))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / width).cast("int")), lambda b: F.struct(b.alias("b"), _sum(F.slice(steps, b * width + 1, width)).alias("sum")))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["sum"])))
    # One struct holds the block sums so that they are worked out once for a text.
    held = F.transform(F.array(before), lambda p: F.transform(steps, lambda x, i: F.struct((F.get(p, F.floor(i / width).cast("int")) + _sum(F.slice(steps, F.floor(i / width).cast("int") * width + 1, i % width)) + x.gap).alias("start"), x.len.alias("len"), x.m.alias("m"))))
    return F.when(F.size(steps) > 0, F.get(held, F.lit(0))).otherwise(F.array().cast("array<struct<start:int,len:int,m:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(m: Column) -> Column:
    """Four numbers of at most 255; zeros in front do not count."""
    short = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.concat(F.lit("0"), F.substring(short(p), 1, 3)).cast("int") <= 255))


def _check(kind: int, m: Column) -> Column:
    """The kind's own check, as the base rule has it."""
    if kind == IP:
        return _octets(m)
    if kind == CARD:
        return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))
    if kind == PHONE:
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v.when(no, -1) if no is not None else v).otherwise(0)


def _secret_value(m: Column) -> Column:
    return F.regexp_replace(m, r"(?i)^[a-z_]+\s{0,2}[=:]\s{0,2}|[\"']", "")


def _shape(kind: int, m: Column) -> Column:
    """How it is written: as most spans of the kind are, or as few are."""
    if kind == EMAIL:
        return _vote(m.rlike(r"^[A-Za-z0-9][^@]*@[^@]*\.[A-Za-z]{2,}$"), ~m.rlike(r"\.|[\])}]") | m.rlike(r"\.\.|^\.|\.@|@-|\.[0-9]+$"))
    if kind == IP:
        return _vote(m.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"), m.rlike(r"[0-9]{4}|(^|[^0-9])0[0-9]"))
    if kind == CARD:
        return _vote(m.rlike(r"^([0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\3[0-9]{5})$"), m.rlike(r"[0-9]{17}|[\x20-]{2}|^[0-9]{1,3}[\x20-]"))
    if kind == PHONE:
        few = F.length(_digits(m)) < 7
        return _vote(~few & m.rlike(r"^(\+|00)[0-9]{1,3}[\x20.-]|^\([0-9]{3}\)|^[0-9]{3}([.-])[0-9]{3}\2[0-9]{4}$"), few | m.rlike(r"^[0-9]+$|[.-]{2}|\([0-9]*$"))
    return _vote(m.rlike(r"[=:]\s{0,2}[\"']"), ~m.rlike(r"(?i)^(password|passwd|pwd|secret|api_?key|token)\s{0,2}[=:]"))


def _own_check(kind: int, m: Column) -> Column:
    """The vote of the kind's own check, also for what has no base pattern."""
    if kind == EMAIL:
        return _vote(m.rlike(r"@[^@]*\.|[\])}][^\[({]*[\[({] ?dot"), ~m.rlike(r"\.[A-Za-z0-9-]+$|dot"))
    if kind == IP:
        plain = F.regexp_replace(m, r"(?: ?[\[({](?:\.|dot)[\])}] ?)", ".")
        return _vote(_octets(plain), ~_octets(plain))
    if kind in (CARD, PHONE):
        return _vote(_check(kind, m), ~_check(kind, m))
    value = _secret_value(m)
    rich = value.rlike("[0-9]") & value.rlike("(?i)[a-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    return _vote(rich, ~rich)


def _gazetteer(kind: int, m: Column) -> Column:
    if kind == EMAIL:
        return _vote(m.rlike(rf"(?i)(\.|dot[\])}} ]+)({TOP_LEVEL})$"), m.rlike(r"\.[0-9-]+$") | ~m.rlike(r"\.|dot"))
    if kind == IP:
        return _vote(~m.rlike(r"^(0|10|127|255|192\.168|2[4-5][0-9])[.\[({ ]"), m.rlike(r"^0"))
    if kind == CARD:
        return _vote(_digits(m).rlike(ISSUERS), ~_digits(m).rlike(ISSUERS))
    if kind == PHONE:
        return _vote(m.rlike(r"^(?:\+|00)(1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])") | m.rlike(r"^\(?[2-9][0-9]{2}[^0-9]"), m.rlike(r"^\(?[01][0-9]{2}[^0-9]|^0[1-9]?$"))
    value = _secret_value(m)
    return _vote(value.rlike(r"^(ghp_|gho_|sk-|xox[abp]-|AKIA|eyJ)|^[0-9a-f]{32}$|^[0-9a-f]{40}$|^[0-9a-f]{64}$"), value.rlike(r"(?i)example|change.?me|placeholder|your|dummy|^(.)\1+$|^(true|false|null|none)"))


def _judged(found: Column, kind: int, strict: bool) -> Column:
    """Votes and features of the matches ``found`` in ``_t``."""

    def made(x: Column) -> Column:
        before = F.lower(F.substring(F.col("_t"), F.greatest(x.start - 24, F.lit(0)) + 1, F.least(x.start, F.lit(24))))
        after = F.substring(F.col("_t"), x.start + x.len + 1, F.lit(2))
        size, n_digits = F.length(x.m), F.length(_digits(x.m))
        joined = before.rlike(r"[a-z0-9_@/.-]$") | after.rlike(r"^[A-Za-z0-9_@/]|^[.-][0-9A-Za-z]")
        words = lambda w: before.rlike(rf"(?<![a-z])({w})[^a-z]{{0,4}}( [a-z]{{1,6}}[^a-z]{{0,3}})?$")
        return F.struct(
            F.lit(kind).alias("kind"),
            x.start.alias("start"),
            (x.start + x.len).alias("end"),
            (_check(kind, x.m) if strict else F.lit(False)).alias("base"),
            _shape(kind, x.m).alias("shape"),
            _own_check(kind, x.m).alias("check"),
            _gazetteer(kind, x.m).alias("gazetteer"),
            _vote(words(CONTEXT[kind]), words(COUNTER[kind])).alias("context"),
            _vote(~joined, joined).alias("edges"),
            F.when(size < 10, 0).when(size < 16, 1).when(size < 28, 2).otherwise(3).alias("size"),
            F.floor(n_digits * 3 / size).cast("int").alias("digits"),
        )

    return F.transform(found, made)


def candidates(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and spans: array<struct<kind,start,end,base,votes...,size,digits>> of every row; a narrow pass."""
    step = docs.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    plans = [(k, p, True, NEEDS.get(k)) for k, p in STRICT.items()] + [(k, p, False, None) for k, p in LOOSE.items()]
    for j, (_, pattern, _, needs) in enumerate(plans):
        step = step.withColumn(f"_m{j}", _located(F.col("_t"), pattern, needs))
    for j, (_, pattern, _, _) in enumerate(plans):
        step = step.withColumn(f"_m{j}", _starts(F.col("_t"), F.col(f"_m{j}"), pattern))
    for j in range(len(plans)):
        step = step.withColumn(f"_m{j}", _placed(F.col(f"_m{j}")))
    parts = [_judged(F.col(f"_m{j}"), kind, strict) for j, (kind, _, strict, _) in enumerate(plans)]
    return step.select(*keys, F.concat(*parts).alias("spans"))


#: What is believed of a labeler before any votes, in counts: of spans and of others, for (+1, -1, 0). A span seldom fails the
#: check of its own kind, while many others pass it; so on small tables, too, a failed check outweighs a good shape.
PRIOR = ((3.0, 1.0, 2.0), (1.0, 3.0, 2.0))
CHECK_PRIOR = ((40.0, 0.2, 6.0), (6.0, 12.0, 4.0))
#: Where the posterior starts: half, and so much for each vote, and less for a failed check.
VOTE, FAILED = 0.15, 0.5


def fit(found: DataFrame, least: float = 0.9, rounds: int = 40) -> PiiModel:
    """EM over counted vote patterns, then the span classifier."""
    columns = ["kind", *LABELERS, "size", "digits"]
    rows = found.select(F.explode("spans").alias("s")).select(*(f"s.{c}" for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.array([r["n"] for r in rows], float)
    votes = np.array([[r[c] for c in LABELERS] for r in rows], int).reshape(len(rows), len(LABELERS))
    kinds = np.array([r["kind"] for r in rows], int)
    reliability: dict = {}
    post = np.zeros(len(rows))
    for kind in sorted(set(kinds.tolist())):
        at = np.flatnonzero(kinds == kind)
        post[at], table = _em(votes[at], n[at], rounds)
        reliability[KINDS[kind]] = dict(zip(LABELERS, table, strict=True))
    x = _design(kinds, votes, np.array([r["size"] for r in rows], int), np.array([r["digits"] for r in rows], int))
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (n * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ x + np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (n * (post - q)) - beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return PiiModel(reliability, tuple(float(b) for b in beta), least)


def _em(votes: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, list[tuple[float, ...]]]:
    """Posterior of each vote pattern and each labeler's reliabilities, from a majority vote on in which a failed check counts most."""
    failed = votes[:, LABELERS.index("check")] < 0
    p = np.clip(0.5 + VOTE * votes.sum(1) - FAILED * failed, 0.05, 0.95)
    table: list[tuple[float, ...]] = []
    for _ in range(rounds):
        table, log_odds = [], np.full(len(n), np.log((p @ n + 2) / ((1 - p) @ n + 2)))
        for name, v in zip(LABELERS, votes.T, strict=True):
            chance = []
            for q, (yes, no, none) in zip((p, 1 - p), CHECK_PRIOR if name == "check" else PRIOR, strict=True):
                total = q @ n + yes + no + none
                chance.append((((q * (v == 1)) @ n + yes) / total, ((q * (v == -1)) @ n + no) / total))
            pick = lambda c: np.where(v == 1, c[0], np.where(v == -1, c[1], 1 - c[0] - c[1]))  # noqa: E731, B023
            log_odds = log_odds + np.log(pick(chance[0]) / pick(chance[1]))
            table.append(tuple(float(c) for pair in chance for c in pair))
        p = 1 / (1 + np.exp(-np.clip(log_odds, -20, 20)))
    return p, table


def _design(kinds: np.ndarray, votes: np.ndarray, size: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """One column for each cell that ``_cells`` names."""
    x = np.zeros((len(kinds), len(KINDS) * (len(LABELERS) * 3 + 1) + SIZES + DIGITS))
    row = np.arange(len(kinds))
    wide = len(LABELERS) * 3 + 1
    x[row, kinds * wide] = 1
    for j in range(len(LABELERS)):
        x[row, kinds * wide + 1 + 3 * j + votes[:, j] + 1] = 1
    x[row, len(KINDS) * wide + size] = 1
    x[row, len(KINDS) * wide + SIZES + digits] = 1
    return x


def _probability(model: PiiModel, s: Column) -> Column:
    """The classifier's chance: the weights of the cells of a span, by position as in ``_design``."""
    weights, wide = F.array(*(F.lit(w) for w in model.weights)), len(LABELERS) * 3 + 1
    z = F.get(weights, s["kind"] * wide)
    for j, name in enumerate(LABELERS):
        z = z + F.get(weights, s["kind"] * wide + (1 + 3 * j + 1) + s[name])
    z = z + F.get(weights, s["size"] + len(KINDS) * wide) + F.get(weights, s["digits"] + len(KINDS) * wide + SIZES)
    return 1.0 / (1.0 + F.exp(-z))


def _touches(s: Column) -> Column:
    """Whether a span meets one of ``_base`` of its kind; whole blocks of base spans are passed over by their ends."""
    near = F.filter("_blocks", lambda b: (b.low < s.end) & (s.start < b.high))
    inside = lambda b: F.exists(F.slice("base", b.at + 1, F.col("_width")), lambda x: (x.kind == s.kind) & (x.start < s.end) & (s.start < x.end))
    return F.exists(near, inside)


def decide(found: DataFrame, model: PiiModel) -> DataFrame:
    """``found`` with base and all: sorted array<struct<start,kind,end>>; added spans never touch a base span of their kind."""
    bare = lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))
    step = found.withColumn("base", F.sort_array(F.transform(F.filter("spans", lambda s: s.base), bare)))
    step = step.withColumn("_more", F.filter("spans", lambda s: ~s.base & (_probability(model, s) >= model.least)))
    step = step.withColumn("_width", F.greatest(F.ceil(F.sqrt(F.size("base"))).cast("int"), F.lit(1)))
    starts = F.filter(F.sequence(F.lit(0), F.size("base"), F.col("_width")), lambda i: i < F.size("base"))

    def block(i: Column) -> Column:
        own = F.slice("base", i + 1, F.col("_width"))
        return F.struct(i.alias("at"), F.get(own, F.lit(0)).start.alias("low"), F.array_max(F.transform(own, lambda x: x.end)).alias("high"))

    step = step.withColumn("_blocks", F.when(F.size("_more") > 0, F.transform(starts, block)))
    clear = F.transform(F.filter("_more", lambda s: ~_touches(s)), bare)
    step = step.withColumn("all", F.when(F.size("_more") == 0, F.col("base")).otherwise(F.array_sort(F.array_distinct(F.concat("base", clear)))))
    return step.drop("_more", "_width", "_blocks", "spans")


def find(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), least: float = 0.9) -> tuple[DataFrame, PiiModel]:
    """Spans of every row, and the model behind them."""
    found = materialise(candidates(docs, keys), "pii")
    model = fit(found, least)
    return decide(found, model), model


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that meet become one."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def one(a: Column, s: Column) -> Column:
        tail = F.concat(a.out, F.substring(text, a["at"] + 1, s.start - a["at"]), F.get(names, s.kind))
        return F.when(s.start >= a["at"], F.struct(tail.alias("out"), s.end.alias("at"))).otherwise(F.struct(a.out.alias("out"), F.greatest(a["at"], s.end).alias("at")))

    whole = F.aggregate(spans, start, one, lambda a: F.concat(a.out, F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
