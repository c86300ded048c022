"""Values beside a row in groups of any size, and clock calibration against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from verdance.operators import calibrate, match, ordering


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_beside_equals_a_scan(spark, partitions):
    rnd = random.Random(4)
    # One group holds two thirds of all rows and so spans ranges; null groups, groups without values, ties of equal values.
    rows = [(rnd.choice([1, 1, 1, 1, 2, None]), rnd.randrange(400), None if rnd.random() < 0.7 else "v") for _ in range(3000)] + [(9, 1, None), (9, 2, None), (1, 100, None)]
    rows = [(g, t, v and f"{v}{t}") for g, t, v in rows]
    rows = sorted(set(rows), key=lambda r: (str(r[0]), r[1], r[2] or ""))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "g long, t long, v string").withColumn("side", F.col("v").isNull().cast("int"))
        got = sorted(((r.g, r.t, r.v, r._p, r._n) for r in ordering.beside(df, ["g"], ["t", "side"], "v").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2] is None))
        for i, (_, t, v) in enumerate(own):
            want.append((g, t, v, next((x[2] for x in reversed(own[:i]) if x[2]), None), next((x[2] for x in own[i + 1 :] if x[2]), None)))
    assert got == sorted(want, key=str)
    assert ordering.beside(df.limit(0), ["g"], ["t", "side"], "v").count() == 0


def test_as_of_with_one_group_in_many_ranges(spark):
    left = [(None if i % 50 == 0 else 1, (i * 37) % 5000, i) for i in range(1500)]
    right = [(1, (i * 61) % 6000, i * 1.0) for i in range(700)]
    a = spark.createDataFrame(left, "g long, t long, i long").select("g", F.timestamp_seconds("t").alias("t"), "i")
    b = spark.createDataFrame(right, "g long, t long, v double").select("g", F.timestamp_seconds("t").alias("t"), "v")
    got = {r.i: r.v_match for r in match.as_of(a, b, ["g"], "t", ["v"]).collect()}
    assert len(got) == len(left)
    for g, t, i in left:
        best = min(((abs(t - u), u, v) for h, u, v in right if h == g), default=None)
        assert got[i] == (best[2] if best else None)


def plain(photos, log, triggers, manual, span, coarse, fine_span, fine):
    """The same search with loops, for one flight."""
    fixes = sorted(log)

    def at(t):
        for (t0, *a), (t1, *b) in zip(fixes, fixes[1:] + [(math.inf, *fixes[-1][1:])]):
            if t == t0:
                return a
            if t0 < t < t1:
                return [p + (q - p) * ((t - t0) / (t1 - t0)) for p, q in zip(a, b)] if t1 - t0 <= 30_000_000 else None
        return None

    def score(o):
        shots = [(t + o, at(t + o)) for t in sorted(photos)]
        if len(triggers) >= 2:
            if sum(p is not None for _, p in shots) < 3:
                return None
            near = [(min(shots, key=lambda s: (abs(s[0] - t), s[0]))[1], x, y) for t, x, y in triggers]
            errors = [math.hypot(p[0] - x, p[1] - y) for p, x, y in near if p]
            return sum(errors) / len(errors) if errors else None
        flown = [p for _, p in shots if p and p[2] > fixes[0][3] + 50 and p[3] > 1.5]
        if sum(p is not None for _, p in shots) < 5 or len(flown) < 10:
            return 0.0
        v = [(p[3] + q[3]) / 2 for p, q in zip(flown, flown[1:])]
        d = [math.hypot(q[0] - p[0], q[1] - p[1]) for p, q in zip(flown, flown[1:])]
        mv, md = sum(v) / len(v), sum(d) / len(d)
        sv, sd = (math.sqrt(sum((x - m) ** 2 for x in z)) for z, m in ((v, mv), (d, md)))
        if min(sv, sd) / math.sqrt(len(v)) < 1e-6:
            return 0.0
        return -sum((x - mv) * (y - md) for x, y in zip(v, d)) / (sv * sd)

    best = round(manual * 1e6)
    for reach, step in ((span, coarse), (fine_span, fine)):
        n, w = round(reach / step), round(step * 1e6)
        tried = [(round(s, 9), best + i * w) for i in range(-n, n + 1) if (s := score(best + i * w)) is not None]
        if tried:
            best = min(tried)[1]
    return best


def flight(seed, anchors, photos=60):
    rnd = random.Random(seed)
    x, log = 0.0, []
    for i in range(300):
        speed = 0.5 if i < 8 else 6 + 4 * math.sin(i / 15) + rnd.random()
        x += speed * 0.5
        log.append((i * 500_000 if i < 200 else i * 500_000 + 40_000_000, x, rnd.random(), 30.0 if i < 8 else 100.0 + rnd.random(), speed))
    taken = sorted(rnd.randrange(5_000_000, 180_000_000) for _ in range(photos))
    place = {t: next((p + (q - p) * (t - a[0]) / (b[0] - a[0]) for a, b in zip(log, log[1:]) if a[0] <= t < b[0] for p, q in [(a[1], b[1])]), None) for t in taken}
    triggers = [(t, place[t], 0.5) for t in taken[:: max(1, photos // anchors)] if place[t] is not None][:anchors] if anchors else []
    return [t - 4_200_000 for t in taken], log, triggers


def test_calibration_equals_loops(spark):
    made = {1: flight(1, 12), 2: flight(2, 0), 3: flight(3, 1), 4: flight(4, 12, photos=2 * 12), 5: (flight(5, 0)[0], [], [(1, 0.0, 0.0), (2, 0.0, 0.0)]), 6: ([1, 2], flight(6, 0)[1], []), 7: (flight(7, 0)[0] * 2, flight(7, 0)[1], [])}
    frame = lambda k, schema: spark.createDataFrame([(f, *(r if isinstance(r, tuple) else (r,))) for f, m in made.items() for r in m[k]] + [(None, *([None] * (schema.count(",") + 1)))], "flight long, " + schema)
    photos, log, triggers = frame(0, "at long"), frame(1, "at long, x double, y double, alt double, speed double"), frame(2, "at long, x double, y double")
    got = {r.flight: r for r in calibrate.calibrated(photos, log, triggers, "flight", manual=3.0, span=6.0, coarse=0.5, fine_span=1.0, fine=0.1, limit=4.0).collect()}
    assert set(got) == set(made)
    for f in (1, 2, 3, 4, 7):
        want = plain(*made[f], 3.0, 6.0, 0.5, 1.0, 0.1) / 1e6
        far = len(made[f][2]) < 2 and abs(want - 3.0) > 4.0
        assert (got[f].offset, got[f].fell_back) == (pytest.approx(3.0 if far else want, abs=1e-9), far), f
    assert got[1].method == got[4].method == "anchors" and got[2].method == got[3].method == "speed"
    assert got[1].offset == pytest.approx(4.2, abs=0.11)  # the clock that was planted
    # No fix at all: triggers cannot be scored; too few photos: every offset has score 0, the first is too far away.
    assert (got[5].offset, got[5].score, got[5].method) == (3.0, None, "anchors")
    assert (got[6].offset, got[6].score, got[6].fell_back) == (3.0, 0.0, True)
    assert calibrate.calibrated(photos.limit(0), log, triggers, "flight", span=1.0, fine_span=0.1).count() == 0


def test_calibration_over_many_cells_equals_loops(spark, monkeypatch):
    """Cells shorter than a flight: pairs and triggers reach over cells, also over ones without photos, at times around 0 and far from it."""
    monkeypatch.setattr(calibrate, "WIDE", 1, raising=False)
    monkeypatch.setattr(calibrate, "ROWS", 200, raising=False)
    later = lambda f, by: ([t + by for t in f[0]], [(r[0] + by, *r[1:]) for r in f[1]], [(r[0] + by, *r[1:]) for r in f[2]])
    ends = flight(11, 12, 90)
    thin = lambda f: ([t for t in f[0] if t < 30_000_000 or t > 120_000_000], f[1], f[2])
    made = {1: later(flight(1, 12), 1_700_000_000_000_000), 2: later(flight(2, 0), -90_000_000), 3: thin(ends), 4: thin(later(flight(12, 0, 120), 500)), 5: ([t for t in ends[0] if t > 120_000_000], ends[1], ends[2])}
    frame = lambda k, schema: spark.createDataFrame([(f"f{f}", *(r if isinstance(r, tuple) else (r,))) for f, m in made.items() for r in m[k]], "flight string, " + schema)
    photos, log, triggers = frame(0, "at long"), frame(1, "at long, x double, y double, alt double, speed double"), frame(2, "at long, x double, y double")
    got = {r.flight: r for r in calibrate.calibrated(photos, log, triggers, "flight", manual=3.0, span=6.0, coarse=0.5, fine_span=1.0, fine=0.1, limit=90.0).collect()}
    assert {f: r.offset for f, r in got.items()} == {f"f{f}": pytest.approx(plain(*m, 3.0, 6.0, 0.5, 1.0, 0.1) / 1e6, abs=1e-9) for f, m in made.items()}


def test_calibration_writes_no_row_an_offset(spark, monkeypatch):
    """What is written is as long as the input and its copies at the ends of cells, for any number of offsets."""
    photos, log, triggers = flight(1, 12)
    frame = lambda rows, schema: spark.createDataFrame([(1, *(r if isinstance(r, tuple) else (r,))) for r in rows], "flight long, " + schema)
    seen = []
    for module, name in ((calibrate, "written"), (ordering, "checkpointed")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, real=real: seen.append((out := real(df)).count()) or out)
    calibrate.calibrated(frame(photos, "at long"), frame(log, "at long, x double, y double, alt double, speed double"), frame(triggers, "at long, x double, y double"), "flight", manual=3.0).collect()
    assert max(seen) <= 3 * (len(photos) + len(log) + len(triggers))
