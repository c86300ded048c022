"""The registration ladder against a loop with a queue of moves."""

import math
import random
from collections import deque

import pytest

from verdance.operators import register

SCHEMA = "series long, k long, rms double, dx double, dy double, tone double, hist_rms double, spare string"


def ladder(images):
    """The ladder of one series by a loop."""
    moves, out = deque(maxlen=10), {}
    narrowest = lambda x, limits: next((t for t in limits if x is not None and x <= t), None)
    for _, k, rms, dx, dy, tone, hist, _ in sorted(images, key=lambda r: r[1]):
        hint = [sum(m[i] for m in moves) / len(moves) for i in (0, 1)] if len(moves) >= 3 else None
        left = math.hypot(dx - hint[0], dy - hint[1]) if hint and dx is not None and dy is not None else None
        alike = tone is not None and tone <= 30
        for name, x, limits in (("direct", rms, (2, 5, 10)), ("offset", left, (2, 5, 10)), ("relaxed", rms, (15,)) if alike else ("hist", hist, (2, 5, 10, 15))):
            if t := narrowest(x, limits):
                out[k] = (name, t, x, *(hint if name == "offset" else (None, None)))
                break
        else:
            out[k] = ("failed", None, None, None, None)
        if out[k][0] == "direct" and dx is not None and dy is not None:
            moves.append((dx, dy))
    return out


def series(rnd, s, n):
    # Residuals on the limits themselves, unknown values, and order keys with holes.
    value = lambda most: None if rnd.random() < 0.1 else rnd.choice([2.0, 5.0, 10.0, 15.0, rnd.random() * most])
    return [(s, k, value(25), value(30), value(30), rnd.choice([None, 30.0, rnd.random() * 60]), value(25), "x") for k in rnd.sample(range(4 * n), n)]


@pytest.mark.parametrize("block", [register.BLOCK, 23])
def test_ladder_equals_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(register, "BLOCK", block)
    rnd = random.Random(8)
    # One series holds most rows; one has too few direct moves for a hint; one is of a null key.
    images = series(rnd, 1, 1200) + series(rnd, 2, 150) + series(rnd, None, 40) + [(3, k, 20.0, 1.0, 1.0, 1.0, 1.0, "x") for k in range(5)] + [(4, None, 1.0, 1.0, 1.0, 1.0, 1.0, "x")]
    got = {(r.series, r.k): (r.method, r.limit, r.residual, r.dx, r.dy) for r in register.ladder(spark.createDataFrame(images, SCHEMA), "series", "k").collect()}
    want = {(s, k): v for s in (1, 2, 3, None) for k, v in ladder([r for r in images if r[0] == s]).items()}
    assert set(got) == set(want)
    for key, row in want.items():
        assert got[key][:2] == row[:2] and all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in zip(got[key][2:], row[2:], strict=True)), key
    assert {r[0] for r in want.values()} == {"direct", "offset", "relaxed", "hist", "failed"}
    assert register.ladder(spark.createDataFrame([], SCHEMA), "series", "k").count() == 0


def test_a_run_goes_on_from_its_log(spark, tmp_path):
    rnd = random.Random(9)
    images = series(rnd, 1, 80)
    first, path = [r for r in images if r[1] < 150], str(tmp_path / "log")
    one = {(r.k, r.method) for r in register.registered(spark.createDataFrame(first, SCHEMA), "series", "k", path).collect()}
    assert one == {(k, v[0]) for k, v in ladder(first).items() if v[0] != "failed"}
    both = {(r.k, r.method) for r in register.registered(spark.createDataFrame(images, SCHEMA), "series", "k", path).collect()}
    rest = ladder([r for r in images if r[1] not in {k for k, _ in one}])
    assert both == one | {(k, v[0]) for k, v in rest.items() if v[0] != "failed"}
