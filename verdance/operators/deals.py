"""Random numbers and permutations by arithmetic, so that runs, engines and executors agree.

``mixed`` is a hash of two whole numbers; ``place`` a keyed permutation of the numbers below n:
a Feistel network over two digits, of which each round turns one by a hash of the other. Where it leaves
the numbers below n it is applied again, until it is back (cycle walking).
"""

from __future__ import annotations

from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus and multipliers of the hash; products of 2^31 and of numbers up to 2^40 stay in 64 bits.
MODULUS, FIRST, SECOND, LAST = 2_147_483_647, 2_654_435, 40_503, 48_271
#: Rounds of the network, and how often it is applied again at most: of numbers up to 100 any walk is shorter,
#: beyond it fewer than one in the square root of n is outside each time.
NETWORK, WALKS = 6, 10
#: Chances of a Poisson count with mean 1 to be at most 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402)


def mixed(v: Column, key: Column) -> Column:
    """A whole number from 0 up to MODULUS by a hash of ``v`` and ``key``, neither of them negative."""
    m = (v.cast("long") * FIRST + key.cast("long") * SECOND + 12_345) % MODULUS
    return (m.bitwiseXOR(F.shiftright(m, 15)) * LAST) % MODULUS


def mixed_sql(v: str, key: str) -> str:
    m = f"((({v}) * {FIRST} + ({key}) * {SECOND} + 12345) % {MODULUS})"
    return f"((xor({m}, {m} >> 15) * {LAST}) % {MODULUS})"


def digits(n: int) -> tuple[int, int]:
    """Sizes of the two digits: the smallest square-like box that holds n numbers."""
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    return a, max(1, ceil(n / a))


def place(i: Column, n: int, key: Column) -> Column:
    """Where the permutation with ``key`` puts number ``i`` of those below ``n``."""
    a, b = digits(n)

    def turned(s: Column, t: Column) -> Column:
        left, right, k = s["l"], s["r"], key.cast("long") * 8 + t
        return F.struct(
            F.when(t % 2 == 0, (left + mixed(right, k)) % a).otherwise(left).alias("l"),
            F.when(t % 2 == 1, (right + mixed(left, k)) % b).otherwise(right).alias("r"),
        )

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
        return F.aggregate(F.array(*(F.lit(t).cast("long") for t in range(NETWORK))), start, turned, lambda s: s["l"] * b + s["r"])

    return F.aggregate(F.array(*(F.lit(t) for t in range(WALKS))), once(i.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def _rest(v: np.ndarray) -> np.ndarray:
    """``v`` modulo 2^31 - 1, of numbers below 2^63, without a division."""
    m = np.uint64(MODULUS)
    v = (v & m) + (v >> np.uint64(31))
    v = (v & m) + (v >> np.uint64(31))
    return np.where(v >= m, v - m, v)


def places(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """``place`` of many numbers inside of a task."""
    a, b = digits(n)

    def turned(at: np.ndarray, by: np.ndarray, k: int, size: int) -> np.ndarray:
        m = _rest(by * np.uint64(FIRST) + np.uint64(k * SECOND + 12_345))
        t = at + _rest((m ^ (m >> np.uint64(15))) * np.uint64(LAST))
        return t - t // np.uint64(size) * np.uint64(size)

    def once(x: np.ndarray) -> np.ndarray:
        left = x // np.uint64(b)
        right = x - left * np.uint64(b)
        for t in range(NETWORK):
            if t % 2 == 0:
                left = turned(left, right, key * 8 + t, a)
            else:
                right = turned(right, left, key * 8 + t, b)
        return left * np.uint64(b) + right

    x = once(i.astype(np.uint64))
    for _ in range(WALKS):
        out = np.flatnonzero(x >= np.uint64(n))
        if not len(out):
            break
        x[out] = once(x[out])
    return x.astype(np.int64)


def placed(i: Column, n: int, key: int) -> Column:
    """``place`` by arrays, for passes over many rows: as a column function its loops are interpreted row by row."""

    def moved(v: pd.Series) -> pd.Series:
        return pd.Series(places(v.to_numpy(np.int64), n, key))

    return F.pandas_udf(moved, "long")(i)


def place_sql(source: str, name: str = "placed") -> str:
    """Recursive CTE ``name``: rows of ``source`` (i, n, key, ...), with ``x``, the place of i.

    ``source`` has no columns a, b, l, r, x of its own; steps outside of n are walked on and left out.
    """
    step = f"SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM {source}"

    def once(rows: str, at: str) -> str:
        rows = f"SELECT *, {at} // b AS l, {at} % b AS r FROM ({rows})"
        for t in range(NETWORK):
            rows = f"SELECT * REPLACE ((l + {mixed_sql('r', f'key * 8 + {t}')}) % a AS l) FROM ({rows})" if t % 2 == 0 else f"SELECT * REPLACE ((r + {mixed_sql('l', f'key * 8 + {t}')}) % b AS r) FROM ({rows})"
        return f"SELECT * EXCLUDE (l, r), l * b + r AS x FROM ({rows})"

    again = once(f"SELECT * EXCLUDE (x), x AS y FROM {name}_all WHERE x >= n", "y").replace("EXCLUDE (l, r)", "EXCLUDE (l, r, y)")
    return f"{name}_all AS ({once(step, 'i')} UNION ALL {again}), {name} AS (SELECT * FROM {name}_all WHERE x < n)"


def poisson(u: Column) -> Column:
    """A Poisson count with mean 1 for ``u`` from 0 up to 1."""
    return sum((F.when(u >= t, 1).otherwise(0) for t in POISSON), F.lit(0))


def poisson_sql(u: str) -> str:
    return " + ".join(f"CASE WHEN {u} >= {t!r}::DOUBLE THEN 1 ELSE 0 END" for t in POISSON)
