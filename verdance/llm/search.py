"""Exact top-k inner products by MaxScore over integer vectors.

A vector's components are its terms; the postings of a term are its values in
one shard of candidates. For a query, the terms' contributions in a shard lie
between bounds that the shard's largest and smallest values give. Terms are
ordered by how far those bounds lie apart; the narrow ones that together cannot
lift a candidate to the query's bar (its k-th best score so far) are
non-essential. Essential postings are traversed for all candidates of the shard,
as one product for a block of queries; the others are probed for candidates
that can still reach the bar. A query whose bound for a whole shard is under its bar skips it.
Shards give their best, which are merged.

Candidates are put into shards by similarity (signs of a few fixed projections),
so that bounds are narrow and a query's own shard gives it a high bar first; a
crowded sign pattern is split by a hash of the id, so a shard has at most about
``shard_rows`` rows even where a third of all vectors are equal. Queries are
dealt into blocks; a task holds one shard and one block. Rows of candidates are
copied once for each block of queries, the stated set of queries against all rows.

Edge cases: vectors that are null or hold null, NaN or infinite components, and
rows without an id, take no part; components that are missing in shorter vectors count as
zero; of rows that repeat an id the smallest vector counts; ties go to the smaller id; a
score that a long can't hold is given as the largest or smallest long; an empty table gives an
empty one; columns but ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.llm.common import materialise

#: Terms in a step; queries whose scores are held at once; share of candidates under which they are probed one by one.
PROBE, HELD, FEW = 16, 256, 0.25
#: At most so many projections, so there are at most 2**PLANES sign patterns.
PLANES = 12


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of every vector that takes part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    own = vectors.select("vec_id", e).filter(F.col("vec_id").isNotNull() & e.isNotNull() & fine)
    v = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return own.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


class Shard:
    """Candidates of one shard with the bounds of each term."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.most, self.least = v.max(0), v.min(0)

    def bounds(self, q: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest that ``terms`` can add to each query's score."""
        up, down = np.maximum(q[:, terms], 0), np.minimum(q[:, terms], 0)
        most, least = self.most[terms], self.least[terms]
        return up @ most + down @ least, up @ least + down @ most

    def top(self, query_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, row of the shard, score) of at most k candidates a query whose score is at least its bar.

        The query itself is no candidate. Ties beyond the k-th go to smaller ids.
        """
        every = np.arange(q.shape[1])
        alive = np.flatnonzero(self.bounds(q, every)[0] >= bar)
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(alive), HELD):
            rows = alive[at : at + HELD]
            i, j, s = self._block(query_ids[rows], q[rows], bar[rows].copy(), k)
            out.append((rows[i], j, s))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (alive, alive, np.zeros(0, q.dtype))  # type: ignore[return-value]

    def _block(self, query_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        reach = (self.most - self.least) * np.abs(q).max(0)
        terms = np.argsort(reach.astype(float), kind="stable")[::-1]  # widest first
        own = self.ids[None, :] == query_ids[:, None]
        score = np.zeros((len(q), len(self.ids)), q.dtype)
        done = 0
        while True:  # essential terms, for all candidates
            now, rest = terms[done : done + PROBE], terms[done + PROBE :]
            score = score + q[:, now] @ self.v[:, now].T
            done += PROBE
            high, low = self.bounds(q, rest)
            if done <= PROBE or not len(rest):  # the bar rises by what is sure in this shard
                bar = np.maximum(bar, _kth(np.where(own, low[:, None] - np.inf if q.dtype != object else -(1 << 200), score + low[:, None]), k))
            open_ = (score + high[:, None] >= bar[:, None]) & ~own
            if not len(rest) or open_.mean() < FEW:
                break
        i, j = np.nonzero(open_)
        s = score[i, j]
        while done < len(terms) and len(i):  # the others, only where a candidate can still compete
            now, rest = terms[done : done + PROBE], terms[done + PROBE :]
            s = s + (q[i][:, now] * self.v[j][:, now]).sum(1)
            done += PROBE
            keep = s + self.bounds(q, rest)[0][i] >= bar[i]
            i, j, s = i[keep], j[keep], s[keep]
        order = np.lexsort((self.ids[j], -s if s.dtype != object else np.array([-float(x) for x in s]), i))
        i, j, s = i[order], j[order], s[order]
        if s.dtype == object and len(s):  # doubles can't tell all whole numbers apart
            order = np.array(sorted(range(len(i)), key=lambda r: (i[r], -s[r], self.ids[j[r]])))
            i, j, s = i[order], j[order], s[order]
        first = np.searchsorted(i, i, side="left")
        keep = np.arange(len(i)) - first < k
        return i[keep], j[keep], s[keep]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    if scores.dtype == object:
        return np.array([sorted(r, reverse=True)[k - 1] for r in scores], object)
    return np.partition(scores, -k, axis=1)[:, -k]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows: of doubles where all sums of products are exact in them, else of Python integers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    big = int(max(abs(int(flat.max())), abs(int(flat.min())))) if len(flat) else 0
    out = np.zeros((len(sizes), width), np.float64 if big * big * max(1, width) < 1 << 52 else object)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat if out.dtype != object else [int(x) for x in flat]
    return out


def _pattern(v: Column, planes: int, width: int, seed: int = 5) -> Column:
    """Signs of fixed projections of a vector, as the bits of a number."""
    rng = np.random.default_rng(seed)
    code = F.lit(0).cast("long")
    for p in range(planes):
        signs = F.array(*(F.lit(int(s)) for s in rng.choice([-1, 1], width)))
        dot = F.aggregate(F.zip_with(v, signs, lambda x, s: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(s, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
        code = code + F.when(dot >= 0, 1 << p).otherwise(0)
    return code


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 4096, block_rows: int = 2048, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other vectors for each query; ties to the smaller id."""
    own = materialise(quantised(vectors, scale).withColumn("ask", F.coalesce(is_query, F.lit(False))), "vectors")
    n, m, width = own.agg(F.count(F.lit(1)), F.count_if(F.col("ask")), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    planes = min(PLANES, max(0, math.ceil(math.log2(max(1, n) / shard_rows))) if n > shard_rows else 0)
    coded = own.withColumn("code", _pattern(F.col("v"), planes, width))
    sizes = sorted((r["code"], r["n"]) for r in coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 2**PLANES rows
    parts = [max(1, -(-count // shard_rows)) for _, count in sizes]
    first = np.concatenate([[0], np.cumsum(parts)])
    shards, blocks = int(first[-1]), max(1, math.ceil((m or 0) / block_rows))
    spread = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), count)
    table = own.sparkSession.createDataFrame([(c, int(f), p) for (c, _), f, p in zip(sizes, first, parts, strict=False)], "code long, first long, parts long")
    placed = coded.join(F.broadcast(table), "code").select("vec_id", "v", "ask", (F.col("first") + spread(F.col("parts"), 1)).alias("shard"))
    placed = materialise(placed.withColumn("block", spread(F.lit(blocks), 2)), "shards")
    schema = "query_id long, vec_id long, score long"

    def search(ids: np.ndarray, v: np.ndarray, asks: np.ndarray, q_ids: np.ndarray, q: np.ndarray, bar: np.ndarray) -> pa.Table:
        rest = np.flatnonzero(asks)
        i = j = np.zeros(0, int)
        s = np.zeros(0)
        if len(rest) and len(q_ids):
            shard = Shard(ids[rest], v[rest])
            i, j, s = shard.top(q_ids, q, bar, k)
            got = shard.ids[j]
        else:
            got = np.zeros(0, np.int64)
        low, high = -(1 << 63), (1 << 63) - 1
        scores = s.astype(np.int64) if s.dtype != object else [min(max(int(x), low), high) for x in s]
        return pa.table([pa.array(q_ids[i], pa.int64()), pa.array(got, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    def at_home(t: pa.Table) -> pa.Table:
        ids, v, asks = t.column("vec_id").to_numpy(), _matrix(t.column("v"), width), t.column("ask").to_numpy()
        return search(ids, v, np.ones(len(ids), bool), ids[asks], v[asks], np.full(int(asks.sum()), -np.inf))

    def away(t: pa.Table) -> pa.Table:
        ids, v, asks = t.column("vec_id").to_numpy(), _matrix(t.column("v"), width), t.column("ask").to_numpy()
        bar = t.column("bar").to_numpy()[asks].astype(float)
        bar = np.where(np.abs(bar) < 2.0**53, bar, np.nextafter(bar, -np.inf))  # a bar must not be rounded up
        return search(ids, v, ~asks, ids[asks], v[asks], bar)

    home = materialise(placed.groupBy("shard").applyInArrow(at_home, schema), "home")
    bars = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).filter(F.col("n") >= k)
    bars = bars.select(F.col("query_id").alias("vec_id"), F.col("bar").cast("double").alias("bar"))
    asking = placed.filter("ask").join(bars, "vec_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    asking = asking.withColumn("to", F.explode(F.filter(F.sequence(F.lit(0), F.lit(max(0, shards - 1))), lambda x: x != F.col("shard"))))
    asking = asking.select("vec_id", "v", F.lit(True).alias("ask"), "bar", F.col("to").cast("long").alias("shard"), "block")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    candidates = placed.select("vec_id", "v", F.lit(False).alias("ask"), F.lit(None).cast("double").alias("bar"), "shard", every.alias("block"))
    found = asking.unionByName(candidates).groupBy("shard", "block").applyInArrow(away, schema).unionByName(home)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), own AS (SELECT vec_id, min(v) AS v FROM kept GROUP BY vec_id), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM own q JOIN own c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
