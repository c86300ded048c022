"""A registry of queries and their SQL, and the views both sides read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query

        return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel stand-in: zone, year, three channels, a value and a mask from lineitem."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
        F.col("l_suppkey").alias("zone"),
        F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("r"),
        F.round(F.col("l_discount") * 100, 6).alias("g"),
        F.round(F.col("l_tax") * 100, 6).alias("b"),
        F.col("l_extendedprice").alias("v"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


PX = """px AS (
  SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS zone, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS r,
    round(l_discount * 100, 6) AS g, round(l_tax * 100, 6) AS b, l_extendedprice AS v, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""

#: Positions derived from keys, on a 1 km square; of customers (the survey) and suppliers (the crowns).
SPOTS = """cu AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 91 + 13) % 997 AS DOUBLE) AS y, c_nationkey AS nation, c_acctbal AS w FROM customer),
su AS (SELECT s_suppkey AS id, CAST((s_suppkey * 53) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 79 + 7) % 997 AS DOUBLE) AS y, s_nationkey AS nation, s_acctbal AS w FROM supplier)"""


def spots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def place(name: str, p: str, mx: int, my: int, add: int) -> DataFrame:
        key = F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}")
        return read(spark, sf_dir, name).select(key.alias("id"), ((key * mx) % 1000).cast("double").alias("x"), ((key * my + add) % 997).cast("double").alias("y"), F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("w"))

    return place("customer", "c", 37, 91, 13), place("supplier", "s", 53, 79, 7)


def rounded(df: DataFrame, digits: int = 6, but: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show; -0.0 becomes 0.0."""
    doubles = {n for n, t in df.dtypes if t == "double" and n not in but}
    one = lambda c: F.round(c, digits) + F.lit(0.0)
    return df.select(*(one(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns))


def num(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def micros(c: str) -> Column:
    """A time stamp as microseconds."""
    return F.unix_micros(F.col(c).cast("timestamp"))
