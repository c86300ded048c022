"""Sinks. Paths are folders; long tables are the stored form, wide ones are made on the way out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide_csv(df: DataFrame, path: str, key: str, year: str, values: list[str], years: list[int]) -> None:
    """One row a key and one column a value and year, as CSV."""
    wide = df.groupBy(key).pivot(year, years).agg(*(F.first(v, ignorenulls=True).alias(v) for v in values))
    names = [key] + [f"{v}_{y}" for y in years for v in values]
    wide.toDF(*names).write.mode("overwrite").option("header", True).csv(path)


def csv(df: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    df.withColumnsRenamed(names or {}).write.mode("overwrite").option("header", True).csv(path)


def json_document(df: DataFrame, path: str) -> None:
    """Tidy result rows as JSON lines; values of any type by their text."""
    df.write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` put in their place by key: the later write wins."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_v"))
    return both.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_v", "_i")


def with_columns(old: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """A new table with the columns of ``more``; the old one stays as it is."""
    return old.join(more, key, "left")


def once(df: DataFrame, path: str) -> None:
    """Write unless something is there already."""
    df.write.mode("ignore").parquet(path)


def resumed(todo: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All results in ``path`` after ``work`` was done for the rows of ``todo`` whose keys have none there yet.

    Results are added in one commit, so a run that is lost before it leaves nothing and is done again.
    """
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None
    rest = todo if done is None else todo.join(done.select(*keys).distinct(), keys, "left_anti")
    if not rest.isEmpty():
        work(rest).write.mode("append").parquet(path)
    return spark.read.parquet(path)
