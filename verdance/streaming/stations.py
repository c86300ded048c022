"""Streaming forms: hourly windows, sessions and a chill model with state.

The batch operators define the results; these keep them up to date as rows come.
State is bounded by the watermark (windows, sessions) or is a few numbers a
station (chill).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdance.operators.timeseries import A0, A1, E0, E1


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A folder's Parquet files of one name as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", True).parquet(folder)


def hourly(df: DataFrame, ts: str, by: list[str], v: str, late: str = "2 hours") -> DataFrame:
    """Count and mean a tumbling hour; rows later than ``late`` are dropped."""
    own = df.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return own.groupBy(F.window("_t", "1 hour").alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean")).select(F.col("w.start").alias("hour"), *by, "n", "mean")


def sliding(df: DataFrame, ts: str, by: list[str], v: str, width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    own = df.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return own.groupBy(F.window("_t", width, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def flights(df: DataFrame, ts: str, by: list[str], gap: str = "30 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions that end after ``gap`` without a row."""
    own = df.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return own.groupBy(F.session_window("_t", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def chill(hours: DataFrame, station: str, order: str, t: str) -> DataFrame:
    """Portions so far of each station, updated with each micro-batch of hourly rows.

    Hours of a station must come in order across batches; within one they are sorted.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, p = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values([order, t])
        for c in rows[t].dropna():
            k = c + 273.15
            k0, k1 = A0 * exp(-E0 / k), A1 * exp(-E1 / k)
            x = x * exp(-k1) + k0 / k1 * (1 - exp(-k1)) if k1 else x + k0
            if x >= 1:
                x, p = x - 1, p + 1
        state.update((x, p))
        yield pd.DataFrame({station: [key[0]], "portions": [p]})

    kind = hours.schema[station].dataType.simpleString()
    return hours.groupBy(station).applyInPandasWithState(update, f"{station} {kind}, portions double", "x double, p double", "update", GroupStateTimeout.NoTimeout)


def collected(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is available now, run to its end into a memory table; for checks on small streams."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
