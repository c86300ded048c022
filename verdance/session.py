"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers.

    Where the repository is on ``PYTHONPATH`` workers find it already; else a zip
    of the package is sent once for each application.
    """
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    to = Path(tempfile.mkdtemp(prefix="verdance-")) / "verdance.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none and all work is done in this process (a
    ``local`` master, as in tests) a temporary folder is made and set. Executors
    of a cluster could not see it, so there the setting is required.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='verdance-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: for loops, since a checkpoint keeps what is known of its columns, and that grows with each round."""
    path = f"{checkpoint_dir(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Appended:
    """A table in the shared folder that rounds of a loop append to, so that no plan grows with their number."""

    def __init__(self, spark: SparkSession, schema) -> None:
        self.spark, self.schema, self.path = spark, schema, f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.select(*self.schema.fieldNames()).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
