"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.session import checkpoint_dir

#: ASCII white space, as the word patterns of the contracts have it.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Lineage is cut by files every executor can read, so a lost executor costs
    at most the tasks it was running. ``discard`` deletes the files once nothing reads them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out, lambda _, k=id(out): _WRITTEN.pop(k, None)), path)
    return out


_WRITTEN: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` wrote; nothing that is still to run may read them."""
    for df in tables:
        _, path = _WRITTEN.pop(id(df), (None, None))
        if path:
            own = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(own, True)


def small_batches(spark: SparkSession, rows: int = 256, size: int = 8 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and ``size`` bytes, since whole texts can be long.

    The results are lazy, so the limits have to hold while the caller runs them;
    a session that has set tighter limits keeps its own.
    """
    for key, most, usual in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", size, "64m")):
        now = int(re.sub("[^0-9]", "", spark.conf.get(f"spark.sql.execution.arrow.{key}", usual) or "") or 0)
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")), F.lit(n))


def ascii_lower(col: Column) -> Column:
    """A-Z lowered, all else as it is for matching against ASCII words.

    ``lower`` is the fast path; the Kelvin sign is the one other character that
    it turns into an ASCII letter by itself, so texts with it are translated.
    """
    return F.when(F.instr(col, "K") > 0, F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


def named(df: DataFrame, within: str = "") -> list[Column]:
    """All columns of ``df``, whatever their names; ``within`` is a struct that holds them."""
    return [F.col(f"{within}`{c.replace('`', '``')}`").alias(c) for c in df.columns]


def chance(key: str | Column, seed: int) -> Column:
    """A number from 0 up to 1 by a hash of ``key``, in steps of 2^-53."""
    col = F.col(key) if isinstance(key, str) else key
    return F.shiftrightunsigned(F.xxhash64(col.cast("string"), F.lit(seed)), 11).cast("double") / F.lit(2.0**53)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def bounded_sample(df: DataFrame, key: str, strata: list[str], rows: int, seed: int = 17) -> DataFrame:
    """About ``rows`` rows of each stratum (all, if fewer), chosen by a hash of ``key``.

    One small aggregate counts the strata; their number must be bounded by the
    caller (labels, languages). No window, so a hot stratum stays spread out.
    """
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    named = [F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)]
    counts = F.broadcast(counts.select(*named, (F.lit(float(rows)) / F.col("_n")).alias("_p")))
    same = F.lit(True)
    for i, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    return df.join(counts, same).filter(chance(key, seed) < F.col("_p")).select(*df.columns)


def arrow_rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def release() -> None:
    """Give memory that is free in this worker back to the machine: idle workers stay for the tasks to come."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it has


def map_arrow(df: DataFrame, make, schema, state: dict | None = None) -> DataFrame:
    """``mapInArrow`` with ``make(batch) -> RecordBatch | None`` applied to each batch.

    ``state`` is what ``make`` remembers within a task; it is dropped at the task's end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    out = make(batch)
                    if out is not None:
                        yield out
        finally:
            if state is not None:
                state.clear()
            release()

    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents of each class.

    The label rows are sampled first, so what is broadcast to the scan of the
    documents is at most a few times ``rows`` ids, whatever the table's size.
    Rows with a null id or label are left out; of several labels of an id the larger counts.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
    picked = bounded_sample(own, "doc_id", ["label"], rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def class_counts(labels: DataFrame, label: str, keep: Column) -> dict[int, int]:
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
    return {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def split_by_filter(df: DataFrame, key: str, ids: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose key is surely not in ``ids``, all others), by a bit filter of at most 2**most bits.

    The filter is one row that is broadcast, 4 MB at most whatever the tables'
    size; beyond what it can tell apart, more rows are among the others. So an
    exact join with ``ids`` need only be made for the others, and wide rows that
    are surely not concerned are not shuffled. Null keys are surely not in ``ids``.
    """
    spark = df.sparkSession
    bits = 1 << min(most, max(10, (16 * ids.count()).bit_length()))
    own = ids.select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(bits)).alias("h"))
    words = own.select(F.floor(F.col("h") / 64).alias("w"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = [0] * (bits // 64)
    for r in words.collect():  # at most bits / 64 rows
        table[r["w"]] = r["b"]
    name = "_f"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    one = F.broadcast(spark.createDataFrame([(table,)], f"`{name}` array<bigint>"))
    h = F.pmod(F.xxhash64(df[key].cast("string")), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (h % 64).cast("int"))
    hit = df[key].isNotNull() & (F.get(F.col(name), F.floor(h / 64).cast("int")).bitwiseAND(bit) != 0)
    return df.join(one, hit, "left_anti"), df.join(one, hit, "left_semi")


#: Hot keys are found by counts; there are at most so many of them, so their list can be broadcast.
HOT_KEYS = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame | None = None, least: int = 50_000, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, where hot keys of ``left`` are dealt over copies of their right row.

    A key is hot if it has ``least`` rows of ``left`` or more, and at least one in HOT_KEYS of
    all; so there are at most HOT_KEYS of them, and no task gets more than about that many
    rows of one key. ``by`` is the column of ``left`` that deals them. ``counts`` (key, n) may be given.
    """
    if counts is None:
        total = left.count()
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if total >= least else None
    else:
        total = counts.agg(F.sum("n")).first()[0] or 0
    if total < least or counts is None:
        return left.join(right, key, how)
    heavy = max(least, total // HOT_KEYS)
    hot = materialise(counts.filter(F.col("n") >= heavy).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / heavy).alias("_parts")), "hot")
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(hot)  # at most HOT_KEYS rows
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(few, left[key] == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(left[by].cast("string"), F.lit(23)), parts)).drop("_hot", "_parts")
    copied = right.join(few, right[key] == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_hot", "_parts")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
