"""Shared helpers: shared-folder tables, row keys, single evaluation of expressions, Arrow rows."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast only tables of at most this many rows of at most some 64 bytes (checked by a count).
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a join leaves together; a key with more is dealt over several salts.
SALT_ROWS = 256
#: The white space of every word rule here: space, and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "wellspring-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body` (a lambda variable is not re-evaluated)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if it has at most `limit` rows; else leave the join strategy to Spark."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def salts(rows: Column) -> Column:
    """Into how many salts a key with so many rows is dealt."""
    return F.ceil(rows / SALT_ROWS)


def join_salted(rows: DataFrame, one: DataFrame, key: str, by: str, counted: DataFrame | None = None) -> DataFrame:
    """rows joined by key with `one`, a table of few but wide rows for each key. The rows of a key with more than SALT_ROWS rows (in
    `counted`, where that is given) are dealt by the column `by` over salts, each of which gets a copy of the key's wide rows."""
    counts = (rows if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SALT_ROWS)
    hot = materialise(counts.select(key, salts(F.col("n")).alias("salts")), "hot-keys")
    n = hot.count()
    if not n:
        return rows.join(one, key)
    hot, salts_of = maybe_broadcast(hot, rows=n), F.coalesce("salts", F.lit(1).cast("long"))
    rows = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts_of)).drop("salts")
    one = one.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts_of - 1))).drop("salts")
    return rows.join(one, [key, "salt"]).drop("salt")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts can hold in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give back to the system what a finished task has freed: idle workers stay, and share the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, with the memory of the task released at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def map_rows(df: DataFrame, rows: Callable[[list[tuple]], list[tuple]], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """Arrow map: `rows(batch)` or, with setup, `rows(state, batch)` turns lists of tuples into lists of tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            if not b.num_rows:
                continue
            got = list(zip(*(c.to_pylist() for c in b.columns)))
            out = rows(state, got) if setup else rows(got)
            cols = list(zip(*out)) if out else [[]] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, kind)], schema=kind)

    return df.mapInArrow(releasing(run), schema)
