"""Continuous indexing: new documents of a folder become chunks and vectors, micro-batch by micro-batch.

An extension for folders that keep growing. Each micro-batch writes under its own batch id, so a batch that is repeated after a failure replaces its own output and nothing is
indexed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks, vector


def index_batch(batch: DataFrame, batch_id: int, out: str, size: int, overlap: int) -> None:
    made = chunks.chunk(batch, size, overlap).withColumn("id", F.xxhash64("doc_id", "chunk_index")).persist()
    made.write.mode("overwrite").parquet(f"{out}/chunks/batch_id={batch_id}")
    vector.embed(made, "chunk_text").write.mode("overwrite").parquet(f"{out}/vectors/batch_id={batch_id}")
    made.unpersist()


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, size: int = 500, overlap: int = 100, once: bool = False) -> StreamingQuery:
    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select("value", F.col("_metadata.file_path").alias("doc_id"))
    docs = files.select("doc_id", F.col("value").alias("text"))
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: index_batch(b, i, out, size, overlap))
    return (writer.trigger(availableNow=True) if once else writer).start()
