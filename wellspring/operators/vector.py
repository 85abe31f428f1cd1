"""Vector search: hashed n-grams, a fixed random projection, cosine top-k for a table of queries."""

from __future__ import annotations

import tempfile
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import text as T
from ..functions import values
from . import counted
from .relational import spread

#: Queries that one pass over the vectors serves, and vectors of one matrix product.
QUERY_BLOCK, ROW_BLOCK = 4096, 1024
#: Vectors that a batch keeps for texts with the same buckets in the same order: 6 MB at 384 numbers.
SAME_TEXTS = 4096


@lru_cache(maxsize=4)
def projection(dim: int = values.VECTOR_DIM, buckets: int = values.HASH_BUCKETS, seed: int = values.VECTOR_SEED) -> np.ndarray:
    """Gaussian rows of unit length; derived from the seed in each worker, so nothing is shipped."""
    p = np.random.RandomState(seed).randn(dim, buckets)
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def hashed_counts(items: DataFrame, text: str = "text", buckets: int = values.HASH_BUCKETS) -> DataFrame:
    """id, bucket, tf, weight (tf over the L2 norm of the row): counted inside each row, without a shuffle. Ids are unique."""
    kind = f"id {items.schema['id'].dataType.simpleString()}, bucket long, tf long, weight double"
    rows = spread(items.select("id", text)).select("id", T.spaced(F.col(text)).alias("text"))
    return counted.mapped(rows, counted.hashed, kind, buckets)


def embed(items: DataFrame, text: str = "text", dim: int = values.VECTOR_DIM, seed: int = values.VECTOR_SEED, half: bool = True) -> DataFrame:
    """id, vector: buckets are hashed in the JVM; the worker only sums columns of the projection."""

    @F.pandas_udf("array<float>")
    def project(buckets: pd.Series) -> pd.Series:
        p = projection(dim, values.HASH_BUCKETS, seed)

        @lru_cache(maxsize=SAME_TEXTS)
        def vector(bs: bytes) -> np.ndarray:
            return one(np.frombuffer(bs, dtype=np.int64))

        def one(bs):
            if len(bs) == 0:
                return np.zeros(dim, dtype=np.float32)
            at, n = np.unique(np.asarray(bs, dtype=np.int64), return_counts=True)
            v = p[:, at] @ (n / np.sqrt((n * n).sum()))
            size = np.linalg.norm(v)
            v = v / size if size > 0 else v
            return (v.astype(np.float16) if half else v).astype(np.float32)

        return buckets.map(lambda bs: vector(np.asarray(bs, dtype=np.int64).tobytes()))

    return spread(items.select("id", text)).select("id", project(F.transform(T.features(F.col(text)), lambda t: T.bucket(t))).alias("vector"))


def index_text(normalized, original):
    """The normalized text, or the original one where that is null or empty."""
    return F.coalesce(F.when(normalized != "", normalized), original)


def incremental(vectors: DataFrame, items: DataFrame, since=None, text: str = "text", **params) -> DataFrame:
    """The vectors with those of rows that have none yet (and were created after `since`)."""
    fresh = items if since is None else items.filter(F.col("created_at") > F.lit(since))
    return vectors.unionByName(embed(fresh.join(vectors.select("id"), "id", "left_anti"), text, **params))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, min_score: float = 0.0, digits: int | None = None) -> DataFrame:
    """query_id, id, score, rank. queries: query_id, vector, a stated set of queries.

    The queries go to the workers in blocks of at most QUERY_BLOCK rows. Each task scores its vectors against a block by one
    matrix product for each batch and keeps the k best of each query, so what is shuffled is queries x tasks x k rows, never
    pairs. Ties go to the smaller id; null vectors and queries of zeros have no hits.
    """
    q = queries.select("query_id", F.col("vector").alias("q")).filter(F.exists("q", lambda x: x != 0))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    at = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    kind = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    found, best, spark = vectors.select("id", "vector").filter("vector IS NOT NULL"), [], vectors.sparkSession
    if blocks > 1 and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wellspring-"))
    for n in range(blocks):
        one = found.mapInArrow(best_of(q.filter(at == n).toArrow(), k, min_score, digits, kind), kind)
        best.append(one.checkpoint() if blocks > 1 else one)  # the driver holds one block of queries at a time
    ranked = reduce(DataFrame.unionByName, best).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k)


def best_of(block: pa.Table, k: int, min_score: float, digits: int | None, kind: str):
    """For mapInArrow over (id, vector): the k best of each query of the block."""
    ids = block.column("query_id")
    q = np.array(block.column("q").to_pylist(), dtype=np.float64)
    schema = to_arrow_schema(_parse_datatype_string(kind))

    def run(batches):
        kept: list[pa.Table] = []
        for b in batches if len(q) else ():
            for start in range(0, b.num_rows, ROW_BLOCK):
                part = b.slice(start, ROW_BLOCK)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                s = q @ v.T
                s = np.round(s, digits) if digits is not None else s
                least = np.partition(s, -k, axis=1)[:, [-k]] if k < s.shape[1] else min_score
                who, col = np.nonzero(s >= np.maximum(least, min_score))
                found = pa.table([ids.take(pa.array(who)), part.column(0).take(pa.array(col)), pa.array(s[who, col])], schema=schema)
                kept = [first_k(pa.concat_tables([*kept, found]), k)]
        for t in kept:
            yield from t.to_batches()

    return run


def first_k(hits: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query: by score, then by id."""
    hits = hits.sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
    who = hits.column("query_id").to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, dtype=int)
    place = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    return hits.filter(pa.array(place < k))
