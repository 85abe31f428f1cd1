"""Token counts as delta-maintained rollups.

A change is a signed row: +1 with the count of a document that is inserted, -1 with the count of one that is deleted, and
both for a revised count (of a document, or of its tokenizer version). Totals by source, language and tokenizer version
are sums of signed rows, so they are updated by adding a batch's sums, without reading what was committed before.

A batch is committed under its id: its sums are written to a staging folder and renamed to `batches/<id>`; the rename is
the commit. A batch whose folder is there already changes nothing, so a repeated or restarted commit counts once.
`compact` publishes the sums of many batches together with their ids by one rename as well, so a process that ends at any
point leaves either the old or the new sums, and no batch is counted twice or can be committed again.

Plan. Signed rows are summed with map-side combination (a hot source costs one row for each task); no join of the old
with the new state is needed, since equal rows of both cancel out.

Defined cases: null source or language is the category "(none)"; null or empty text has 0 tokens and still counts as a
document; repeated rows count as often as they occur; an empty batch commits and adds nothing; categories whose totals
have become 0 are not listed; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary, own_encoder
from .common import documents, fresh_path, map_rows, materialise
from .mixing import token_count

KEYS = ("source", "lang", "tokenizer_version")
SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class Rollup:
    """A store of committed batches below `path`, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self.fs = self._p(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._p(f"{path}/batches"))

    def committed(self, batch_id: str) -> bool:
        return self.fs.exists(self._p(f"{self.path}/batches/{batch_id}")) or batch_id in self._compaction()[1]

    def commit(self, batch_id: str, signed: DataFrame) -> bool:
        """signed: KEYS, sign (+1 or -1), n_tokens. False if the batch was committed before."""
        if not batch_id or "/" in batch_id or batch_id.startswith(("_", ".")):
            raise ValueError("a batch id is a plain folder name")
        if self.committed(batch_id):
            return False
        key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c)
        sums = signed.select(*[key(k) for k in KEYS], F.col("sign").cast("long").alias("sign"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n"))
        sums = sums.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).alias("n_tokens"))
        staging = self._staging()
        sums.write.parquet(staging)
        return self._publish(staging, f"{self.path}/batches/{batch_id}")

    def _staging(self) -> str:
        return f"{self.path}/staging/{uuid.uuid4().hex}"

    def _publish(self, staging: str, target: str) -> bool:
        """The rename that commits. Onto a folder that another process has just made it fails, or puts the staging folder inside."""
        source, place = self._p(staging), self._p(target)
        inside = self._p(f"{target}/{source.getName()}")
        if not self.fs.exists(place) and self.fs.rename(source, place) and not self.fs.exists(inside):
            return True
        for p in (inside, source):
            self.fs.delete(p, True)
        return False

    def _names(self, folder: str) -> list[str]:
        p = self._p(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def _compaction(self) -> tuple[str | None, set[str]]:
        """The last compaction's folder name, and the ids of the batches that its sums hold."""
        names = self._names("compactions")
        if not names:
            return None, set()
        ids = self.spark.read.schema("batch_id string").parquet(f"{self.path}/compactions/{names[-1]}/ids")
        return names[-1], {r[0] for r in ids.collect()}

    def batches(self) -> list[str]:
        return sorted({*self._names("batches"), *self._compaction()[1]})

    def _sums(self, last: str | None, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{n}" for n in names] + ([f"{self.path}/compactions/{last}/sums"] if last else [])
        if not paths:
            return self.spark.createDataFrame([], SUMS)
        sums = self.spark.read.schema(SUMS).parquet(*paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        last, held = self._compaction()
        return self._sums(last, [n for n in self._names("batches") if n not in held])

    def compact(self) -> bool:
        """Publish the sums of all batches, with their ids, as one folder; False if there is nothing new or another process came first.

        Before the rename the old sums count and after it the new ones, wherever the process ends. What the last compaction
        replaced is removed here, so totals that were begun after that one still find their files."""
        last, held = self._compaction()
        new = [n for n in self._names("batches") if n not in held]
        if not new:
            return False
        staging, number = self._staging(), int(last or 0) + 1
        self._sums(last, new).write.parquet(f"{staging}/sums")
        self.spark.createDataFrame([(n,) for n in sorted({*held, *new})], "batch_id string").write.parquet(f"{staging}/ids")
        replaced = [f"batches/{n}" for n in self._names("batches") if n in held]
        replaced += [f"compactions/{n}" for n in self._names("compactions") if last and n < last]
        if not self._publish(staging, f"{self.path}/compactions/{number:010d}"):
            return False
        for p in replaced:
            self.fs.delete(self._p(f"{self.path}/{p}"), True)
        return True


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).alias("sign"), "n_tokens")


def inserted(counts: DataFrame) -> DataFrame:
    return signed(counts, 1)


def deleted(counts: DataFrame) -> DataFrame:
    return signed(counts, -1)


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select("source", "lang", F.lit("words").alias("tokenizer_version"), token_count(docs["text"]).alias("n_tokens"))


def bpe_counts(docs: DataFrame, vocabulary: str | None = None, version: str = "byte_bpe_50k") -> DataFrame:
    def rows(enc, batch):
        got = enc.encode_batch([t or "" for _, _, t in batch])
        return [(s, g, version, len(ids)) for (s, g, _), ids in zip(batch, got)]

    def setup(path=vocabulary):
        return own_encoder(path or default_vocabulary())[1]

    return map_rows(docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), "text"), rows, "source string, lang string, tokenizer_version string, n_tokens long", setup)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by deltas: load word counts, revise all to BPE counts, load the word counts again, delete and re-insert all
    BPE counts; then repeat every commit, which must change nothing. The totals are those of one load of both counts."""
    docs, store = documents(spark, sf_dir), Rollup(spark, fresh_path(spark, "token-rollup"))
    # Counted once, since several batches read each table.
    words, tokens = materialise(word_counts(docs), "word-counts"), materialise(bpe_counts(docs), "bpe-counts")
    batches = {
        "load-words": inserted(words),
        "revise-to-bpe": revised(words, tokens),
        "reload-words": inserted(words),
        "delete-bpe": deleted(tokens),
        "reinsert-bpe": inserted(tokens),
    }
    for batch_id in (*batches, *batches):
        store.commit(batch_id, batches[batch_id])
    return store.totals()
