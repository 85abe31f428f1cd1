"""A store of Parquet tables: schema bootstrap, reads, and writes with the constraint rules of each table.

Each table is a folder of versions; a write goes to a new version and is published by replacing a one-line pointer
file, so readers see either the old or the new table. Rules: botanicals and indications keep the first row of a natural
key, edges keep the last row of (indication, botanical, preparation) where null preparations never clash, documents
with a known filename are turned away.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import META_SEED, SCHEMAS

NATURAL_KEYS = {"botanicals": ["latin_binomial"], "indications": ["normalized_text"], "edges": ["indication_id", "botanical_id", "preparation"], "docs": ["filename"], "meta": ["key"]}
LAST_WINS = {"edges", "meta"}


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by `order`. A hot key is combined before the shuffle, not sorted in one task."""
    return _one_of(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[str], order: list[str], nulls_clash: bool = False) -> DataFrame:
    """One row for each key: the last by `order`; rows with a null in the key all stay unless `nulls_clash`."""
    if nulls_clash:
        return _one_of(df, keys, order, F.max_by)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return _one_of(df.filter(whole), keys, order, F.max_by).unionByName(df.filter(~whole))


def _one_of(df: DataFrame, keys, order, pick) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(pick(row, F.struct(*[F.col(c) for c in order])).alias("_row")).select("_row.*")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def initialise(self) -> None:
        for name, schema in SCHEMAS.items():
            if not self.exists(name):
                self._publish(name, self.spark.createDataFrame([], schema))
        if not self.read("meta").limit(1).count():
            rows = [(k, v) for k, v in META_SEED.items()]
            self.write("meta", self.spark.createDataFrame(rows, "key string, value string").withColumn("updated_at", F.current_timestamp().cast("timestamp_ntz")))

    def _pointer(self, name: str) -> str:
        return f"{self.path}/{name}/CURRENT"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self._pointer(name)))

    def _publish(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}/{version}")
        tmp = self._path(f"{self.path}/{name}/.current-{version}")
        out = self._fs.create(tmp)
        out.write(bytearray(version.encode()))
        out.close()
        self._fs.delete(self._path(self._pointer(name)), False)
        self._fs.rename(tmp, self._path(self._pointer(name)))

    def read(self, name: str) -> DataFrame:
        version = self.spark.read.text(self._pointer(name)).first()[0]
        return self.spark.read.parquet(f"{self.path}/{name}/{version}")

    def conform(self, name: str, df: DataFrame) -> DataFrame:
        """All columns of the table, in order and type; missing ones are null."""
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])

    def write(self, name: str, new: DataFrame) -> None:
        """Insert rows under the table's rule; new rows get ids after the highest one, in key order."""
        old, new = self.read(name), self.conform(name, new)
        keys = NATURAL_KEYS.get(name)
        if "id" in new.columns:
            top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            order = [c for c in (keys or new.columns) if c in new.columns and c != "id"]
            if new.filter("id IS NULL").limit(1).count():
                new = new.withColumn("id", F.coalesce("id", top + F.row_number().over(Window.orderBy(*order)).cast("long")))
        if keys is None:
            out = old.unionByName(new)
        else:
            both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
            order = ["_age", "id"] if "id" in new.columns else ["_age"]
            one = last_wins(both, keys, order) if name in LAST_WINS else first_wins(both, keys, order)
            out = one.drop("_age")
        self._publish(name, out)

    def known_filenames(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents to insert, documents turned away)."""
        have = self.read("docs").select("filename")
        return docs.join(have, "filename", "left_anti"), docs.join(have, "filename", "left_semi")

    def set_meta(self, values: dict[str, str]) -> None:
        rows = self.spark.createDataFrame(list(values.items()), "key string, value string")
        self.write("meta", rows.withColumn("updated_at", F.current_timestamp().cast("timestamp_ntz")))

    def get_meta(self, key: str) -> str | None:
        row = self.read("meta").filter(F.col("key") == key).select("value").first()
        return row and row[0]
