"""Tables that know their keys.

``KeyedTable``: rows in hash buckets of their key. A batch rewrites only the buckets it touches: the new files of those
buckets are written beside the old ones, and a manifest that names the folder of every bucket is put in place last. The
manifest also holds the number of the last batch, so a batch that is delivered again changes nothing.

``DoneTable``: keys already done, as a bucketed and sorted catalog table with column statistics. Asking what is still to do
moves only the new side.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.folders import Folder

MANIFESTS = "_manifest"
#: Manifests kept for readers under way: the current one and the one before.
KEPT = 2


def last_write(keys: list[str], order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge rule: per key the row with the greatest ``order`` columns, old or new."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c not in keys]
        best = F.max_by(F.struct(*rest), F.struct(*order))
        both = old.unionByName(new).groupBy(*keys).agg(best.alias("_r"))
        return both.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in old.columns])
    return merge


def first_write(keys: list[str], order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge rule: a key that is there keeps its row; of new rows that share a key the first by ``order`` enters."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        from tessera.sources.sinks import insert_if_absent
        return insert_if_absent(old, new, keys, order).select(*old.columns)
    return merge


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``schema`` at ``path``, one per value of ``keys``, in ``buckets`` buckets (fixed when the table is new)."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = 64

    def _folder(self, *parts: str) -> Folder:
        return Folder(self.spark, "/".join([self.path.rstrip("/"), *parts]))

    def manifest(self) -> dict:
        """{"batch": number of the last batch, "buckets": {bucket: folder}}."""
        names = [n for n in self._folder(MANIFESTS).names() if n.endswith(".json")]
        if not names:
            return {"serial": 0, "batch": None, "of": self.buckets, "buckets": {}}
        found = json.loads(self._folder(MANIFESTS, names[-1]).text())
        if found["of"] != self.buckets:
            raise ValueError(f"the table has {found['of']} buckets, not {self.buckets}")
        return found

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = [self._folder(f).path for f in folders]
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def rows(self) -> DataFrame:
        """All current rows: one scan of the current files."""
        return self._read(sorted(self.manifest()["buckets"].values()))

    def apply(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame],
              batch_id: int | None = None) -> list[int]:
        """Merge a batch into the buckets it touches and return those. A numbered batch that is not beyond the last one
        applied is left alone."""
        now = self.manifest()
        if batch_id is not None and now["batch"] is not None and batch_id <= now["batch"]:
            return []
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        own = batch.select(*self.schema.names)
        touched = sorted(r[0] for r in own.select(bucket.alias("b")).distinct().collect())  # at most ``buckets`` numbers
        if not touched and batch_id is None:
            return []
        held = dict(now["buckets"])
        folder = f"write-{now['serial'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        if touched:
            old = self._read(sorted(held[str(b)] for b in touched if str(b) in held))
            (merge(old, own).withColumn("_bucket", bucket).repartition("_bucket")
             .write.partitionBy("_bucket").parquet(self._folder(folder).path))
            written = {n.split("=")[1] for n in self._folder(folder).names() if n.startswith("_bucket=")}
            for b in map(str, touched):
                if b in written:
                    held[b] = f"{folder}/_bucket={b}"
                else:
                    held.pop(b, None)
        fresh = {"serial": now["serial"] + 1, "batch": now["batch"] if batch_id is None else batch_id, "of": self.buckets,
                 "buckets": held}
        self._folder(MANIFESTS).make()
        self._folder(MANIFESTS, f"{fresh['serial']:012d}.json").put(json.dumps(fresh))
        self._clean()
        return touched

    def _clean(self) -> None:
        """Remove folders that neither of the last manifests names (files of batches that broke off among them)."""
        names = [n for n in self._folder(MANIFESTS).names() if n.endswith(".json")]
        used = set()
        for n in names[-KEPT:]:
            used |= set(json.loads(self._folder(MANIFESTS, n).text())["buckets"].values())
        for n in names[:-KEPT]:
            self._folder(MANIFESTS, n).remove()
        for write in self._folder().names():
            if write.startswith("write-"):
                for b in self._folder(write).names():
                    if b.startswith("_bucket=") and f"{write}/{b}" not in used:
                        self._folder(write, b).remove()
                if not any(u.startswith(write) for u in used):
                    self._folder(write).remove()


@dataclass(frozen=True)
class DoneTable:
    """Keys (and what else their rows hold) in a catalog table bucketed and sorted by ``key``."""

    spark: SparkSession
    name: str
    key: str
    buckets: int
    path: str | None = None

    def add(self, rows: DataFrame, statistics: bool = True) -> None:
        """Append rows in the table's layout and bring its statistics up to date."""
        writer = (rows.repartition(self.buckets, self.key).write.format("parquet").mode("append")
                  .bucketBy(self.buckets, self.key).sortBy(self.key))
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)
        if statistics:
            self.spark.sql(f"ANALYZE TABLE {self.name} COMPUTE STATISTICS FOR COLUMNS {self.key}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def todo(self, source: DataFrame, key: str | None = None) -> DataFrame:
        """Rows of ``source`` whose key is not done: a merge join that shuffles the source only, into the table's buckets."""
        done = self.rows().select(F.col(self.key).alias("_done")).hint("merge")
        dealt = source.repartition(self.buckets, key or self.key)
        return dealt.join(done, F.col(key or self.key) == F.col("_done"), "left_anti")
