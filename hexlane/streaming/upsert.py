"""Latest-wins merging of a stream into a table of versions, partitioned, with the same result however often a batch is replayed.

A version is a small manifest: for each partition value the folder that holds its rows, and the number of the last batch. A batch
rewrites only the partitions it touches, into one fresh folder, and then commits by renaming its manifest into place; readers of the
version before are not disturbed. Rows of a partition in folders that the manifest doesn't name for it are of older versions and not
read. The files of a folder follow the size of the batch, not the number of partitions, and are sorted by partition. A batch whose
number is already committed is skipped, and a batch that died before its commit leaves a folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


FEW = 100  # so many partition values are named to the reader, which then skips files of others


class VersionedTable:
    """Rows by keys, the one with the greatest `order` winning (ties: the greatest by the other columns)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], order: str, partition: str):
        if partition not in keys:
            raise ValueError("the partition column must be one of the keys, or a row could move to another partition")
        self.spark, self.root, self.schema, self.keys, self.order, self.partition = spark, root.rstrip("/"), schema, keys, order, partition
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(f"{self.root}/manifests").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Numbers of the committed batches."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folder by partition value (its text, as JSON) of a version, by default the last."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else -1
        if version not in have:
            return {}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{version:012d}.json").collect()))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self._rows(self.manifest(version))

    def _text(self):
        return F.col(self.partition).cast("string")

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        """The rows of partition values in the folders that hold them."""
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        texts = {v: json.loads(v) for v in folders}
        rows = self.spark.read.schema(self.schema).parquet(*sorted(set(folders.values())))
        if len(texts) <= FEW and self.schema[self.partition].dataType == T.StringType():
            named = F.col(self.partition).isin([v for v in texts.values() if v is not None])
            rows = rows.where(named | F.col(self.partition).isNull() if None in texts.values() else named)
        rows = rows.withColumn("_text", self._text()).withColumn("_folder", F.regexp_extract("_metadata.file_path", "/data/([^/]+)/[^/]+$", 1))
        live = self.spark.createDataFrame([(texts[v], f.rsplit("/", 1)[1]) for v, f in folders.items()], "_live string, _in string")  # a row a partition value
        rows = rows.join(F.broadcast(live), F.col("_text").eqNullSafe(F.col("_live")) & (F.col("_folder") == F.col("_in")), "left_semi")
        return rows.select(self.schema.fieldNames())

    def _commit(self, version: int, folders: dict[str, str]) -> None:
        text = json.dumps(folders, sort_keys=True)
        draft, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{version:012d}.json")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} was committed by another writer")

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Merge a batch; False if this number, or a later one, is committed already."""
        have = self.versions()
        if have and number <= have[-1]:
            return False
        batch = batch.select(self.schema.fieldNames())
        values = sorted(json.dumps(r[0]) for r in batch.select(self._text()).distinct().collect())  # the partitions of one batch
        folders = self.manifest()
        old = {v: folders[v] for v in values if v in folders}
        rows = self._rows(old).unionByName(batch) if old else batch
        rest = [c for c in self.schema.fieldNames() if c not in self.keys]
        order = [self.order, *[c for c in rest if c != self.order]]
        latest = rows.groupBy(*self.keys).agg(F.max(F.struct(*order)).alias("_row")).select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        base = f"{self.root}/data/{number:012d}-{uuid.uuid4().hex}"
        latest.select(self.schema.fieldNames()).hint("rebalance", F.col(self.partition)).sortWithinPartitions(self.partition).write.parquet(base)
        self._commit(number, folders | dict.fromkeys(values, base))
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests but the last `keep`, and data that no kept manifest names; gives the deleted data folders."""
        have = self.versions()
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v:012d}.json"), False)
        live = {p for v in have[-keep:] for p in self.manifest(v).values()}
        gone = []
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            path = f"{self.root}/data/{s.getPath().getName()}"
            if path not in live:
                self._fs.delete(s.getPath(), True)
                gone.append(path)
        return gone


def run(stream: DataFrame, target: VersionedTable, checkpoint: str) -> None:
    """Merge all that a stream has now, batch by batch."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: target.merge(batch, number)).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def replace_parts(df: DataFrame, path: str, partition: str) -> None:
    """Write df over the partitions it has rows of and leave the others; Spark stages the files and moves them at the end."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
