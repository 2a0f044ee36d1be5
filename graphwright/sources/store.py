"""Append-only tables, epochs and the review snapshot store.

A batch is written under its own directory and becomes visible when its commit
marker exists; markers are created exclusively, which is the compare-and-set of
the single writer.  All files go through the Hadoop file system of the path, so
a table can lie wherever Spark reads and writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1


class StaleEpochError(RuntimeError):
    """Another writer committed the epoch first."""


class DuplicateKeyError(ValueError):
    """A row that is to be appended has a key that is there already."""


class RetryableStoreError(OSError):
    """Input or output failed; trying again can help."""


class PermanentStoreError(ValueError):
    """The stored data cannot be read; trying again cannot help."""


class Files:
    """Small files of a folder on the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.setVerifyChecksum(False)
        self.fs.setWriteChecksum(False)
        self.fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, prefix: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.globStatus(self._at(f"{prefix}*"))]

    def read(self, name: str) -> str | None:
        """Text of a file; None if there is none."""
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False, and nothing written, if it is there already."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if self.fs.exists(self._at(name)):
                return False
            raise RetryableStoreError(str(e.java_exception)) from e
        stream.write(text.encode())
        stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Put a file in the place of another in one step."""
        tmp = f"{name}.{uuid.uuid4().hex}"
        self.create(tmp, text)
        options = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._at(tmp), self._at(name), options)


class AppendOnlyTable:
    """Batches of rows with an optional unique key; there is no update and no delete.

    ``refs`` names array columns whose elements are kept as reference tables
    (key, element), written and published together with their rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, unique: str | None = None, refs: dict[str, str] | None = None) -> None:
        self.spark, self.path, self.unique, self.refs = spark, path.rstrip("/"), unique, refs or {}
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files = Files(spark, self.path)
        self.files.create("_version.json", json.dumps({"version": SCHEMA_VERSION}))
        found = json.loads(self.files.read("_version.json") or "{}").get("version")
        if found != SCHEMA_VERSION:
            raise PermanentStoreError(f"table version {found}, expected {SCHEMA_VERSION}")

    def epochs(self) -> list[int]:
        return sorted(int(n.removeprefix("_COMMITTED_")) for n in self.files.names("_COMMITTED_"))

    def published(self) -> int:
        """Greatest committed epoch, 0 for none; never goes back."""
        return max(self.epochs(), default=0)

    def _marker(self, epoch: int) -> dict:
        return json.loads(self.files.read(f"_COMMITTED_{epoch}"))

    def last_batch(self, stream: str) -> int:
        """Greatest batch id that a stream has committed here, -1 for none."""
        return max((m["batch"] for m in map(self._marker, self.epochs()) if m.get("stream") == stream), default=-1)

    def read(self, epoch: int | None = None) -> DataFrame:
        """Rows of all committed batches up to ``epoch``, in batch and row order by ``seq``."""
        names = [f"{self.path}/{self._marker(e)['dir']}/rows" for e in self.epochs() if epoch is None or e <= epoch]
        full = T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType()), T.StructField("seq", T.LongType())])
        return self.spark.read.schema(full).parquet(*names) if names else self.spark.createDataFrame([], full)

    def read_refs(self, column: str) -> DataFrame:
        """The reference table (key, element) of an array column."""
        names = [f"{self.path}/{self._marker(e)['dir']}/{column}" for e in self.epochs()]
        schema = f"{self.unique} string, {self.refs[column]} string"
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, expected: int | None = None, stream: str | None = None, batch: int | None = None) -> int:
        """Write a batch with its references as the next epoch and return it.

        ``expected`` is the epoch that the caller has read; another one there
        refuses the batch.  Repeated keys, within the batch or with committed
        rows, refuse it as well.  ``stream`` and ``batch`` are kept with the
        commit.
        """
        now = self.published()
        if expected is not None and expected != now:
            raise StaleEpochError(f"epoch {now}, expected {expected}")
        if self.unique:
            clash = rows.groupBy(self.unique).agg(F.count("*").alias("n")).filter("n > 1").select(self.unique).unionByName(rows.join(self.read().select(self.unique), self.unique, "left_semi").select(self.unique))
            if not clash.isEmpty():
                raise DuplicateKeyError(f"{self.unique} is not unique")
        name = f"batch-{uuid.uuid4().hex}"
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*cols, F.lit(now + 1).cast("bigint").alias("epoch"), F.monotonically_increasing_id().alias("seq")).write.parquet(f"{self.path}/{name}/rows")
        for column, element in self.refs.items():
            rows.select(self.unique, F.explode(F.array_distinct(column)).alias(element)).filter(F.col(element).isNotNull()).write.parquet(f"{self.path}/{name}/{column}")
        if not self.files.create(f"_COMMITTED_{now + 1}", json.dumps({"dir": name, "stream": stream, "batch": batch})):
            raise StaleEpochError(f"epoch {now + 1} is taken")
        return now + 1


class MemoryTable:
    """The interface of ``AppendOnlyTable`` without files: for tests and single runs.  Rows are held by the plans that gave them."""

    def __init__(self, spark: SparkSession, schema: T.StructType | str, unique: str | None = None) -> None:
        self.spark, self.unique = spark, unique
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.batches: list[DataFrame] = []

    def published(self) -> int:
        return len(self.batches)

    def read(self, epoch: int | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType()), T.StructField("seq", T.LongType())]))
        for b in self.batches[: len(self.batches) if epoch is None else epoch]:
            out = out.unionByName(b)
        return out

    def append(self, rows: DataFrame, expected: int | None = None, **_) -> int:
        if expected is not None and expected != self.published():
            raise StaleEpochError(f"epoch {self.published()}, expected {expected}")
        if self.unique and not rows.select(self.unique).unionByName(self.read().select(self.unique)).groupBy(self.unique).count().filter("count > 1").isEmpty():
            raise DuplicateKeyError(f"{self.unique} is not unique")
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self.batches.append(rows.select(*cols, F.lit(self.published() + 1).cast("bigint").alias("epoch"), F.monotonically_increasing_id().alias("seq")))
        return self.published()


def with_refs(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Reference rows (audit_id, name) that are appended with their main rows."""
    return rows.select("audit_id", F.explode(F.array_distinct(column)).alias(name)).filter(F.col(name).isNotNull())


def records_for(table: DataFrame, refs: DataFrame, name: str, value: str) -> DataFrame:
    """Records that reference ``value``, in order of insertion."""
    return table.join(refs.filter(F.col(name) == value).select("audit_id"), "audit_id", "left_semi").orderBy("epoch", "seq")


class ReviewSnapshotStore:
    """Whole-table JSON snapshots: a new directory per save, then the pointer moves."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files = Files(spark, self.path)

    def load(self) -> DataFrame:
        """The latest snapshot; a missing one is empty, an unreadable one raises."""
        current = self.files.read("_CURRENT")
        if current is None:
            return self.spark.createDataFrame([], self.schema)
        out = self.spark.read.schema(self.schema).option("mode", "FAILFAST").json(f"{self.path}/{current.strip()}")
        try:
            out.foreach(lambda _: None)
        except Exception as e:
            raise PermanentStoreError(f"unreadable snapshot in {self.path}") from e
        return out

    def save(self, rows: DataFrame) -> None:
        name = f"snapshot-{uuid.uuid4().hex}"
        try:
            rows.select(*[f.name for f in self.schema.fields]).write.json(f"{self.path}/{name}")
        except OSError as e:
            raise RetryableStoreError(str(e)) from e
        self.files.replace("_CURRENT", name)
