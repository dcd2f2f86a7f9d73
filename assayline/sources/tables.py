"""Immutable table versions and append-only history under one folder.

A thin naming convention over plain parquet writes. Data is written once, to a folder no one else knows; it becomes a version by
the creation of a small manifest under the next free number, which only one writer can create. A manifest names the data, its
rows, its schema and the time it was published, so a reader can pin all its inputs to one moment. The
folder is addressed through Hadoop's file system, so it may live on any storage the cluster can use; two writers exclude each other
as far as that storage creates a file exclusively.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, types as T

from assayline.errors import DataQualityError, SchemaRefused

ENTRY_TRIES = 200  # of 0.05 seconds
OPEN_FILES = 16
CONCURRENT_FILES = "spark.sql.maxConcurrentOutputFileWriters"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def partition_text(value: str) -> str:
    """A partition value as Spark itself writes it into a path: characters with a meaning there as a percent code."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda found: f"%{ord(found[0]):02X}", str(value)) or "__HIVE_DEFAULT_PARTITION__"


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, path: str) -> list[str]:
        place = self._path(path)
        if not self._files.exists(place):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(place) if s.isDirectory())

    def _exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    # Numbered entries: created once, never changed.

    def _entries(self, place: str, *, finished: bool = True) -> list[int]:
        """Numbers in a folder of entries; one whose writer is still at it is taken, but not there yet."""
        folder = self._path(f"{self.root}/{place}")
        if not self._files.exists(folder):
            return []
        found = [(status.getPath().getName(), status.getLen()) for status in self._files.listStatus(folder)]
        return sorted(int(name[:-5]) for name, size in found if re.fullmatch(r"\d+\.json", name) and (size or not finished))

    def _entry(self, place: str, number: int) -> dict:
        """An entry's content, once its writer has finished."""
        path = self._path(f"{self.root}/{place}/{number:08d}.json")
        for _ in range(ENTRY_TRIES):
            stream = self._files.open(path)
            try:
                text = bytes(stream.readAllBytes()).decode("utf-8")
            finally:
                stream.close()
            if text:
                return json.loads(text)
            time.sleep(0.05)
        raise DataQualityError(f"Entry {number} of {place} was never finished; remove {path} if no writer is at it.")

    def _create_once(self, path: str, body: bytes) -> bool:
        """Create a file that must not be there yet; False where another writer was faster.

        A distributed file system creates files exclusively itself. Hadoop's local one does not, but a hard link does.
        """
        if self._files.getScheme() == "file":
            target = self._path(path).toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            draft = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
            with open(draft, "xb") as file:
                file.write(body)
            try:
                os.link(draft, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        try:
            stream = self._files.create(self._path(path), False)
            try:
                stream.write(bytearray(body))
            finally:
                stream.close()
            return True
        except Py4JJavaError as error:
            if "Exist" not in error.java_exception.getClass().getName():
                raise
            return False

    def _enter(self, place: str, content: Callable[[int], dict]) -> int:
        """Create the next entry of a folder; if another writer takes the number, try the one after."""
        mark = uuid.uuid4().hex
        while True:
            number = 1 + max(self._entries(place, finished=False), default=0)
            body = json.dumps({**content(number), "writer": mark}, sort_keys=True).encode("utf-8")
            if not self._create_once(f"{self.root}/{place}/{number:08d}.json", body):
                continue
            if self._entry(place, number)["writer"] == mark:
                return number

    # Datasets: numbered versions.

    def dataset_names(self) -> list[str]:
        return [name for name in self._folders(f"{self.root}/datasets") if self.versions(name)]

    def versions(self, name: str) -> list[int]:
        return self._entries(f"datasets/{name}/versions")

    def version(self, name: str) -> int:
        found = self.versions(name)
        if not found:
            raise DataQualityError(f"Table does not exist: {name}")
        return max(found)

    def manifest(self, name: str, version: int | None = None) -> dict:
        """Rows, schema, data folder and publication time of a version."""
        number = self.version(name) if version is None else version
        if number not in self.versions(name):
            raise DataQualityError(f"Table {name} has no version {number}")
        return self._entry(f"datasets/{name}/versions", number)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self.manifest(name, version)
        schema = T.StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.root}/datasets/{name}/data/{found['data']}")

    def as_of(self, moment: datetime, names: Sequence[str] | None = None) -> dict[str, int]:
        """The version of each dataset that was current at a moment (UTC); datasets that did not exist yet are left out."""
        at = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment
        pinned = {}
        for name in self.dataset_names() if names is None else names:
            for number in reversed(self.versions(name)):
                if datetime.fromisoformat(self.manifest(name, number)["published_at"]) <= at:
                    pinned[name] = number
                    break
        return pinned

    def save(self, name: str, frame: DataFrame, *, create: bool = False) -> int:
        """Write a new version; it becomes current when its manifest exists."""
        return self._commit(name, frame, create=create)

    def publish(
        self, name: str, frame: DataFrame, expected_rows: int, *, replace: bool = False,
        cancelled: Callable[[], bool] | None = None,
    ) -> int:
        """Write once, verify what was written, then make exactly that the table; never replace silently."""
        if self.versions(name) and not replace:
            raise SchemaRefused(f"Table {name} is there already; pass replace=True to replace it.")
        return self._commit(name, frame, create=not replace, expected=expected_rows, cancelled=cancelled)

    def _commit(
        self, name: str, frame: DataFrame, *, create: bool, expected: int | None = None, cancelled: Callable[[], bool] | None = None
    ) -> int:
        if not re.fullmatch(IDENTIFIER, name):
            raise SchemaRefused(f"Not a valid table name: {name}")
        if create and self.versions(name):
            raise SchemaRefused(f"Table {name} is there already.")
        folder = uuid.uuid4().hex
        path = f"{self.root}/datasets/{name}/data/{folder}"
        try:
            frame.write.mode("errorifexists").parquet(path)
            written = self.spark.read.schema(frame.schema).parquet(path)
            rows = written.count()  # from the files' footers
            if expected is not None and rows != expected:
                raise DataQualityError(f"{rows} rows were written and {expected} announced; the table stays as it was.")
            if cancelled is not None and cancelled():
                raise DataQualityError("Stopped on request; the table stays as it was.")

            def content(number: int) -> dict:
                if create and number > 1:
                    raise SchemaRefused(f"Table {name} is there already.")
                return {
                    "data": folder, "rows": rows, "schema": json.loads(written.schema.json()),
                    "published_at": datetime.now(timezone.utc).isoformat(),
                }

            return self._enter(f"datasets/{name}/versions", content)
        except Exception:
            self._files.delete(self._path(path), True)
            raise

    # Registers: numbers given out once.

    def reserve(self, register: str, count: int, at_least: int = 0) -> int:
        """The highest number given out before; the ``count`` numbers above it now belong to the caller.

        ``at_least`` is a number known to be in use, such as the highest id of a table that is older than its register.
        """
        before = {}

        def content(number: int) -> dict:
            taken = self._entry(f"registers/{register}", number - 1)["highest"] if number > 1 else 0
            before["highest"] = max(taken, at_least)
            return {"highest": before["highest"] + count}

        self._enter(f"registers/{register}", content)
        return before["highest"]

    def highest(self, register: str) -> int:
        taken = self._entries(f"registers/{register}")
        return self._entry(f"registers/{register}", taken[-1])["highest"] if taken else 0

    def high_water(self, name: str, key: str = "id") -> int:
        """Highest whole-number key any version ever had, so that keys are never used twice.

        The answer is kept with the version it covers: each version is looked at once.
        """
        kept = self.history("high_water", "table_name string, version bigint, highest bigint")
        row = kept.where(f"table_name = '{name}'").selectExpr("max(version)", "max(highest)").first()
        covered, top = row[0] or 0, row[1] or 0
        fresh = [number for number in self.versions(name) if number > covered]
        for number in fresh:
            largest = self.read(name, number).selectExpr(f"max({key})").first()[0]
            top = max(top, largest or 0)
        if fresh:
            line = self.spark.createDataFrame([(name, fresh[-1], top)], "table_name string, version bigint, highest bigint")
            self.append("high_water", line, at=f"{name}-{fresh[-1]}")
        return top

    # Stages: written once, read as often as needed.

    def stage(self, frame: DataFrame) -> str:
        path = f"{self.root}/stages/{uuid.uuid4().hex}"
        try:
            frame.write.mode("errorifexists").parquet(path)
        except Exception:
            self.drop_stage(path)
            raise
        return path

    def read_stage(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def drop_stage(self, path: str) -> None:
        """Remove a stage this store wrote."""
        if path.startswith(f"{self.root}/stages/"):
            self._files.delete(self._path(path), True)

    # History: appended partitions, never rewritten.

    def append_by(self, name: str, frame: DataFrame, by: Sequence[str]) -> None:
        """Add rows under the partitions that columns of their own name; small ones share as few files as their size needs.

        The partitions must be new ones, as those of a fresh run id are. A task keeps a file open for each of its first OPEN_FILES
        partitions, so that its rows need not be sorted by partition in memory; only a task with more of them sorts the rest.
        """
        before = self.spark.conf.get(CONCURRENT_FILES)
        self.spark.conf.set(CONCURRENT_FILES, str(max(int(before), OPEN_FILES)))
        try:
            frame.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(f"{self.root}/history/{name}")
        finally:
            self.spark.conf.set(CONCURRENT_FILES, before)

    def append(self, name: str, frame: DataFrame, **partition: str) -> DataFrame:
        """Add one immutable partition; writing the same partition twice is refused."""
        where = "/".join(f"{key}={partition_text(value)}" for key, value in partition.items())
        path = f"{self.root}/history/{name}/{where}"
        kept = [column for column in frame.columns if column not in partition]
        frame.select(*kept).write.mode("errorifexists").parquet(path)
        return self.spark.read.parquet(path)

    def history(self, name: str, schema: str) -> DataFrame:
        """All partitions of a history table; empty where nothing was stored yet."""
        base = f"{self.root}/history/{name}"
        if not self._folders(base):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(base)
