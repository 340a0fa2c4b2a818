"""A collection with versions: changes are written beside what is there, and a version is a list of the folders it reads.

Each change writes its rows, or the keys it deletes, into a folder of its own and then a manifest, commits/version=N, that names
the folders in order. Readers take a manifest, so a change is seen whole or not at all; a writer that dies leaves no trace that is
read, and of two writers of one version the second fails. Of a key's rows the one of the latest folder counts. Keys are not null
and stand once in a change.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a version from which on a change compacts them.
MOST_FOLDERS = 8


@dataclass(frozen=True)
class Version:
    number: int
    folders: tuple[str, ...]
    #: Of each folder whether it holds keys that are deleted.
    deletes: tuple[bool, ...]
    action: str


class Collection:
    """The rows of a schema by key, at the last version or at another one."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, version: Version):
        self.spark, self.path, self.key, self.schema, self.version = spark, path, key, schema, version

    @staticmethod
    def create(spark: SparkSession, path: str, key: str, schema: str) -> Collection:
        """A new collection without rows, as version 0; fails if there is one."""
        return Collection(spark, path, key, schema, Version(-1, (), (), ""))._commit((), (), "create")

    @staticmethod
    def open(spark: SparkSession, path: str, number: int | None = None) -> Collection:
        """The collection at a version, by default the last."""
        found = spark.read.parquet(f"{path}/commits")
        row = (found if number is None else found.filter(F.col("version") == number)).orderBy(F.desc("version")).first()
        if row is None:
            raise ValueError(f"no version {number}")
        return Collection(spark, path, row["key"], row["schema"], Version(row["version"], tuple(row["folders"]), tuple(row["deletes"]), row["action"]))

    def _commit(self, folders: Sequence[str], deletes: Sequence[bool], action: str) -> Collection:
        new = Version(self.version.number + 1, tuple(folders), tuple(deletes), action)
        row = [(list(folders), list(deletes), action, self.key, self.schema)]
        self.spark.createDataFrame(row, "folders array<string>, deletes array<boolean>, action string, key string, schema string").coalesce(1).write.parquet(f"{self.path}/commits/version={new.number}")
        return Collection(self.spark, self.path, self.key, self.schema, new)

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _folder(self, i: int) -> DataFrame:
        kind = self.schema if not self.version.deletes[i] else self.empty().select(self.key).schema
        return self.spark.read.schema(kind).parquet(f"{self.path}/data/{self.version.folders[i]}")

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The rows of the version. Each folder's rows lose the keys of later folders, of which only the key column is read."""
        parts = []
        for i, deletes in enumerate(self.version.deletes):
            if deletes:
                continue
            later = [self._folder(j).select(self.key) for j in range(i + 1, len(self.version.folders))]
            own = self._folder(i)
            parts.append(own.join(functools.reduce(DataFrame.unionByName, later), self.key, "left_anti").select(own.columns) if later else own)
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.empty()

    def upsert(self, rows: DataFrame) -> Collection:
        """Adds rows, in place of those of the same keys."""
        return self._add(self._write(rows.select(self.empty().columns)), False, "upsert")

    def delete(self, keys: DataFrame) -> Collection:
        return self._add(self._write(keys.select(self.key).distinct()), True, "delete")

    def _add(self, folder: str, deletes: bool, action: str) -> Collection:
        new = self._commit((*self.version.folders, folder), (*self.version.deletes, deletes), action)
        return new.compact() if len(new.version.folders) > MOST_FOLDERS else new

    def clear(self) -> Collection:
        """No rows; older versions keep theirs."""
        return self._commit((), (), "clear")

    def compact(self) -> Collection:
        """The same rows in one folder."""
        return self._commit((self._write(self.rows()),), (False,), "compact")

    def restore(self, number: int) -> Collection:
        """A new version with the rows of an older one; nothing is copied."""
        old = Collection.open(self.spark, self.path, number).version
        return self._commit(old.folders, old.deletes, f"restore {number}")

    def history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/commits").select("version", "action", F.size("folders").alias("n_folders"))
