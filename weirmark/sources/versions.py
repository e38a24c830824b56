"""Tables as immutable folders, and numbered manifests that say which folders are current.

A writer makes new folders first and then commits one manifest by a rename
that fails if the number is taken. So a reader sees one state or the next,
never a half; a writer that is lost leaves folders that no manifest names.
Manifests are small: a name for each folder, none for rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

MANIFESTS = "_manifests"


class Conflict(Exception):
    """Another writer has committed meanwhile."""


class Store:
    """A folder with data folders and manifests."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        found = self._hadoop.Path("/".join((self.path, *names)))
        return found, found.getFileSystem(self._conf)

    def new_folder(self, name: str) -> str:
        """A name, below the table's folder, that nothing has used."""
        return f"{name}-{uuid.uuid4().hex}"

    def _numbers(self) -> list[int]:
        folder, fs = self._at(MANIFESTS)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json") and not x.startswith((".", "_")))

    def current(self) -> tuple[int, dict]:
        """Number and content of the last manifest; 0 and nothing for a new table."""
        numbers = self._numbers()
        return (numbers[-1], self.manifest(numbers[-1])) if numbers else (0, {})

    def manifest(self, number: int) -> dict:
        file, fs = self._at(MANIFESTS, f"{number}.json")
        stream = fs.open(file)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, content: dict) -> int:
        """Makes ``content`` the manifest that follows number ``after``; ``Conflict`` if there is one already."""
        draft, fs = self._at(MANIFESTS, f"_draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        final, _ = self._at(MANIFESTS, f"{after + 1}.json")
        rename = self._hadoop.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, never)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"{self.path} has a version {after + 1}") from error
            raise
        return after + 1

    def forget(self, keep: int = 2) -> None:
        """Deletes all manifests but the last ``keep``, and the folders that these don't name: old states, and what lost writers left.

        Not while a writer is at work, whose folders no manifest names yet.
        """
        numbers = self._numbers()
        for number in numbers[:-keep]:
            file, fs = self._at(MANIFESTS, f"{number}.json")
            fs.delete(file, False)
        named = json.dumps([self.manifest(n) for n in numbers[-keep:]])
        folder, fs = self._at()
        for x in fs.listStatus(folder):
            name = x.getPath().getName()
            if name != MANIFESTS and f'"{name}"' not in named and f'"{name}/' not in named:
                fs.delete(x.getPath(), True)
