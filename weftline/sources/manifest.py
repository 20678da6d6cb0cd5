"""Numbered manifests: which folders of files make up a table, changed in one step.

A table's files are written first, under names of their own. A manifest, a small JSON file that lists the folders that count, then
takes the next number: it is written aside and renamed, and the rename fails if somebody else has taken that number, who
is then followed by trying again on what he has made of the table. Readers take the highest number and see one state of the table,
whatever is written meanwhile. The file system must refuse to rename onto an existing file in one step, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Manifests:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._place("x").getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        fs, folder = self._fs(), self._place("manifest")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self, number: int | None = None) -> tuple[int, dict]:
        """(number, content) of a manifest, by default the last; (-1, {}) if there is none."""
        if number is None:
            number = max(self.numbers(), default=-1)
        if number < 0:
            return -1, {}
        stream = self._fs().open(self._place(f"manifest/{number:020}.json"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _try(self, number: int, content: dict) -> bool:
        """Whether the content has become the manifest of that number."""
        fs = self._fs()
        aside, place = self._place(f"manifest/.{uuid.uuid4().hex}"), self._place(f"manifest/{number:020}.json")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(place), none)
            return True
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def change(self, edit: Callable[[dict], dict | None]) -> int:
        """Makes `edit` of the last content the next manifest, trying again when others come first; its number. None from `edit`: nothing changes."""
        while True:
            number, content = self.load()
            new = edit(json.loads(json.dumps(content)))
            if new is None:
                return number
            if self._try(number + 1, new):
                return number + 1

    def folders(self, *names: str) -> list[str]:
        """Names of the folders under those of the table's parts."""
        fs, found = self._fs(), []
        for name in names:
            if fs.exists(self._place(name)):
                found += [f"{name}/{f.getPath().getName()}" for f in fs.listStatus(self._place(name))]
        return found

    def remove(self, names: list[str]) -> None:
        fs = self._fs()
        for name in names:
            fs.delete(self._place(name), True)
