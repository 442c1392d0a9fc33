"""Small tables of records that several writers append to: a file of JSON lines per append, merged from time to time.

A record appears with the rename of its file, so readers never see half of one and writers do not wait for each
other.  Once ``FILES`` files have gathered they are merged into one; those it replaces stay for ``GRACE_SECONDS``
for readers that have listed them, and every record has an identity of its own, by which it counts once meanwhile.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES, GRACE_SECONDS = 64, 600
_ID = "record_id"


class Taken(RuntimeError):
    """Another writer was first."""


class Records:
    """The table below ``path``; ``schema`` is that of its records."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _hadoop(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, name: str, text: str) -> None:
        hidden, files = self._hadoop(f".{name}-{uuid.uuid4().hex}")
        out = files.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not files.rename(hidden, self._hadoop(name)[0]):
            raise OSError(f"{self.path}/{name} could not be put in place")

    def _listed(self) -> dict[str, int]:
        """Names of the visible files and when they were written, in milliseconds."""
        path, files = self._hadoop()
        if not files.exists(path):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in files.listStatus(path) if not s.getPath().getName().startswith(".")}

    def append(self, rows: list[tuple]) -> None:
        if rows:
            told = self.spark.createDataFrame(rows, self.schema).withColumn(_ID, F.expr("uuid()"))
            self._put(f"{uuid.uuid4().hex}.json", "".join(r[0] + "\n" for r in told.select(F.to_json(F.struct("*"))).collect()))
            self.merge()

    def read(self) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        if not any(n.endswith(".json") for n in self._listed()):
            return empty
        told = self.spark.read.schema(f"{self.schema}, {_ID} string").json(f"{self.path}/*.json")
        return told.dropDuplicates([_ID]).drop(_ID)

    def stream(self) -> DataFrame:
        """Records as they arrive; one may come twice, from its own file and a merged one."""
        path, files = self._hadoop()
        files.mkdirs(path)
        return self.spark.readStream.schema(f"{self.schema}, {_ID} string").option("pathGlobFilter", "*.json").json(self.path).drop(_ID)

    def merge(self) -> None:
        """Merge the files if there are many, and remove those that were replaced long enough ago."""
        listed = self._listed()
        replaced: set[str] = set()
        for note in [n for n in listed if n.endswith(".replaced")]:
            names = self._text(note).split()
            replaced.update(names)
            if listed[note] + GRACE_SECONDS * 1000 <= time.time() * 1000:
                for name in [*names, note]:
                    path, files = self._hadoop(name)
                    files.delete(path, False)
        kept = [n for n in listed if n.endswith(".json") and n not in replaced]
        if len(kept) < FILES:
            return
        try:
            told = self.spark.read.text([f"{self.path}/{n}" for n in kept]).dropDuplicates(["value"])
            lines = [r.value for r in told.collect()]  # records of a catalogue, not of its tables
        except AnalysisException:  # another writer merged them
            return
        name = uuid.uuid4().hex
        self._put(f"{name}.json", "".join(f"{line}\n" for line in lines))
        self._put(f"{name}.replaced", "\n".join(kept))

    def _text(self, name: str) -> str:
        path, files = self._hadoop(name)
        try:
            size = files.getFileStatus(path).getLen()
            stream = files.open(path)
        except Exception:  # removed by another writer meanwhile
            return ""
        try:
            return bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode() if size else ""
        finally:
            stream.close()

    def claim(self, name: str) -> None:
        """Create the marker ``name`` beside the records; :class:`Taken` if it is there.  Only one of several writers succeeds."""
        path, files = self._hadoop(f"_claims/{name}")
        try:
            files.create(path, False).close()
        except Exception as failure:
            if files.exists(path):
                raise Taken(name) from failure
            raise

    def release(self, name: str) -> None:
        path, files = self._hadoop(f"_claims/{name}")
        files.delete(path, False)
