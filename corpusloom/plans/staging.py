"""Cutting lineage through written tables.

Iterative operators and results that several plans read are written as parquet under
the folder that the session names in ``spark.checkpoint.dir``: every executor reaches
it, so a lost executor costs a re-read and never a failed job.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a private folder in a local
    session. On a cluster every executor would write to its own disk there, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor reaches")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return _roots[app]


class Folder:
    """A folder that lasts, with a manifest that says what in it counts.

    Writers write under names of their own first and switch the manifest last, so a reader
    or a run after a failure sees all of a change or nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def load(self) -> dict:
        # a switch that was cut short has left the complete new manifest beside
        for name in ("manifest.json", "manifest.new"):
            at = self._hadoop(self.path(name))
            if self._fs.exists(at):
                stream = self._fs.open(at)
                try:
                    return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return {}

    def switch(self, manifest: dict) -> None:
        fresh, now = self._hadoop(self.path("manifest.new")), self._hadoop(self.path("manifest.json"))
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        self._fs.delete(now, False)
        self._fs.rename(fresh, now)

    def drop(self, name: str) -> None:
        self._fs.delete(self._hadoop(self.path(name)), True)

    def stamp(self, path: str) -> str:
        """What tells whether a file has changed: its length and time of change."""
        at = self._hadoop(path)
        status = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        return f"{status.getLen()}-{status.getModificationTime()}"


class Stage:
    """A folder of staged tables of one operator call.

    ``write`` stores a frame and returns it as a scan of the stored files, so later plans
    prune columns and Spark knows the sizes. ``drop`` removes one table that no later
    plan reads. What is left goes at the end of the process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
        self._gone = False
        atexit.register(self.clear)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, **options) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        self._delete(self.path(table))

    def clear(self) -> None:
        if not self._gone:
            self._gone = True
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            pass
