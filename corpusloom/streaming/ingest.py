"""Incremental ingest: records arrive as a stream or as files, cards and variants are kept up to date.

The corpus is a log in a folder that lasts: every batch is mapped and written as a folder of
its own, and a manifest, switched last, says which of them count. A batch that is delivered
again replaces itself, none costs more than its own rows, and a run after a failure goes on
where the last one ended. What is current (the latest version of each external id, and the
cards and variants that follow) is a view over the log; ``compact`` folds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ingest as I
from ..plans.staging import Folder


class CorpusSink:
    """Records of all batches so far, with the tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    def manifest(self) -> dict:
        """parts (name of a batch -> folder), files (path -> stamp), failed (path -> reason)."""
        return {"parts": {}, "files": {}, "failed": {}, **self.folder.load()}

    def merge(self, records: DataFrame, batch: str | int, **changes: dict) -> None:
        """Take in a batch; ``changes`` go into the manifest with it."""
        part = f"log/{uuid.uuid4().hex}"
        I.map_records(records).write.parquet(self.folder.path(part))
        manifest = self.manifest()
        before = manifest["parts"].get(str(batch))
        manifest["parts"][str(batch)] = part
        for name, values in changes.items():
            manifest[name].update(values)
        self.folder.switch(manifest)
        if before:
            self.folder.drop(before)

    def compact(self) -> None:
        """Fold the log into one folder of current rows; the old folders go once the manifest names the new one."""
        manifest = self.manifest()
        old = manifest["parts"]
        if not old:
            return
        part = f"log/{uuid.uuid4().hex}"
        self.rows().write.parquet(self.folder.path(part))
        self.folder.switch({**manifest, "parts": {f"folded-{part[4:]}": part}})
        for name in old.values():
            self.folder.drop(name)

    def rows(self) -> DataFrame:
        """Current rows: each record once, of each external id the latest version."""
        parts = sorted(self.manifest()["parts"].values())
        if not parts:
            raise FileNotFoundError(f"nothing was taken into {self.folder.root} yet")
        log = self.spark.read.parquet(*map(self.folder.path, parts))
        return I.latest_versions(log.dropDuplicates(["record_id"]), I.external_number(F.col("external_id")))

    def read(self, table: str) -> DataFrame:
        """rows, cards or variants as they stand."""
        rows = self.rows()
        return {"rows": lambda: rows, "cards": lambda: I.canonical_cards(rows), "variants": lambda: I.attach_variants(rows)}[table]()

    def ingest_files(self, files: Sequence[str], schema) -> dict[str, int]:
        """Take in record files, each a batch of its own that counts once it is written; the
        number of files done, skipped (seen before and not changed since) and failed. A file
        that cannot be read is noted with its reason, is tried again by the next run and
        stops no other."""
        out = {"done": 0, "skipped": 0, "failed": 0}
        for path in sorted(files):  # a list of files, not of rows
            try:
                stamp = self.folder.stamp(path)
                if self.manifest()["files"].get(path) == stamp:
                    out["skipped"] += 1
                    continue
                self.merge(self.spark.read.schema(schema).parquet(path), f"file {path}", files={path: stamp}, failed={path: ""})
                out["done"] += 1
            except Exception as e:  # whatever is wrong with one file
                manifest = self.manifest()
                manifest["failed"][path] = str(e).splitlines()[0]
                self.folder.switch(manifest)
                out["failed"] += 1
        return out


def ingest_stream(spark: SparkSession, source: str, schema, folder: str, files_per_batch: int = 1) -> CorpusSink:
    """Run a stream of record files (a path or pattern) into the corpus at ``folder`` to its
    present end. The checkpoint lies in the folder too, so called again, by whatever
    process, it goes on with the files that have come since."""
    sink = CorpusSink(spark, folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (
        stream.writeStream.foreachBatch(lambda df, n: sink.merge(df, f"stream {n}"))
        .option("checkpointLocation", sink.folder.path("checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sink
