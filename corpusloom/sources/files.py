"""Files and archives as frames of cards, one task per file, nothing on the driver."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from .documents import CARD_DDL, FIELDS, cards_of_file

ENDINGS = (".docx", ".doc", ".pdf", ".txt")
_FILE_DDL = f"path string, sha256 string, status string, error string, {CARD_DDL}"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content and sha256 of files; of equal contents the first path counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    return files.join(files.groupBy("sha256").agg(F.min("path").alias("path")), ["sha256", "path"], "left_semi")


def store(files: DataFrame, path: str) -> None:
    """Keep contents by their hash, in folders by its first two digits; what is there stays."""
    prefix = F.substring("sha256", 1, 2).alias("prefix")
    try:
        held = files.sparkSession.read.parquet(path).select("sha256")
        files = files.join(held, "sha256", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    files.select("sha256", "path", "content", prefix).write.mode("append").partitionBy("prefix").parquet(path)


def unzip(files: DataFrame) -> DataFrame:
    """Entries of zip archives that a reader may know; an entry that cannot be read comes
    out with null content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for entry in archive.infolist():
                            if not entry.is_dir() and entry.filename.lower().endswith(ENDINGS):
                                try:
                                    rows.append((f"{path}!{entry.filename}", archive.read(entry)))
                                except Exception:  # noqa: BLE001
                                    rows.append((f"{path}!{entry.filename}", None))
                except zipfile.BadZipFile:
                    rows.append((path, None))
                yield pd.DataFrame(rows, columns=["path", "content"])

    entries = files.select("path", "content").mapInPandas(run, "path string, content binary")
    return entries.select("path", "content", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("sha256"))


def parse_files(files: DataFrame, fidelity: str | None = None) -> DataFrame:
    """One row per card, and one without card fields per file that has none or failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, sha in zip(batch["path"], batch["content"], batch["sha256"], strict=True):
                status, error, cards = ("failed", "unreadable entry", []) if content is None else cards_of_file(path, content, fidelity)
                rows = [[path, sha, status, error, *(c[f] for f in FIELDS)] for c in cards] or [[path, sha, status, error, *([None] * len(FIELDS))]]
                yield pd.DataFrame(rows, columns=["path", "sha256", "status", "error", *FIELDS])

    return files.select("path", "content", "sha256").mapInPandas(run, _FILE_DDL)


@udtf(returnType=f"status string, error string, {CARD_DDL}")
class ParseCardFile:
    """parse_card_file(path, content) for SQL: rows as of ``parse_files``. Register with
    ``spark.udtf.register("parse_card_file", ParseCardFile)``."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        status, error, cards = cards_of_file(path, content)
        for card in cards or [dict.fromkeys(FIELDS)]:
            yield (status, error, *(card[f] for f in FIELDS))


def provenance(path: Column) -> tuple[Column, Column]:
    """(school, team) from the folders of an entry; a flat archive tells nothing."""
    inner = F.element_at(F.split(path, "!"), -1)
    parts = F.filter(F.split(inner, "/"), lambda p: ~p.isin("", ".", ".."))
    n = F.size(parts)
    school = F.when(n >= 3, F.try_element_at(parts, F.lit(-3))).when(n == 2, F.try_element_at(parts, F.lit(1)))
    return school, F.when(n >= 3, F.try_element_at(parts, F.lit(-2)))


def choose_archive(names: DataFrame) -> DataFrame:
    """The newest full archive of a listing (name), else the newest of any kind."""
    day = F.regexp_replace(F.regexp_extract("name", r"(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    full = F.col("name").rlike(r"(?i)-all-\d{4}-?\d{2}-?\d{2}")
    return names.orderBy(full.desc(), day.desc(), "name").limit(1)


def cites_only(rows: DataFrame) -> DataFrame:
    """Citations delivered without a document (round_id, cite_id, title, cites): one card
    each, numbered by their id or, without one, below zero by their place."""
    return rows.select(
        "round_id", F.col("title").alias("tag"), F.col("cites").alias("body_text"), (F.coalesce(F.length("cites"), F.lit(0)) == 0).alias("is_analytic"),
        F.lit("cites_only").alias("fidelity"), F.coalesce(F.col("cite_id"), -(F.col("place") + 1)).alias("ordinal"),
        F.sha2(F.concat(F.lit("cites:round:"), F.col("round_id").cast("string")), 256).alias("document_id"),
    )
