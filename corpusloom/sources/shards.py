"""Parquet shards of the bulk data: pruned by a census, filtered at the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Columns of a bulk row; all but the id are text.
BULK_COLUMNS = (
    "id tag cite fullcite summary spoken fulltext textLength markup pocket hat block bucketId duplicateCount filePath roundId side round "
    "report opensourcePath caselistUpdatedAt teamId schoolId chapterId caselistId caselistName caselistDisplayName year event level teamSize"
).split()
BULK_SCHEMA = ", ".join(f"{c} {'bigint' if c == 'id' else 'string'}" for c in BULK_COLUMNS)


def scan(spark: SparkSession, paths: Iterable[str], events: Iterable[str] = ("pf",), min_duplicates: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of the wanted events; a floor on duplicates holds for all events but pf. The
    event filter reaches the parquet reader. ``limit`` is for a first look at the data and
    counts rows before the filter."""
    rows = spark.read.schema(BULK_SCHEMA).parquet(*paths)
    return keep(rows if limit is None else rows.limit(limit), events, min_duplicates)


def sample(spark: SparkSession, paths: Iterable[str], events: Iterable[str], share: float, seed: int = 1) -> DataFrame:
    """A share of the rows of the wanted events, for development."""
    return scan(spark, paths, events).sample(share, seed)


def keep(rows: DataFrame, events: Iterable[str], min_duplicates: int = 0) -> DataFrame:
    rows = rows.where(F.col("event").isin(*events))
    return rows.where((F.col("event") == "pf") | (F.col("duplicateCount").try_cast("int") >= min_duplicates)) if min_duplicates else rows


def census(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Rows per shard, event and list; two columns are read."""
    rows = spark.read.schema("event string, caselistName string").parquet(*paths)
    return rows.groupBy(F.input_file_name().alias("shard"), "event", "caselistName").agg(F.count(F.lit(1)).alias("n"))


def shards_of(counted: DataFrame, events: Iterable[str]) -> list[str]:
    """Shards that hold the events, by the census. An empty census is an error, not a guess."""
    if counted.isEmpty():
        raise ValueError("the census is empty")
    return [r[0] for r in counted.where(F.col("event").isin(*events)).select("shard").distinct().orderBy("shard").collect()]


def lookup(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with the given ids, by semi join: Spark decides by size how."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def is_pf(event: Column, slug: Column, name: Column, known: Iterable[str] = ("pf", "publicforum", "public forum")) -> Column:
    """By the event where one is given, else by a slug or name that holds pf as the end of a word."""
    given = F.lower(F.trim(F.coalesce(event, F.lit(""))))
    named = F.lower(F.concat_ws(" ", F.coalesce(slug, F.lit("")), F.coalesce(name, F.lit("")))).rlike("pf(?=[^a-z]|$)")
    return F.when(given != "", given.isin(*known)).otherwise(named)


def since(rows: DataFrame, text: str | None, column: str = "year") -> DataFrame:
    """Rows from a year on; rows without a year stay."""
    import re

    m = re.search(r"\d{4}", text or "")
    return rows.where(F.col(column).isNull() | (F.col(column).try_cast("int") >= int(m.group()))) if m else rows
