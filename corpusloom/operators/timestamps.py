"""Mixed timestamp formats and zones, normalised through a dictionary of distinct strings.

Written dates repeat: the distinct (string, zone, order) triples grow far slower than the
rows. They are counted with map-side combining, parsed once each in Arrow batches, kept in
a table that later runs extend, and joined back. The few strings that a large share of
the rows carries (at most ``1 / HOT_SHARE`` of them, by arithmetic) are joined by
broadcast, so no join task gets a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dateparse import parse_written
from ..plans.staging import Stage

HOT_SHARE = 1 / 500
KEY = ("raw", "zone", "day_first")
_PARSED = "raw string, zone string, day_first boolean, n bigint, utc string, grain string"

# How citations mark the day on which a page was read.
ACCESS_MARKS = r"(?:doa|date of access|access date|accessed|last accessed|retrieved|last visited)"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
NO_DATE = r"(?:no date|n\.\s?d\.?|undated)"
# What parts the places of a citation. Only a place that a year fills is a date;
# any other number of four digits may be said in a title.
_NAME = r"[^\s,;:–—|]{1,40}"
_LEAD = rf"^\s{{0,9}}{_NAME}(?: (?:and|&) {_NAME}| et al\.?)? "  # Name 2016, a short citation
_BEFORE, _AFTER = r"(?<=(?:^|[,;.:(\[–—|])\s{0,9})", r"(?=\s*(?:[,;.:)\]–—|]|$))"
CITE_DATE = (
    r"(?<![\w/.-])("
    r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?"
    r"|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2})"
    rf"|\d{{1,2}}(?:st|nd|rd|th)?[ -](?:of )?{_MONTH}[ -],? ?\d{{4}}"
    rf"|{_MONTH} \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}"
    rf"|{_MONTH},? \d{{4}}"
    rf"|\d{{4}}[-/]\d{{1,2}}|\d{{1,2}}/\d{{4}}|(?:{_BEFORE}|(?<={_LEAD}))\d{{4}}{_AFTER}"
    r")(?![\w/-]|\.\d)"
)


def cite_date(cite: Column) -> Column:
    """The publication date as written in a full citation: addresses, quoted titles, the
    date of access and what follows a statement that there is no date are cut away first.
    A year alone counts only where it fills a place between separators. Null if there is none."""
    text = F.regexp_replace(cite, r"(?i)https?://\S+", " ")
    text = F.regexp_replace(text, r"“[^”]*”|\"[^\"]*\"|(?<=[;,] )'[^;]*'(?=;)", " ")
    text = F.regexp_replace(text, rf"(?is)\b{ACCESS_MARKS}\b.*$|{_BEFORE}{NO_DATE}{_AFTER}.*$", " ")
    return F.nullif(F.regexp_extract(text, "(?i)" + CITE_DATE, 1), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host of an address without ``www.``, a port or user; null if it has none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.nullif(F.regexp_replace(authority, r"^(?:[^@]*@)?(?:www\.)?|:\d*$", ""), F.lit(""))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        found = [parse_written(*key) for key in zip(*(rows[c] for c in KEY), strict=True)]
        rows["utc"] = [f and f[0] for f in found]
        rows["grain"] = [f and f[1] for f in found]
        schema = pa.schema([(c, pa.bool_() if c == "day_first" else pa.int64() if c == "n" else pa.string()) for c in rows])
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


class TimestampDictionary:
    """Distinct written times with their parse, in a parquet folder that only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_PARSED).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def update(self, rows: DataFrame, stage: Stage) -> DataFrame:
        """Add what ``rows`` (raw, zone, day_first) has and the dictionary has not. Returns
        the strings of these rows with their parse and how many of these rows carry each:
        they are counted anew on every call, since a string is hot by the rows at hand, not
        by those that first brought it. Null strings are left out."""
        counted = rows.where(F.col("raw").isNotNull()).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        known = self.read()
        if known is None:
            counted.mapInArrow(_parse, _PARSED).write.mode("append").parquet(self.path)
            return self.read()
        counted = stage.write(counted, "strings")
        same = [counted[c].eqNullSafe(known[c]) for c in KEY]
        fresh = counted.join(known, same[0] & same[1] & same[2], "left_anti")
        fresh.mapInArrow(_parse, _PARSED).write.mode("append").parquet(self.path)
        known = self.read().drop("n")
        same = [counted[c].eqNullSafe(known[c]) for c in KEY]
        return stage.write(counted.join(known, same[0] & same[1] & same[2]).select(*(counted[c] for c in KEY), "n", "utc", "grain"), "parsed")

    @staticmethod
    def attach(rows: DataFrame, parsed: DataFrame, id_col: str, total: int) -> DataFrame:
        """``rows`` (with the key columns) plus utc and grain, null where unreadable, from
        the strings that ``update`` returned; ``total`` rows carry one."""
        parsed = parsed.groupBy(*KEY).agg(F.sum("n").alias("n"), F.first("utc").alias("utc"), F.first("grain").alias("grain"))
        tag = F.concat_ws("\x01", "raw", F.coalesce("zone", F.lit("")), F.coalesce(F.col("day_first").cast("string"), F.lit("")))
        parsed = parsed.select(tag.alias("_k"), "n", "utc", "grain")
        limit = max(total * HOT_SHARE, 1000)
        hot = parsed.where(F.col("n") > limit).select("_k", F.struct("utc", "grain").alias("_hot"))
        cold = parsed.where(F.col("n") <= limit).select("_k", "utc", "grain")
        out = rows.withColumn("_k", F.when(F.col("raw").isNotNull(), tag)).join(F.broadcast(hot), "_k", "left")
        # rows that need no look-up get keys of their own, spread over all partitions
        spread = F.concat(F.lit("\x02"), (F.xxhash64(id_col) % 100_000).cast("string"))
        out = out.withColumn("_k", F.when(F.col("_hot").isNull() & F.col("_k").isNotNull(), F.col("_k")).otherwise(spread))
        out = out.join(cold, "_k", "left")
        return out.withColumns({c: F.coalesce(F.col(f"_hot.{c}"), F.col(c)) for c in ("utc", "grain")}).drop("_k", "_hot")


def publication_times(cards: DataFrame, outlets: DataFrame, stage: Stage | None = None, dictionary: str | None = None) -> DataFrame:
    """(id, pub_utc, grain) of every card that tells its publication time.

    ``cards`` has id, source_pub_date, fullcite and source_url; ``outlets`` (domain, tz,
    day_first) is a bounded list of publishers. A readable source_pub_date wins over the
    citation. Nulls, blanks, dates that do not exist and placeholders tell nothing; an
    empty table gives an empty result; columns besides those named are ignored; repeated
    rows come out as often as they came in. ``dictionary`` names a folder to keep between
    runs; without it one is made for this call.
    """
    stage = stage or Stage(cards.sparkSession, "timestamps")
    lists = outlets.where(F.col("domain").isNotNull()).groupBy(F.lower("domain").alias("_domain")).agg(
        F.min_by(F.struct("tz", "day_first"), "tz").alias("_o")
    )
    rows = cards.select(
        F.col("id"),
        F.nullif(F.trim(F.regexp_replace("source_pub_date", r"[\s ]+", " ")), F.lit("")).alias("raw"),
        cite_date(F.col("fullcite")).alias("cited"),
        host(F.col("source_url")).alias("_domain"),
    )
    rows = rows.join(lists, "_domain", "left").select(
        "id", "raw", "cited", F.col("_o.tz").alias("zone"), F.coalesce("_o.day_first", F.lit(False)).alias("day_first")
    )
    rows = stage.write(rows, "rows")
    words = TimestampDictionary(cards.sparkSession, dictionary or stage.path("dictionary"))
    both = rows.select(F.explode(F.array("raw", "cited")).alias("raw"), "zone", "day_first")
    parsed = words.update(both, stage)
    total = parsed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = words.attach(rows, parsed, "id", total)
    later = first.select(
        "id", F.col("utc").alias("pub"), F.col("grain").alias("pub_grain"),
        F.when(F.col("utc").isNull(), F.col("cited")).alias("raw"), "zone", "day_first",
    )
    out = words.attach(later, parsed, "id", total)
    return out.select("id", F.coalesce("pub", "utc").alias("pub_utc"), F.coalesce("pub_grain", "grain").alias("grain")).where(
        F.col("pub_utc").isNotNull()
    )
