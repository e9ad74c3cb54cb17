"""A corpus as it is published: denormalised, capped by size, checked after writing."""

from __future__ import annotations

import uuid
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.staging import Folder, Stage
from .ingest import number_rows, ranged


def published_cards(cards: DataFrame, variants: DataFrame, events: DataFrame, card_topics: DataFrame) -> DataFrame:
    """One row per card with what its representative variant shows folded in."""
    order = F.struct(F.coalesce("highlight_ratio", F.lit(-1.0)).alias("h"), (-F.col("record_id")).alias("i"))
    shown = variants.groupBy("card_id").agg(F.max_by(F.struct("pocket", "hat", "block", "markup_html", "spoken", "fidelity"), order).alias("_v"))
    out = cards.join(shown, "card_id", "left").join(events, "card_id", "left").join(card_topics, "card_id", "left")
    return out.select(*(c for c in cards.columns), "_v.*", "events", F.to_json("topic_codes").alias("topic_codes"))


def row_bytes(*columns: str) -> Column:
    """Size of a row's text in UTF-8."""
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total


def value_order() -> list[Column]:
    return [F.desc("team_count"), F.desc("body_len"), F.asc("card_id")]


def capped(cards: DataFrame, cap: int, size: Column, drop_analytics: bool = True, stage: Stage | None = None) -> DataFrame:
    """The most valuable cards that fit into ``cap`` bytes: all if they fit, else evidence
    only, and of that the longest prefix in order of value.

    Cards are written in range partitions of that order; by the sums of the partitions
    each is kept or dropped whole but the one in which the cap is reached, and only in that
    one sizes are added up row by row. A null is_analytic counts as evidence, a null size as 0."""
    stage = stage or Stage(cards.sparkSession, "capped")
    analytic = F.coalesce("is_analytic", F.lit(False))
    rows = cards.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0)))
    total, evidence = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.sum(F.when(~analytic, F.col("_size"))), F.lit(0))).first()
    if total <= cap:
        return rows.drop("_size")
    if drop_analytics:
        rows = rows.where(~analytic)
        if evidence <= cap:
            return rows.drop("_size")
    placed = ranged(rows, value_order(), stage)
    used, edge = 0, -1
    sums = sorted((r["_p"], r["s"]) for r in placed.groupBy("_p").agg(F.sum("_size").alias("s")).collect())  # one row per partition
    for edge, s in sums:  # noqa: B007
        if used + s > cap:
            break
        used += s
    whole = placed.where(F.col("_p") < edge).drop("_size", "_p", "_i")
    run = F.sum("_size").over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    cut = placed.where(F.col("_p") == edge).withColumn("_run", run).where(F.col("_run") <= cap - used)
    return whole.unionByName(cut.drop("_size", "_p", "_i", "_run"))


def write_published(cards: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Sorted by id in files of bounded length."""
    cards.repartitionByRange("card_id").sortWithinPartitions("card_id").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_generation(cards: DataFrame, path: str, rows_per_file: int = 500_000, keep: int = 2) -> str:
    """Publish under a name made of the content, so that readers may cache what they fetched,
    then let the manifest name it; the ``keep`` latest generations stay for readers of the
    one before. What is written is counted again before it counts. Returns the name."""
    folder = Folder(cards.sparkSession, path)
    fresh = f"generation-{uuid.uuid4().hex}"
    write_published(cards, folder.path(fresh), rows_per_file)
    total = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    n, content = total(cards.sparkSession.read.schema(cards.schema).parquet(folder.path(fresh)))
    if (n, content) != tuple(total(cards)):
        folder.drop(fresh)
        raise RuntimeError("what was written is not what was to be published")
    now = [g for g in folder.load().get("generations", []) if g["content"] != f"{n}-{content}"]
    now.append({"folder": fresh, "content": f"{n}-{content}"})
    old = folder.load().get("generations", [])
    folder.switch({"generations": now[-keep:]})
    for g in old:
        if g not in now[-keep:]:
            folder.drop(g["folder"])
    return now[-1]["content"]


def read_generation(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The latest generation, or the one ``back`` before it."""
    folder = Folder(spark, path)
    return spark.read.parquet(folder.path(folder.load()["generations"][-1 - back]["folder"]))


def verify_published(cards: DataFrame, index_rows: int, found: int) -> list[str]:
    """What is wrong with a published corpus: row counts that differ, a probe not found."""
    n = cards.count()
    return [m for bad, m in ((n != index_rows, f"{n} cards but {index_rows} indexed"), (n > 0 and not found, "the probe word was not found")) if bad]


def disagreements(pairs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Where the given buckets and our merges differ: (kind, card_a, card_b, bucket).

    ``pairs`` has a, b (a < b) merged by us, ``buckets`` card_id and bucket_id before any
    merge. A pair that shares a bucket and was not merged comes out once, with its smallest
    bucket; a bucket is compared with its smallest card, so a large one gives rows in
    proportion, not pairs. A merged pair of cards in different buckets only comes out too."""
    b = buckets.where("bucket_id is not null").distinct()
    head = b.groupBy("bucket_id").agg(F.min("card_id").alias("a"))
    same = b.join(head, "bucket_id").where("card_id <> a").groupBy("a", F.col("card_id").alias("b")).agg(F.min("bucket_id").alias("bucket"))
    apart = same.join(pairs.select("a", "b"), ["a", "b"], "left_anti").select(F.lit("same_bucket_not_merged").alias("kind"), "a", "b", "bucket")
    lists = b.groupBy("card_id").agg(F.array_sort(F.collect_set("bucket_id")).alias("l"))
    both = pairs.join(lists.select(F.col("card_id").alias("a"), F.col("l").alias("la")), "a").join(lists.select(F.col("card_id").alias("b"), F.col("l").alias("lb")), "b")
    split = both.where(~F.arrays_overlap("la", "lb")).select(F.lit("merged_across_buckets").alias("kind"), "a", "b", F.col("la")[0].alias("bucket"))
    return apart.unionByName(split)


def numbered(cards: DataFrame, name: str = "place") -> DataFrame:
    """Cards with their place in the published order."""
    return number_rows(cards, ["card_id"], name)


def site_stats(cards: DataFrame, disclosures: DataFrame) -> str:
    """Counts of a published corpus as JSON, one row's worth."""
    c = cards.agg(F.count_if(~F.col("is_analytic")).alias("cards"), F.count_if("is_analytic").alias("analytics"))
    d = disclosures.agg(F.countDistinct("team_id").alias("teams"), F.countDistinct("school_id").alias("schools"), F.array_sort(F.collect_set("season")).alias("seasons"))
    return c.crossJoin(d).select(F.to_json(F.struct("*"))).first()[0]


def write_report(rows: DataFrame, path: str) -> None:
    """Tab-separated, with a header."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def feed(cards: DataFrame, disclosures: DataFrame, title: str, link: str, n: int = 50) -> str:
    """RSS of the ``n`` cards read last."""
    latest = disclosures.groupBy("card_id").agg(F.max("round_date").alias("latest"))
    top = latest.orderBy(F.desc_nulls_last("latest"), "card_id").limit(n).join(cards.select("card_id", "tag", "cite"), "card_id")
    rows = top.orderBy(F.desc_nulls_last("latest"), "card_id").collect()  # at most ``n``
    item = "<item><title>{}</title><link>{}/card/{}</link><guid>{}</guid><description>{}</description></item>"
    items = "".join(item.format(escape(r["tag"] or ""), escape(link), r["card_id"], r["card_id"], escape(r["cite"] or "")) for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(link)}</link>{items}</channel></rss>'
