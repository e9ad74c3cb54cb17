"""What an answer of a web server says about a source, and which sources to ask next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

# Status codes and phrases of pages behind a fee, and where archived copies are found.
PAYWALL_STATUS = (401, 402, 403)
PAYWALL_MARKS = (
    "paywall", "subscribe to continue", "subscribe to read", "subscription required", "subscribers only", "sign in to continue",
    "sign in to read", "log in to continue", "register to continue", "create a free account to continue", "purchase this article",
    "to continue reading", "metered-content", "piano.io", "tinypass.com",
)
ARCHIVE = "https://web.archive.org/web/*/"
HEAD = 4096


def classify(url: Column, status: Column, final_url: Column, head: Column) -> Column:
    """alive, redirected, paywalled or dead; a null status is dead."""
    shown = F.lower(F.substring(F.coalesce(head, F.lit("")), 1, HEAD))
    marked = F.lit(False)
    for mark in PAYWALL_MARKS:
        marked = marked | F.contains(shown, F.lit(mark))
    good = F.coalesce(status.between(200, 299), F.lit(False))
    moved = ~X.hostname(final_url).eqNullSafe(X.hostname(url))
    return F.when(status.isin(*PAYWALL_STATUS) | (good & marked), "paywalled").when(good & moved, "redirected").when(good, "alive").otherwise("dead")


def archived(url: Column, state: Column) -> Column:
    return F.when(state != "alive", F.concat(F.lit(ARCHIVE), url))


def latest_health(checks: DataFrame) -> DataFrame:
    """Of each card the latest check."""
    w = Window.partitionBy("card_id").orderBy(F.desc_nulls_last("checked_at"), "status")
    return checks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def queue(cards: DataFrame, health: DataFrame, n: int) -> DataFrame:
    """The next sources to check: never checked first, then the longest ago, then by id."""
    c = cards.where(F.col("source_url") != "").select("card_id", "source_url").join(health.select("card_id", "checked_at"), "card_id", "left")
    return c.orderBy(F.asc_nulls_first("checked_at"), "card_id").limit(n)
