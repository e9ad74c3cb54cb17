"""Predicates on cards. Each is a semi or anti join of its own, so two filters may be
satisfied by different disclosures of a card."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X


def contains_ignoring_case(value: Column, needle: str) -> Column:
    """Substring whatever its case; wildcards have no meaning; null matches nothing."""
    return F.coalesce(F.contains(F.lower(value), F.lit(needle.lower())), F.lit(False))


def kind(cards: DataFrame, analytic: bool = False) -> DataFrame:
    """Evidence only, or analytics only."""
    return cards.where(F.col("is_analytic") == F.lit(analytic))


def disclosed(cards: DataFrame, disclosures: DataFrame, test: Column) -> DataFrame:
    """Cards with a disclosure that passes ``test``."""
    return cards.join(disclosures.where(test).select("card_id").distinct(), "card_id", "left_semi")


def by_topics(cards: DataFrame, disclosures: DataFrame, topic_ids: Iterable[int]) -> DataFrame:
    """Cards read in a round of one of the topics; of no topics, none."""
    ids = list(topic_ids)
    return disclosed(cards, disclosures, F.col("topic_id").isin(*ids)) if ids else cards.where(F.lit(False))


def by_season(cards: DataFrame, disclosures: DataFrame, season: int) -> DataFrame:
    return disclosed(cards, disclosures, F.col("season") == season)


def by_side(cards: DataFrame, disclosures: DataFrame, side: str) -> DataFrame:
    return disclosed(cards, disclosures, F.col("side") == side)


def by_school(cards: DataFrame, disclosures: DataFrame, text: str) -> DataFrame:
    return disclosed(cards, disclosures, contains_ignoring_case(F.col("school_name"), text) | contains_ignoring_case(F.col("school_display"), text))


def by_team(cards: DataFrame, disclosures: DataFrame, text: str) -> DataFrame:
    return disclosed(cards, disclosures, contains_ignoring_case(F.col("team_name"), text) | contains_ignoring_case(F.col("team_display"), text))


def by_cite(cards: DataFrame, text: str) -> DataFrame:
    return cards.where(contains_ignoring_case(F.col("cite"), text) | contains_ignoring_case(F.col("fullcite"), text))


def by_year(cards: DataFrame, year: str) -> DataFrame:
    return cards.where(X.cite_year_search(F.col("cite")) == year)


def before(cards: DataFrame, bound: str) -> DataFrame:
    """Published, at the earliest that the date can mean, before the earliest of the bound."""
    return cards.where((F.col("source_pub_date") != "") & (X.date_floor(F.col("source_pub_date")) < X.date_floor(F.lit(bound))))


def after(cards: DataFrame, bound: str) -> DataFrame:
    """Published, at the latest that the date can mean, not before the earliest of the bound."""
    return cards.where((F.col("source_pub_date") != "") & (X.date_ceiling(F.col("source_pub_date")) >= X.date_floor(F.lit(bound))))


def min_reads(cards: DataFrame, n: int) -> DataFrame:
    return cards.where(F.col("team_count") >= n)


def by_status(cards: DataFrame, status: str, prep: DataFrame | None) -> DataFrame:
    """Cards with that preparation status; without such a table the filter does nothing."""
    return cards if prep is None else cards.join(prep.where(F.col("status") == status).select("card_id").distinct(), "card_id", "left_semi")


def excluding(cards: DataFrame, matched: DataFrame) -> DataFrame:
    return cards.join(matched.select("card_id").distinct(), "card_id", "left_anti")


def publishable(cards: DataFrame, disclosures: DataFrame | None, events: Iterable[str] | None, least_teams: int = 0, analytics: bool = True) -> DataFrame:
    """What a published corpus takes: enough teams, of the wanted lists."""
    out = cards.where(F.col("team_count") >= least_teams)
    out = out if analytics else kind(out)
    return out if events is None else disclosed(out, disclosures, F.col("caselist").isin(*events))
