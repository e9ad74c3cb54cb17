"""From a search string to a page of hits: parse, bind, filter by semi joins, rank, cut,
and only then fetch what the page shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import filters as P, topics as G
from ..operators.fulltext import TextIndex, snippet
from .grammar import Query, parse

#: How many hits by score the published dialect re-ranks, evidence before analytics.
WINDOW = 300


@dataclass
class Tables:
    """What search reads. ``cards`` has card_id, tag, cite, fullcite, body_text, body_len,
    is_analytic, source_pub_date, team_count, school_count and topic_codes; ``prep`` (card_id,
    status) may be missing; the published dialect also reads block and events."""

    cards: DataFrame
    disclosures: DataFrame
    topics: DataFrame
    index: TextIndex
    prep: DataFrame | None = None


@dataclass
class Result:
    hits: DataFrame
    matched: DataFrame
    query: Query

    def total(self) -> int:
        """Exact number of matches."""
        return self.matched.count()


def _engine_filters(cards: DataFrame, t: Tables, f: dict, today: str) -> DataFrame:
    d = t.disclosures
    cards = P.kind(cards, bool(f.get("is_analytic")))
    if "topic" in f:
        wanted = G.resolve_token(t.topics, f["topic"], today).select(F.col("id").alias("topic_id"))
        cards = P.disclosed(cards, d.join(wanted, "topic_id", "left_semi"), F.lit(True))
    steps = {
        "season": lambda c, v: P.by_season(c, d, v), "side": lambda c, v: P.by_side(c, d, v),
        "school": lambda c, v: P.by_school(c, d, v), "team": lambda c, v: P.by_team(c, d, v),
        "cite": P.by_cite, "year": P.by_year, "before": P.before, "after": P.after, "min_reads": P.min_reads,
        "status": lambda c, v: P.by_status(c, v, t.prep), "exclude": lambda c, v: P.excluding(c, t.index.any_of(v)),
    }
    for name, step in steps.items():
        if name in f:
            cards = step(cards, f[name])
    return cards


def _site_filters(cards: DataFrame, t: Tables, f: dict, today: str) -> DataFrame:
    if f.get("is_analytic"):
        cards = P.kind(cards, True)
    if "event" in f:
        cards = cards.where(F.array_contains(F.split(F.coalesce("events", F.lit("pf")), ","), f["event"]))
    if "topic" in f or "season" in f:
        codes = t.topics.select("code", "season")
        if "topic" in f:
            any_ = None
            for token in f["topic"]:
                one = G.resolve_token(t.topics, token, today).select("code")
                any_ = one if any_ is None else any_.unionByName(one)
            codes = codes.join(any_.distinct(), "code", "left_semi")
        if "season" in f:
            codes = codes.where(F.col("season") == f["season"])
        own = cards.select("card_id", F.explode("topic_codes").alias("code")).join(codes.select("code"), "code", "left_semi")
        cards = cards.join(own.select("card_id").distinct(), "card_id", "left_semi")
    for text in f.get("cite", []):
        cards = P.by_cite(cards, text)
    if "year" in f:
        cards = cards.where(P.contains_ignoring_case(F.col("cite"), f["year"]))
    if "block" in f:
        cards = cards.where(P.contains_ignoring_case(F.col("block"), f["block"]))
    if "before" in f:
        cards = cards.where(F.col("source_pub_date") < f["before"])
    if "after" in f:
        cards = cards.where(F.col("source_pub_date") > f["after"])
    return P.min_reads(cards, f["min_reads"]) if "min_reads" in f else cards


def search(t: Tables, text: object, today: str, limit: int = 30, offset: int = 0, dialect: str = "engine") -> Result:
    """Hits of a search string, one row per card, ties by card_id; never raises for what is typed.

    A query without words lists the most read cards. Columns: place, card_id, tag, cite,
    snippet, body_len, is_analytic, team_count, school_count, topic_codes, source_pub_date.
    """
    query = parse(text, dialect)
    filtered = (_site_filters if dialect == "site" else _engine_filters)(t.cards, t, query.filters, today)
    ranked = bool(query.positives)
    if ranked:
        matched = filtered.join(t.index.match(query.positives, query.negatives), "card_id")
    else:
        matched = filtered.withColumn("score", F.lit(0.0))
    order = {
        "reads": [F.desc("team_count")] + ([F.desc("school_count")] if dialect == "site" else []),
        "length": [F.desc("body_len")],
        "recent": [F.desc_nulls_last("source_pub_date" if dialect == "site" else "latest")],
        "relevance": [F.asc("score")] if ranked else [F.desc("team_count")],
    }[query.sort]
    if query.sort == "recent" and dialect != "site":
        latest = t.disclosures.groupBy("card_id").agg(F.max("round_date").alias("latest"))
        matched = matched.join(latest, "card_id", "left")
    order = [*order, F.asc("card_id")]
    narrow = matched.select("card_id", *(c for c in ("score", "latest", "team_count", "school_count", "body_len", "is_analytic", "source_pub_date") if c in matched.columns))
    if dialect == "site" and ranked and query.sort == "relevance" and offset + limit <= WINDOW:
        narrow = narrow.orderBy(*order).limit(WINDOW)
        order = [F.asc("is_analytic"), *order]
    page = narrow.orderBy(*order).offset(offset).limit(limit)
    keys = page.select("card_id", F.struct(*_sortable(order, narrow.columns)).alias("_s"))
    shown = t.cards.join(F.broadcast(keys), "card_id")  # at most ``limit`` rows
    phrases = [tokens for tokens, col in t.index.phrases(query.positives) if col in (None, "body")]
    body = snippet(F.col("body_text"), phrases, t.index.stem) if ranked else X.escape_html(X.first_words(F.col("body_text")))
    hits = shown.orderBy("_s").select(
        "card_id", "tag", "cite", body.alias("snippet"), "body_len", "is_analytic", "team_count", "school_count", "topic_codes", "source_pub_date"
    )
    return Result(hits, matched.select("card_id", "score"), query)


def _sortable(order: list, columns: list[str]) -> list:
    """The place of a page's rows as one column, so that the page keeps its order after the
    join that fetches what it shows."""
    from pyspark.sql import Window

    return [F.row_number().over(Window.orderBy(*order)).alias("place")]
