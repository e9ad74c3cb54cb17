"""The engine as one object: ingest, dedup, topics, search and pages over a corpus folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as X
from .operators import analytics as A, consensus as C, dedup as D, heuristics as H, publish as P, topics as G
from .operators.fulltext import TextIndex
from .operators.ingest import index_rows
from .plans.corpus import Corpus
from .plans.search import Result, Tables, search
from .plans.staging import Folder, Stage
from .streaming.ingest import CorpusSink


@dataclass
class Engine:
    """Over a folder of tables (card_records, rounds, teams, schools, topics). ``today`` is
    given with each call that depends on it."""

    spark: SparkSession
    folder: str
    #: A corpus and text index that last, taken in by ``ingest``; without one everything is
    #: derived from the table card_records.
    store: str | None = None

    def __post_init__(self) -> None:
        self.corpus = Corpus(self.spark, self.folder, self.store and f"{self.store}/corpus")
        self.stage = Stage(self.spark, "engine")
        self._tables: Tables | None = None

    # -- data -------------------------------------------------------------------------

    @property
    def cards(self) -> DataFrame:
        return self.corpus.totals

    def ingest_rows(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cards, variants) of raw records; the same records again give the same."""
        from .operators.ingest import attach_variants, canonical_cards, map_records

        rows = self.stage.write(map_records(records), "ingested")
        return canonical_cards(rows), attach_variants(rows)

    def ingest(self, files: list[str]) -> dict[str, int]:
        """Take record files into the store; files seen before are skipped, a bad one stops no other."""
        schema = self.corpus.table("card_records").schema
        out = CorpusSink(self.spark, f"{self.store}/corpus").ingest_files(files, schema)
        self.corpus, self._tables = Corpus(self.spark, self.folder, f"{self.store}/corpus"), None
        return out

    def reindex(self) -> TextIndex:
        """Bring the stored text index up to the store: cards that it has not go in."""
        rows, path = index_rows(self.corpus.cards, self.corpus.variants), f"{self.store}/index"
        if Folder(self.spark, path).load():
            rows = rows.join(TextIndex.load(self.spark, path).lengths.select("card_id"), "card_id", "left_anti")
        return TextIndex.update(rows, path)

    def backup(self, path: str) -> None:
        """A copy of what the store holds: current rows as one folder."""
        CorpusSink(self.spark, f"{self.store}/corpus").rows().write.parquet(path)

    def dedup(self, cards: DataFrame | None = None) -> DataFrame:
        """Merges (survivor_id, absorbed_id, relation) of near-duplicate cards."""
        stage = Stage(self.spark, "dedup")
        rows = stage.write(D.universe(self.corpus.cards if cards is None else cards), "universe")
        return D.greedy_merges(rows, stage.write(D.candidate_pairs(rows), "candidates"), stage)

    def assign_topics(self, overrides: DataFrame) -> DataFrame:
        from .operators.disclosures import season_of

        c = self.corpus
        team = c.table("teams").select(F.col("id").alias("team_id"), "school_id")
        school = c.table("schools").select(F.col("id").alias("school_id"), season_of(F.col("caselist")).alias("season"))
        rounds = c.rounds.join(team, "team_id", "left").join(school, "school_id", "left").select("id", "round_date", "tournament", "season")
        return G.assign_topics(rounds, c.variants, c.topics, overrides)

    # -- search -----------------------------------------------------------------------

    def tables(self, cache: bool = True) -> Tables:
        """What search reads, made once; with ``cache`` kept in memory as far as it fits."""
        if self._tables is None:
            c = self.corpus
            cards = c.totals.join(c.card_topics, "card_id").join(A.events_of_cards(c.cards, c.disclosures), "card_id")
            rows = index_rows(c.cards, c.variants)
            cards = self.stage.write(cards.join(rows.select("card_id", "block"), "card_id"), "cards")
            disclosures = self.stage.write(c.disclosures, "disclosures")
            index = self.reindex() if self.store else TextIndex.build(rows, self.stage)
            self._tables = Tables(cards.persist(), disclosures.persist(), c.topics.persist(), index.cached()) if cache else Tables(cards, disclosures, c.topics, index)
        return self._tables

    def search(self, text: str, today: str, limit: int = 30, offset: int = 0, dialect: str = "engine") -> Result:
        return search(self.tables(), text, today, limit, offset, dialect)

    # -- pages ------------------------------------------------------------------------

    def card(self, card_id: int) -> dict[str, DataFrame]:
        """A card, where it was read, what is marked in it, its signals and the answers to it."""
        c = self.corpus
        one = c.totals.where(F.col("card_id") == card_id)
        own = c.variants.where(F.col("card_id") == card_id)
        return {
            "card": one,
            "provenance": A.provenance(own, c.rounds, c.table("teams"), c.table("schools")).orderBy(F.asc_nulls_last("round_date"), "variant_id"),
            "consensus": C.weights(C.layers(one, own)),
            "flags": H.flags(one, own),
            "answers": A.answers(c.variants).where(F.col("card_id") == card_id),
        }

    def topic(self, code: str) -> dict[str, DataFrame]:
        """Cards per day, sides, authors and the newest cards of a topic."""
        c = self.corpus
        ids = c.topics.where(F.upper("code") == code.upper()).select(F.col("id").alias("topic_id"))
        d = c.disclosures.join(ids, "topic_id", "left_semi")
        newest = d.groupBy("card_id").agg(F.max("round_date").alias("latest")).orderBy(F.desc_nulls_last("latest"), "card_id").limit(50)
        return {"days": A.per_day(d), "sides": A.side_split(d), "authors": A.authors_per_topic(c.cards, d), "newest": newest}

    def authors(self, n: int = 200) -> DataFrame:
        return A.author_index(self.corpus.cards, n)

    def stats(self) -> dict[str, DataFrame]:
        c = self.corpus
        return {"counts": A.corpus_counts(c.cards, c.variants, c.disclosures), "seasons": A.per_season(c.cards, c.disclosures), "topics": A.per_topic(c.topics, c.cards, c.disclosures)}

    def publish(self, path: str, cap: int | None = None) -> DataFrame:
        """Write the published cards, at most ``cap`` bytes of text, and read them back."""
        c = self.corpus
        cards = c.totals if cap is None else P.capped(c.totals, cap, P.row_bytes("body_text", "tag", "fullcite"))
        P.write_published(P.published_cards(cards, c.variants, A.events_of_cards(c.cards, c.disclosures), c.card_topics), path)
        return self.spark.read.parquet(path)


def register(spark: SparkSession) -> None:
    """The scalar function for users who write SQL: pf_cite_year(cite), a SQL function over
    the native expression, so that the optimiser sees through it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pf_cite_year(cite STRING) RETURNS STRING RETURN {X.CITE_YEAR_SQL}")


def cite_year(column: str):
    """The same as a native expression."""
    return X.cite_year_search(F.col(column))
