"""The tables of a corpus folder and what is derived from them, each built when first asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import table
from ..operators import disclosures as D, ingest as I
from .staging import Stage


class Corpus:
    """``store`` names a corpus that was taken in piece by piece (``streaming.ingest``); without
    one the records are those of the table card_records."""

    def __init__(self, spark: SparkSession, folder: str, store: str | None = None):
        self.spark, self.folder, self.store = spark, folder, store
        self.stage = Stage(spark, "corpus")

    def table(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.folder, name, *columns)

    @cached_property
    def mapped(self) -> DataFrame:
        """Records as card fields with their key, written once."""
        if self.store:
            from ..streaming.ingest import CorpusSink

            return self.stage.write(CorpusSink(self.spark, self.store).rows(), "mapped")
        return self.stage.write(I.map_records(self.table("card_records")), "mapped")

    @cached_property
    def cards(self) -> DataFrame:
        """Canonical cards, written once."""
        return self.stage.write(I.canonical_cards(self.mapped), "cards")

    @cached_property
    def variants(self) -> DataFrame:
        own = I.attach_variants(self.mapped).drop("tag", "body_text", "norm", "fullcite", "cite")
        return self.stage.write(own.join(self.cards.select("canonical_key", "card_id"), "canonical_key"), "variants")

    @cached_property
    def rounds(self) -> DataFrame:
        return D.unique_rounds(self.table("rounds"))

    @cached_property
    def topics(self) -> DataFrame:
        return self.table("topics")

    @cached_property
    def disclosures(self) -> DataFrame:
        # of the rounds only what the chain shows, so that no other column is read to tell repeats apart
        rounds = D.unique_rounds(self.table("rounds", "id", "team_id", "side", "tournament", "round_date", "topic_id"))
        return D.disclosures(self.variants, rounds, self.table("teams"), self.table("schools"))

    @cached_property
    def totals(self) -> DataFrame:
        """Cards with their aggregates."""
        return self.cards.join(I.card_aggregates(self.cards, self.variants, self.disclosures), "card_id")

    @cached_property
    def card_topics(self) -> DataFrame:
        """Sorted distinct topic codes of every card, none as an empty list."""
        codes = self.disclosures.select("card_id", "topic_id").distinct().join(self.topics.select(F.col("id").alias("topic_id"), "code"), "topic_id")
        lists = codes.groupBy("card_id").agg(F.array_sort(F.collect_set("code")).alias("topic_codes"))
        return self.cards.select("card_id").join(lists, "card_id", "left").withColumn("topic_codes", F.coalesce("topic_codes", F.array().cast("array<string>")))
