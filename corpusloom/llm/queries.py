"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..plans.registry import Query
from .sql import SQL

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if name in SQL:
            ORACLE[name] = SQL[name]
        return fn

    return add


def _cards(spark, sf):
    cards = table(spark, sf, "cards", "id", "canonical_key", "is_analytic", "tag", "body_text")
    kind = F.coalesce("is_analytic", F.lit(False))
    return cards.select("id", F.col("canonical_key").alias("grp"), kind.alias("kind"), F.when(kind, F.col("tag")).otherwise(F.col("body_text")).alias("text"))


@query("p2_found")
def p2_found(spark, sf):
    from .bitslice import near_duplicates, pairs_between_groups

    return pairs_between_groups(*near_duplicates(_cards(spark, sf)))


@query("p4_found")
def p4_found(spark, sf):
    from ..plans.staging import Stage
    from .components import connected_components, member_edges

    stage = Stage(spark, "p4")
    buckets = table(spark, sf, "hf_buckets", "card_id", "bucket_id")
    buckets = buckets.select("card_id", F.nullif(F.lower(F.regexp_replace("bucket_id", r"(?U)^\s+|\s+$", "")), F.lit("")).alias("bucket"))
    merges = table(spark, sf, "dedup_pairs", "card_id_a", "card_id_b", "merged").where("merged")
    edges = member_edges(buckets, stage).unionByName(merges.select(F.col("card_id_a").alias("node"), F.col("card_id_b").alias("root")))
    return connected_components(edges, stage).select(F.col("component").alias("group_id"), F.col("node").alias("card_id"))


@query("p6_found")
def p6_found(spark, sf):
    from .merkle import same_records

    return same_records(table(spark, sf, "card_records", "record_id", "tag", "body_text", "is_analytic", "payload"))


@query("p7_ids")
def p7_ids(spark, sf):
    from .bpe import encode_texts

    return encode_texts(table(spark, sf, "documents", "doc_id", "text"))


def _sizes(spark, sf, stage):
    from .bpe import count_tokens

    return stage.write(count_tokens(table(spark, sf, "documents", "doc_id", "text")), "sizes")


@query("p8_found")
def p8_found(spark, sf):
    from ..plans.staging import Stage
    from .packing import CAPACITY, pack

    stage = Stage(spark, "p8")
    placed = pack(_sizes(spark, sf, stage), CAPACITY, stage)
    # only an item larger than a container has a second piece
    return placed.where("piece = 1").select("doc_id")


@query("p8_containers")
def p8_containers(spark, sf):
    from ..plans.staging import Stage
    from .packing import CAPACITY, pack

    stage = Stage(spark, "p8")
    return pack(_sizes(spark, sf, stage), CAPACITY, stage)


@query("p1_found")
def p1_found(spark, sf):
    from .survivors import best_fields, card_fields

    columns = ("id", "canonical_key", "fullcite", "body_text", "variant_count", "team_count", "markup_html", "fidelity", "updated_at")
    return best_fields(table(spark, sf, "cards", *columns), card_fields())


@query("p9_found")
def p9_found(spark, sf):
    from .reading import english_of_length, reading_levels

    documents = english_of_length(table(spark, sf, "documents", "doc_id", "text", "lang"))
    return reading_levels(documents, table(spark, sf, "reading_refs", "level", "text")).select("doc_id", "level")


@query("p5_found")
def p5_found(spark, sf):
    from .history import first_accepted

    columns = ("record_id", "batch_no", "external_id", "tag", "body_text", "is_analytic", "payload")
    return first_accepted(table(spark, sf, "card_records", *columns))
