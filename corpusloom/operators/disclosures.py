"""The chain variant - round - team - school - season, joined once and used by most queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def unique_rounds(rounds: DataFrame) -> DataFrame:
    """Rounds delivered more than once count once: per id the smallest row."""
    rest = [c for c in rounds.columns if c != "id"]
    first = rounds.groupBy("id").agg(F.min(F.struct(*rest)).alias("_r"))
    return first.select("id", "_r.*")


def season_of(caselist):
    """Start year of the season a list belongs to, from the two digits that end its name."""
    return F.regexp_extract(caselist, r"(\d{2})$", 1).try_cast("int") + F.lit(2000)


def disclosures(variants: DataFrame, rounds: DataFrame, teams: DataFrame, schools: DataFrame) -> DataFrame:
    """Variants with a known round, team and school. Teams and schools are dimensions:
    Spark broadcasts them while their size allows and shuffles beyond."""
    r = rounds.select(F.col("id").alias("round_id"), "team_id", "side", "tournament", "round_date", F.col("topic_id").alias("topic_id"))
    t = teams.select(F.col("id").alias("team_id"), "school_id", F.col("name").alias("team_name"), F.col("display_name").alias("team_display"))
    s = schools.select(F.col("id").alias("school_id"), "caselist", F.col("name").alias("school_name"), F.col("display_name").alias("school_display"), "state")
    v = variants.select("card_id", F.col("record_id").alias("variant_id"), "round_id", "highlight_ratio", "block")
    out = v.join(r, "round_id").join(t, "team_id").join(s, "school_id")
    return out.withColumn("season", season_of(F.col("caselist")))
