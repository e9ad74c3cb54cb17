"""Topics: their status, and the topic of a round by date, override or keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X


def load_topics(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(topics, overrides) of a seed file: an object with both lists, or a bare list of
    topics. Rows without a code are skipped, of one code the last stays, matches are lower case."""
    fields = "season int, slot string, code string, resolution string, starts string, ends string, source_url string"
    whole = spark.read.text(path, wholetext=True)
    boxed = F.when(F.ltrim("value").startswith("["), F.concat(F.lit('{"topics":'), "value", F.lit("}"))).otherwise(F.col("value"))
    seed = whole.select(F.from_json(boxed, f"topics array<struct<{fields.replace(' int', ': int').replace(' string', ': string')}>>, overrides array<struct<match: string, slot: string, code: string>>").alias("s"))
    rows = seed.select(F.posexplode_outer("s.topics").alias("n", "t")).where("t.code is not null")
    topics = rows.groupBy("t.code").agg(F.max_by("t", "n").alias("t")).select("t.*")
    overrides = seed.select(F.explode("s.overrides").alias("o")).select(F.lower("o.match").alias("match"), "o.slot", "o.code").where("match <> ''")
    return topics, overrides


def topic_status(starts: Column, ends: Column, today: str) -> Column:
    """past, present or future; without any date a topic is still to come."""
    return (
        F.when(starts.isNull() & ends.isNull(), "future").when(ends < today, "past").when(starts > today, "future").otherwise("present")
    )


def resolve_token(topics: DataFrame, token: str, today: str) -> DataFrame:
    """Topics that a token of the search language means: a status, or a code in any case."""
    word = token.strip()
    if word.lower() in ("past", "present", "future"):
        return topics.where(topic_status(F.col("starts"), F.col("ends"), today) == word.lower())
    return topics.where(F.upper("code") == word.upper())


def current_topic(topics: DataFrame, today: str) -> DataFrame:
    """The present topic that started last."""
    return resolve_token(topics, "present", today).orderBy(F.desc_nulls_last("starts"), "code").limit(1)


def _iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def by_date(rounds: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, topic_id) of rounds whose date lies in the window of exactly one topic of their
    season (of any, where the season is unknown). Topics are a bounded list of windows."""
    t = topics.select(F.col("id").alias("topic_id"), F.col("season").alias("t_season"), _iso_date(F.col("starts")).alias("s"), _iso_date(F.col("ends")).alias("e"))
    dated = rounds.select("id", "season", _iso_date(F.col("round_date")).alias("d")).where("d is not null")
    inside = (F.col("d") >= F.col("s")) & (F.col("d") <= F.col("e")) & (F.col("season").isNull() | (F.col("season") == F.col("t_season")))
    hits = dated.join(F.broadcast(t), inside).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("topic_id").alias("topic_id"))
    return hits.where("n = 1").select("id", "topic_id")


def by_override(rounds: DataFrame, overrides: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, topic_id) by the longest override that the tournament's name contains and that
    leads to a topic: by its code, or by its slot within the round's season."""
    codes = topics.select(F.upper("code").alias("c_code"), F.col("id").alias("c_topic"))
    slots = topics.select(F.col("season").alias("s_season"), F.col("slot").alias("s_slot"), F.col("id").alias("s_topic"))
    o = overrides.where(F.col("match") != "").join(codes, F.upper("code") == F.col("c_code"), "left").drop("c_code")
    named = rounds.where(F.col("tournament") != "").select("id", "season", F.lower("tournament").alias("name"))
    hits = named.join(F.broadcast(o), F.contains(F.col("name"), F.col("match")))
    hits = hits.join(F.broadcast(slots), (F.col("code").isNull()) & (F.col("season") == F.col("s_season")) & (F.col("slot") == F.col("s_slot")), "left")
    hits = hits.withColumn("topic_id", F.coalesce("c_topic", "s_topic")).where("topic_id is not null")
    return hits.groupBy("id").agg(F.min_by("topic_id", F.struct(-F.length("match"), "match", "topic_id")).alias("topic_id"))


def distinctive_keywords(topics: DataFrame) -> DataFrame:
    """(season, topic_id, word): words of a resolution that no other of its season has."""
    words = topics.select("season", F.col("id").alias("topic_id"), F.explode(X.topic_tokens(F.col("resolution"))).alias("word"))
    alone = words.groupBy("season", "word").agg(F.countDistinct("topic_id").alias("n"), F.min("topic_id").alias("topic_id"))
    return alone.where("n = 1").select("season", "topic_id", "word")


def by_keyword(rounds: DataFrame, variants: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, topic_id) by the words of pocket, hat and block of a round's variants: the topic
    with strictly the most distinctive words; a tie tells nothing."""
    heads = variants.select(F.col("round_id").alias("id"), F.explode(X.topic_tokens(F.concat_ws(" ", "pocket", "hat", "block"))).alias("word")).distinct()
    seasons = rounds.select("id", "season").where("season is not null")
    votes = heads.join(seasons, "id").join(F.broadcast(distinctive_keywords(topics)), ["season", "word"]).groupBy("id", "topic_id").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.max("n").alias("top"), F.max_by("topic_id", F.struct("n", "topic_id")).alias("topic_id"), F.collect_list("n").alias("all"))
    return best.where(F.size(F.filter("all", lambda x: x == F.col("top"))) == 1).select("id", "topic_id")


def assign_topics(rounds: DataFrame, variants: DataFrame, topics: DataFrame, overrides: DataFrame) -> DataFrame:
    """(id, topic_id, method) of every round: date, else override, else keyword, else none.

    ``rounds`` has id, round_date, tournament and season. Nothing is guessed; running it
    again gives the same result.
    """
    steps = [("date", by_date(rounds, topics)), ("override", by_override(rounds, overrides, topics)), ("keyword", by_keyword(rounds, variants, topics))]
    out = rounds.select("id")
    for name, found in steps:
        out = out.join(found.withColumnRenamed("topic_id", f"_{name}"), "id", "left")
    method = F.when(F.col("_date").isNotNull(), "date").when(F.col("_override").isNotNull(), "override").when(F.col("_keyword").isNotNull(), "keyword").otherwise("none")
    return out.select("id", F.coalesce("_date", "_override", "_keyword").alias("topic_id"), method.alias("method"))

