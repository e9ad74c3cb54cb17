"""Corpus pages: counts, series, rankings, cross-references. Every top-k has a tie-break that is unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X


def corpus_counts(cards: DataFrame, variants: DataFrame, disclosures: DataFrame) -> DataFrame:
    a = cards.agg(
        F.count_if(~F.col("is_analytic")).alias("n_cards"), F.count_if("is_analytic").alias("n_analytics")
    )
    b = variants.agg(F.count(F.lit(1)).alias("n_variants"))
    c = disclosures.agg(
        F.countDistinct("team_id").alias("n_teams"), F.countDistinct("school_id").alias("n_schools"),
        F.min("season").alias("first_season"), F.max("season").alias("last_season"),
    )
    return a.crossJoin(b).crossJoin(c)  # one row each


def per_season(cards: DataFrame, disclosures: DataFrame) -> DataFrame:
    d = disclosures.join(cards.select("card_id", "is_analytic"), "card_id")
    return d.groupBy("season").agg(
        F.countDistinct(F.when(~F.col("is_analytic"), F.col("card_id"))).alias("n_cards"), F.count(F.lit(1)).alias("n_variants")
    )


def per_topic(topics: DataFrame, cards: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Distinct evidence cards of every topic, topics without any included."""
    evidence = disclosures.join(cards.where(~F.col("is_analytic")).select("card_id"), "card_id", "left_semi")
    n = evidence.groupBy(F.col("topic_id").alias("id")).agg(F.countDistinct("card_id").alias("n"))
    return topics.join(n, "id", "left").select("code", "starts", "ends", F.coalesce("n", F.lit(0)).alias("n_cards"))


def per_day(disclosures: DataFrame) -> DataFrame:
    return disclosures.where(F.col("round_date").isNotNull()).groupBy("round_date").agg(F.count(F.lit(1)).alias("n"))


def per_month(disclosures: DataFrame) -> DataFrame:
    d = disclosures.where(F.col("round_date") != "")
    return d.groupBy(X.month_of(F.col("round_date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("round_date").alias("first_seen"))


def side_split(disclosures: DataFrame) -> DataFrame:
    """Per topic how often each side read, and the rounded percentage of the pro side."""
    n = disclosures.where(F.col("side").isNotNull()).groupBy("topic_id").agg(
        F.count_if(F.col("side") == "P").alias("n_pro"), F.count_if(F.col("side") == "C").alias("n_con")
    )
    share = F.lit(100.0) * F.col("n_pro") / F.greatest(F.col("n_pro") + F.col("n_con"), F.lit(1))
    return n.withColumn("pro_percent", F.bround(share, 0).cast("int"))


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def authors_per_topic(cards: DataFrame, disclosures: DataFrame, n: int = 10) -> DataFrame:
    own = disclosures.where(F.col("topic_id").isNotNull()).select("topic_id", "card_id").distinct().join(cards.where(F.col("cite") != "").select("card_id", "cite"), "card_id")
    counted = own.groupBy("topic_id", "cite").agg(F.countDistinct("card_id").alias("n_cards"))
    return top_per_group(counted, "topic_id", [F.desc("n_cards"), F.asc("cite")], n)


def author_index(cards: DataFrame, n: int = 200) -> DataFrame:
    """Citations by how many cards carry them, with the qualification in brackets of the
    largest full citation, else its first 160 characters."""
    a = cards.where(F.col("cite") != "").groupBy("cite").agg(F.count(F.lit(1)).alias("n_cards"), F.max("fullcite").alias("fullcite"))
    quals = F.coalesce(F.nullif(F.regexp_extract("fullcite", r"\[([^\]]{3,240})\]", 1), F.lit("")), F.substring("fullcite", 1, 160))
    return a.select("cite", "n_cards", quals.alias("quals")).orderBy(F.desc("n_cards"), "cite").limit(n)


def domains(cards: DataFrame, n: int = 100) -> DataFrame:
    d = cards.select(X.domain(F.col("source_url")).alias("domain")).where("domain is not null")
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(n)


def provenance(variants: DataFrame, rounds: DataFrame, teams: DataFrame, schools: DataFrame) -> DataFrame:
    """Every variant with its round, team and school where known (outer joins)."""
    r = rounds.select(F.col("id").alias("round_id"), F.col("team_id").alias("r_team"), "tournament", "round_label", "side", "round_date")
    t = teams.select(F.col("id").alias("r_team"), "school_id", F.col("display_name").alias("team"))
    s = schools.select(F.col("id").alias("school_id"), F.col("display_name").alias("school"))
    v = variants.select("card_id", F.col("record_id").alias("variant_id"), "round_id")
    out = v.join(r, "round_id", "left").join(t, "r_team", "left").join(s, "school_id", "left")
    return out.select("card_id", "variant_id", "tournament", "round_label", "side", "round_date", "team", "school")


def representative(variants: DataFrame) -> DataFrame:
    """Per card the variant with the largest highlight ratio (none counts as -1), then the oldest."""
    order = F.struct(F.coalesce("highlight_ratio", F.lit(-1.0)).alias("h"), (-F.col("record_id")).alias("i"))
    return variants.groupBy("card_id").agg(F.max_by("record_id", order).alias("variant_id"), F.max(F.coalesce("highlight_ratio", F.lit(-1.0))).alias("ratio"))


def export_variant(variants: DataFrame) -> DataFrame:
    """Per card the first variant with markup, else the first."""
    empty = (F.coalesce(F.length("markup_html"), F.lit(0)) == 0).cast("int")
    return variants.groupBy("card_id").agg(F.min_by("record_id", F.struct(empty.alias("e"), "record_id")).alias("variant_id"))


def answers(variants: DataFrame, per_block: int = 25) -> DataFrame:
    """(card_id, answer_id): cards with a variant whose block answers the argument that a
    block of the card is about. Per block the first ``per_block`` answers by id."""
    rows = variants.where(F.col("block").isNotNull()).select("card_id", "block").distinct()
    about = rows.select("card_id", X.argument_key(F.col("block")).alias("key")).where("key is not null").distinct()
    target = rows.select(F.col("card_id").alias("answer_id"), X.answer_target(F.col("block")).alias("key")).where("key is not null").distinct()
    # the first answers of an argument, one more than wanted in case the card itself is among them
    first = top_per_group(target, "key", [F.asc("answer_id")], per_block + 1).select("key", "answer_id")
    both = about.join(first, "key").where("card_id <> answer_id")
    w = Window.partitionBy("card_id", "key").orderBy("answer_id")
    return both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_block).select("card_id", "answer_id").distinct()


def cards_by_topic(cards: DataFrame, disclosures: DataFrame, topics: DataFrame) -> DataFrame:
    """Distinct (code, card_id, tag) for school and team pages, rounds without a topic as Unassigned."""
    t = topics.select(F.col("id").alias("topic_id"), "code")
    out = disclosures.select("card_id", "topic_id").distinct().join(t, "topic_id", "left").join(cards.select("card_id", "tag"), "card_id")
    return out.select(F.coalesce("code", F.lit("Unassigned")).alias("code"), "card_id", "tag").distinct()


def round_cards(variants: DataFrame, round_id: int) -> DataFrame:
    """Variants of all documents that the round's variants lie in."""
    docs = variants.where(F.col("round_id") == round_id).select("document_id").distinct()
    return variants.join(docs, "document_id", "left_semi").select("card_id", F.col("record_id").alias("variant_id"), "ordinal")


def topic_groups(counted: DataFrame, status: Column) -> DataFrame:
    """Topics with their status, latest first within it."""
    return counted.select(status.alias("status"), "code", "n_cards", F.row_number().over(Window.partitionBy(status).orderBy(F.desc_nulls_last("starts"), F.desc("code"))).alias("place"))


def box_view(boxes: DataFrame, members: DataFrame, cards: DataFrame, variants: DataFrame, per_minute: int = 250) -> DataFrame:
    """Per box its members, the words read aloud (of each card the first spoken text) and the time they take."""
    spoken = variants.where(F.col("spoken") != "").groupBy("card_id").agg(F.min_by("spoken", "record_id").alias("spoken"))
    own = members.join(cards.select("card_id"), "card_id", "left_semi").join(spoken, "card_id", "left")
    sums = own.groupBy("box_id").agg(F.count(F.lit(1)).alias("n_cards"), F.sum(X.words_spoken(F.col("spoken"))).alias("n_words"))
    out = boxes.join(sums, "box_id", "left")
    out = out.withColumns({"n_cards": F.coalesce("n_cards", F.lit(0)), "n_words": F.coalesce("n_words", F.lit(0))})
    return out.withColumn("read_time", X.read_time(F.col("n_words"), per_minute))


def import_box(payload: DataFrame, cards: DataFrame) -> DataFrame:
    """Members of imported boxes by canonical key; unknown keys are skipped, repeats count once."""
    return payload.join(cards.select("canonical_key", "card_id"), "canonical_key").select("box_id", "card_id").dropDuplicates(["box_id", "card_id"])


def source_totals(cards: DataFrame) -> DataFrame:
    return cards.agg(
        F.count_if(~F.col("is_analytic")).alias("evidence"), F.count_if("is_analytic").alias("analytics"),
        F.sum("variant_count").alias("variants"), F.sum(F.length("body_text")).alias("body_chars"),
    )


def events_of_cards(cards: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Sorted lists of the lists a card was read in, the default where none is known."""
    e = disclosures.groupBy("card_id").agg(F.array_join(F.array_sort(F.collect_set("caselist")), ",").alias("events"))
    return cards.select("card_id").join(e, "card_id", "left").withColumn("events", F.coalesce("events", F.lit("pf")))


def outline(variants: DataFrame) -> DataFrame:
    """Headings of a document in order: pocket, hat and block are shown where they differ
    from the ones above, and a new parent shows its children again."""
    w = Window.partitionBy("document_id").orderBy("ordinal", "record_id")
    cells = [F.coalesce(F.col(c), F.lit("")) for c in ("pocket", "hat", "block")]
    shown, changed = {}, F.lit(False)
    for c, value in zip(("pocket", "hat", "block"), cells, strict=True):
        before = F.lag(value).over(w)
        changed = changed | before.isNull() | (value != before)
        shown[f"show_{c}"] = F.when(changed & (value != ""), value)
    rows = variants.where(F.col("document_id").isNotNull() & F.col("ordinal").isNotNull())
    return rows.select(F.col("record_id").alias("variant_id"), *(v.alias(k) for k, v in shown.items()))
