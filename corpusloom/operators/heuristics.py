"""Signals that a card was cut badly, set-wise for all cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X

# Thresholds of the signals.
LONG_BODY, RATIO_HIGH, RATIO_LOW = 500, 0.80, 0.02
BRACKET_DENSITY, BRACKET_LEAST_WORDS = 2.0, 20
ELLIPSIS_LEAST = 3
TAG_OVERLAP, TAG_LEAST_WORDS = 0.05, 3
# What counts as an insertion and as an ellipsis, and the labels of the signals.
INSERTION, ELLIPSIS = r"\[[^\[\]]*\]", r"…|\.{3,}"
LABELS = {
    "hl_ratio_high": "Nearly the whole card is highlighted",
    "hl_ratio_low": "Almost none of a long card is highlighted",
    "bracket_density": "Many bracketed insertions",
    "ellipsis": "Multiple ellipses in the body",
    "power_tag": "Tag shares almost no words with the spoken text",
}


def measures(cards: DataFrame, variants: DataFrame) -> DataFrame:
    """What the signals look at, one row per card."""
    read = variants.groupBy("card_id").agg(
        F.max("highlight_ratio").alias("ratio_high"), F.min("highlight_ratio").alias("ratio_low"),
        F.array_distinct(F.flatten(F.collect_set(X.content_words(F.col("spoken"))))).alias("spoken_words"),
    )
    c = cards.select("card_id", "tag", "body_text", "body_len").join(read, "card_id", "left")
    body = F.coalesce("body_text", F.lit(""))
    tag, spoken = X.content_words(F.col("tag")), F.coalesce("spoken_words", F.array().cast("array<string>"))
    both = F.size(F.array_union(tag, spoken))
    return c.select(
        "card_id", F.coalesce("body_len", F.lit(0)).alias("body_len"), "ratio_high", "ratio_low", X.words_spoken(body).alias("n_words"),
        F.regexp_count(body, F.lit(INSERTION)).alias("n_brackets"), F.regexp_count(body, F.lit(ELLIPSIS)).alias("n_ellipses"),
        F.when((F.size(tag) >= TAG_LEAST_WORDS) & (F.size(spoken) >= TAG_LEAST_WORDS), F.size(F.array_intersect(tag, spoken)) / both).alias("overlap"),
    )


def flags(cards: DataFrame, variants: DataFrame) -> DataFrame:
    """(card_id, flags array<struct<code,label,detail>>) of every card, in a fixed order."""
    m = measures(cards, variants)
    long = F.col("body_len") >= LONG_BODY
    density = F.lit(100.0) * F.col("n_brackets") / F.col("n_words")
    made = [
        (long & (F.col("ratio_high") > RATIO_HIGH), "hl_ratio_high",
         F.format_string("%.0f%% of %d characters highlighted", F.col("ratio_high") * 100, F.col("body_len"))),
        (long & (F.col("ratio_low") < RATIO_LOW), "hl_ratio_low",
         F.format_string("%.1f%% of %d characters highlighted", F.col("ratio_low") * 100, F.col("body_len"))),
        ((F.col("n_words") >= BRACKET_LEAST_WORDS) & (F.when(F.col("n_words") > 0, density) > BRACKET_DENSITY), "bracket_density",
         F.format_string("%d insertions in %d words", F.col("n_brackets"), F.col("n_words"))),
        (F.col("n_ellipses") >= ELLIPSIS_LEAST, "ellipsis", F.format_string("%d ellipses", F.col("n_ellipses"))),
        (F.col("overlap") < TAG_OVERLAP, "power_tag", F.format_string("overlap %.3f", F.col("overlap"))),
    ]
    each = F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(LABELS[code]).alias("label"), detail.alias("detail"))) for test, code, detail in made))
    return m.select("card_id", F.array_compact(each).alias("flags"))
