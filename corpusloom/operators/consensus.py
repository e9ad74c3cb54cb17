"""How many variants of a card mark each word of its body."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from ..functions.markup import layer_vectors


@pandas_udf(ArrayType(StructType([StructField("mark", BooleanType()), StructField("summary", BooleanType())])))
def _vectors(body: pd.Series, markup: pd.Series) -> pd.Series:
    return pd.Series([[{"mark": m, "summary": s} for m, s in layer_vectors(b, h)] for b, h in zip(body, markup, strict=True)])


def layers(cards: DataFrame, variants: DataFrame) -> DataFrame:
    """(card_id, place, marked, summarised): per word of each body the number of variants
    that have it in a layer. Counts are summed per word with partial sums, so a card with
    very many variants is no larger task than others."""
    # variants with one markup are parsed once and counted
    own = variants.where(F.col("markup_html") != "").groupBy("card_id", "markup_html").agg(F.count(F.lit(1)).alias("n"))
    rows = own.join(cards.where(F.col("body_text") != "").select("card_id", "body_text"), "card_id")
    words = rows.select("card_id", "n", F.posexplode(_vectors("body_text", "markup_html")).alias("place", "v"))
    having = lambda layer: F.sum(F.when(F.col(f"v.{layer}"), F.col("n")).otherwise(0))
    return words.groupBy("card_id", "place").agg(having("mark").alias("marked"), having("summary").alias("summarised"))


def weights(counts: DataFrame) -> DataFrame:
    """Counts with their share of the largest count of the card, two decimals, half to even."""
    top = counts.groupBy("card_id").agg(F.max("marked").alias("top"))
    out = counts.join(top, "card_id")
    return out.withColumn("weight", F.when(F.col("top") > 0, F.bround(F.col("marked") / F.col("top"), 2)).otherwise(F.lit(0.0))).drop("top")
