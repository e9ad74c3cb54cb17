"""Query of the timestamp operator."""

from __future__ import annotations

from ..catalog import table
from ..operators.timestamps import publication_times
from .registry import query


@query("p3_found")
def p3_found(spark, sf):
    cards = table(spark, sf, "cards", "id", "source_pub_date", "fullcite", "source_url")
    return publication_times(cards, table(spark, sf, "outlets", "domain", "tz", "day_first"))
