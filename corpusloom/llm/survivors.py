"""Best representative of each duplicate group, field by field, by currency reasoning.

Rows of a group are versions of one record. Each row's value is put into one of a bounded
number of value classes. From rows with a timestamp it is learned which class follows
which: a class precedes another in a group if its last sighting there is older than the
other's first. The votes of all groups make a precedence graph. Where timestamps decide
between the versions of a group, they do; where they are missing or equal, the graph gives
a partial order of the classes that these versions have, and a version of the topologically
latest class wins.

A group is one aggregation with partial results per partition, down to a row per value
class, so it may hold any share of the rows; everything after that is row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import Stage

# Fidelity, from least to most trusted.
TRUST = ("cites_only", "private", "pdf", "opensource")
#: Value classes of a field; the graph that reaches the driver has at most CLASSES ** 2 edges.
CLASSES = 24


@dataclass(frozen=True)
class Field:
    """A field to choose: where it is usable, the class of its value, whether trust goes first."""

    name: str
    usable: Column
    value_class: Column
    by_trust: bool


def squeeze(text: Column) -> Column:
    """Letters and digits in lower case, null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))


def visible(markup: Column) -> Column:
    """Text that a page shows for the markup, without regard to spacing."""
    text = F.regexp_replace(markup, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0*39;|&apos;", "'"), ("&#\\w+;", " "), ("&amp;", "&")):
        text = F.regexp_replace(text, entity, char)
    return text


# The four ways in which full citations are laid out, and what stands for a missing address.
_ADDRESS = r"(?:https?://\S+|no address)"
_DATE = r"(?=[^;“”\"]*\d)[^;“”\"]*?"
LAYOUTS = (
    rf"^\[[^;,]+, [^;]+; {_DATE}; '[^;]+'; [^;]+; {_ADDRESS}\]",
    rf"^[^(\"]+ \([^)]+\)\. \"[^\"]+\" [^.\"]+\. {_DATE}\. {_ADDRESS}",
    rf"^[^,“]+, [^“]+?, {_DATE}, “[^”]+” [^,”]+, {_ADDRESS}",
    rf"^[^–]+ – [^–]+ – [^–]+, {_DATE.replace(';', ';–')} – [^–]+ – {_ADDRESS}",
)


def complete_cite(cite: Column) -> Column:
    """Whether a citation names author, qualification, date, title and outlet and then the
    address, or says that there is none."""
    text = F.trim(F.regexp_replace(cite, r"\s+", " "))
    out = text.rlike(LAYOUTS[0])
    for layout in LAYOUTS[1:]:
        out = out | text.rlike(layout)
    return F.coalesce(out, F.lit(False))


def card_fields() -> list[Field]:
    """markup_html, fullcite and team_count of cards."""
    body = squeeze(F.col("body_text"))
    length = F.coalesce(F.length("markup_html"), F.lit(0))
    step = F.least(F.floor(F.log2(F.greatest(F.col("team_count"), F.lit(1)).cast("double"))).cast("int"), F.lit(CLASSES - 1))
    marks = sum((F.col("markup_html").contains(t).cast("int") * w for t, w in (("<mark>", 1), ("<strong>", 2), ("<h4>", 4), ("<div>", 8))), F.lit(0))
    layout = F.lit(len(LAYOUTS))
    for k, pattern in enumerate(LAYOUTS):
        layout = F.when(F.col("fullcite").rlike(pattern), F.lit(k)).otherwise(layout)
    accessed = F.col("fullcite").rlike("(?i)accessed|doa").cast("int")
    return [
        Field("markup_html", (length > 0) & (body != "") & squeeze(visible(F.col("markup_html"))).contains(body), marks, True),
        Field("fullcite", complete_cite(F.col("fullcite")), layout * 2 + accessed, True),
        Field("team_count", F.col("team_count").between(F.lit(1), F.col("variant_count")), step, False),
    ]


def precedence(votes: list[tuple[int, int, int]]) -> dict[int, frozenset[int]]:
    """For each class those that come after it, from (earlier, later, votes): an edge goes
    the way of the majority, and what follows by several edges follows. Classes that follow
    each other round a cycle have no order among themselves."""
    count: dict[tuple[int, int], int] = {}
    for a, b, n in votes:
        count[a, b] = count.get((a, b), 0) + n
    nodes = sorted({x for e in count for x in e})
    reach = {a: {b for b in nodes if count.get((a, b), 0) > count.get((b, a), 0)} for a in nodes}
    for k in nodes:  # transitive closure over at most CLASSES nodes
        for a in nodes:
            if k in reach[a]:
                reach[a] |= reach[k]
    return {a: frozenset(b for b in reach[a] if a not in reach[b]) for a in nodes}


def _narrow(rows: DataFrame, fields: list[Field], key: str, id_col: str, at: str, trust: str) -> DataFrame:
    """Key, id, time and trust with, per field, its value class where usable, else null. The
    long values are looked at once, here."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TRUST)), F.col(trust)), F.lit(0)).cast("int")
    cells = [F.when(F.coalesce(f.usable, F.lit(False)), F.coalesce(f.value_class.cast("int"), F.lit(-1))).alias(f"c{k}") for k, f in enumerate(fields)]
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(at).alias("at"), rank.alias("trust"), *cells)


def versions(narrow: DataFrame, fields: list[Field]) -> DataFrame:
    """(key, n, v): the number of rows of each key and, of each field and value class in it,
    when the class was first and last seen and the best row that has it. Rows collapse to
    one per (key, field, class) before anything is gathered, so v has at most
    ``len(fields) * (CLASSES + 1)`` entries however many rows a key has."""
    trusted = F.array(*(F.lit(f.by_trust) for f in fields))
    seen = F.array(F.struct(F.lit(-1).alias("f"), F.lit(0).alias("c")), *(F.when(F.col(f"c{k}").isNotNull(), F.struct(F.lit(k).alias("f"), F.col(f"c{k}").alias("c"))) for k in range(len(fields))))
    each = narrow.select("key", "id", "at", "trust", F.explode(F.array_compact(seen)).alias("v")).select("key", "id", "at", "trust", "v.f", "v.c")
    counts = F.coalesce(F.get(trusted, F.col("f")), F.lit(False))
    rank = F.struct(F.when(counts, F.col("trust")).otherwise(0).alias("trust"), F.col("at").isNotNull().alias("known"), F.col("at").alias("at"))
    spans = each.groupBy("key", "f", "c").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.max(rank).alias("rank"),
        F.max_by("id", F.struct(rank.alias("r"), (-F.col("id")).alias("i"))).alias("id"), F.count(F.lit(1)).alias("n"),
    )
    entry = F.struct("f", "c", "first", "last", "rank", "id")
    return spans.groupBy("key").agg(F.max(F.when(F.col("f") < 0, F.col("n"))).alias("n"), F.collect_list(F.when(F.col("f") >= 0, entry)).alias("v"))


def learn_precedence(groups: DataFrame, fields: list[Field]) -> list[dict[int, frozenset[int]]]:
    """Which value classes follow which, per field, learned from all rows with a timestamp."""
    pairs = groups.where(F.size("v") > 1).select(F.explode("v").alias("a"), "v").where("a.last is not null").select("a", F.explode("v").alias("b"))
    votes = pairs.where((F.col("a.f") == F.col("b.f")) & (F.col("a.last") < F.col("b.first"))).groupBy("a.f", F.col("a.c").alias("x"), F.col("b.c").alias("y")).count()
    by: list[list[tuple[int, int, int]]] = [[] for _ in fields]
    for r in votes.collect():  # at most len(fields) * (CLASSES + 1) ** 2 rows
        by[r["f"]].append((r["x"], r["y"], r["count"]))
    return [precedence(v) for v in by]


def best_fields(
    rows: DataFrame, fields: list[Field], key: str = "canonical_key", id_col: str = "id", at: str = "updated_at", trust: str = "fidelity", stage: Stage | None = None
) -> DataFrame:
    """(key, field, id): of each group of two or more rows and each field, the row whose
    value survives; nothing for a field without a usable value.

    Most trusted first where the field says so (an unknown trust is the lowest), then the
    latest timestamp, a null one being older than any other. Where that leaves several
    versions, for times are missing or equal, the value classes among them are ordered by
    the learned precedence, which may leave some without an order; of those that none of the
    others follows, the smallest id is taken. Rows with a null key belong to no group; a null
    usability is none; repeated rows are versions like any other; extra columns are ignored;
    an empty table gives an empty result.
    """
    stage = stage or Stage(rows.sparkSession, "survivors")
    groups = stage.write(versions(_narrow(rows, fields, key, id_col, at, trust), fields), "groups")
    later = learn_precedence(groups, fields)

    def tied(k: int) -> Column:
        """Of a field the versions that trust and time leave."""
        own = F.filter("v", lambda e: e["f"] == k)
        top = F.array_max(F.transform(own, lambda e: e["rank"]))
        return F.filter(own, lambda e: e["rank"] == top)

    picks = [F.struct(F.lit(f.name).alias("field"), tied(k).alias("tied"), F.lit(k).alias("f")) for k, f in enumerate(fields)]
    each = groups.where("n > 1").select("key", F.explode(F.array(*picks)).alias("p")).select("key", "p.field", "p.f", "p.tied").where(F.size("tied") > 0)
    # the partial order of one group: of its classes those that no other one follows
    after = F.create_map(*(x for k, order in enumerate(later) for c, then in sorted(order.items()) for x in (F.lit(k * 100 + c), F.array(*map(F.lit, sorted(then))).cast("array<int>")))) if any(later) else None
    last = F.col("tied")
    if after is not None:
        present = F.transform("tied", lambda e: e["c"])
        follows = lambda e: F.coalesce(F.try_element_at(after, F.col("f") * 100 + e["c"]), F.array().cast("array<int>"))
        last = F.when(F.size("tied") > 1, F.filter("tied", lambda e: ~F.arrays_overlap(follows(e), present))).otherwise(F.col("tied"))
    return each.select(F.col("key").alias(key), "field", F.array_min(F.transform(last, lambda e: e["id"])).alias(id_col))
