"""From raw records to canonical cards and their variants, by set operations.

Every step is a function of frames, so running it again changes nothing, and what counts
as first is an explicit sequence column, never the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..plans.staging import Stage

RECOVERED_LEAST = 40
_PAYLOAD = "tag string, body_text string, is_analytic string"


def map_records(records: DataFrame) -> DataFrame:
    """Record -> card fields, key and status.

    Strings are stripped, empty ones null; tag and body come from the payload where they
    lie there. With a body a record is evidence, with a tag only an analytic; with neither,
    the visible text of its markup is its body if it has 40 characters or more; else its
    status is ``failed`` and it has no key. Null columns, extra columns and repeated rows
    pass through.
    """
    raw = F.from_json("payload", _PAYLOAD)
    rows = records.withColumn("_p", raw)
    shown = X.visible_text(F.col("markup_html"))
    rows = rows.withColumns({
        "tag": X.blank_to_null(F.coalesce("tag", "_p.tag")),
        "body_text": F.coalesce("body_text", "_p.body_text"),
        **{c: X.blank_to_null(F.col(c)) for c in ("cite", "fullcite", "source_url", "source_pub_date", "pocket", "hat", "block", "spoken", "external_id")},
    }).drop("_p", "payload")
    has_body = X.has_text(F.col("body_text"))
    recovered = ~has_body & F.col("tag").isNull() & (F.length(shown) >= RECOVERED_LEAST)
    rows = rows.withColumns({
        "status": F.when(has_body, "evidence").when(F.col("tag").isNotNull(), "analytic").when(recovered, "recovered").otherwise("failed"),
        "body_text": F.when(has_body, F.col("body_text")).when(recovered, shown),
    })
    rows = rows.withColumn("is_analytic", F.col("status") == "analytic")
    rows = rows.withColumn("norm", X.normalize(F.when(F.col("is_analytic"), F.col("tag")).otherwise(F.col("body_text"))))
    return rows.withColumn("canonical_key", F.when(F.col("status") != "failed", X.canonical_key(F.col("norm"), F.col("is_analytic"))))


def canonical_cards(mapped: DataFrame, seq: str = "record_id", existing: DataFrame | None = None) -> DataFrame:
    """One card per key: the first row by ``seq`` wins; address, publication date and full
    citation are filled from the first row that has them. Keys in ``existing`` are left out."""
    rows = mapped.where(F.col("canonical_key").isNotNull())
    if existing is not None:
        rows = rows.join(existing.select("canonical_key"), "canonical_key", "left_anti")
    whole = F.struct("tag", "cite", "body_text", "is_analytic")
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in ("source_url", "source_pub_date", "fullcite")]
    cards = rows.groupBy("canonical_key").agg(F.min(seq).alias("card_id"), F.min_by(whole, F.col(seq)).alias("_w"), *filled)
    return cards.select("card_id", "canonical_key", "_w.*", "source_url", "source_pub_date", "fullcite").withColumn(
        "body_len", F.coalesce(F.length("body_text"), F.lit(0)).cast("long")
    )


def backfill(cards: DataFrame, mapped: DataFrame, seq: str = "record_id") -> DataFrame:
    """Existing cards with nulls among address, date and full citation filled from new rows."""
    fields = ("source_url", "source_pub_date", "fullcite")
    fresh = mapped.where(F.col("canonical_key").isNotNull()).groupBy("canonical_key").agg(
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_{c}") for c in fields)
    )
    out = cards.join(fresh, "canonical_key", "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).drop(*(f"_{c}" for c in fields))


def document_identity(round_id: Column, record_id: Column) -> Column:
    """Stable identity of the document behind a record without a file: its round, else itself."""
    kind = F.when(round_id.isNotNull(), F.concat(F.lit("hf:doc:round:"), round_id.cast("string"))).otherwise(F.concat(F.lit("hf:doc:row:"), record_id.cast("string")))
    return F.sha2(kind, 256)


def attach_variants(mapped: DataFrame, seq: str = "record_id", existing: DataFrame | None = None) -> DataFrame:
    """Variants of cards: of rows with one document and ordinal the first stays. A null
    document or ordinal conflicts with nothing."""
    rows = mapped.where(F.col("canonical_key").isNotNull()).withColumn("document_id", document_identity(F.col("round_id"), F.col("record_id")))
    whole = F.col("document_id").isNotNull() & F.col("ordinal").isNotNull()
    if existing is not None:
        rows = rows.join(existing.select("document_id", "ordinal"), ["document_id", "ordinal"], "left_anti")
    # rows that cannot conflict get a place of their own, so no window holds them all
    order = Window.partitionBy("document_id", "ordinal", F.when(~whole, F.col(seq))).orderBy(seq)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def redirect_keys(rows: DataFrame, merges: DataFrame, cards: DataFrame) -> DataFrame:
    """card_id of each row's key: the card itself, or the survivor of the latest merge that
    absorbed the key, as long as it is alive. ``merges`` has survivor_id, absorbed_key, merged_at."""
    last = merges.groupBy(F.col("absorbed_key").alias("canonical_key")).agg(F.max_by("survivor_id", F.struct("merged_at", "survivor_id")).alias("_s"))
    alive = last.join(cards.select(F.col("card_id").alias("_s")), "_s", "left_semi")
    own = cards.select("canonical_key", F.col("card_id").alias("_own"))
    out = rows.join(alive, "canonical_key", "left").join(own, "canonical_key", "left")
    return out.withColumn("card_id", F.coalesce("_s", "_own")).drop("_s", "_own")


def row_hash(columns: Sequence[str]) -> Column:
    """Hash of the content of a row: its named columns in order of name, nulls kept apart from empty."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def not_in_ledger(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose (source, external_id, sha256) the ledger has not; a new sha is unseen."""
    return rows.join(ledger.select("source", "external_id", "sha256"), ["source", "external_id", "sha256"], "left_anti")


def put_ledger(ledger: DataFrame, rows: DataFrame, at: str = "ingested_at") -> DataFrame:
    """Ledger after an upsert: the latest sha of every (source, external_id)."""
    both = ledger.select("source", "external_id", "sha256", at).unionByName(rows.select("source", "external_id", "sha256", at))
    return both.groupBy("source", "external_id").agg(F.max_by("sha256", F.struct(at, "sha256")).alias("sha256"), F.max(at).alias(at))


def latest_versions(mapped: DataFrame, key: Column, seq: Sequence[str] = ("received_at", "record_id")) -> DataFrame:
    """Of rows with one external id the latest version; rows without an id all stay."""
    lone = F.when(key.isNull(), F.col(seq[-1]))
    order = Window.partitionBy(key, lone).orderBy(*(F.col(c).desc_nulls_last() for c in seq))
    return mapped.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def external_number(external_id: Column) -> Column:
    """Number in an external id without leading zeros."""
    return F.regexp_replace(F.nullif(F.regexp_extract(external_id, r"(\d+)\D*$", 1), F.lit("")), "^0+(?=.)", "")


def get_or_create(wanted: DataFrame, natural: Sequence[str], existing: DataFrame, id_col: str = "id") -> DataFrame:
    """``existing`` (id and natural key) plus rows for the keys of ``wanted`` it has not,
    numbered on in the order of the key. Null in a key equals null. Everything is read at
    once, so rows that are numbered keep their numbers whatever changes afterwards."""
    same = None
    for c in natural:
        test = F.col(f"w.{c}").eqNullSafe(F.col(f"e.{c}"))
        same = test if same is None else same & test
    fresh = wanted.select(*natural).distinct().alias("w").join(existing.alias("e"), same, "left_anti")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    ranked = number_rows(fresh, natural, "_n").crossJoin(F.broadcast(top))  # one row
    return existing.select(id_col, *natural).unionByName(ranked.select((F.col("_top") + F.col("_n")).cast("long").alias(id_col), *natural))


def number_rows(df: DataFrame, order: Sequence[str], name: str, stage: Stage | None = None) -> DataFrame:
    """1, 2, ... in ``order`` (nulls first) without one task for all rows; rows that are
    equal in ``order`` follow each other in no particular order. An empty frame stays empty."""
    placed = ranged(df, [F.col(c).asc_nulls_first() for c in order], stage or Stage(df.sparkSession, "numbered"))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # one row per partition
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def ranged(df: DataFrame, order: Sequence[Column], stage: Stage) -> DataFrame:
    """``df`` in range partitions of ``order``, with the number of each row's partition
    (``_p``) and its place in there from 1 (``_i``).

    Bounds are sampled, so two plans over one frame would have two sets of them: the rows
    are written once with their places, and whatever is derived reads the stored table. Rows
    that are equal in ``order`` are told apart by a hash of all they hold, so no range
    partition gets all rows of a frequent value.
    """
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "struct", "array", "variant"))]
    order = [*order, F.xxhash64(*plain)]
    # partition number and place of a row, as Spark packs them
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = at.withColumns({"_p": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1})
    return stage.write(at.drop("_at"), "ranged")


def index_rows(cards: DataFrame, variants: DataFrame) -> DataFrame:
    """What full text search reads of a card: cite with full citation, blocks of all variants."""
    blocks = variants.where(F.col("block") != "").groupBy("card_id").agg(F.array_join(F.array_sort(F.collect_set("block")), " ; ").alias("block"))
    out = cards.join(blocks, "card_id", "left")
    return out.select(
        "card_id", F.coalesce("tag", F.lit("")).alias("tag"), F.concat_ws(" ", "cite", "fullcite").alias("cite"),
        F.coalesce("block", F.lit("")).alias("block"), F.coalesce("body_text", F.lit("")).alias("body"),
    )


def card_aggregates(cards: DataFrame, variants: DataFrame, disclosures: DataFrame) -> DataFrame:
    """variant_count, team_count, school_count and first_season of every card, derived anew.
    Variants without a round count as variants only."""
    n = variants.groupBy("card_id").agg(F.count(F.lit(1)).alias("variant_count"))
    reach = disclosures.groupBy("card_id").agg(
        F.countDistinct("team_id").alias("team_count"), F.countDistinct("school_id").alias("school_count"), F.min("season").alias("first_season")
    )
    out = cards.select("card_id").join(n, "card_id", "left").join(reach, "card_id", "left")
    return out.select("card_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("variant_count", "team_count", "school_count")), "first_season")


def apply_merges(table: DataFrame, final: DataFrame, key: Sequence[str], card: str = "card_id") -> DataFrame:
    """Rows of ``table`` moved from absorbed cards to their survivors (old_id, survivor_id).
    Where a survivor has a row with the same ``key`` already, its own stays."""
    moved = table.join(final, table[card] == final.old_id, "left").withColumn("_own", F.col("old_id").isNull())
    moved = moved.withColumn(card, F.coalesce("survivor_id", card)).drop("old_id", "survivor_id")
    if not key:
        return moved.drop("_own")
    order = Window.partitionBy(card, *key).orderBy(F.col("_own").desc(), *(F.col(c) for c in table.columns if c != card))
    return moved.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r", "_own")
