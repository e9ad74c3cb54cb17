"""Deduplicating batches against everything accepted before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.staging import Stage
from .components import connected_components, key_edges, member_forests
from .features import describe
from .graphindex import HistoryIndex

_PAYLOAD = "tag string, body_text string, is_analytic string"
#: What a call keeps beside its shards: links between records that it found, of each key (number
#: or normal form) a record, and the batch of each record.
_KEPT = {"ties": "node bigint, root bigint", "heads": "record_id bigint, key string", "records": "record_id bigint, batch_no int"}
def unpacked_records(records: DataFrame) -> DataFrame:
    """(record_id, batch_no, number, kind, text): the number of the external id without
    leading zeros, and the text that counts (tag of an analytic, else body_text), taken
    from the payload where it lies there. A null flag means evidence."""
    raw = F.from_json("payload", _PAYLOAD)
    rows = records.select("record_id", "batch_no", "external_id", "tag", "body_text", "is_analytic", raw.alias("p"))
    said = F.lower(F.trim("p.is_analytic")).isin("true", "t", "yes", "y", "1")
    kind = F.coalesce("is_analytic", said, F.lit(False))
    digits = F.nullif(F.regexp_extract("external_id", r"(\d+)\D*$", 1), F.lit(""))
    return rows.select(
        "record_id", "batch_no", F.regexp_replace(digits, "^0+(?=.)", "").alias("number"), kind.alias("kind"),
        F.when(kind, F.coalesce("tag", "p.tag")).otherwise(F.coalesce("body_text", "p.body_text")).alias("text"),
    )


class History:
    """Everything accepted so far, in a folder that only grows.

    ``accept`` takes one batch or several and checks each against all earlier ones: it reads
    its own records, the band keys of the history and the shards in which one of its own
    occurs, never a record or a result of earlier calls. ``groups`` and
    ``first_accepted`` give what holds over all calls. A batch may come in several calls
    and a record again; a call that fails has accepted nothing and is repeated. One call at
    a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.index = spark, HistoryIndex(spark, path)

    def _kept(self, name: str) -> DataFrame:
        folders = [f"{self.index.path}/{c}/{name}" for c in self.index.calls]
        return self.spark.read.schema(_KEPT[name]).parquet(*folders)

    def accept(self, records: DataFrame, stage: Stage | None = None) -> None:
        stage = stage or Stage(self.spark, "history")
        rows = unpacked_records(records).withColumn("batch_no", F.coalesce("batch_no", F.lit(-(2**31))))
        # a name of its own for every attempt, so that none overwrites what another has written
        call = f"call-{len(self.index.calls)}-{uuid.uuid4().hex}"
        keep = f"{self.index.path}/{call}"
        features = stage.write(describe(rows, "record_id", "batch_no", once=["batch_no"]), "features")
        texts = features.where("words is not null").select(
            "batch_no", F.col("record_id").alias("rep"), "kind", F.xxhash64("kind", "key_a", "key_b").alias("spread"), "s0", "s1", F.transform("bands", lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int")).alias("bands"), "words"
        )
        self.index.compact(f"merged-{call}")
        sizes = texts.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("words") / 4).cast("long").alias("w"))
        sizes = sorted((r["batch_no"], r["n"], r["w"]) for r in sizes.collect())  # one row per batch
        links = self.index.add(texts, sizes, f"shards-{call}", stage)
        form = F.concat_ws("-", F.col("kind").cast("string"), "key_a", "key_b").alias("key")
        members = rows.where("number is not null").select("record_id", F.concat(F.lit("x"), "number").alias("key"))
        ties, heads = member_forests(members.unionByName(features.select("record_id", form)), stage)
        ties = ties.unionByName(links.select(F.col("a").alias("node"), F.col("b").alias("root")))
        ties.write.parquet(f"{keep}/ties")
        heads.select(F.col("node").alias("record_id"), "key").write.parquet(f"{keep}/heads")
        rows.groupBy("record_id").agg(F.min("batch_no").alias("batch_no")).write.parquet(f"{keep}/records")
        self.index.commit(call)
        stage.clear()

    def groups(self, stage: Stage) -> DataFrame:
        """(node, component) of every record linked to another; component is its smallest."""
        heads = self._kept("heads").select(F.col("record_id").alias("node"), "key")
        return connected_components(self._kept("ties").unionByName(key_edges(heads)), stage)

    def first_accepted(self, stage: Stage | None = None) -> DataFrame:
        """(first_id, record_id) of every record whose group goes back to an earlier batch."""
        stage = stage or Stage(self.spark, "accepted")
        when = self._kept("records").groupBy("record_id").agg(F.min("batch_no").alias("batch_no"))
        labels = self.groups(stage)
        placed = labels.join(when, labels.node == when.record_id).select("record_id", "component", "batch_no")
        # a group may be any share of all rows: its head is joined on eight keys
        heads = placed.where(F.col("record_id") == F.col("component")).select("component", F.col("batch_no").alias("first_batch"), F.explode(F.array(*map(F.lit, range(8)))).alias("salt"))
        placed = placed.withColumn("salt", F.pmod("record_id", F.lit(8)).cast("int"))
        out = placed.join(heads, ["component", "salt"]).where("first_batch < batch_no")
        return out.select(F.col("component").alias("first_id"), "record_id")


def first_accepted(records: DataFrame, stage: Stage | None = None, index: str | None = None) -> DataFrame:
    """(first_id, record_id) of every record that goes back to one of an earlier batch.

    Records are linked by the number of their external_id or by texts of one kind that are
    the same or the same up to small edits; first_id is the smallest record reached by such
    links. Batches are accepted by a ``History`` in order. Records without a number and
    without a word in their text are linked to nothing; a null batch_no counts as the first
    batch; repeated rows of one record_id are one record; extra columns are ignored; an
    empty table gives an empty result.

    With ``index``, a folder, records are accepted for good: the result is that of one call
    over the records of all calls on the folder.
    """
    stage = stage or Stage(records.sparkSession, "history")
    history = History(records.sparkSession, index or stage.path("index"))
    history.accept(records)
    return history.first_accepted(stage)
