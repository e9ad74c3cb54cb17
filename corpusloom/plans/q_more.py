"""Queries of what reads, writes and keeps: archives, documents, seeds, stores, published sets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as D, ingest as I, publish as B, topics as G
from ..operators.fulltext import TextIndex
from ..sources import files as L, shards as H
from ..sources.export import export_boxes, write_docx
from ..streaming.ingest import ingest_stream
from .corpus import Corpus
from .grammar import Term
from .oracle import corpus as sql
from .q_sources import _BULK, _bulk
from .q_text import _card_rows
from .registry import query
from .staging import Stage


def _shards(spark, sf) -> list[str]:
    stage = Stage(spark, "bulk")
    rows = _bulk(spark, sf)
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in H.BULK_COLUMNS)).write.parquet(stage.path("shards"))
    return [stage.path("shards")]


@query("q_s5_scan_limit", "SELECT least(count(*), 1000) AS n FROM card_records")
def _(spark, sf):
    """A first look at the data: the limit counts rows before the filter, here one that all pass."""
    return H.scan(spark, _shards(spark, sf), ("pf", "ld", "cx"), limit=1000).agg(F.count(F.lit(1)).alias("n"))


@query("q_s6_sample", f"SELECT id FROM {_BULK} WHERE event = 'ld'")
def _(spark, sf):
    """A sample of the whole of one event."""
    return H.sample(spark, _shards(spark, sf), ("ld",), 1.0).select("id")


_SQUEEZED = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"
_TAG = "list_aggregate(regexp_extract_all(tag, '[^\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+'), 'string_agg', ' ')"


def _archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k, rows in batch.groupby("archive"):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for r in rows.itertuples():
                    z.writestr(f"School/Team/{r.id}.docx", write_docx([{"tag": r.tag, "body_text": r.body_text}]))
                z.writestr(f"School/Team/{-k}-{rows.id.min()}.docx", b"broken")
                z.writestr("School/ignored.png", b"x")
            yield pd.DataFrame({"path": [f"{k}-{rows.id.min()}.zip"], "content": [held.getvalue()]})


@query("q_s11_archives", f"SELECT id, 'parsed' AS status, {_TAG} AS tag FROM cards WHERE coalesce(is_analytic, false) AND {_TAG} <> ''")
def _(spark, sf):
    """Analytics in .docx files in zip archives, with an entry that cannot be read and one of another kind in each."""
    cards = Corpus(spark, sf).table("cards", "id", "tag", "is_analytic").where(F.col("is_analytic") & X.has_text(F.col("tag")))
    packed = cards.select(F.pmod("id", F.lit(7)).alias("archive"), "id", "tag", F.lit(None).cast("string").alias("body_text")).mapInPandas(_archives, "path string, content binary")
    got = L.parse_files(L.unzip(packed)).where("status <> 'failed'")
    return got.select(F.regexp_extract("path", r"/(\d+)\.docx$", 1).cast("bigint").alias("id"), "status", "tag")


_HEADED = "SELECT record_id, document_id, pocket, hat, block, tag FROM variant WHERE pocket IS NOT NULL AND hat IS NOT NULL AND block IS NOT NULL AND tag IS NOT NULL"


def _documents(spark, sf):
    """Documents of rounds as .docx files, cards in order under their headings."""
    v = Corpus(spark, sf)
    full = v.variants.where("pocket is not null and hat is not null and block is not null").join(v.mapped.select("record_id", "tag").where("tag is not null"), "record_id")
    rows = full.select(F.col("document_id").alias("box_id"), F.col("record_id").alias("place"), "tag", "pocket", "hat", "block")
    files = export_boxes(rows.withColumns({c: F.lit(None).cast("string") for c in ("cite", "fullcite", "body_text", "markup_html")}))
    return files.select(F.concat("box_id", F.lit(".docx")).alias("path"), "content", F.sha2("content", 256).alias("sha256"))


@query("q_w8_headings", sql(f"SELECT pocket, hat, block, {_TAG} AS tag, count(*) AS n FROM ({_HEADED}) GROUP BY ALL", "variant"))
def _(spark, sf):
    """Headings are written where they change and carried down to every card on reading."""
    got = L.parse_files(_documents(spark, sf))
    return got.groupBy("pocket", "hat", "block", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("q_e4_udtf", sql(f"SELECT {_TAG} AS tag, count(*) AS n FROM ({_HEADED}) GROUP BY ALL", "variant"))
def _(spark, sf):
    """The parser as a table function of SQL."""
    spark.udtf.register("parse_card_file", L.ParseCardFile)
    files = Stage(spark, "udtf").write(_documents(spark, sf), "files")
    files.createOrReplaceTempView("card_files")
    return spark.sql("SELECT c.tag, count(*) AS n FROM card_files f, LATERAL parse_card_file(f.path, f.content) c GROUP BY c.tag")


@query("q_s15_topics", "SELECT season, slot, code, resolution, starts, ends FROM topics")
def _(spark, sf):
    """Topics written as a seed file and loaded from it."""
    stage = Stage(spark, "seed")
    topics = Corpus(spark, sf).table("topics", "season", "slot", "code", "resolution", "starts", "ends")
    seed = topics.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))  # a fixed list
    seed.coalesce(1).write.text(stage.path("seed"))
    return G.load_topics(spark, stage.path("seed"))[0].select("season", "slot", "code", "resolution", "starts", "ends")


@query("q_k7_store", "SELECT sha256(text) AS sha256, count(*) AS n FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def _(spark, sf):
    """Contents kept by their hash; what is there already stays one."""
    stage = Stage(spark, "blobs")
    d = Corpus(spark, sf).table("documents", "doc_id", "text").where("text is not null")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), F.sha2("text", 256).alias("sha256"))
    files = files.groupBy("sha256").agg(F.min("path").alias("path"), F.first("content").alias("content"))
    for _turn in range(2):
        L.store(files, stage.path("blobs"))
    return spark.read.parquet(stage.path("blobs")).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


@query("q_k14_generations", sql("SELECT card_id, team_count FROM total"))
def _(spark, sf):
    """Three generations published, of which the second and third stay; the last is read back."""
    stage = Stage(spark, "generations")
    t = Corpus(spark, sf).totals.select("card_id", "team_count")
    for cards in (t.where("team_count > 1"), t.where("team_count > 0"), t):
        B.write_generation(cards, stage.path("site"), rows_per_file=500)
    return B.read_generation(spark, stage.path("site"))


@query("q_k16_site_stats", sql("SELECT (SELECT count(*) FROM cards2 WHERE NOT is_analytic) AS cards, (SELECT count(*) FROM cards2 WHERE is_analytic) AS analytics, count(DISTINCT team_id) AS teams, count(DISTINCT school_id) AS schools FROM disc", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    stats = spark.createDataFrame([(B.site_stats(c.cards, c.disclosures),)], "j string")
    return stats.select(F.from_json("j", "cards bigint, analytics bigint, teams bigint, schools bigint").alias("s")).select("s.*")


@query("q_x26_human_bytes", "SELECT id, CASE WHEN n >= 1024::BIGINT ** 4 THEN printf('%.1f TB', n / 1024::BIGINT ** 4) WHEN n >= 1024 ** 3 THEN printf('%.1f GB', n / 1024 ** 3) WHEN n >= 1024 ** 2 THEN printf('%.1f MB', n / 1024 ** 2) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024) ELSE n || ' B' END AS shown FROM (SELECT id, id * id * id * 17 AS n FROM cards)")
def _(spark, sf):
    """From id 815606 on the size is beyond bigint: the SQL needs wider ids there, this does not."""
    return Corpus(spark, sf).table("cards", "id").select("id", X.human_bytes(F.col("id"), F.col("id"), F.col("id"), F.lit(17)).alias("shown"))


@query("q_t5_block_scope", sql("SELECT DISTINCT card_id FROM (SELECT card_id, regexp_extract_all(lower(string_agg(block, ' ; ' ORDER BY block)), '[a-z0-9]+') AS w FROM (SELECT DISTINCT card_id, block FROM variant WHERE block <> '') GROUP BY 1) WHERE list_contains(w, 'pathogen') OR list_contains(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), 'alliance bad')", "variant"))
def _(spark, sf):
    """A word and a phrase that must stand in the block; elsewhere they do not count."""
    c = Corpus(spark, sf)
    index = TextIndex.build(I.index_rows(c.cards, c.variants), Stage(spark, "blocks"), False)
    return index.any_of([Term("pathogen", "block"), Term("alliance bad", "block")])


@query("q_d11_second_run", "SELECT 0::BIGINT AS merges")
def _(spark, sf):
    """What a second run over the survivors of the first merges."""
    stage = Stage(spark, "d11")
    cards = stage.write(D.universe(_card_rows(spark, sf)), "universe")
    first = stage.write(D.greedy_merges(cards, stage.write(D.candidate_pairs(cards), "candidates"), stage), "merges")
    left = stage.write(cards.join(first.select(F.col("absorbed_id").alias("card_id")), "card_id", "left_anti"), "left")
    again = Stage(spark, "d11-again")
    return D.greedy_merges(left, again.write(D.candidate_pairs(left), "candidates"), again).agg(F.count(F.lit(1)).alias("merges"))


@query("q_z3_resume", sql("""
, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ltrim(regexp_extract(external_id, '(\\d+)\\D*$', 1), '0') ORDER BY received_at DESC NULLS LAST, record_id DESC) AS rn FROM mapped) WHERE rn = 1)
SELECT record_id, status FROM latest""", "mapped"))
def _(spark, sf):
    """A stream that stops after half of the batches, is folded, and goes on from its checkpoint."""
    stage = Stage(spark, "resume")
    records = Corpus(spark, sf).table("card_records")
    for part in ("batch_no <= 6", "batch_no > 6 or batch_no is null"):
        records.where(part).withColumn("arrival", F.coalesce("batch_no", F.lit(-1))).repartition("arrival").write.mode("append").partitionBy("arrival").parquet(stage.path("arrived"))
        sink = ingest_stream(spark, f"{stage.path('arrived')}/arrival=*", records.schema, stage.path("corpus"), files_per_batch=3)
        sink.compact()
    return sink.read("rows").select("record_id", "status")
