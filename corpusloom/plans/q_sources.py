"""Queries of sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as L, shards as H
from ..sources.export import export_boxes
from ..streaming import windows as W
from ..streaming.ingest import ingest_stream
from .corpus import Corpus
from .oracle import corpus as sql
from .registry import query
from .staging import Stage


def _bulk(spark, sf):
    """Card records in the columns of the bulk data."""
    r = Corpus(spark, sf).table("card_records", "record_id", "tag", "body_text", "team_id", "batch_no")
    event = F.when(F.pmod("team_id", F.lit(3)) == 0, "pf").when(F.pmod("team_id", F.lit(3)) == 1, "ld").otherwise("cx")
    return r.select(F.col("record_id").alias("id"), event.alias("event"), F.col("batch_no").cast("string").alias("duplicateCount"), F.concat(F.lit("list-"), F.pmod("batch_no", F.lit(3)).cast("string")).alias("caselistName"))


_BULK = "(SELECT record_id AS id, CASE team_id % 3 WHEN 0 THEN 'pf' WHEN 1 THEN 'ld' ELSE 'cx' END AS event, batch_no::VARCHAR AS dup, 'list-' || batch_no % 3 AS list FROM card_records)"


@query("q_s1_scan", f"SELECT id FROM {_BULK} WHERE event IN ('pf', 'ld') AND (event = 'pf' OR try_cast(dup AS INT) >= 5)")
def _(spark, sf):
    return H.keep(_bulk(spark, sf), ("pf", "ld"), 5).select("id")


@query("q_s2_census", f"SELECT event, list AS caselistName, count(*) AS n FROM {_BULK} GROUP BY 1, 2")
def _(spark, sf):
    stage = Stage(spark, "census")
    stage.write(_bulk(spark, sf), "shards")
    return H.census(spark, [stage.path("shards")]).groupBy("event", "caselistName").agg(F.sum("n").alias("n"))


@query("q_s3_pruned_scan", f"SELECT id FROM {_BULK} WHERE event = 'ld'")
def _(spark, sf):
    stage = Stage(spark, "pruned")
    rows = _bulk(spark, sf)
    rows.repartition("event").write.partitionBy("caselistName").parquet(stage.path("shards"))
    files = H.shards_of(H.census(spark, [stage.path("shards")]), ["ld"])
    return spark.read.schema("id bigint, event string").parquet(*files).where("event = 'ld'").select("id")


@query("q_s7_lookup", f"SELECT id FROM {_BULK} WHERE id IN (SELECT card_id_a FROM dedup_pairs)")
def _(spark, sf):
    return H.lookup(_bulk(spark, sf), Corpus(spark, sf).table("dedup_pairs").select(F.col("card_id_a").alias("id"))).select("id")


@query("q_s12_provenance", "SELECT id, CASE WHEN len(p) >= 3 THEN p[-3] WHEN len(p) = 2 THEN p[1] END AS school, CASE WHEN len(p) >= 3 THEN p[-2] END AS team FROM (SELECT id, list_filter(string_split(regexp_replace(source_url, '^https://', ''), '/'), lambda x: x NOT IN ('', '.', '..')) AS p FROM cards WHERE source_url IS NOT NULL)")
def _(spark, sf):
    c = Corpus(spark, sf).table("cards", "id", "source_url").where("source_url is not null")
    school, team = L.provenance(F.regexp_replace("source_url", "^https://", ""))
    return c.select("id", school.alias("school"), team.alias("team"))


@query("q_s13_choose_archive", "SELECT name FROM (SELECT DISTINCT caselist || CASE WHEN id % 2 = 0 THEN '-all-' ELSE '-weekly-' END || '2024-' || lpad((id % 12 + 1)::VARCHAR, 2, '0') || '-01.zip' AS name FROM schools) ORDER BY contains(name, '-all-') DESC, replace(regexp_extract(name, '(\\d{4}-?\\d{2}-?\\d{2})', 1), '-', '') DESC, name LIMIT 1")
def _(spark, sf):
    s = Corpus(spark, sf).table("schools", "id", "caselist")
    kind = F.when(F.pmod("id", F.lit(2)) == 0, "-all-").otherwise("-weekly-")
    month = F.lpad((F.pmod("id", F.lit(12)) + 1).cast("string"), 2, "0")
    return L.choose_archive(s.select(F.concat("caselist", kind, F.lit("2024-"), month, F.lit("-01.zip")).alias("name")).distinct())


@query("q_s17_is_pf", "SELECT id, CASE WHEN state IS NOT NULL THEN lower(state) = 'pf' ELSE regexp_matches(lower(caselist || ' ' || name), 'pf([^a-z]|$)') END AS pf FROM schools")
def _(spark, sf):
    return Corpus(spark, sf).table("schools").select("id", H.is_pf(F.col("state"), F.col("caselist"), F.col("name")).alias("pf"))


@query("q_s18_since", "SELECT id FROM topics WHERE season IS NULL OR season >= 2023")
def _(spark, sf):
    return H.since(Corpus(spark, sf).topics, "from 2023 on", "season").select("id")


@query("q_r11_cites_only", "SELECT record_id, (coalesce(length(cite), 0) = 0) AS is_analytic, coalesce(ordinal, -(record_id + 1)) AS ordinal FROM card_records WHERE fidelity = 'cites_only'")
def _(spark, sf):
    r = Corpus(spark, sf).table("card_records").where("fidelity = 'cites_only'")
    rows = r.select(F.col("record_id").alias("round_id"), F.col("ordinal").alias("cite_id"), "tag", F.col("tag").alias("title"), F.col("cite").alias("cites"), F.col("record_id").alias("place"))
    return L.cites_only(rows).select(F.col("round_id").alias("record_id"), "is_analytic", "ordinal")


@query("q_s8_docx_round_trip", sql("SELECT card_id, list_aggregate(regexp_extract_all(tag, '[^\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+'), 'string_agg', ' ') AS tag FROM cards2 WHERE tag IS NOT NULL", "variant"))
def _(spark, sf):
    """Every card written to a file of its own and read back."""
    cards = Corpus(spark, sf).cards.where("tag is not null").select(F.col("card_id").alias("box_id"), F.lit(0).alias("place"), "tag", "cite", "fullcite", "body_text")
    files = export_boxes(cards.withColumns({c: F.lit(None).cast("string") for c in ("markup_html", "pocket", "hat", "block")}))
    files = files.select(F.concat(F.col("box_id").cast("string"), F.lit(".docx")).alias("path"), "content", F.sha2("content", 256).alias("sha256"))
    return L.parse_files(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("card_id"), "tag")


# --- streams ------------------------------------------------------------------------------


@query("q_z1_stream_ingest", sql("""
, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ltrim(regexp_extract(external_id, '(\\d+)\\D*$', 1), '0') ORDER BY received_at DESC NULLS LAST, record_id DESC) AS rn FROM mapped) WHERE rn = 1)
SELECT canonical_key, min(record_id) AS card_id, count(*) AS n_rows FROM latest WHERE canonical_key IS NOT NULL GROUP BY 1""", "mapped"))
def _(spark, sf):
    stage = Stage(spark, "stream")
    records = Corpus(spark, sf).table("card_records")
    # every batch a file of its own, hence a micro-batch
    records.withColumn("arrival", F.col("batch_no")).repartition("arrival").write.partitionBy("arrival").parquet(stage.path("arrived"))
    sink = ingest_stream(spark, f"{stage.path('arrived')}/arrival=*", records.schema, stage.path("corpus"))
    rows = sink.read("rows").where("canonical_key is not null").groupBy("canonical_key").agg(F.count(F.lit(1)).alias("n_rows"))
    return sink.read("cards").select("canonical_key", "card_id").join(rows, "canonical_key")


@query("q_z2_exactly_once", sql("""
, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ltrim(regexp_extract(external_id, '(\\d+)\\D*$', 1), '0') ORDER BY received_at DESC NULLS LAST, record_id DESC) AS rn FROM mapped) WHERE rn = 1)
SELECT record_id, status FROM latest""", "mapped"))
def _(spark, sf):
    """Every batch delivered, some again, some after a compaction: each record counts once."""
    from ..streaming.ingest import CorpusSink

    sink = CorpusSink(spark, Stage(spark, "twice").path("corpus"))
    records = Corpus(spark, sf).table("card_records")
    for turn in (0, 1, 1, 2):
        sink.merge(records.where(F.pmod("batch_no", F.lit(3)) == turn), turn)
    sink.compact()
    sink.merge(records.where(F.pmod("batch_no", F.lit(3)) == 0), 0)
    return sink.read("rows").select("record_id", "status")


@query("q_z6_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    out = W.run(W.tumbling(W.events(spark, sf)), Stage(spark, "tumbling"), "out", "complete")
    return out.withColumn("total", F.round("total", 4))


@query("q_z6_sliding", "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01') - INTERVAL 12 HOURS * k AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2")
def _(spark, sf):
    out = W.run(W.sliding(W.events(spark, sf)), Stage(spark, "sliding"), "out", "complete")
    return out.withColumn("total", F.round("total", 4))


@query("q_z6_sessions", """WITH g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def _(spark, sf):
    return W.run(W.sessions(W.events(spark, sf)), Stage(spark, "sessions"), "out", "complete")


@query("q_z6_dedup_events", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    """Every event delivered three times, in several files."""
    stage = Stage(spark, "repeats")
    once = Corpus(spark, sf).table("events")
    once.unionByName(once).unionByName(once).repartition(6).write.parquet(stage.path("in/events.parquet"))
    # a replay reads all files in one trigger: their times overlap, and none is late
    stream = W.events(spark, stage.path("in"), files_per_batch=1_000_000)
    return W.run(W.without_repeats(stream, "event_id").select("event_id", "event_type"), stage, "out")
