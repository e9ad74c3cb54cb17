"""Queries over the ingested corpus: keys, joins, filters, aggregates, rankings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import analytics as A, filters as P, ingest as I, topics as G
from .corpus import Corpus
from .oracle import corpus as sql, norm
from .registry import query

TODAY = "2024-10-15"
OVERRIDES = [("round robin", "SO", None), ("open", None, "2023-APR"), ("ford open", "JAN", None), ("classic", "NOPE", None), ("class", None, "2022-FEB")]


def _overrides(spark):
    return spark.createDataFrame(OVERRIDES, "match string, slot string, code string")


_OVERRIDES_SQL = "(VALUES " + ", ".join(str(tuple(x)).replace("None", "NULL") for x in OVERRIDES) + ") AS o(match, slot, code)"


# --- keys and ingest -----------------------------------------------------------------


@query("q_p1_map_records", sql("SELECT record_id, status, is_analytic, canonical_key FROM mapped", "mapped"))
def _(spark, sf):
    return Corpus(spark, sf).mapped.select("record_id", "status", "is_analytic", "canonical_key")


@query("q_x2_canonical_key", f"SELECT id, sha256(CASE WHEN coalesce(is_analytic, false) THEN '1:analytic:' || {norm('tag')} ELSE '1:' || {norm('body_text')} END) AS computed_key, canonical_key FROM cards")
def _(spark, sf):
    c = Corpus(spark, sf).table("cards", "id", "canonical_key", "is_analytic", "tag", "body_text")
    kind = F.coalesce("is_analytic", F.lit(False))
    return c.select("id", X.canonical_key(X.normalize(F.when(kind, F.col("tag")).otherwise(F.col("body_text"))), kind).alias("computed_key"), "canonical_key")


@query("q_x1_normalize", f"SELECT record_id, {norm('tag')} AS norm_tag, {norm('cite')} AS norm_cite FROM card_records")
def _(spark, sf):
    return Corpus(spark, sf).table("card_records", "record_id", "tag", "cite").select("record_id", X.normalize(F.col("tag")).alias("norm_tag"), X.normalize(F.col("cite")).alias("norm_cite"))


@query("q_k1_canonical_cards", sql("SELECT card_id, canonical_key, tag, cite, body_len, is_analytic, source_url, source_pub_date, fullcite FROM cards2", "variant"))
def _(spark, sf):
    return Corpus(spark, sf).cards.drop("body_text")


@query("q_k1_insert_if_absent", sql("SELECT min(record_id) AS card_id, canonical_key FROM mapped WHERE batch_no > 6 AND canonical_key IS NOT NULL AND canonical_key NOT IN (SELECT canonical_key FROM mapped WHERE batch_no <= 6 AND canonical_key IS NOT NULL) GROUP BY 2", "mapped"))
def _(spark, sf):
    m = Corpus(spark, sf).mapped
    old = I.canonical_cards(m.where("batch_no <= 6"))
    return I.canonical_cards(m.where("batch_no > 6"), existing=old).select("card_id", "canonical_key")


@query("q_k1_backfill", sql("""
SELECT a.canonical_key, coalesce(arg_min(m.source_url, m.record_id) FILTER (m.batch_no <= 3 AND m.source_url IS NOT NULL), arg_min(m.source_url, m.record_id) FILTER (m.batch_no > 3 AND m.source_url IS NOT NULL)) AS source_url
FROM (SELECT DISTINCT canonical_key FROM mapped WHERE batch_no <= 3 AND canonical_key IS NOT NULL) a JOIN mapped m USING (canonical_key) GROUP BY 1""", "mapped"))
def _(spark, sf):
    m = Corpus(spark, sf).mapped
    return I.backfill(I.canonical_cards(m.where("batch_no <= 3")), m.where("batch_no > 3")).select("canonical_key", "source_url")


@query("q_k2_redirect", sql("""
SELECT m.record_id, coalesce(s.survivor, c.card_id) AS card_id FROM mapped m JOIN card c USING (canonical_key)
LEFT JOIN (SELECT * FROM (SELECT ca.canonical_key AS absorbed, p.card_id_a AS survivor, row_number() OVER (PARTITION BY ca.canonical_key ORDER BY p.logged_at DESC, p.card_id_a DESC) AS rn
  FROM dedup_pairs p JOIN card ca ON ca.card_id = p.card_id_b WHERE p.merged AND p.card_id_a IS NOT NULL) WHERE rn = 1) s
  ON s.absorbed = m.canonical_key AND s.survivor IN (SELECT card_id FROM card)
WHERE m.canonical_key IS NOT NULL""", "variant"))
def _(spark, sf):
    c = Corpus(spark, sf)
    pairs = c.table("dedup_pairs").where("merged and card_id_a is not null")
    merges = pairs.join(c.cards.select(F.col("card_id").alias("card_id_b"), F.col("canonical_key").alias("absorbed_key")), "card_id_b")
    merges = merges.select(F.col("card_id_a").alias("survivor_id"), "absorbed_key", F.col("logged_at").alias("merged_at"))
    rows = c.mapped.where("canonical_key is not null").select("record_id", "canonical_key")
    return I.redirect_keys(rows, merges, c.cards).select("record_id", "card_id")


@query("q_k3_variants", sql("SELECT record_id, card_id, ordinal FROM variant", "variant"))
def _(spark, sf):
    return Corpus(spark, sf).variants.select("record_id", "card_id", "ordinal")


@query("q_k4_get_or_create", """
WITH have AS (SELECT id, caselist, name FROM schools WHERE state IS NOT NULL), w AS (SELECT DISTINCT caselist, name FROM schools),
fresh AS (SELECT caselist, name, row_number() OVER (ORDER BY caselist NULLS FIRST, name NULLS FIRST) AS n FROM w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.caselist IS NOT DISTINCT FROM w.caselist AND h.name IS NOT DISTINCT FROM w.name))
SELECT * FROM have UNION ALL SELECT (SELECT max(id) FROM have) + n, caselist, name FROM fresh""")
def _(spark, sf):
    s = Corpus(spark, sf).table("schools", "id", "caselist", "name", "state")
    return I.get_or_create(s, ["caselist", "name"], s.where("state is not null").select("id", "caselist", "name"))


@query("q_k5_ledger", """
WITH r AS (SELECT record_id, batch_no, ltrim(regexp_extract(external_id, '(\\d+)\\D*$', 1), '0') AS x, coalesce(tag, '') || '|' || coalesce(body_text, '') || '|' || coalesce(payload, '') AS content FROM card_records)
SELECT record_id FROM r WHERE batch_no > 6 AND NOT EXISTS (SELECT 1 FROM r o WHERE o.batch_no <= 6 AND o.x = r.x AND o.content = r.content)""")
def _(spark, sf):
    r = Corpus(spark, sf).table("card_records")
    rows = r.select(
        "record_id", "batch_no", F.lit("records").alias("source"), I.external_number(F.col("external_id")).alias("external_id"),
        I.row_hash(["tag", "body_text", "payload"]).alias("sha256"), F.col("received_at").alias("ingested_at"),
    )
    # a content is seen if any version of the ledger had it; the ledger itself keeps the latest
    seen = rows.where("batch_no <= 6").select("source", "external_id", "sha256").distinct()
    return I.not_in_ledger(rows.where("batch_no > 6"), seen).select("record_id")


@query("q_k5_put_ledger", """
SELECT x AS external_id, arg_max(record_id, (received_at, record_id)) AS last_record FROM (SELECT *, ltrim(regexp_extract(external_id, '(\\d+)\\D*$', 1), '0') AS x FROM card_records) GROUP BY 1""")
def _(spark, sf):
    r = Corpus(spark, sf).table("card_records", "record_id", "external_id", "received_at")
    rows = r.withColumn("external_id", I.external_number(F.col("external_id")))
    return I.latest_versions(rows, F.col("external_id")).select("external_id", F.col("record_id").alias("last_record"))


@query("q_k6_changed_rows", sql("""
, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ltrim(regexp_extract(external_id, '(\\d+)\\D*$', 1), '0') ORDER BY received_at DESC NULLS LAST, record_id DESC) AS rn FROM mapped) WHERE rn = 1)
SELECT canonical_key, count(*) AS n_variants FROM latest WHERE canonical_key IS NOT NULL GROUP BY 1""", "mapped"))
def _(spark, sf):
    m = Corpus(spark, sf).mapped
    now = I.latest_versions(m, I.external_number(F.col("external_id")))
    return now.where("canonical_key is not null").groupBy("canonical_key").agg(F.count(F.lit(1)).alias("n_variants"))


@query("q_k11_index_rows", sql("""SELECT c.card_id, coalesce(c.tag, '') AS tag, concat_ws(' ', c.cite, c.fullcite) AS cite, coalesce(b.block, '') AS block, c.body_len
FROM cards2 c LEFT JOIN (SELECT card_id, string_agg(block, ' ; ' ORDER BY block) AS block FROM (SELECT DISTINCT card_id, block FROM variant WHERE block <> '') GROUP BY 1) b USING (card_id)""", "variant"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return I.index_rows(c.cards, c.variants).select("card_id", "tag", "cite", "block", F.length("body").cast("long").alias("body_len"))


@query("q_k21_apply_merges", """
WITH f AS (SELECT b AS old_id, min(a) AS survivor_id FROM (SELECT least(card_id_a, card_id_b) AS a, greatest(card_id_a, card_id_b) AS b FROM dedup_pairs WHERE merged AND card_id_a <> card_id_b) GROUP BY 1),
b AS (SELECT DISTINCT card_id, lower(trim(bucket_id)) AS bucket_id FROM hf_buckets WHERE trim(bucket_id) <> '')
SELECT DISTINCT coalesce(f.survivor_id, b.card_id) AS card_id, b.bucket_id FROM b LEFT JOIN f ON f.old_id = b.card_id""")
def _(spark, sf):
    c = Corpus(spark, sf)
    p = c.table("dedup_pairs").where("merged and card_id_a <> card_id_b")
    final = p.select(F.least("card_id_a", "card_id_b").alias("a"), F.greatest("card_id_a", "card_id_b").alias("old_id")).groupBy("old_id").agg(F.min("a").alias("survivor_id"))
    b = c.table("hf_buckets").select("card_id", F.nullif(F.lower(F.trim("bucket_id")), F.lit("")).alias("bucket_id")).where("bucket_id is not null").distinct()
    return I.apply_merges(b, final, ["bucket_id"])


# --- joins and aggregates ---------------------------------------------------------------


@query("q_j1_disclosures", sql("SELECT card_id, variant_id, round_id, team_id, school_id, season FROM disc", "disc"))
def _(spark, sf):
    return Corpus(spark, sf).disclosures.select("card_id", "variant_id", "round_id", "team_id", "school_id", "season")


@query("q_j2_provenance", sql("""SELECT v.card_id, v.record_id AS variant_id, r.tournament, r.round_label, r.side, r.round_date, t.display_name AS team, s.display_name AS school
FROM variant v LEFT JOIN round1 r ON r.id = v.round_id LEFT JOIN teams t ON t.id = r.team_id LEFT JOIN schools s ON s.id = t.school_id""", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return A.provenance(c.variants, c.rounds, c.table("teams"), c.table("schools"))


@query("q_a1_card_aggregates", sql("SELECT card_id, variant_count, team_count, school_count, first_season FROM total"))
def _(spark, sf):
    return Corpus(spark, sf).totals.select("card_id", "variant_count", "team_count", "school_count", "first_season")


@query("q_a2_corpus_counts", sql("""SELECT (SELECT count(*) FROM cards2 WHERE NOT is_analytic) AS n_cards, (SELECT count(*) FROM cards2 WHERE is_analytic) AS n_analytics,
(SELECT count(*) FROM variant) AS n_variants, count(DISTINCT team_id) AS n_teams, count(DISTINCT school_id) AS n_schools, min(season) AS first_season, max(season) AS last_season FROM disc""", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return A.corpus_counts(c.cards, c.variants, c.disclosures)


@query("q_a3_per_season", sql("SELECT d.season, count(DISTINCT d.card_id) FILTER (NOT c.is_analytic) AS n_cards, count(*) AS n_variants FROM disc d JOIN cards2 c USING (card_id) GROUP BY 1", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return A.per_season(c.cards, c.disclosures)


@query("q_a4_per_topic", sql("SELECT t.code, t.starts, t.ends, count(DISTINCT c.card_id) AS n_cards FROM topics t LEFT JOIN disc d ON d.topic_id = t.id LEFT JOIN cards2 c ON c.card_id = d.card_id AND NOT c.is_analytic GROUP BY ALL", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return A.per_topic(c.topics, c.cards, c.disclosures)


_STATUS = f"CASE WHEN starts IS NULL AND ends IS NULL THEN 'future' WHEN ends < '{TODAY}' THEN 'past' WHEN starts > '{TODAY}' THEN 'future' ELSE 'present' END"


@query("q_a5_topic_groups", sql(f"""SELECT status, code, n_cards, row_number() OVER (PARTITION BY status ORDER BY starts DESC NULLS LAST, code DESC) AS place FROM (
SELECT {_STATUS} AS status, t.code, t.starts, count(DISTINCT c.card_id) AS n_cards FROM topics t LEFT JOIN disc d ON d.topic_id = t.id LEFT JOIN cards2 c ON c.card_id = d.card_id AND NOT c.is_analytic GROUP BY ALL)""", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return A.topic_groups(A.per_topic(c.topics, c.cards, c.disclosures), G.topic_status(F.col("starts"), F.col("ends"), TODAY))


@query("q_a6_per_day", sql("SELECT round_date, count(*) AS n FROM disc WHERE round_date IS NOT NULL GROUP BY 1", "disc"))
def _(spark, sf):
    return A.per_day(Corpus(spark, sf).disclosures)


@query("q_a7_side_split", sql("SELECT topic_id, n_pro, n_con, cast(round_even(100.0 * n_pro / greatest(n_pro + n_con, 1), 0) AS INT) AS pro_percent FROM (SELECT topic_id, count(*) FILTER (side = 'P') AS n_pro, count(*) FILTER (side = 'C') AS n_con FROM disc WHERE side IS NOT NULL GROUP BY 1)", "disc"))
def _(spark, sf):
    return A.side_split(Corpus(spark, sf).disclosures)


@query("q_a8_authors_per_topic", sql("SELECT * FROM (SELECT topic_id, cite, n_cards, row_number() OVER (PARTITION BY topic_id ORDER BY n_cards DESC, cite) AS rank FROM (SELECT d.topic_id, c.cite, count(DISTINCT d.card_id) AS n_cards FROM disc d JOIN cards2 c USING (card_id) WHERE d.topic_id IS NOT NULL AND c.cite <> '' GROUP BY 1, 2)) WHERE rank <= 10", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return A.authors_per_topic(c.cards, c.disclosures)


@query("q_a9_author_index", sql("SELECT cite, n_cards, coalesce(nullif(regexp_extract(fullcite, '\\[([^\\]]{3,240})\\]', 1), ''), fullcite[1:160]) AS quals FROM (SELECT cite, count(*) AS n_cards, max(fullcite) AS fullcite FROM cards2 WHERE cite <> '' GROUP BY 1) ORDER BY n_cards DESC, cite LIMIT 200", "variant"))
def _(spark, sf):
    return A.author_index(Corpus(spark, sf).cards)


_DOMAIN = "nullif(regexp_replace(lower(regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', ''), '')"


@query("q_a10_domains", sql(f"SELECT domain, count(*) AS n FROM (SELECT {_DOMAIN} AS domain FROM cards2) WHERE domain IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 100", "variant"))
def _(spark, sf):
    return A.domains(Corpus(spark, sf).cards)


@query("q_a11_status_counts", sql("SELECT coalesce(status, 'unparsed') AS status, count(*) AS n FROM mapped GROUP BY 1", "mapped"))
def _(spark, sf):
    return Corpus(spark, sf).mapped.groupBy(F.coalesce("status", F.lit("unparsed")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("q_a12_unassigned", "SELECT (SELECT count(DISTINCT id) FROM rounds WHERE topic_id IS NULL) AS unassigned, (SELECT count(*) FROM dedup_pairs WHERE merged) AS merges")
def _(spark, sf):
    c = Corpus(spark, sf)
    return c.rounds.agg(F.count_if(F.col("topic_id").isNull()).alias("unassigned")).crossJoin(c.table("dedup_pairs").agg(F.count_if("merged").alias("merges")))


@query("q_a13_per_month", sql("SELECT round_date[1:7] AS month, count(*) AS n, min(round_date) AS first_seen FROM disc WHERE round_date <> '' GROUP BY 1", "disc"))
def _(spark, sf):
    return A.per_month(Corpus(spark, sf).disclosures)


@query("q_a15_topic_codes", sql("SELECT c.card_id, coalesce(string_agg(DISTINCT t.code, ',' ORDER BY t.code), '') AS codes FROM cards2 c LEFT JOIN disc d USING (card_id) LEFT JOIN topics t ON t.id = d.topic_id GROUP BY 1", "disc"))
def _(spark, sf):
    return Corpus(spark, sf).card_topics.select("card_id", F.array_join("topic_codes", ",").alias("codes"))


@query("q_a16_topic_json", """SELECT id, len(json_extract_string(topic_ids, '$[*]')) AS n_codes, json_extract_string(topic_ids, '$[0]') AS first_code FROM cards""")
def _(spark, sf):
    codes = F.from_json("topic_ids", "array<string>")
    return Corpus(spark, sf).table("cards", "id", "topic_ids").select("id", F.size(codes).cast("long").alias("n_codes"), F.get(codes, 0).alias("first_code"))


@query("q_a17_events", sql("SELECT c.card_id, coalesce(string_agg(DISTINCT d.caselist, ',' ORDER BY d.caselist), 'pf') AS events FROM cards2 c LEFT JOIN disc d USING (card_id) GROUP BY 1", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return A.events_of_cards(c.cards, c.disclosures)


@query("q_a18_source_totals", sql("SELECT count(*) FILTER (NOT is_analytic) AS evidence, count(*) FILTER (is_analytic) AS analytics, sum(variant_count)::BIGINT AS variants, sum(length(body_text))::BIGINT AS body_chars FROM total"))
def _(spark, sf):
    return A.source_totals(Corpus(spark, sf).totals)


@query("q_a19_shipped_scope", sql("SELECT count(DISTINCT team_id) AS teams, count(DISTINCT school_id) AS schools, string_agg(DISTINCT season::VARCHAR, ',' ORDER BY season::VARCHAR) AS seasons FROM disc WHERE caselist IN ('caselist-22', 'caselist-23')", "disc"))
def _(spark, sf):
    d = Corpus(spark, sf).disclosures.where(F.col("caselist").isin("caselist-22", "caselist-23"))
    return d.agg(F.countDistinct("team_id").alias("teams"), F.countDistinct("school_id").alias("schools"), F.array_join(F.array_sort(F.collect_set(F.col("season").cast("string"))), ",").alias("seasons"))


@query("q_a20_published_topics", sql(f"SELECT code, n_cards FROM (SELECT t.code, {_STATUS} AS status, count(DISTINCT c.card_id) AS n_cards FROM topics t LEFT JOIN disc d ON d.topic_id = t.id LEFT JOIN cards2 c ON c.card_id = d.card_id AND NOT c.is_analytic GROUP BY ALL) WHERE status <> 'past' OR n_cards > 0", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    exploded = c.card_topics.join(c.cards.where("not is_analytic").select("card_id"), "card_id", "left_semi").select(F.explode("topic_codes").alias("code"))
    n = exploded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    out = c.topics.join(n, "code", "left").withColumn("n_cards", F.coalesce("n", F.lit(0)))
    return out.where((G.topic_status(F.col("starts"), F.col("ends"), TODAY) != "past") | (F.col("n_cards") > 0)).select("code", "n_cards")


@query("q_a21_box_counts", "SELECT bucket_id AS box, count(DISTINCT card_id) AS n FROM (SELECT card_id, lower(trim(bucket_id)) AS bucket_id FROM hf_buckets) WHERE bucket_id <> '' GROUP BY 1")
def _(spark, sf):
    b = Corpus(spark, sf).table("hf_buckets").select("card_id", F.lower(F.trim("bucket_id")).alias("box")).where("box <> ''")
    return b.groupBy("box").agg(F.countDistinct("card_id").alias("n"))


@query("q_a14_box_view", sql("""
, mem AS (SELECT DISTINCT team_id AS box_id, card_id FROM variant WHERE team_id IS NOT NULL),
sp AS (SELECT card_id, arg_min(spoken, record_id) AS spoken FROM variant WHERE spoken <> '' GROUP BY 1),
agg AS (SELECT box_id, count(*) AS n_cards, coalesce(sum(len(list_filter(string_split_regex(coalesce(sp.spoken, ''), '[\\s\\x{a0}]+'), lambda x: x <> ''))), 0)::BIGINT AS n_words FROM mem LEFT JOIN sp USING (card_id) GROUP BY 1)
SELECT t.id AS box_id, coalesce(n_cards, 0) AS n_cards, coalesce(n_words, 0) AS n_words FROM teams t LEFT JOIN agg ON agg.box_id = t.id""", "variant"))
def _(spark, sf):
    c = Corpus(spark, sf)
    members = c.variants.where("team_id is not null").select(F.col("team_id").alias("box_id"), "card_id").distinct()
    return A.box_view(c.table("teams").select(F.col("id").alias("box_id")), members, c.cards, c.variants).select("box_id", "n_cards", "n_words")


@query("q_a24_census", "SELECT caselist, state, count(*) AS n FROM schools GROUP BY 1, 2")
def _(spark, sf):
    return Corpus(spark, sf).table("schools").groupBy("caselist", "state").agg(F.count(F.lit(1)).alias("n"))


@query("q_k22_import_box", "WITH p AS (SELECT is_analytic AS box_id, canonical_key FROM cards) SELECT DISTINCT p.box_id, c.id AS card_id FROM p JOIN (SELECT canonical_key, min(id) AS id FROM cards GROUP BY 1) c USING (canonical_key)")
def _(spark, sf):
    cards = Corpus(spark, sf).table("cards", "id", "canonical_key", "is_analytic")
    known = cards.groupBy("canonical_key").agg(F.min("id").alias("card_id"))
    return A.import_box(cards.select(F.col("is_analytic").alias("box_id"), "canonical_key"), known)


@query("q_j8_representative", sql("SELECT card_id, variant_id, ratio FROM (SELECT card_id, record_id AS variant_id, coalesce(highlight_ratio, -1) AS ratio, row_number() OVER (PARTITION BY card_id ORDER BY coalesce(highlight_ratio, -1) DESC, record_id) AS rn FROM variant) WHERE rn = 1", "variant"))
def _(spark, sf):
    return A.representative(Corpus(spark, sf).variants)


@query("q_w3_export_variant", sql("SELECT card_id, variant_id FROM (SELECT card_id, record_id AS variant_id, row_number() OVER (PARTITION BY card_id ORDER BY (coalesce(length(markup_html), 0) = 0)::INT, record_id) AS rn FROM variant) WHERE rn = 1", "variant"))
def _(spark, sf):
    return A.export_variant(Corpus(spark, sf).variants)


_NUMBERED = "regexp_replace(block, '(?i)^\\s*(?:\\(?\\d+[\\).]|\\(?[a-z][\\).]|[ivx]+[\\).])\\s+', '')"
_PREFIX = "(?i)^\\s*(?:(?:a2|at|a/2|a-2)\\s*[:\\-–—]?\\s+|(?:a2|at)[:\\-–—]\\s*)"
_ABOUT = f"nullif({norm(f'''regexp_replace({_NUMBERED}, '{_PREFIX}', '')''')}, '')"
_TARGET = f"CASE WHEN regexp_matches({_NUMBERED}, '{_PREFIX}') THEN {_ABOUT} END"


@query("q_x8_answer_target", f"SELECT DISTINCT block, {_TARGET} AS target, {_ABOUT} AS about FROM card_records WHERE block IS NOT NULL")
def _(spark, sf):
    b = Corpus(spark, sf).table("card_records", "block").where("block is not null").distinct()
    return b.select("block", X.answer_target(F.col("block")).alias("target"), X.argument_key(F.col("block")).alias("about"))


@query("q_j9_answers", sql(f"""
, b AS (SELECT DISTINCT card_id, block FROM variant WHERE block IS NOT NULL), about AS (SELECT DISTINCT card_id, {_ABOUT} AS key FROM b),
target AS (SELECT DISTINCT card_id AS answer_id, {_TARGET} AS key FROM b)
SELECT DISTINCT card_id, answer_id FROM (SELECT a.card_id, t.answer_id, row_number() OVER (PARTITION BY a.card_id, a.key ORDER BY t.answer_id) AS r FROM about a JOIN target t USING (key) WHERE key IS NOT NULL AND a.card_id <> t.answer_id) WHERE r <= 25""", "variant"))
def _(spark, sf):
    return A.answers(Corpus(spark, sf).variants)


@query("q_j15_round_cards", sql("SELECT card_id, record_id AS variant_id, ordinal FROM variant WHERE document_id IN (SELECT document_id FROM variant WHERE round_id = 7)", "variant"))
def _(spark, sf):
    return A.round_cards(Corpus(spark, sf).variants, 7)


@query("q_j11_health_queue", "SELECT id, updated_at FROM cards WHERE source_url IS NOT NULL ORDER BY updated_at NULLS FIRST, id LIMIT 50")
def _(spark, sf):
    c = Corpus(spark, sf).table("cards", "id", "source_url", "updated_at").where("source_url is not null")
    return c.orderBy(F.asc_nulls_first("updated_at"), "id").limit(50).select("id", "updated_at")


@query("q_o11_cards_by_topic", sql("SELECT DISTINCT coalesce(t.code, 'Unassigned') AS code, d.card_id, c.tag FROM disc d LEFT JOIN topics t ON t.id = d.topic_id JOIN cards2 c USING (card_id)", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return A.cards_by_topic(c.cards, c.disclosures, c.topics)


@query("q_o13_first_listing", "SELECT name, arg_min(id, (src, id)) AS id FROM (SELECT 0 AS src, id, display_name AS name FROM schools WHERE caselist = 'caselist-23' UNION ALL SELECT 1, id, display_name FROM schools) GROUP BY 1")
def _(spark, sf):
    s = Corpus(spark, sf).table("schools")
    both = s.where("caselist = 'caselist-23'").select(F.lit(0).alias("src"), "id", F.col("display_name").alias("name")).unionByName(s.select(F.lit(1).alias("src"), "id", F.col("display_name").alias("name")))
    return both.groupBy("name").agg(F.min_by("id", F.struct("src", "id")).alias("id"))


@query("q_w6_outline", sql("""SELECT record_id AS variant_id,
 CASE WHEN p <> '' AND (pp IS NULL OR pp <> p) THEN p END AS show_pocket,
 CASE WHEN h <> '' AND (pp IS NULL OR pp <> p OR ph <> h) THEN h END AS show_hat,
 CASE WHEN b <> '' AND (pp IS NULL OR pp <> p OR ph <> h OR pb <> b) THEN b END AS show_block
FROM (SELECT *, lag(p) OVER w AS pp, lag(h) OVER w AS ph, lag(b) OVER w AS pb FROM (SELECT *, coalesce(pocket, '') AS p, coalesce(hat, '') AS h, coalesce(block, '') AS b FROM variant WHERE ordinal IS NOT NULL) WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, record_id))""", "variant"))
def _(spark, sf):
    return A.outline(Corpus(spark, sf).variants)


# --- filters ------------------------------------------------------------------------------

def _filter(name: str, where: str, apply, upto: str = "total"):
    @query(name, sql(f"SELECT c.card_id FROM total c WHERE {where}", upto))
    def _(spark, sf):
        c = Corpus(spark, sf)
        return apply(c, c.totals).select("card_id")


def _disc(test: str) -> str:
    return f"EXISTS (SELECT 1 FROM disc d WHERE d.card_id = c.card_id AND {test})"


_filter("q_f1_kind", "is_analytic", lambda c, t: P.kind(t, True))
_filter("q_f2_topic", _disc(f"d.topic_id IN (SELECT id FROM topics WHERE {_STATUS} = 'past')"), lambda c, t: P.disclosed(t, c.disclosures.join(F.broadcast(G.resolve_token(c.topics, "past", TODAY).select(F.col("id").alias("topic_id"))), "topic_id", "left_semi"), F.lit(True)))
_filter("q_f3_season", _disc("d.season = 2022"), lambda c, t: P.by_season(t, c.disclosures, 2022))
_filter("q_f4_side", _disc("d.side = 'C'"), lambda c, t: P.by_side(t, c.disclosures, "C"))
_filter("q_f5_school", _disc("(contains(lower(d.school_name), 'gra') OR contains(lower(d.school_display), 'gra'))"), lambda c, t: P.by_school(t, c.disclosures, "Gra"))
_filter("q_f6_team", _disc("(contains(lower(d.team_name), 'do') OR contains(lower(d.team_display), 'do'))"), lambda c, t: P.by_team(t, c.disclosures, "DO"))
_filter("q_f7_cite", "contains(lower(c.cite), 'lu') OR contains(lower(c.fullcite), 'lu')", lambda c, t: P.by_cite(t, "Lu"))
_LAST = "list_filter(regexp_extract_all(c.cite, '\\d+'), lambda x: length(x) IN (1, 2, 4))[-1]"
_filter("q_f8_year", f"CASE WHEN length({_LAST}) = 4 THEN {_LAST}[3:4] ELSE lpad({_LAST}, 2, '0') END = '17'", lambda c, t: P.by_year(t, "17"))
_FLOOR = "CASE length(c.source_pub_date) WHEN 4 THEN c.source_pub_date || '-01-01' WHEN 7 THEN c.source_pub_date || '-01' ELSE c.source_pub_date END"
_filter("q_f9_before", f"c.source_pub_date <> '' AND {_FLOOR} < '2018-01-01'", lambda c, t: P.before(t, "2018"))
_filter("q_f10_after", f"c.source_pub_date <> '' AND {_FLOOR.replace('-01-01', '-12-31').replace(chr(39) + '-01' + chr(39), chr(39) + '-31' + chr(39))} >= '2020-06-01'", lambda c, t: P.after(t, "2020-06"))
_filter("q_f11_min_reads", "team_count >= 2", lambda c, t: P.min_reads(t, 2))
_filter("q_f12_status", "c.card_id IN (SELECT card_id_a FROM dedup_pairs WHERE merged)", lambda c, t: P.by_status(t, "true", c.table("dedup_pairs").select(F.col("card_id_a").alias("card_id"), F.col("merged").cast("string").alias("status"))))
_filter("q_f13_excluding", "c.card_id NOT IN (SELECT card_id FROM hf_buckets WHERE card_id IS NOT NULL)", lambda c, t: P.excluding(t, c.table("hf_buckets", "card_id")))
_filter("q_f14_independent", _disc("d.season = 2022") + " AND " + _disc("d.side = 'C'"), lambda c, t: P.by_side(P.by_season(t, c.disclosures, 2022), c.disclosures, "C"))
_filter("q_f15_event", _disc("d.caselist = 'caselist-23'"), lambda c, t: t.join(A.events_of_cards(c.cards, c.disclosures).where(F.array_contains(F.split("events", ","), "caselist-23")), "card_id", "left_semi"))
_filter("q_f16_topic_codes", _disc("d.topic_id IN (SELECT id FROM topics WHERE code IN ('2022-SO', '2023-APR'))"), lambda c, t: t.join(c.card_topics.where(F.arrays_overlap("topic_codes", F.array(F.lit("2022-SO"), F.lit("2023-APR")))), "card_id", "left_semi"))
_filter("q_f18_publishable", "team_count >= 1 AND NOT is_analytic AND " + _disc("d.caselist IN ('caselist-21', 'caselist-22')"), lambda c, t: P.publishable(t, c.disclosures, ["caselist-21", "caselist-22"], 1, False))

# --- orders -------------------------------------------------------------------------------


def _order(name: str, order: str, by, limit: str = "LIMIT 30", page=(0, 30)):
    @query(name, sql(f"SELECT c.card_id, row_number() OVER (ORDER BY {order}) AS place FROM total c LEFT JOIN (SELECT card_id, max(round_date) AS latest FROM disc GROUP BY 1) l USING (card_id) WHERE NOT is_analytic ORDER BY place {limit}"))
    def _(spark, sf):
        c = Corpus(spark, sf)
        latest = c.disclosures.groupBy("card_id").agg(F.max("round_date").alias("latest"))
        top = c.totals.where("not is_analytic").join(latest, "card_id", "left").orderBy(*by()).offset(page[0]).limit(page[1])
        # the page is small; its places follow from its own order
        return top.select("card_id", (F.row_number().over(Window.orderBy(*by())) + page[0]).alias("place"))


_order("q_o2_reads", "team_count DESC, card_id", lambda: [F.desc("team_count"), F.asc("card_id")])
_order("q_o3_recent", "latest DESC NULLS LAST, card_id", lambda: [F.desc_nulls_last("latest"), F.asc("card_id")])
_order("q_o4_length", "body_len DESC, card_id", lambda: [F.desc("body_len"), F.asc("card_id")])
_order("q_o5_page", "team_count DESC, card_id", lambda: [F.desc("team_count"), F.asc("card_id")], "LIMIT 20 OFFSET 40", (40, 20))
_order("q_o6_site_reads", "team_count DESC, school_count DESC, card_id", lambda: [F.desc("team_count"), F.desc("school_count"), F.asc("card_id")])
_order("q_o9_value", "team_count DESC, body_len DESC, card_id", lambda: [F.desc("team_count"), F.desc("body_len"), F.asc("card_id")], "LIMIT 100", (0, 100))


@query("q_o8_feed", sql("SELECT card_id FROM (SELECT d.card_id, max(round_date) AS latest FROM disc d WHERE topic_id = 10 GROUP BY 1) ORDER BY latest DESC NULLS LAST, card_id LIMIT 50", "disc"))
def _(spark, sf):
    d = Corpus(spark, sf).disclosures.where("topic_id = 10").groupBy("card_id").agg(F.max("round_date").alias("latest"))
    return d.orderBy(F.desc_nulls_last("latest"), "card_id").limit(50).select("card_id")


# --- topics -------------------------------------------------------------------------------

_SEASONED = """, rs AS (SELECT r.id, r.round_date, r.tournament, 2000 + try_cast(regexp_extract(s.caselist, '(\\d{2})$', 1) AS INT) AS season
  FROM round1 r LEFT JOIN teams t ON t.id = r.team_id LEFT JOIN schools s ON s.id = t.school_id)"""
_BYDATE = """, bydate AS (SELECT rs.id, min(t.id) AS topic_id FROM rs JOIN topics t ON (rs.season IS NULL OR rs.season = t.season) AND rs.round_date BETWEEN t.starts AND t.ends GROUP BY 1 HAVING count(*) = 1)"""
_BYOVER = f""", byover AS (SELECT id, topic_id FROM (SELECT rs.id, coalesce(tc.id, ts.id) AS topic_id, row_number() OVER (PARTITION BY rs.id ORDER BY length(o.match) DESC, o.match) AS rn
  FROM rs JOIN {_OVERRIDES_SQL} ON contains(lower(rs.tournament), o.match) LEFT JOIN topics tc ON upper(tc.code) = upper(o.code) LEFT JOIN topics ts ON o.code IS NULL AND ts.season = rs.season AND ts.slot = o.slot
  WHERE coalesce(tc.id, ts.id) IS NOT NULL) WHERE rn = 1)"""
_STOP = ", ".join(f"'{w}'" for w in X.TOPIC_STOPWORDS)


def _tokens(e: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({e}, '')), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})), lambda w: CASE WHEN length(w) > 3 AND w[-1:] = 's' THEN w[:-2] ELSE w END))"


_BYWORD = f""", tw AS (SELECT season, id AS topic_id, unnest({_tokens('resolution')}) AS word FROM topics),
kw AS (SELECT season, word, min(topic_id) AS topic_id FROM tw GROUP BY 1, 2 HAVING count(DISTINCT topic_id) = 1),
heads AS (SELECT DISTINCT round_id AS id, unnest({_tokens("concat_ws(' ', pocket, hat, block)")}) AS word FROM variant WHERE round_id IS NOT NULL),
votes AS (SELECT h.id, k.topic_id, count(*) AS n FROM heads h JOIN rs USING (id) JOIN kw k ON k.season = rs.season AND k.word = h.word GROUP BY 1, 2),
byword AS (SELECT v.id, max(v.topic_id) AS topic_id FROM votes v JOIN (SELECT id, max(n) AS top FROM votes GROUP BY 1) m ON m.id = v.id AND v.n = m.top GROUP BY 1 HAVING count(*) = 1)"""


def _rounds(c: Corpus):
    from ..operators.disclosures import season_of

    t = c.table("teams").select(F.col("id").alias("team_id"), "school_id")
    s = c.table("schools").select(F.col("id").alias("school_id"), season_of(F.col("caselist")).alias("season"))
    return c.rounds.join(t, "team_id", "left").join(s, "school_id", "left").select("id", "round_date", "tournament", "season")


@query("q_j6_topic_by_date", sql(_SEASONED + _BYDATE + " SELECT * FROM bydate", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return G.by_date(_rounds(c), c.topics)


@query("q_j7_topic_by_override", sql(_SEASONED + _BYOVER + " SELECT * FROM byover", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return G.by_override(_rounds(c), _overrides(spark), c.topics)


@query("q_g2_keywords", f"SELECT season, min(topic_id) AS topic_id, word FROM (SELECT season, id AS topic_id, unnest({_tokens('resolution')}) AS word FROM topics) GROUP BY season, word HAVING count(DISTINCT topic_id) = 1")
def _(spark, sf):
    return G.distinctive_keywords(Corpus(spark, sf).topics)


@query("q_g3_topic_by_keyword", sql(_SEASONED + _BYWORD + " SELECT * FROM byword", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return G.by_keyword(_rounds(c), c.variants, c.topics)


@query("q_g1_assign_topics", sql(_SEASONED + _BYDATE + _BYOVER + _BYWORD + """ SELECT rs.id, coalesce(a.topic_id, b.topic_id, w.topic_id) AS topic_id,
CASE WHEN a.topic_id IS NOT NULL THEN 'date' WHEN b.topic_id IS NOT NULL THEN 'override' WHEN w.topic_id IS NOT NULL THEN 'keyword' ELSE 'none' END AS method
FROM rs LEFT JOIN bydate a USING (id) LEFT JOIN byover b USING (id) LEFT JOIN byword w USING (id)""", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return G.assign_topics(_rounds(c), c.variants, c.topics, _overrides(spark))


@query("q_g4_assign_stats", sql(_SEASONED + _BYDATE + _BYOVER + _BYWORD + """ SELECT method, count(*) AS n FROM (SELECT
CASE WHEN a.topic_id IS NOT NULL THEN 'date' WHEN b.topic_id IS NOT NULL THEN 'override' WHEN w.topic_id IS NOT NULL THEN 'keyword' ELSE 'none' END AS method
FROM rs LEFT JOIN bydate a USING (id) LEFT JOIN byover b USING (id) LEFT JOIN byword w USING (id)) GROUP BY 1""", "disc"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return G.assign_topics(_rounds(c), c.variants, c.topics, _overrides(spark)).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("q_t2_topic_status", f"SELECT code, {_STATUS} AS status FROM topics")
def _(spark, sf):
    return Corpus(spark, sf).topics.select("code", G.topic_status(F.col("starts"), F.col("ends"), TODAY).alias("status"))
