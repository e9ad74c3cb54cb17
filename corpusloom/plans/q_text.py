"""Queries of text functions, full text search, near-duplicates, signals and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.markup import sanitize_markup
from ..operators import analytics as A, citehealth as H, consensus as C, dedup as D, disclosures as J, fulltext as T, heuristics as S, publish as B
from .corpus import Corpus
from .oracle import corpus as sql, norm, strip, visible
from .q_corpus import _NUMBERED, _PREFIX, TODAY
from .registry import query
from .search import Tables, search
from .staging import Stage

_SHORT = "FROM (SELECT cite FROM card_records UNION SELECT cite FROM cards) WHERE cite IS NOT NULL"
_CITES = "FROM (SELECT cite FROM card_records UNION SELECT cite FROM cards UNION SELECT fullcite FROM cards) WHERE cite IS NOT NULL"


def _cites(spark, sf, full: bool = True):
    """All distinct short citations and, with ``full``, full ones."""
    c = Corpus(spark, sf)
    both = c.table("card_records", "cite").unionByName(c.table("cards", "cite"))
    if full:
        both = both.unionByName(c.table("cards", "fullcite").select(F.col("fullcite").alias("cite")))
    return both.where("cite is not null").distinct()


@query("q_x4_cite_year_search", f"SELECT cite, CASE WHEN length(y) = 4 THEN y[3:4] ELSE lpad(y, 2, '0') END AS year FROM (SELECT cite, list_filter(regexp_extract_all(cite, '\\d+'), lambda x: length(x) IN (1, 2, 4))[-1] AS y {_CITES})")
def _(spark, sf):
    return _cites(spark, sf).select("cite", X.cite_year_search(F.col("cite")).alias("year"))


@query("q_x5_cite_year_strict", f"SELECT cite, list_filter(regexp_extract_all(regexp_replace(cite, '([^0-9A-Za-z])', '\\1\\1', 'g'), '(?:^|[^0-9A-Za-z])([0-9]{{4}}|[0-9]{{2}})(?:$|[^0-9A-Za-z])', 1), lambda x: length(x) = 2 OR x[1:2] IN ('19', '20'))[-1][-2:] AS year {_CITES}")
def _(spark, sf):
    return _cites(spark, sf).select("cite", X.cite_year_strict(F.col("cite")).alias("year"))


@query("q_x6_author_tokens", f"SELECT cite, list_aggregate(list_sort(list_filter(list_distinct(string_split({norm('cite')}, ' ')), lambda w: w NOT IN ('and', 'et', 'al', '') AND NOT regexp_matches(w, '^[0-9]+$'))), 'string_agg', ' ') AS authors {_CITES}")
def _(spark, sf):
    return _cites(spark, sf).select("cite", F.nullif(F.array_join(F.array_sort(X.author_tokens(F.col("cite"))), " "), F.lit("")).alias("authors"))


@query("q_x7_cites_compatible", f"""
WITH c AS (SELECT cite, list_filter(regexp_extract_all(cite, '(?:^|[^0-9A-Za-z])([0-9]{{4}}|[0-9]{{2}})(?:$|[^0-9A-Za-z])', 1), lambda x: length(x) = 2 OR x[1:2] IN ('19', '20'))[-1][-2:] AS y,
  list_filter(list_distinct(string_split({norm('cite')}, ' ')), lambda w: w NOT IN ('and', 'et', 'al', '') AND NOT regexp_matches(w, '^[0-9]+$')) AS w {_SHORT})
SELECT a.cite AS a, b.cite AS b FROM c a JOIN c b ON a.y = b.y AND a.cite < b.cite WHERE list_has_any(a.w, b.w)""")
def _(spark, sf):
    c = _cites(spark, sf, full=False).select("cite", X.cite_year_strict(F.col("cite")).alias("y"), X.author_tokens(F.col("cite")).alias("w"))
    # an author in common is an equality on the exploded words; the year joins with it
    words = c.select("cite", "y", F.explode("w").alias("word"))
    pairs = words.select(F.col("cite").alias("a"), "y", "word").join(words.select(F.col("cite").alias("b"), "y", "word"), ["y", "word"]).where("a < b")
    return pairs.select("a", "b").distinct()


_SHOWN = f"regexp_replace({_NUMBERED}, '{_PREFIX}', '')"


@query("q_x9_answer_display", f"SELECT DISTINCT block, coalesce({strip(_SHOWN)}, '') AS shown FROM card_records WHERE block IS NOT NULL")
def _(spark, sf):
    b = Corpus(spark, sf).table("card_records", "block").where("block is not null").distinct()
    return b.select("block", X.answer_display(F.col("block")).alias("shown"))


@query("q_x11_source_url", "SELECT id, nullif(regexp_replace(regexp_extract(fullcite, 'https?://[^\\s\"''<>\\)\\]]+'), '[.,;:!?''’”]+$', ''), '') AS url FROM cards WHERE fullcite IS NOT NULL")
def _(spark, sf):
    return Corpus(spark, sf).table("cards", "id", "fullcite").where("fullcite is not null").select("id", X.first_url(F.col("fullcite")).alias("url"))


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH_SQL = "CASE lower(n) " + " ".join(f"WHEN '{w}' THEN {k}" for k, (s, f) in enumerate(zip(_MONTHS, "january february march april may june july august september october november december".split()), 1) for w in dict.fromkeys([s, f, *(["sept"] if s == "sep" else [])])) + " END"


@query("q_x12_pub_date", f"""
WITH f AS (SELECT id, substr(string_split(fullcite, 'http')[1], 1, 200) AS front FROM cards WHERE fullcite IS NOT NULL),
g AS (SELECT *, regexp_extract(front, '\\b(\\d{{1,2}})-(\\d{{1,2}})-(\\d{{4}})\\b', ['m', 'd', 'y']) AS a, regexp_extract(front, '\\b([A-Za-z]{{3,9}})\\.?\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})\\b', ['n', 'd', 'y']) AS b FROM f),
h AS (SELECT *, a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') AS d1, b.n AS n, b.d AS bd, b.y AS by_ FROM g)
SELECT id, coalesce(try_cast(d1 AS DATE)::VARCHAR, try_cast(by_ || '-' || lpad(({_MONTH_SQL})::VARCHAR, 2, '0') || '-' || lpad(bd, 2, '0') AS DATE)::VARCHAR, nullif(regexp_extract(front, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1), '')) AS pub_date FROM h""")
def _(spark, sf):
    return Corpus(spark, sf).table("cards", "id", "fullcite").where("fullcite is not null").select("id", X.pub_date_by_shape(F.col("fullcite")).alias("pub_date"))


@query("q_x14_date_bounds", "SELECT id, source_pub_date, CASE length(source_pub_date) WHEN 4 THEN source_pub_date || '-01-01' WHEN 7 THEN source_pub_date || '-01' ELSE source_pub_date END AS floor, CASE length(source_pub_date) WHEN 4 THEN source_pub_date || '-12-31' WHEN 7 THEN source_pub_date || '-31' ELSE source_pub_date END AS ceiling FROM cards")
def _(spark, sf):
    d = F.col("source_pub_date")
    return Corpus(spark, sf).table("cards", "id", "source_pub_date").select("id", "source_pub_date", X.date_floor(d).alias("floor"), X.date_ceiling(d).alias("ceiling"))


@query("q_x16_visible_text", f"SELECT id, {visible('markup_html')} AS shown FROM cards")
def _(spark, sf):
    return Corpus(spark, sf).table("cards", "id", "markup_html").select("id", X.visible_text(F.col("markup_html")).alias("shown"))


@query("q_x21_hosts", "SELECT id, nullif(regexp_replace(lower(regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*)', 1)), '^www\\.', ''), '') AS host FROM cards")
def _(spark, sf):
    return Corpus(spark, sf).table("cards", "id", "source_url").select("id", X.hostname(F.col("source_url")).alias("host"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in X.CONTENT_STOPWORDS)


def _content(e: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({e}, '')), '[a-z0-9'']+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})))"


@query("q_x23_content_words", f"SELECT id, len({_content('tag')}) AS n FROM cards")
def _(spark, sf):
    return Corpus(spark, sf).table("cards", "id", "tag").select("id", F.size(X.content_words(F.col("tag"))).cast("long").alias("n"))


@query("q_x24_strong_fullcite", """SELECT id, coalesce((regexp_matches(fullcite, '(?i)https?://[^\\s<>"'')\\]]') OR regexp_matches(fullcite, '\\b(?:19|20)\\d{2}\\b') OR regexp_matches(fullcite, '(?i)\\b(?:accessed|access date|date of access|retrieved)\\b') OR regexp_matches(fullcite, '\\bDOA\\b'))
 AND len(list_filter(string_split_regex(fullcite, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+'), lambda x: x <> '')) <= 80, false) AS strong FROM (SELECT id, fullcite FROM cards UNION ALL SELECT -id, body_text FROM cards)""")
def _(spark, sf):
    """Full citations, and the bodies as paragraphs that are none."""
    c = Corpus(spark, sf).table("cards", "id", "fullcite", "body_text")
    both = c.select("id", "fullcite").unionByName(c.select((-F.col("id")).alias("id"), F.col("body_text").alias("fullcite")))
    return both.select("id", X.strong_fullcite(F.col("fullcite")).alias("strong"))


@query("q_p4_side_label", "SELECT id, CASE WHEN upper(trim(side)) IN ('P','PRO','A','AFF','AFFIRMATIVE','1') THEN 'Pro' WHEN upper(trim(side)) IN ('C','CON','N','NEG','NEGATIVE','2') THEN 'Con' END AS side FROM (SELECT DISTINCT id, side FROM rounds)")
def _(spark, sf):
    return Corpus(spark, sf).table("rounds", "id", "side").distinct().select("id", X.side_label(X.side(F.col("side"))).alias("side"))


@query("q_p3_season_label", "SELECT code, season || '-' || lpad(((season + 1) % 100)::VARCHAR, 2, '0') AS label, coalesce(map {'SO': 'Sept/Oct', 'ND': 'Nov/Dec', 'JAN': 'January', 'FEB': 'February', 'MA': 'March', 'APR': 'April', 'SEP': 'September', 'OCT': 'October', 'NOV': 'November', 'DEC': 'December', 'NATS': 'Nationals'}[slot], slot) AS slot FROM topics")
def _(spark, sf):
    return Corpus(spark, sf).topics.select("code", X.season_label(F.col("season")).alias("label"), X.slot_label(F.col("slot")).alias("slot"))


_SPOKEN_N = "len(list_filter(string_split_regex(coalesce(spoken, ''), '[\\s\\x{a0}]+'), lambda x: x <> ''))"


@query("q_p9_read_time", f"SELECT record_id, n AS n_words, (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS read_time FROM (SELECT record_id, n, round_even(n * 60.0 / 250, 0)::INT AS s FROM (SELECT record_id, {_SPOKEN_N} AS n FROM card_records))")
def _(spark, sf):
    n = X.words_spoken(F.col("spoken"))
    return Corpus(spark, sf).table("card_records", "record_id", "spoken").select("record_id", n.cast("long").alias("n_words"), X.read_time(n).alias("read_time"))


@query("q_p2_highlight_ratio", "SELECT record_id, round(length(spoken) / length(body_text), 6) AS ratio FROM card_records WHERE spoken IS NOT NULL AND body_text <> ''")
def _(spark, sf):
    r = Corpus(spark, sf).table("card_records", "record_id", "spoken", "body_text").where("spoken is not null and body_text <> ''")
    return r.select("record_id", F.round(F.length("spoken") / F.length("body_text"), 6).alias("ratio"))


# --- full text ----------------------------------------------------------------------------


def _index(spark, sf, stem: bool) -> tuple[T.TextIndex, object]:
    cards = Corpus(spark, sf).table("cards", "id", "tag", "cite", "fullcite", "body_text")
    rows = cards.select(F.col("id").alias("card_id"), "tag", F.concat_ws(" ", "cite", "fullcite").alias("cite"), F.lit("").alias("block"), F.col("body_text").alias("body"))
    return T.TextIndex.build(rows, Stage(spark, "fts"), stem), cards


def _bm25_sql(phrases: list[str]) -> str:
    split = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
    cols = {"tag": "tag", "cite": "concat_ws(' ', cite, fullcite)", "body": "body_text"}
    sel = ", ".join(f"{split.format(e)} AS {c}" for c, e in cols.items())
    hits = []
    for k, p in enumerate(phrases):
        words = p.split()
        each = []
        for c in cols:
            test = " AND ".join(f"{c}[i + {j}] = '{w}'" for j, w in enumerate(words))
            each.append(f"{T.WEIGHTS[c]} * len(list_filter(range(1, len({c}) + 1), lambda i: {test}))")
        hits.append(" + ".join(each) + f" AS f{k}")
    n = len(phrases)
    idf = ", ".join(f"greatest(CASE WHEN count(*) FILTER (f{k} > 0) * 2 < count(*) THEN ln((count(*) - count(*) FILTER (f{k} > 0) + 0.5) / (count(*) FILTER (f{k} > 0) + 0.5)) ELSE 0 END, 1e-6) AS i{k}" for k in range(n))
    score = " + ".join(f"i{k} * f{k} * 2.2 / (f{k} + 0.3 + 0.9 * dl / avgdl)" for k in range(n))
    return f"""WITH t AS (SELECT id, {sel} FROM cards), h AS (SELECT id, len(tag) + len(cite) + len(body) AS dl, {", ".join(hits)} FROM t),
s AS (SELECT avg(dl) AS avgdl, {idf} FROM h) SELECT id AS card_id, round(-({score}), 6) AS score FROM h, s WHERE {" AND ".join(f"f{k} > 0" for k in range(n))}"""


@query("q_t6_bm25", _bm25_sql(["statutory", "regulator"]))
def _(spark, sf):
    from .grammar import Term

    index, _ = _index(spark, sf, False)
    return index.match([Term("statutory"), Term("regulator")]).select("card_id", F.round("score", 6).alias("score"))


@query("q_t3_phrase", _bm25_sql(["tax increase"]))
def _(spark, sf):
    from .grammar import Term

    index, _ = _index(spark, sf, False)
    return index.match([Term("tax increase")]).select("card_id", F.round("score", 6).alias("score"))


@query("q_t4_not", "SELECT id AS card_id FROM cards WHERE list_contains(regexp_extract_all(lower(concat_ws(' ', tag, cite, fullcite, body_text)), '[a-z0-9]+'), 'ballot') AND NOT list_has_any(regexp_extract_all(lower(concat_ws(' ', tag, cite, fullcite, body_text)), '[a-z0-9]+'), ['treaty', 'census'])")
def _(spark, sf):
    from .grammar import Term

    index, _ = _index(spark, sf, False)
    return index.match([Term("ballot")], [Term("treaty"), Term("census")]).select("card_id")


def tables(spark, sf) -> Tables:
    """Search tables of the ingested corpus, stemmed."""
    from ..operators.ingest import index_rows

    c = Corpus(spark, sf)
    cards = c.stage.write(c.totals.join(c.card_topics, "card_id").join(A.events_of_cards(c.cards, c.disclosures), "card_id"), "search-cards")
    shown = c.stage.write(c.disclosures, "search-disclosures")
    rows = index_rows(c.cards, c.variants)
    index = T.TextIndex.build(rows, c.stage)
    return Tables(cards.join(rows.select("card_id", "block"), "card_id"), shown, c.topics, index)


def _search(name: str, text: str, dialect: str = "engine", **page):
    @query(name)
    def _(spark, sf):
        return search(tables(spark, sf), text, TODAY, dialect=dialect, **page).hits.withColumn("topic_codes", F.array_join("topic_codes", ","))


_search("q_s1_search_words", "grid regulator -treaty")
_search("q_s2_search_filters", 'topic:past side:con min_reads:1 "tax increase"')
_search("q_s3_search_site", "season:2022 grid reform", "site")
_search("q_s4_search_listing", "sort:recent after:2015", limit=20, offset=10)

# --- near-duplicates ----------------------------------------------------------------------


def _card_rows(spark, sf):
    c = Corpus(spark, sf).table("cards", "id", "cite", "is_analytic", "body_text", "body_len")
    return c.withColumnRenamed("id", "card_id").withColumn("is_analytic", F.coalesce("is_analytic", F.lit(False)))


_SHINGLES = f"""w AS (SELECT id, string_split({norm('body_text')}, ' ') AS w FROM cards WHERE NOT coalesce(is_analytic, false) AND body_text <> ''),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s FROM w WHERE len(w) >= 5)"""


@query("q_d2_shingles", f"WITH {_SHINGLES} SELECT id AS card_id, len(s) AS n_shingles FROM s")
def _(spark, sf):
    return D.universe(_card_rows(spark, sf)).select("card_id", F.size("shingles").cast("long").alias("n_shingles"))


@query("q_d5_near_dup_pairs", f"""WITH {_SHINGLES}, k AS (SELECT s.id, coalesce(c.cite, '') AS cite, list_sort(s) AS s FROM s JOIN cards c USING (id)),
r AS (SELECT min(id) AS id, cite, s FROM k GROUP BY cite, s), e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM r),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS inter FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a, b, CASE WHEN inter / (na + nb - inter) >= 0.9 THEN 'dup' ELSE 'trim' END AS verdict FROM p WHERE inter / (na + nb - inter) >= 0.9 OR (inter / least(na, nb) >= 0.95 AND inter / (na + nb - inter) >= 0.8)
UNION SELECT r.id, k.id, 'dup' FROM k JOIN r ON r.s = k.s AND r.cite = k.cite WHERE r.id <> k.id""")
def _(spark, sf):
    stage = Stage(spark, "d5")
    cards = stage.write(D.universe(_card_rows(spark, sf)), "universe")
    return D.verified_pairs(cards, D.candidate_pairs(cards))


@query("q_d7_greedy_merges")
def _(spark, sf):
    stage = Stage(spark, "d7")
    cards = stage.write(D.universe(_card_rows(spark, sf)), "universe")
    return D.greedy_merges(cards, stage.write(D.candidate_pairs(cards), "candidates"), stage)


_BUCKETS = "b AS (SELECT DISTINCT card_id, lower(trim(bucket_id)) AS bucket_id FROM hf_buckets WHERE trim(bucket_id) <> '')"
_MERGED = "m AS (SELECT DISTINCT least(card_id_a, card_id_b) AS a, greatest(card_id_a, card_id_b) AS b FROM dedup_pairs WHERE merged AND card_id_a <> card_id_b)"


@query("q_d10_disagreements", f"""WITH {_BUCKETS}, {_MERGED}, h AS (SELECT bucket_id, min(card_id) AS a FROM b GROUP BY 1),
same AS (SELECT h.a, b.card_id AS b, min(b.bucket_id) AS bucket FROM b JOIN h USING (bucket_id) WHERE b.card_id <> h.a GROUP BY 1, 2)
SELECT 'same_bucket_not_merged' AS kind, a, b, bucket FROM same WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.a = same.a AND m.b = same.b)
UNION ALL SELECT 'merged_across_buckets', m.a, m.b, (SELECT min(bucket_id) FROM b WHERE card_id = m.a) FROM m
WHERE EXISTS (SELECT 1 FROM b WHERE card_id = m.a) AND EXISTS (SELECT 1 FROM b WHERE card_id = m.b) AND NOT EXISTS (SELECT 1 FROM b x JOIN b y USING (bucket_id) WHERE x.card_id = m.a AND y.card_id = m.b)""")
def _(spark, sf):
    c = Corpus(spark, sf)
    b = c.table("hf_buckets").select("card_id", F.nullif(F.lower(F.trim("bucket_id")), F.lit("")).alias("bucket_id"))
    m = c.table("dedup_pairs").where("merged and card_id_a <> card_id_b").select(F.least("card_id_a", "card_id_b").alias("a"), F.greatest("card_id_a", "card_id_b").alias("b")).distinct()
    return B.disagreements(m, b)


@query("q_d6_dedup_stats", "SELECT run_id, count(*) AS candidates, count(DISTINCT CASE WHEN merged AND card_id_a <> card_id_b THEN least(card_id_a, card_id_b) || '-' || greatest(card_id_a, card_id_b) END) AS merged FROM dedup_pairs GROUP BY 1")
def _(spark, sf):
    p = Corpus(spark, sf).table("dedup_pairs")
    pair = F.when(F.col("merged") & (F.col("card_id_a") != F.col("card_id_b")), F.struct(F.least("card_id_a", "card_id_b"), F.greatest("card_id_a", "card_id_b")))
    return p.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct(pair).alias("merged"))


# --- signals, layers, health --------------------------------------------------------------


@query("q_h1_measures", sql(f"""
, r AS (SELECT card_id, max(highlight_ratio) AS ratio_high, min(highlight_ratio) AS ratio_low, list_distinct(flatten(list({_content('spoken')}))) AS sw FROM variant GROUP BY 1)
SELECT c.card_id, ratio_high, ratio_low, len(list_filter(string_split_regex(coalesce(c.body_text, ''), '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+'), lambda x: x <> '')) AS n_words,
  len(regexp_extract_all(coalesce(c.body_text, ''), '\\[[^\\[\\]]*\\]')) AS n_brackets, len(regexp_extract_all(coalesce(c.body_text, ''), '…|\\.{{3,}}')) AS n_ellipses,
  round(CASE WHEN len({_content('c.tag')}) >= 3 AND len(r.sw) >= 3 THEN len(list_intersect({_content('c.tag')}, r.sw)) / len(list_distinct(list_concat({_content('c.tag')}, r.sw))) END, 6) AS overlap
FROM cards2 c LEFT JOIN r USING (card_id)""", "variant"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return S.measures(c.cards, c.variants).select("card_id", "ratio_high", "ratio_low", "n_words", "n_brackets", "n_ellipses", F.round("overlap", 6).alias("overlap"))


_FLAG_ROWS = (
    ("hl_ratio_high", "body_len >= 500 AND ratio_high > 0.8", "printf('%.0f%% of %d characters highlighted', ratio_high * 100, body_len)"),
    ("hl_ratio_low", "body_len >= 500 AND ratio_low < 0.02", "printf('%.1f%% of %d characters highlighted', ratio_low * 100, body_len)"),
    ("bracket_density", "n_words >= 20 AND 100.0 * n_brackets / n_words > 2.0", "printf('%d insertions in %d words', n_brackets, n_words)"),
    ("ellipsis", "n_ellipses >= 3", "printf('%d ellipses', n_ellipses)"),
    ("power_tag", "overlap < 0.05", "printf('overlap %.3f', overlap)"),
)


@query("q_h5_flags", sql(f"""
, r AS (SELECT card_id, max(highlight_ratio) AS ratio_high, min(highlight_ratio) AS ratio_low, list_distinct(flatten(list({_content('spoken')}))) AS sw FROM variant GROUP BY 1),
m AS (SELECT c.card_id, c.body_len, ratio_high, ratio_low, len(list_filter(string_split_regex(coalesce(c.body_text, ''), '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+'), lambda x: x <> '')) AS n_words,
  len(regexp_extract_all(coalesce(c.body_text, ''), '\\[[^\\[\\]]*\\]')) AS n_brackets, len(regexp_extract_all(coalesce(c.body_text, ''), '…|\\.{{3,}}')) AS n_ellipses,
  CASE WHEN len({_content('c.tag')}) >= 3 AND len(r.sw) >= 3 THEN len(list_intersect({_content('c.tag')}, r.sw)) / len(list_distinct(list_concat({_content('c.tag')}, r.sw))) END AS overlap
FROM cards2 c LEFT JOIN r USING (card_id))
""" + " UNION ALL ".join(f"SELECT card_id, '{code}' AS code, '{S.LABELS[code]}' AS label, {shown} AS detail FROM m WHERE {test}" for code, test, shown in _FLAG_ROWS), "variant"))
def _(spark, sf):
    c = Corpus(spark, sf)
    return S.flags(c.cards, c.variants).select("card_id", F.explode("flags").alias("f")).select("card_id", "f.code", "f.label", "f.detail")


@query("q_c3_consensus")
def _(spark, sf):
    c = Corpus(spark, sf)
    return C.weights(C.layers(c.cards, c.variants))


@query("q_x15_sanitize")
def _(spark, sf):
    return Corpus(spark, sf).table("cards", "id", "markup_html").select("id", sanitize_markup("markup_html").alias("clean"))


_STATUS = "CASE id % 5 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 200 END"


@query("q_v1_cite_health", f"""SELECT id, state, CASE WHEN state <> 'alive' THEN 'https://web.archive.org/web/*/' || source_url END AS archived FROM (SELECT id, source_url, CASE
 WHEN {_STATUS} = 403 THEN 'paywalled' WHEN {_STATUS} = 200 AND contains(lower(coalesce(tag, '')), 'paywall') THEN 'paywalled'
 WHEN {_STATUS} = 200 AND id % 5 = 3 AND NOT starts_with(source_url, 'https://www.alder') AND NOT starts_with(source_url, 'https://alderledger.example/') THEN 'redirected'
 WHEN {_STATUS} = 200 AND id % 5 = 3 AND NOT starts_with(source_url, 'https://www.alderledger.example/') AND NOT starts_with(source_url, 'https://alderledger.example/') THEN 'redirected'
 WHEN {_STATUS} = 200 THEN 'alive' ELSE 'dead' END AS state FROM cards WHERE source_url IS NOT NULL)""")
def _(spark, sf):
    c = Corpus(spark, sf).table("cards", "id", "source_url", "tag").where("source_url is not null")
    k = F.pmod("id", F.lit(5))
    status = F.when(k == 0, 200).when(k == 1, 403).when(k == 2, 404).when(k == 3, 200)
    final = F.when(k == 3, F.lit("https://alderledger.example/moved")).otherwise(F.col("source_url"))
    state = H.classify(F.col("source_url"), status, final, F.col("tag"))
    return c.select("id", state.alias("state"), H.archived(F.col("source_url"), state).alias("archived"))


@query("q_v2_latest_health", "SELECT card_id_a AS card_id, arg_max(run_id, logged_at) AS run_id FROM dedup_pairs WHERE card_id_a IS NOT NULL GROUP BY 1")
def _(spark, sf):
    p = Corpus(spark, sf).table("dedup_pairs").where("card_id_a is not null")
    checks = p.select(F.col("card_id_a").alias("card_id"), F.col("run_id").alias("status"), F.col("logged_at").alias("checked_at"))
    return H.latest_health(checks).select("card_id", F.col("status").alias("run_id"))


# --- publishing ---------------------------------------------------------------------------


@query("q_k12_published", sql("""
, e AS (SELECT card_id, string_agg(DISTINCT caselist, ',' ORDER BY caselist) AS events FROM disc GROUP BY 1),
rep AS (SELECT * FROM (SELECT card_id, pocket, hat, block, fidelity, row_number() OVER (PARTITION BY card_id ORDER BY coalesce(highlight_ratio, -1) DESC, record_id) AS rn FROM variant) WHERE rn = 1)
SELECT c.card_id, c.team_count, r.pocket, r.hat, r.block, r.fidelity, coalesce(e.events, 'pf') AS events FROM total c LEFT JOIN rep r USING (card_id) LEFT JOIN e USING (card_id)"""))
def _(spark, sf):
    c = Corpus(spark, sf)
    p = B.published_cards(c.totals, c.variants, A.events_of_cards(c.cards, c.disclosures), c.card_topics)
    return p.select("card_id", "team_count", "pocket", "hat", "block", "fidelity", "events")


@query("q_k13_capped", sql("""
, z AS (SELECT *, strlen(coalesce(body_text, '')) + strlen(coalesce(tag, '')) AS b FROM total),
o AS (SELECT card_id, sum(b) OVER (ORDER BY team_count DESC, body_len DESC, card_id ROWS UNBOUNDED PRECEDING) AS run FROM z WHERE NOT is_analytic)
SELECT card_id FROM o WHERE run <= (SELECT sum(b) // 3 FROM z)"""))
def _(spark, sf):
    t = Corpus(spark, sf).totals
    size = B.row_bytes("body_text", "tag")
    third = t.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] // 3
    return B.capped(t, third, size).select("card_id")


@query("q_k15_verify", "SELECT count(*) AS published, (SELECT count(*) FROM cards WHERE list_contains(regexp_extract_all(lower(concat_ws(' ', tag, cite, fullcite, body_text)), '[a-z0-9]+'), 'regulator')) AS found, 0::BIGINT AS wrong, 1::BIGINT AS wrong_if_short FROM cards")
def _(spark, sf):
    """The check of a published set against its index, and of one that lacks a card."""
    from .grammar import Term

    index, cards = _index(spark, sf, False)
    found = index.any_of([Term("regulator")]).count()
    wrong, short = (len(B.verify_published(df, index.rows, found)) for df in (cards, cards.where(F.col("id") > 1)))
    return cards.agg(F.count(F.lit(1)).alias("published")).select("published", F.lit(found).cast("bigint").alias("found"), F.lit(wrong).cast("bigint").alias("wrong"), F.lit(short).cast("bigint").alias("wrong_if_short"))


@query("q_w7_numbered", "SELECT id AS card_id, row_number() OVER (ORDER BY id) AS place FROM cards")
def _(spark, sf):
    c = Corpus(spark, sf).table("cards", "id").select(F.col("id").alias("card_id"))
    return B.numbered(c).select("card_id", F.col("place").cast("long").alias("place"))


@query("q_j5_rounds_unique", "SELECT DISTINCT ON (id) id, team_id, tournament FROM rounds ORDER BY id, team_id")
def _(spark, sf):
    return J.unique_rounds(Corpus(spark, sf).table("rounds")).select("id", "team_id", "tournament")
