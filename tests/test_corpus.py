"""Merges, topics, signals, publishing, documents, and the registered queries as a whole."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import consensus as C, dedup as D, heuristics as H, publish as P, topics as G
from corpusloom.operators.citehealth import classify, queue
from corpusloom.plans.staging import Stage
from corpusloom.sources import documents as W, files as L

TEXT = " ".join(f"word{k % 97} of{k % 13} item{k}" for k in range(64))


def _cards(spark, rows):
    df = spark.createDataFrame(rows, "card_id bigint, cite string, body_text string")
    return df.withColumns({"is_analytic": F.lit(False), "body_len": F.length("body_text").cast("long")})


def _merges(spark, rows):
    stage = Stage(spark, "test")
    cards = stage.write(D.universe(_cards(spark, rows)), "u")
    merges = D.greedy_merges(cards, stage.write(D.candidate_pairs(cards), "p"), stage)
    return sorted(map(tuple, merges.collect()))


def test_merge_or_not(spark):
    drift = TEXT.replace("item30", "thing30")
    words = TEXT.split()
    trim = " ".join(words[: int(len(words) * 0.89)])
    assert _merges(spark, [(1, "Diamond '13", TEXT), (2, "Diamond 2013", drift)]) == [(1, 2, "dup")] or _merges(spark, [(1, "Diamond '13", TEXT), (2, "Diamond 2013", drift)]) == [(2, 1, "dup")]
    assert _merges(spark, [(1, "Diamond '13", trim), (2, "Diamond 13", TEXT)]) == [(2, 1, "trim")]
    assert _merges(spark, [(1, "Diamond '13", TEXT), (2, "Diamond '14", drift)]) == []
    assert _merges(spark, [(1, "Diamond '13", TEXT), (2, "Cooper '13", drift)]) == []
    assert _merges(spark, [(1, "Diamond", TEXT), (2, "Diamond", TEXT)]) == []
    assert _merges(spark, [(1, "Diamond '13", "too short"), (2, "Diamond '13", "too short")]) == []
    assert _merges(spark, [(1, "A '13", TEXT), (2, "A '13", TEXT), (3, "A '13", TEXT)]) == [(1, 2, "dup"), (1, 3, "dup")]


def test_second_run_merges_nothing(spark):
    rows = [(1, "A '13", TEXT), (2, "A '13", TEXT.replace("item30", "x")), (3, "B 14", TEXT[::-1])]
    gone = {m[1] for m in _merges(spark, rows)}
    assert len(gone) == 1 and _merges(spark, [r for r in rows if r[0] not in gone]) == []


def test_merges_end_at_the_survivor(spark):
    merges = spark.createDataFrame([(2, 1, "dup"), (3, 2, "dup"), (4, 3, "trim")], "survivor_id bigint, absorbed_id bigint, relation string")
    assert sorted(map(tuple, D.final_map(merges).collect())) == [(1, 4), (2, 4), (3, 4)]


def test_topic_ladder(spark):
    topics = spark.createDataFrame(
        [
            (1, 2025, "SO", "2025-SO", "Resolved: grids should grow", "2025-09-01", "2025-10-31"),
            (2, 2025, "ND", "2025-ND", "Resolved: water should flow", "2025-11-01", "2025-12-31"),
            (3, 2025, "JAN", "2025-JAN", "Resolved: water and trains should stop", None, None),
        ],
        "id bigint, season int, slot string, code string, resolution string, starts string, ends string",
    )
    rounds = spark.createDataFrame(
        [(1, "2025-09-05", "Grand Open", 2025), (2, None, "Grand Open", 2025), (3, "n/a", "Nothing", 2025), (4, None, "x", 2025), (5, None, "Open", None), (6, "2025-11-05", None, None), (7, None, None, 2025)],
        "id bigint, round_date string, tournament string, season int",
    )
    overrides = spark.createDataFrame([("open", "ND", None), ("grand open", "NONE", None), ("grand", None, "2025-jan")], "match string, slot string, code string")
    variants = spark.createDataFrame([(3, "Grids", None, None), (4, "grids", "flow", None), (7, None, None, None)], "round_id bigint, pocket string, hat string, block string")
    got = {r.id: (r.topic_id, r.method) for r in G.assign_topics(rounds, variants, topics, overrides).collect()}
    assert got == {1: (1, "date"), 2: (3, "override"), 3: (1, "keyword"), 4: (None, "none"), 5: (None, "none"), 6: (2, "date"), 7: (None, "none")}
    assert [r.code for r in G.resolve_token(topics, "FUTURE", "2025-01-01").orderBy("id").collect()] == ["2025-SO", "2025-ND", "2025-JAN"]
    assert G.current_topic(topics, "2025-09-09").first().code == "2025-SO"


def test_seed_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"topics": [{"code": "A", "season": 1}, {"season": 2}, {"code": "A", "season": 3}], "overrides": [{"match": "OPEN", "slot": "SO"}]}')
    (tmp_path / "b.json").write_text('[{"code": "B"}]')
    topics, overrides = G.load_topics(spark, str(tmp_path / "a.json"))
    assert [(r.code, r.season) for r in topics.collect()] == [("A", 3)] and [r.match for r in overrides.collect()] == ["open"]
    assert [r.code for r in G.load_topics(spark, str(tmp_path / "b.json"))[0].collect()] == ["B"]


def test_signals(spark):
    cards = _cards(spark, [(1, None, "word " * 200 + "… ... …"), (2, None, "[a] b [c] " + "w " * 20), (3, None, None)]).withColumn("tag", F.lit("alpha beta gamma"))
    variants = spark.createDataFrame([(1, 0.9, "delta epsilon zeta"), (1, 0.01, None), (3, None, "alpha beta gamma")], "card_id bigint, highlight_ratio double, spoken string")
    got = {r.card_id: [f.code for f in r.flags] for r in H.flags(cards, variants).collect()}
    assert got == {1: ["hl_ratio_high", "hl_ratio_low", "ellipsis", "power_tag"], 2: ["bracket_density"], 3: []}


def test_consensus(spark):
    cards = _cards(spark, [(1, None, "one two three"), (2, None, None)])
    variants = spark.createDataFrame([(1, "<p>one <mark>two</mark> three</p>"), (1, "<mark>two three</mark> four"), (1, None), (2, "<mark>x</mark>")], "card_id bigint, markup_html string")
    got = [(r.place, r.marked, r.weight) for r in C.weights(C.layers(cards, variants)).orderBy("place").collect()]
    assert got == [(0, 0, 0.0), (1, 2, 1.0), (2, 1, 0.5)]


def test_cap(spark):
    cards = spark.createDataFrame([(k, k % 5 == 0, k % 7, 100) for k in range(200)], "card_id bigint, is_analytic boolean, team_count bigint, body_len bigint")
    size = F.lit(10)
    assert P.capped(cards, 10_000, size).count() == 200
    assert P.capped(cards, 1_600, size).count() == 160
    kept = {r.card_id for r in P.capped(cards, 505, size).collect()}
    best = sorted((k for k in range(200) if k % 5), key=lambda k: (-(k % 7), k))[:50]
    assert kept == set(best)


def test_health(spark):
    rows = [("https://www.a.example/x", 200, "https://a.example/y", "fine"), ("https://a.example", 200, "https://b.example", ""), ("https://a.example", 200, "https://a.example", "Subscribe to READ"), ("https://a.example", 403, None, None), ("https://a.example", None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, u string, s int, f string, h string")
    got = [r[0] for r in df.orderBy("k").select(classify(F.col("u"), F.col("s"), F.col("f"), F.col("h"))).collect()]
    assert got == ["alive", "redirected", "paywalled", "paywalled", "dead"]
    cards = spark.createDataFrame([(1, "u"), (2, "u"), (3, "")], "card_id bigint, source_url string")
    checked = spark.createDataFrame([(1, 5)], "card_id bigint, checked_at int")
    assert [r.card_id for r in queue(cards, checked, 5).collect()] == [2, 1]


# --- documents ----------------------------------------------------------------------------

_STYLES = '<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{}</w:styles>'
_DOC = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def _run(text, **props):
    inner = "".join(f'<w:{k} w:val="{v}"/>' if v is not True else f"<w:{k}/>" for k, v in props.items())
    return f'<w:r><w:rPr>{inner}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def _par(*runs, style=None):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}{''.join(runs)}</w:p>"


def _docx(*parts):
    styles = "".join(f'<w:style w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 5))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", _DOC.format("".join(parts)))
        z.writestr("word/styles.xml", _STYLES.format(styles))
    return out.getvalue()


BODY = "The body of the evidence goes on for a while and says what it has to say about the matter at hand."


def test_headings():
    content = _docx(
        _par(_run("1AC"), style="Heading1"), _par(_run("Economy"), style="Heading3"), _par(_run("Growth is  good"), style="Heading4"),
        _par(_run("Kessler ’26"), _run(", analyst, May 3, 2026, https://x.example/a.")), _par(_run("Plain "), _run("read", highlight="yellow"), _run(" under", u="single"), _run(" tiny", sz="16")),
        _par(_run("Neg"), style="Heading2"), _par(_run("A bare claim"), style="Heading4"),
    )
    a, b = W.docx_cards(content)
    assert (a["tag"], a["cite"], a["pocket"], a["hat"], a["block"]) == ("Growth is good", "Kessler ’26", "1AC", None, "Economy")
    assert (a["source_url"], a["source_pub_date"], a["spoken"], a["summary"]) == ("https://x.example/a", "2026-05-03", "read", "read under")
    assert a["body_text"] == "Plain read under tiny" and "<mark>read</mark>" in a["markup_html"] and '<span class="min">' in a["markup_html"]
    assert b["is_analytic"] and (b["pocket"], b["hat"], b["block"], b["ordinal"]) == ("1AC", "Neg", None, 1)


def test_format_fallback():
    content = _docx(_par(_run("Growth is good", b=True, sz="26")), _par(_run("Kessler 26, analyst, writes")), _par(_run(BODY)))
    (card,) = W.docx_cards(content)
    assert (card["tag"], card["cite"], card["body_text"]) == ("Growth is good", "Kessler 26", BODY)
    assert W.docx_cards(_docx()) == []


def test_lines():
    text = f"Title page\nA preamble that ends.\nGrowth is good\nKessler 26, analyst, 2026, https://x.example\n{BODY}\nPage 2 of 3\nTrade is\nbetter still\nDoe 19, 2019, accessed 1-1-2020\nMore body."
    a, b = W.line_cards(text)
    assert (a["tag"], a["cite"], a["body_text"]) == ("Growth is good", "Kessler 26", BODY)
    assert (b["tag"], b["cite"], b["body_text"]) == ("Trade is better still", "Doe 19", "More body.")
    assert W.line_cards("") == [] and W.line_cards("Only a tag")[0]["is_analytic"]


def test_archive(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("School/Team/a.docx", _docx(_par(_run("Tag"), style="Heading4"), _par(_run(BODY * 3))))
        z.writestr("School/b.docx", b"broken")
        z.writestr("ignored.png", b"x")
    (tmp_path / "all.zip").write_bytes(inner.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    cards = L.parse_files(L.unzip(L.read_files(spark, str(tmp_path), "*.zip")))
    school, team = L.provenance(F.col("path"))
    got = sorted((r.status, r.tag, r.s, r.t) for r in cards.where("path like '%!%'").select("status", "tag", school.alias("s"), team.alias("t")).collect())
    assert got == [("failed", None, "School", None), ("parsed", "Tag", "School", "Team")]
    assert cards.where("status = 'failed'").count() == 2


@pytest.mark.parametrize("preset", ["house", "verbatim"])
@pytest.mark.parametrize("colour", ["green", "yellow", "blue", "turquoise"])
def test_round_trip(preset, colour):
    from corpusloom.sources.export import write_docx

    body = f"{BODY} café &amp; <tag>\nSecond  paragraph, read in part.\n{BODY}"
    markup = body.replace("&", "&amp;").replace("<", "&lt;").replace("Second", "<mark>Second").replace("paragraph,", "paragraph,</mark>").replace("read in", "<u>read in</u>").replace("\n", "<br>")
    cards = [
        {"tag": "First tag", "cite": "Kessler ’26", "fullcite": "Dana Kessler, analyst, 2026, https://x.example/a", "body_text": body, "markup_html": markup, "pocket": "1AC", "block": "Economy"},
        {"tag": "Second tag", "cite": "Doe 19", "fullcite": "Jo Doe, 2019, https://x.example/b", "body_text": BODY, "markup_html": None, "pocket": "1AC", "block": "Economy"},
        {"tag": "Only a tag", "pocket": "1AC", "hat": "Case", "block": None},
    ]
    a, b, c = W.docx_cards(write_docx(cards, preset, colour))
    assert (a["tag"], a["cite"], a["fullcite"], a["body_text"]) == ("First tag", "Kessler ’26", cards[0]["fullcite"], body)
    assert (a["spoken"], a["summary"]) == ("Second paragraph,", "Second paragraph, read in")
    assert (b["pocket"], b["block"], b["body_text"]) == ("1AC", "Economy", BODY)
    assert c["is_analytic"] and (c["hat"], c["block"]) == ("Case", None)


def test_export_and_parse_by_spark(spark):
    from corpusloom.sources.export import export_boxes

    rows = [(1, k, f"Tag {k}", "Doe 19", "Jo Doe, 2019, https://x.example/b", BODY, None, None, None, None) for k in range(3)] + [(2, 0, "T", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "box_id bigint, place int, tag string, cite string, fullcite string, body_text string, markup_html string, pocket string, hat string, block string")
    files = export_boxes(df).withColumn("path", F.concat(F.lit("a/b/"), F.col("box_id").cast("string"), F.lit(".docx")))
    spark.udtf.register("parse_card_file", L.ParseCardFile)
    files.createOrReplaceTempView("card_files")
    got = spark.sql("select f.box_id, c.tag, c.body_text from card_files f, lateral parse_card_file(f.path, f.content) c").collect()
    assert sorted((r.box_id, r.tag, r.body_text or "") for r in got) == [(1, f"Tag {k}", BODY) for k in range(3)] + [(2, "T", "")]


def test_small_sinks(spark, tmp_path):
    import json

    cards = spark.createDataFrame([(1, "a <b>", "A '13", False), (2, "c", None, True)], "card_id bigint, tag string, cite string, is_analytic boolean")
    read = spark.createDataFrame([(1, 7, 3, 2021, "2021-09-01"), (2, 7, 3, 2022, None)], "card_id bigint, team_id bigint, school_id bigint, season int, round_date string")
    assert json.loads(P.site_stats(cards, read)) == {"cards": 1, "analytics": 1, "teams": 1, "schools": 1, "seasons": [2021, 2022]}
    shown = P.feed(cards, read, "T & co", "https://x.example")
    assert shown.count("<item>") == 2 and "a &lt;b&gt;" in shown and shown.index("a &lt;b") < shown.index("<title>c")
    P.write_report(cards, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).count() == 2
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_text("same")
    for _ in range(2):
        L.store(L.read_files(spark, str(tmp_path / "in")), str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 1


def test_listing_source(spark, tmp_path):
    from corpusloom.sources.api import ListingSource

    (tmp_path / "one.json").write_text('[{"name": "x"}, {"name": "y"}]')
    spark.dataSource.register(ListingSource)
    rows = spark.read.format("listing").option("base", str(tmp_path)).option("lists", "one, none").load().collect()
    assert [(r.list, r.body) for r in rows] == [("one", '{"name": "x"}'), ("one", '{"name": "y"}')]


def test_shards(spark, tmp_path):
    from corpusloom.sources import shards as S

    rows = spark.createDataFrame([(1, "pf", "0"), (2, "ld", "7"), (3, "ld", "x"), (4, None, "9")], "id bigint, event string, duplicateCount string")
    full = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in S.BULK_COLUMNS))
    full.coalesce(1).write.parquet(str(tmp_path / "s"))
    assert sorted(r.id for r in S.scan(spark, [str(tmp_path / "s")], ("pf", "ld"), 5).collect()) == [1, 2]
    assert len(S.shards_of(S.census(spark, [str(tmp_path / "s")]), ["ld"])) == 1
    assert S.scan(spark, [str(tmp_path / "s")], ("ld",), limit=4).count() == 2 and S.sample(spark, [str(tmp_path / "s")], ("ld",), 1.0).count() == 2
    with pytest.raises(ValueError):
        S.shards_of(rows.select("event", F.lit("x").alias("shard")).limit(0), ["pf"])


def test_engine(spark, tmp_path):
    from pathlib import Path

    from corpusloom.engine import Engine, register

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    engine = Engine(spark, str(folder))
    hit = engine.search("grid", "2024-10-15").hits.first()
    page = engine.card(hit.card_id)
    assert page["card"].count() == 1 and page["consensus"].count() >= 0 and page["flags"].count() == 1
    assert engine.stats()["counts"].first().n_cards > 0 and engine.authors().count() > 0
    assert engine.publish(str(tmp_path / "site"), 20_000).count() < engine.cards.count()
    assert set(engine.topic("2023-APR")) == {"days", "sides", "authors", "newest"}
    register(spark)
    assert spark.sql("select pf_cite_year('Kessler 2026')").first()[0] == "26"


def test_disagreements(spark):
    pairs = spark.createDataFrame([(1, 2), (5, 6)], "a bigint, b bigint")
    buckets = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (5, "y"), (6, "z"), (7, None)], "card_id bigint, bucket_id string")
    got = sorted(map(tuple, P.disagreements(pairs, buckets).collect()))
    assert got == [("merged_across_buckets", 5, 6, "y"), ("same_bucket_not_merged", 1, 3, "x")]


def test_registry_is_whole():
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert oracle.keys() <= queries.keys() and len(queries) > 100


@pytest.mark.parametrize("name", ["q_a1_card_aggregates", "q_g1_assign_topics", "q_t6_bm25", "q_z6_tumbling"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    import __spark_entry__ as entry

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    ours = entry.queries()[name](spark, str(folder))
    theirs = con.execute(entry.oracle_sql()[name]).fetchall()
    order = [d[0] for d in con.description]
    key = lambda row: tuple(str(v) for v in row)
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    a = sorted((tuple(plain(v) for v in r) for r in ours.select(*order).collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in theirs), key=key)
    assert a == b


def test_sizes_beyond_bigint(spark, tmp_path):
    """q_x26_human_bytes where id * id * id * 17 leaves bigint, after 815605; its SQL says the same of wider ids."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    ids = [None, -(10**9), -1, 0, 1, 80, 815605, 815606, 1040000, 10**9 + 1, 10**12]
    spark.createDataFrame([(i,) for i in ids], "id bigint").write.parquet(str(tmp_path / "cards.parquet"))
    con = duckdb.connect()
    con.execute(f"create view cards as select id::hugeint as id from '{tmp_path}/cards.parquet/*.parquet'")
    run = entry.queries()["q_x26_human_bytes"]
    ours = run(spark, str(tmp_path))
    assert ours.dtypes == [("id", "bigint"), ("shown", "string")]
    assert set(map(tuple, ours.collect())) == set(con.execute(entry.oracle_sql()["q_x26_human_bytes"]).fetchall())
    # the ends of bigint, where the SQL has no type that is wide enough
    spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "id bigint").write.parquet(str(tmp_path / "ends" / "cards.parquet"))
    ends = dict(map(tuple, run(spark, str(tmp_path / "ends")).collect()))
    assert ends == {i: "%.1f TB" % (17 * i**3 / 2**40) if i > 0 else f"{17 * i**3} B" for i in (2**63 - 1, -(2**63))}
