"""The search language, and ranking against SQLite's own full text index."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.stem import Analyzer, porter
from corpusloom.operators.fulltext import TextIndex, prefix_snippet_of, snippet_of
from corpusloom.plans.grammar import Term, parse
from corpusloom.plans.search import Tables, search
from corpusloom.plans.staging import Stage

WORDS = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing happy sky relational conditional valency digitizer conformably radically differently vilely analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate angularity effective bowdlerize probate rate cease controlling rolling policies policy running generalizations oscillators archaeology yes"


def _fts(rows):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(tag, cite, block, body, tokenize='porter unicode61 remove_diacritics 2')")
    con.executemany("insert into f(rowid, tag, cite, block, body) values (?, ?, ?, ?, ?)", rows)
    return con


def test_stems_match_the_index_of_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    con.execute("create virtual table v using fts5vocab(f, 'instance')")
    con.executemany("insert into f(rowid, x) values (?, ?)", list(enumerate(WORDS.split(), 1)))
    theirs = {doc: term for term, doc, *_ in con.execute("select * from v")}
    assert {w: porter(w) for w in WORDS.split()} == {w: theirs[k] for k, w in enumerate(WORDS.split(), 1)}
    assert Analyzer()("it's a naïve x_y U.S. Café") == ["it", "s", "a", "naiv", "x", "y", "u", "s", "cafe"]


ROWS = [
    (1, "Grid reliability fails", "Kessler '26", "Economy", "The interconnection queue makes grid reliability worse. Grid operators said so twice."),
    (2, "Crypto strains the grid", "Diamond '13", "", "Mining hurts the grid and its reliability in summer, reliably."),
    (3, "Econ", "Rodgers and Cooper 06", "", "The interconnection queue slows growth"),
    (4, "Framework", "Smith et al. 24", "A2: Moratorium", "Weigh policies by the policy that they are"),
    (5, "Water", "Nguyen '26", "", "queue of an interconnection; water for <b>cafés</b>"),
    (6, "", "", "", ""),
]


def _index(spark):
    df = spark.createDataFrame(ROWS, "card_id bigint, tag string, cite string, block string, body string")
    return TextIndex.build(df, Stage(spark, "test"))


@pytest.mark.parametrize(
    ("positives", "negatives", "theirs"),
    [
        (["grid"], [], '"grid"'),
        (["grid", "reliability"], [], '"grid" AND "reliability"'),
        (["interconnection queue"], [], '"interconnection queue"'),
        (["grid-reliability"], [], '"grid-reliability"'),
        (["policy"], [], '"policy"'),
        (["grid"], ["mining"], '"grid" NOT "mining"'),
        (["cafe"], [], '"cafe"'),
        (["queue", "26"], [], '"queue" AND "26"'),
        (["nowhere"], [], '"nowhere"'),
    ],
)
def test_scores_match_sqlite(spark, positives, negatives, theirs):
    con = _fts(ROWS)
    expected = dict(con.execute("select rowid, bm25(f, 5, 3, 2, 1) from f where f match ?", (theirs,)).fetchall())
    got = {r.card_id: r.score for r in _index(spark).match([Term(t) for t in positives], [Term(t) for t in negatives]).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_block_scope(spark):
    index = _index(spark)
    assert [r.card_id for r in index.match([Term("A2: Moratorium", "block")]).collect()] == [4]
    assert index.match([Term("grid", "block")]).isEmpty()
    assert index.match([Term("???")]).isEmpty()


def test_grammar():
    q = parse('grid "interconnection queue" -crypto side:con season:2025 year:2026 sort:recent min_reads:2 block:"A2: X"')
    assert [t.text for t in q.positives] == ["grid", "interconnection queue", "A2: X"] and q.positives[2].column == "block"
    assert [t.text for t in q.negatives] == ["crypto"]
    assert q.filters == {"side": "C", "season": 2025, "year": "26", "min_reads": 2} and q.sort == "recent"
    assert parse("-crypto").filters["exclude"][0].text == "crypto"
    assert parse("-crypto", "site").filters == {} and not parse("-crypto", "site").positives
    assert [t.text for t in parse("season:20 foo:bar -side:con").positives] == ["season:20", "foo:bar"]
    assert [t.text for t in parse("-side:con x").negatives] == ["side:con"]
    assert parse('topic:"unclosed').filters == {"topic": "unclosed"}
    assert parse("topic:a topic:b", "site").filters == {"topic": ["a", "b"]}
    assert parse("event:policy year:'26", "site").filters == {"event": "cx", "year": "26"}


@pytest.mark.parametrize("text", ["", ":", '"', "-", "--", "a:b:c", "'; drop table x", "NEAR(a b)", "* ^", "\x00", None, 5, "é" * 5000, 'year: side:"" -"'])
def test_anything_is_a_query(text):
    for dialect in ("engine", "site"):
        parse(text, dialect)


def _tables(spark):
    cards = spark.createDataFrame(
        [
            (1, "Grid", "Kessler '26", None, "grid reliability and the interconnection queue", 50, False, "2026-07-14", 2, 1, ["2026-SO"]),
            (2, "Crypto", "Diamond '13", None, "crypto and grid reliability", 40, False, "2013", 1, 1, ["2025-SO"]),
            (3, "Analytic", None, None, None, 0, True, None, 1, 1, []),
            (4, "Econ", "Rodgers 06", None, "interconnection queue", 20, False, "2026-05", 0, 0, ["2026-SO"]),
        ],
        "card_id bigint, tag string, cite string, fullcite string, body_text string, body_len bigint, is_analytic boolean, source_pub_date string, team_count bigint, school_count bigint, topic_codes array<string>",
    )
    disclosures = spark.createDataFrame(
        [(1, 1, "P", "2026-09-13", 2026, "Millburn"), (1, 1, "P", "2026-09-20", 2026, "Test%ville"), (2, 2, "C", "2025-09-20", 2025, "Oldtown")],
        "card_id bigint, topic_id bigint, side string, round_date string, season int, school_name string",
    ).withColumns({"school_display": F.lit(None).cast("string"), "team_name": F.lit("AB"), "team_display": F.lit(None).cast("string"), "caselist": F.lit("pf")})
    topics = spark.createDataFrame([(1, 2026, "SO", "2026-SO", "2026-09-01", "2026-10-31"), (2, 2025, "SO", "2025-SO", "2025-09-01", "2025-10-31")], "id bigint, season int, slot string, code string, starts string, ends string")
    rows = cards.select("card_id", F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("cite", F.lit("")).alias("cite"), F.lit("").alias("block"), F.coalesce("body_text", F.lit("")).alias("body"))
    return Tables(cards.withColumns({"block": F.lit(""), "events": F.lit("pf,ld")}), disclosures, topics, TextIndex.build(rows, Stage(spark, "test")))


def test_search(spark):
    t = _tables(spark)
    ids = lambda q, **kw: [r.card_id for r in search(t, q, "2026-09-15", **kw).hits.collect()]
    assert ids("grid reliability") == [1, 2] or set(ids("grid reliability")) == {1, 2}
    assert ids("") == [1, 2, 4]
    assert ids("is:analytic") == [3]
    assert ids("topic:present") == [1] and ids("topic:past") == [2] and ids("topic:9999-ZZ") == []
    assert ids("side:con") == [2] and ids("season:2025") == [2] and ids("school:millburn") == [1] and ids("school:%") == [1]
    assert ids("year:06") == [4] and ids("before:2026-01-01") == [2] and set(ids("after:2026-06-01")) == {1}
    assert ids("-crypto") == [1, 4] and ids("min_reads:2") == [1] and ids("status:ready") == [1, 2, 4]
    assert ids("sort:recent") == [1, 2, 4] and ids("sort:length") == [1, 2, 4]
    assert ids("", limit=1, offset=1) == [2] and search(t, "", "2026-09-15", limit=1).total() == 3
    assert ids("", dialect="site") == [1, 2, 3, 4] and ids("season:2025", dialect="site") == [2] and ids("event:ld grid", dialect="site") in ([1, 2], [2, 1])
    hit = search(t, '"interconnection queue"', "2026-09-15").hits.where("card_id = 4").first()
    assert hit.snippet == "<b>interconnection</b> <b>queue</b>"


def test_snippets():
    a = Analyzer()
    text = " ".join(f"w{k}" for k in range(100)) + " <script> grids "
    shown = snippet_of(text, [["grid"]], a)
    assert "<b>grids</b>" in shown and "&lt;script&gt;" in shown and shown.startswith("…")
    assert snippet_of(None, [["grid"]], a) == "" and snippet_of("...", [], a) == "..."
    assert prefix_snippet_of("<p>one two <u>three</u></p>", ["thr"]) == "one two <b>three</b>"
