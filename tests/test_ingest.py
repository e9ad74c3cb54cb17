"""Ingest: what becomes a card, who wins, and that a second run or another order changes nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import ingest as I
from corpusloom.plans.staging import Stage
from corpusloom.streaming.ingest import CorpusSink, ingest_stream

SCHEMA = (
    "record_id bigint, batch_no int, received_at timestamp, external_id string, round_id bigint, team_id bigint, tag string, cite string, fullcite string, "
    "body_text string, is_analytic boolean, source_url string, source_pub_date string, pocket string, hat string, block string, markup_html string, spoken string, "
    "highlight_ratio double, fidelity string, ordinal bigint, payload string"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def records(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], SCHEMA)


ROWS = [
    {"record_id": 1, "tag": " Tag ", "body_text": "The Grid.", "round_id": 5, "ordinal": 1, "external_id": "7", "cite": "A 17"},
    {"record_id": 2, "tag": "Other", "body_text": "the grid", "round_id": 6, "ordinal": 1, "source_url": "https://a.example", "external_id": "8"},
    {"record_id": 3, "tag": "Only a tag", "round_id": 5, "ordinal": 1},
    {"record_id": 4, "markup_html": "<p>" + "visible text that is long enough to be kept" + "</p>"},
    {"record_id": 5, "markup_html": "<p>short</p>"},
    {"record_id": 6, "payload": '{"tag": "T", "body_text": "in the payload"}'},
    {"record_id": 7, "payload": "no json", "tag": "", "body_text": "  "},
]


def test_mapping(spark):
    got = {r.record_id: (r.status, r.tag) for r in I.map_records(records(spark, *ROWS)).collect()}
    assert got == {1: ("evidence", "Tag"), 2: ("evidence", "Other"), 3: ("analytic", "Only a tag"), 4: ("recovered", None), 5: ("failed", None), 6: ("evidence", "T"), 7: ("failed", None)}


def test_first_wins_whatever_the_order(spark):
    mapped = I.map_records(records(spark, *ROWS))
    a = I.canonical_cards(mapped).orderBy("card_id").collect()
    b = I.canonical_cards(mapped.repartition(7).orderBy(F.desc("record_id"))).orderBy("card_id").collect()
    assert a == b and [r.card_id for r in a] == [1, 3, 4, 6]
    assert (a[0].tag, a[0].cite, a[0].source_url) == ("Tag", "A 17", "https://a.example")
    assert I.canonical_cards(mapped, existing=I.canonical_cards(mapped)).isEmpty()


def test_variants_conflict_only_when_whole(spark):
    mapped = I.map_records(records(spark, *ROWS, {"record_id": 8, "tag": "x", "round_id": 5}, {"record_id": 9, "tag": "x", "round_id": 5}))
    kept = {r.record_id for r in I.attach_variants(mapped).collect()}
    assert kept == {1, 2, 4, 6, 8, 9}
    assert I.attach_variants(mapped, existing=I.attach_variants(mapped)).where("ordinal is not null").isEmpty()


def test_empty(spark):
    mapped = I.map_records(records(spark))
    assert I.canonical_cards(mapped).isEmpty() and I.attach_variants(mapped).isEmpty()


def test_ledger_and_versions(spark):
    rows = spark.createDataFrame([("s", "1", "a", 1), ("s", "1", "b", 2), ("s", "2", "c", 1)], "source string, external_id string, sha256 string, ingested_at int")
    ledger = I.put_ledger(rows.limit(0), rows)
    assert {(r.external_id, r.sha256) for r in ledger.collect()} == {("1", "b"), ("2", "c")}
    assert [r.sha256 for r in I.not_in_ledger(rows, ledger).collect()] == ["a"]


def test_redirect_to_living_survivor(spark):
    cards = spark.createDataFrame([(1, "k1"), (2, "k2")], "card_id bigint, canonical_key string")
    merges = spark.createDataFrame([(1, "k3", 1), (9, "k3", 2), (2, "k4", 1)], "survivor_id bigint, absorbed_key string, merged_at int")
    rows = spark.createDataFrame([("k1",), ("k3",), ("k4",), ("k5",)], "canonical_key string")
    got = {r.canonical_key: r.card_id for r in I.redirect_keys(rows, merges, cards).collect()}
    assert got == {"k1": 1, "k3": None, "k4": 2, "k5": None}


def test_numbering_and_get_or_create(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = [r.n for r in I.number_rows(df, ["x"], "n").orderBy("x").collect()]
    assert got == list(range(1, 1001))
    have = spark.createDataFrame([(4, "a", None)], "id bigint, p string, q string")
    want = spark.createDataFrame([("a", None), ("b", "x"), ("b", None), ("b", "x")], "p string, q string")
    made = {(r.p, r.q): r.id for r in I.get_or_create(want, ["p", "q"], have).collect()}
    assert made == {("a", None): 4, ("b", None): 5, ("b", "x"): 6}


def test_numbers_and_caps_beyond_what_bounds_are_sampled_from(spark):
    """More rows and partitions than the range sampler looks at, with further columns, ties and a frequent value."""
    from corpusloom.operators.publish import capped

    n = 2_000_000
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id"))
    df = spark.range(0, n, 1, 200).select(key.alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("txt"), "id")
    got = I.number_rows(df, ["k"], "n")
    assert got.agg(F.countDistinct("n"), F.min("n"), F.max("n"), F.count("*")).first()[:] == (n, 1, n, n)
    ends = got.groupBy("k").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c"))
    assert ends.where("b - a + 1 <> c").isEmpty()  # in order: equal keys follow each other
    assert got.where("k = 0").count() == ends.where("k = 0").first().c
    cards = spark.range(0, 1_000_000, 1, 200).select(F.col("id").alias("card_id"), F.lit(False).alias("is_analytic"), (F.xxhash64("id") % 1000).alias("team_count"), F.lit(9).alias("body_len"), F.lit("x").alias("body_text"))
    kept = capped(cards, 333_333, F.lit(1))
    assert kept.count() == 333_333
    least = kept.agg(F.min("team_count")).first()[0]
    assert cards.where(F.col("team_count") > least).join(kept.select("card_id"), "card_id", "left_anti").isEmpty()
    edge = kept.where(F.col("team_count") == least).agg(F.max("card_id")).first()[0]
    assert cards.where((F.col("team_count") == least) & (F.col("card_id") <= edge)).join(kept.select("card_id"), "card_id", "left_anti").isEmpty()
    assert capped(cards, 0, F.lit(1)).isEmpty() and capped(cards.limit(0), 5, F.lit(1)).isEmpty()


def test_merges_move_rows_without_doubling(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "z")], "card_id bigint, bucket string")
    final = spark.createDataFrame([(2, 1)], "old_id bigint, survivor_id bigint")
    assert sorted(map(tuple, I.apply_merges(rows, final, ["bucket"]).collect())) == [(1, "x"), (1, "y"), (3, "z")]


def test_stream_batches_are_idempotent(spark):
    sink = CorpusSink(spark, Stage(spark, "sink").path("corpus"))
    first, again = records(spark, *ROWS[:3]), records(spark, {**ROWS[0], "record_id": 11, "body_text": "changed text"})
    sink.merge(first, 0)
    before = sorted(map(tuple, sink.read("cards").select("card_id", "canonical_key").collect()))
    sink.merge(first, 0)
    sink.merge(first, 1)
    assert sorted(map(tuple, sink.read("cards").select("card_id", "canonical_key").collect())) == before and len(sink.manifest()["parts"]) == 2
    sink.merge(again, 2)
    after = {r.card_id for r in sink.read("cards").collect()}
    assert after == {2, 3, 11}  # record 1 was replaced; its text lives on with record 2
    for k in range(5):  # batches between compactions
        sink.compact()
        sink.merge(records(spark, {"record_id": 100 + k, "tag": f"one more {k}"}), f"b{k}")
    assert {r.card_id for r in sink.read("cards").collect()} == after | {100, 101, 102, 103, 104}
    assert sink.read("variants").where("record_id < 100").count() == 2  # 3 and 11 share a place in one document


def test_stream_goes_on_with_what_lies_in_its_folder(spark):
    stage = Stage(spark, "resumed")
    for k in range(3):
        records(spark, *ROWS[k : k + 1]).coalesce(1).write.mode("append").parquet(stage.path("arrived"))
        sink = ingest_stream(spark, f"{stage.path('arrived')}/*.parquet", spark.read.parquet(stage.path("arrived")).schema, stage.path("corpus"))
        assert {r.record_id for r in sink.read("rows").collect()} == {r["record_id"] for r in ROWS[: k + 1]}
        sink.compact()
    again = ingest_stream(spark, f"{stage.path('arrived')}/*.parquet", spark.read.parquet(stage.path("arrived")).schema, stage.path("corpus"))
    assert again.read("rows").count() == 3


def test_files_resume_and_fail_apart(spark, tmp_path):
    """Four files, one of them broken, a stop after two: the rest comes later, nothing twice; search on what lasts."""
    from corpusloom.engine import Engine

    folder, store = tmp_path / "tables", f"file://{tmp_path}/store"
    records(spark).write.parquet(str(folder / "card_records.parquet"))
    for k, row in enumerate(ROWS[:3]):
        records(spark, row).coalesce(1).write.parquet(str(tmp_path / f"f{k}.parquet"))
    (tmp_path / "f3.parquet").write_bytes(b"no parquet")
    files = [str(tmp_path / f"f{k}.parquet") for k in range(4)]
    assert Engine(spark, str(folder), store).ingest(files[:2]) == {"done": 2, "skipped": 0, "failed": 0}
    engine = Engine(spark, str(folder), store)
    assert engine.ingest(files) == {"done": 1, "skipped": 2, "failed": 1}
    assert CorpusSink(spark, f"{store}/corpus").manifest()["failed"][files[3]]
    assert {r.card_id for r in engine.corpus.cards.collect()} == {1, 3}
    index = engine.reindex()
    assert index.rows == 2
    from corpusloom.operators.fulltext import TextIndex
    from corpusloom.plans.grammar import Term

    new = spark.createDataFrame([(9, "grid", "", "", "new words"), (1, "replaced", "", "", "nothing else")], "card_id bigint, tag string, cite string, block string, body string")
    TextIndex.update(new, f"{store}/index")
    for opened in (TextIndex.load, TextIndex.merge):
        index = opened(spark, f"{store}/index")
        assert {r.card_id for r in index.match([Term("grid")]).collect()} == {9} and index.rows == 3
        fresh = TextIndex.build(new.unionByName(spark.createDataFrame([(3, "Only a tag", "", "", "")], new.schema)), Stage(spark, "t"))
        score = lambda x: {(r.card_id, round(r.score, 9)) for r in x.match([Term("grid")]).collect()}
        assert score(index) == score(fresh)
    engine.backup(str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 3


def test_windows_close_and_late_events_do_not_open_them_again(spark):
    """Append mode, file by file: a window comes out once, closed; repeats within the bound count once; what comes too late is left out."""
    import time
    from datetime import datetime

    from corpusloom.streaming import windows as W

    def day(n, hour=1):
        return datetime(2024, 1, n, hour)

    stage = Stage(spark, "late")
    files = [
        [(1, day(1)), (2, day(2)), (2, day(2)), (3, day(3))],
        [(3, day(3)), (4, day(2, 23)), (5, day(4))],  # a repeat, and one that is late but within a day of the latest
        [(6, day(9))],
        [(8, day(9, 5)), (8, day(9, 5))],
        [(7, day(3))],  # days after its window was closed
        [(9, day(20))],
    ]
    for rows in files:
        spark.createDataFrame([(k, t, 1, "x", 1.0, None) for k, t in rows], W.EVENTS).coalesce(1).write.mode("append").parquet(stage.path("in/events.parquet"))
        time.sleep(0.05)  # files are taken in order of their time
    counted = W.run(W.tumbling(W.events(spark, stage.path("in"))), stage, "windows")
    assert sorted((r.start.day, r.n) for r in counted.collect()) == [(1, 1), (2, 3), (3, 2), (4, 1), (9, 3)]
    once = W.run(W.without_repeats(W.events(spark, stage.path("in")), "event_id").select("event_id"), stage, "once")
    assert sorted(r.event_id for r in once.collect()) == [1, 2, 3, 4, 5, 6, 8, 9]
