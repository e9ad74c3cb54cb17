"""Operators for training data against brute force, round trips and awkward tables."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import bitslice, components, features, graphindex, history, merkle, packing, reading, survivors, text as T
from corpusloom.plans.staging import Stage

WORDS = [a + b for a in ("grid", "port", "levy", "bond", "dam", "quota", "audit", "ferry", "veto", "tariff") for b in ("", "s", "er", "ing", "al", "ist", "or", "age", "y", "ed")]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


def _corpus(seed=1, groups=40, size=4):
    """(id, text) with groups of copies, edited copies and reordered ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = _text(rng, rng.randrange(30, 200))
        for k in range(rng.randrange(1, size + 1)):
            w = base.split()
            variant = base if k == 1 else base.upper().replace(" ", " — ") if k == 2 else _edited(rng, base, len(w) // 25)
            if k == 3:
                half = len(variant.split()) // 3
                v = variant.split()
                variant = " ".join(v[half:] + v[:half])
            out.append(variant)
    rng.shuffle(out)
    return list(enumerate(out, 1))


def _links(rows):
    h = T.WordHasher()
    words = {k: h(T.words(t)) for k, t in rows}
    ids = sorted(words)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if T.same_up_to_edits(words[a], words[b])}


# --- texts --------------------------------------------------------------------------------


def test_normal_forms():
    assert T.squeezed("Ｔhe ﬁnal — “word”\n") == T.squeezed("the FINAL word") == "thefinalword"
    assert T.words("treat-\nment so­ft ze​ro x—y") == ["treatment", "soft", "zero", "x", "y"]
    assert T.squeezed(None) == "" and T.words("?!") == [] and T.words("") == []


# --- 1: survivors ---------------------------------------------------------------------------

CARD = "id bigint, canonical_key string, fullcite string, body_text string, variant_count bigint, team_count bigint, markup_html string, fidelity string, updated_at timestamp, field string"
CITE = "Dov Zan (Staff Writer). \"A title.\" Marl Herald. {}. https://x.example/1, Accessed: 1-2-2024"


def _stamp(day):
    from datetime import datetime

    return datetime(2024, 1, day)


def _best(spark, rows):
    df = spark.createDataFrame(rows, CARD)
    return {(r.canonical_key, r.field): r.id for r in survivors.best_fields(df, survivors.card_fields()).collect()}


def test_fields_are_chosen_apart(spark):
    full, part = "<p>The <mark>bo</mark>dy &amp; more</p>", "<p>The body</p>"
    got = _best(spark, [
        (1, "k", CITE.format("2015"), "The body & more.", 3, 2, part, "opensource", _stamp(9), "x"),
        (2, "k", CITE.format("May 2015"), "The body & more.", 3, 4, full, "pdf", _stamp(1), "x"),
        (3, "k", "Zan 15", "The body & more.", 3, 3, full, "private", None, "x"),
        (4, "k", CITE.format("n.d."), "The body & more.", 3, 0, None, "opensource", None, None),
        (5, "one", CITE.format("2015"), "b", 1, 1, "b", "pdf", None, None),
        (6, None, None, None, None, None, None, None, None, None),
        (7, None, None, None, None, None, None, None, None, None),
        (8, "none", None, None, None, None, None, None, None, None),
        (9, "none", "", "", 1, 9999, "", "?", None, None),
    ])
    assert got == {("k", "markup_html"): 2, ("k", "fullcite"): 1, ("k", "team_count"): 1}


def test_precedence_is_learned_where_time_is_missing(spark):
    rows, k = [], 0
    for g in range(20):  # with a timestamp, counts grow
        for day, n in ((1, 1), (5, 4), (9, 16)):
            k += 1
            rows.append((k, f"t{g}", None, None, 99, n, None, "pdf", _stamp(day), None))
    rows += [(901, "u", None, None, 99, 16, None, "pdf", None, None), (900, "u", None, None, 99, 4, None, "pdf", None, None), (902, "u", None, None, 99, 1, None, "pdf", None, None)]
    assert _best(spark, rows)["u", "team_count"] == 901
    assert survivors.precedence([(1, 2, 5), (2, 1, 3), (2, 3, 1), (3, 4, 1), (4, 3, 1)]) == {1: {2, 3}, 2: {3}, 3: set(), 4: set()}
    assert survivors.precedence([(0, 1, 2), (1, 2, 2), (2, 0, 2), (2, 3, 1)]) == {0: {3}, 1: {3}, 2: {3}, 3: set()}


def test_orders_are_partial_and_per_group(spark):
    """Two histories that never meet: 1 before 4, and 2 before 8 before 32 (as team counts)."""
    rows, k = [], 0
    for g in range(6):
        for h, counts in (("a", (1, 4)), ("b", (2, 8, 32))):
            for day, n in enumerate(counts, 1):
                k += 1
                rows.append((k, f"{h}{g}", None, None, 99, n, None, "pdf", _stamp(day), None))
    at = lambda i, key, n, t=None: (i, key, None, None, 99, n, None, "pdf", t, None)
    rows += [at(100, "chain", 2), at(101, "chain", 32), at(102, "chain", 8)]
    rows += [at(110, "apart", 8), at(111, "apart", 4), at(112, "apart", 1), at(113, "apart", 2)]  # 4 and 8 have no order: the smaller id
    rows += [at(120, "equal", 8, _stamp(9)), at(121, "equal", 32, _stamp(9)), at(122, "equal", 2, _stamp(10))]  # times go first
    rows += [at(130, "same time", 8, _stamp(9)), at(131, "same time", 32, _stamp(9)), at(132, "same time", 99, None)]
    got = _best(spark, rows)
    assert [got[g, "team_count"] for g in ("chain", "apart", "equal", "same time")] == [101, 110, 122, 131]


def test_ties_and_empty(spark):
    row = (5, "k", None, None, 3, 2, None, "pdf", None, None)
    assert _best(spark, [row, (4, *row[1:]), row])["k", "team_count"] == 4
    assert _best(spark, []) == {}


# --- 2: bit slices --------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 300), st.integers(1, 5), st.sampled_from([0, 20, 44, 64, 127]))
def test_lanes_count_exactly(seed, n, n_keys, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (3, 2), dtype=np.int64)
    codes = base[rng.integers(0, 3, n)] ^ (rng.integers(0, 2**63, (n, 2)) & rng.integers(0, 2**63, (n, 2)) & rng.integers(0, 2**63, (n, 2)))
    keys = np.sort(rng.integers(0, n_keys, n))
    i, j = bitslice.pairs_in_runs(keys, np.ascontiguousarray(codes[:, 0]), np.ascontiguousarray(codes[:, 1]), radius)
    u = codes.view(np.uint64)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if keys[a] == keys[b] and np.bitwise_count(u[a] ^ u[b]).sum() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def _near(spark, rows, kinds=None):
    df = spark.createDataFrame([(k, str(k), (kinds or {}).get(k), t, "x") for k, t in rows], "id bigint, grp string, kind boolean, text string, rep string")
    members, pairs = bitslice.near_duplicates(df, Stage(spark, "test"))
    return {(r.id_a, r.id_b) for r in bitslice.pairs_between_groups(members, pairs).collect()}


def test_near_duplicates_match_brute_force(spark):
    rows = _corpus()
    assert _near(spark, rows) == _links(rows)


def test_hot_bucket_in_blocks(spark):
    rows = _corpus(2, 10)
    df = spark.createDataFrame([(k, True, t) for k, t in rows], "id bigint, kind boolean, text string")
    stage = Stage(spark, "test")
    reps = stage.write(features.classes(features.describe(df, "id"), "id", (F.first(F.octet_length("words")) / 4).cast("int").alias("n_words")), "reps")
    hot = reps.withColumn("bands", F.array(F.lit(7).cast("bigint")))
    whole = {tuple(r) for r in bitslice.candidate_pairs(hot).collect()}
    cut = {tuple(r) for r in bitslice.candidate_pairs(hot, block=5).collect()}
    assert whole == cut and whole
    words = {k: len(T.words(t)) for k, t in rows}
    assert all(min(words[a], words[b]) >= 0.8 * max(words[a], words[b]) for a, b in whole)


def test_block_pairs_of_one_bucket_are_compared_one_by_one():
    """A task that gets many block pairs of one bucket holds one, not all."""
    rng, taken = np.random.default_rng(2), []

    def batches():
        for pair in range(40):
            taken.append(pair)
            n = 8192
            part = np.arange(n) % 2
            yield bitslice.pa.RecordBatch.from_pydict({
                "bucket": np.full(n, 7), "part_i": np.full(n, pair), "part_j": np.full(n, pair + 100), "part": part * 100 + pair,
                "rep": np.arange(n) + pair * n, "s0": np.r_[rng.integers(-2**63, 2**63 - 1, n - 2), 1, 1], "s1": np.r_[rng.integers(-2**63, 2**63 - 1, n - 2), 1, 1], "n_words": np.full(n, 100),
            })

    out = bitslice._compare(3)(batches())
    first = next(out)
    assert len(taken) <= bitslice.TAKEN // 8192 + 1
    assert first.num_rows + sum(b.num_rows for b in out) == 40


def test_awkward_texts(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "?!"), (4, "one"), (5, "ONE."), (6, long), (7, long + " end"), (8, "one")]
    assert _near(spark, rows, {8: True}) == {(4, 5), (6, 7)}
    assert _near(spark, []) == set()


# --- 4: components --------------------------------------------------------------------------


def _groups(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {(x, top(x)) for x in parent}


@pytest.mark.parametrize("bound", [7, 50, 10_000])
def test_components(spark, bound):
    rng = random.Random(bound)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5000, 5200)]
    edges += [(None, 1), (1, None), (3, 3), edges[0], edges[0][::-1]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "node bigint, root bigint").repartition(5)
    got = components.connected_components(df, bound=bound)
    assert {tuple(r) for r in got.collect()} == _groups(edges) and got.count() == got.distinct().count()


def test_components_last_merge_is_in_one_partition(spark):
    """120 star edges, a little more than the bound; a level in two partitions leaves a little
    less, with nodes that have a root in each."""
    edges = [(10 * g + root, 10 * g + k) for root in (0, 1) for g in range(20) for k in (2, 3, 4)]
    got = components.connected_components(spark.createDataFrame(edges, "node bigint, root bigint"), bound=len(edges) - 1)
    assert {tuple(r) for r in got.collect()} == _groups(edges) and got.count() == got.distinct().count()


def test_members_and_empty(spark):
    rows = [(k % 90, f"b{k % 17}") for k in range(400)] + [(500, None), (None, "b1"), (501, "alone")]
    stage = Stage(spark, "test")
    df = spark.createDataFrame(rows, "card_id bigint, bucket string").repartition(4)
    got = components.connected_components(components.member_edges(df, stage, bound=16), stage)
    by = defaultdict(list)
    for k, b in rows:
        if k is not None and b is not None:
            by[b].append(k)
    assert {tuple(r) for r in got.collect()} == _groups([(v[0], x) for v in by.values() for x in v])
    assert components.connected_components(df.select("card_id", "card_id").toDF("a", "b").limit(0)).isEmpty()


# --- 5: history -----------------------------------------------------------------------------

RECORD = "record_id bigint, batch_no int, external_id string, tag string, body_text string, is_analytic boolean, payload string, rep string, text string"


def test_history_matches_brute_force(spark):
    rng = random.Random(5)
    rows = _corpus(3, 30)
    records = [(k, k * 6 // (len(rows) + 1), f"HF-{rng.randrange(60):04d}" if k % 4 == 0 else None, None, t, None, None, "x", "y") for k, t in rows]
    edges = set(_links(rows))
    by = defaultdict(list)
    for r in records:
        if r[2]:
            by[int(r[2][3:])].append(r[0])
    edges |= {(v[0], x) for v in by.values() for x in v}
    batch = {r[0]: r[1] for r in records}
    want = {(g, k) for k, g in _groups(edges) if batch[g] < batch[k]}
    got = {tuple(r) for r in history.first_accepted(spark.createDataFrame(records, RECORD)).collect()}
    assert got == want and want


def test_history_awkward(spark):
    got = history.first_accepted(spark.createDataFrame([
        (1, 1, " 007 ", None, None, None, None, None, None), (2, 2, "hf_7", "t", "", None, None, None, None), (3, None, "x", None, None, True, None, None, None),
        (4, 2, None, "only tag words here", None, True, None, None, None), (5, 3, None, None, None, None, '{"tag": "Only TAG words, here", "is_analytic": "true"}', None, None),
        (6, 3, None, None, "only tag words here", None, "broken", None, None),
    ], RECORD))
    assert {tuple(r) for r in got.collect()} == {(1, 2), (4, 5)}
    assert history.first_accepted(spark.createDataFrame([], RECORD)).isEmpty()


def test_history_handed_over_in_calls(spark):
    """Calls on one index folder, with a batch cut in two, against one call over all."""
    rng = random.Random(8)
    rows = _corpus(8, 20)
    records = [(k, rng.randrange(4), f"HF-{rng.randrange(40):04d}" if k % 4 == 0 else None, None, t, None, None, "x", "y") for k, t in rows]
    first = [r for r in records if r[1] < 2 or r[1] == 2 and r[0] % 2]
    second = [r for r in records if r not in first]
    path = Stage(spark, "test").path("index")

    def call(some, index=None):
        return {tuple(r) for r in history.first_accepted(spark.createDataFrame(some, RECORD), index=index).collect()}

    want, new = call(records), {r[0] for r in second}
    assert call(first, path) == call(first)
    assert call(second, path) == want
    assert {g for g, k in want if k in new} - new and call([], path) == want == call(first[:9], path)


def test_history_call_by_call(spark):
    """A call per batch, opened anew each time, gives what one call over all gives; shards merge on the way."""
    rows = _corpus(4, 60)
    records = [(k, k % 6, f"HF-{k % 50:04d}" if k % 5 == 0 else None, None, t, None, None, "x", "y") for k, t in rows]
    stage = Stage(spark, "test")
    for b in range(6):
        one = spark.createDataFrame([r for r in records if r[1] == b], RECORD)
        if b == 3:  # a call that fails before it commits leaves nothing that counts
            broken = history.History(spark, stage.path("index"))
            broken.index.commit = lambda call: 1 / 0
            with pytest.raises(ZeroDivisionError):
                broken.accept(one)
        history.History(spark, stage.path("index")).accept(one)
    index = history.History(spark, stage.path("index"))
    got = {tuple(r) for r in index.first_accepted().collect()}
    assert got == {tuple(r) for r in history.first_accepted(spark.createDataFrame(records, RECORD)).collect()} and got
    assert len(index.index.live) < 6 and len(index.index.calls) == 6
    folders = {f.getPath().getName() for f in index.index._fs.listStatus(index.index._path(stage.path("index"))) if f.isDirectory()}
    assert folders == {*index.index.calls, *(e["name"] for e in index.index.live)}


def _texts(rows):
    h = T.WordHasher()
    hashed = [h(T.words(t)) for _, t in rows]
    runs = [T.shingles(x, features.RUN) for x in hashed]
    starts = np.cumsum([0, *map(len, runs[:-1])])
    mins = T.minhashes(np.concatenate(runs), starts, features.HASHES)
    bands = np.ascontiguousarray(T.band_keys(mins[: features.ROWS * features.BANDS], features.ROWS).T.astype(np.uint32))
    ends = np.cumsum([len(x) for x in hashed])
    return graphindex.Texts(np.array([k for k, _ in rows]), np.zeros(len(rows), bool), T.sketch_bits(mins), bands, np.concatenate(hashed).astype(np.uint32), ends)


def test_graph_links_every_component():
    rows = _corpus(6, 400)
    texts = _texts(rows)
    half = len(rows) // 2
    old = graphindex.Shard.from_bytes(graphindex.Shard(texts.take(np.arange(half))).to_bytes())
    new = graphindex.Shard(texts.take(np.arange(half, len(rows))))
    q, node = old.linked(new.texts)
    edges = [(old.ids[x], old.ids[y]) for x, y in graphindex.Shard(old.texts).pairs] + [(new.ids[x], new.ids[y]) for x, y in new.pairs] + list(zip(new.ids[q], old.ids[node], strict=True))
    assert set(_groups(edges)) == set(_groups(_links(rows)))
    merged = graphindex.Shard.merged([old, new, old])  # repeated texts once
    assert len(merged.ids) == len({texts.words_of(k).tobytes() for k in range(len(rows))})
    by = dict(zip(merged.ids.tolist(), merged.component.tolist(), strict=True))
    assert all(by[a] == by[b] for a, b in _links(rows) if a in by and b in by)
    got, every = old.recall(old.codes, old.bands)
    assert got >= 0.5 * every > 0


def test_a_cluster_gives_a_spanning_set():
    """Ten thousand near texts: seconds, and links in proportion to the texts."""
    rng = random.Random(3)
    base = _text(rng, 120)
    rows = [(k, _edited(rng, base, 3)) for k in range(10_000)]
    began = time.perf_counter()
    shard = graphindex.Shard(_texts(rows))
    q, _ = shard.linked(_texts([(k, _edited(rng, base, 3)) for k in range(20_000, 22_000)]))
    assert time.perf_counter() - began < 120
    assert len(set(shard.component.tolist())) == 1 and len(shard.pairs) == 9_999
    assert len(set(q)) == len(q) == 2_000


# --- 6: merkle ------------------------------------------------------------------------------


def test_field_order_and_form_do_not_matter():
    a = merkle.canonical({"tag": "Ｔhe “tag”", "n": [1, {"x": "A", "y": None}]})
    assert a == merkle.canonical({"n": [1, {"y": "", "x": "a!"}], "tag": "the TAG"})
    assert a != merkle.canonical({"n": [{"y": "", "x": "a!"}, 1], "tag": "the TAG"})
    assert merkle.canonical({"a": "b"}) != merkle.canonical({"b": "a"})


def test_same_records(spark):
    rows = [
        (1, "Tag", "The body.", None, None), (2, "TAG!", "the​ bo­dy", False, None), (3, None, None, None, '{"is_analytic": "false", "body_text": "The Body", "tag": "tag"}'),
        (4, "Tag", "The body.", True, None), (5, "Tag", "The body", None, '{"is_analytic": 1}'), (6, None, "", None, None), (7, "?", None, None, "{broken"),
        (8, None, "x" * 200_000, None, None), (9, "", "X" * 200_000, None, None), (9, "", "X" * 200_000, None, None),
    ]
    df = spark.createDataFrame([(*r, "root") for r in rows], "record_id bigint, tag string, body_text string, is_analytic boolean, payload string, root string")
    got = {tuple(r) for r in merkle.same_records(df).collect()}
    assert got == {(1, 3), (4, 2), (8, 3)}
    assert merkle.same_records(df.limit(0)).isEmpty()


# --- 7, 8: tokens and containers ------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    from pathlib import Path

    from corpusloom.llm.bpe import VOCABULARY, encoder

    if not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary files")
    return encoder()


def _reference():
    tokenizers = pytest.importorskip("tokenizers")
    from corpusloom.llm.bpe import VOCABULARY

    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text_encodes_and_decodes(bpe, text):
    ids = bpe.encode(text)
    assert bpe.decode(ids) == text
    assert ids == _reference().encode(text, add_special_tokens=False).ids


def test_long_pieces(bpe):
    for text in ("a" * 20_000, "ab" * 5_000 + " " * 3_000, "<|endoftext|>", "日本語" * 2_000, "\n\n\t  x"):
        assert bpe.encode(text) == _reference().encode(text, add_special_tokens=False).ids


def test_ids_of_rows(spark, bpe):
    from corpusloom.llm.bpe import encode_texts

    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (3, None)], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df).collect())
    assert got == [(1, bpe.encode("a b")), (2, []), (3, []), (3, [])]
    assert encode_texts(df.limit(0)).isEmpty()


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=40), st.integers(1, 30))
def test_plan_places_every_item_once(histogram, groups):
    seen, load = Counter(), Counter()
    for size, first, n, at in packing.plan(histogram, 100, groups):
        for k in range(n):
            seen[size, first + k] += 1
            load[at + k] += size
    assert set(seen.values()) <= {1} and Counter(s for s, _ in seen) == Counter(histogram)
    assert max(load.values(), default=0) <= 100
    if load:
        assert set(load) == set(range(len(load)))
        large = sum(n for s, n in histogram.items() if s > 100 // packing.SMALL_PART)
        small = sum(s * n for s, n in histogram.items()) - sum(s * n for s, n in histogram.items() if s > 100 // packing.SMALL_PART)
        # at worst each large item lies alone, and small ones leave less room than one of them takes
        assert len(load) <= large + small / (100 - 100 // packing.SMALL_PART) + 1


def test_plan_comes_near_the_lower_bound():
    rng = random.Random(3)
    sizes = Counter(min(100, max(1, int(rng.lognormvariate(3, 0.8)))) for _ in range(20_000))
    used = {at + k for _, _, n, at in packing.plan(dict(sizes), 100) for k in range(n)}
    assert len(used) <= 1.02 * sum(s * n for s, n in sizes.items()) / 100


def test_pack(spark):
    rng = random.Random(2)
    sizes = [(k, rng.choice([0, 1, 7, 33, 50, 99, 100, 101, 250, 700])) for k in range(2000)] + [(5000, None), (7, 33), (7, 33)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens int").withColumn("container", F.lit(0))
    rows = packing.pack(df, 100).collect()
    load, whole = Counter(), Counter()
    for r in rows:
        load[r.container] += r["size"]
        whole[r.doc_id] += r["size"]
    assert max(load.values()) <= 100 and set(load) == set(range(len(load)))
    want = Counter()
    for k, n in sizes:
        want[k] += n or 0
    assert whole == +want
    assert {r.doc_id for r in rows if r.piece} == {k for k, n in sizes if n and n > 100}
    assert packing.pack(df.limit(0)).isEmpty()


# --- 9: reading level -----------------------------------------------------------------------


def _graded(rng, level, n=40):
    """Sentences of words of their own level and, at times, of the one below."""
    out = []
    for _ in range(n):
        k = max(1, level - (rng.random() < 0.3))
        out.append(" ".join(f"{'abcde'[k - 1]}{rng.choice('lmnopqrst')}{rng.choice('uvwxyz')}" for _ in range(4 + 2 * k)).capitalize() + ".")
    return " ".join(out)


def test_levels_of_held_out_texts(spark):
    rng = random.Random(9)
    refs = spark.createDataFrame([(lv, _graded(rng, lv, 10)) for lv in range(1, 6) for _ in range(8)], "level int, text string")
    docs = [(k, _graded(rng, k % 5 + 1)) for k in range(300)] + [(900, None), (901, ""), (902, "1 2 3"), (0, _graded(rng, 1))]
    got = reading.reading_levels(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("level", F.lit(9)), refs).collect()
    right = sum(r.level == r.doc_id % 5 + 1 for r in got)
    assert len(got) == 301 and right >= 0.95 * len(got)
    assert reading.reading_levels(spark.createDataFrame([], "doc_id bigint, text string"), refs).isEmpty()


def test_english_of_length(spark):
    df = spark.createDataFrame([(1, " a" * 50, "en"), (2, " a" * 49, "en"), (3, "a " * 50, "en"), (4, "a " * 50, "EN"), (5, None, "en"), (6, "a " * 60, None)], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in reading.english_of_length(df).collect()) == [1, 3]
