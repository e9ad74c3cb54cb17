"""Near-duplicate bodies by shingles: candidates by banded minimum hashes, then the greedy
merge that always tests the current survivors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from ..functions import text as X
from ..plans.staging import Stage

# Shingle length and the two thresholds of the verdict. The 128 hashes make 16
# bands of 8: at a similarity of 0.9 one pair in ten thousand is missed, of 8 bands of 16 one in five.
SHINGLE = 5
BANDS, ROWS = 16, 8
DUP_JACCARD, TRIM_CONTAINMENT = 0.90, 0.95
#: Cards of a band beyond which its pairs are made in blocks, and cards that one call of the merge takes
#: (a component larger than that has a call of its own).
BAND_BLOCK, MERGE_CARDS = 2000, 5000


def shingle_hashes(norm: Column, k: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of all runs of k words; fewer words give an empty array."""
    w = X.word_list(norm)
    n = F.greatest(F.size(w) - F.lit(k - 1), F.lit(0))
    # k shifted copies side by side: nothing is computed again for each element, as it
    # would be if the list of words were used inside the lambda
    runs = F.arrays_zip(*(F.slice(w, F.lit(j + 1), n).alias(f"w{j}") for j in range(k)))
    return F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))


def universe(cards: DataFrame) -> DataFrame:
    """Evidence of five words or more: card_id, cite, n_tokens, body_len, shingles."""
    c = cards.where(~F.col("is_analytic") & (F.col("body_text") != "")).withColumn("norm", X.normalize(F.col("body_text")))
    c = c.withColumn("n_tokens", F.size(X.word_list(F.col("norm")))).where(F.col("n_tokens") >= SHINGLE)
    return c.select("card_id", "cite", "n_tokens", F.coalesce("body_len", F.length("body_text")).alias("body_len"), shingle_hashes(F.col("norm")).alias("shingles"))


@pandas_udf(ArrayType(LongType()))
def _band_keys(shingles: pd.Series) -> pd.Series:
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    sizes = shingles.map(len).to_numpy()
    if not len(sizes):
        return pd.Series([], dtype=object)
    # one pass per hash over the shingles of the whole batch; no row is without a shingle
    flat = np.concatenate(shingles.to_list()).view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    mins = np.stack([np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(16), starts) for k in range(BANDS * ROWS)])
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None] + np.uint64(1), len(sizes), axis=1)
    for r in range(ROWS):
        out = (out ^ mins[r::ROWS]) * mix
        out ^= out >> np.uint64(32)
    return pd.Series(list(np.ascontiguousarray(out.T).view(np.int64)))


def candidate_pairs(cards: DataFrame, block: int = BAND_BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of cards that share a band (by the minimum hashes of their shingles, so a
    trim is sought only where the similarity is high too). A band of more than ``block`` cards is parted by hash and paired
    part with part, so no join task gets all of it. Cards with the very same shingles
    and citation are one node in the bands, under the smallest id, and each of them is
    paired with that one: the merge treats them alike, and no group gives all its pairs."""
    same = cards.select("card_id", F.xxhash64("shingles").alias("h1"), F.hash("shingles").alias("h2"), F.coalesce("cite", F.lit("")).alias("c"), "shingles")
    first = same.groupBy("h1", "h2", "c").agg(F.min("card_id").alias("a"), F.first("shingles").alias("shingles"))
    copies = same.join(first.select("h1", "h2", "c", "a"), ["h1", "h2", "c"]).where("card_id <> a").select("a", F.col("card_id").alias("b"))
    bands = first.select("a", F.explode(_band_keys("shingles")).alias("band"))
    parts = bands.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")).where("n > 1")
    cut = bands.join(parts, "band", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("a"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = cut.select("a", "band", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    pairs = cut.join(cut.toDF("b", "band", "part_b", "lo", "hi"), ["band", "lo", "hi"]).where("a < b and (lo = hi or part <> part_b)").select("a", "b")
    return pairs.unionByName(copies).distinct()


def verdict(shingles_a: Column, shingles_b: Column) -> Column:
    """dup, trim or null."""
    both = F.size(F.array_intersect(shingles_a, shingles_b))
    na, nb = F.size(shingles_a), F.size(shingles_b)
    jaccard = both / F.nullif(na + nb - both, F.lit(0))
    contained = both / F.nullif(F.least(na, nb), F.lit(0))
    return F.when(jaccard >= DUP_JACCARD, "dup").when(contained >= TRIM_CONTAINMENT, "trim")


def verified_pairs(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs with their own verdict and measures (before any merge)."""
    s = cards.select(F.col("card_id").alias("_id"), "shingles")
    both = pairs.join(s.withColumnRenamed("shingles", "sa"), F.col("a") == F.col("_id")).drop("_id").join(s.withColumnRenamed("shingles", "sb"), F.col("b") == F.col("_id")).drop("_id")
    return both.select("a", "b", verdict(F.col("sa"), F.col("sb")).alias("verdict")).where("verdict is not null")


def component_labels(pairs: DataFrame, stage: Stage) -> DataFrame:
    """(card_id, component) by hashing to the smallest neighbour and jumping to its label,
    which halves distances, until nothing changes; an error if that does not come about."""
    edges = stage.write(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v"), "edges")
    labels = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
    labels = stage.write(labels, "labels-0")
    for turn in range(1, 64):
        near = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.least("label", "near").alias("label"), "label")
        step = step.toDF("u", "label", "old")
        jump = step.join(step.select(F.col("u").alias("label"), F.col("label").alias("up")), "label", "left")
        step = stage.write(jump.select("u", F.coalesce(F.least("label", "up"), "label").alias("label"), "old"), f"labels-{turn}")
        labels = step.select("u", "label")
        if step.where("label <> old").isEmpty():
            return labels.select(F.col("u").alias("card_id"), F.col("label").alias("component"))
        if turn > 1:
            stage.drop(f"labels-{turn - 2}")
    raise RuntimeError("the components did not settle")


def _greedy(pairs: list[tuple[int, int]], cards: dict[int, dict]) -> list[tuple[int, int, str]]:
    """Merges of one component, in order of the pairs: each is judged on the texts and
    citations of the two survivors at that time; the longer one survives. Pairs of several
    components may come together: they never meet."""
    parent = {c: c for c in cards}
    out = []

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        x, y = cards[top(a)], cards[top(b)]
        if x is y:
            continue
        both = len(x["set"] & y["set"])
        if both >= DUP_JACCARD * len(x["set"] | y["set"]):
            relation = "dup"
        elif both >= TRIM_CONTAINMENT * min(len(x["set"]), len(y["set"])):
            relation = "trim"
        else:
            continue
        if x["year"] is None or x["year"] != y["year"] or not x["authors"] & y["authors"]:
            continue
        keep, gone = sorted((x, y), key=lambda c: (-c["n_tokens"], -c["body_len"], c["card_id"]))
        parent[gone["card_id"]] = keep["card_id"]
        out.append((keep["card_id"], gone["card_id"], relation))
    return out


def greedy_merges(cards: DataFrame, pairs: DataFrame, stage: Stage | None = None) -> DataFrame:
    """(survivor_id, absorbed_id, relation) of all merges. The loop depends on its order,
    but components of the candidate graph never meet, so each is solved on its own; small ones
    share a call."""
    stage = stage or Stage(cards.sparkSession, "dedup")
    labels = component_labels(pairs, stage)
    shares = -(-labels.count() // MERGE_CARDS) or 1
    large = labels.groupBy("component").count().where(F.col("count") > MERGE_CARDS).select("component", F.lit(True).alias("own"))
    share = F.when(F.col("own"), F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(shares)))
    labels = stage.write(labels.join(large, "component", "left").select("card_id", share.alias("share")), "shares")
    edges = pairs.join(labels.toDF("a", "group"), "a").select("group", "a", "b")
    nodes = cards.join(labels, "card_id").select(
        "share", "card_id", "n_tokens", "body_len", "shingles", X.cite_year_strict(F.col("cite")).alias("year"), X.author_tokens(F.col("cite")).alias("authors")
    )

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = {
            int(r.card_id): {"card_id": int(r.card_id), "n_tokens": r.n_tokens, "body_len": r.body_len, "set": set(r.shingles), "year": r.year, "authors": set(r.authors)}
            for r in left.itertuples()
        }
        merges = _greedy(list(zip(right.a.astype(int), right.b.astype(int), strict=True)), own)
        return pd.DataFrame(merges, columns=["survivor_id", "absorbed_id", "relation"])

    return nodes.groupBy("share").cogroup(edges.groupBy("group")).applyInPandas(run, "survivor_id bigint, absorbed_id bigint, relation string")


def final_map(merges: DataFrame, stage: Stage | None = None) -> DataFrame:
    """(old_id, survivor_id): every absorbed card with the card that is alive in the end."""
    stage = stage or Stage(merges.sparkSession, "final")
    now = stage.write(merges.select(F.col("absorbed_id").alias("old_id"), "survivor_id"), "map-0")
    for turn in range(1, 64):
        up = now.select(F.col("old_id").alias("survivor_id"), F.col("survivor_id").alias("up"))
        step = stage.write(now.join(up, "survivor_id", "left").select("old_id", F.coalesce("up", "survivor_id").alias("survivor_id"), F.col("up").isNotNull().alias("moved")), f"map-{turn}")
        now = step.select("old_id", "survivor_id")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError("merges form a cycle")

