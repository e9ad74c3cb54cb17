"""Near-duplicates by bit-sliced comparison of sketches.

Texts that share a band key form a bucket. Inside buckets sketches are stored vertically:
plane k holds bit k of 64 texts per machine word. Comparing every text with the d-th next
one of its bucket is then, for 64 pairs at once, an exclusive or of each plane with itself
shifted by d; carry-save adders sum the planes into vertical counters, and words of which
every pair has passed the radius are abandoned early. Survivors are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import Stage
from .features import BANDS, classes, describe, verified
from .text import SAME_WORDS

#: Of 128 sketch bits, unrelated texts differ in 64 (deviation 5.7), texts with half of
#: their word runs in common in 32 (4.9), the weakest true pairs of the test data in 19 (4).
RADIUS = 44
#: Larger buckets are parted by the length of texts, since texts of which one is shorter than
#: four fifths of the other are never the same, and then compared block against block.
BLOCK = 4096
#: Rows that a comparing task takes in before it compares (and the rest of the last group).
TAKEN = 65_536
_STEP = 32
#: Words that are compared at once, of as many distances as it takes.
_WORDS = 4096


def planes(s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """uint64 [128, words]: bit k of text i is bit ``i % 64`` of ``[k, i // 64]``."""
    n = len(s0)
    rows = np.stack([s0, s1], axis=1).view(np.uint8).reshape(n, 16)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    padded = np.zeros((-(-n // 64) * 64, 128), dtype=np.uint8)
    padded[:n] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)


def _shifted(p: np.ndarray, at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Words ``at`` of the planes moved down by ``d`` texts, d for each word."""
    skip, by = at + (d >> 6), (d & 63).astype(np.uint64)
    last = p.shape[1] - 1
    low = np.where(skip <= last, p[:, np.minimum(skip, last)], np.uint64(0))
    high = np.where((skip < last) & (by > 0), p[:, np.minimum(skip + 1, last)], np.uint64(0))
    return (low >> by) | (high << ((np.uint64(64) - by) & np.uint64(63)))


def _add(counter: list[np.ndarray], bit: np.ndarray, weight: int) -> None:
    """Add 2**weight for each set bit to the vertical counter."""
    while weight < len(counter):
        counter[weight], bit = counter[weight] ^ bit, counter[weight] & bit
        weight += 1
    counter.append(bit)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _at_most(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Bits of the lanes whose counter does not exceed ``limit``."""
    less = np.zeros_like(counter[0])
    equal = ~less
    for k in reversed(range(max(len(counter), limit.bit_length()))):
        bit = counter[k] if k < len(counter) else np.zeros_like(less)
        if limit >> k & 1:
            less |= equal & ~bit
            equal &= bit
        else:
            equal &= ~bit
    return less | equal


def close_lanes(p: np.ndarray, at: np.ndarray, lanes: np.ndarray, d: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, i + d) given as bits ``lanes`` of the words ``at``, with a d for each
    word: those within ``radius``, as the words that keep any, their bits and their d."""
    counter: list[np.ndarray] = []
    for begin in range(0, len(p), _STEP):
        part = p[begin : begin + _STEP]
        level = list(part[:, at] ^ _shifted(part, at, d))
        weight = 0
        while level:  # carry-save: three words of one weight become one, and one of twice the weight
            above = []
            while len(level) >= 3:
                kept, carry = _csa(level.pop(), level.pop(), level.pop())
                level.append(kept)
                above.append(carry)
            for bit in level:
                while len(counter) < weight:
                    counter.append(np.zeros(len(at), dtype=np.uint64))
                _add_at(counter, bit, weight)
            level, weight = above, weight + 1
        lanes = lanes & _at_most(counter, radius)
        alive = lanes != 0
        if not alive.all():  # abandon
            at, lanes, d, counter = at[alive], lanes[alive], d[alive], [c[alive] for c in counter]
            if not len(at):
                break
    return at, lanes, d


def _add_at(counter: list[np.ndarray], bit: np.ndarray, weight: int) -> None:
    if weight == len(counter):
        counter.append(bit.copy())
    else:
        _add(counter, bit, weight)


def pairs_in_runs(keys: np.ndarray, s0: np.ndarray, s1: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of equal key with sketches within ``radius``; keys sorted."""
    n = len(keys)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = planes(s0, s1)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.searchsorted(keys, keys, side="right")
    left = ends - 1 - np.arange(n)  # how many of the own key follow
    active = np.flatnonzero(left > 0)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, d = 0, 1
    while len(active) or waiting:
        if len(active):
            word = active >> 6
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lanes = np.bitwise_or.reduceat(np.uint64(1) << (active & 63).astype(np.uint64), first)
            waiting.append((word[first], lanes, np.full(len(first), d)))
            size += len(first)
            d += 1
            active = active[left[active] >= d]
        if size >= _WORDS or not len(active):  # few words of many distances are compared together
            at, lanes, by = close_lanes(p, *(np.concatenate(x) for x in zip(*waiting, strict=True)), radius)
            waiting, size = [], 0
            if len(at):
                bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k, bit = np.nonzero(bits)
                found_i.append(at[k] * 64 + bit)
                found_j.append(found_i[-1] + by[k])
    return np.concatenate(found_i), np.concatenate(found_j)


def _compare(radius: int):
    """Over rows sorted by (bucket, part_i, part_j): the close pairs of each group."""
    key = ("bucket", "part_i", "part_j")

    def groups(rows: pa.Table) -> pa.RecordBatch | None:
        bucket, i_part, j_part, part, rep, s0, s1, n_words = (rows.column(n).to_numpy() for n in (*key, "part", "rep", "s0", "s1", "n_words"))
        change = np.ones(len(bucket), dtype=bool)
        change[1:] = (bucket[1:] != bucket[:-1]) | (i_part[1:] != i_part[:-1]) | (j_part[1:] != j_part[:-1])
        i, j = pairs_in_runs(np.cumsum(change), s0, s1, radius)
        ok = (rep[i] != rep[j]) & ((i_part[i] == j_part[i]) | (part[i] != part[j]))
        ok &= (n_words[i] >= SAME_WORDS * n_words[j]) & (n_words[j] >= SAME_WORDS * n_words[i])
        a, b = np.minimum(rep[i], rep[j])[ok], np.maximum(rep[i], rep[j])[ok]
        if not len(a):
            return None
        seen = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < TAKEN:
                continue
            rows = pa.Table.from_batches(held)
            last = np.ones(size, dtype=bool)  # the last group may go on; it is a block pair at most
            for name in key:
                column = rows.column(name).to_numpy()
                last &= column == column[-1]
            cut = size - int(last.sum())
            if cut:
                if (out := groups(rows.slice(0, cut))) is not None:
                    yield out
                held, size = rows.slice(cut).combine_chunks().to_batches(), size - cut
        if size and (out := groups(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def length_class(n_words: Column) -> Column:
    """Texts of which one has at least four fifths of the words of the other are of one class or of neighbouring ones."""
    return F.floor(F.log(n_words.cast("double")) / F.log(F.lit(1 / SAME_WORDS + 1e-9))).cast("long")


def candidate_pairs(reps: DataFrame, radius: int = RADIUS, block: int = BLOCK, bands: int = BANDS) -> DataFrame:
    """Distinct (a, b), a < b, of representatives that share a band key, lie within
    ``radius`` of each other and are of comparable length. ``reps`` has rep, bands, s0, s1
    and n_words and should be a stored table: it is read more than once.

    Buckets of more than ``block`` rows are parted by classes of length, and these by hash;
    a part is compared with the parts of its own class and the neighbouring ones, every two
    parts in one group, and a task holds a group at a time."""
    rows = reps.select(F.explode(F.slice("bands", 1, bands)).alias("bucket"), "rep", "s0", "s1", "n_words")
    hot = rows.groupBy("bucket").count().where(F.col("count") > block).select("bucket")
    if hot.isEmpty():
        whole = [F.lit(0).cast("long").alias(c) for c in ("part_i", "part_j", "part")]
        cut = rows.select("*", *whole).repartition("bucket")
    else:
        rows = rows.withColumn("class", length_class(F.col("n_words")))
        sizes = rows.join(hot, "bucket", "left_semi").groupBy("bucket", "class").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
        near = sizes.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("parts"))  # a class is a quarter longer than the last: some dozens
        split = rows.join(near, "bucket", "left")
        n = lambda by: F.coalesce(F.try_element_at("parts", F.col("class") + by), F.lit(0))
        code = lambda by, k: (F.col("class") + by) * 2**20 + k
        split = split.withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(code(0, F.pmod(F.xxhash64("rep"), F.greatest(n(0), F.lit(1))))))
        upto = lambda by: F.transform(F.filter(F.sequence(F.lit(0), n(by)), lambda k: k > 0), lambda k: code(by, k - 1))
        others = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.concat(upto(-1), upto(0), upto(1)))
        split = split.withColumn("other", F.explode(others))
        cut = split.select(
            "bucket", "rep", "s0", "s1", "n_words",
            F.least("part", "other").alias("part_i"), F.greatest("part", "other").alias("part_j"), "part",
        ).repartition("bucket", "part_i", "part_j")
    cut = cut.sortWithinPartitions("bucket", "part_i", "part_j")
    return cut.mapInArrow(_compare(radius), "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership (id, grp, rep) and the pairs (a, b) of representatives that are the same
    up to small edits.

    ``df`` has id (unique long), grp (any), kind (boolean; null counts as false) and text.
    rep is the smallest id with the same normal form and kind; pairs relate different
    representatives of one kind, a < b, so that no link between different texts is lost and
    copies are not multiplied. Texts without a word (null, empty, punctuation) come out in
    neither. Very long texts are compared whole. Extra columns are ignored.
    """
    stage = stage or Stage(df.sparkSession, "bitslice")
    rows = df.select("id", "grp", F.coalesce("kind", F.lit(False)).alias("kind"), "text")
    features = stage.write(describe(rows, "id", "grp"), "features")
    reps = stage.write(classes(features, "id", F.first(F.octet_length("words") / 4).cast("int").alias("n_words")), "reps")
    candidates = candidate_pairs(reps)
    pairs = stage.write(verified(candidates, features, "id"), "pairs")
    members = features.select("id", "grp", "kind", "key_a", "key_b").join(
        reps.select("kind", "key_a", "key_b", "rep", "copies"), ["kind", "key_a", "key_b"]
    )
    return members.select("id", "grp", "rep", "copies"), pairs


def pairs_between_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows of different grp that are copies of one
    text or of two related texts."""
    linked = pairs.select(F.explode(F.array(F.array("a", "b"), F.array("b", "a"))).alias("p")).select(F.col("p")[0].alias("rep"), F.col("p")[1].alias("to"))
    own = members.where("copies > 1").select("rep", F.col("rep").alias("to"))
    left = members.select(F.col("id").alias("id_a"), F.col("grp").alias("_ga"), "rep")
    right = members.select(F.col("id").alias("id_b"), F.col("grp").alias("_gb"), F.col("rep").alias("to"))
    out = linked.unionByName(own.distinct()).join(left, "rep").join(right, "to")
    return out.where((F.col("id_a") < F.col("id_b")) & ~F.col("_ga").eqNullSafe(F.col("_gb"))).select("id_a", "id_b")
