"""One pass over texts: what the near-duplicate operators know of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T

#: Runs of three words; three minimum hashes to a band. Two texts that differ in one word
#: of seven still meet in one of 24 bands with probability 0.99, unrelated ones in about
#: one pair of ten thousand. (Runs of five words at 0.8, the usual choice, would lose true
#: pairs of short texts here: of thirty words with three edits 0.55 of such runs remain.)
RUN, ROWS, BANDS, HASHES = 3, 3, 24, 128
SCHEMA = "kind boolean, key_a bigint, key_b bigint, bands array<bigint>, s0 bigint, s1 bigint, words binary"
_TYPES = [
    ("kind", pa.bool_()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("bands", pa.list_(pa.int64())),
    ("s0", pa.int64()), ("s1", pa.int64()), ("words", pa.binary()),
]


def _describe(batch: pa.RecordBatch, hasher: T.WordHasher, once: list[str] | None, seen: set) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != "text"]
    texts = batch.column("text").to_pylist()
    hashed = [hasher(w) if (w := T.words(t)) else None for t in texts]
    keep = [k for k, h in enumerate(hashed) if h is not None]
    hashed = [hashed[k] for k in keep]
    kinds = batch.column("kind").take(pa.array(keep, pa.int64()))
    digests = [xxhash.xxh3_128_intdigest(h.tobytes()) for h in hashed]
    keys = np.array([[d & (2**64 - 1), d >> 64] for d in digests], dtype=np.uint64).reshape(-1, 2).view(np.int64)
    rest = [batch.column(n).take(pa.array(keep, pa.int64())) for n in names if n != "kind"]
    fresh = list(range(len(keep)))
    if once is not None:
        scope = [batch.column(n).take(pa.array(keep, pa.int64())).to_pylist() for n in ("kind", *once)]
        fresh = []
        for k, place in enumerate(zip(digests, *scope, strict=True)):
            if place not in seen:
                seen.add(place)
                fresh.append(k)
        if len(seen) > 1 << 20:
            seen.clear()
    runs = [T.shingles(hashed[k], RUN) for k in fresh]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])[:-1]]).astype(np.int64) if runs else np.zeros(0, np.int64)
    mins = T.minhashes(np.concatenate(runs) if runs else np.zeros(0, np.uint64), starts, HASHES)
    bands = T.band_keys(mins[: ROWS * BANDS], ROWS)
    salt = np.where(np.array(kinds.take(pa.array(fresh, pa.int64())).to_pylist(), dtype=bool), np.int64(0x51A7_0001), np.int64(0))
    bands ^= salt[None, :]  # analytics and evidence never meet
    sketch = T.sketch_bits(mins).view(np.int64) if fresh else np.zeros((0, 2), np.int64)
    flat = pa.array(np.ascontiguousarray(bands.T).ravel(), pa.int64())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fresh) + 1) * BANDS, pa.int32()), flat)
    words = pa.array([hashed[k].astype(np.uint32).tobytes() for k in fresh], pa.binary())
    own = [lists, pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), words]
    if len(fresh) < len(keep):  # the others carry their key only
        at = np.full(len(keep), -1, np.int64)
        at[fresh] = np.arange(len(fresh))
        own = [c.take(pa.array(at, mask=at < 0)) for c in own]
    return pa.RecordBatch.from_arrays([*rest, kinds, pa.array(keys[:, 0]), pa.array(keys[:, 1]), *own], names=[n for n in names if n != "kind"] + [n for n, _ in _TYPES])


def describe(df: DataFrame, *carried: str, once: list[str] | None = None) -> DataFrame:
    """``carried`` columns, kind, an exact 128-bit key of the normal form, band keys, a
    128-bit sketch (one bit of each minimum hash) and the hashed words of each row's
    ``text``. Rows without a word in their text are left out; ``kind`` must not be null.

    With ``once`` (columns, maybe none), of the rows of a partition that agree in these, in
    kind and in normal form the first carries what is known of the text and the others, as
    far as a million distinct ones can tell, their key only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = T.WordHasher(), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                yield _describe(batch.slice(start, 2048), hasher, once, seen)

    df = df.select(*carried, "kind", "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in carried)
    return df.mapInArrow(run, f"{fields}, {SCHEMA}")


def classes(features: DataFrame, id_col: str, *more: Column) -> DataFrame:
    """One row per distinct normal form: rep (its smallest id), its number of copies, band
    keys and sketch. Copies collapse before the shuffle."""
    return features.groupBy("kind", "key_a", "key_b").agg(
        F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.first("bands").alias("bands"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), *more,
    )


def verified(pairs: DataFrame, features: DataFrame, id_col: str) -> DataFrame:
    """The candidate pairs (a, b) of representatives that are the same up to small edits."""
    words = features.select(F.col(id_col).alias("_id"), "words")
    left = pairs.join(words.withColumnRenamed("words", "wa"), pairs.a == F.col("_id")).drop("_id")
    both = left.join(words.withColumnRenamed("words", "wb"), left.b == F.col("_id")).drop("_id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, wb = (batch.column(n).to_pylist() for n in ("wa", "wb"))
            keep = [T.same_up_to_edits(np.frombuffer(x, np.uint32).astype(np.uint64), np.frombuffer(y, np.uint32).astype(np.uint64)) for x, y in zip(wa, wb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a bigint, b bigint")
