"""Reading level by propagation over the document-word graph.

Passages of documents and words are the two sides of a weighted graph. Graded examples are
clamped to their level; everything else takes harmonic steps: a word's difficulty is the
mean of the passages it occurs in, a passage's the mean of its words, weighted by how much a
word tells. A document has the median of its passages, so that
a few easier or harder sentences do not move it. Words are hashed into a fixed number of slots, so the word side is a vector of
bounded size that is broadcast, while the document side, the one that grows, stays where it
is: an iteration is one pass with one small partial vector per partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import Stage
from .text import WordHasher

#: Slots for words; the vector of the word side has this many entries at any corpus size.
SLOTS = 1 << 18
ITERATIONS = 4
MIN_WORDS = 50
#: How many documents a clamped example counts for in the mean of a word.
CLAMP = 50.0
#: Text without sentence ends is cut into passages of WINDOW words where more than LONG come
#: together; headings and the like, of less than SHORT words, join the next passage.
WINDOW, LONG, SHORT = 24, 60, 5
_URL = re.compile(r"https?://\S+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_END = re.compile(r"(?<=[.!?…])[\s\"”)]+|[\r\n•]+")
_BREAK = np.array([-1], np.int32)


def _slots(text: str | None, hasher: WordHasher, slots: int) -> np.ndarray:
    """Slots of all words in order, -1 after each passage."""
    passages: list[list[str]] = []
    held: list[str] = []
    for part in _END.split(_URL.sub(" ", (text or "").casefold().replace("’", "'"))):
        held += _WORD.findall(part)
        if len(held) < SHORT:
            continue
        step = WINDOW if len(held) > LONG else LONG
        passages += [held[begin : begin + step] for begin in range(0, len(held), step)]
        held = []
    if held:
        passages = [*passages[:-1], passages[-1] + held] if passages else [held]
    out = [x for p in passages for x in ((hasher(p) % np.uint64(slots)).astype(np.int32), _BREAK)]
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _documents(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows = [_slots(t, hasher, slots).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "words"])

    return run


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some documents all slots, the passage number of each, and the document of each passage."""
    words = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    breaks = words < 0
    passage = np.cumsum(breaks) - breaks
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return words[~breaks], passage[~breaks], doc[breaks]


def _rows(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int32) for b in batch.column("words").to_pylist()]


def passage_scores(words: np.ndarray, passage: np.ndarray, n: int, level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted mean level of each passage's words; NaN where none is known."""
    known = weight[words]
    total = np.bincount(passage, weights=known, minlength=n)
    value = np.bincount(passage, weights=known * level[words], minlength=n)
    return np.divide(value, total, out=np.full(n, np.nan), where=total > 0)


def document_scores(rows: list[np.ndarray], level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted median score of each document's passages; NaN where none is known."""
    words, passage, doc = _flat(rows)
    score = passage_scores(words, passage, len(doc), level, weight)
    ok = ~np.isnan(score)
    share = (1 + np.bincount(passage, minlength=len(doc)) / 400)[ok]  # of two halves the longer one
    doc, score = doc[ok], score[ok]
    order = np.lexsort((score, doc))
    doc, score, share = doc[order], score[order], share[order]
    whole = np.bincount(doc, weights=share, minlength=len(rows))
    upto = np.cumsum(share) - (np.cumsum(whole) - whole)[doc]
    middle = np.flatnonzero(upto >= whole[doc] / 2 - 1e-9)
    out = np.full(len(rows), np.nan)
    docs, first = np.unique(doc[middle], return_index=True)
    out[docs] = score[middle[first]]
    return out


def _word_sums(state, slots: int):
    """Per partition: of every slot the sum and the count of the scores of the passages that
    hold it, each occurrence counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, weight = state.value
        total, count = np.zeros(slots), np.zeros(slots)
        for batch in batches:
            words, passage, doc = _flat(_rows(batch))
            score = passage_scores(words, passage, len(doc), level, weight)[passage]
            ok = ~np.isnan(score)
            total += np.bincount(words[ok], weights=score[ok], minlength=slots)
            count += np.bincount(words[ok], minlength=slots)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held]), pa.array(count[held])], names=["slot", "total", "n"])

    return run


class ReadingScale:
    """The clamped side: graded examples, and the scale that their own scores give."""

    def __init__(self, graded: list[tuple[int, str]], slots: int = SLOTS):
        hasher = WordHasher()
        self.slots = slots
        self.texts = [(lv, s) for lv, t in graded if lv is not None and len(s := _slots(t, hasher, slots))]
        if not self.texts:
            raise ValueError("no graded text has a word")
        self.rows = [s for _, s in self.texts]
        self.levels = np.array([lv for lv, _ in self.texts], dtype=float)
        words, passage, doc = _flat(self.rows)
        given = self.levels[doc[passage]]
        self.total = np.bincount(words, weights=given, minlength=slots) * CLAMP
        self.count = np.bincount(words, minlength=slots) * CLAMP
        self.square = np.bincount(words, weights=given**2, minlength=slots) * CLAMP

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        return self.update(np.zeros(self.slots), np.zeros(self.slots))

    def update(self, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(level, weight) of each slot. A word that the examples use at all levels alike
        tells little, one that they use at one level only the most; a word that no example
        holds gets its level from documents and a moderate weight."""
        n = self.count + count
        level = np.divide(self.total + total, n, out=np.zeros(self.slots), where=n > 0)
        mean = np.divide(self.total, self.count, out=np.zeros(self.slots), where=self.count > 0)
        spread = np.sqrt(np.maximum(np.divide(self.square, self.count, out=np.zeros(self.slots), where=self.count > 0) - mean**2, 0))
        weight = np.where(self.count > 0, 1 / (0.25 + spread) ** 2, 1.0) * (n > 0)
        return level, weight

    def cuts(self, level: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct levels and the scores that part them: half way between the mean scores
        of the examples of neighbouring levels, taken unclamped."""
        own = document_scores(self.rows, level, weight)
        names = np.unique(self.levels)
        means = np.array([own[self.levels == lv].mean() for lv in names])
        return names, (means[1:] + means[:-1]) / 2


def reading_levels(documents: DataFrame, refs: DataFrame, stage: Stage | None = None, iterations: int = ITERATIONS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, level, score) of each row of ``documents`` (doc_id, text).

    ``refs`` (level, text) are the graded examples, a bounded list. score is the continuous
    difficulty, level the nearest step of the examples' scale. Texts without a known word
    (null, empty, numbers) are left out; whole texts count; repeated rows come out as often
    as they came in; extra columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    stage = stage or Stage(spark, "reading")
    scale = ReadingScale([(r["level"], r["text"]) for r in refs.select("level", "text").collect()], slots)
    kind = documents.select("doc_id").schema[0].dataType.simpleString()
    docs = stage.write(documents.select("doc_id", "text").mapInArrow(_documents(slots), f"doc_id {kind}, words binary"), "documents")
    level, weight = scale.start()
    for _ in range(iterations):
        state = spark.sparkContext.broadcast((level, weight))
        partial = docs.select("words").mapInArrow(_word_sums(state, slots), "slot int, total double, n double")
        total, count = np.zeros(slots), np.zeros(slots)
        sums = partial.groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()  # at most ``slots`` rows
        total[sums["slot"]], count[sums["slot"]] = sums["total"], sums["n"]
        level, weight = scale.update(total, count)
        state.unpersist()
    names, cuts = scale.cuts(level, weight)
    state = spark.sparkContext.broadcast((level, weight))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, weight = state.value
        for batch in batches:
            score = document_scores(_rows(batch), level, weight)
            ok = ~np.isnan(score)
            found = names[np.searchsorted(cuts, score[ok])].astype(np.int32)
            ids = batch.column("doc_id").filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found), pa.array(score[ok])], names=["doc_id", "level", "score"])

    return docs.mapInArrow(grade, f"doc_id {kind}, level int, score double")


def english_of_length(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text) of the documents with lang exactly ``en`` and at least ``least`` parts
    between white space."""
    parts = F.size(F.split(F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), r"(?U)[\s\x1c-\x1f]+"))
    return documents.where((F.col("lang") == "en") & (parts >= least)).select("doc_id", "text")
