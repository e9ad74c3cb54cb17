"""Full text: an inverted index as tables, boolean and phrase matching, weighted BM25.

The index is two tables: postings (term, card_id, col, positions), stored in ranges of
terms so that a query reads the row groups of its own terms only, and the length of every
card in tokens. Ranking touches postings alone; texts are joined to the page that is shown.
"""

from __future__ import annotations

import html
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.stem import Analyzer
from ..plans.grammar import Term
from ..plans.staging import Folder, Stage

#: Columns and their weight in the score; constants of BM25.
WEIGHTS = {"tag": 5.0, "cite": 3.0, "block": 2.0, "body": 1.0}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
_POSTINGS = "card_id bigint, col string, term string, positions array<int>"


def _post(stem: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyze = Analyzer(stem)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                out: dict[str, list] = {"card_id": [], "col": [], "term": [], "positions": []}
                for row in part.to_pylist():
                    for col in WEIGHTS:
                        places: dict[str, list[int]] = {}
                        for k, token in enumerate(analyze(row[col])):
                            places.setdefault(token, []).append(k)
                        for token, at in places.items():
                            for key, value in zip(out, (row["card_id"], col, token, at), strict=True):
                                out[key].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("card_id", pa.int64()), ("col", pa.string()), ("term", pa.string()), ("positions", pa.list_(pa.int32()))]))

    return run


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


@dataclass
class TextIndex:
    """Postings and lengths with what ranking needs of the whole: rows and mean length."""

    postings: DataFrame
    lengths: DataFrame
    rows: int
    mean_length: float
    stem: bool = True

    @classmethod
    def build(cls, rows: DataFrame, stage: Stage | Folder, stem: bool = True, name: str = "index") -> TextIndex:
        """Index (card_id, tag, cite, block, body) under ``name``; null columns count as empty."""
        spark = rows.sparkSession
        rows.select("card_id", *WEIGHTS).mapInArrow(_post(stem), _POSTINGS).repartitionByRange("term", "card_id").sortWithinPartitions("term", "card_id").write.parquet(stage.path(f"{name}/postings"))
        postings = spark.read.schema(_POSTINGS).parquet(stage.path(f"{name}/postings"))
        lengths = postings.groupBy("card_id").agg(F.sum(F.size("positions")).alias("length"))
        lengths = rows.select("card_id").join(lengths, "card_id", "left").select("card_id", F.coalesce("length", F.lit(0)).alias("length"))
        lengths.write.parquet(stage.path(f"{name}/lengths"))
        lengths = spark.read.schema("card_id bigint, length bigint").parquet(stage.path(f"{name}/lengths"))
        n, total = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return cls(postings, lengths, n, total / n if n else 0.0, stem)

    @classmethod
    def update(cls, rows: DataFrame, path: str, stem: bool = True) -> TextIndex:
        """Put rows into the index at ``path``, a folder that lasts; a card that is there
        already is replaced. Costs the new rows, and the ids and lengths of the others."""
        spark = rows.sparkSession
        folder = Folder(spark, path)
        manifest = {"segments": [], "lengths": None, "stem": stem, **folder.load()}
        if manifest["stem"] != stem:
            raise ValueError("the index was built with the other analyzer")
        name = f"segment-{uuid.uuid4().hex}"
        part = cls.build(rows, folder, stem, name)
        lengths = part.lengths.withColumn("segment", F.lit(name))
        if manifest["lengths"]:
            held = spark.read.parquet(folder.path(manifest["lengths"]))
            lengths = held.join(lengths.select("card_id"), "card_id", "left_anti").unionByName(lengths)
        fresh = f"lengths-{uuid.uuid4().hex}"
        lengths.write.parquet(folder.path(fresh))
        old = manifest["lengths"]
        folder.switch({"segments": [*manifest["segments"], name], "lengths": fresh, "stem": stem})
        if old:
            folder.drop(old)
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        """The index as it was left by ``update``. A posting counts if its segment is the one
        that its card was put in last."""
        folder = Folder(spark, path)
        manifest = folder.load()
        lengths = spark.read.parquet(folder.path(manifest["lengths"]))
        postings = None
        for name in manifest["segments"]:
            part = spark.read.schema(_POSTINGS).parquet(folder.path(f"{name}/postings"))
            if len(manifest["segments"]) > 1:
                part = part.join(lengths.where(F.col("segment") == name).select("card_id"), "card_id", "left_semi")
            postings = part if postings is None else postings.unionByName(part)
        n, total = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return cls(postings, lengths.drop("segment"), n, total / n if n else 0.0, manifest["stem"])

    @classmethod
    def merge(cls, spark: SparkSession, path: str) -> TextIndex:
        """Fold all segments into one, sorted by term."""
        folder, index = Folder(spark, path), cls.load(spark, path)
        manifest, name, fresh = folder.load(), f"segment-{uuid.uuid4().hex}", f"lengths-{uuid.uuid4().hex}"
        index.postings.repartitionByRange("term", "card_id").sortWithinPartitions("term", "card_id").write.parquet(folder.path(f"{name}/postings"))
        index.lengths.withColumn("segment", F.lit(name)).write.parquet(folder.path(fresh))
        folder.switch({**manifest, "segments": [name], "lengths": fresh})
        for old in (*manifest["segments"], manifest["lengths"]):
            folder.drop(old)
        return cls.load(spark, path)

    def cached(self) -> TextIndex:
        """The same index held in memory (and on disk beyond it) for repeated searches."""
        self.postings, self.lengths = self.postings.persist(), self.lengths.persist()
        return self

    def phrases(self, terms: Sequence[Term]) -> list[tuple[list[str], str | None]]:
        analyze = Analyzer(self.stem)
        return [(analyze(t.text), t.column) for t in terms]

    def hits(self, phrases: Sequence[tuple[list[str], str | None]]) -> DataFrame:
        """(card_id, f0, f1, ...): per phrase the weighted number of its occurrences. One
        exchange, on card_id, of the postings of the query's terms."""
        wanted = sorted({t for tokens, _ in phrases for t in tokens})
        own = self.postings.where(F.col("term").isin(*wanted)) if wanted else self.postings.where(F.lit(False))
        cells: dict[tuple[str, str], str] = {}
        for tokens, only in phrases:
            for t in tokens:
                for col in [only] if only else WEIGHTS:
                    cells.setdefault((t, col), f"c{len(cells)}")
        picked = [F.first(F.when((F.col("term") == t) & (F.col("col") == c), F.col("positions")), ignorenulls=True).alias(n) for (t, c), n in cells.items()]
        placed = own.groupBy("card_id").agg(*picked) if picked else own.select("card_id").distinct()
        none = F.array().cast("array<int>")

        def count(tokens: list[str], col: str) -> Column:
            at = [F.coalesce(F.col(cells[t, col]), none) for t in tokens]
            if len(at) == 1:
                return F.size(at[0])
            starts = at[0]
            for k, more in enumerate(at[1:], 1):
                starts = F.array_intersect(starts, _moved(more, k))
            return F.size(starts)

        out = []
        for k, (tokens, only) in enumerate(phrases):
            total = F.lit(0.0)
            for col in ([only] if only else WEIGHTS) if tokens else []:
                total = total + count(tokens, col) * F.lit(WEIGHTS[col])
            out.append(total.alias(f"f{k}"))
        return placed.select("card_id", *out)

    def match(self, positives: Sequence[Term], negatives: Sequence[Term] = ()) -> DataFrame:
        """(card_id, score) of the cards with all positives and no negative; the smaller the
        score the better. A positive without a token matches nothing."""
        phrases = self.phrases(positives)
        against = [p for p in self.phrases(negatives) if p[0]]
        hits = self.hits([*phrases, *against])
        n = len(phrases)
        if not n:
            return hits.select("card_id", F.lit(0.0).alias("score")).where(F.lit(False))
        # how many rows each phrase is in: one row, joined to the hits within the same plan
        having = hits.agg(*(F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(n)))
        score = F.lit(0.0)
        for k in range(n):
            rows, in_ = F.lit(float(self.rows)), F.col(f"n{k}")
            idf = F.when(in_ * 2 < rows, F.ln((rows - in_ + 0.5) / (in_ + 0.5))).otherwise(F.lit(LEAST_IDF))
            tf = F.col(f"f{k}")
            norm = K1 * (1 - B) + K1 * B * F.col("length") / (self.mean_length or 1.0)
            score = score + idf * tf * (K1 + 1) / (tf + norm)
        length = self.lengths
        test = F.lit(True)
        for k in range(n):
            test = test & (F.col(f"f{k}") > 0)
        for k in range(n, n + len(against)):
            test = test & (F.col(f"f{k}") == 0)
        found = hits.where(test).join(length, "card_id").crossJoin(F.broadcast(having))
        return found.select("card_id", (-score).alias("score"))

    def any_of(self, terms: Sequence[Term]) -> DataFrame:
        """Cards with at least one of the terms."""
        phrases = [p for p in self.phrases(terms) if p[0]]
        hits = self.hits(phrases)
        test = F.lit(False)
        for k in range(len(phrases)):
            test = test | (F.col(f"f{k}") > 0)
        return hits.where(test).select("card_id")


OPEN, CLOSE = "\x02", "\x03"


def snippet_of(text: str | None, phrases: Sequence[Sequence[str]], analyze: Analyzer, width: int = 24) -> str:
    """The window of ``width`` tokens with the most hits, hits in bold, everything escaped."""
    text = text or ""
    spans = analyze.spans(text)
    hit = [False] * len(spans)
    tokens = [t for _, _, t in spans]
    for phrase in phrases:
        n = len(phrase)
        for k in range(len(tokens) - n + 1 if n else 0):
            if tokens[k : k + n] == list(phrase):
                hit[k : k + n] = [True] * n
    sums = [0]
    for h in hit:
        sums.append(sums[-1] + h)
    starts = range(max(1, len(spans) - width + 1))
    best = max(starts, key=lambda k: (sums[min(k + width, len(spans))] - sums[k], -k))
    chosen = spans[best : best + width]
    if not chosen:
        return html.escape(text)
    out, at = [], chosen[0][0] if best else 0
    for (begin, end, _), marked in zip(chosen, hit[best : best + width], strict=False):
        out.append(html.escape(text[at:begin]))
        word = html.escape(text[begin:end])
        out.append(f"<b>{word}</b>" if marked else word)
        at = end
    more = best + width < len(spans)
    return ("…" if best else "") + "".join(out) + ("…" if more else html.escape(text[at:]))


def snippet(text: Column, phrases: Sequence[Sequence[str]], stem: bool = True, width: int = 24) -> Column:
    """``snippet_of`` as a column; to be used on the rows of a page, after the limit."""
    wanted = [list(p) for p in phrases if p]

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        analyze = Analyzer(stem)
        return texts.map(lambda t: snippet_of(t, wanted, analyze, width))

    return run(text)


def prefix_snippet_of(markup: str | None, words: Sequence[str], before: int = 8, after: int = 34) -> str:
    """Plain window around the first word that begins with one of ``words``; hits in bold."""
    from ..functions.markup import visible

    tokens = visible(markup or "").split()
    stems = [w.lower() for w in words if w]
    starts = [any(t.lower().lstrip("\"'“‘([").startswith(s) for s in stems) for t in tokens]
    first = starts.index(True) if True in starts else 0
    low = max(0, first - before)
    window = tokens[low : first + after]
    shown = [f"<b>{html.escape(t)}</b>" if starts[low + k] else html.escape(t) for k, t in enumerate(window)]
    return ("…" if low else "") + " ".join(shown) + ("…" if first + after < len(tokens) else "")
