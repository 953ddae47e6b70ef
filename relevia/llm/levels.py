"""Reading level of documents by propagation over the document-word graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.sources import materialize, most_frequent

def running_prose(text: Column) -> Column:
    """The text without the rows of tables: lines of two bars or more, or with a cell of figures only."""
    rows = r"(?m)^[^\n|]*(?:\|[^\n|]*){2,}$|^[^\n]*\|[ \t]*[-+\d.,% ]+(?:\|[^\n]*)?$|^(?:[^\n\t]*\t){2,}[^\n]*$"
    return F.when(text.rlike(r"[|\t]"), F.regexp_replace(text, rows, "")).otherwise(text)


def sentences(prose: Column) -> Column:
    """How many sentences: stretches up to an end mark or line end with two words of two letters or more."""
    parts = F.split(prose, r"(?<=[.!?…])\s+|\n")
    return F.size(F.filter(parts, lambda s: s.rlike(r"\p{L}{2}[^\p{L}]+(?:\p{L}[^\p{L}]+)*\p{L}{2}")))


def words_of(prose: Column) -> Column:
    return F.regexp_extract_all(F.lower(prose), F.lit(r"\p{L}+(?:-\p{L}+)*"), 0)


def _number(batches: Iterator[pa.RecordBatch], common: pa.Array) -> Iterator[pa.RecordBatch]:
    """Lists of words to numbers of the common words, the other words as they are, and whether most words are Cyrillic."""
    for batch in batches:
        lists = batch.column("words")
        flat = lists.flatten()
        at = pc.index_in(flat, common)
        known = np.asarray(at.is_valid())
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])

        def cut(ok: np.ndarray, bounds: np.ndarray = bounds) -> pa.Array:
            return pa.array(np.concatenate([[0], np.cumsum(ok)])[bounds].astype(np.int32))

        nodes = pa.ListArray.from_arrays(cut(known), at.drop_null().cast(pa.int32()))
        rest = pa.ListArray.from_arrays(cut(~known), flat.filter(pa.array(~known)))
        cyr = np.diff(np.concatenate([[0], np.cumsum(np.asarray(pc.greater_equal(flat, "Ѐ")))])[bounds]) * 2 > np.diff(bounds)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), batch.column("level"), pa.array(cyr), nodes, rest], names=["row", "key", "level", "cyr", "nodes", "rest"])


def _scores(batch: pa.RecordBatch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: the document of each edge to a common word, its word, and every document's mean word score."""
    lists = batch.column("nodes")
    n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    node = np.asarray(lists.flatten())
    doc = np.repeat(np.arange(len(n)), n)
    value = words[node]
    known = np.isfinite(value)
    num = np.bincount(doc[known], value[known], len(n)) + batch.column("num").to_numpy()
    den = np.bincount(doc[known], minlength=len(n)) + batch.column("den").to_numpy()
    return doc, node, num / np.where(den > 0, den, np.nan)


def _spread(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's share of the common words' new scores; graded texts are clamped to their level."""
    num, den = np.zeros(len(words)), np.zeros(len(words))
    for batch in batches:
        doc, node, mean = _scores(batch, words)
        level = batch.column("level").to_numpy(zero_copy_only=False).astype(float)
        score = np.where(np.isfinite(level), level, mean)[doc]
        ok = np.isfinite(score)
        share = 1.0 / batch.column("size").to_numpy()[doc[ok]]
        num += np.bincount(node[ok], score[ok] * share, len(words))
        den += np.bincount(node[ok], share, len(words))
    at = np.flatnonzero(den)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(num[at]), pa.array(den[at])], names=["node", "num", "den"])


def _read(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every text's unclamped score."""
    for batch in batches:
        mean = _scores(batch, words)[2]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "key", "level", "cyr", "size")], pa.array(mean)], names=["row", "key", "level", "cyr", "size", "score"])


class _Graph:
    """Texts and the words of two texts or more: common words by number, the rest as rows (row, word)."""

    def __init__(self, texts: DataFrame, shared_words: int) -> None:
        seen = materialize(texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        common = most_frequent(seen, "n", shared_words).select("word").toArrow().column("word").combine_chunks()
        self.size, self.spark = len(common), texts.sparkSession
        shared = self.spark.sparkContext.broadcast(common)
        rows = texts.mapInArrow(lambda b: _number(b, shared.value), "row bigint, key string, level int, cyr boolean, nodes array<int>, rest array<string>")
        self.rare = None
        if seen.count() > self.size:
            rows = materialize(rows)
            listed = rows.select("row", "level", F.explode("rest").alias("word")).groupBy("row", "level", "word").agg(F.count(F.lit(1)).alias("n"))
            self.rare = materialize(listed.join(seen.select("word"), "word", "left_semi"))
            more = self.rare.groupBy("row").agg(F.sum("n").alias("more"))
            rows = rows.drop("rest").join(more, "row", "left").withColumn("size", F.size("nodes") + F.coalesce("more", F.lit(0)).cast("int")).drop("more")
        else:
            rows = rows.drop("rest").withColumn("size", F.size("nodes"))
        self.texts = materialize(rows.where("size > 0"))

    def sums(self, rare_scores: DataFrame | None) -> DataFrame:
        """The texts with the sum and number of the scores of their rare words."""
        if rare_scores is None:
            return self.texts.withColumn("num", F.lit(0.0)).withColumn("den", F.lit(0.0))
        part = self.rare.join(rare_scores, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("score")).alias("num"), F.sum("n").cast("double").alias("den"))
        return self.texts.join(part, "row", "left").na.fill(0.0, ["num", "den"])

    def spread(self, texts: DataFrame, words: np.ndarray) -> tuple[np.ndarray, DataFrame | None]:
        """The mean score of the texts of every word, weighted by its share of them: common words, and rare ones as (word, score)."""
        shared = self.spark.sparkContext.broadcast(words)
        part = texts.mapInArrow(lambda b: _spread(b, shared.value), "node int, num double, den double")
        sums = part.groupBy("node").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).toArrow()
        new = np.full(self.size, np.nan)
        new[sums.column("node").to_numpy()] = sums.column("num").to_numpy() / sums.column("den").to_numpy()
        if self.rare is None:
            return new, None
        said = self.read(texts, words).select("row", F.coalesce(F.col("level").cast("double"), "score").alias("s"), "size").where("not isnan(s)")
        share = F.col("n") / F.col("size")
        rare = self.rare.drop("level").join(said, "row").groupBy("word").agg((F.sum(share * F.col("s")) / F.sum(share)).alias("score"))
        return new, rare

    def read(self, texts: DataFrame, words: np.ndarray) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(words)
        return texts.mapInArrow(lambda b: _read(b, shared.value), "row bigint, key string, level int, cyr boolean, size int, score double")


def reading_levels(
    texts: DataFrame, key: str, text: str, graded: DataFrame, graded_text: str, graded_level: str,
    least: int = 6, rounds: int = 24, settled: float = 1e-3, anchor: float = 0.5, shared_words: int = 1 << 18,
) -> DataFrame:
    """(key, score, level) of every text with at least ``least`` sentences of running prose.

    Texts and their words form a bipartite graph; a text's score is the mean of its words' scores. Graded texts stay
    clamped to their level. A word's score is the mean of its texts' scores, weighted by its share of them, where graded
    texts together have the weight ``anchor`` and all others together the rest, so that the scale stays the same however
    many texts are not graded. Rounds go on until no common word moves by more than ``settled``, ``rounds`` at most.
    Words of a single text follow it and change nothing, so they are left out. The most frequent words, ``shared_words`` at most, go
    to every task (2 MB of scores at the default); rarer ones, whose texts are few, meet their texts by join with the
    same result.

    The level is the most probable one given the scores that graded texts of the script reach unclamped (normal curves,
    their width at least 3 % of the mean distance of two levels); ties go to the lower level. Null, empty and tiny texts
    and pure tables have no row, nor have texts none of whose words is reached; keys may repeat, each row is read for
    itself, rows with a null key are left out; without graded texts the result is empty."""
    kind = texts.schema[key].dataType
    docs = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.lit(None).cast("int").alias("level"), running_prose(F.col(text)).alias("t"))
    docs = docs.where((F.length("t") > 0) & (sentences(F.col("t")) >= least))
    known = graded.where(F.col(graded_level).isNotNull()).select(F.lit(None).cast("string").alias("key"), F.col(graded_level).cast("int").alias("level"), running_prose(F.col(graded_text)).alias("t"))
    g = _Graph(materialize(docs.unionByName(known).select(F.monotonically_increasing_id().alias("row"), "key", "level", words_of(F.col("t")).alias("words"))), shared_words)

    fixed, fixed_rare = g.spread(g.sums(None).where("level is not null"), np.full(g.size, np.nan))
    if fixed_rare is not None:
        fixed_rare = materialize(fixed_rare.withColumnRenamed("score", "fixed"))
    words, rare = fixed, None if fixed_rare is None else fixed_rare.select("word", F.col("fixed").alias("score"))
    for _ in range(rounds):
        new, new_rare = g.spread(g.sums(rare).where("level is null"), words)
        new = np.where(np.isnan(fixed), new, np.where(np.isnan(new), fixed, anchor * fixed + (1 - anchor) * new))
        if new_rare is not None:
            mixed = F.coalesce(anchor * F.col("fixed") + (1 - anchor) * F.col("score"), "fixed", "score")
            rare = materialize(new_rare.join(fixed_rare, "word", "full").select("word", mixed.alias("score")))
        reached = bool((np.isnan(words) == np.isnan(new)).all())
        moved = np.nanmax(np.abs(new - words), initial=0.0)
        words = new
        if reached and moved <= settled:
            break

    scored = g.read(g.sums(rare), words).where("not isnan(score)")
    stats = scored.where("level is not null").groupBy("cyr", "level").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("d")).collect()
    if not stats:
        return scored.where("false").select(F.col("key").cast(kind).alias(key), "score", F.col("level").alias("level"))
    chosen = F.lit(None).cast("int")
    for cyr in (False, True):
        own = [r for r in stats if r.cyr == cyr] or stats
        step = (max(r.m for r in own) - min(r.m for r in own)) / max(1, len(own) - 1)
        width = {r.level: r.d + 0.03 * step + 1e-9 for r in own}
        odds = [(-F.pow((F.col("score") - r.m) / width[r.level], 2) / 2 - float(np.log(width[r.level])), r.level) for r in own]
        best = F.greatest(*[o for o, _ in odds]) if len(odds) > 1 else odds[0][0]
        chosen = F.when(F.col("cyr") == cyr, F.coalesce(*[F.when(o == best, F.lit(k)) for o, k in sorted(odds, key=lambda x: x[1])])).otherwise(chosen)
    return scored.where("level is null").select(F.col("key").cast(kind).alias(key), "score", chosen.cast("int").alias("level"))
