"""Units of text around chunks: neighbours, overlapping pages, stitched text, cards, splitting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.sources import materialize


def neighbours(chunks: DataFrame, reach: int = 1) -> DataFrame:
    """(cid, doc_id, around): the cids within ``reach`` numbers of a chunk in its document, itself included, in order.

    An equi-join on (document, shifted number), so no document is sorted in one task; repeated rows count once."""
    c = chunks.where("doc_id is not null and idx is not null").select("cid", "doc_id", "idx").distinct()
    shifted = c.select("cid", "doc_id", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.col("idx") + d)).alias("idx"))
    met = shifted.join(c.select(F.col("cid").alias("near"), "doc_id", "idx"), ["doc_id", "idx"])
    return met.groupBy("cid", "doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "near"))), lambda x: x["near"]).alias("around"))


def overlapping_pages(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(span, cid): chunks whose pages overlap a span (doc_id, span, page_start, page_end).

    Both sides are exploded to their pages and meet on (document, page), so a document of many pages is no nested loop."""
    pages = F.explode(F.sequence(F.col("page_start"), F.greatest("page_start", F.coalesce("page_end", "page_start"))))
    a = chunks.where("page_start is not null and doc_id is not null").select("cid", "doc_id", pages.alias("page"))
    b = spans.where("page_start is not null and doc_id is not null").select("span", "doc_id", pages.alias("page"))
    return b.join(a, ["doc_id", "page"]).select("span", "cid").distinct()


def stitched(chunks: DataFrame, by: list[str], run: int = 512) -> DataFrame:
    """(by, piece, text): chunk texts of a unit in the order of their places, overlaps cut once, others joined by line feeds.

    A chunk that lies wholly in what is already there adds nothing; chunks without a place come last, by number. A unit
    comes in pieces numbered from 0, whose texts put one after another are its text; up to ``run`` chunks are one piece.
    Only the ends and sizes of cells (stretches of places or numbers) are ordered over a whole unit; they tell what lies
    before a piece, so that no unit is collected whole. Grouping by structs keeps units with a null in ``by``."""
    late, low = F.col("char_start").isNull(), F.lit(-(2**62))
    place = F.coalesce(F.when(late, F.floor(F.col("idx") / run)).otherwise(F.floor(F.col("char_start") / 2**14)), low)
    number = F.coalesce(F.when(late & F.col("idx").isNull(), F.floor(F.col("cid") / run)), low)
    order = ["late", "char_start", "idx", "cid", "char_end"]
    rows = chunks.where("text is not null").select(F.struct(*by).alias("u"), F.struct(late.alias("late"), place.alias("place"), number.alias("number")).alias("cell"), late.alias("late"), *order[1:], "text")

    slim = rows.groupBy("u", "cell", *order).agg(F.max(F.length("text")).alias("long"))
    cells = slim.groupBy("u", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("char_end").alias("end"), F.max("long").alias("long"))
    earlier = Window.partitionBy("u").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("part", F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / run)).withColumns({"far": F.max("end").over(earlier), "seen": F.max("long").over(earlier)})
    whole = Window.partitionBy("u", "part").orderBy("cell")
    cells = cells.select("u", "cell", (F.dense_rank().over(Window.partitionBy("u").orderBy("part")) - 1).alias("piece"), F.first("far").over(whole).alias("far"), F.first("seen").over(whole).alias("seen"))

    r = rows.join(cells, ["u", "cell"]).select("u", "piece", "far", "seen", *order, "text").repartition("u", "piece").distinct()
    before = Window.partitionBy("u", "piece").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumns({"cut": F.greatest("far", F.max("char_end").over(before)) - F.col("char_start"), "some": F.greatest("seen", F.max(F.length("text")).over(before)) > 0})
    added = F.when(F.col("cut") >= 0, F.substring("text", F.col("cut") + 1, F.length("text"))).when(F.col("some"), F.concat(F.lit("\n"), "text")).otherwise(F.col("text"))
    texts = r.select("u", "piece", F.struct(*order, "text", added.alias("added")).alias("c")).groupBy("u", "piece").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    return texts.select(*[F.col("u")[c].alias(c) for c in by], "piece", F.array_join(F.transform("cs", lambda c: c["added"]), "").alias("text"))


def cards(manifest: DataFrame) -> DataFrame:
    """(doc_id, text): a card per document: its name, then the properties that the lines so far don't contain word by word."""
    m = manifest.where("doc_id is not null").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("title", "dataset", "format", "key")])
    stem = F.regexp_replace(F.regexp_replace("doc_id", "^.*/", ""), r"\.[^.]*$", "")
    text = F.concat(F.lit("Документ: "), stem)
    for label, column in (("Название", "title"), ("Раздел", "dataset"), ("Ключ", "key")):
        value = F.left(F.trim(column), F.lit(300))
        new = F.coalesce(value != "", F.lit(False)) & ~F.contains(T.padded(text), T.padded(value))
        text = F.when(new, F.concat(text, F.lit(f"\n{label}: "), value)).otherwise(text)
    return m.select("doc_id", text.alias("text"))


def parents(chunks: DataFrame) -> DataFrame:
    """(doc_id, unit, key, chunks): the larger units of the corpus and how many chunks they hold."""
    p = T.parent_of(F.col("kind"), F.col("table_id"), F.col("page_start"), F.col("section"))
    return chunks.where("doc_id is not null").select("doc_id", p.alias("p")).groupBy("doc_id", F.col("p.unit").alias("unit"), F.col("p.key").alias("key")).agg(F.count(F.lit(1)).alias("chunks"))


def _split(text: str, size: int, overlap: int, separators: tuple[str, ...], keep: bool, tail: float) -> list[tuple[int, str]]:
    """Pieces of at most ``size`` characters with their places, cut at the last place of the first separator that a stretch holds."""
    at, n, out = 0, len(text), []
    while at < n:
        end = after = min(at + size, n)
        if end < n:
            for s in separators:
                cut = text.rfind(s, at + size // 2, end)
                if cut > at:
                    end, after = (cut + len(s) if keep else cut), cut + len(s)
                    break
        out.append((at, text[at:end]))
        if after >= n:
            break
        at = max(after - overlap, at + 1)
    if len(out) > 1 and len(out[-1][1]) < tail * size:
        out[-2:] = [(out[-2][0], text[out[-2][0] :])]
    return out


def split_texts(
    texts: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " "), keep: bool = True, tail: float = 0.0
) -> DataFrame:
    """(key, idx, char_start, text): texts cut into overlapping pieces at paragraphs, lines, sentences or words.

    With ``keep`` a piece ends with its separator. A last piece of less than ``tail`` of ``size`` joins the one before it.
    Null and empty texts give no piece; a text without separators is cut at ``size``."""
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, s, p) for k, t in zip(f["key"], f["text"]) if t for i, (s, p) in enumerate(_split(t, size, overlap, separators, keep, tail))]
            yield pd.DataFrame(rows, columns=["key", "idx", "char_start", "text"]).astype({"idx": "int32", "char_start": "int32"})

    out = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, idx int, char_start int, text string")
    return out.withColumnRenamed("key", key)


def _pieces(word: str, vocabulary: set[str]) -> int:
    """How many pieces a word has by the longest pieces from the left; 1 for one that can't be made or has over 100 letters."""
    if len(word) > 100:
        return 1
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), at)
        if end == at:
            return 1
        n, at = n + 1, end
    return n


def piece_counts(texts: DataFrame, key: str, text: str, vocabulary: set[str], most: int = 2048) -> DataFrame:
    """(key, pieces): how many word pieces a text has with the two special ones, ``most`` at the most.

    Words end at blanks, every punctuation mark is a piece; control and format characters don't count. Only distinct words
    are cut; null texts have the two special pieces."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\t\n\r]", " "), r"[\x00\x{FFFD}\p{Cc}\p{Cf}]", "")
    parts = F.regexp_extract_all(clean, F.lit(r"[\p{P}$+<=>^`|~]|[^\s\p{Z}\p{P}$+<=>^`|~]+"), 0)
    rows = materialize(texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), parts.alias("w")))
    words = rows.select("row", F.explode("w").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    count = F.pandas_udf(lambda s: s.map(lambda w: _pieces(w, shared.value)).astype("int32"), "int")
    known = words.select("word").distinct().withColumn("pieces", count("word"))
    sums = words.join(known, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("pieces"))
    total = F.least(F.coalesce("pieces", F.lit(0)) + 2, F.lit(most)).cast("int")
    return rows.join(sums, "row", "left").select(F.col("key").alias(key), total.alias("pieces"))


def numbered(rows: DataFrame, order: list[str], name: str, prefix: str = "", width: int = 7) -> DataFrame:
    """``rows`` with consecutive names in an explicit total order, counted within ranges of it, nulls first.

    The ranges are a table, as sampling could set their bounds anew."""
    r = materialize(rows.repartitionByRange(*order).withColumn("__u", F.spark_partition_id()))
    off = r.groupBy("__u").count().withColumn("__o", F.coalesce(F.sum("count").over(Window.orderBy("__u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    n = F.row_number().over(Window.partitionBy("__u").orderBy(*order)) - 1 + F.col("__o")
    return r.join(F.broadcast(off.select("__u", "__o")), "__u").withColumn(name, F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))).drop("__u", "__o")


def best_windows(pairs: DataFrame, most: int = 8, digits: int = 9) -> DataFrame:
    """(ref, f1, first, last): the stretch of at most ``most`` lines whose bag of words is nearest a fact's; ``pairs`` has ref,
    fact and lines.

    Of equal stretches the first that begins earliest, then the shortest, counts; facts without words, or without a common
    word, have no row. Only words of the fact leave a line, so a line weighs as many rows as it shares with the fact."""
    rows = pairs.where("ref is not null").select("ref", T.tokens(F.col("fact")).alias("f"), F.transform("lines", T.tokens).alias("l")).where("size(f) > 0")
    lines = rows.select("ref", "f", F.posexplode("l").alias("i", "w")).select("ref", "i", F.size("w").alias("n"), F.filter("w", lambda x: F.array_contains("f", x)).alias("w"))
    windows = lines.select("ref", F.explode(F.sequence(F.greatest(F.col("i") - most + 1, F.lit(0)), F.col("i"))).alias("first"), "i", "n")
    reach = windows.groupBy("ref", "first").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("s")).select("ref", "first", F.posexplode("s").alias("k", "x"), "s")
    sizes = reach.select("ref", "first", F.col("x.i").alias("last"), F.aggregate(F.slice("s", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, b: a + b["n"]).alias("size")).where(F.col("last") >= F.col("first"))
    held = lines.select("ref", "i", F.explode("w").alias("word")).groupBy("ref", "i", "word").agg(F.count(F.lit(1)).alias("c"))
    spans = sizes.select("ref", "first", "last", F.explode(F.sequence("first", "last")).alias("i")).join(held, ["ref", "i"]).groupBy("ref", "first", "last", "word").agg(F.sum("c").alias("c"))
    wanted = rows.select("ref", F.explode("f").alias("word")).groupBy("ref", "word").agg(F.count(F.lit(1)).alias("want"))
    common = spans.join(wanted, ["ref", "word"]).groupBy("ref", "first", "last").agg(F.sum(F.least("c", "want")).alias("both"))
    total = wanted.groupBy("ref").agg(F.sum("want").alias("n"))
    scored = common.join(sizes, ["ref", "first", "last"]).join(total, "ref").select("ref", "first", "last", F.round(2 * F.col("both") / (F.col("n") + F.col("size")), digits).alias("f1"))
    best = scored.groupBy("ref").agg(F.max_by(F.struct("f1", "first", "last"), F.struct("f1", -F.col("first"), -F.col("last"))).alias("b"))
    return best.select("ref", "b.f1", "b.first", "b.last")


def packed(texts: DataFrame, key: str, text: str, most: int = 3500) -> DataFrame:
    """(key, part, paragraphs, words): paragraphs packed one after another into parts of at most ``most`` words, from 1.

    A longer paragraph is a part of its own; paragraphs are separated by lines without anything on them; null and blank texts
    have no part. The running state is a fold over the numbers of words of a text, not its paragraphs."""
    paras = F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike(r"[^\s\p{Z}]"))
    counts = F.transform(paras, lambda p: F.size(F.filter(F.split(p, T.SPACE), lambda w: w != "")))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), counts.alias("c"))
    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("words"), F.array().cast("array<int>").alias("parts"))

    def add(s: Column, n: Column) -> Column:
        new = (s["part"] == 0) | (s["words"] + n > most)
        part = F.when(new, s["part"] + 1).otherwise(s["part"])
        return F.struct(part.alias("part"), F.when(new, n).otherwise(s["words"] + n).alias("words"), F.array_append(s["parts"], part).alias("parts"))

    placed = rows.where("size(c) > 0").select("key", F.explode(F.arrays_zip(F.aggregate("c", start, add)["parts"].alias("part"), F.col("c").alias("n"))).alias("x"))
    return placed.groupBy("key", F.col("x.part").alias("part")).agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("x.n").alias("words")).withColumnRenamed("key", key)
