"""What to judge next, passages to show, navigation questions, disagreement between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.operators.grades import hash_order


def differing_pool(ranking: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id): ungraded places of several runs that tell them apart: documents that one run alone lists, or that
    stand above the first relevant document of a run (above place k where there is none)."""
    top = ranking.where(F.col("rank") <= k)
    g = grades.select("qid", "doc_id", "grade")
    first = top.join(g.where("grade >= 2"), ["qid", "doc_id"]).groupBy("run_id", "qid").agg(F.min("rank").alias("first"))
    seen = top.groupBy("qid", "doc_id").agg(F.count_distinct("run_id").alias("runs"))
    rows = top.join(first, ["run_id", "qid"], "left").join(seen, ["qid", "doc_id"])
    picked = rows.where((F.col("runs") == 1) | (F.col("rank") < F.coalesce("first", F.lit(k)))).select("qid", "doc_id").distinct()
    return picked.join(g, ["qid", "doc_id"], "left_anti")


def first_disagreement(ranking: DataFrame, grades: DataFrame, a: str, b: str) -> DataFrame:
    """One row: questions of both runs, those with another first document, and of them where only a's or only b's is relevant."""
    rel = F.coalesce(F.col("grade") >= 2, F.lit(False))
    one = ranking.where("rank = 1").join(grades.select("qid", "doc_id", "grade"), ["qid", "doc_id"], "left").select("run_id", "qid", "doc_id", rel.alias("rel"))
    x = one.where(F.col("run_id") == a).select("qid", F.col("doc_id").alias("da"), F.col("rel").alias("ra"))
    y = one.where(F.col("run_id") == b).select("qid", F.col("doc_id").alias("db"), F.col("rel").alias("rb"))
    other = F.col("da") != F.col("db")
    return x.join(y, "qid").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(other).alias("differ"),
        F.count_if(other & F.col("ra") & ~F.col("rb")).alias("only_a"), F.count_if(other & ~F.col("ra") & F.col("rb")).alias("only_b"),
    )


def passages(pairs: DataFrame, chunks: DataFrame, n: int = 3, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(pid, cid, score, rank): the n best chunks of each pair's document for its need, by BM25 with the document's own
    statistics. ``pairs`` has pid, need, doc_id; ``chunks`` cid, doc_id, text.

    Everything is keyed by document, and only terms of the needs are scored; scores above 0 stay, ties go to the smaller cid."""
    asked = pairs.where("pid is not null and need is not null").select("pid", "doc_id", F.explode(T.tokens(F.col("need"))).alias("term")).groupBy("pid", "doc_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    rows = chunks.select("cid", "doc_id", T.tokens(F.col("text")).alias("w")).where("size(w) > 0").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    size = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.avg(F.size("w")).alias("avg"))
    tf = rows.select("doc_id", "cid", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("doc_id", "cid", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")).join(size, "doc_id")
    raw = df.select("doc_id", "term", "avg", F.log((F.col("units") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("raw"))
    eps = raw.groupBy("doc_id").agg((F.avg("raw") * 0.25).alias("eps"))
    idf = raw.join(eps, "doc_id").select("doc_id", "term", "avg", F.when(F.col("raw") < 0, F.col("eps")).otherwise(F.col("raw")).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = asked.join(idf, ["doc_id", "term"]).join(tf, ["doc_id", "term"]).groupBy("pid", "cid").agg(F.round(F.sum(part), digits).alias("score")).where("score > 0")
    w = Window.partitionBy("pid").orderBy(F.desc("score"), "cid")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# How questions for a document are worded.
TEMPLATES = {
    "name": ["Найди файл {x}", "Где документ {x}", "Открой {x}", "{x}"],
    "code": ["Найди файл {x}", "Где файл {x}", "Открой документ {x}", "{x}"],
    "title": ["Найди документ {x}", "Где документ «{x}»", "{x}"],
    "heading": ["Найди раздел {x}", "Где раздел «{x}»", "{x}"],
}


def shown(found: DataFrame, extra: DataFrame, k: int = 3, limit: int = 1500, most: int = 2) -> DataFrame:
    """(pid, place, text): what an assessor sees of a pair: up to ``most`` fragments that the system gave (pid, place, text), then
    the best passages (pid, rank, text), ``k`` and the number of fragments in all, each cut to ``limit`` characters and shown once."""
    own = extra.where("text <> ''").withColumn("n", F.row_number().over(Window.partitionBy("pid").orderBy("place", "text"))).where(F.col("n") <= most)
    number = own.groupBy("pid").agg(F.count(F.lit(1)).alias("extra"))
    rows = own.select("pid", F.lit(0).alias("p"), F.col("n").alias("o"), F.left("text", F.lit(limit)).alias("text")).unionByName(found.select("pid", F.lit(1).alias("p"), F.col("rank").alias("o"), F.left("text", F.lit(limit)).alias("text")))
    once = rows.groupBy("pid", "text").agg(F.min(F.struct("p", "o")).alias("at"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy("at", "text"))).join(number, "pid", "left")
    return placed.where(F.col("place") <= k + F.coalesce("extra", F.lit(0))).select("pid", "place", "text")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, T.SPACE, " ")), " "), 1, n), " ")


def navigation(manifest: DataFrame, chunks: DataFrame, most: int = 15) -> DataFrame:
    """(type, query, doc_id): questions that one document answers by its name, its title, a code or a heading.

    name: the file's stem; title: where the stem doesn't contain its words; code: the last designation that stands in this
    stem only; heading: of the last parts of the sections of text documents (cards aside) with three words or more that this
    document alone has, the first in hash order. Titles and headings are cut to ``most`` words; the wording is picked by hash."""
    m = manifest.where("doc_id is not null").groupBy("doc_id").agg(F.min("title").alias("title"))
    stem = F.regexp_replace(F.regexp_replace("doc_id", "^.*/", ""), r"\.[^.]*$", "")
    m = m.select("doc_id", F.trim("title").alias("title"), stem.alias("stem"))
    names = m.select(F.lit("name").alias("type"), F.col("stem").alias("x"), "doc_id")
    other = ~F.contains(T.padded(T.fold(F.col("stem"))), T.padded(T.fold(F.col("title"))))
    titles = m.where(F.coalesce(F.col("title") != "", F.lit(False)) & other).select(F.lit("title"), first_words(F.col("title"), most), "doc_id")
    codes = m.select("doc_id", F.posexplode(F.split("stem", T.SPACE)).alias("pos", "code")).where(T.is_code(F.col("code"))).withColumn("norm", T.norm_letters(F.col("code")))
    own = codes.groupBy("norm").agg(F.count_distinct("doc_id").alias("n")).where("n = 1")
    codes = codes.join(own, "norm", "left_semi").groupBy("doc_id").agg(F.max_by("code", "pos").alias("code")).select(F.lit("code"), "code", "doc_id")
    text = F.coalesce("kind", F.lit("")) != "card" if "kind" in chunks.columns else F.lit(True)
    part = F.trim(F.regexp_replace("section", "^.* › ", ""))
    heads = chunks.where("section is not null and doc_id is not null").where(text & T.extension(F.col("doc_id")).isin("pdf", "docx", "pptx", "txt")).select("doc_id", part.alias("h")).distinct()
    heads = heads.withColumn("norm", T.norm_letters(F.col("h")))
    lone = heads.groupBy("norm").agg(F.count_distinct("doc_id").alias("n")).where("n = 1")
    heads = heads.where(F.size(F.split("h", T.SPACE)) >= 3).join(lone, "norm", "left_semi")
    heads = heads.groupBy("doc_id").agg(F.min_by("h", F.struct(hash_order(F.col("h")).alias("o"), "h")).alias("h")).select(F.lit("heading"), first_words(F.col("h"), most), "doc_id")
    rows = names.union(titles).union(codes).union(heads)
    pick = F.conv(F.left(hash_order(F.col("type"), F.col("doc_id")), F.lit(8)), 16, 10).cast("bigint")
    worded = F.lit(None).cast("string")
    for kind, forms in TEMPLATES.items():
        form = F.element_at(F.array(*map(F.lit, forms)), (pick % len(forms) + 1).cast("int"))
        worded = F.when(F.col("type") == kind, F.replace(form, F.lit("{x}"), F.col("x"))).otherwise(worded)
    return rows.select("type", worded.alias("query"), "doc_id")


def named_documents(asked: DataFrame, qid: str, query: str, manifest: DataFrame, most: int = 3) -> DataFrame:
    """(qid, doc_id, hit_no): documents whose file name holds a designation of the question, where ``most`` documents at most
    hold it; hits in the order of the question's designations, then of the documents.

    A designation is a word of the question, its punctuation aside, with a digit and a letter or underscore; names hold it as
    whole words. Names and questions meet on phrases of up to four words."""
    stem = T.norm_letters(F.regexp_replace(F.regexp_replace("doc_id", "^.*/", ""), r"\.[^.]*$", ""))
    names = manifest.where("doc_id is not null").select("doc_id").distinct().select("doc_id", F.split(stem, " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.when(i + n - 1 <= F.size("w"), F.array_join(F.slice("w", i, n), " "))), lambda x: x.isNotNull())))
    held = names.select("doc_id", F.explode(F.array_distinct(spans)).alias("phrase"))
    few = held.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("phrase")
    words = asked.where(F.col(qid).isNotNull()).select(F.col(qid).alias("qid"), F.posexplode(F.split(query, T.SPACE)).alias("pos", "raw"))
    bare = F.regexp_replace("raw", r"""^[.,;:!?«»"'()\[\]]+|[.,;:!?«»"'()\[\]]+$""", "")
    codes = words.select("qid", "pos", bare.alias("code")).where(T.is_code(F.col("code"))).select("qid", "pos", T.norm_letters(F.col("code")).alias("phrase"))
    met = codes.join(few, "phrase", "left_semi").join(held, "phrase").groupBy("qid", "doc_id").agg(F.min("pos").alias("pos"))
    return met.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "doc_id")).alias("hit_no"))


def tie_groups(scores: Column, keys: Column, tolerance: float = 1e-6) -> Column:
    """Keys of a ranked list in groups of scores within ``tolerance`` of the group's first; each group sorted."""
    rows = F.arrays_zip(scores.alias("s"), keys.alias("k"))
    start = F.array().cast("array<struct<first:double,keys:array<string>>>")

    def add(groups: Column, r: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        near = last.isNotNull() & (F.abs(last["first"] - r["s"]) <= tolerance)
        grown = F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), F.concat(last["keys"], F.array(r["k"])).alias("keys"))))
        return F.when(near, grown).otherwise(F.concat(groups, F.array(F.struct(r["s"].alias("first"), F.array(r["k"]).alias("keys")))))

    return F.transform(F.aggregate(rows, start, add), lambda g: F.array_sort(g["keys"]))
