"""Rankings in long form, and the ranking metrics per query.

A ranking has a run, qid, rank (from 1) and doc_id; grades have qid, doc_id and grade. Unjudged documents count as grade
0, a document is relevant from grade 2 on, gain is linear, lists are cut at k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.sources import materialize

RELEVANT = 2
METRICS = ["ndcg", "hit_1", "hit_k", "mrr", "recall"]


def latest_responses(responses: DataFrame) -> DataFrame:
    """One successful response per (run_id, qid): the one asked last, then received last, then slowest."""
    ok = responses.where("http = 200 and qid is not null and run_id is not null and results is not null")
    last = ok.groupBy("run_id", "qid").agg(F.max(F.struct("asked_at", "received_at", "ms", F.transform("results", lambda r: F.struct(r["absolute_path"].alias("path"), r["score"].alias("score"))).alias("results"))).alias("m"))
    return last.select("run_id", "qid", F.col("m.results").alias("results"))


def ranking_of(responses: DataFrame) -> DataFrame:
    """(run_id, qid, rank, doc_id, score): the order of the response, first place of a repeated document, ranked
    anew; a NaN score is null."""
    hits = latest_responses(responses).select("run_id", "qid", F.posexplode("results").alias("pos", "r"))
    docs = hits.select("run_id", "qid", "pos", T.document_of(F.col("r.path")).alias("doc_id"), F.when(~F.isnan("r.score"), F.col("r.score")).alias("score")).where("doc_id is not null")
    return rerank(docs.groupBy("run_id", "qid", "doc_id").agg(F.min("pos").alias("pos"), F.min_by("score", "pos").alias("score")), ["run_id", "qid"], ["pos"])


def rerank(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """Ranks from 1 within ``by``; the order must be total."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.drop("pos") if "pos" in ranked.columns else ranked


def answerable(grades: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(qid) with a relevant document, except those of ``without`` (qid), such as questions that should have no answer."""
    out = grades.where(F.col("grade") >= RELEVANT).select("qid").distinct()
    return out if without is None else out.join(without.where("qid is not null").select("qid").distinct(), "qid", "left_anti")


def narrowed(table: DataFrame, questions: DataFrame, scenario: int | None = None, dataset: str | None = None, part: str | None = None) -> DataFrame:
    """The rows of ``table`` (qid, ...) whose question (qid, scenario, dataset and, if asked for, part) passes all filters given."""
    q = questions
    for column, value in (("scenario", scenario), ("dataset", dataset), ("part", part)):
        q = q if value is None else q.where(F.col(column) == value)
    return table.join(q.select("qid").distinct(), "qid", "left_semi")


def indexed_answerable(grades: DataFrame, indexed: DataFrame) -> DataFrame:
    """(qid) with a relevant document that is indexed."""
    return grades.where(F.col("grade") >= RELEVANT).join(indexed.select("doc_id").distinct(), "doc_id", "left_semi").select("qid").distinct()


def ideal_gain(grades: DataFrame, k: int = 10) -> DataFrame:
    """(qid, idcg, n_relevant): the best discounted gain that the grades allow, retrieved or not."""
    w = Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id")
    graded = grades.select("qid", "grade", F.row_number().over(w).alias("i"))
    gain = F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1.0)).otherwise(0.0)
    return graded.groupBy("qid").agg(F.sum(gain).alias("idcg"), F.count_if(F.col("grade") >= RELEVANT).alias("n_relevant"))


def per_query(ranking: DataFrame, grades: DataFrame, spine: DataFrame, k: int = 10) -> DataFrame:
    """(run_id, qid, five metrics, unjudged): every run over every query of the spine, zeros where the run lacks it.

    One pass joins the first k places with the grades and sums all metrics at once."""
    top = ranking.where(F.col("rank") <= k).join(grades.select("qid", "doc_id", "grade"), ["qid", "doc_id"], "left")
    good = F.coalesce(F.col("grade") >= RELEVANT, F.lit(False))
    got = top.groupBy("run_id", "qid").agg(
        F.sum(F.coalesce("grade", F.lit(0)) / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.max((good & (F.col("rank") == 1)).cast("int")).alias("hit_1"),
        F.max(good.cast("int")).alias("hit_k"),
        F.min(F.when(good, F.col("rank"))).alias("first"),
        F.count_if(good).alias("found"),
        F.count_if(F.col("grade").isNull()).alias("unjudged"),
    )
    got = materialize(got)
    all_ = spine.select("qid").distinct().join(ideal_gain(grades, k), "qid", "left")
    full = all_.join(F.broadcast(got.select("run_id").distinct()), F.lit(True))  # a row per run
    rows = full.join(got, ["run_id", "qid"], "left")
    return rows.select(
        "run_id",
        "qid",
        F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.col("hit_1"), F.lit(0)).cast("double").alias("hit_1"),
        F.coalesce(F.col("hit_k"), F.lit(0)).cast("double").alias("hit_k"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide("found", "n_relevant"), F.lit(0.0)).cast("double").alias("recall"),
        F.coalesce("unjudged", F.lit(0)).cast("bigint").alias("unjudged"),
    )


def means(table: DataFrame, by: list[str], values: list[str] | None = None) -> DataFrame:
    """Averages per slice with the number of queries; an empty slice has no row."""
    return table.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values or METRICS])


def unjudged(ranking: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """Places up to k without a grade."""
    return ranking.where(F.col("rank") <= k).join(grades.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")


def optimistic(ranking: DataFrame, grades: DataFrame, k: int = 10, grade: int = 2) -> DataFrame:
    """The grades plus ``grade`` for every unjudged place of the given rankings."""
    extra = unjudged(ranking, grades, k).select("qid", "doc_id").distinct().withColumn("grade", F.lit(grade))
    return grades.select("qid", "doc_id", "grade").unionByName(extra)


def paired(table: DataFrame, a: str, b: str, values: list[str] | None = None) -> DataFrame:
    """(qid, value_a, value_b, value_delta ...): two runs side by side; both come from one spine, so none is missing."""
    values = values or METRICS
    one = table.where(F.col("run_id") == a).select("qid", *[F.col(v).alias(f"{v}_a") for v in values])
    two = table.where(F.col("run_id") == b).select("qid", *[F.col(v).alias(f"{v}_b") for v in values])
    return one.join(two, "qid").select("*", *[(F.col(f"{v}_b") - F.col(f"{v}_a")).alias(f"{v}_delta") for v in values])


def movers(pairs: DataFrame, delta: str, n: int = 5, dead: float = 1e-9) -> DataFrame:
    """The n largest gains and the n largest losses beyond the dead zone; ties by qid, in opposite directions."""
    up = pairs.where(F.col(delta) > dead).orderBy(F.desc(delta), F.desc("qid")).limit(n).withColumn("side", F.lit("gain"))
    down = pairs.where(F.col(delta) < -dead).orderBy(F.asc(delta), F.asc("qid")).limit(n).withColumn("side", F.lit("loss"))
    return up.unionByName(down).select("side", "qid", delta)


def same_lists(ranking: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """One row: queries of both runs whose first k places are equal, equal as sets, and equal in the first place."""
    top = ranking.where((F.col("rank") <= k) & F.col("run_id").isin(a, b)).groupBy("qid", "run_id")
    lists = top.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    one = lists.where(F.col("run_id") == a).select("qid", F.col("docs").alias("x"))
    two = lists.where(F.col("run_id") == b).select("qid", F.col("docs").alias("y"))
    both = one.join(two, "qid")
    return both.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("x") == F.col("y")).alias("same_list"),
        F.count_if(F.array_sort("x") == F.array_sort("y")).alias("same_set"),
        F.count_if(F.get("x", F.lit(0)) == F.get("y", F.lit(0))).alias("same_first"),
    )


def promote(ranking: DataFrame, hits: DataFrame) -> DataFrame:
    """Documents of ``hits`` (qid, doc_id, hit_no) first, stably: those already listed in list order, then the others in
    hit order, then the rest of the list."""
    named = hits.groupBy("qid", "doc_id").agg(F.min("hit_no").alias("hit_no"))
    both = ranking.select("qid", "doc_id", F.col("rank").alias("old")).join(named, ["qid", "doc_id"], "full")
    bucket = F.when(F.col("hit_no").isNotNull() & F.col("old").isNotNull(), 0).when(F.col("hit_no").isNotNull(), 1).otherwise(2)
    return rerank(both.select("qid", "doc_id", bucket.alias("b"), F.coalesce("old", "hit_no").alias("o")), ["qid"], ["b", "o", "doc_id"]).drop("b", "o")


def collapse_chunks(chunks: DataFrame, k: int = 10, documents_first: bool = True) -> DataFrame:
    """(qid, rank, doc_id) from ranked chunks (qid, rank, doc_id): cut after or before the collapse to documents."""
    rows = chunks if documents_first else chunks.where(F.col("rank") <= k)
    docs = rows.groupBy("qid", "doc_id").agg(F.min("rank").alias("pos"))
    return rerank(docs, ["qid"], ["pos", "doc_id"]).where(F.col("rank") <= k)


def fragments(chunks: DataFrame, n: int = 3) -> DataFrame:
    """Up to n chunks per (qid, doc_id) in rank order, cards left out."""
    w = Window.partitionBy("qid", "doc_id").orderBy("rank")
    return chunks.where(F.coalesce("kind", F.lit("")) != "card").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def place_metrics(places: DataFrame, by: str, k: int = 10) -> DataFrame:
    """(by, n, hit_1, hit_k, mrr) of questions with one right document at place ``rank`` (null where it wasn't found), by
    slice and for ``all``."""
    r = F.when(F.col("rank") <= k, F.col("rank"))
    g = places.groupingSets([[by], []], by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(r == 1, F.lit(False)).cast("double")).alias("hit_1"),
        F.avg(r.isNotNull().cast("double")).alias(f"hit_{k}"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), F.grouping_id().alias("__g"),
    )
    return g.withColumn(by, F.when(F.col("__g") == 0, F.col(by)).otherwise("all")).drop("__g")


def repeat_classes(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(qid, verdict): how the answers of one run (qid, docs: array of (doc_id, score), scores: chunk scores) repeat those of
    another: exact; ties (other order among equal scores); cut (other documents only at the lowest chunk score); other.

    Questions are those of ``b``; null scores count as 0."""
    x = a.select("qid", F.col("docs").alias("da"), F.array_sort("scores").alias("sa"))
    y = b.select("qid", F.col("docs").alias("db"), F.array_sort("scores").alias("sb"))

    def near(p: Column, q: Column) -> Column:
        return (F.size(p) == F.size(q)) & F.forall(F.zip_with(p, q, lambda u, v: F.abs(u - v) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))

    def part(c: str, field: str) -> Column:
        return F.transform(c, lambda d: d[field])

    def within(p: Column, q: Column) -> Column:
        return F.forall(p, lambda d: F.exists(q, lambda e: (e["doc_id"] == d["doc_id"]) & (F.abs(e["score"] - d["score"]) <= tolerance)))

    both = y.join(x, "qid", "left").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("da", "array<struct<doc_id:string,score:double>>"), ("sa", "array<double>"))})
    scores = near(part("da", "score"), part("db", "score"))
    apart = F.concat(F.array_except("da", "db"), F.array_except("db", "da"))
    edge = near(F.col("sa"), F.col("sb")) & (F.size("sa") > 0) & F.forall(apart, lambda d: F.abs(d["score"] - F.get("sa", F.lit(0))) <= tolerance)
    verdict = F.when(scores & (part("da", "doc_id") == part("db", "doc_id")), "exact").when(scores & within(F.col("da"), F.col("db")) & within(F.col("db"), F.col("da")), "ties").when(edge, "cut").otherwise("other")
    return both.select("qid", verdict.alias("verdict"))
