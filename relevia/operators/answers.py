"""Answers in the text that a search gives out: windows around chunks, emitted text, coverage of references, pages."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevia.functions import text as T

BUDGET = 1800  # characters given out per document


def windows(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(cid, text): every chunk stitched with the chunks before and after it, ``budget`` characters around its middle.

    Chunks follow one another by number, then cid; of a repeated cid one row counts. Stitching goes by place, then cid: what
    lies in the text so far is cut, others are joined by line feeds. Order comes from a window over slim rows of a document
    cut into runs of 512 numbers with their edges, texts are joined afterwards."""
    slim = chunks.select("cid", "doc_id", "idx").dropDuplicates(["cid"]).withColumn("run", F.floor(F.col("idx") / 512))
    order = Window.partitionBy("doc_id", "run").orderBy("idx", "cid")
    edge = slim.groupBy("doc_id", "run").agg(F.min(F.struct("idx", "cid"))["cid"].alias("low"), F.max(F.struct("idx", "cid"))["cid"].alias("high"))
    runs = Window.partitionBy("doc_id").orderBy("run")
    edge = edge.select("doc_id", "run", F.lag("high").over(runs).alias("far_before"), F.lead("low").over(runs).alias("far_after"))
    around = slim.select("*", F.lag("cid").over(order).alias("before"), F.lead("cid").over(order).alias("after")).join(edge, ["doc_id", "run"])
    near = around.select("cid", F.explode(F.array_compact(F.array(F.coalesce("before", "far_before"), F.col("cid"), F.coalesce("after", "far_after")))).alias("other"))
    texts = chunks.groupBy(F.col("cid").alias("other")).agg(F.min(F.struct(F.coalesce(F.col("char_start").cast("bigint"), F.lit(10**12)).alias("o"), F.col("cid").alias("c"), F.col("char_start").alias("s"), T.strip_prefix(F.col("text")).alias("t"))).alias("p"))
    met = near.join(texts, "other").groupBy("cid").agg(F.sort_array(F.collect_list("p")).alias("parts"))  # three at most
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("end"), F.lit(0).alias("at"), F.lit(0).alias("long"))

    def add(a: Column, p: Column) -> Column:
        n = F.length(p["t"])
        over = F.coalesce(p["s"] < a["end"], F.lit(False))
        cut = F.least(n, a["end"] - p["s"])
        at = F.when(over, F.length(a["text"]) - cut).otherwise(F.length(a["text"]) + (a["text"] != "").cast("int"))
        text = F.when(over, F.concat(a["text"], F.substring(p["t"], cut + 1, n))).otherwise(F.concat(a["text"], F.when(a["text"] != "", "\n").otherwise(""), p["t"]))
        end = F.when(p["s"].isNotNull(), F.greatest(F.coalesce(a["end"], F.lit(0)), p["s"] + n))
        own = p["c"] == F.col("cid")
        return F.struct(text.alias("text"), end.alias("end"), F.when(own, at).otherwise(a["at"]).alias("at"), F.when(own, n).otherwise(a["long"]).alias("long"))

    whole = met.select("cid", F.aggregate("parts", start, add).alias("w"))
    return whole.select("cid", T.window_text(F.col("w.text"), F.col("w.at"), F.col("w.long"), budget).alias("text"))


def emitted(responses: DataFrame, most: int = 3, budget: int = BUDGET) -> DataFrame:
    """(run_id, qid, doc_id, emitted): the first ``most`` fragments that the last response of a run gives for a document, cut to
    ``budget`` characters; of a repeated document the first place counts."""
    ok = responses.where("http = 200 and qid is not null and run_id is not null and results is not null")
    slim = F.transform("results", lambda r: F.struct(r["absolute_path"].alias("path"), F.slice(F.filter(F.coalesce(F.transform(r["chunks"], lambda c: c["content"]), F.array().cast("array<string>")), lambda c: c.isNotNull()), 1, most).alias("texts")))
    last = ok.groupBy("run_id", "qid").agg(F.max(F.struct("asked_at", "received_at", "ms", slim.alias("results")))["results"].alias("results"))
    hits = last.select("run_id", "qid", F.posexplode("results").alias("pos", "r")).where("r.path is not null")
    text = F.left(F.array_join("r.texts", "\n"), F.lit(budget))
    return hits.groupBy("run_id", "qid", T.document_of(F.col("r.path")).alias("doc_id")).agg(F.min_by(text, "pos").alias("emitted"))


def answers_at(emitted_texts: DataFrame, ranking: DataFrame, refs: DataFrame, enough: float = 0.8) -> DataFrame:
    """(run_id, n, answer_1, answer_3, document_3): shares of the questions with a reference (qid, doc_id, passage) whose first,
    or one of whose first three documents is a reference's and gives out text with ``enough`` of its 3-grams; and of those
    where a reference's document is among the three at all."""
    asked = refs.withColumn("g", T.grams(T.tokens(F.col("passage")))).where("size(g) > 0").select("qid", "doc_id", "g")
    top = ranking.where("rank <= 3").join(emitted_texts, ["run_id", "qid", "doc_id"]).join(asked, ["qid", "doc_id"])
    ok = F.size(F.array_intersect("g", T.grams(T.tokens(F.col("emitted"))))) >= enough * F.size("g")
    per = top.groupBy("run_id", "qid").agg(F.max(((F.col("rank") == 1) & ok).cast("int")).alias("a1"), F.max(ok.cast("int")).alias("a3"), F.lit(1).alias("d3"))
    full = asked.select("qid").distinct().join(F.broadcast(ranking.select("run_id").distinct()), F.lit(True))  # a row per run
    rows = full.join(per, ["run_id", "qid"], "left").na.fill(0, ["a1", "a3", "d3"])
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("a1").alias("answer_1"), F.avg("a3").alias("answer_3"), F.avg("d3").alias("document_3"))


def value_in_text(text: Column, label: Column, value: Column, period: Column | None = None) -> Column:
    """Whether a text holds a label, a number within 0.051 (or a millionth) of the value, and the written date of the period.

    Raised digits count as digits; a period that is no ISO date isn't looked for; a null text holds nothing."""
    low = T.norm(T.superscripts_to_digits(text))
    near = F.exists(T.numbers_in(low), lambda x: F.abs(x - value) <= F.greatest(F.lit(0.051), 1e-6 * F.abs(value)))
    dated = F.lit(True) if period is None else F.coalesce(F.contains(low, F.get(T.human_dates(period), F.lit(0))), F.lit(True))
    return F.coalesce(F.contains(low, T.norm(T.superscripts_to_digits(label))), F.lit(False)) & F.coalesce(near, F.lit(False)) & dated


def _page_shares(answers: pd.Series, pages: pd.Series) -> pd.Series:
    """Share of an answer's sentences of 40 characters or more that stand in a page, or nearly at the place of their first 30."""

    def one(answer: str | None, page: str | None) -> float | None:
        parts = [s for s in (answer or "").split("\x00") if len(s) >= 40]
        if not parts or page is None:
            return None
        found = 0
        for s in parts:
            at = page.find(s[:30])
            found += s in page or (at >= 0 and SequenceMatcher(None, s, page[at : at + len(s)]).ratio() > 0.85)
        return found / len(parts)

    return pd.Series([one(a, p) for a, p in zip(answers, pages)], dtype="float64")


def on_page(pairs: DataFrame, ref: str, digits: int = 6) -> DataFrame:
    """(ref, share, question_on_page, relevant) of pairs (ref, question, answer, page): how much of the answer stands on the page,
    whether the question's first 80 characters do, and whether the page answers (that, or a share of 0.6)."""
    sentences = F.array_join(F.transform(F.split("answer", r"(?<=[.!?…])\s+|\n"), T.norm), "\x00")
    page = T.norm(F.col("page"))
    share = F.pandas_udf(_page_shares, "double")(sentences, page)
    rows = pairs.select(F.col(ref).alias("ref"), F.round(share, digits).alias("share"), F.coalesce(F.contains(page, F.left(T.norm(F.col("question")), F.lit(80))), F.lit(False)).alias("question_on_page"))
    return rows.withColumn("relevant", F.col("question_on_page") | F.coalesce(F.col("share") >= 0.6, F.lit(False)))


