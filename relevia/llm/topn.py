"""Top N items within every group, also when one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(
    items: DataFrame, group: str, ident: str, score: str, n: int = 10, salts: int = 32, rank: str = "rank_no"
) -> DataFrame:
    """Two-stage salted ranking: (group, ident, score, rank), the ``n`` best identifiers of each group.

    An identifier counts once per group, with its highest score; higher score first, ties by identifier ascending in
    byte order. Rows with a null group, identifier or score and NaN scores are left out; other columns are ignored, an
    empty table gives an empty result. Groups are hashed into ``salts`` subgroups by identifier; each subgroup keeps its
    ``n`` best, so the final ranking of a group sees at most ``salts * n`` rows however large the group is, and a task at
    most a ``salts``-th of a group's identifiers: choose it so that this many rows of the largest group sort in one task.
    Repeated rows of a (group, identifier) are reduced before they are moved."""
    rows = items.select(F.col(group).alias("g"), F.col(ident).alias("i"), F.col(score).alias("s"))
    rows = rows.where("g is not null and i is not null and s is not null and not isnan(s)")
    best = rows.groupBy("g", "i").agg(F.max("s").alias("s"))
    order = [F.desc("s"), F.asc("i")]
    sub = best.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
    sub = sub.withColumn("r", F.row_number().over(Window.partitionBy("g", "b").orderBy(*order))).where(F.col("r") <= n)
    top = sub.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("r") <= n)
    return top.select(F.col("g").alias(group), F.col("i").alias(ident), F.col("s").alias(score), F.col("r").alias(rank))


def result_documents(responses: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of every result of a successful response (http 200) with a qid.

    The document is what follows the first ``/corpus/`` of the path; a path without it is itself the document."""
    hits = responses.where("http = 200 and qid is not null").select("qid", F.explode("results").alias("r"))
    doc = F.regexp_replace(F.col("r.absolute_path"), r"(?s)^.*?/corpus/", "")
    return hits.select("qid", doc.alias("doc_id"), F.col("r.score").alias("score"))
