"""Grades: two opinions and a third, gold before earlier rounds, conflicts, agreement, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_opinion(grades: DataFrame) -> DataFrame:
    """(pid, grade): the earliest usable grade (0..3) of a pid; equal times give the smaller assessor, then grade."""
    ok = grades.where("pid is not null and grade between 0 and 3")
    first = ok.groupBy("pid").agg(F.min(F.struct(F.col("graded_at").isNull().alias("late"), "graded_at", F.coalesce("assessor", F.lit("")).alias("a"), "grade")).alias("m"))
    return first.select("pid", F.col("m.grade").alias("grade"))


def merge_opinions(a: DataFrame, b: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """(pid, grade_a, grade_b, grade): the third opinion before the first; pairs without a first are left out."""
    m = a.select("pid", F.col("grade").alias("grade_a")).join(b.select("pid", F.col("grade").alias("grade_b")), "pid", "left")
    if c is None:
        return m.withColumn("grade", F.col("grade_a"))
    return m.join(c.select("pid", F.col("grade").alias("c")), "pid", "left").select("pid", "grade_a", "grade_b", F.coalesce("c", "grade_a").alias("grade"))


def conflicts(merged: DataFrame) -> DataFrame:
    """Pairs whose two grades differ and one of which is relevant."""
    return merged.where("grade_b is not null and grade_a <> grade_b and greatest(grade_a, grade_b) >= 2")


def resolve(gold: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, doc_id, grade): gold before judged; of several judged grades that of the first round in byte order, then the smallest."""
    g = gold.where("grade is not null").select("qid", "doc_id", F.lit(0).alias("p"), F.lit("").alias("round"), "grade")
    j = judged.where("grade is not null").select("qid", "doc_id", F.lit(1).alias("p"), F.coalesce("round", F.lit("")).alias("round"), "grade")
    best = g.unionByName(j).where("qid is not null and doc_id is not null").groupBy("qid", "doc_id").agg(F.min(F.struct("p", "round", "grade")).alias("m"))
    return best.select("qid", "doc_id", F.col("m.grade").alias("grade"))


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of the pairs where both are given."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def weighted_kappa(pairs: DataFrame, a: str, b: str, classes: int = 4) -> DataFrame:
    """One row (n, exact, kappa): quadratic weights; null without pairs or where chance alone allows no disagreement."""
    w = F.pow((F.col("a") - F.col("b")) / (classes - 1), 2)
    cells = confusion(pairs, a, b)
    observed = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum(w * F.col("n")).alias("d"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("x")), cells.groupBy("b").agg(F.sum("n").alias("y"))
    chance = rows.join(F.broadcast(cols), F.lit(True)).agg(F.sum(w * F.col("x") * F.col("y")).alias("e"))  # classes x classes rows
    return observed.join(F.broadcast(chance), F.lit(True)).select(F.coalesce("n", F.lit(0)).alias("n"), F.try_divide("same", "n").alias("exact"), (1 - F.try_divide(F.col("d") * F.col("n"), F.col("e"))).alias("kappa"))


def foreign_zero(candidates: DataFrame, allowed: DataFrame, grades: DataFrame) -> DataFrame:
    """(qid, doc_id, grade 0) of ungraded pairs whose document's dataset isn't allowed for the query's.

    ``candidates`` has qid, doc_id, query_dataset, doc_dataset; ``allowed`` the two dataset columns."""
    out = candidates.join(allowed.distinct(), ["query_dataset", "doc_dataset"], "left_anti")
    return out.join(grades.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").select("qid", "doc_id", F.lit(0).alias("grade")).distinct()


def hash_order(*parts: Column, seed: str = "20260925") -> Column:
    """A fixed pseudo-random order, the same in every engine: MD5 of the seeded key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))


def positions(pairs: DataFrame, key: str, seed: str = "20260925", spread: int = 64, name: str = "pos") -> DataFrame:
    """``pairs`` with their places from 0 in a fixed shuffle.

    Places are counted within ranges of the hash and shifted by the ranges' sizes, so nothing is sorted in one task."""
    h = hash_order(F.col(key), seed=seed)
    rows = pairs.withColumn("__h", h).withColumn("__u", F.floor(F.conv(F.left(h, F.lit(4)), 16, 10).cast("int") * spread / 65536))
    ahead = rows.groupBy("__u").count().withColumn("__o", F.sum("count").over(Window.orderBy("__u").rowsBetween(Window.unboundedPreceding, -1)))  # spread rows
    nth = F.row_number().over(Window.partitionBy("__u").orderBy("__h", key)) - 1
    out = rows.withColumn("__n", nth).join(F.broadcast(ahead.select("__u", "__o")), "__u")
    return out.withColumn(name, F.col("__n") + F.coalesce("__o", F.lit(0))).drop("__h", "__u", "__n", "__o")


def batches(pairs: DataFrame, key: str, size: int = 40, seed: str = "20260925", spread: int = 64) -> DataFrame:
    """``pairs`` with a batch number: a fixed shuffle cut into batches of ``size``."""
    return positions(pairs, key, seed, spread, "__pos").withColumn("batch", F.floor(F.col("__pos") / size).cast("int")).drop("__pos")


def second_opinions(pairs: DataFrame, key: str, share: float = 0.2, size: int = 40, seed: str = "20260925") -> DataFrame:
    """(key, batch): an independent sample of ``share`` of the pairs, one at least, shuffled anew and cut into batches."""
    n = pairs.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("__k"))
    picked = positions(pairs.select(key), key, seed + "/second", name="__p").join(F.broadcast(n), F.lit(True)).where("__p < __k")
    return batches(picked.select(key), key, size, seed + "/order")


def to_verify(first: DataFrame, second: DataFrame, allowed: DataFrame | None = None, size: int = 40) -> DataFrame:
    """(pid, batch): pairs whose first grade is relevant and that have no second opinion, without those of ``allowed`` (pid)."""
    todo = first.where("grade >= 2").select("pid").join(second.select("pid"), "pid", "left_anti")
    return batches(todo if allowed is None else todo.join(allowed.select("pid"), "pid", "left_anti"), "pid", size)


def evidence(rows: DataFrame, qid: str, keys: str, manifest: DataFrame, grade: int = 3) -> DataFrame:
    """(qid, doc_id, grade) of the documents whose key is among a question's evidence keys (an array)."""
    asked = rows.where(F.col(qid).isNotNull()).select(F.col(qid).alias("qid"), F.explode(keys).alias("key")).distinct()
    return asked.join(manifest.select("key", "doc_id").distinct(), "key").select("qid", "doc_id", F.lit(grade).alias("grade")).distinct()


def rebatched(pairs: DataFrame, key: str, graded: DataFrame, needed: DataFrame, size: int = 40, seed: str = "20260925") -> DataFrame:
    """(key, part, batch): pairs (key, qid, doc_id) without a grade; those that ``needed`` (qid, doc_id) has come first (part p),
    the others second (part q), each part in batches of its own."""
    todo = pairs.join(graded.select(key), key, "left_anti")
    first = todo.join(needed.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").select(key).distinct()
    second = todo.select(key).distinct().join(first, key, "left_anti")
    return batches(first, key, size, seed).withColumn("part", F.lit("p")).unionByName(batches(second, key, size, seed).withColumn("part", F.lit("q"))).select(key, "part", "batch")


def inherited(grades: DataFrame, variants: DataFrame) -> DataFrame:
    """(qid, doc_id, grade): the base question's grades for every variant (qid, base) that has none of its own."""
    without = variants.where("qid is not null and base is not null and qid <> base").distinct().join(grades.select("qid").distinct(), "qid", "left_anti")
    got = without.join(grades.select(F.col("qid").alias("base"), "doc_id", "grade"), "base")
    return got.groupBy("qid", "doc_id").agg(F.max("grade").alias("grade"))


def cited(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, doc_id, grade): documents that a source cites by number: 3 for its own number, 2 for the others'.

    ``sources`` has source, own (a number or null) and refs (numbers); ``targets`` doc_id and number. The higher grade counts."""
    own = sources.where("own is not null").select("source", F.col("own").alias("number"), F.lit(3).alias("grade"))
    refs = sources.select("source", F.explode("refs").alias("number"), F.lit(2).alias("grade"))
    return own.unionByName(refs).distinct().join(targets.distinct(), "number").groupBy("source", "doc_id").agg(F.max("grade").alias("grade"))


def stratified(rows: DataFrame, stratum: str, key: str, total: int = 250, least: int = 5, seed: str = "20260925") -> DataFrame:
    """Of each stratum max(least, its half-even share of total) rows at most, in the fixed pseudo-random order."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    take = F.greatest(F.lit(least), F.bround(total * F.col("__n") / F.sum("__n").over(Window.partitionBy(F.lit(0)))).cast("int"))  # a row per stratum
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed=seed), key)
    nth = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(total, least))
    quota = sizes.select(F.col(stratum).alias("__s"), take.alias("__k"))
    return nth.join(quota, F.col(stratum).eqNullSafe(F.col("__s"))).where("__r <= __k").drop("__r", "__s", "__k")
