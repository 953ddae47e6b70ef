"""Consensus of several annotators by expectation-maximisation over their confusion matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevia.sources import materialize

PRIOR = "\x00classes"  # pseudo-annotator whose one "vote" per item carries the class shares


@dataclass
class Consensus:
    labels: DataFrame  # item, label, confidence, n_votes
    annotators: DataFrame  # annotator, n_votes, reliability, bias
    agreement: DataFrame  # one row: n_items, observed, expected, kappa
    rounds: int  # how many were needed
    moved: float  # the largest move of a probability when it was last measured, every four rounds


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def consensus(
    votes: DataFrame,
    item: str,
    annotator: str,
    label: str,
    classes: int = 4,
    smoothing: float = 0.5,
    max_iter: int = 24,
    tol: float = 1e-3,
    salts: int = 8,
) -> Consensus:
    """Item posteriors and annotator confusion matrices, fitted in turn until they stand still.

    ``votes`` has at most one row per (item, annotator); further ones are reduced to the smallest label. Rows with a null
    key or a label outside 0..classes-1 are left out; an empty table gives empty labels and annotators and an agreement
    row of nulls. Ties between classes go to the smaller label. Votes stay hash-partitioned by item over all rounds, so
    a round moves only the sums per (annotator, label): hot annotators are summed before the shuffle, and meet their
    matrices, of which there are ``salts`` copies, by a salt of the item. Rounds end when no probability moves by ``tol``,
    after ``max_iter`` at the latest."""
    ks = range(classes)
    v = votes.select(F.col(item).alias("i"), F.col(annotator).cast("string").alias("a"), F.col(label).cast("int").alias("l"))
    v = v.where(F.col("i").isNotNull() & F.col("a").isNotNull() & F.col("l").between(0, classes - 1))
    given = v.groupBy("i", "a").agg(F.min("l").alias("l"))
    v = given.withColumn("n", F.lit(1)).unionByName(given.select("i").distinct().select("i", F.lit(PRIOR).alias("a"), F.lit(0).alias("l"), F.lit(0).alias("n")))
    parts = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = v.withColumn("s", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int")).repartition(parts, "i").persist()

    real = F.col("a") != PRIOR

    def model(post: DataFrame) -> DataFrame:
        """Log-probability of each observed (annotator, label) under each class."""
        sums = v.join(post, "i").groupBy("a", "l").agg(*[F.sum(f"p{k}").alias(f"c{k}") for k in ks])
        mine, prior = Window.partitionBy("a"), F.col("a") == PRIOR
        mass = _total([F.col(f"c{k}") for k in ks])
        cols = []
        for k in ks:
            extra = F.when(F.col("l") == k, 3.0 * smoothing).otherwise(smoothing)
            vote = (F.col(f"c{k}") + extra) / (F.sum(f"c{k}").over(mine) + smoothing * (classes + 2))
            share = (F.col(f"c{k}") + smoothing) / (mass + smoothing * classes)
            cols.append(F.log(F.when(prior, share).otherwise(vote)).alias(f"m{k}"))
        return sums.select("a", "l", *[F.col(f"c{k}") for k in ks], *cols)

    def posterior(m: DataFrame) -> DataFrame:
        copies = m.where(real).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        shares = m.where(~real).select(*[F.col(f"m{k}").alias(f"q{k}") for k in ks])  # one row
        s = v.where(real).join(copies, ["a", "l", "s"]).groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(f"m{k}").alias(f"s{k}") for k in ks])
        s = s.join(F.broadcast(shares), F.lit(True)).select("i", "n", *[(F.col(f"s{k}") + F.col(f"q{k}")).alias(f"s{k}") for k in ks])
        top = F.greatest(*[F.col(f"s{k}") for k in ks])
        e = [F.exp(F.col(f"s{k}") - top) for k in ks]
        return s.select("i", "n", *[(e[k] / _total(e)).alias(f"p{k}") for k in ks])

    start = v.groupBy("i").agg(*[((F.sum(F.when(real & (F.col("l") == k), 1.0).otherwise(0.0)) + 0.1) / (F.sum("n") + 0.1 * classes)).alias(f"p{k}") for k in ks])
    m, moved, step = materialize(model(start)), float("inf"), -1
    for step in range(max_iter):
        new = materialize(model(posterior(m)))
        if step % 4 == 3:
            old = m.select("a", "l", *[F.col(f"m{k}").alias(f"o{k}") for k in ks])
            moved = new.join(old, ["a", "l"]).agg(F.max(F.greatest(*[F.abs(F.exp(f"m{k}") - F.exp(f"o{k}")) for k in ks]))).first()[0]
            moved = moved or 0.0
            if moved < tol:
                m = new
                break
        m = new

    post = materialize(posterior(m))
    v.unpersist()
    best = F.greatest(*[F.col(f"p{k}") for k in ks])
    chosen = F.coalesce(*[F.when(F.col(f"p{k}") >= best - 1e-12, F.lit(k)) for k in ks])
    labels = post.select(F.col("i").alias(item), chosen.cast("int").alias(label), best.alias("confidence"), F.col("n").cast("int").alias("n_votes"))

    mine = Window.partitionBy("a")
    hits = _total([F.when(F.col("l") == k, F.col(f"c{k}")).otherwise(0.0) for k in ks])
    mass = _total([F.col(f"c{k}") for k in ks])
    shift = _total([(F.col("l") - k) * F.col(f"c{k}") for k in ks])
    annotators = m.where(real).groupBy("a").agg(F.sum(mass).alias("n_votes"), F.sum(hits).alias("h"), F.sum(shift).alias("d"))
    annotators = annotators.select(F.col("a").alias(annotator), F.round("n_votes").cast("bigint").alias("n_votes"), F.try_divide("h", "n_votes").alias("reliability"), F.try_divide("d", "n_votes").alias("bias"))
    return Consensus(labels, annotators, chance_corrected_agreement(given, "i", "l", classes), step + 1, moved)


def chance_corrected_agreement(votes: DataFrame, item: str, label: str, classes: int = 4) -> DataFrame:
    """Kappa of many raters (pairs within items against chance), over items with two votes or more; null if undefined."""
    ks = range(classes)
    per = votes.groupBy(item).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(label) == k, 1)).alias(f"n{k}") for k in ks]).where("n > 1")
    same = _total([F.col(f"n{k}") * (F.col(f"n{k}") - 1) for k in ks]) / (F.col("n") * (F.col("n") - 1))
    s = per.agg(F.count(F.lit(1)).alias("n_items"), F.avg(same).alias("observed"), F.sum("n").alias("n"), *[F.sum(f"n{k}").alias(f"n{k}") for k in ks])
    expected = _total([F.pow(F.try_divide(f"n{k}", "n"), 2) for k in ks])
    s = s.withColumn("expected", expected)
    return s.select("n_items", "observed", "expected", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))


def usable_grades(grades: DataFrame) -> DataFrame:
    """Earliest usable grade (0..3) of each (pid, assessor); equal times give the smaller grade, null times come last."""
    ok = grades.where("pid is not null and assessor is not null and grade between 0 and 3")
    first = ok.groupBy("pid", "assessor").agg(F.min(F.struct(F.col("graded_at").isNull().alias("late"), "graded_at", "grade")).alias("f"))
    return first.select("pid", F.col("assessor").alias("annotator"), F.col("f.grade").alias("grade"))


def round_grades(judged: DataFrame, pairs: DataFrame) -> DataFrame:
    """One vote per (pid, round); of several usable grades of a round the most frequent counts, then the smaller."""
    ok = judged.where("grade between 0 and 3 and round is not null").groupBy("qid", "doc_id", "round", "grade").count()
    one = ok.groupBy("qid", "doc_id", "round").agg(F.min(F.struct((-F.col("count")).alias("c"), "grade")).alias("f"))
    named = one.join(pairs.select("pid", "qid", "doc_id").distinct(), ["qid", "doc_id"])
    return named.select("pid", F.concat(F.lit("round:"), "round").alias("annotator"), F.col("f.grade").alias("grade"))
