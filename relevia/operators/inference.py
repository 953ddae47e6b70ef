"""Statistics over per-query tables: cluster bootstrap, sign test, ROC, thresholds."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevia.sources import materialize


def sums_before(rows: DataFrame, order: str, sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with the sums over all rows of smaller ``order``, whose values differ from row to row; nulls come first.

    Rows are sorted within ranges, and the ranges' totals give what lies before a range; ``ranges`` defaults to Spark's
    own number. The ranges are a table, as sampling could set their bounds anew."""
    cut = rows.repartitionByRange(ranges, order) if ranges else rows.repartitionByRange(order)
    r = materialize(cut.withColumn("__range", F.spark_partition_id()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = r.groupBy("__range").agg(*[F.sum(v).alias(f"__{c}") for c, v in sums.items()])
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums])
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = r.withColumns({c: F.coalesce(F.sum(v).over(within), F.lit(0)) for c, v in sums.items()}).join(F.broadcast(offsets), "__range")
    return out.withColumns({c: F.col(c) + F.col(f"__{c}") for c in sums}).drop("__range", *[f"__{c}" for c in sums])


def cluster_sums(table: DataFrame, value: str, cluster: str) -> DataFrame:
    """(k, s, c): sum and count per cluster, numbered from 0 in byte order of the key; null values are left out."""
    rows = table.where(F.col(value).isNotNull()).groupBy(F.col(cluster).cast("string").alias("key"))
    sums = rows.agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    return sums_before(sums, "key", {"k": F.lit(1)}).select(F.col("k").cast("int").alias("k"), "s", "c")


def draws(spark: SparkSession, clusters: int, n: int, seed: int = 20260925, rng: str = "hash") -> DataFrame:
    """(rep, k, m): how often replicate ``rep`` draws cluster ``k``.

    ``hash`` takes 15 hexadecimal digits of MD5('rep-slot') modulo the clusters, made by Spark and alike in every
    engine; ``mt`` the standard library's generator, whose n x clusters numbers come from one sequence."""
    if rng == "hash":
        slots = spark.range(n).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))).alias("slot"))
        k = F.conv(F.left(F.md5(F.concat_ws("-", F.col("rep").cast("string"), F.col("slot").cast("string")).cast("binary")), F.lit(15)), 16, 10).cast("bigint") % clusters
        return slots.select("rep", k.cast("int").alias("k")).groupBy("rep", "k").agg(F.count(F.lit(1)).alias("m"))
    made = random.Random(seed)
    rows = [(r, made.randrange(clusters)) for r in range(n) for _ in range(clusters)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["rep", "k"])).groupBy("rep", "k").agg(F.count(F.lit(1)).alias("m"))


def bootstrap(table: DataFrame, value: str, cluster: str, n: int = 2000, alpha: float = 0.05, seed: int = 20260925, rng: str = "hash") -> DataFrame:
    """One row (mean, lo, hi): the mean over queries with percentile bounds over whole clusters drawn with replacement.

    Queries are summed per cluster first, so a replicate moves clusters, not queries. Nulls for an empty table."""
    sums = cluster_sums(table, value, cluster).persist()
    size = sums.count()
    mean = sums.agg(F.try_divide(F.sum("s"), F.sum("c")).alias("mean"))
    if not size:
        return mean.select("mean", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    # Spark takes the draws for the few rows they are made of, and would broadcast them.
    reps = draws(table.sparkSession, size, n, seed, rng).hint("merge").join(sums, "k").groupBy("rep").agg((F.sum(F.col("m") * F.col("s")) / F.sum(F.col("m") * F.col("c"))).alias("x"))
    ranked = F.sort_array(F.collect_list("x"))  # n numbers
    bounds = reps.agg(F.get(ranked, F.lit(int(n * alpha / 2))).alias("lo"), F.get(ranked, F.lit(min(n - 1, int(n * (1 - alpha / 2))))).alias("hi"))
    return mean.join(bounds, F.lit(True))


def bootstrap_by(table: DataFrame, by: str, values: list[str], cluster: str, n: int = 2000, alpha: float = 0.05) -> DataFrame:
    """(by, value, mean, lo, hi) for several columns and slices at once, whose clusters are drawn together.

    Clusters are numbered once over the whole table; a replicate of a slice uses the drawn clusters that it has."""
    keys = sums_before(table.select(F.col(cluster).cast("string").alias("c")).distinct(), "c", {"k": F.lit(1)}).select("c", F.col("k").cast("int").alias("k"))
    long = table.select(F.col(cluster).cast("string").alias("c"), F.col(by).alias("g"), F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("x")) for v in values])).alias("e"))
    sums = long.where("e.x is not null").groupBy("c", "g", F.col("e.value").alias("value")).agg(F.sum("e.x").alias("s"), F.count(F.lit(1)).alias("m"))
    sums = materialize(sums.join(keys, "c").drop("c"))
    size = keys.count()
    mean = sums.groupBy("g", "value").agg((F.sum("s") / F.sum("m")).alias("mean"))
    if not size:
        return mean.select(F.col("g").alias(by), "value", "mean", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    d = draws(table.sparkSession, size, n).withColumnRenamed("m", "times").hint("merge")
    reps = d.join(sums, "k").groupBy("g", "value", "rep").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("m"))).alias("x"))
    ranked = F.sort_array(F.collect_list("x"))  # n numbers
    bounds = reps.groupBy("g", "value").agg(F.get(ranked, F.lit(int(n * alpha / 2))).alias("lo"), F.get(ranked, F.lit(min(n - 1, int(n * (1 - alpha / 2))))).alias("hi"))
    return mean.join(bounds, ["g", "value"]).withColumnRenamed("g", by)


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test; 1 without wins and losses.

    The binomial's terms are summed as powers of logarithms, so a million wins don't overflow; terms more than 60 roots of
    n below the smaller side vanish in double precision and aren't made."""
    k, n = F.least(wins, losses).cast("bigint"), (wins + losses).cast("bigint")

    def tail(x: Column) -> Column:
        low = F.greatest(F.lit(0).cast("bigint"), x["k"] - F.ceil(60 * F.sqrt(x["n"])))
        log_n = log_factorial(x["n"]) - x["n"] * F.log(F.lit(2.0))
        term = lambda i: F.exp(log_n - log_factorial(i) - log_factorial(x["n"] - i))
        return F.aggregate(F.sequence(low, x["k"]), F.lit(0.0), lambda s, i: s + term(i))

    p = F.get(F.transform(F.array(F.struct(k.alias("k"), n.alias("n"))), tail), F.lit(0))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * p))


def log_factorial(n: Column) -> Column:
    """The logarithm of n!: exact up to 20, then Stirling's series, whose error is below 1e-12."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def compare(pairs: DataFrame, by: list[str], value: str, dead: float = 1e-9) -> DataFrame:
    """Per slice: n, both means, their difference, wins, losses and the sign test."""
    d = F.col(f"{value}_delta")
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(f"{value}_a").alias("mean_a"), F.avg(f"{value}_b").alias("mean_b"), F.avg(d).alias("delta"), F.count_if(d > dead).alias("wins"), F.count_if(d < -dead).alias("losses"))
    return g.withColumn("p", sign_test(F.col("wins"), F.col("losses")))


def roc_auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row (auc): from average ranks, ties half; null if one side is empty.

    Scores are grouped first, and the distinct ones are ordered within ranges."""
    g = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    g = sums_before(g, "s", {"below": F.col("q")}).withColumn("won", F.col("p") * (F.col("below") + F.col("q") / 2.0))
    return g.agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("q")).alias("auc"))


def threshold(rows: DataFrame, score: str, positive: str, max_loss: float = 0.05) -> DataFrame:
    """One row (tau, loss, empty): the largest of the best thresholds that lose at most ``max_loss`` of the positives.

    empty is the share of negatives below tau. (null, 0, 0) if no threshold does any good; nulls if a side is empty."""
    g = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("tau")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    g = sums_before(g, "tau", {"lost": F.col("p"), "below": F.col("q")})
    g = g.join(F.broadcast(g.agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))), F.lit(True))  # one row
    g = g.select("tau", F.try_divide("lost", "ps").alias("loss"), F.try_divide("below", "qs").alias("empty"))
    best = g.agg(F.max(F.when(F.col("loss") <= max_loss, F.struct("empty", "tau", "loss"))).alias("m"), F.count(F.lit(1)).alias("n"), F.max("loss").alias("l"), F.max("empty").alias("e"))
    undefined = (F.col("n") > 0) & (F.col("l").isNull() | F.col("e").isNull())
    zero = F.when(~undefined, F.lit(0.0))
    return best.select(F.col("m.tau").alias("tau"), F.coalesce("m.loss", zero).alias("loss"), F.coalesce("m.empty", zero).alias("empty"))
