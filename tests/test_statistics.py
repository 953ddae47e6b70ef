"""Grades, agreement, bootstrap, sign test, ROC and thresholds by hand."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from relevia.operators import grades as G
from relevia.operators import inference as I
from relevia.plans import evaluation


def kappa(spark, a, b):
    return G.weighted_kappa(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first()


def test_kappa(spark):
    assert kappa(spark, [0, 1, 2, 3, 3], [0, 1, 2, 3, 3]).kappa == pytest.approx(1.0)
    assert kappa(spark, [0, 3, 0, 3], [3, 0, 3, 0]).kappa < 0
    assert kappa(spark, [0, 0, 3, 3], [0, 1, 3, 3]).kappa == pytest.approx(0.9375)
    assert kappa(spark, [1, 1], [1, 1]).kappa is None
    assert G.weighted_kappa(spark.createDataFrame([], "a int, b int"), "a", "b").first().n == 0


def test_opinions(spark):
    t = [datetime.datetime(2026, 1, d) for d in (1, 2)]
    kind = "pid string, grade int, assessor string, graded_at timestamp"
    a = G.first_opinion(spark.createDataFrame([("p", 2, "x", t[1]), ("p", 3, "y", t[0]), ("p", 9, "z", None), (None, 1, "x", t[0]), ("s", None, "x", t[0])], kind))
    assert [tuple(r) for r in a.collect()] == [("p", 3)]
    b, c = spark.createDataFrame([("p", 1)], "pid string, grade int"), spark.createDataFrame([("p", 2)], "pid string, grade int")
    m = G.merge_opinions(a, b, c)
    assert tuple(m.first()) == ("p", 3, 1, 2) and G.conflicts(m).count() == 1
    assert G.conflicts(spark.createDataFrame([("p", 1, 0, 1), ("q", 3, 3, 3), ("r", 2, None, 2)], "pid string, grade_a int, grade_b int, grade int")).count() == 0


def test_gold_before_rounds_and_foreign_pairs(spark):
    g = spark.createDataFrame([("q", "d", 3), ("q", "n", None)], "qid string, doc_id string, grade int")
    j = spark.createDataFrame([("q", "d", 0, "a"), ("q", "e", 2, "b"), ("q", "e", 1, "a"), ("q", "n", 1, None)], "qid string, doc_id string, grade int, round string")
    r = G.resolve(g, j)
    assert {tuple(x) for x in r.collect()} == {("q", "d", 3), ("q", "e", 1), ("q", "n", 1)}
    c = spark.createDataFrame([("q", "x", "s", "t"), ("q", "y", "s", "s"), ("q", "d", "s", "t")], "qid string, doc_id string, query_dataset string, doc_dataset string")
    ok = spark.createDataFrame([("s", "s")], "query_dataset string, doc_dataset string")
    assert [tuple(x) for x in G.foreign_zero(c, ok, r).collect()] == [("q", "x", 0)]


def test_batches_and_strata(spark):
    df = spark.range(203).select(F.col("id").cast("string").alias("pid"), (F.col("id") % 3 == 0).alias("s"))
    sizes = G.batches(df, "pid", 40).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in sizes) == [(0, 40), (1, 40), (2, 40), (3, 40), (4, 40), (5, 3)]
    got = {r.s: r["count"] for r in G.stratified(df, "s", "pid", 30).groupBy("s").count().collect()}
    assert got == {True: 10, False: 20}


@pytest.mark.parametrize("rng", ["mt", "hash"])
def test_bootstrap(spark, rng):
    df = spark.range(40).select((F.col("id") % 2).cast("double").alias("x"), F.col("id").cast("string").alias("q"), F.floor(F.col("id") / 2).cast("string").alias("pair"))
    r = I.bootstrap(df, "x", "q", 500, rng=rng).first()
    assert r["mean"] == 0.5 and r.lo < 0.5 < r.hi
    assert tuple(I.bootstrap(df, "x", "pair", 500, rng=rng).first()) == (0.5, 0.5, 0.5)
    assert tuple(I.bootstrap(df.where("false"), "x", "q", 50, rng=rng).first()) == (None, None, None)


def test_sums_before_and_cluster_numbers_by_ranges(spark):
    keys = [None, *sorted(f"k{i * 7919 % 1000:03}" for i in range(200))]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, v long").repartition(6)
    for ranges in (None, 1, 7):
        got = {r.key: (r.n, r.s) for r in I.sums_before(df, "key", {"n": F.lit(1), "s": F.col("v")}, ranges).collect()}
        assert got == {k: (i, i * (i - 1) // 2) for i, k in enumerate(keys)}
    sums = I.cluster_sums(df, "v", "key")
    assert sorted((r.k, r.s, r.c) for r in sums.collect()) == [(i, i, 1) for i in range(201)]
    assert not re.search(r"windowspecdefinition\(key#", sums._jdf.queryExecution().optimizedPlan().toString())


def test_full_interval_takes_2000_replicates(spark, monkeypatch):
    df = spark.range(40).select(F.lit("P4").alias("run_id"), F.col("id").cast("string").alias("qid"), (F.col("id") % 2).cast("double").alias("ndcg"))
    monkeypatch.setattr(evaluation, "per_query", lambda *_: df)
    monkeypatch.setattr(evaluation, "clusters", lambda *_: df.select("qid", F.col("qid").alias("cluster")))
    want = I.bootstrap(df, "ndcg", "qid", 2000).first()
    assert tuple(evaluation.QUERIES["bootstrap_interval_full"](spark, "").first()) == tuple(round(x, 6) for x in want)


def test_draws_of_the_standard_generator(spark):
    got = {(r.rep, r.k): r.m for r in I.draws(spark, 5, 2, rng="mt").collect()}
    want = {}
    for i, k in enumerate([2, 1, 4, 0, 3, 4, 4, 1, 4, 3]):
        want[i // 5, k] = want.get((i // 5, k), 0) + 1
    assert got == want


def test_sign(spark):
    df = spark.createDataFrame([(8, 2), (5, 5), (10, 0), (0, 0)], "w long, l long")
    assert [round(r.p, 6) for r in df.select(I.sign_test(F.col("w"), F.col("l")).alias("p")).collect()] == [0.109375, 1.0, 0.001953, 1.0]


@pytest.mark.parametrize(("pos", "neg", "want"), [([3, 4], [1, 2], 1.0), ([1, 2], [3, 4], 0.0), ([1], [1], 0.5), ([0.9, 0.8, 0.4], [0.7, 0.4], 0.75), ([1], [], None)])
def test_auc(spark, pos, neg, want):
    rows = [(float(x), True) for x in pos] + [(float(x), False) for x in neg]
    assert I.roc_auc(spark.createDataFrame(rows, "s double, p boolean"), "s", "p").first().auc == (want if want is None else pytest.approx(want))


def test_threshold(spark):
    rows = [(float(x), True) for x in range(20, 40)] + [(float(x), False) for x in range(25)]
    df = spark.createDataFrame(rows, "s double, p boolean")
    r = I.threshold(df, "s", "p").first()
    assert (r.tau, r.loss, r.empty) == (21.0, 0.05, 21 / 25)
    assert tuple(I.threshold(df.where("p"), "s", "p").first())[1:] == (None, None) or I.threshold(df.where("p"), "s", "p").first().empty is None


def test_scores_are_ordered_within_ranges(spark):
    df = spark.createDataFrame([(float(i * 37 % 500), i % 3 > 0) for i in range(500)] + [(None, True), (float("nan"), False)], "s double, p boolean").repartition(5)
    auc, best = I.roc_auc(df, "s", "p"), I.threshold(df, "s", "p", 0.1)
    rows = [(float(i * 37 % 500), i % 3 > 0) for i in range(500)]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    assert auc.first().auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    want = max((sum(b < t for b in neg) / len(neg), t) for t, _ in rows if sum(a < t for a in pos) / len(pos) <= 0.1)
    assert (best.first().empty, best.first().tau) == want
    for df in (auc, best):
        assert not re.search(r"windowspecdefinition\((s#|tau#|0)", df._jdf.queryExecution().optimizedPlan().toString())
