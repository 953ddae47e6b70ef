"""Ranking metrics by hand, and the run operators."""

import datetime
from math import log2

import pytest

from relevia.operators import ranking as R

J = [("q", "a", 3), ("q", "b", 2), ("q", "c", 1), ("q", "z", 0)]


def scored(spark, docs, grades=J, spine=("q",)):
    run = spark.createDataFrame([("r", "q", i, d) for i, d in enumerate(docs, 1)] or [("r", "other", 1, "a")], "run_id string, qid string, rank int, doc_id string")
    g = spark.createDataFrame(grades, "qid string, doc_id string, grade int")
    return R.per_query(run, g, spark.createDataFrame([(q,) for q in spine], "qid string")).collect()


@pytest.mark.parametrize(
    ("docs", "metric", "want"),
    [
        ("abc", "ndcg", 1.0),
        ("xba", "ndcg", (2 / log2(3) + 3 / 2) / (3 + 2 / log2(3) + 1 / 2)),
        ("c", "ndcg", 1 / (3 + 2 / log2(3) + 1 / 2)),
        ("cx", "hit_1", 0),
        ("cx", "mrr", 0),
        ("cb", "hit_k", 1),
        ("cxb", "mrr", 1 / 3),
        ("bc", "recall", 0.5),
        ("ab", "recall", 1.0),
        ("klmnopqrsta", "hit_k", 0),
        ("klmnopqrsta", "mrr", 0),
        ("xyb", "unjudged", 2),
        ("", "recall", 0),
    ],
)
def test_metrics_by_hand(spark, docs, metric, want):
    assert scored(spark, docs)[0][metric] == pytest.approx(want)


def test_answerable_and_missing_query(spark):
    g = spark.createDataFrame([*J, ("q2", "c", 1)], "qid string, doc_id string, grade int")
    assert [r.qid for r in R.answerable(g).collect()] == ["q"]
    assert [r.qid for r in R.indexed_answerable(g, spark.createDataFrame([("c",)], "doc_id string")).collect()] == []
    rows = {r.qid: r for r in scored(spark, "a", spine=("q", "q9"))}
    assert rows["q9"].ndcg == rows["q9"].mrr == 0 and rows["q"].hit_1 == 1


RESULTS = "array<struct<absolute_path string, score double, chunks array<struct<content string, score double>>, duplicates array<string>>>"


def test_ranking_takes_the_last_response_and_first_places(spark):
    t = [datetime.datetime(2026, 1, d) for d in (1, 2)]
    hit = lambda d, s: (f"/x/corpus/{d}", s, [], [])
    rows = [
        ("r", "q", 200, 1.0, t[0], t[0], [hit("old", 9.0)]),
        ("r", "q", 200, 1.0, t[1], t[1], [hit("b", 0.1), hit("a", float("nan")), hit("b", 5.0), (None, 1.0, [], []), hit("c", None)]),
        ("r", "q", 500, 1.0, t[1], t[1], [hit("no", 1.0)]),
        (None, "q", 200, 1.0, t[1], t[1], [hit("no", 1.0)]),
        ("r", "e", 200, 1.0, t[1], t[1], []),
        ("r", "n", 200, 1.0, t[1], t[1], None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], f"run_id string, qid string, http int, ms double, asked_at timestamp, received_at timestamp, results {RESULTS}, rank string")
    assert [tuple(x) for x in R.ranking_of(df).orderBy("rank").select("qid", "doc_id", "rank", "score").collect()] == [("q", "b", 1, 0.1), ("q", "a", 2, None), ("q", "c", 3, None)]
    assert R.ranking_of(df.where("false")).count() == 0


def test_comparing_runs(spark):
    t = spark.createDataFrame([("A", "q1", 0.5), ("A", "q2", 0.2), ("B", "q1", 0.7), ("B", "q2", 0.2)], "run_id string, qid string, ndcg double")
    p = R.paired(t, "A", "B", ["ndcg"])
    assert {r.qid: round(r.ndcg_delta, 9) for r in p.collect()} == {"q1": 0.2, "q2": 0.0}
    assert [tuple(x)[:2] for x in R.movers(p, "ndcg_delta").collect()] == [("gain", "q1")]
    run = spark.createDataFrame([("A", "q", 1, "a"), ("A", "q", 2, "b"), ("B", "q", 1, "b"), ("B", "q", 2, "a")], "run_id string, qid string, rank int, doc_id string")
    assert tuple(R.same_lists(run, "A", "B").first()) == (1, 0, 1, 0)
    g = spark.createDataFrame([("q", "a", 0)], "qid string, doc_id string, grade int")
    assert {tuple(x) for x in R.optimistic(run, g).collect()} == {("q", "a", 0), ("q", "b", 2)}


def test_promotion_and_collapse(spark):
    run = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")], "qid string, rank int, doc_id string")
    hits = spark.createDataFrame([("q", "new", 1), ("q", "c", 2), ("q", "c", 2)], "qid string, doc_id string, hit_no int")
    assert [r.doc_id for r in R.promote(run, hits).orderBy("rank").collect()] == ["c", "new", "a", "b"]
    chunks = spark.createDataFrame([("q", i, d, "card" if i == 1 else "text") for i, d in enumerate("aababc", 1)], "qid string, rank int, doc_id string, kind string")
    assert [r.doc_id for r in R.collapse_chunks(chunks, 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.doc_id for r in R.collapse_chunks(chunks, 2, documents_first=False).collect()] == ["a"]
    assert R.fragments(chunks, 1).count() == 3
