"""Consensus on simulated annotators of known quality."""

import datetime
import random

from relevia.llm import consensus as C


def simulated(seed=3, items=300):
    r = random.Random(seed)
    truth = {f"p{i}": r.choices(range(4), [4, 3, 2, 1])[0] for i in range(items)}
    rows = []
    for p, t in truth.items():
        for a in r.sample(["good1", "good2", "good3", "invert", "random", "always2", "plus1"], 4):
            said = {"invert": 3 - t, "random": r.randrange(4), "always2": 2, "plus1": min(3, t + 1)}.get(a, t if r.random() < 0.9 else r.randrange(4))
            rows.append((p, a, said))
    return truth, rows


def test_beats_majority_and_ranks_annotators(spark):
    truth, rows = simulated()
    df = spark.createDataFrame([(*x, "extra") for x in rows], "pid string, annotator string, grade int, n string")
    c = C.consensus(df, "pid", "annotator", "grade")
    got = {x.pid: x.grade for x in c.labels.collect()}
    votes = {}
    for p, _, g in rows:
        votes.setdefault(p, []).append(g)
    majority = sum(max(sorted(set(v)), key=v.count) == truth[p] for p, v in votes.items()) / len(truth)
    right = sum(got[p] == t for p, t in truth.items()) / len(truth)
    assert set(got) == set(truth) and right > 0.88 and right > majority + 0.1
    trust = {x.annotator: x.reliability for x in c.annotators.collect()}
    assert min(trust["good1"], trust["good2"], trust["good3"]) > 0.75 > 0.5 > max(trust["invert"], trust["random"], trust["always2"])
    a = c.agreement.first()
    assert a.n_items == 300 and -1 < a.kappa < a.observed < 1
    assert 4 <= c.rounds <= 24 and (c.moved < 1e-3 or c.rounds == 24)


def test_nulls_impossible_labels_repeats_and_empty(spark):
    kind = "pid string, annotator string, grade int"
    df = spark.createDataFrame([("a", "x", 2), ("a", "x", 2), ("a", None, 1), (None, "x", 1), ("b", "y", None), ("b", "y", 9), ("c", "y", 0)], kind)
    assert {(x.pid, x.n_votes) for x in C.consensus(df, "pid", "annotator", "grade").labels.collect()} == {("a", 1), ("c", 1)}
    none = C.consensus(spark.createDataFrame([], kind), "pid", "annotator", "grade")
    assert none.labels.count() == 0 and none.annotators.count() == 0 and none.agreement.first().kappa is None


def test_agreement_by_hand(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 1), ("c", 3)], "pid string, grade int")
    r = C.chance_corrected_agreement(df, "pid", "grade").first()
    assert (r.n_items, r.observed, r.expected, r.kappa) == (2, 1.0, 0.5, 1.0)


def test_earliest_usable_grade_and_rounds(spark):
    t = [datetime.datetime(2026, 1, d) for d in (1, 2, 3)]
    g = spark.createDataFrame([("p", 9, "a", t[0]), ("p", 2, "a", t[2]), ("p", 1, "a", t[1]), ("p", 3, "b", None), (None, 1, "a", t[0])], "pid string, grade int, assessor string, graded_at timestamp")
    assert {tuple(x) for x in C.usable_grades(g).collect()} == {("p", "a", 1), ("p", "b", 3)}
    j = spark.createDataFrame([("q", "d", 1, "old"), ("q", "d", 1, "old"), ("q", "d", 3, "old"), ("q", "d", None, "new"), ("x", "d", 2, "old")], "qid string, doc_id string, grade int, round string")
    p = spark.createDataFrame([("p", "q", "d")], "pid string, qid string, doc_id string")
    assert [tuple(x) for x in C.round_grades(j, p).collect()] == [("p", "round:old", 1)]
