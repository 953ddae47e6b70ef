"""Families against union-find, and proportions of the splits."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relevia.llm import splits as S


def union_find(rows):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, t in rows:
        root(k)
        if t is not None:
            up[root(k)] = root(t)
    least = {}
    for x in list(up):
        least[root(x)] = min(x, least.get(root(x), x))
    return {k: least[root(k)] for k, _ in rows}


def check(spark, rows):
    df = spark.createDataFrame([(k, k, t, "v") for k, t in rows], "qid string, key string, link string, root string")
    got = {x.qid: x.group_key for x in S.families(df, "qid", "key", "link").collect()}
    assert got == union_find(rows)


def test_hub_chain_and_singles(spark):
    rows = [(f"h{i:03}", "hub") for i in range(60)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("s1", None), ("s2", "s2"), ("s1", None), ("x", "outside"), ("y", "outside"), ("c10", "h005")]
    check(spark, rows)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefghijkl"), st.sampled_from([*"abcdefghijkl", None])), min_size=1, max_size=14))
def test_random_links(spark, rows):
    check(spark, rows)


def test_forest_has_no_cycle(spark):
    r = random.Random(2)
    edges = {(a, b) for a, b in ((f"v{r.randrange(40):02}", f"v{r.randrange(40):02}") for _ in range(80)) if a != b}
    forest, labels = S.spanning_forest(spark.createDataFrame(list(edges), "a string, b string"))
    assert forest.distinct().count() == labels.count() - labels.select("root").distinct().count()


def test_empty_and_nulls(spark):
    kind = "qid string, key string, link string"
    assert S.families(spark.createDataFrame([], kind), "qid", "key", "link").count() == 0
    got = S.families(spark.createDataFrame([(None, None, "a"), ("b", "b", None)], kind), "qid", "key", "link").collect()
    assert [tuple(x) for x in got] == [("b", "b")]


def test_spellings(spark):
    df = spark.createDataFrame([(" Q_00ff\t",), ("AI_00ff",), ("Zx_1  ",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(S.identifier(F.col("x"))).collect()] == ["ai_00ff", "ai_00ff", "zx_1", None, ""]


def test_splits_keep_groups_and_proportions(spark):
    r = random.Random(4)
    rows = [(f"g{i:04}",) for i in range(600) for _ in range(r.choice([1, 1, 1, 2, 3, 8]))] + [("big",)] * 700
    df = spark.createDataFrame(rows, "g string")
    got = S.deal_splits(df, "g").collect()
    assert len(got) == 601 and len({x.g for x in got}) == 601
    for lo, hi in ((1, 1), (2, 3), (8, 15)):
        band = [x.split for x in got if lo <= x["size"] <= hi]
        for part, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
            assert abs(band.count(part) - share * len(band)) <= 1.5
    assert S.deal_splits(spark.createDataFrame([], "g string"), "g").count() == 0
