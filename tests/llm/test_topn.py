"""Top N per group against brute force."""

import math
import random

from relevia.llm.topn import result_documents, top_n_per_group


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or math.isnan(s):
            continue
        best[g, i] = max(s, best.get((g, i), -math.inf))
    out = []
    for g in {k[0] for k in best}:
        top = sorted(((-s, i) for (h, i), s in best.items() if h == g), key=lambda x: (x[0], x[1].encode()))[:n]
        out += [(g, i, -s, r) for r, (s, i) in enumerate(top, 1)]
    return sorted(out)


def test_matches_brute_force_with_a_hot_group_ties_and_nulls(spark):
    r = random.Random(1)
    rows = [("hot", f"d{r.randrange(400)}", r.choice([0.1, 0.2, 0.3, -1.0])) for _ in range(3000)]
    rows += [(f"g{r.randrange(50)}", f"Документ {r.randrange(30)}", r.random()) for _ in range(500)]
    rows += [(None, "x", 1.0), ("a", None, 1.0), ("a", "x", None), ("a", "y", float("nan")), ("a", "z", -0.5), ("a", "z", -0.5)]
    df = spark.createDataFrame([(*x, 7) for x in rows], "q string, d string, s double, rank_no int")
    got = sorted(tuple(x) for x in top_n_per_group(df, "q", "d", "s", 10, salts=8).collect())
    assert got == brute(rows, 10)


def test_empty_table(spark):
    df = spark.createDataFrame([], "q string, d string, s double")
    out = top_n_per_group(df, "q", "d", "s", 3)
    assert out.columns == ["q", "d", "s", "rank_no"] and out.count() == 0


def test_documents_of_results(spark):
    result = "array<struct<absolute_path string, score double, chunks array<struct<content string, score double>>, duplicates array<string>>>"
    rows = [
        ("q", 200, [("/a/corpus/x/corpus/y.pdf", 1.0, [], []), ("file:///b/corpus/z.txt", None, None, None), ("nowhere.txt", 2.0, [], [])]),
        ("q", 500, [("/a/corpus/no.pdf", 1.0, [], [])]),
        (None, 200, [("/a/corpus/no.pdf", 1.0, [], [])]),
        ("q", 200, None),
        ("q", 200, []),
    ]
    got = {(x.qid, x.doc_id, x.score) for x in result_documents(spark.createDataFrame(rows, f"qid string, http int, results {result}")).collect()}
    assert got == {("q", "x/corpus/y.pdf", 1.0), ("q", "z.txt", None), ("q", "nowhere.txt", 2.0)}
