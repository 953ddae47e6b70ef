"""Pools, navigation questions and ties on small tables."""

from pyspark.sql import functions as F

from relevia.operators import judging as J


def test_pool_tells_runs_apart(spark):
    r = spark.createDataFrame([("A", "q", i, d) for i, d in enumerate("abcd", 1)] + [("B", "q", i, d) for i, d in enumerate("bace", 1)], "run_id string, qid string, rank int, doc_id string")
    g = spark.createDataFrame([("q", "b", 3)], "qid string, doc_id string, grade int")
    assert {x.doc_id for x in J.differing_pool(r, g).collect()} == {"a", "d", "e"}
    assert tuple(J.first_disagreement(r, g, "A", "B").first()) == (1, 1, 0, 1)
    assert J.differing_pool(r.where("false"), g).count() == 0


def test_navigation(spark):
    m = spark.createDataFrame([("x/Акт 5348-У.pdf", "О рисках"), ("x/Обзор.pdf", "обзор"), ("x/Акт 1-И.pdf", None)], "doc_id string, title string")
    c = spark.createDataFrame([("x/Обзор.pdf", "Порядок расчёта норматива"), ("x/Обзор.pdf", "Приложение"), ("x/Акт 1-И.pdf", " Общие для всех слова "), ("x/Обзор.pdf", "Общие для всех слова"), (None, "Ничей раздел из слов")], "doc_id string, section string")
    got = sorted((x.type, x.query) for x in J.navigation(m, c).collect())
    want = sorted([("name", "Акт 5348-У"), ("name", "Обзор"), ("name", "Акт 1-И"), ("title", "О рисках"), ("code", "5348-У"), ("code", "1-И"), ("heading", "Порядок расчёта норматива")])
    worded = {(kind, form.replace("{x}", x)): (kind, x) for kind, x in want for form in J.TEMPLATES[kind]}
    assert sorted(worded[k] for k in got) == want
    assert J.navigation(m.where("false"), c.where("false")).count() == 0


def test_named_documents(spark):
    m = spark.createDataFrame([(f"a/{n}.pdf",) for n in ("Акт 5348-У № 2", "Обзор obs_400", "Свод obs_400 2", "Акт 77-П", "Акт 77-П 1", "Акт 77-П 2", "Акт 77-П 3")], "doc_id string")
    q = spark.createDataFrame([("q", "Где «obs_400», и что в 5348-у?"), ("r", "акт 77-П"), ("s", "обзор 400"), ("t", None), (None, "obs_400")], "qid string, query string")
    got = sorted((x.qid, x.hit_no, x.doc_id) for x in J.named_documents(q, "qid", "query", m).collect())
    assert got == [("q", 1, "a/Обзор obs_400.pdf"), ("q", 2, "a/Свод obs_400 2.pdf"), ("q", 3, "a/Акт 5348-У № 2.pdf")]  # four documents hold 77-П


def test_ties_compare_with_the_first_of_their_group(spark):
    df = spark.createDataFrame([([0.5, 0.5000004, 0.4999996, 0.4999985, 0.1], ["d", "b", "c", "a", "e"]), ([], [])], "s array<double>, k array<string>")
    assert [r[0] for r in df.select(J.tie_groups(F.col("s"), F.col("k"))).collect()] == [[["b", "c", "d"], ["a"], ["e"]], []]


def test_passages_of_pairs(spark):
    p = spark.createDataFrame([("p", "кредит", "d"), ("r", "", "d"), ("s", "кредит", "none")], "pid string, need string, doc_id string")
    c = spark.createDataFrame([(1, "d", "кредит банка"), (2, "d", "вексель банка"), (3, "d", "кредит кредит"), (4, "d", ""), (5, "d", "дом банка"), (6, "e", "кредит")], "cid long, doc_id string, text string")
    assert [(x.pid, x.cid) for x in J.passages(p, c, 2).orderBy("rank").collect()] in ([("p", 3), ("p", 1)], [("p", 1), ("p", 3)], [])
