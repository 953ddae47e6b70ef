"""Order, names, copies, samples, shapes and Markdown on small tables."""

from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.operators import judging as J
from relevia.operators import retrieval as S
from relevia.operators import structure as O


def test_column_groups(spark):
    h = spark.createDataFrame([("t", 0, None), ("t", 1, "2024"), ("t", 2, " "), ("t", 3, "2025"), ("t", 4, None), ("u", 0, "x")], "tbl string, col int, label string")
    assert {tuple(x) for x in O.column_groups(h).collect()} == {("t", "2024", 1, 2), ("t", "2025", 3, 4), ("u", "x", 0, 0)}
    assert O.column_groups(h.where("false")).count() == 0


def test_picks_and_rounds(spark):
    r = spark.createDataFrame([("d", i) for i in range(10)] + [("e", 5), (None, 1)], "doc string, page int")
    assert {(x.doc, x.page) for x in O.every_nth(r, "doc", ["page"], 4).collect()} == {("d", 0), ("d", 4), ("d", 8), ("e", 5), (None, 1)}
    keys = spark.createDataFrame([(f"k{i:02}",) for i in range(11)] + [("k03",), (None,)], "k string")
    assert {x.k: x.part for x in O.round_robin(keys, "k", 3).collect()} == {f"k{i:02}": i % 3 for i in range(11)}
    t = spark.createDataFrame([("a", 1), ("a", 9), ("b", 9), ("c", 3), ("d", None), (None, 10)], "k string, t int")
    assert [tuple(x) for x in O.latest(t, "k", "t", 2).collect()] == [("a", 9), ("b", 9)]


def test_chapters_copies_and_known_keys(spark):
    c = spark.createDataFrame([("2.1",), ("2.10",), ("10.1",), ("2.1",), ("A.3",), (None,)], "p string")
    assert {tuple(x) for x in O.chapters(c, "p").collect()} == {("2", 2, 2), ("10", 10, 1), ("A", 999, 1)}
    t = spark.createDataFrame([(1, "Один  два"), (2, "один два "), (3, "три"), (4, None), (None, "три"), (2, "один два ")], "k int, t string")
    kept = O.copies(t, "k", "t")
    assert {tuple(x) for x in kept.collect()} == {(1, 1), (2, 1)}
    assert sorted(x.k for x in O.remapped(spark.createDataFrame([(2,), (3,)], "k int"), "k", kept).collect()) == [1, 3]
    asked = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a"), ("s", None), ("t", "a"), ("t", None), (None, "a")], "q string, k string")
    got = {x.q: (x["keys"], x.complete) for x in O.all_known(asked, "q", "k", spark.createDataFrame([("a",), ("a",)], "k string")).collect()}
    assert got == {"q": (2, False), "r": (1, True), "s": (0, False), "t": (1, False)}


def test_means_parameters_counts_and_names(spark):
    v = spark.createDataFrame([(i, i) for i in range(50)], "k int, v int")
    assert tuple(O.sampled_mean(v, "k", F.col("v"), 100).first()) == (50, 24.5) and O.sampled_mean(v, "k", F.col("v"), 7).first().n == 7
    m = spark.createDataFrame([({"a": "1", "b": None}, {"a": "1", "b": None, "c": "2"}), ({"a": "1"}, {"a": "2"}), ({"a": "1"}, None), ({}, None)], "w map<string,string>, g map<string,string>")
    assert [x[0] for x in m.select(O.meets(F.col("w"), F.col("g"))).collect()] == [True, False, False, True]
    n = O.rows_per_key(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string"), "k", spark.createDataFrame([("a",), ("a",), ("c",)], "k string"))
    assert {tuple(x) for x in n.collect()} == {("a", 2), ("b", 0)}
    f = spark.createDataFrame([("1", "x", "Отчёт: 1", "pdf"), ("2", "x", "отчёт 1", "pdf"), ("3", "x", "Отчёт 1", "txt"), ("4", "y", "Отчёт 1", "")], "k string, f string, t string, s string")
    assert {x.k: x.name for x in O.file_names(f, "k", F.col("f"), F.col("t"), F.col("s")).collect()} == {"1": "Отчёт 1.pdf", "2": "отчёт 1 (2).pdf", "3": "Отчёт 1.txt", "4": "Отчёт 1"}


def test_rows_in_one_unit(spark):
    r = spark.createDataFrame([(1, "t", ["a", "b"]), (2, "t", ["a", "c"]), (3, "u", ["a"]), (4, None, ["a"]), (5, "t", [])], "row int, g string, cells array<string>")
    u = spark.createDataFrame([(1, "t", "a x b"), (2, "t", "c"), (3, None, "a")], "unit int, g string, text string")
    assert {tuple(x) for x in O.rows_in_one(r, u, "cells", "g").collect()} == {(1, 2, True), (2, 2, False), (3, 1, False)}


def test_shapes_and_markdown(spark):
    def one(column, **values):
        return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x

    t = F.col("t")
    assert tuple(one(T.dated_start(t), t="от 12.05.2023 Вопрос")) == ("12.05.2023", "Вопрос") and tuple(one(T.dated_start(t), t="Вопрос")) == (None, "Вопрос")
    assert tuple(one(T.period_of(t), t="бюллетень_2024_05")) == (2024, 5) and tuple(one(T.period_of(t), t="отчёт 2023")) == (2023, None) and tuple(one(T.period_of(t), t="x")) == (None, None)
    assert tuple(one(T.header_pair(t), t="Ключ: a: b")) == ("Ключ", "a: b") and tuple(one(T.header_pair(t), t="Ключ")) == ("Ключ", "")
    assert one(T.mentions_number(t, F.lit("5348-У")), t="акт 5348") and not one(T.mentions_number(t, F.lit("5348-У")), t="акт 53")
    assert [one(T.is_shape(t, s), t=v) for s, v in (("date", "2024-01-02"), ("date", "2024-01-02 x"), ("year", "2024"), ("note", "¹²"), ("marker", "1.2."), ("marker", "—"))] == [True, False, True, True, True, True]
    assert one(T.heading(t), t="Глава 1...") == "Глава 1" and one(T.heading(t), t=None) is None
    lines = {"| **a** | [b](u) | |": ("row", None, ["a", "b"]), "## Заголовок": ("head", None, ["заголовок"]), "12. Пункт «x»": ("num", "12.", ['пункт "x"']), "- _слово_ и snake_case": ("bullet", None, ["слово и snake_case"]), "> просто…": ("text", None, ["просто..."]), "|---|:--:|": None, "***": None, "": None}
    for line, want in lines.items():
        got = one(T.markdown_line(t), t=line)
        assert (got and tuple(got)) == want, line
    assert one(T.without(T.tokens(t), ["и"]), t="кот и пёс") == ["кот", "пес"] and one(T.without(T.tokens(t), []), t="и") == ["и"]


def test_fallback_and_shown_passages(spark):
    v = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.8, 2), ("r", 3, 0.5, 1)], "qid string, key int, score double, rank int")
    t = spark.createDataFrame([("q", 2, 7.0, 1)], "qid string, key int, score double, rank int")
    got = {(x.qid, x.key): (round(x.score, 6), x["rank"], x.fallback) for x in S.with_fallback(v, t).collect()}
    assert got == {("q", 2): (round(1 / 62 + 1 / 61, 6), 1, False), ("q", 1): (round(1 / 61, 6), 2, False), ("r", 3): (-0.5, 1, True)}
    found = spark.createDataFrame([("p", 1, "aaaX"), ("p", 2, "bbb"), ("p", 3, "ccc"), ("s", 1, "z")], "pid string, rank int, text string")
    extra = spark.createDataFrame([("p", 1, "aaaY"), ("p", 2, ""), ("p", 3, "eee"), ("p", 4, "fff")], "pid string, place int, text string")
    shown = {(x.pid, x.place): x.text for x in J.shown(found, extra, 2, 3).collect()}
    assert shown == {("p", 1): "aaa", ("p", 2): "eee", ("p", 3): "bbb", ("p", 4): "ccc", ("s", 1): "z"}


def test_positional_joins(spark):
    a, b = spark.createDataFrame([("x", 1), ("x", 2)], "p string, i int"), spark.createDataFrame([("x", 1), ("y", 1)], "p string, i int")
    assert {tuple(x) for x in O.same_keys(a, b, ["p", "i"]).collect()} == {("x", 2, "a"), ("y", 1, "b")} and O.same_keys(a, a, ["p", "i"]).count() == 0
    lines = spark.createDataFrame([("u", i, f"строка {i}") for i in range(5)] + [("u", 1, "строка 1")], "unit string, line int, text string")
    spans = spark.createDataFrame([("r", "u", 1, 2), ("s", "v", 0, 1)], "ref string, unit string, first int, last int")
    assert [tuple(x) for x in O.parallel_lines(spans, lines).collect()] == [("r", "строка 1\nстрока 2")]
    ex = spark.createDataFrame([(" Вопрос? ", "скан без слоя"), ("Другой?", "нет акта")], "query string, reason string")
    asked = spark.createDataFrame([("q1", "Вопрос?", "да", [("f1", "1-2"), ("f2", "3")]), ("q2", "Другой?", "нет", [("f3", "1")])], "qid string, question string, answer string, evidence array<struct<file:string,pages:string>>")
    assert {tuple(x) for x in O.excluded_evidence(ex, asked, "скан").collect()} == {("q1", "f1", "1-2", "да"), ("q1", "f2", "3", "да")}


def test_run_parameters_and_missing_designations(spark):
    kind = "run_id string, emulation map<string,string>, indices array<struct<type:string,details:map<string,string>>>"
    runs = spark.createDataFrame([("a", {"stem": "1"}, [("FTS", {"stem": "0"})]), ("b", None, [("IVF", {"x": "y"}), ("FTS", {"stem": "0"})]), ("c", None, None), ("d", None, [])], kind)
    assert {x.run_id: x.parameters for x in O.run_parameters(runs).collect()} == {"a": {"stem": "1"}, "b": {"stem": "0"}, "c": None, "d": None}
    asked = spark.createDataFrame([("q", "1-И"), ("q", "2-П"), ("q", "2-П"), ("r", "1-И"), (None, "1-И"), ("s", None)], "qid string, number string")
    gold = spark.createDataFrame([("q", "a"), ("q", "b"), ("s", "a")], "qid string, doc_id string")
    held = spark.createDataFrame([("b", "1-И"), ("c", "2-П")], "doc_id string, number string")
    assert [tuple(x) for x in O.missing_designations(asked, gold, held).collect()] == [("q", "2-П")]
