"""Windows, emitted text, answers, pages, stems."""

from math import comb

from pyspark.sql import functions as F

from relevia.functions import stem
from relevia.operators import answers as A
from relevia.operators import grades as G
from relevia.operators import inference as I
from relevia.operators import ranking as R
from relevia.operators import retrieval as S


def test_windows_against_a_loop(spark):
    texts = {1: ("Документ: x\nabcdef", 0), 2: ("efgh", 4), 3: ("ij", None), 4: ("klmn" * 600, 20), 5: ("z", 5000)}
    rows = [(c, "d", c * (600 if c > 3 else 1), t, s) for c, (t, s) in texts.items()]
    got = {x.cid: x.text for x in A.windows(spark.createDataFrame([*rows, rows[0]], "cid bigint, doc_id string, idx int, text string, char_start int"), 50).collect()}
    order = sorted(texts)
    for i, c in enumerate(order):
        parts = sorted(order[max(0, i - 1) : i + 2], key=lambda x: (texts[x][1] if texts[x][1] is not None else 10**12, x))
        text, end, at = "", None, {}
        for x in parts:
            t, s = texts[x][0].removeprefix("Документ: x\n"), texts[x][1]
            if end is not None and s is not None and s < end:
                cut = min(len(t), end - s)
                at[x] = len(text) - cut
                text += t[cut:]
            else:
                text += "\n" if text else ""
                at[x] = len(text)
                text += t
            end = max(end or 0, s + len(t)) if s is not None else None
        n = len(texts[c][0].removeprefix("Документ: x\n"))
        lo = max(0, min(len(text) - 50, at[c] + n // 2 - 25))
        assert got[c] == text[lo : lo + 50], c
    assert A.windows(spark.createDataFrame([], "cid bigint, doc_id string, idx int, text string, char_start int")).count() == 0


def test_answers_at(spark):
    e = spark.createDataFrame([("r", "q", "a", "раз два три четыре пять"), ("r", "q", "b", "шесть семь восемь девять"), ("s", "q", "b", "шесть")], "run_id string, qid string, doc_id string, emitted string")
    k = spark.createDataFrame([("r", "q", "a", 1), ("r", "q", "b", 2), ("s", "q", "b", 1), ("s", "p", "c", 1)], "run_id string, qid string, doc_id string, rank int")
    refs = spark.createDataFrame([("q", "b", "шесть семь восемь девять"), ("q", "a", "раз два"), ("p", "z", "один два три"), ("o", "z", "")], "qid string, doc_id string, passage string")
    got = {x.run_id: (x.n, x.answer_1, x.answer_3, x.document_3) for x in A.answers_at(e, k, refs).collect()}
    assert got == {"r": (2, 0.0, 0.5, 0.5), "s": (2, 0.0, 0.0, 0.5)}


def test_values_with_label_and_period(spark):
    df = spark.createDataFrame([("Челябинская область¹: 613,0 на 1 января 2025",), ("Челябинская область: 612,9 на 1 января 2025",), ("Челябинская область: 613",), (None,)], "t string")
    ok = A.value_in_text(F.col("t"), F.lit("Челябинская область1"), F.lit(613.0), F.lit("2025-01-01"))
    assert [x[0] for x in df.select(ok).collect()] == [True, False, False, False]
    loose = A.value_in_text(F.col("t"), F.lit("область"), F.lit(613.0), F.lit("9м24"))
    assert [x[0] for x in df.select(loose).collect()] == [True, False, True, False]


def test_pages(spark):
    long = "Банк обязан раскрыть величину базового капитала не позднее пятого числа."
    near = long.replace("пятого", "седьмого")
    rows = [("a", "Вопрос?", f"{long} Да.", f"x {long}"), ("b", "Вопрос?", f"{long} {long[:20]} другие слова совсем и ещё немного.", f"y {near}"), ("c", "Что это?", "Кратко.", "что это? ответ"), ("d", None, None, None)]
    got = {x.ref: (x.share, x.question_on_page, x.relevant) for x in A.on_page(spark.createDataFrame(rows, "ref string, question string, answer string, page string"), "ref").collect()}
    assert got == {"a": (1.0, False, True), "b": (0.5, False, False), "c": (None, True, True), "d": (None, False, False)}


def test_stems(spark):
    # Published examples of both algorithms.
    ru = {"важнейшими": "важн", "вагонов": "вагон", "вал": "вал", "варенье": "варен", "взглянула": "взглянул", "власть": "власт", "внимательный": "внимательн", "воспоминаний": "воспоминан", "павловна": "павловн", "падал": "пада", "подарок": "подарок", "пальцами": "пальц", "памятниками": "памятник", "парой": "пар", "пасть": "паст", "поднявшись": "подня", "неспособность": "неспособн", "хнычет": "хнычет", "": "", "бр": "бр"}
    df = spark.createDataFrame(list(ru.items()), "w string, s string")
    wrong = [tuple(x) for x in stem.stemmed(df, "w", "got").where("got <> s").collect()]
    assert not wrong
    en = {"consigned": "consign", "consistency": "consist", "knightly": "knight", "generally": "general", "relational": "relat", "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "organization": "organ", "reports": "report", "sky": "sky", "agreed": "agre", "at": "at"}
    assert {w: stem.english(w) for w in en} == en


def test_stemmed_index(spark):
    u = spark.createDataFrame([(1, "отчёты банков"), (2, "отчёт"), (3, "reports report")], "k bigint, t string")
    index = stem.stem_postings(S.postings(u, "k", "t"))
    assert {(x.key, x.term, x.tf, x.len) for x in index.collect()} == {(1, "отчет", 1, 2), (1, "банк", 1, 2), (2, "отчет", 1, 1), (3, "report", 2, 2)}


def test_repeat_classes(spark):
    kind = "qid string, docs array<struct<doc_id:string,score:double>>, scores array<double>"
    a = spark.createDataFrame([("e", [("x", 2.0), ("y", 1.0)], [2.0, 1.0]), ("t", [("y", 1.0), ("x", 1.0000001)], [1.0, 1.0]), ("c", [("x", 2.0), ("z", 1.0)], [1.0, 2.0]), ("o", [("x", 2.0)], [2.0])], kind)
    b = spark.createDataFrame([("e", [("x", 2.0), ("y", 1.0)], [1.0, 2.0]), ("t", [("x", 1.0), ("y", 1.0)], [1.0, 1.0]), ("c", [("x", 2.0), ("y", 1.0)], [1.0, 2.0]), ("o", [("x", 3.0)], [3.0]), ("m", [("x", 3.0)], [3.0])], kind)
    assert {x.qid: x.verdict for x in R.repeat_classes(a, b).collect()} == {"e": "exact", "t": "ties", "c": "cut", "o": "other", "m": "other"}


def test_place_metrics(spark):
    got = {x.type: (x.n, x.hit_1, x.hit_10, x.mrr) for x in R.place_metrics(spark.createDataFrame([("a", 1), ("a", 4), ("b", None), ("b", 11)], "type string, rank int"), "type").collect()}
    assert got == {"a": (2, 0.5, 1.0, 0.625), "b": (2, 0.0, 0.0, 0.0), "all": (4, 0.25, 0.5, 0.3125)}


def test_bootstrap_of_several_slices_equals_one_by_one(spark):
    rows = [(g, f"c{i % 7}", float((i * 13 + k) % 5), float(i % 3)) for k, g in enumerate("xy") for i in range(40)]
    t = spark.createDataFrame(rows, "g string, c string, a double, b double")
    got = {(x.g, x.value): (round(x.mean, 9), round(x.lo, 9), round(x.hi, 9)) for x in I.bootstrap_by(t, "g", ["a", "b"], "c", n=50).collect()}
    for g in "xy":
        for v in "ab":
            one = I.bootstrap(t.where(F.col("g") == g), v, "c", n=50).first()
            assert got[g, v] == (round(one["mean"], 9), round(one.lo, 9), round(one.hi, 9))


def test_sign_test_of_many(spark):
    df = spark.createDataFrame([(1_000_000, 1_000_000), (1_010_000, 990_000), (30, 12), (60, 0)], "w bigint, l bigint")
    got = [x[0] for x in df.select(I.sign_test(F.col("w"), F.col("l"))).collect()]
    assert got[0] == 1.0 and 1e-46 < got[1] < 1e-42 and abs(got[2] - 2 * sum(comb(42, i) for i in range(13)) / 2**42) < 1e-12 and abs(got[3] / 2**-59 - 1) < 1e-9


def test_samples_batches_and_inherited_grades(spark):
    pairs = spark.createDataFrame([(f"p{i}", f"q{i % 5}", f"d{i}") for i in range(103)], "pid string, qid string, doc_id string")
    some = G.second_opinions(pairs, "pid").collect()
    assert len(some) == 20 and len({x.pid for x in some}) == 20
    assert G.second_opinions(pairs.limit(1), "pid").count() == 1 and G.second_opinions(pairs.where("false"), "pid").count() == 0
    parts = G.rebatched(pairs, "pid", pairs.where("qid = 'q0'"), pairs.where("qid = 'q1'"), 8).collect()
    assert {x.part for x in parts if int(x.pid[1:]) % 5 == 1} == {"p"} and len(parts) == 82 and {x.part for x in parts if int(x.pid[1:]) % 5 > 1} == {"q"}
    g = spark.createDataFrame([("b", "d1", 3), ("b", "d2", 1), ("v2", "d9", 2)], "qid string, doc_id string, grade int")
    v = spark.createDataFrame([("v1", "b"), ("v1", "b"), ("v2", "b"), ("b", "b"), ("v3", "zz"), (None, "b"), ("v4", None)], "qid string, base string")
    assert {tuple(x) for x in G.inherited(g, v).collect()} == {("v1", "d1", 3), ("v1", "d2", 1)}
    c = G.cited(spark.createDataFrame([("s", "1-И", ["1-И", "2-П"]), ("t", None, ["9-У"])], "source string, own string, refs array<string>"), spark.createDataFrame([("a", "1-И"), ("b", "2-П")], "doc_id string, number string"))
    assert {tuple(x) for x in c.collect()} == {("s", "a", 3), ("s", "b", 2)}


def test_evidence_verification_and_narrowing(spark):
    m = spark.createDataFrame([("k1", "d1"), ("k2", "d2")], "key string, doc_id string")
    rows = spark.createDataFrame([("q", ["k1", "k1", "zz"]), ("r", []), (None, ["k2"])], "qid string, keys array<string>")
    assert [tuple(x) for x in G.evidence(rows, "qid", "keys", m).collect()] == [("q", "d1", 3)]
    a = spark.createDataFrame([("p1", 3), ("p2", 2), ("p3", 1), ("p4", 2)], "pid string, grade int")
    got = G.to_verify(a, a.where("pid = 'p2'"), a.where("pid = 'p4'")).collect()
    assert [(x.pid, x.batch) for x in got] == [("p1", 0)]
    q = spark.createDataFrame([("q", 1, "x", "dev"), ("r", 2, "x", "dev"), ("s", 1, "y", "test")], "qid string, scenario int, dataset string, part string")
    t = q.select("qid")
    assert [x.qid for x in R.narrowed(t, q, scenario=1, dataset="x").collect()] == ["q"] and R.narrowed(t, q, part="dev").count() == 2 and R.narrowed(t, q).count() == 3
    g = spark.createDataFrame([("q", "d", 2), ("r", "d", 3), ("s", "d", 1)], "qid string, doc_id string, grade int")
    assert [x.qid for x in R.answerable(g, q.where("scenario = 2")).collect()] == ["q"]
