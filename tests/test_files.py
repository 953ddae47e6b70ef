"""Sources and sinks in a temporary folder."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql.utils import AnalysisException

from relevia.sources import files, sinks


def test_json_and_tab_separated(spark, tmp_path):
    rows = [{"qid": "a", "query": "x", "scenario": 1, "extras": {"k": "v"}}, {"qid": "b", "query": None}]
    text = "\n\n".join(json.dumps(r) for r in rows)
    (tmp_path / "q.jsonl").write_text(text)
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write(text)
    for name in ("q.jsonl", "z.jsonl.gz"):
        got = files.json_lines(spark, str(tmp_path / name), files.QUERIES).orderBy("qid").collect()
        assert [(r.qid, r.scenario) for r in got] == [("a", 1), ("b", None)] and got[0].extras == {"k": "v"}
    (tmp_path / "g.tsv").write_text('qid\tdoc_id\tgrade\tsource\nq\ta "b\t3\tdataset\n')
    (tmp_path / "j.tsv").write_text("q\td\t1\told\n\nq\te\t\told\n")
    assert [tuple(r) for r in files.graded_pairs(spark, str(tmp_path / "g.tsv")).collect()] == [("q", 'a "b', 3, "dataset")]
    assert [tuple(r) for r in files.judged_pairs(spark, str(tmp_path / "j.tsv")).collect()] == [("q", "d", 1, "old"), ("q", "e", None, "old")]


def test_documents_csv_and_hashes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"pid": "p", "grade": 2}]')
    (tmp_path / "b.json").write_text('{"result": [\n{"pid": "q", "grade": null}]}')
    got = files.json_document(spark, str(tmp_path / "*.json"), "pid string, grade int").collect()
    assert sorted((r.pid, r.grade, r.file[-6:]) for r in got) == [("p", 2, "a.json"), ("q", None, "b.json")]
    (tmp_path / "c.csv").write_text('id,note\n1,"two\nlines ""quoted"""\n')
    assert files.quoted_csv(spark, str(tmp_path / "c.csv"), "id int, note string").first().note == 'two\nlines "quoted"'
    sub = tmp_path / "docs" / "x"
    sub.mkdir(parents=True)
    (sub / "A.PDF").write_bytes(b"abc")
    (sub / "b.exe").write_bytes(b"abc")
    r = files.corpus_files(spark, str(tmp_path / "docs")).collect()
    assert len(r) == 1 and r[0].sha1 == "a9993e364706816aba3e25717850c26c9cd0d89d"


def test_pages_and_tables(spark, tmp_path):
    html = "<title>T <b>x</b></title><body><nav>menu</nav><h1>Head</h1><p>One</p><p>One</p><p>12</p><script>no()</script><li>Two  words</li></body>"
    got = {r.k: (r.title, r.blocks) for r in files.page_texts(spark.createDataFrame([(1, html), (2, None), (3, "")], "k long, html string"), "k", "html").collect()}
    assert got == {1: ("Head", ["Head", "One", "Two words"]), 3: ("", [])}
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, s="": f"<w:tc>{s}<w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:tbl><w:tr>{cell('a')}{cell('b', '<w:tcPr><w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/></w:tcPr>')}</w:tr><w:tr>{cell('alone')}</w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    assert [(r.tbl, r.row, r.cells) for r in files.docx_rows(spark, str(tmp_path / "*.docx")).collect()] == [(0, 0, ["a", "b", "b"])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q", "d", 1, "r1"), ("q", "e", 2, "r2")], "qid string, doc_id string, grade int, round string")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    with pytest.raises(AnalysisException):
        sinks.write_json_lines(df, str(tmp_path / "j"))
    sinks.write_json_lines(df, str(tmp_path / "j"), force=True)
    sinks.replace_rounds(df, str(tmp_path / "p"))
    sinks.replace_rounds(df.where("round = 'r2'").replace(2, 3, "grade"), str(tmp_path / "p"))
    assert {(r.doc_id, r.grade, r.round) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("d", 1, "r1"), ("e", 3, "r2")}
    assert sinks.append_new(df.union(df), str(tmp_path / "a"), ["qid", "doc_id"]) == 2
    assert sinks.append_new(df, str(tmp_path / "a"), ["qid", "doc_id"]) == 0
    sinks.write_batches(df, "doc_id", str(tmp_path / "b"), 1)
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == ["batch=0", "batch=1"]
    assert sinks.markdown(df.orderBy("doc_id"), ["doc_id", "grade"]).splitlines()[2:] == ["| d | 1 |", "| e | 2 |"]
    with pytest.raises(ValueError):
        sinks.markdown(df, ["doc_id"], 1)


def test_append_once(spark, tmp_path):
    target = str(tmp_path / "out")
    for rows in ([("r", "a", 1.0), ("r", "a", 1.0)], [("r", "a", 2.0), ("r", "b", 1.0)]):
        sinks.append_new(spark.createDataFrame(rows, "run_id string, qid string, ms double"), target, ["run_id", "qid"])
    assert sorted((r.qid, r.ms) for r in spark.read.parquet(target).collect()) == [("a", 1.0), ("b", 1.0)]


def test_scopes_noise_and_titles_of_pages(spark):
    page = """<html><head><title>Сайт</title></head><body><header><h1>Шапка</h1></header><p>Перед</p><main><h1>Заголовок <b>главы</b></h1>
      <div class="breadcrumbs"><p>Главная</p></div><p>Один<br>два</p><p>Один два</p><ul><li>три</li><li>7</li></ul><p>Отправить</p><div>четыре<script>x</script></div></main><p>После</p></body></html>"""
    other = '<body><p>Вне</p><div class="x page-content"><p>Внутри</p></div></body>'
    rows = [(1, page), (2, other), (3, "<p>просто"), (4, "")]
    got = {r.k: (r.title, r.blocks) for r in files.page_texts(spark.createDataFrame(rows, "k int, html string"), "k", "html").collect()}
    assert got[1] == ("Заголовок главы", ["Заголовок главы", "Один два", "три", "четыре"])
    assert got[2] == ("", ["Внутри"]) and got[3] == ("", ["просто"]) and got[4] == ("", [])


def test_question_blocks(spark):
    page = """<div class="dropdown question"><span class="question_num">5</span><div class="question_title">О <i>расчёте</i></div><div class="dropdown_content">
      <div class="dropdown_content_title">Вопрос</div><p>от 01.02.2023 Как считать x<sup>2</sup>?</p><div class="dropdown_content_title">Ответ</div>
      <p>от 05.02.2023 № 41-1/2 Согласно Инструкции № 0199-И и закону № 395-1</p><p>и № 115-ФЗ.</p></div></div>
      <div class="dropdown question"><div class="dropdown_content"><p>Без ответа</p></div></div>"""
    got = files.page_questions(spark.createDataFrame([(1, page), (2, None), (3, "<p>x</p>")], "k int, html string"), "k", "html").orderBy("pos").collect()
    a, b = got
    assert (a.num, a.topic, a.question_date, a.question, a.answer_date, a.answer_number) == ("5", "О расчёте", "01.02.2023", "Как считать x²?", "05.02.2023", "41-1/2")
    assert a.answer == "Согласно Инструкции № 0199-И и закону № 395-1\nи № 115-ФЗ." and a.acts == ["199-И"] and a.laws == ["115-ФЗ", "395-1"]
    assert (b.num, b.question, b.answer, b.acts) == (None, "Без ответа", "", [])


def test_table_bodies_runs_and_batches(spark, tmp_path):
    rows = [("p", 0, 0, ["Показатель", "2024", "2025"]), ("p", 0, 1, ["1", "2", "3"]), ("p", 0, 2, ["Ставка", "7", ""]), ("p", 0, 3, ["итого", "итого", "итого"]), ("q", 0, 0, ["a", "b"])]
    got = files.table_bodies(spark.createDataFrame(rows, "path string, tbl int, row int, cells array<string>")).collect()
    assert [(x.row, x.cells, x.heads) for x in got] == [(2, ["Ставка", "7"], ["Показатель", "2024"])]
    assert files.run_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    for name, n in (("b", 2), ("a", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"pid": name, "grade": i} for i in range(n)]))
    got = files.ordered_batches(spark, str(tmp_path / "*.json"), "pid string, grade int").collect()
    assert {(x.batch, x.pid, x.grade) for x in got} == {(0, "a", 0), (1, "b", 0), (1, "b", 1)}
