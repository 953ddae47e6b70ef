"""Reading the files of an evaluation: JSON lines, tab-separated grades, runs, batches, documents."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from relevia.functions import text as T

# Schemas of the files.
QUERIES = "qid string, query string, dataset string, scenario int, base string, extras map<string,string>"
RESPONSES = (
    "qid string, mode string, http int, ms double, error string, results array<struct<absolute_path string, score double, "
    "chunks array<struct<content string, score double>>, duplicates array<string>>>"
)
DOCUMENTS = (".pdf", ".docx", ".pptx", ".txt", ".xlsx", ".md", ".html")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or compressed; blank lines give no row, a broken line a row of nulls."""
    return spark.read.schema(schema).json(path)


def graded_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Gold grades: tab-separated with a header, no quoting."""
    return spark.read.csv(path, sep="\t", header=True, schema="qid string, doc_id string, grade int, source string", quote="")


def judged_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Grades of earlier rounds: tab-separated without a header; lines without a pair are left out."""
    return spark.read.csv(path, sep="\t", schema="qid string, doc_id string, grade int, round string", quote="").where("qid is not null and doc_id is not null")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays or objects over several lines; an object's ``result`` array stands for it. The file is kept as ``file``."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    wrapped = F.from_json("value", f"result array<struct<{_fields(schema)}>>")["result"]
    return raw.select("file", F.explode(F.coalesce(wrapped, F.from_json("value", f"array<struct<{_fields(schema)}>>"))).alias("r")).select("file", "r.*")


def _fields(schema: str) -> str:
    return re.sub(r"(\w+) (?=\w)", r"\1: ", schema)


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and cells that hold line breaks and doubled quotes."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def corpus_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = DOCUMENTS) -> DataFrame:
    """(path, length, sha1, sha256) of the documents below a folder, by suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    wanted = F.lower("path").rlike(r"(?:" + "|".join(map(re.escape, suffixes)) + ")$")
    return files.where(wanted).select("path", "length", F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def run_lines(spark: SparkSession, path: str, schema: str = RESPONSES) -> DataFrame:
    """The JSON lines of a run; a run without a file is empty."""
    try:
        return json_lines(spark, path, schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def ordered_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``json_document`` over several files with ``batch``, the number of a row's file by name from 0."""
    rows = json_document(spark, path, schema)
    files = rows.select("file").distinct()
    return rows.join(F.broadcast(files.withColumn("batch", F.row_number().over(Window.orderBy("file")) - 1)), "file")  # a row per file


# What is left out of a page.
SKIPPED = ("script", "style", "noscript", "form", "header", "footer", "nav")
FURNITURE = ("breadcrumbs", "page-info", "b-share", "subscribe", "page-rating")
NOISE = (
    "Да Нет", "Отправить", "Ответ не помог решить проблему", "Ответ ссылается на неактуальные данные",
    "Спасибо, что помогаете нам стать лучше!", "Пожалуйста, расскажите, почему вам не подошел этот ответ?",
)
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """Walks a page with the open elements and their classes: ``before`` an element opens, ``enter`` once it is open, ``leave``
    before it closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset[str]]] = []

    def inside(self, tags: tuple[str, ...] = (), classes: tuple[str, ...] = ()) -> bool:
        return any(t in tags or c.intersection(classes) for t, c in self.open)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.before(tag)
        if tag not in VOID:
            self.open.append((tag, frozenset((dict(attrs).get("class") or "").split())))
        self.enter(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open:
                last = self.open[-1][0]
                self.leave(last)
                self.open.pop()
                if last == tag:
                    break

    def before(self, tag: str) -> None: ...

    def enter(self, tag: str) -> None: ...

    def leave(self, tag: str) -> None: ...


class _Blocks(_Tree):
    """Text blocks of a page: headings, paragraphs, items, cells and divisions, of ``main``, else of ``.page-content``, else of all."""

    BLOCK = {"h1", "h2", "h3", "h4", "p", "li", "td", "div", "main", "body"}

    def __init__(self) -> None:
        super().__init__()
        self.titles: dict[str, str] = {}
        self.closed: set[str] = set()
        self.scopes: dict[str, list[str]] = {"all": []}
        self.now = ""

    def flush(self) -> None:
        text, self.now = " ".join(self.now.split()), ""
        scopes = ["all", *(["main"] if self.inside(("main",)) else []), *(["content"] if self.inside(classes=("page-content",)) else [])]
        for scope in scopes:
            blocks = self.scopes.setdefault(scope, [])
            if text and (not blocks or blocks[-1] != text):
                blocks.append(text)

    def before(self, tag: str) -> None:
        if tag in self.BLOCK:
            self.flush()

    def leave(self, tag: str) -> None:
        self.before(tag)
        if tag in self.titles:
            self.closed.add(tag)

    def handle_data(self, data: str) -> None:
        if not self.inside(SKIPPED):
            for tag in ("h1", "title"):
                if self.inside((tag,)) and tag not in self.closed:
                    self.titles[tag] = self.titles.get(tag, "") + " " + data
            if not self.inside(("title",), FURNITURE):
                self.now += " " + data

    def result(self) -> tuple[str, list[str]]:
        self.flush()
        blocks = self.scopes.get("main", self.scopes.get("content", self.scopes["all"]))
        kept = [b for b in blocks if b not in NOISE and not re.fullmatch(r"\d{1,3}", b)]
        return " ".join(self.titles.get("h1", self.titles.get("title", "")).split()), kept


def page_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, blocks) of HTML pages: the first heading, else the page's title, and its blocks of text.

    Equal neighbouring blocks count once; blocks of one to three digits and fixed phrases of page furniture are left out, as
    are null pages."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, h in zip(f["key"], f["html"]):
                p = _Blocks()
                p.feed(h)
                out.append((k, *p.result()))
            yield pd.DataFrame(out, columns=["key", "title", "blocks"])

    rows = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("key"), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"key {kind}, title string, blocks array<string>").withColumnRenamed("key", key)


class _Questions(_Tree):
    """Blocks ``div.dropdown.question``: number, topic, and what stands before and after the title ``Ответ``."""

    RAISED = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")

    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict[str, str]] = []

    def place(self) -> str | None:
        for name, part in (("dropdown_content_title", "head"), ("question_num", "num"), ("question_title", "topic")):
            if self.inside(classes=(name,)):
                return part
        return ("answer" if "Ответ" in self.found[-1]["head"] else "question") if self.inside(classes=("dropdown_content",)) else None

    def enter(self, tag: str) -> None:
        if tag == "div" and self.open and {"dropdown", "question"} <= self.open[-1][1]:
            self.found.append(dict.fromkeys(("num", "topic", "head", "question", "answer"), ""))
        elif self.found and tag in ("p", "li", "div", "td", "br") and (part := self.place()) in ("question", "answer"):
            self.found[-1][part] += "\n"

    def handle_data(self, data: str) -> None:
        if self.found and self.inside(classes=("question",)) and (part := self.place()):
            self.found[-1][part] += data.translate(self.RAISED) if self.inside(("sup",)) else data


def page_questions(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, num, topic, question_date, question, answer_date, answer_number, answer, acts, laws) of the question blocks of
    HTML pages; a date and a number at the beginning stand apart; raised digits stay raised; null pages are left out."""
    kind = pages.schema[key].dataType.simpleString()

    def tidy(text: str) -> str:
        return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, h in zip(f["key"], f["html"]):
                p = _Questions()
                p.feed(h)
                out += [(k, i, *(tidy(q[c]) for c in ("num", "topic", "question", "answer"))) for i, q in enumerate(p.found)]
            yield pd.DataFrame(out, columns=["key", "pos", "num", "topic", "q", "a"]).astype({"pos": "int32"})

    rows = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("key"), F.col(html).alias("html"))
    found = rows.mapInPandas(run, f"key {kind}, pos int, num string, topic string, q string, a string")
    asked, said, number = T.dated_start(F.col("q")), T.dated_start(F.col("a")), r"^№\s*(\S+)"
    plain = F.when(said["date"].isNotNull(), F.trim(F.regexp_replace(said["rest"], number, ""))).otherwise(F.col("a"))
    return found.select(
        F.col("key").alias(key), "pos", F.nullif("num", F.lit("")).alias("num"), F.nullif("topic", F.lit("")).alias("topic"), asked["date"].alias("question_date"), asked["rest"].alias("question"),
        said["date"].alias("answer_date"), F.when(said["date"].isNotNull(), F.nullif(F.regexp_extract(said["rest"], number, 1), F.lit(""))).alias("answer_number"), plain.alias("answer"),
        T.acts_in(plain).alias("acts"), T.laws_in(plain).alias("laws"),
    )


def table_bodies(rows: DataFrame) -> DataFrame:
    """(path, tbl, row, cells, heads) of the body rows of tables as ``docx_rows`` gives them: the different cells with words, and
    the labels of the first row over the columns with a value. Rows of one cell and rows of column numbers are left out."""
    head = rows.where("row = 0").select("path", "tbl", F.col("cells").alias("h"))
    word = lambda c: c.rlike(r"[\p{L}\p{N}_]")
    cells = F.array_distinct(F.filter("cells", word))
    heads = F.array_distinct(F.filter(F.zip_with("h", "cells", lambda h, c: F.when(c != "", h)), lambda h: h.isNotNull() & (h != "")))
    body = rows.where("row > 0").join(head, ["path", "tbl"]).select("path", "tbl", "row", cells.alias("cells"), heads.alias("heads"))
    return body.where((F.size("cells") > 1) & ~F.forall("cells", lambda c: c.rlike("^[0-9]{1,2}[а-я]?$")))


def docx_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, tbl, row, cells) of the tables in DOCX files: spanned cells once per column, nested tables and single cells left out.

    A file that is no DOCX gives no row."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, content in zip(f["path"], f["content"]):
                try:
                    body = ElementTree.fromstring(zipfile.ZipFile(BytesIO(content)).read("word/document.xml")).find(f"{w}body")
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                for t, tbl in enumerate(body.findall(f"{w}tbl") if body is not None else []):
                    for r, tr in enumerate(tbl.findall(f"{w}tr")):
                        cells = []
                        for tc in tr.findall(f"{w}tc"):
                            span = tc.find(f"{w}tcPr/{w}gridSpan")
                            text = " ".join("".join(x.text or "" for x in par.iter(f"{w}t")) for par in tc.findall(f"{w}p")).strip()
                            cells += [text] * int(span.get(f"{w}val", "1") if span is not None else 1)
                        if len(cells) > 1:
                            out.append((p, t, r, cells))
            yield pd.DataFrame(out, columns=["path", "tbl", "row", "cells"]).astype({"tbl": "int32", "row": "int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, tbl int, row int, cells array<string>")
