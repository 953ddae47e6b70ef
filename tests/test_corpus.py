"""Quality and text units on small tables."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from relevia.operators import quality as Q
from relevia.operators import units as U
from relevia.plans.corpus import stitched_sections

KIND = "cid long, doc_id string, idx int, text string, kind string, section string, table_id string, page_start int, page_end int, char_start int, char_end int"


def chunks(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (11 - len(r))) for r in rows], KIND)


def test_boilerplate_repeats_and_hygiene(spark):
    c = chunks(spark, [(i, "d", i, f"Банк России\nстрока {i} текста\n12") for i in range(4)] + [(9, "d", 9, " БАНК  России\nстрока 3 текста\n12"), (10, "e", 1, None), (11, "e", 2, "")])
    assert [tuple(x) for x in Q.boilerplate(c, "cid").collect()] == [("d", "банк россии", 5)]
    assert [tuple(x) for x in Q.repeated_chunks(c).collect()] == [("d", 5, 1)]
    h = Q.hygiene(c, "text", F.lit("all")).first()
    assert h.n == 6 and h.spaces_2plus == 1 / 6 and h.short == 1 / 6
    assert Q.hygiene(c.where("false"), "text", F.lit("all")).count() == 0


def test_coverage(spark):
    c = chunks(spark, [(1, "d", 1, "один два три четыре"), (2, "d", 2, "три четыре пять шесть 12 345"), (3, "e", 1, "один два три четыре пять")])
    refs = spark.createDataFrame([("r", "d", "один два три четыре пять 12345 и 7777"), ("s", "none", "один два три"), ("t", "d", ""), (None, "d", "x")], "ref string, doc string, text string")
    got = {x.ref: (x.grams, round(x.in_doc, 3), round(x.in_chunk, 3)) for x in Q.gram_coverage(refs, "ref", "doc", "text", c, "doc_id", "cid", "text").collect()}
    assert got == {"r": (6, 0.5, 0.333), "s": (1, 0.0, 0.0)}
    n = Q.number_coverage(refs, "ref", "doc", "text", c).first()
    assert (n.numbers, n.found) == (2, 1)


def test_reports(spark):
    a = spark.createDataFrame([("m", 1.0), ("seconds", 5.0), ("old", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("m", 1.0), ("seconds", 6.0), ("new", 3.0)], "metric string, value double")
    assert {tuple(x) for x in Q.report_delta(a, b).collect()} == {("old", 2.0, None), ("new", None, 3.0)}
    wide = spark.createDataFrame([("ru", 1, 2), (None, 3, 4)], "lang string, n int, m int")
    assert {tuple(x) for x in Q.flatten_report(wide, ["lang"], ["n", "m"]).collect()} == {("ru.n", 1.0), ("ru.m", 2.0), ("all.n", 3.0), ("all.m", 4.0)}


def test_units(spark):
    rows = [(1, "d", 1, "abcdef", "text", "s", None, 1, 2, 0, 6), (2, "d", 2, "efghi", "text", "s", None, 3, None, 4, 9), (3, "d", 4, "zz", "text", "s", "t", None, None, None, None), (4, "d", 3, "fg", "text", "s", None, 2, 2, 5, 7)]
    c = chunks(spark, rows + rows[:1])
    assert {x.cid: x.around for x in U.neighbours(c).collect()} == {1: [1, 2], 2: [1, 2, 4], 3: [4, 3], 4: [2, 4, 3]}
    assert [x.text for x in U.stitched(c, ["doc_id", "section"]).collect()] == ["abcdefghi\nzz"]
    spans = spark.createDataFrame([("x", "d", 2, 3), ("y", "d", 9, 9)], "span string, doc_id string, page_start int, page_end int")
    assert {tuple(x) for x in U.overlapping_pages(c, spans).collect()} == {("x", 1), ("x", 2), ("x", 4)}
    assert {(x.unit, x.key): x.chunks for x in U.parents(c).collect()} == {("page", "1"): 2, ("page", "3"): 1, ("page", "2"): 1, ("table", "t"): 1}


def test_stitched_sections_of_all_kinds_in_pieces(spark, tmp_path):
    rows = [(1, "d", 1, "ab", "text", "s", None, None, None, 0, 2), (2, "d", 2, "row", "table_row", "s", "t"), (3, "d", 3, "table", "table", "s", "t"), (4, "d", 4, "bc", "notes", "s", None, None, None, 1, 3), (5, "d", 5, "odd", None, "s"), (6, "d", 6, "x", "text", None)]
    chunks(spark, rows).write.parquet(f"{tmp_path}/chunks.parquet")
    assert [(x.doc_id, x.section, x.piece, x.text) for x in stitched_sections(spark, str(tmp_path)).collect()] == [("d", "s", 0, "abc\nrow\ntable\nodd")]


def test_stitched_pieces_are_the_whole(spark):
    r = random.Random(3)
    rows = [(i, d, r.choice([i, i, None]), "".join(r.choice("abc") for _ in range(n)), r.choice(["text", "table"]), s, None, None, None, *((at, at + n) if at is not None else (None, None)))
            for i in range(400) for d in [r.choice(["d", "d", None])] for s in [r.choice(["s", "s", "z"])] for n in [r.choice([0, 5, 400, 20_000])] for at in [r.choice([None, r.randrange(300_000)])]]
    want = {}
    low = lambda x: (x is not None, x or 0)
    for x in sorted(rows, key=lambda x: (x[9] is None, low(x[9]), low(x[2]), x[0])):
        text, end = want.get((x[1], x[5]), ("", None))
        cut = end - x[9] if end is not None and x[9] is not None else -1
        text = text + x[3][cut:] if cut >= 0 else text + "\n" + x[3] if text else x[3]
        want[x[1], x[5]] = text, max(end or 0, x[10]) if x[10] is not None else end
    for run in (4, 512):
        got = {}
        for x in sorted(U.stitched(chunks(spark, rows + rows[:50]), ["doc_id", "section"], run).collect(), key=lambda x: x.piece):
            got.setdefault((x.doc_id, x.section), []).append(x)
        assert {k: "".join(x.text for x in v) for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all([x.piece for x in v] == list(range(len(v))) and (len(v) > 5) == (run == 4) for v in got.values())


def test_cards_splitting_and_numbers(spark):
    m = spark.createDataFrame([("a/Отчёт 5.pdf", "p", "a", "pdf", "Отчёт 5", "k5"), ("a/Отчёт 5.pdf", "p", "a", "pdf", "Отчёт 5", "k5")], "doc_id string, path string, dataset string, format string, title string, key string")
    assert [x.text for x in U.cards(m).collect()] == ["Документ: Отчёт 5\nРаздел: a\nКлюч: k5"]
    long = "слово. " * 500
    t = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "x" * 2500)], "k long, text string")
    got = U.split_texts(t, "k", "text", 1000, 100).collect()
    for k, text in ((1, long), (4, "x" * 2500)):
        parts = sorted((x for x in got if x.k == k), key=lambda x: x.idx)
        assert all(text[x.char_start : x.char_start + len(x.text)] == x.text and len(x.text) <= 1000 for x in parts)
        assert parts[0].char_start == 0 and parts[-1].char_start + len(parts[-1].text) == len(text)
    assert {x.k for x in got} == {1, 4}
    ids = spark.range(50).selectExpr("id * 37 % 101 as k", "id % 3 as g")
    for order in (["k"], ["g", "k"]):
        rows = sorted(U.numbered(ids, order, "n", "p", 4).collect(), key=lambda x: [x[c] for c in order])
        assert [x.n for x in rows] == [f"p{i:04}" for i in range(50)]
    assert U.numbered(ids.where("false"), ["k"], "n").count() == 0


def test_context_and_defects(spark):
    kind = "cid bigint, doc_id string, title string, text string"
    rows = [(1, "a/x", "Акт 154-И за 2019 год.pdf", "В акте № 154 - И указано"), (2, "a/x", "Акт 154-И за 2019 год.pdf", "154-ИС, 12019 и 2019"), (3, "a/y", "Обзор рисков банка", "обзоры и рискованный банк"), (4, "a/y", "12", "текст"), (5, None, None, "x")]
    got = {x.cid: (x.has_title, x.has_number, x.has_year) for x in Q.context(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (False, True, False), 2: (False, False, True), 3: (True, None, None), 4: (False, None, None)}
    texts = [(1, "d", "t", "кре-\nдит и вы\u00adдача"), (2, "d", "t", "Документ: x\nБАНК  РОССИИ"), (3, "d", "t", "Банк\nРоссии \x02"), (4, "e", "t", None)]
    d = Q.text_defects(spark.createDataFrame(texts, kind), F.col("doc_id"), r"банк\s+россии").collect()
    assert [tuple(x) for x in d] == [("d", 3, 1, 0, 1, 1, 1, 2)]


def test_numbers_inside_longer_ones(spark):
    c = spark.createDataFrame([("d", "всего 1 234 567,8 руб."), ("e", "8 765")], "doc_id string, text string")
    refs = spark.createDataFrame([("r", "d", "сумма 234567 и 2345 678, в 2019 году 99 99"), ("s", "d", "нет чисел"), (None, "d", "1234")], "ref string, doc string, text string")
    assert {x.ref: (x.numbers, x.found) for x in Q.number_coverage(refs, "ref", "doc", "text", c).collect()} == {"r": (3, 2), None: (1, 1)}


def test_packing_against_a_loop(spark):
    r = random.Random(8)
    texts = [(i, "\n\n".join(" ".join("w" * r.choice([1, 3]) for _ in range(r.choice([1, 5, 30]))) + r.choice(["", "\nx"]) for _ in range(r.randrange(12)))) for i in range(40)] + [(100, None), (101, " \n\n \n")]
    want = set()
    for k, t in texts:
        part, words, n = 0, 0, {}
        for p in [p for p in re.split(r"\n\s*\n", t or "") if p.strip()]:
            w = len(p.split())
            if not part or words + w > 35:
                part, words = part + 1, 0
            words += w
            a, b = n.get(part, (0, 0))
            n[part] = a + 1, b + w
        want |= {(k, part, a, b) for part, (a, b) in n.items()}
    got = U.packed(spark.createDataFrame(texts, "k bigint, t string"), "k", "t", 35).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_best_window_against_a_loop(spark):
    r = random.Random(9)
    word = lambda: r.choice("абвгдежз")
    rows = [(str(i), " ".join(word() for _ in range(6)), [" ".join(word() for _ in range(r.randrange(5))) for _ in range(12)]) for i in range(15)] + [("none", "я", ["а"]), ("empty", "", ["а"]), ("dry", "а", [])]
    got = {x.ref: (x.f1, x.first, x.last) for x in U.best_windows(spark.createDataFrame(rows, "ref string, fact string, lines array<string>"), 4).collect()}
    want = {}
    for ref, fact, lines in rows:
        ft, best = Counter(fact.split()), (0.0, None, None)
        for i in range(len(lines)):
            wc = Counter()
            for j in range(i, min(len(lines), i + 4)):
                wc += Counter(lines[j].split())
                f1 = round(2 * sum((ft & wc).values()) / max(1, sum(ft.values()) + sum(wc.values())), 9)
                best = (f1, i, j) if f1 > best[0] else best
        if best[0]:
            want[ref] = best
    assert got == want


def test_coverage_report(spark):
    rows = spark.createDataFrame([("pdf", 0.9), ("pdf", 0.5), ("txt", 0.8)], "format string, x double")
    got = {x.format: (x.n, round(x.mean, 6), x.least, x.covered, x.below) for x in Q.coverage_report(rows, "format", "x").collect()}
    assert got == {"pdf": (2, 0.7, 0.5, 1, 1), "txt": (1, 0.8, 0.8, 1, 0), None: (3, 0.733333, 0.5, 2, 1)}


def test_splitter_tail_and_separators(spark):
    t = spark.createDataFrame([(1, "аб вг дe жз и"), (2, "длинноеслово")], "k int, t string")
    got = {(x.k, x.idx): x.text for x in U.split_texts(t, "k", "t", 6, 0, (" ",), keep=False).collect()}
    assert got == {(1, 0): "аб вг", (1, 1): "дe жз", (1, 2): "и", (2, 0): "длинно", (2, 1): "еслово"}
    tail = {(x.k, x.idx): x.text for x in U.split_texts(t, "k", "t", 6, 0, (" ",), tail=0.5).collect()}
    assert tail == {(1, 0): "аб вг ", (1, 1): "дe жз и", (2, 0): "длинно", (2, 1): "еслово"}


def test_word_pieces(spark):
    v = {"кот", "##ик", "##и", "дом", ",", "a"}
    t = spark.createDataFrame([(1, "котики, дом!​"), (1, "zzz a"), (2, None), (3, "кот" * 40), (4, "a " * 3000)], "k int, t string")
    assert sorted((x.k, x.pieces) for x in U.piece_counts(t, "k", "t", v).collect()) == [(1, 4), (1, 8), (2, 2), (3, 3), (4, 2048)]
