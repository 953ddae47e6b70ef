"""Planted scan noise on small documents."""

import random

import pytest

from relevia.llm import ocr

KIND = "cid bigint, doc_id string, idx int, text string, kind string, page_start int, char_start int, extra string"
WORDS = "банковский кредит заёмщик подтверждает договор страхование вексель оплачивает комиссия решение портфель документ залог выписка".split()


def page(r, n=6):
    return [" ".join(r.choice(WORDS) for _ in range(5)) for _ in range(n)]


@pytest.fixture(scope="module")
def repaired(spark):
    r = random.Random(9)
    rows, cid = [], 0
    for d in range(3):
        for p in range(1, 9):
            lines = page(r)
            head = f"Обзор «Банк{d}й»" if p % 2 else "Раздел 4. Лимит овердрафта"
            rows.append([cid, f"d{d}", p * 2, [head, *lines, f"— {p + 10} —"], "ocr" if p != 3 else None, p, None])
            cid += 1
    for k in range(60):
        rows.append([1000 + k, "plain", k, page(r, 8) + ["процентно-комиссионный доход"], "text", None, 5])
    by = {x[0]: x for x in rows}
    by[0][3][2] = "банковский кредит подтвер-"
    by[0][3][3] = "ждает договор залог"
    by[1][3][0] = "Рздел 4. Лимит овердрафта"
    by[1][3][3] = "вексель доход процентно-"
    by[1][3][4] = "комиссионный доход залог"
    by[2][3][3] = "заёмщик кре4ит залог банковский догово0"
    by[3][3][2] = "вексель поп 2O23 года"
    by[4][3][6] = "решение вексель страхо¬"
    by[5][3][1] = "вание залог документ"
    by[5][3][4] = "залог допо вексель комиссия"
    by[6][3][3] = "Документ: это строка текста"
    data = [(c, d, i, "\n".join(t), k, p, s, "x") for c, d, i, t, k, p, s in rows]
    data += [data[0], (2000, "d9", 1, None, "ocr", 1, None, "x"), (2001, "d9", 2, "", "ocr", 2, None, "x"), (None, "d9", 3, "x", "ocr", 3, None, "x")]
    rep = ocr.repair_scans(spark.createDataFrame(data, KIND))
    return {(x.cid, x.noise) for x in rep.noise.collect()}, {x.cid: x.text for x in rep.text.collect()}


def test_headers_and_page_numbers(repaired):
    noise, _ = repaired
    for kind in ("header", "pageno"):
        assert {c for c, n in noise if n == kind} == set(range(24))


def test_cut_words_within_and_across_pages(repaired):
    noise, text = repaired
    assert {c for c, n in noise if n == "hyphen"} == {0, 4}
    assert "подтверждает" in text[0] and "процентно-комиссионный" in text[1]


def test_misread_words_and_numbers(repaired):
    noise, text = repaired
    assert {c for c, n in noise if n == "misread"} >= {2, 3} and {c for c, n in noise if n == "misread"} <= {2, 3, 5}
    assert "2023" in text[3] and "договоо" not in text[2]


def test_text_is_continuous(repaired):
    _, text = repaired
    assert len(text) == 25 and all("\n" not in t and "Обзор" not in t and "—" not in t for t in text.values())


def test_empty(spark):
    rep = ocr.repair_scans(spark.createDataFrame([], KIND))
    assert rep.noise.count() == 0 and rep.text.count() == 0


def test_page_values():
    import pandas as pd

    assert [None if pd.isna(x) else int(x) for x in ocr.page_value(pd.Series(["12", "xiv", "1O", None, "", "З", "mm"]))] == [12, 14, 10, None, None, 3, 2000]


def test_long_headers_and_parts_with_numbers_of_their_own(spark):
    r = random.Random(4)
    long = " ".join(r.choice(WORDS) for _ in range(40))
    rows = []
    for p in range(1, 17):
        own = p + 3 if p < 10 else p - 9  # the annex starts anew
        rows.append((p, "d", p, "\n".join([f"{long} часть" if p % 2 else f"{long} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]} {page(r, 1)[0]}", *page(r), str(own)]), "ocr", p, None, "x"))
    marks = ocr.furniture(ocr.scanned_pages(spark.createDataFrame(rows, KIND))).collect()
    assert {x.cid for x in marks if x.header} == {p for p in range(1, 17) if p % 2}  # long lines that only begin alike are no header
    assert {x.cid for x in marks if x.pageno} == set(range(1, 17))


def test_cut_word_before_a_page_of_furniture(spark):
    r = random.Random(5)
    rows = [[p, "d", p, ["Обзор рынка банка", *page(r), str(p + 2)], "ocr", p, None, "x"] for p in range(1, 9)]
    rows[2][3][6] = "залог подтвер-"
    rows[3][3] = ["Обзор рынка банка", "6"]
    rows[4][3][1] = "ждает договор залог"
    rows += [[100 + k, "plain", k, page(r, 8), "text", None, 5, "x"] for k in range(20)]
    rep = ocr.repair_scans(spark.createDataFrame([(*x[:3], "\n".join(x[3]), *x[4:]) for x in rows], KIND))
    assert [x.cid for x in rep.noise.where("noise = 'hyphen'").collect()] == [3]
    assert {x.cid for x in rep.text.where("text = ''").collect()} == {4}


def test_confusions_and_long_words(spark):
    assert ocr.confusions("кре4ит", "кречит") == 1 and ocr.confusions("rnodern", "modern") == 1 and ocr.confusions("дом", "дым") == 3
    assert len(ocr._edits("попиинпопиинпопиинпопиинпопиинпопиин")) > 400
    right = "оченьдлинноесоставноеслово" * 3
    suspects = spark.createDataFrame([(right.replace("о", "0", 1).replace("ч", "4", 1), 1), ("к0рзина", 1), ("x" * 300, 1)], "word string, n bigint")
    common = spark.createDataFrame([(right, 9), ("корзина", 7)], "right string, m bigint")
    got = {x.right: x.edits for x in ocr.linked_words(suspects, common).collect()}
    assert got == {right: 2, "корзина": 1}


def test_context_chooses_between_equal_spellings(spark):
    r = random.Random(6)
    topics = [[f"слово{a}{b}" for b in "абвгде"] for a in "кл"]
    texts = [[*(r.choice(t) for _ in range(4)), own, *(r.choice(t) for _ in range(4))] for _ in range(600) for t, own in zip(topics, ("полка", "лопка"))]
    flow = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, " ".join([*topics[0][:4], "попка", *topics[0][2:]])), (9001, " ".join([*topics[1][:4], "попка", *topics[1][2:]]))]
    words = spark.createDataFrame([(w, 900) for t in topics for w in t] + [("полка", 600), ("лопка", 600), ("попка", 2)], "word string, n bigint")
    got = {x.cid: x.right for x in ocr.misread_words(spark.createDataFrame(flow, "cid bigint, text string"), words).collect()}
    assert got == {9000: "полка", 9001: "лопка"}
