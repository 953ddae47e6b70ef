"""Text columns by hand-checked values."""

import pytest
from pyspark.sql import functions as F

from relevia.functions import text as T


@pytest.fixture
def one(spark):
    return lambda column, **values: spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (T.norm, " Счёт   А\n", "счет а"),
        (T.norm_hyphens, "a – b", "a - b"),
        (T.norm_letters, "Ёж-1, два!", "еж 1 два"),
        (T.tokens, "Счёт №5: pay-off", ["счет", "5", "pay", "off"]),
        (T.padded, "Да, нет", " да нет "),
        (T.own_text, "Документ: x\nРаздел: y\nbody", "body"),
        (T.strip_prefix, "Документ: x\nРаздел: y\nbody", "Раздел: y\nbody"),
        (T.numbers_in, "от -1 234,5 до 7.25 и −12", [-1234.5, 7.25, -12.0]),
        (T.sums_in, "2024 год, 12 345 и 999, 5000 5000", ["12345", "5000"]),
        (T.human_dates, "2025-01-05", ["5 января 2025", "05.01.2025"]),
        (T.human_dates, "январь", None),
        (T.superscripts_to_digits, "м²³", "м23"),
        (T.designations, "указание 5348-У и ЦБ ABC, 5348-У", ["5348-У", "ABC"]),
        (T.safe_name, ' a/b: "c" . ', "a b c"),
        (T.slug, "Bank Code, No 5!", "bank-code-no-5"),
        (T.document_of, "file:///x/corpus/a/corpus/b.pdf", "a/corpus/b.pdf"),
        (T.extension, "a/b.c/d.PDF", "pdf"),
        (T.path_key, "a/b", "a__b"),
        (T.markdown_kind, "| a | b |", "row"),
        (T.markdown_kind, "1.2. пункт", "num"),
        (T.markdown_clean, "# Глава\n**a** [b](c)", "Глава\na b"),
    ],
)
def test_values_and_nulls(one, make, text, want):
    assert one(make(F.col("t")), t=text) == want
    assert one(make(F.col("t").cast("string")), t=None) in (None, False, "text")


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, ["a"]), (2, ["a b"]), (3, ["a b c"]), (4, ["a b c", "b c d"])])
def test_grams(one, n, want):
    assert one(T.grams(F.array(*map(F.lit, "abcd"[:n])).cast("array<string>")), t=1) == want


@pytest.mark.parametrize(("key", "want"), [("q1", 0), ("q2", 2), ("q3", 2), ("q6", 0), ("cbr0001", 2)])
def test_hash_third(one, key, want):
    assert one(T.hash_third("split", F.col("k")), k=key) == want


@pytest.mark.parametrize(("token", "want"), [("ЦБ_21", True), ("5348-У", True), ("obs_286", True), ("2025", False), ("слово", False)])
def test_codes(one, token, want):
    assert one(T.is_code(F.col("t")), t=token) is want


def test_byte_limit_window_and_titles(one):
    assert one(T.within_bytes(F.array(F.lit("я" * 20), F.lit("я" * 19)), 40), t=1) == ["я" * 19]
    assert one(T.loses_words(F.array(F.lit("я" * 20)), 40), t=1) is True
    assert one(T.window_text(F.col("t"), F.lit(2000), F.lit(100), 1800), t="x" * 3000) == "x" * 1800
    assert one(T.window_text(F.col("t"), F.lit(0), F.lit(5), 1800), t="short") == "short"
    assert one(T.junk_title(F.col("t")), t="Microsoft Word - a.doc") and one(T.junk_title(F.col("t").cast("string")), t=None) and not one(T.junk_title(F.col("t")), t="Обзор рынка")
    assert one(T.interval_text(F.lit(0.61), F.lit(0.598), F.lit(0.622)), t=1) == "0.610 [0.598–0.622]"
    assert one(T.share(F.lit(1), F.lit(0)), t=1) is None and one(T.share(F.lit(1), F.lit(8)), t=1) == 12.5
    assert one(T.has_emoji(F.col("t")), t="да 👍") and one(T.has_controls(F.col("t")), t="a\x07")
