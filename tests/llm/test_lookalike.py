"""Look-alike texts: pairs, the automaton, and what must stay different."""

from relevia.llm import lookalike as L


def pairs(spark, texts):
    df = spark.createDataFrame([("f", i, str(i), t, "x") for i, t in enumerate(texts)], "field string, number bigint, key string, text string, t string")
    return {(int(r.key_1), int(r.key_2)) for r in L.lookalike_pairs(df, "field", "key", "number", "text").collect()}


def test_equal_in_print(spark):
    base = "Срочный кредит № 12: счёт и ещё йод, Bank Code KB4663"
    same = [
        base,
        base.replace(" ", "\u00a0"),
        base.replace("Срочный", "Cpoчный"),
        base.replace("12", "１２").replace("Bank", "Ｂａｎｋ"),
        base.replace("й", "и\u0306").replace("ё", "е\u0308"),
        base.replace("кредит", "кре\u200bдит").replace("счёт", "с\u00adчёт"),
        base.replace("о", "\u03bf"),
        base.replace("KB4663", "КВ4663"),
    ]
    n = len(same)
    assert pairs(spark, same) == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_visibly_different(spark):
    assert pairs(spark, ["счёт 5 м²", "счет 5 м²", "Счёт 5 м²", "сче\u0301т 5 м²", "счёт 5 м2", "счёт 5 м²!", "счёт  5 м²", "счёт 6 м²"]) == set()


def test_words_of_shared_letters_take_the_script_of_the_text(spark):
    assert pairs(spark, ["сор и рост", "cop и рост", "the cop", "thе сор"]) == {(0, 1), (2, 3)}


def test_nulls_empty_repeats_and_copies(spark):
    assert pairs(spark, [None, "", "a b", "a\u00a0b", "a b"]) == {(2, 3), (3, 4)}
    df = spark.createDataFrame([("f", 1, "1", "a b")] * 3 + [("f", 2, "2", "a\u2009b")] * 2, "field string, number bigint, key string, text string")
    assert L.lookalike_pairs(df, "field", "key", "number", "text").count() == 1
    assert L.lookalike_pairs(df.where("false"), "field", "key", "number", "text").count() == 0


def test_very_long_text(spark):
    long = "кредит банка " * 20000
    assert pairs(spark, [long, long.replace("а", "a", 1), long + "!"]) == {(0, 1)}


def test_automaton():
    t = L.Trie()
    for w, n in (("кредит", 5), ("кредиты", 2), ("йод", 1)):
        t.add(w, n)
    assert t.search("кpeдит") == [(0, -5, "кредит")]
    assert t.search("к\u200bред\u00adит") == [(0, -5, "кредит")]
    assert t.search("и\u0306од") == [(0, -1, "йод")]
    assert t.search("кредт") == [] and [w for _, _, w in t.search("кредт", 1)] == ["кредит"]
    assert [(c, w) for c, _, w in t.search("кредитыы", 1)] == [(1, "кредиты")]


def test_canonical_form_is_the_commonest_clean_spelling(spark):
    df = spark.createDataFrame([(1, "кредит банка"), (2, "кpeдит бaнка"), (3, "\ufb01nаnce")], "k int, text string")
    got = {r.k: r.canonical for r in L.normalize_lookalikes(df, ["k"], "text").collect()}
    assert got == {1: "кредит банка", 2: "кредит банка", 3: "finance"}
