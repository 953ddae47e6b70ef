"""Reading levels of held-out texts of known level."""

import random

from relevia.llm import levels

WORDS = {"ru": [[f"{a}{b}{c}" for a in "бвгд" for b in "аоуи" for c in t] for t in ("кт", "мн", "рл", "зс", "шч")], "en": [[f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in t] for t in ("kt", "mn", "rl", "zs", "pv")]}


def text(r, lang, level, sentences=9):
    out = []
    for _ in range(sentences):
        at = min(4, max(0, round(r.gauss(level - 1, 0.4))))
        out.append(" ".join(r.choice(WORDS[lang][at]) for _ in range(8)).capitalize() + ".")
    return " ".join(out)


def test_held_out_accuracy_and_texts_without_a_level(spark):
    r = random.Random(8)
    graded = [(lang, text(r, lang, k), k) for lang in ("ru", "en") for k in range(1, 6) for _ in range(12)]
    known = {i: (lang, k) for i, (lang, k) in enumerate((lang, k) for lang in ("ru", "en") for k in range(1, 6) for _ in range(12))}
    docs = [(i, text(r, lang, k, 12)) for i, (lang, k) in known.items()]
    docs += [(900, None), (901, ""), (902, "Кот."), (903, "Форма 1\n" + "\n".join("лимит банка | 12,5 | 33.1" for _ in range(20))), (904, text(r, "ru", 3, 5))]
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id bigint, text string, level string")
    g = spark.createDataFrame(graded, "lang string, text string, reading_level int")
    got = {x.doc_id: x.level for x in levels.reading_levels(d, "doc_id", "text", g, "text", "reading_level").collect()}
    assert set(got) == set(known)
    assert sum(got[i] == k for i, (_, k) in known.items()) / len(known) > 0.85


def test_empty(spark):
    d, g = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([("Кот пил чай. " * 8, 2)], "text string, reading_level int")
    assert levels.reading_levels(d, "doc_id", "text", g, "text", "reading_level").count() == 0
    some = spark.createDataFrame([(1, "Кот пил чай. " * 8)], "doc_id bigint, text string")
    assert levels.reading_levels(some, "doc_id", "text", g.where("false"), "text", "reading_level").count() == 0


def corpus(spark):
    r = random.Random(3)
    graded = [(lang, text(r, lang, k), k) for lang in ("ru", "en") for k in range(1, 6) for _ in range(5)]
    docs = [(i, text(r, lang, k, 9)) for i, (lang, k) in enumerate((lang, k) for lang in ("ru", "en") for k in range(1, 6) for _ in range(6))]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(graded, "lang string, text string, reading_level int")


def test_words_by_join_give_the_same_scores(spark):
    d, g = corpus(spark)
    shared = levels.reading_levels(d, "doc_id", "text", g, "text", "reading_level", rounds=3, settled=0.0).toPandas().set_index("doc_id").sort_index()
    joined = levels.reading_levels(d, "doc_id", "text", g, "text", "reading_level", rounds=3, settled=0.0, shared_words=100).toPandas().set_index("doc_id").sort_index()
    assert (shared.score - joined.score).abs().max() < 1e-9 and (shared.level == joined.level).all()


def test_scale_stays_when_the_corpus_grows(spark):
    d, g = corpus(spark)
    many = d.crossJoin(spark.range(12)).selectExpr("doc_id + 1000 * id as doc_id", "text")
    few = levels.reading_levels(d, "doc_id", "text", g, "text", "reading_level").toPandas().set_index("doc_id")
    big = levels.reading_levels(many, "doc_id", "text", g, "text", "reading_level").toPandas().set_index("doc_id")
    assert (few.score - big.score.loc[few.index]).abs().max() < 0.15
    assert big.level.loc[few.index].eq(few.level).mean() > 0.95


def test_repeated_and_null_keys(spark):
    _, g = corpus(spark)
    r = random.Random(5)
    d = spark.createDataFrame([(1, text(r, "ru", 1)), (1, text(r, "ru", 5)), (None, text(r, "ru", 5))], "doc_id bigint, text string")
    got = levels.reading_levels(d, "doc_id", "text", g, "text", "reading_level").collect()
    assert [x.doc_id for x in got] == [1, 1] and abs(got[0].level - got[1].level) >= 3
