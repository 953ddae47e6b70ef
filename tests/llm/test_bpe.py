"""Token ids against the public tokenizer itself, exact round trips, and every path of the encoder."""

import random

import pytest

from relevia.llm import bpe

FOLDER = "/opt/tokenizers"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken")


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["", " ", "\n\n  x", "It's   a test, we'll see…", "Срочный кредит № 12: счёт и ещё", "👍🏽 数据 κεφάλαιο é é", "a" * 300, "<|endoftext|>", "tab\t\tend  ", "x" * 70 + " y", "12345 67,8", "ﬁ Ⅳ ¼"]


def test_same_ids_and_round_trip(spark, ranks):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("abc деё1 .\n'’é") for _ in range(r.randrange(60))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(999, None, "k")], "id bigint, text string, key string")
    for words, width in ((100_000, 64), (10, 8)):  # all words shared to the tasks; most words by join
        out = bpe.encode_corpus(df, "id", "text", ranks, words, width)
        got = {x.id: x.ids for x in out.collect()}
        assert got.pop(999) == [] and [got[i] for i in range(len(texts))] == reference(texts)
    back = {x.id: x.text for x in bpe.decode_corpus(out, "id", "ids", ranks).collect()}
    assert [back[i] for i in range(len(texts))] == texts and back[999] == ""


def test_long_word_and_heap(ranks):
    r = random.Random(2)
    for w in ("a" * 5000, "".join(r.choice("ab") for _ in range(400)), "налогообложение" * 40):
        assert bpe._heap_merge(w.encode(), ranks) == reference([w])[0]


def test_empty_table_and_repeated_keys(spark, ranks):
    kind = "id bigint, text string"
    assert bpe.encode_corpus(spark.createDataFrame([], kind), "id", "text", ranks).count() == 0
    twice = bpe.encode_corpus(spark.createDataFrame([(1, "a b"), (1, "a b")], kind), "id", "text", ranks)
    assert [x.ids for x in twice.collect()] == reference(["a b"]) * 2


def test_null_and_repeated_keys_by_join(spark, ranks):
    rows = [(None, "a b"), (None, "a rareword"), (1, "a b"), (1, "a otherword"), (1, "a otherword"), (1, None), (2, "a b a b")]
    rows += [(k, "a b a b a b") for k in range(10, 15)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    want = sorted((str(k), i) for (k, _), i in zip(rows, reference([t or "" for _, t in rows])))
    for words in (100_000, 10, 3):  # the five different words are all shared; then only the commonest
        assert sorted((str(x.id), x.ids) for x in bpe.encode_corpus(df, "id", "text", ranks, words).collect()) == want
