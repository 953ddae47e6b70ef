"""Stems of Russian and English words by the published Snowball algorithms, for distinct words of a table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Endings of the Russian algorithm; those after "ая" must follow а or я.
GERUND = r"(?<=[ая])(?:вшись|вши|в)$|(?:ившись|ывшись|ивши|ывши|ив|ыв)$"
REFLEXIVE = r"(?:ся|сь)$"
ADJECTIVAL = r"(?:(?<=[ая])(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ)?(?:ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею)$"
VERB = (
    r"(?<=[ая])(?:ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)$"
    r"|(?:ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю)$"
)
NOUN = r"(?:а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я)$"
VOWEL = "[аеиоуыэюя]"


def russian(word: Column) -> Column:
    """The stem of a lower-case word without ё; endings count from the first vowel on."""
    head = F.regexp_extract(word, f"^.*?{VOWEL}", 0)
    rest = F.when(head == "", "").otherwise(F.substring(word, F.length(head) + 1, F.length(word)))
    gerund = F.regexp_replace(rest, GERUND, "")
    bare = F.regexp_replace(rest, REFLEXIVE, "")
    cut = bare
    for ending in (NOUN, VERB, ADJECTIVAL):  # the first of the last that is there
        shorter = F.regexp_replace(bare, ending, "")
        cut = F.when(shorter != bare, shorter).otherwise(cut)
    one = F.regexp_replace(F.when(gerund != rest, gerund).otherwise(cut), "и$", "")
    # the derivational ending counts from the second syllable's end on
    whole = F.concat(head, one)
    second = F.length(F.regexp_extract(whole, f"^.*?{VOWEL}.*?[^аеиоуыэюя].*?{VOWEL}.*?[^аеиоуыэюя]", 0))
    without = F.regexp_replace(whole, "(?:ост|ость)$", "")
    three = F.when((second > 0) & (F.length(without) >= second), without).otherwise(whole)
    tail = F.substring(three, F.length(head) + 1, F.length(three))
    plain = F.regexp_replace(tail, "(?:ейше|ейш)$", "")
    four = F.when(plain != tail, F.regexp_replace(plain, "нн$", "н")).when(tail.rlike("нн$"), F.regexp_replace(tail, "нн$", "н")).otherwise(F.regexp_replace(tail, "ь$", ""))
    return F.when(head == "", word).otherwise(F.concat(head, four))


# Exceptions and endings of the English algorithm.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _region(w: str, start: int) -> int:
    m = re.compile(r"[aeiouy][^aeiouy]").search(w, start)
    return m.end() if m else len(w)


def english(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or not word.isascii():
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    special = re.match(r"gener|commun|arsen", w)
    r1 = special.end() if special else _region(w, 0)
    r2 = _region(w, r1)

    def ends(*options: str) -> str:
        return max((x for x in options if w.endswith(x)), key=len, default="")

    if e := ends("sses"):
        w = w[:-2]
    elif e := ends("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif not ends("us", "ss") and w.endswith("s") and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    if e := ends("eed", "eedly"):
        w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    elif (e := ends("ed", "edly", "ing", "ingly")) and re.search("[aeiouy]", w[: -len(e)]):
        w = w[: -len(e)]
        if ends("at", "bl", "iz"):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and SHORT.search(w):
            w += "e"
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    e = ends(*STEP_2, "ogi", "li")
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] in set("cdeghkmnrt") else w
        else:
            w = w[: -len(e)] + STEP_2[e]
    e = ends(*STEP_3, "ative")
    if e and len(w) - len(e) >= r1:
        if e != "ative":
            w = w[: -len(e)] + STEP_3[e]
        elif len(w) - len(e) >= r2:
            w = w[: -len(e)]
    e = ends(*STEP_4, "ion")
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in {"s", "t"}):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def _english(words: pd.Series) -> pd.Series:
    return words.map(english)


def stemmed(words: DataFrame, word: str, stem: str = "stem") -> DataFrame:
    """``words`` with the stem of every word: Russian where there is a Cyrillic letter, else English."""
    return words.withColumn(stem, F.when(F.col(word).rlike("[а-я]"), russian(F.col(word))).otherwise(_english(word)))


def stem_postings(index: DataFrame) -> DataFrame:
    """An inverted index (key, grp, len, term, tf) with stems for terms; only distinct terms are stemmed."""
    stems = stemmed(index.select("term").distinct(), "term")
    met = index.join(stems, "term").groupBy("key", "grp", "len", "stem").agg(F.sum("tf").alias("tf"))
    return met.select("key", "grp", "len", F.col("stem").alias("term"), "tf")
