"""One form for texts that look alike in print but differ in their characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.sources import materialize

# Letters that look alike, as Latin, Cyrillic, Greek; "-" where a script has none.
LATIN = "aceijopsxyABCEHIJKMNOPSTXYZ"
CYRILLIC = "асеіјорѕхуАВСЕНІЈКМ-ОРЅТХ--"
GREEK = "-----ο----ΑΒ-ΕΗΙ-ΚΜΝΟΡ-ΤΧΥΖ"
# Blanks of one width or another, characters without a shape, joined letters.
BLANKS = "\t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
ASCII = "".join(map(chr, range(0x21, 0x7F)))
LIKE = {x: a for a, c, g in zip(LATIN, CYRILLIC, GREEK) for x in (a, c, g) if x != "-"} | {"K": "K"}
SHARED_LATIN = "".join(a for a, c in zip(LATIN, CYRILLIC) if c != "-")
SHARED_CYRILLIC = CYRILLIC.replace("-", "")
ONLY_LATIN = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123)]) if c not in LIKE)
ONLY_CYRILLIC = "".join(c for c in [*map(chr, range(0x410, 0x450)), "Ё", "ё"] if c not in LIKE)
FOREIGN = "".join(c for c in LIKE if not c.isascii() and not "А" <= c <= "я")

WORD = r"[\p{L}\p{M}\p{N}\p{Cf}]"
ODD = rf"[\p{{Cf}}\p{{M}}\r{BLANKS}！-～ﬀ-ﬆ\u212a{FOREIGN}]"
LATIN_CYRILLIC, CYRILLIC_LATIN = "[A-Za-z][0-9]*[А-ё]", "[А-ё][0-9]*[A-Za-z]"


def _alone(letters: str) -> str:
    """A word of nothing but ``letters`` and digits, with a letter in it, among plain letters."""
    return rf"(?<![0-9A-Za-zА-ё])[0-9]*+[{letters}][0-9{letters}]*+(?![0-9A-Za-zА-ё])"


def shape(c: str) -> str:
    """The class of a character: all characters of a class look the same."""
    return LIKE.get(c, c)


def ignorable(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c == "\u034f" or "\ufe00" <= c <= "\ufe0f"


def expand(token: str) -> str:
    """Full-width forms as ordinary ones, joined letters apart."""
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else LIGATURES.get(c, c) for c in token)


class Trie:
    """Words by their letters; ``search`` runs the weighted edit automaton over it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + count

    def search(self, token: str, most: int = 0) -> list[tuple[int, int, str]]:
        """(cost, -count, word) of the words within ``most`` edits.

        A state is a place in the token with its cost. Look-alikes, characters without a shape, and a letter with its
        combining mark against the composed letter cost nothing; any other substitution, omission or insertion one."""
        n = len(token)

        def closed(states: dict[int, int]) -> dict[int, int]:
            for i in sorted(states):
                cost = states[i]
                while i < n and (cost := cost + (not ignorable(token[i]))) <= most and cost < states.get(i + 1, most + 1):
                    i += 1
                    states[i] = cost
            return states

        found, stack = [], [(self.root, "", closed({0: 0}))]
        while stack:
            node, word, states = stack.pop()
            if (cost := states.get(n)) is not None and "" in node:
                found.append((cost, -node[""], word))
            for c, child in node.items():
                if not c:
                    continue
                new: dict[int, int] = {}
                for i, cost in states.items():
                    steps = [(i, cost + 1)] if cost < most else []
                    if i < n:
                        steps.append((i + 1, cost + (shape(token[i]) != shape(c))))
                        j = i + 1
                        while j < n and ignorable(token[j]):
                            j += 1
                        if j < n and unicodedata.combining(token[j]) and composed(token[i], token[j]) == c:
                            steps.append((j + 1, cost))
                    for j, k in steps:
                        if k <= most and k < new.get(j, most + 1):
                            new[j] = k
                if new:
                    stack.append((child, word + c, closed(new)))
        return sorted(found)


def composed(base: str, mark: str) -> str:
    """A letter with its mark as one character; a base from another script counts as the look-alike that composes."""
    for b in {base, *(x for x, s in LIKE.items() if s == shape(base))}:
        if len(c := unicodedata.normalize("NFC", b + mark)) == 1 and c in "йЙёЁ":
            return c
    return unicodedata.normalize("NFC", base + mark)


def by_table(token: str) -> str:
    """The form of a token that no vocabulary word looks like: composed, without shapeless characters, look-alikes in
    the script of the letters that only one script has (Latin where none or several)."""
    kept = [c for c in expand(token) if not ignorable(c)]
    out: list[str] = []
    for c in kept:
        if out and unicodedata.combining(c) and len(out[-1]) == 1 and len(joined := composed(out[-1], c)) == 1:
            out[-1] = joined
        else:
            out.append(shape(c))
    text = unicodedata.normalize("NFC", "".join(out))
    names = {unicodedata.name(c, "").split(" ")[0] for c in text if c.isalpha() and c not in LIKE}
    if names == {"CYRILLIC"}:
        return text.translate(str.maketrans({a: c for a, c in zip(LATIN, CYRILLIC) if c != "-"}))
    if names == {"GREEK"}:
        return text.translate(str.maketrans({a: c for a, c in zip(LATIN, GREEK) if c != "-"}))
    return text


def _match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket, vocabulary before tokens; a trie lives as long as its bucket. Only spellings at no cost count."""
    bucket, trie = None, Trie()
    for frame in frames:
        tokens, forms = [], []
        for b, word, count in zip(frame["bucket"], frame["word"], frame["n"]):
            if b != bucket:
                bucket, trie = b, Trie()
            if count >= 0:
                trie.add(word, int(count))
            else:
                found = trie.search(expand(word))
                tokens.append(word)
                forms.append(found[0][2] if found else by_table(word))
        yield pd.DataFrame({"word": pd.Series(tokens, dtype=str), "form": pd.Series(forms, dtype=str)})


def _bucket(word: Column) -> Column:
    """Equal for words that look alike, and hardly for others: all shapes of the word, without marks."""
    bare = F.translate(word, FULL, ASCII)
    for a, b in LIGATURES.items():
        bare = F.replace(bare, F.lit(a), F.lit(b))
    bare = F.regexp_replace(bare, r"[\p{Cf}\p{M}]", "")
    olds, news = zip(*((k, v) for k, v in LIKE.items() if k != v))
    return F.translate(bare, "".join(olds) + "йЙёЁ", "".join(news) + "иИeE")


def normalize_lookalikes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text, canonical): every text in the one form that all texts looking the same share.

    Words of clean texts form a vocabulary, cut into tries by what look-alikes have in common; each word with unusual
    characters or mixed scripts runs through its trie by the edit automaton and takes the commonest spelling reached at
    no cost, else the form by table. Words made of shared letters alone take the script of the first letter of the text
    that only one script has. Blanks become spaces, CR LF a line feed; case, stress marks, ё, raised digits and
    punctuation stay. Null texts are left out, empty ones stay empty; repeated (keys, text) rows come once if unusual, else as often
    as they are."""
    ks = [f"k{i}" for i in range(len(keys))]
    rows = texts.select(*[F.col(k).alias(x) for k, x in zip(keys, ks)], F.col(text).alias("t")).where("t is not null")
    wide = ONLY_LATIN.translate(str.maketrans(ASCII, FULL))
    lead = F.regexp_extract("t", f"[{ONLY_LATIN}{wide}{ONLY_CYRILLIC}]", 0)
    cyr = lead.rlike(f"[{ONLY_CYRILLIC}]")
    t = F.col("t")
    # one pass settles most texts: nothing but letters of the leading script and ordinary signs
    other = F.when(cyr, ~t.rlike(r"^[\n -@\[-`{-~А-ё№]*+\z")).otherwise(~t.rlike(r"^[\n -~№]*+\z"))
    astray = F.when(cyr, t.rlike(_alone(SHARED_LATIN))).otherwise(t.rlike(_alone(SHARED_CYRILLIC)))
    mixed = t.rlike(LATIN_CYRILLIC) | t.rlike(CYRILLIC_LATIN)
    odd_text = other & ((~t.rlike(r"^[\n -~А-ё№«»—]*+\z") & t.rlike(ODD)) | mixed | astray)
    rows = materialize(rows.withColumns({"odd": odd_text, "cyr": cyr}))
    clean = rows.where("not odd")
    odd = rows.where("odd").select(*ks, "t", "cyr", F.xxhash64("t").alias("h")).dropDuplicates([*ks, "h"])
    odd = materialize(odd.withColumn("id", F.monotonically_increasing_id()))

    words = clean.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("[A-Za-z]+|[А-ё]+"), 0))).alias("word"))
    whole = F.col("word").rlike(f"[{ONLY_LATIN}{ONLY_CYRILLIC}]")
    vocabulary = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(whole)

    def strange(piece: Column) -> Column:
        return ~piece.rlike(r"^(?:[0-9A-Za-z]*+|[0-9А-ё]*+)\z") & piece.rlike(f"^{WORD}")

    flat = F.regexp_replace(F.translate("t", BLANKS + FULL, " " * len(BLANKS) + ASCII), "\r\n?", "\n")
    pieces = F.regexp_extract_all(flat, F.lit(r"[0-9A-Za-zА-ё\p{L}\p{M}\p{N}\p{Cf}]++|[ ,.\n]++|[^\p{L}\p{M}\p{N}\p{Cf}]++"), 0)
    tokens = odd.select("id", F.posexplode(F.filter(pieces, strange)).alias("pos", "word"))
    unknown = tokens.select("word").distinct().select("word", F.lit(-1).cast("bigint").alias("n"))
    bucketed = vocabulary.unionByName(unknown).withColumn("bucket", _bucket(F.col("word")))  # spellings of one look
    bucketed = bucketed.repartition("bucket").sortWithinPartitions("bucket", F.desc("n"))
    forms = bucketed.select("bucket", "word", "n").mapInPandas(_match, "word string, form string")

    def scripted(form: Column) -> Column:
        shared = form.rlike(f"^[0-9{SHARED_LATIN}{SHARED_CYRILLIC}]+$")
        return F.when(~shared, form).when(F.col("cyr"), F.translate(form, SHARED_LATIN, SHARED_CYRILLIC)).otherwise(F.translate(form, SHARED_CYRILLIC, SHARED_LATIN))

    # the k-th strange word is put back at the k-th gap of the text
    named = tokens.join(forms, "word").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "form"))), lambda x: x["form"]).alias("q"))
    gap = "\x00"
    rest = F.transform(pieces, lambda x: F.when(strange(x), F.lit(gap)).otherwise(scripted(F.replace(x, F.lit(gap), F.lit(" ")))))
    found = odd.join(named, "id", "left").select(*ks, "t", "cyr", F.coalesce("q", F.array().cast("array<string>")).alias("q"), F.split(F.array_join(rest, ""), gap).alias("p"))
    filled = F.zip_with("p", F.transform("q", scripted), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    built = found.select(*ks, "t", F.array_join(filled, "").alias("c"))
    out = clean.select(*ks, "t", F.col("t").alias("c")).unionByName(built)
    return out.select(*[F.col(x).alias(k) for k, x in zip(keys, ks)], F.col("t").alias(text), F.col("c").alias("canonical"))


def lookalike_classes(texts: DataFrame, field: str, key: str, number: str, text: str) -> DataFrame:
    """(field, class, number, key, digest, keys): every key of a field whose text looks like an unequal one, its class, a digest
    of its very text, and the number of rows of the class.

    Texts travel as digests; a key with several texts has a row for each. Null keys are left out."""
    canon = normalize_lookalikes(texts, [field, number, key], text)
    d = canon.select(F.col(field).alias("f"), F.col(number).alias("o"), F.col(key).alias("k"), F.md5(text).alias("t"), F.md5("canonical").alias("c")).where("k is not null")
    d = materialize(d.distinct())
    mixed = d.groupBy("f", "c").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("keys")).where("t0 <> t1").select("f", "c", "keys")
    return d.join(mixed, ["f", "c"]).select(F.col("f").alias(field), F.col("c").alias("class"), F.col("o").alias(number), F.col("k").alias(key), F.col("t").alias("digest"), "keys")


def lookalike_pairs(texts: DataFrame, field: str, key: str, number: str, text: str, salts: int = 8) -> DataFrame:
    """(field, key_1, key_2): pairs of distinct keys of a field whose unequal texts have one canonical form.

    The pair is ordered by the column ``number``, then by the key in byte order. A class meets itself in ``salts`` parts."""
    d = materialize(lookalike_classes(texts, field, key, number, text).select(F.col(field).alias("f"), F.col("class").alias("c"), F.col(number).alias("o"), F.col(key).alias("k"), F.col("digest").alias("t")))
    a = d.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int")).alias("a")
    b = d.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("b")
    first = (F.col("a.o") < F.col("b.o")) | ((F.col("a.o") == F.col("b.o")) & (F.col("a.k") < F.col("b.k")))
    same = (F.col("a.f") == F.col("b.f")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.s") == F.col("b.s"))
    both = a.join(b, same & (F.col("a.t") != F.col("b.t")) & first)
    return both.select(F.col("a.f").alias(field), F.col("a.k").alias("key_1"), F.col("b.k").alias("key_2")).distinct()
