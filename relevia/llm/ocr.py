"""Traces of the page in text from scans: cut words, misread characters, running headers, page numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from relevia.sources import materialize, most_frequent

# What stands on the page, and what a recogniser takes it for.
GLYPHS = [
    ("о", "0"), ("з", "3"), ("ч", "4"), ("б", "6"), ("т", "7"), ("в", "8"), ("н", "и"), ("п", "n"), ("л", "п"), ("т", "г"), ("ы", "bl"), ("и", "н"), ("с", "e"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "6"), ("g", "9"), ("i", "!"), ("e", "c"), ("c", "e"), ("t", "f"), ("h", "b"), ("n", "ri"), ("d", "cl"), ("m", "rn"), ("rn", "m"), ("li", "h"), ("u", "ii"),
]
FIGURES = {"cyr": ("034678", "озчбтв"), "lat": ("01569!", "olsbgi")}
DIGITS = {"o": "0", "о": "0", "l": "1", "i": "1", "з": "3", "s": "5", "б": "6", "b": "6", "в": "8"}
MARKS = "\\-¬‐\u00ad"
LABEL = r"^(?:Документ|Раздел): "
NUMBER = r"[0-9OОoоlIЗзSБбB]{1,4}|[ivxlcdmIVXLCDM]{1,8}"
PAGE = rf"^[\s\-–—\[(]*(?:(?:стр|с|page|p)\b\.?\s*)?({NUMBER})(?:\s*(?:/|из|of)\s*[0-9]{{1,4}})?[\s\-–—\])]*$"
WORD = r"[0-9A-Za-zА-ё\p{L}\p{N}]++(?:!\p{L}++)*+"
TOKEN = r"[0-9A-Za-zА-ё\p{L}\p{N}]++(?:[-!][0-9A-Za-zА-ё\p{L}\p{N}]++)*+"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def lines_of(text: Column) -> Column:
    """The lines with something on them, without the indexer's labels on top."""
    bare = F.regexp_replace(text, r"^(?:(?:Документ|Раздел): [^\n]*(?:\n|$))+", "")
    return F.filter(F.split(bare, r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)


def scanned_pages(chunks: DataFrame) -> DataFrame:
    """(doc_id, cid, idx, page, lines) of scanned documents, a row per cid.

    Chunks with a page but without a place in a source text come from scans, whatever their label; a document is
    scanned if at least half of its paged chunks are labelled ocr or have no such place."""
    paged = chunks.where("page_start is not null and cid is not null and text is not null and doc_id is not null")
    off = F.col("char_start").isNull() | (F.coalesce("kind", F.lit("")) == "ocr")
    docs = paged.groupBy("doc_id").agg(F.avg(off.cast("int")).alias("share")).where("share >= 0.5").select("doc_id")
    own = paged.where(off & ~F.coalesce("kind", F.lit("")).isin("table", "table_row", "card")).select("doc_id", "cid", "idx", F.col("page_start").alias("page"), lines_of(F.col("text")).alias("lines"))
    return materialize(own.join(docs, "doc_id").dropDuplicates(["cid"]))


def page_value(numbers: pd.Series) -> pd.Series:
    """The value of a printed number, with misread digits or in Roman figures; null if it is neither."""

    def value(x: str | None) -> int | None:
        if not x:
            return None
        x = x.lower()
        if all(c in ROMAN for c in x) and not any(c.isdigit() for c in x):
            v = [ROMAN[c] for c in x]
            return sum(-a if a < max(v[i:]) else a for i, a in enumerate(v))
        y = "".join(DIGITS.get(c, c) for c in x)
        return int(y) if y.isascii() and y.isdigit() else None

    return numbers.map(value).astype("Int32")


def furniture(pages: DataFrame, shares: float = 0.1, alike: float = 0.3, reach: int = 3, salts: int = 8) -> DataFrame:
    """(cid, slot, header, pageno) of the edge lines that are page furniture; slots 0 and 1 from the top, -1 and -2 from the end.

    A header is an edge line whose letters stand on two pages or more and on ``shares`` of the document's, without the
    mark of a sentence's end, or one that differs from such a line in at most ``alike`` of its letters. A page number
    must keep the distance to the page that most numbers of the document keep, or that two more numbers keep within
    ``reach`` pages, as in a part with numbers of its own. The second line of an edge counts if the first one does. Counts
    come from partial sums; a document's lines meet its headers, a few per document, in ``salts`` parts."""
    n = F.size("lines")
    cut = F.expr("filter(array(struct(0 as slot, lines[0] as line), if(size(lines) > 3, struct(1 as slot, lines[1] as line), null), if(size(lines) > 1, struct(-1 as slot, element_at(lines, -1) as line), null), if(size(lines) > 3, struct(-2 as slot, element_at(lines, -2) as line), null)), x -> x is not null)")
    e = pages.where(n > 0).select("doc_id", "cid", "page", F.explode(cut).alias("e")).select("doc_id", "cid", "page", "e.slot", F.trim("e.line").alias("line"))
    whole = F.regexp_extract("line", rf"(?i){PAGE}", 1)
    left, right = F.regexp_extract("line", rf"^({NUMBER})\s{{2,}}\S", 1), F.regexp_extract("line", rf"\S\s{{2,}}({NUMBER})$", 1)
    beside = F.when(left != "", left).otherwise(right)
    name = F.when(whole != "", "").when(left != "", F.regexp_replace("line", r"^\S+\s{2,}", "")).when(right != "", F.regexp_replace("line", r"\s{2,}\S+$", "")).otherwise(F.col("line"))
    e = e.withColumn("number", F.pandas_udf(page_value, IntegerType())(F.when(whole != "", whole).otherwise(F.nullif(beside, F.lit(""))))).withColumn("name", name)
    key = F.lower(F.regexp_replace("name", r"[^\p{L}\p{N}]", ""))
    e = materialize(e.withColumn("key", F.when((F.length(key) >= 5) & ~F.col("name").rlike(rf"[.,;:{MARKS}]$"), key)).drop("name", "line"))

    total = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    keys = e.where("key is not null").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("on")).where("on >= 2")
    heads = keys.join(total, "doc_id").where(F.col("on") >= shares * F.col("pages")).select("doc_id", F.col("key").alias("head"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    longer = F.greatest(F.length("key"), F.length("head"))
    close = (F.abs(F.length("key") - F.length("head")) <= alike * longer) & ((F.col("key") == F.col("head")) | (F.levenshtein("key", "head") <= alike * longer))
    named = e.where("key is not null").withColumn("s", F.pmod(F.xxhash64("cid"), F.lit(salts)).cast("int")).join(heads, ["doc_id", "s"]).where(close).select("cid", "slot", F.lit(True).alias("header")).distinct()

    printed = e.where("number is not null").select("doc_id", "cid", "slot", "page", (F.col("number") - F.col("page")).alias("gap"))
    gaps = printed.groupBy("doc_id", "gap").agg(F.count_distinct("page").alias("on")).where("on >= 2")
    usual = gaps.groupBy("doc_id").agg(F.max_by("gap", F.struct("on", -F.abs("gap"))).alias("gap"))
    stand = printed.select("doc_id", "gap", "page").distinct()
    near = [d for d in range(-reach, reach + 1) if d]
    round_ = stand.select("doc_id", "gap", F.explode(F.array(*[F.col("page") + d for d in near])).alias("page")).groupBy("doc_id", "gap", "page").count().where("count >= 2").drop("count")
    counted = printed.join(usual, ["doc_id", "gap"], "left_semi").unionByName(printed.join(round_, ["doc_id", "gap", "page"], "left_semi")).select("cid", "slot", F.lit(True).alias("pageno")).distinct()

    both = named.join(counted, ["cid", "slot"], "full").select("cid", "slot", F.coalesce("header", F.lit(False)).alias("header"), F.coalesce("pageno", F.lit(False)).alias("pageno"))
    outer = both.where("slot in (0, -1)").select("cid", F.when(F.col("slot") == 0, 1).otherwise(-2).alias("slot"))
    return materialize(both.where("slot in (0, -1)").unionByName(both.where("slot in (1, -2)").join(outer, ["cid", "slot"], "left_semi")))


def body_lines(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, cid, idx, body): the lines of every chunk without its furniture."""
    slots = marks.groupBy("cid").agg(F.collect_set("slot").alias("slots"))
    kept = pages.join(slots, "cid", "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<int>")))
    size = F.size("lines")
    body = F.filter(F.transform("lines", lambda x, i: F.when(~F.array_contains("slots", i.cast("int")) & ~F.array_contains("slots", (i - size).cast("int")), x)), lambda x: x.isNotNull())
    return kept.select("doc_id", "cid", "idx", body.alias("body"))


def following(bodies: DataFrame, run: int = 512) -> DataFrame:
    """``bodies`` with ``next``, the first line of the next chunk of the document that has lines.

    Chunks are ordered within runs of ``run`` numbers and runs among themselves, so that no document is sorted whole."""
    part = F.floor(F.col("idx") / run)
    b = bodies.where(F.size("body") > 0).withColumn("part", part).withColumn("first", F.get("body", F.lit(0)))
    order = Window.partitionBy("doc_id", "part").orderBy("idx", "cid")
    b = b.withColumn("next", F.lead("first").over(order))
    heads = b.groupBy("doc_id", "part").agg(F.min(F.struct("idx", "cid", "first")).alias("m"))
    heads = heads.select("doc_id", "part", F.lead("m.first").over(Window.partitionBy("doc_id").orderBy("part")).alias("far"))
    last = F.lead("cid").over(order).isNull()
    out = b.withColumn("last", last).join(heads, ["doc_id", "part"], "left").select("doc_id", "cid", "idx", "body", F.when(F.col("last"), F.col("far")).otherwise(F.col("next")).alias("next"))
    return out.unionByName(bodies.where(F.size("body") == 0).withColumn("next", F.lit(None).cast("string")))


def vocabulary(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Counts of words, and of neighbouring parts of hyphened words, over all texts; words cut at a line end don't count."""
    cut = rf"(?<!\p{{L}})\p{{L}}++[{MARKS}]\r?\n\s*\S*"
    low = F.lower(F.when(F.col(text).rlike(rf"[{MARKS}]\r?\n"), F.regexp_replace(F.col(text), cut, " ")).otherwise(F.col(text)))
    found = F.regexp_extract_all(low, F.lit(TOKEN), 0)
    whole = materialize(texts.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    words = whole.select("n", F.explode(F.regexp_extract_all("w", F.lit(WORD), 0)).alias("word")).groupBy("word").agg(F.sum("n").alias("n"))
    parts = whole.where(F.col("w").contains("-") & ~F.col("w").rlike(r"[^-\p{L}]")).select(F.split("w", "-").alias("p"), "n")
    pairs = parts.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.get("p", i).alias("a"), F.get("p", i + 1).alias("b")))).alias("x"))
    return materialize(words), materialize(pairs.groupBy("x.a", "x.b").agg(F.sum("n").alias("n")))


# -- skip-gram vectors ------------------------------------------------------------------------------------------------

DIM, SPAN, NEGATIVES, BATCH = 24, 2, 5, 2048


@dataclass
class Vectors:
    """Word vectors and context vectors of the frequent words; figures are one word, the last."""

    words: pa.Array
    word: np.ndarray
    context: np.ndarray

    def number(self, words: pa.Array) -> np.ndarray:
        """The rows of words; -1 for a word that isn't frequent."""
        at = np.asarray(pc.index_in(words, self.words).fill_null(-1)).astype(np.int32)
        return np.where(np.asarray(pc.fill_null(pc.utf8_is_digit(words), False)), len(self.words), at)


def _added(m: np.ndarray, rows: np.ndarray, steps: np.ndarray) -> None:
    """Add to each row the sum of its steps over the root of their number."""
    order = np.argsort(rows, kind="stable")
    sorted_ = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    n = np.diff(np.append(starts, len(rows)))
    m[sorted_[starts]] += np.add.reduceat(steps[order], starts, axis=0) / np.sqrt(n)[:, None]


def _train(batches: Iterator[pa.RecordBatch], v: Vectors, share: np.ndarray, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    """One task's pass of skip-gram with negative sampling, from the shared vectors on: its vectors times their words' counts."""
    word, context, seen = v.word.copy(), v.context.copy(), np.zeros(len(v.word))
    draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
    keep = np.minimum(1.0, np.sqrt(0.3 / len(share) / np.maximum(share, 1e-12)))  # commoner words are passed over at times
    odds = np.cumsum(share**0.75)
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            lists = whole.column(0).slice(at, 1024)
            x = v.number(lists.flatten())
            doc = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            some = (x >= 0) & (draw.random(len(x)) < keep[x])
            x, doc = x[some], doc[some]
            seen += np.bincount(x, minlength=len(seen))
            near = [(x[:-s][ok], x[s:][ok]) for s in range(1, SPAN + 1) for ok in (doc[:-s] == doc[s:],)]
            pairs = np.array([np.concatenate([p for ab in near for p in ab]), np.concatenate([p for a, b in near for p in (b, a)])])
            pairs = pairs[:, draw.permutation(pairs.shape[1])]
            for i in range(0, pairs.shape[1], BATCH):
                a, b = pairs[:, i : i + BATCH]
                wrong = np.searchsorted(odds, draw.random(64) * odds[-1])
                w, c, z = word[a], context[b], context[wrong]
                right = rate / (1 + np.exp(np.clip((w * c).sum(1), -8, 8)))[:, None]
                off = -rate * NEGATIVES / len(wrong) / (1 + np.exp(np.clip(-w @ z.T, -8, 8)))
                _added(word, a, right * c + off @ z)
                _added(context, b, right * w)
                _added(context, wrong, off.T @ w / np.sqrt(len(a)))
    at = np.flatnonzero(seen)
    both = np.concatenate([word[at], context[at]], axis=1) * seen[at, None]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at]), *[pa.array(c.astype(np.float64)) for c in both.T]], names=["node", "n", *[f"x{k}" for k in range(2 * DIM)]])


def skipgram_vectors(seq: DataFrame, words: DataFrame, shared_words: int = 1 << 15, rounds: int = 3, seed: int = 1) -> Vectors:
    """Skip-gram vectors with negative sampling of the most frequent words, ``shared_words`` at most (6 MB at the default).

    ``seq`` has lists of words, ``words`` the words' counts. Every round each task trains on its own texts from the
    vectors of the round before, and Spark averages what the tasks made of each word, weighted by how often they saw it."""
    known = most_frequent(words.where("n >= 4 and not word rlike '^[0-9]+$'"), "n", shared_words).select("word", "n").toArrow()
    figures = words.where("word rlike '^[0-9]+$'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = np.append(known.column("n").to_numpy(), max(1, figures)).astype(float)
    share /= share.sum()
    start = np.random.default_rng(seed).random((len(share), DIM)) - 0.5
    v = Vectors(known.column("word").combine_chunks(), start.astype(np.float32), np.zeros((len(share), DIM), np.float32))
    sc = seq.sparkSession.sparkContext
    columns = [f"x{k}" for k in range(2 * DIM)]
    for k in range(rounds):
        shared = sc.broadcast(v)
        made = seq.select("w").mapInArrow(lambda b, s=shared, k=k: _train(b, s.value, share, 0.25 / (k + 1), seed + k), ", ".join(["node int", "n double", *[f"{c} double" for c in columns]]))
        got = made.groupBy("node").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()
        at, mean = got.column("node").to_numpy(), np.stack([got.column(c).to_numpy() for c in columns], axis=1) / got.column("n").to_numpy()[:, None]
        word, context = v.word.copy(), v.context.copy()
        word[at], context[at] = mean[:, :DIM], mean[:, DIM:]
        v = Vectors(v.words, word, context)
    return v


# -- misread words ----------------------------------------------------------------------------------------------------


def _edits(word: str, most: int = 2) -> dict[str, int]:
    """Spellings that glyph confusions may have turned into ``word``, with the number of confusions."""
    found, last = {}, {word}
    for k in range(1, most + 1):
        new = set()
        for w in last:
            for true, seen in GLYPHS:
                at = w.find(seen)
                while at >= 0 and true != seen:
                    new.add(w[:at] + true + w[at + len(seen) :])
                    at = w.find(seen, at + 1)
        last = {w for w in new if w not in found and w != word}
        found |= dict.fromkeys(last, k)
    return found


def confusions(word: str, right: str, most: int = 2) -> int:
    """The least number of glyph confusions that turn ``right`` into ``word``; ``most`` + 1 if more."""
    i = next((i for i, (a, b) in enumerate(zip(word, right)) if a != b), min(len(word), len(right)))
    if word[i:] == right[i:]:
        return 0
    best = most + 1
    for true, seen in GLYPHS if most else ():
        for at in range(max(0, i - 1), i + 1):
            if word.startswith(seen, at) and right.startswith(true, at):
                best = min(best, 1 + confusions(word[at + len(seen) :], right[at + len(true) :], most - 1))
    return best


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(w, n, c, k) for w, n in zip(f["word"], f["n"]) for c, k in _edits(w).items() if c.isalpha()]
        yield pd.DataFrame(rows, columns=["word", "n", "right", "edits"])


def _long_candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f["edits"] = [confusions(w, c) for w, c in zip(f["word"], f["right"])]
        yield f[f["edits"].between(1, 2)].astype({"edits": "int32"})


def linked_words(suspects: DataFrame, common: DataFrame, long: int = 48) -> DataFrame:
    """(word, n, right, edits, m): suspects (word, n) with the common spellings (right, m) up to two confusions away.

    The spellings of a word are listed and looked up; their number grows with the square of its length, so words of more
    than ``long`` letters meet the common words that agree in all letters which aren't subject to confusion."""
    short = suspects.where(F.length("word") <= long).repartition("word").mapInPandas(_candidates, "word string, n bigint, right string, edits int").join(common, "right")
    loose = f"[{''.join(sorted({c for pair in GLYPHS for c in ''.join(pair)}))}]"
    far = suspects.where(F.length("word") > long).withColumn("rest", F.regexp_replace("word", loose, ""))
    held = common.where(F.length("right") > long - 4).withColumn("rest", F.regexp_replace("right", loose, ""))
    met = far.join(held, "rest").where(F.abs(F.length("word") - F.length("right")) <= 4).select("word", "n", "right", "m")
    return short.select("word", "n", "right", "edits", "m").unionByName(met.mapInPandas(_long_candidates, "word string, n bigint, right string, m bigint, edits int"))


def _fit(batches: Iterator[pa.RecordBatch], v: Vectors) -> Iterator[pa.RecordBatch]:
    """How well each candidate goes with the words around the place: cosine of its vector with the mean of their context vectors."""
    unit = v.word / np.maximum(np.linalg.norm(v.word, axis=1, keepdims=True), 1e-9)
    for batch in batches:
        lists, right = batch.column("near"), v.number(batch.column("right"))
        near = v.number(lists.flatten())
        row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        row, near = row[near >= 0], near[near >= 0]
        mean = np.stack([np.bincount(row, v.context[near, k], len(lists)) for k in range(DIM)], axis=1)
        fit = (unit[right] * mean).sum(1) / np.maximum(np.linalg.norm(mean, axis=1), 1e-9)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("cid", "word", "right", "edits", "ratio")], pa.array(np.where(right >= 0, fit, 0.0))], names=["cid", "word", "right", "edits", "ratio", "fit"])


MIXED_NUMBER = r"^(?=.*[0-9].*[0-9])(?=.*[oоlзбвsb])[0-9oоlзбвsb]*[0-9oоl]$"


def misread_words(flow: DataFrame, words: DataFrame, sure: float = 25.0, some: float = 6.0, weight: float = 4.0) -> DataFrame:
    """(cid, word, right) of words and numbers with wrongly recognised characters; ``flow`` has cid and text.

    A word is suspected if it holds digits or signs among its letters, or is rare against a spelling it could have come
    from by glyph confusions, ``some`` times as frequent at least. Frequency and context judge together: the logarithm of the ratio of counts plus ``weight``
    times the fit of the spelling's skip-gram vector with the words around must reach that of ``sure``; of several
    spellings the best is taken. A number with letters for digits may have come from any number, so numbers count and
    stand in the vectors as one word. A word with digits among its letters that this doesn't settle is misread all the
    same; it is spelled by table if that gives a word that occurs, else ``right`` is null."""
    seq = materialize(flow.select("cid", F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0).alias("w")))
    vectors = skipgram_vectors(seq, words)
    tokens = seq.select("cid", F.col("w").alias("all"), F.posexplode("w").alias("pos", "word"))
    spelled = seq.select(F.explode("w").alias("word")).distinct().join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    broken = F.col("word").rlike(r"\p{L}") & F.col("word").rlike("[0-9!]")
    number = F.col("word").rlike(MIXED_NUMBER)
    common = words.where("n >= 4").select(F.col("word").alias("right"), F.col("n").alias("m"))
    linked = linked_words(spelled.where((F.length("word") >= 3) & F.col("word").rlike(r"\p{L}") & ~number).select("word", "n"), common)
    figures = words.where("word rlike '^[0-9]+$'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m"))
    mixed = spelled.where(number).join(F.broadcast(figures), F.lit(True)).select("word", "n", F.translate("word", "".join(DIGITS), "".join(DIGITS.values())).alias("right"), F.lit(1).alias("edits"), "m")
    linked = linked.unionByName(mixed)
    linked = linked.withColumn("ratio", F.when(broken, F.col("m") * 10.0).otherwise(F.col("m") / F.col("n"))).where(F.col("ratio") >= some)
    linked = materialize(linked.select("word", "right", "edits", "ratio"))
    reach = 2 * SPAN
    near = F.filter(F.slice("all", F.greatest(F.col("pos") + 1 - reach, F.lit(1)), 2 * reach), lambda x: x != F.col("word"))
    places = tokens.join(linked, "word").select("cid", "word", "right", "edits", "ratio", near.alias("near"))
    shared = flow.sparkSession.sparkContext.broadcast(vectors)
    kind = flow.schema["cid"].dataType.simpleString()
    fitted = places.mapInArrow(lambda b: _fit(b, shared.value), f"cid {kind}, word string, right string, edits int, ratio double, fit double")
    worth = F.log("ratio") + weight * F.col("fit")
    known = fitted.where(worth >= float(np.log(sure))).groupBy("cid", "word").agg(F.max_by("right", F.struct(-F.col("edits"), worth, "right")).alias("right"))
    inner = F.col("word").rlike(r"\p{L}[0-9!]+\p{Ll}|^[0-9]\p{L}{4}|\p{L}{4}[0-9]$") & ~number
    by_table = F.when(F.col("word").rlike("[А-яё]"), F.translate("word", *FIGURES["cyr"])).otherwise(F.translate("word", *FIGURES["lat"]))
    odd = tokens.where(inner).select("cid", "word", by_table.alias("table")).distinct().join(known, ["cid", "word"], "left_anti")
    rare = words.select(F.col("word").alias("table"), F.col("word").alias("right"))
    return materialize(known.unionByName(odd.join(rare, "table", "left").select("cid", "word", "right")))


@dataclass
class Repair:
    noise: DataFrame  # cid, noise
    text: DataFrame  # cid, text: continuous paragraphs
    words: DataFrame  # cid, word, right


def repair_scans(chunks: DataFrame) -> Repair:
    """Noise found in the chunks of scanned documents, and their text as continuous lines without it.

    ``chunks`` has cid, doc_id, idx, text, kind, page_start and char_start; other columns are ignored. Rows without cid,
    document, page or text have no noise; repeated cids count once. Word counts cover the texts of all chunks."""
    pages = scanned_pages(chunks)
    words, pairs = vocabulary(chunks.where("text is not null"), "text")
    marks = furniture(pages)
    body = materialize(following(body_lines(pages, marks)))

    ends = body.select("cid", F.posexplode("body").alias("i", "line"), "body", "next")
    after = F.coalesce(F.get("body", F.col("i") + 1), F.col("next"))
    tail = rf"(\p{{L}}+)[{MARKS}]$"
    cuts = ends.where(F.col("line").rlike(tail)).select("cid", "i", F.lower(F.regexp_extract("line", tail, 1)).alias("a"), F.right("line", F.lit(1)).alias("mark"), F.regexp_extract(after, r"^\s*(\p{L}+)", 1).alias("b"))
    cuts = cuts.where(F.col("b").rlike(r"^\p{Ll}")).withColumn("word", F.concat("a", "b"))
    lefts, rights = pairs.groupBy("a").agg(F.lit(True).alias("heads")), pairs.groupBy("b").agg(F.lit(True).alias("tails"))
    judged = cuts.join(words.withColumnRenamed("n", "joined"), "word", "left").join(pairs.withColumnRenamed("n", "apart"), ["a", "b"], "left")
    judged = judged.join(lefts, "a", "left").join(rights, "b", "left").na.fill(0, ["joined", "apart"])
    own = (F.col("mark") == "-") & ((F.col("apart") > F.col("joined")) | ((F.col("joined") == 0) & F.coalesce("heads", "tails", F.lit(False))))
    judged = materialize(judged.select("cid", "i", own.alias("own")))

    seams = judged.groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("i", "own"))).alias("seams"))
    laid = body.join(seams, "cid", "left")

    def seam(line: Column, i: Column) -> Column:
        own_mark = F.try_element_at(F.coalesce("seams", F.create_map().cast("map<int,boolean>")), i.cast("int"))
        return F.when(own_mark, F.rtrim(line)).when(~own_mark, F.regexp_replace(line, rf"[{MARKS}]$", "")).otherwise(F.concat(line, F.lit(" ")))

    text = F.trim(F.array_join(F.transform("body", seam), ""))
    flow = materialize(laid.select("cid", text.alias("text")))
    wrong = misread_words(flow, words)
    noise = judged.where("not own").select("cid", F.lit("hyphen").alias("noise"))
    noise = noise.union(wrong.select("cid", F.lit("misread"))).union(marks.where("header").select("cid", F.lit("header"))).union(marks.where("pageno").select("cid", F.lit("pageno")))
    fixes = wrong.where("right is not null").groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("fix"))
    pieces = F.regexp_extract_all("text", F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}]+|."), 0)
    put = F.transform(pieces, lambda p: F.coalesce(F.try_element_at(F.coalesce("fix", F.create_map().cast("map<string,string>")), F.lower(p)), p))
    clean = flow.join(fixes, "cid", "left").select("cid", F.array_join(put, "").alias("text"))
    return Repair(noise.distinct(), clean, wrong)
