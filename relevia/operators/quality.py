"""Corpus quality: volumes, boilerplate, copies, hygiene, metadata, coverage, and comparing two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.functions import text as T

# Patterns of unclean text, by name.
HYGIENE = {
    "nbsp": r"[\x{00A0}\x{202F}\x{2007}]",
    "zero_width": r"[\x{200B}\x{200C}\x{200D}\x{2060}]",
    "bom": r"\x{FEFF}",
    "soft_hyphen": r"\x{00AD}",
    "ctrl": r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]",
    "symbol_pua": r"[\x{F000}-\x{F0FF}]",
    "cr": r"\r",
    "tab": r"\t",
    "spaces_2plus": r"(?<=[^\s\p{Z}])  +(?=[^\s\p{Z}])",
    "trailing_space": r" +\n",
    "newlines_3plus": r"\n{3,}",
}
ENDS = r"[.!?…;:»)]$"


def volumes(chunks: DataFrame, groups: list[Column], long_words: int = 560) -> DataFrame:
    """Per group and in total (group null): documents, chunks, characters, words, chunks of more than ``long_words`` words.

    Grouping sets make the groups and the total in one pass."""
    names = [f"g{i}" for i in range(len(groups))]
    rows = chunks.select(*[g.alias(n) for g, n in zip(groups, names)], "doc_id", F.length("text").alias("chars"), F.size(T.tokens(F.col("text"))).alias("words"))
    sets = [[n] for n in names] + [[]]
    return rows.groupingSets(sets, *names).agg(
        F.grouping_id().alias("level"),
        F.count_distinct("doc_id").alias("docs"),
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.count_if(F.col("words") > long_words).alias("long_chunks"),
    )


def boilerplate(chunks: DataFrame, key: str, share: float = 0.1, least: int = 3) -> DataFrame:
    """(doc_id, line, n): normalised lines of 5 to 80 characters, not only digits, below the indexer's labels, in at least
    max(least, share) of a document's chunks."""
    lines = F.transform(F.split(T.own_text(F.col("text")), "\n"), T.norm)
    kept = F.filter(F.array_distinct(lines), lambda x: F.length(x).between(5, 80) & ~x.rlike(r"^\p{Nd}+$"))
    rows = chunks.where("text is not null and doc_id is not null").select("doc_id", key, kept.alias("lines"))
    sizes = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"))
    counted = rows.select("doc_id", F.explode("lines").alias("line")).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counted.join(sizes, "doc_id").where(F.col("n") >= share * F.col("size")).select("doc_id", "line", "n")


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, repeats): chunks whose normal form came before in the document; digests travel, not texts."""
    rows = chunks.where("text is not null and doc_id is not null").select("doc_id", F.md5(T.norm(T.own_text(F.col("text")))).alias("h"))
    return rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("chunks"), F.sum(F.col("n") - 1).alias("repeats")).where("repeats > 0")


def hygiene(texts: DataFrame, text: str, group: Column) -> DataFrame:
    """(grp, n, share of texts with each pattern of HYGIENE, share of short texts): one pass, eleven conditional means."""
    t = F.col(text)
    short = F.size(F.regexp_extract_all(T.own_text(t), F.lit("[A-Za-zА-Яа-яЁё]{2,}"), 0)) < 3
    rows = texts.where(t.isNotNull()).select(group.alias("grp"), *[t.rlike(p).cast("double").alias(n) for n, p in HYGIENE.items()], short.cast("double").alias("short"))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in [*HYGIENE, "short"]])


def boundaries(chunks: DataFrame, group: Column) -> DataFrame:
    """(grp, n, ends, lower, median_chars): chunks that end a sentence, begin in lower case, and their median length."""
    body = F.regexp_replace(T.own_text(F.col("text")), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    rows = chunks.where("text is not null").select(group.alias("grp"), body.rlike(ENDS).cast("double").alias("ends"), body.rlike(r"^\p{Ll}").cast("double").alias("lower"), F.length("text").alias("chars"))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("ends").alias("ends"), F.avg("lower").alias("lower"), F.median("chars").alias("median_chars"))


def filled_rates(rows: DataFrame, group: Column, columns: list[str]) -> DataFrame:
    """(grp, column, n, filled): how many values of each column are neither null nor empty, unpivoted."""
    kinds = dict(rows.dtypes)
    flags = [F.struct(F.lit(c).alias("column"), T.filled(F.col(c), kinds[c]).alias("ok")) for c in columns]
    long = rows.select(group.alias("grp"), F.explode(F.array(*flags)).alias("f"))
    return long.groupBy("grp", F.col("f.column").alias("column")).agg(F.count(F.lit(1)).alias("n"), F.count_if("f.ok").alias("filled"))


def context(chunks: DataFrame) -> DataFrame:
    """(cid, doc_id, has_title, has_number, has_year): what a chunk says of its document's title.

    has_title: at least half of the first six stems of the title (words of four letters or more that aren't numbers, cut to
    five, file suffixes removed) stand in the text; false without stems. has_number: the title's act number stands in it,
    whatever the sign between its parts; has_year: the title's year; both null where the title has none. Labels count."""
    title = F.regexp_replace("title", r"\.(?:pdf|docx|pptx|txt|xlsx)$", "")
    words = F.filter(T.tokens(title), lambda x: (F.length(x) >= 4) & ~x.rlike("^[0-9]+$"))
    stems = F.slice(F.transform(words, lambda x: F.left(x, F.lit(5))), 1, 6)
    low = T.norm(F.col("text"))
    hits = T.once(low, lambda t: F.size(F.filter(stems, lambda x: F.contains(t, x))))
    number = F.nullif(F.regexp_extract(T.norm(F.col("title")), r"(?<![0-9])([0-9]{1,5}-[а-я]{1,3})(?![а-я])", 1), F.lit(""))
    said = F.transform(F.regexp_extract_all(low, F.lit(r"(?<![0-9])[0-9]{1,5}\s*[^\p{L}\p{N}_]?\s*[а-я]{1,3}(?![а-я])"), 0), lambda x: F.regexp_replace(x, r"^([0-9]+)[^0-9а-я]*", "$1-"))
    year = F.nullif(F.regexp_extract("title", r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1), F.lit(""))
    years = F.regexp_extract_all(low, F.lit(r"(?<![0-9])[0-9]{4}(?![0-9])"), 0)
    rows = chunks.where("title is not null and text is not null")
    return rows.select("cid", "doc_id", (hits * 2 >= F.greatest(F.size(stems), F.lit(1))).alias("has_title"), F.array_contains(said, number).alias("has_number"), F.array_contains(years, year).alias("has_year"))


def text_defects(chunks: DataFrame, group: Column, phrase: str) -> DataFrame:
    """(grp, chunks, breaks, control_breaks, soft_hyphens, controls, phrase_upper, phrase_any): words broken at line ends, in
    all and with a control character for the hyphen; chunks with soft hyphens, controls, and a phrase in capitals or in any case.

    ``phrase`` is a pattern in lower case; labels don't count."""
    t = T.own_text(F.col("text"))
    rows = chunks.where("text is not null").select(
        group.alias("grp"),
        F.regexp_count(t, F.lit(r"[A-Za-zА-Яа-яЁё][-\x{00AD}\x{2010}\x{00AC}\x02\x1F]\s*\n\s*[a-zа-яё]")).alias("breaks"),
        F.regexp_count(t, F.lit(r"[A-Za-zА-Яа-яЁё][\x00-\x08\x0B\x0C\x0E-\x1F]\s*\n?\s*[a-zа-яё]")).alias("control_breaks"),
        F.contains(t, F.lit("\u00ad")).alias("soft"), T.has_controls(t).alias("ctrl"),
        t.rlike(phrase.upper().replace(r"\S", r"\s")).alias("upper"), F.lower(t).rlike(phrase).alias("any"),
    )
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("breaks").alias("breaks"), F.sum("control_breaks").alias("control_breaks"), F.count_if("soft").alias("soft_hyphens"),
        F.count_if("ctrl").alias("controls"), F.count_if("upper").alias("phrase_upper"), F.count_if("any").alias("phrase_any"),
    )


def gram_coverage(refs: DataFrame, ref: str, doc: str, text: str, chunks: DataFrame, chunk_doc: str, chunk_key: str, chunk_text: str, n: int = 3) -> DataFrame:
    """(ref, grams, in_doc, in_chunk, best): share of a reference's distinct n-grams found in its document, and in its best chunk
    (the smaller key of equal ones; null if none shares a gram).

    Grams meet on (document, gram), so the work follows the references' own documents; references without grams are
    left out, a document without chunks covers nothing."""
    asked = refs.where(F.col(ref).isNotNull()).select(F.col(ref).alias("ref"), F.col(doc).alias("doc"), F.explode(T.grams(T.tokens(F.col(text)), n)).alias("gram")).distinct()
    own = chunks.join(refs.select(F.col(doc).alias("__d")).distinct(), F.col(chunk_doc) == F.col("__d"), "left_semi")
    have = own.select(F.col(chunk_doc).alias("doc"), F.col(chunk_key).alias("chunk"), F.explode(T.grams(T.tokens(F.col(chunk_text)), n)).alias("gram"))
    met = asked.join(have, ["doc", "gram"]).distinct()
    per = met.groupBy("ref", "chunk").agg(F.count(F.lit(1)).alias("c")).groupBy("ref")
    best = per.agg(F.max("c").alias("most"), F.min(F.struct((-F.col("c")).alias("o"), "chunk"))["chunk"].alias("best"))
    whole = met.groupBy("ref").agg(F.count_distinct("gram").alias("d"))
    size = asked.groupBy("ref").agg(F.count_distinct("gram").alias("grams"))
    out = size.join(whole, "ref", "left").join(best, "ref", "left")
    return out.select("ref", "grams", F.coalesce(F.col("d") / F.col("grams"), F.lit(0.0)).alias("in_doc"), F.coalesce(F.col("most") / F.col("grams"), F.lit(0.0)).alias("in_chunk"), "best")


def number_coverage(refs: DataFrame, ref: str, doc: str, text: str, chunks: DataFrame) -> DataFrame:
    """(ref, numbers, found): numbers of four digits or more (no years of 2010 to 2029) of a reference that stand in a chunk of
    its document, separators between digits aside, also as part of a longer number.

    The chunks' runs of digits are cut into stretches of the lengths asked for and meet the numbers on (document, digits)."""
    wanted = refs.select(F.col(ref).alias("ref"), F.col(doc).alias("doc_id"), F.explode(T.figures_in(F.col(text))).alias("num")).distinct()
    lengths = F.sequence(F.lit(4), F.least(F.length("run"), F.lit(24)))
    runs = chunks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode(T.digit_runs(F.col("text"))).alias("run")).distinct()
    parts = runs.select("doc_id", "run", F.explode(lengths).alias("n")).select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("n") + 1), lambda i: F.substring(F.col("run"), i, F.col("n")))).alias("num"))
    hit = wanted.join(parts.distinct().withColumn("hit", F.lit(1)), ["doc_id", "num"], "left")
    return hit.groupBy("ref").agg(F.count(F.lit(1)).alias("numbers"), F.count("hit").alias("found"))


def coverage_report(rows: DataFrame, by: str, value: str, enough: float = 0.8) -> DataFrame:
    """(by, n, mean, least, covered, below) of a share per slice and in total (null): rows of at least and of less than ``enough``."""
    g = F.col(value) >= enough
    return rows.groupingSets([[by], []], by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.count_if(g).alias("covered"), F.count_if(~g).alias("below"), F.grouping_id().alias("level")
    )


def report_delta(old: DataFrame, new: DataFrame, skip: str = r"parse_ms$|seconds$") -> DataFrame:
    """(metric, old, new) that differ between two long reports (metric, value), missing ones as null; times are skipped."""
    a = old.where(~F.col("metric").rlike(skip)).select("metric", F.col("value").alias("old"))
    b = new.where(~F.col("metric").rlike(skip)).select("metric", F.col("value").alias("new"))
    return a.join(b, "metric", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def flatten_report(rows: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """A wide report as long rows (metric, value): names and column joined by dots."""
    pairs = [F.struct(F.concat_ws(".", *[F.coalesce(F.col(n).cast("string"), F.lit("all")) for n in names], F.lit(v)).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]
    return rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.metric", "p.value")
