"""Column builders for text: normal forms, tokens, n-grams, shapes, numbers, dates, keys.

All take and return columns, so Catalyst keeps them in generated code and prunes what isn't used. A null in gives a null
out unless said otherwise. Regular expressions are written for Unicode: Java's own ``\\w`` and ``\\s`` know ASCII only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of written dates, labels the indexer puts on top of a chunk, superscript digits.
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
LABELS = "Документ|Раздел|Лист|Таблица"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
SPACE = r"[\s\p{Z}]+"


def fold(text: Column) -> Column:
    """Lower case with ё as е."""
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def norm(text: Column) -> Column:
    """Folded, white space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(fold(text), SPACE, " "))


def norm_hyphens(text: Column) -> Column:
    """``norm`` with all dashes as hyphens."""
    return F.regexp_replace(norm(text), "[‐‑‒–—−]", "-")


def norm_letters(text: Column) -> Column:
    """Folded letters and digits only, separated by single blanks."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Folded runs of digits, Latin and Cyrillic letters, in order and with repeats."""
    return F.regexp_extract_all(fold(text), F.lit("[0-9a-zа-я]+"), 0)


def padded(text: Column) -> Column:
    """Word sequence with a blank at either end, for containment of whole phrases."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0)
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the word sequence of ``phrase`` stands in ``text``; both as given by ``padded``."""
    return F.contains(text, phrase)


def within_bytes(words: Column, limit: int) -> Column:
    """Words of fewer than ``limit`` bytes in UTF-8; one of exactly ``limit`` is dropped."""
    return F.filter(words, lambda w: F.octet_length(w) < limit)


def loses_words(words: Column, limit: int) -> Column:
    """Whether the byte limit drops a word."""
    return F.exists(words, lambda w: F.octet_length(w) >= limit)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is used inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(words: Column, n: int = 3) -> Column:
    """Distinct n-grams; fewer words than n make one gram of all of them, no words none."""

    def made(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        joined = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(joined)

    return once(words, made)


def own_text(text: Column) -> Column:
    """The text without all of the indexer's label lines on top."""
    return F.regexp_replace(text, rf"^(?:(?:{LABELS}): [^\n]*\n)+", "")


def strip_prefix(text: Column) -> Column:
    """The text without the first document label only."""
    return F.regexp_replace(text, r"^Документ: [^\n]*\n", "")


def window_text(text: Column, start: Column, length: Column, budget: int = 1800) -> Column:
    """``budget`` characters around the middle of the stretch at ``start`` (from 0), clamped to the text."""
    first = F.floor(start + length / 2 - budget / 2).cast("int")
    first = F.greatest(F.lit(0), F.least(first, F.length(text) - budget))
    return F.substring(text, first + 1, F.lit(budget))


def is_code(token: Column) -> Column:
    """A designation: a digit together with a letter or an underscore."""
    return token.rlike("[0-9]") & token.rlike(r"[\p{L}_]")


def junk_title(title: Column) -> Column:
    """Titles that say nothing: none, those of office programs, numbered documents, untitled ones, paths."""
    return F.coalesce(F.trim(title), F.lit("")).rlike(r"(?iu)^(?:$|microsoft (?:word|excel|powerpoint)\s*-|please read first|документ[0-9]*$|книга[0-9]*$|презентация[0-9]*$|untitled|без названия|[a-z]:\\|/)")


def has_emoji(text: Column) -> Column:
    return text.rlike(r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]")


def has_controls(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def filled(value: Column, kind: str = "string") -> Column:
    """Neither null nor empty, for strings, arrays and maps."""
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    return F.coalesce(F.size(value) > 0, F.lit(False)) if kind.startswith(("array", "map")) else value.isNotNull()


def numbers_in(text: Column) -> Column:
    """Signed numbers with blanks between thousands and a decimal comma or point, as doubles in order."""
    found = F.regexp_extract_all(text, F.lit(r"[-−]?\d{1,3}(?:[ \u00a0\u2009\u202f]\d{3})+(?:[.,]\d+)?|[-−]?\d+(?:[.,]\d+)?"), 0)
    plain = F.transform(found, lambda x: F.regexp_replace(F.translate(x, "−,", "-."), "[ \u00a0\u2009\u202f]", "").try_cast("double"))
    return F.filter(plain, lambda x: x.isNotNull())


def sums_in(text: Column) -> Column:
    """Grouped or at least four-digit whole numbers of 1000 or more that are no years, as text without blanks."""
    found = F.regexp_extract_all(text, F.lit(r"\d{1,3}(?:[ \u00a0\u2009\u202f]\d{3})+|\d{4,}"), 0)
    bare = F.transform(found, lambda x: F.regexp_replace(x, "[ \u00a0\u2009\u202f]", ""))
    return F.array_distinct(F.filter(bare, lambda x: ~x.rlike("^(?:19|20)[0-9]{2}$") & (x.try_cast("double") >= 1000)))


def figures_in(text: Column) -> Column:
    """Distinct numbers of four digits or more without their separators, years of 2010 to 2029 left out."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9\s\p{Z},.]*[0-9]"), 0)
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"[\s\p{Z},.]", ""))
    return F.array_distinct(F.filter(bare, lambda x: (F.length(x) >= 4) & ~x.rlike("^20[12][0-9]$")))


def digit_runs(text: Column) -> Column:
    """Distinct runs of four digits or more once single separators between digits are gone."""
    flat = F.regexp_replace(text, r"(?<=[0-9])[\s\p{Z},.](?=[0-9])", "")
    return F.array_distinct(F.regexp_extract_all(flat, F.lit("[0-9]{4,}"), 0))


def human_dates(iso: Column) -> Column:
    """The two written forms of an ISO date, ``1 января 2025`` and ``01.01.2025``; null for other text."""
    d = F.try_to_date(iso, "yyyy-MM-dd")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))
    return F.when(d.isNotNull(), F.array(F.concat_ws(" ", F.day(d).cast("string"), month, F.year(d).cast("string")), F.date_format(d, "dd.MM.yyyy")))


def superscripts_to_digits(text: Column) -> Column:
    return F.translate(text, SUPERSCRIPTS, "0123456789")


def designations(text: Column, stop: list[str] | None = None) -> Column:
    """Act numbers such as 5348-У and words of two or more Latin capitals, without those of ``stop``; sorted, distinct."""
    found = F.regexp_extract_all(text, F.lit(r"(?iu)\d{1,5}-[а-яё]{1,3}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[A-Z]{2,}(?![\p{L}\p{N}])"), 0)
    kept = F.filter(found, lambda x: ~F.upper(x).isin(stop)) if stop else found
    return F.array_sort(F.array_distinct(kept))


def safe_name(title: Column, limit: int = 90) -> Column:
    """A title as a file name: forbidden characters as blanks, single blanks, no dots or blanks at the ends, cut."""
    flat = F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|\x00-\x1F]', " "), SPACE, " ")
    return F.regexp_replace(F.left(F.regexp_replace(flat, r"^[ .]+|[ .]+$", ""), F.lit(limit)), r"[ .]+$", "")


def slug(text: Column) -> Column:
    """Lower-case Latin letters and digits, runs of anything else as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def document_of(path: Column) -> Column:
    """What follows the first ``/corpus/`` of a path; a path without it stays."""
    return F.regexp_replace(path, r"(?s)^.*?/corpus/", "")


def path_key(doc: Column) -> Column:
    """A document id as a flat file key."""
    return F.replace(doc, F.lit("/"), F.lit("__"))


def extension(doc: Column) -> Column:
    return F.lower(F.regexp_extract(doc, r"\.([^./]+)$", 1))


def cache_key(*parts: Column) -> Column:
    """Content key of several texts: SHA-1 over them with a zero byte between."""
    return F.sha1(F.concat_ws("\x00", *parts).cast("binary"))


def hash_third(salt: str, key: Column) -> Column:
    """SHA-1 of a salted key modulo 3: as 16 leaves 1, the digit sum of its hexadecimal form decides."""
    hexes = F.split(F.sha1(F.concat(F.lit(salt + "\x00"), key).cast("binary")), "")
    return F.aggregate(hexes, F.lit(0), lambda s, h: s + F.conv(h, 16, 10).cast("int")) % 3


def need_text(scenario: Column, query: Column, base_query: Column) -> Column:
    """The information need: the base question for the reworded scenarios 2 to 4, else the question itself."""
    return F.when(scenario.between(2, 4), F.coalesce(base_query, query)).otherwise(query)


def markdown_kind(line: Column) -> Column:
    """row, head, num, bullet or text."""
    return (
        F.when(line.rlike(r"^\s*\|.*\|\s*$"), "row")
        .when(line.rlike(r"^#{1,6}\s"), "head")
        .when(line.rlike(r"^\s*\d+(?:\.\d+)*[.)]\s"), "num")
        .when(line.rlike(r"^\s*[-*•]\s"), "bullet")
        .otherwise("text")
    )


def markdown_clean(text: Column) -> Column:
    """Markdown without heading marks, emphasis, links, code ticks and table bars."""
    t = F.regexp_replace(text, r"(?m)^#{1,6}\s+", "")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"[*_`]{1,3}([^*_`\n]+)[*_`]{1,3}", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)^\s*\|?[\s:|-]+\|\s*$", ""), r"\s*\|\s*", " ")


def parent_of(kind: Column, table_id: Column, page: Column, section: Column) -> Column:
    """The larger unit of a chunk: its table, else its page, else its section, else none."""
    tag = F.when(table_id.isNotNull(), "table").when(page.isNotNull(), "page").when(section.isNotNull(), "section").otherwise("none")
    return F.struct(tag.alias("unit"), F.coalesce(table_id, page.cast("string"), section, F.lit("")).alias("key"))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, half-even; null for an empty whole."""
    return F.bround(F.try_divide(100.0 * part, whole), digits)


def interval_text(mean: Column, lo: Column, hi: Column, signed: bool = False) -> Column:
    """``0.610 [0.598–0.622]``; with a sign if asked."""
    f = "%+.3f" if signed else "%.3f"
    return F.format_string(f"{f} [{f}–{f}]", mean, lo, hi)


def any_of(values: Column, test: Callable[[Column], Column]) -> Column:
    """Whether a value passes; false for null and empty arrays."""
    return F.coalesce(F.exists(values, test), F.lit(False))


def without(words: Column, stop: list[str]) -> Column:
    """Words that aren't stop words."""
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def dated_start(text: Column) -> Column:
    """A leading ``от dd.mm.yyyy``, apart from the text: a struct of the date (null without one) and the rest."""
    head = F.regexp_extract(text, r"^от\s+(\d{2}\.\d{2}\.\d{4})", 1)
    rest = F.when(head == "", text).otherwise(F.trim(F.regexp_replace(text, r"^от\s+\d{2}\.\d{2}\.\d{4}", "")))
    return F.struct(F.nullif(head, F.lit("")).alias("date"), rest.alias("rest"))


def period_of(stem: Column) -> Column:
    """Year and month at the end of a file stem such as ``name_2024_05``; null parts where they are missing."""
    parts = F.regexp_extract(stem, r"(?:^|[^0-9])((?:19|20)[0-9]{2})[^0-9]?(0[1-9]|1[0-2])?$", 1), F.regexp_extract(stem, r"(?:^|[^0-9])(?:19|20)[0-9]{2}[^0-9]?(0[1-9]|1[0-2])$", 1)
    return F.struct(*[F.nullif(x, F.lit("")).cast("int").alias(n) for x, n in zip(parts, ("year", "month"))])


def header_pair(line: Column) -> Column:
    """``key: value`` as a struct; without the sign the whole line is the key and the value empty."""
    at = F.locate(": ", line)
    return F.struct(F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line).alias("key"), F.when(at > 0, F.substring(line, at + 2, F.length(line))).otherwise("").alias("value"))


def mentions_number(text: Column, number: Column) -> Column:
    """Whether a text holds the part of an act number before its hyphen."""
    return F.contains(text, F.substring_index(number, "-", 1))


def is_shape(text: Column, shape: str) -> Column:
    """Whether the whole text is an ISO ``date``, a ``year``, a raised digit (``note``) or a ``marker`` of a list."""
    shapes = {"date": r"\d{4}-\d{2}-\d{2}", "year": "(?:19|20)[0-9]{2}", "note": "[⁰¹²³⁴⁵⁶⁷⁸⁹]+", "marker": r"(?:\d+(?:\.\d+)*[.)]|[-*•–—])"}
    return text.rlike(f"^(?:{shapes[shape]})\\z")


def heading(text: Column) -> Column:
    """A heading without the dots at its end."""
    return F.regexp_replace(text, r"\.+\z", "")


def markdown_line(line: Column) -> Column:
    """(kind, label, texts) of a Markdown line: row with its cells, head, num with its label, bullet, text; null for rules, blank
    lines and the lines under a table's head."""
    s = F.trim(F.regexp_replace(line, r"^\s*>\s?", ""))
    cells = F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rule = F.forall(cells, lambda c: (c == "") | c.rlike("^:?-{2,}:?$"))
    kind = F.when(s.startswith("|"), "row").when(s.rlike(r"^#+\s+"), "head").when(s.rlike(r"^\d+[.)]\s+"), "num").when(s.rlike(r"^[-*+]\s+"), "bullet").otherwise("text")
    bare = F.regexp_replace(s, r"^(?:#+|\d+[.)]|[-*+])\s+", "")
    texts = F.filter(F.transform(F.when(kind == "row", cells).otherwise(F.array(F.when(kind == "text", s).otherwise(bare))), markdown_plain), lambda t: t != "")
    label = F.nullif(F.regexp_extract(s, r"^(\d+[.)])\s+", 1), F.lit(""))
    nothing = (s == "") | s.rlike(r"^(?:-{3,}|\*{3,}|_{3,})$") | ((kind == "row") & rule)
    return F.when(~nothing, F.struct(kind.alias("kind"), label.alias("label"), texts.alias("texts")))


def markdown_plain(text: Column) -> Column:
    """A Markdown text in plain words: links by their text, without emphasis and escapes, quotes and dashes of one kind, folded."""
    t = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\*\*|__|`", "")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])[_*]+(?=\S)|(?<=\S)[_*]+(?![\p{L}\p{N}_])", "")
    t = F.regexp_replace(t, r"\\([\\`*_{}\[\]()#+\-.!|>])", "$1")
    t = F.translate(t, "\u00a0“”«»„‘’–—−‑", " \"\"\"\"\"''----")
    return F.trim(F.lower(F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), SPACE, " ")))


def acts_in(text: Column) -> Column:
    """Numbers of central-bank acts after № such as 716-П, without leading zeros, sorted and distinct."""
    found = F.regexp_extract_all(text, F.lit(r"№\s*[0-9]{1,5}\s*[-‑–]\s*(?:ПР|МР|П|У|И|Т)(?![а-яА-ЯёЁ])"), 0)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(F.regexp_extract(x, "([0-9]+)", 1).cast("int").cast("string"), F.lit("-"), F.regexp_extract(x, "([А-Я]+)$", 1)))))


def laws_in(text: Column) -> Column:
    """Federal laws after № such as 115-ФЗ, and 395-1, sorted and distinct."""
    federal = F.transform(F.regexp_extract_all(text, F.lit(r"№\s*([0-9]{1,4}(?:-[0-9])?)\s*[-‑–]\s*ФЗ"), 1), lambda x: F.concat(x, F.lit("-ФЗ")))
    old = F.regexp_extract_all(text, F.lit(r"№\s*(395-1)(?![\p{L}\p{N}_])(?!\s*[-‑–]\s*ФЗ)"), 1)
    return F.array_sort(F.array_distinct(F.concat(federal, old)))


def long_words(text: Column, least: int = 5) -> Column:
    """Distinct folded words of ``least`` letters or more."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(rf"\p{{L}}{{{least},}}"), 0))
