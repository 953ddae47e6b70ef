"""Small operators on rows in order and on names: groups of columns, picks, rounds, chapters, copies, parameters, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.operators.grades import hash_order
from relevia.operators.inference import sums_before


def column_groups(headers: DataFrame) -> DataFrame:
    """(tbl, label, first, last) of header cells (tbl, col, label): a label holds for its column and the empty ones after it,
    up to the next label; columns before the first label belong to none. A table's header is one row, so small."""
    order = Window.partitionBy("tbl").orderBy("col")
    filled = headers.withColumn("label", F.nullif(F.trim("label"), F.lit("")))
    end = F.max("col").over(Window.partitionBy("tbl"))
    starts = filled.withColumn("end", end).where("label is not null")
    return starts.select("tbl", "label", F.col("col").alias("first"), F.coalesce(F.lead("col").over(order) - 1, F.col("end")).alias("last"))


def every_nth(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first of every ``n`` rows of a group in order; ``order`` must be total within the group."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("__n", nth).where((F.col("__n") - 1) % n == 0).drop("__n")


def latest(rows: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """(key, time) of the ``n`` keys seen last (a report of n); a key counts with its last time, ties go to the smaller key."""
    return rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key).agg(F.max(time).alias(time)).orderBy(F.desc(time), F.asc(key)).limit(n)


def round_robin(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, part): distinct keys dealt to ``parts`` in turn by their order, counted within ranges."""
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct()
    return sums_before(keys, "__k", {"__i": F.lit(1)}).select(F.col("__k").alias(key), (F.col("__i") % parts).cast("int").alias("part"))


def chapters(rows: DataFrame, ident: str, sign: str = ".") -> DataFrame:
    """(chapter, number, n): identifiers by what stands before the first ``sign``, with its number (999 if it is none)."""
    chapter = F.substring_index(ident, sign, 1)
    g = rows.where(F.col(ident).isNotNull()).groupBy(chapter.alias("chapter")).agg(F.count_distinct(ident).alias("n"))
    return g.select("chapter", F.coalesce(F.col("chapter").try_cast("int"), F.lit(999)).alias("number"), "n")


def copies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kept): keys whose normalised text another key has as well, with the smallest key of that text; digests travel."""
    d = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.sha2(T.norm(F.col(text)), 256).alias("h")).distinct()
    g = d.groupBy("h").agg(F.min("k").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.join(g, "h").groupBy(F.col("k").alias(key)).agg(F.min("kept").alias("kept"))


def remapped(rows: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is replaced by the kept one where ``kept`` (key, kept) names it."""
    names = kept.select(F.col(key).alias("__k"), "kept")
    return rows.join(names, F.col(key) == F.col("__k"), "left").withColumn(key, F.coalesce("kept", key)).drop("__k", "kept")


def all_known(rows: DataFrame, by: str, key: str, known: DataFrame) -> DataFrame:
    """(by, keys, complete): whether every key of a group is known; groups without keys aren't complete."""
    asked = rows.where(F.col(by).isNotNull()).select(F.col(by).alias("__b"), F.col(key).alias("__k")).distinct()
    held = known.select(F.col(key).alias("__k"), F.lit(1).alias("hit")).where("__k is not null").distinct()
    g = asked.join(held, "__k", "left").groupBy("__b").agg(F.count("__k").alias("keys"), F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("__b").alias(by), "keys", ((F.col("keys") > 0) & (F.col("hits") == F.col("n"))).alias("complete"))


def sampled_mean(rows: DataFrame, key: str, value: Column, n: int = 2000, seed: str = "20260925") -> DataFrame:
    """(n, mean) of a value over at most ``n`` rows in the fixed pseudo-random order of their keys (a sampling operator)."""
    some = rows.where(F.col(key).isNotNull()).select(value.alias("v"), hash_order(F.col(key).cast("string"), seed=seed).alias("h"), key).orderBy("h", key).limit(n)
    return some.agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def meets(wanted: Column, got: Column) -> Column:
    """Whether every parameter of the map ``wanted`` has the same value in ``got``; nulls are equal to nulls and to nothing."""
    return F.forall(F.map_entries(wanted), lambda e: F.try_element_at(F.coalesce(got, F.create_map().cast("map<string,string>")), e["key"]).eqNullSafe(e["value"]))


def rows_per_key(keys: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """(key, rows): how many rows every key has, 0 for one without."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return keys.where(F.col(key).isNotNull()).select(key).distinct().join(n, key, "left").na.fill(0, ["rows"])


def file_names(rows: DataFrame, key: str, folder: Column, title: Column, suffix: Column) -> DataFrame:
    """(key, folder, name): a file name per key that no other of its folder has: the title, with `` (n)`` from the second on.

    Names are compared without case, in the order of the keys."""
    named = rows.select(F.col(key).alias("__k"), folder.alias("folder"), T.safe_name(title).alias("t"), suffix.alias("s")).where("__k is not null").dropDuplicates(["__k"])
    nth = F.row_number().over(Window.partitionBy("folder", F.lower("t"), F.lower("s")).orderBy("__k"))
    dot = F.when(F.coalesce("s", F.lit("")) != "", F.concat(F.lit("."), "s")).otherwise("")
    return named.withColumn("n", nth).select(F.col("__k").alias(key), "folder", F.concat("t", F.when(F.col("n") > 1, F.format_string(" (%d)", "n")).otherwise(""), dot).alias("name"))


def rows_in_one(rows: DataFrame, units: DataFrame, cells: str, by: str) -> DataFrame:
    """(row, cells, held): whether all cells of a row (row, by, cells: array) stand in one unit (by, unit, text) of its group.

    Cells and units meet on (group, word of a cell), so only units that share one are looked at."""
    r = rows.where(F.col(by).isNotNull() & (F.size(cells) > 0)).select("row", F.col(by).alias("__b"), F.array_distinct(cells).alias("c"))
    parts = r.select("row", "__b", F.explode("c").alias("cell"), F.size("c").alias("n"))
    words = units.where(F.col(by).isNotNull() & F.col("text").isNotNull()).select(F.col(by).alias("__b"), "unit", F.explode(F.array_distinct(F.split(F.trim("text"), T.SPACE))).alias("cell"))
    met = parts.join(words, ["__b", "cell"]).groupBy("row", "unit", "n").agg(F.count_distinct("cell").alias("hits")).where("hits = n")
    full = met.select("row", F.lit(True).alias("held")).distinct()
    return r.select("row", F.size("c").alias("cells")).distinct().join(full, "row", "left").na.fill(False, ["held"])


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side) of the rows that only ``a`` or only ``b`` has; empty where both tables may be joined row by row."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))


def parallel_lines(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(ref, text): the lines (unit, line, text) of the same numbers as a span (ref, unit, first, last) of the parallel text."""
    asked = spans.where("ref is not null").select("ref", "unit", F.explode(F.sequence("first", "last")).alias("line")).distinct()
    met = asked.join(lines.select("unit", "line", "text").dropDuplicates(["unit", "line"]), ["unit", "line"])
    return met.groupBy("ref").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))  # a span's lines


def excluded_evidence(excluded: DataFrame, asked: DataFrame, reason: str) -> DataFrame:
    """(qid, file, pages, answer) of the excluded questions (query, reason) whose reason matches: ``asked`` has qid, question,
    answer and evidence, an array of (file, pages); questions are equal if they are without their outer blanks."""
    lost = excluded.where(F.col("reason").rlike(reason)).select(F.trim("query").alias("q")).distinct()
    return asked.withColumn("q", F.trim("question")).join(lost, "q", "left_semi").select("qid", "answer", F.explode("evidence").alias("e")).select("qid", "e.file", "e.pages", "answer")


def run_parameters(states: DataFrame) -> DataFrame:
    """(run_id, parameters): how the text index of a run (run_id, emulation, indices) was made: the map of its emulation, else the
    details of its first index of type FTS, else null."""
    details = F.get(F.transform(F.filter("indices", lambda i: i["type"] == "FTS"), lambda i: i["details"]), F.lit(0))
    return states.select("run_id", F.coalesce("emulation", details).alias("parameters"))


def missing_designations(asked: DataFrame, gold: DataFrame, held: DataFrame) -> DataFrame:
    """(qid, number): designations of a question (qid, number) that none of its right documents (qid, doc_id) holds, by
    ``held`` (doc_id, number); questions without a right document are left out."""
    q = asked.where("qid is not null and number is not null").select("qid", "number").distinct().join(gold.select("qid").distinct(), "qid", "left_semi")
    found = q.join(gold.select("qid", "doc_id").distinct(), "qid").join(held.select("doc_id", "number").distinct(), ["doc_id", "number"], "left_semi")
    return q.join(found.select("qid", "number").distinct(), ["qid", "number"], "left_anti")
