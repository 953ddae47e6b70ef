"""Queries over the corpus: quality, units, coverage, splits and pools, each with the same result in SQL where SQL can hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.operators import grades as G
from relevia.operators import quality as Q
from relevia.operators import units as U
from relevia.plans import evaluation
from relevia.plans.register import register
from relevia.sources import table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

TOK = "regexp_extract_all(replace(lower({0}), 'ё', 'е'), '[0-9a-zа-я]+')"
NORM = "trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
OWN = "regexp_replace({0}, '^((Документ|Раздел|Лист|Таблица): [^\\n]*\\n)+', '')"
GRAMS = "case when len({0}) = 0 then [] when len({0}) < 3 then [array_to_string({0}, ' ')] else list_distinct([array_to_string({0}[i:i+2], ' ') for i in range(1, len({0}) - 1)]) end"


def unique_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("cid", "doc_id", "idx", "text", "kind", "title").distinct()


@query(f"""with c as (select split_part(doc_id, '/', 1) as g0, kind as g1, doc_id, length(text) as chars, len({TOK.format('text')}) as words from chunks)
    select g0, g1, count(distinct doc_id) as docs, count(*) as chunks, cast(coalesce(sum(chars), 0) as bigint) as chars, cast(coalesce(sum(words), 0) as bigint) as words,
           count(*) filter (words > 560) as long_chunks, cast(grouping_id(g0, g1) as bigint) as level from c group by grouping sets ((g0), (g1), ())""")
def chunk_volumes(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes of the chunk table by dataset and by kind, with the total."""
    return Q.volumes(table(spark, sf, "chunks"), [F.split_part("doc_id", F.lit("/"), F.lit(1)), F.col("kind")])


@query(f"""with r as (select doc_id, cid, list_filter(list_distinct(list_transform(string_split({OWN.format('text')}, chr(10)), lambda x: {NORM.format('x')})),
                 lambda x: length(x) between 5 and 80 and not regexp_matches(x, '^[0-9]+$')) as lines from chunks where text is not null and doc_id is not null),
    s as (select doc_id, count(*) as size from r group by 1), l as (select doc_id, unnest(lines) as line from r),
    c as (select doc_id, line, count(*) as n from l group by 1, 2 having count(*) >= 3)
    select doc_id, line, n from c join s using (doc_id) where n >= 0.1 * size""")
def boilerplate_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that run through a document."""
    return Q.boilerplate(table(spark, sf, "chunks"), "cid")


@query(f"""with r as (select doc_id, md5({NORM.format(OWN.format('text'))}) as h from chunks where text is not null and doc_id is not null),
    n as (select doc_id, h, count(*) as n from r group by 1, 2)
    select doc_id, cast(sum(n) as bigint) as chunks, cast(sum(n - 1) as bigint) as repeats from n group by 1 having sum(n - 1) > 0""")
def repeated_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks repeated within their document."""
    return Q.repeated_chunks(table(spark, sf, "chunks"))


UNCLEAN = {  # the patterns once more, in the other engine's spelling and without looking around
    "nbsp": "chr(160) || '|' || chr(8239) || '|' || chr(8199)", "zero_width": "chr(8203) || '|' || chr(8204) || '|' || chr(8205) || '|' || chr(8288)",
    "bom": "chr(65279)", "soft_hyphen": "chr(173)", "ctrl": "'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F' || chr(127) || '-' || chr(159) || ']'", "symbol_pua": "'[' || chr(61440) || '-' || chr(61695) || ']'",
    "cr": "chr(13)", "tab": "chr(9)", "spaces_2plus": "'[^\\s\\p{Z}]  +[^\\s\\p{Z}]'", "trailing_space": "' ' || chr(10)", "newlines_3plus": "chr(10) || chr(10) || chr(10)",
}


@query("""select regexp_extract(lower(doc_id), '\\.([^./]+)$', 1) as grp, count(*) as n,
    """ + ", ".join(f"round(avg(cast(regexp_matches(text, {p}) as integer)), 6) as {n}" for n, p in UNCLEAN.items()) + f""",
    round(avg(cast(len(regexp_extract_all({OWN.format('text')}, '[A-Za-zА-Яа-яЁё]{{2,}}')) < 3 as integer)), 6) as short from chunks where text is not null group by 1""")
def chunk_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of chunks with unclean text, by format."""
    return evaluation.rounded(Q.hygiene(table(spark, sf, "chunks"), "text", T.extension(F.col("doc_id"))), *Q.HYGIENE, "short")


@query(f"""with c as (select kind as grp, regexp_replace({OWN.format('text')}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as body, length(text) as chars from chunks where text is not null)
    select grp, count(*) as n, round(avg(cast(regexp_matches(body, '[.!?…;:»)]$') as integer)), 6) as ends,
           round(avg(cast(regexp_matches(body, '^\\p{{Ll}}') as integer)), 6) as lower, round(median(chars), 6) as median_chars from c group by 1""")
def chunk_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Where chunks begin and end, by kind."""
    return evaluation.rounded(Q.boundaries(table(spark, sf, "chunks"), F.col("kind")), "ends", "lower", "median_chars")


FILL = ["section", "title", "table_id", "page_start", "page_end", "line_start", "row_start", "char_start", "char_end", "vector"]


@query("with f as (" + " union all ".join(f"""select regexp_extract(lower(doc_id), '\\.([^./]+)$', 1) as grp, '{c}' as "column", {f"coalesce({c} <> '', false)" if c in ("section", "title", "table_id") else f"coalesce(len({c}) > 0, false)" if c == "vector" else f"{c} is not null"} as ok from chunks""" for c in FILL) + ') select grp, "column", count(*) as n, count(*) filter (ok) as filled from f group by 1, 2')
def metadata_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each field of a chunk is filled, by format."""
    return Q.filled_rates(table(spark, sf, "chunks"), T.extension(F.col("doc_id")), FILL)


@query("""select count(*) as rows, count(distinct doc_id) as docs, count(*) filter (title is null) as no_title, count(*) filter (format is null) as no_format,
    count(*) filter (format <> regexp_extract(lower(doc_id), '\\.([^./]+)$', 1)) as other_format, count(*) filter (regexp_matches(title, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) as control_titles,
    count(*) filter (regexp_replace(path, '^.*?/corpus/', '', 's') <> doc_id) as moved from manifest""")
def manifest_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Integrity of the document list."""
    m = table(spark, sf, "manifest")
    return m.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("docs"), F.count_if(F.col("title").isNull()).alias("no_title"), F.count_if(F.col("format").isNull()).alias("no_format"),
        F.count_if(F.col("format") != T.extension(F.col("doc_id"))).alias("other_format"), F.count_if(T.has_controls(F.col("title"))).alias("control_titles"),
        F.count_if(T.document_of(F.col("path")) != F.col("doc_id")).alias("moved"),
    )


@query(f"""with p as (select pid, doc_id, {TOK.format("array_to_string(passages, chr(10))")} as w from judge_pair where passages is not null and pid is not null),
    a as (select distinct pid as ref, doc_id, unnest({GRAMS.format('w')}) as gram from p),
    c as (select cid, doc_id, {TOK.format('text')} as w from (select distinct cid, doc_id, text from chunks where doc_id in (select doc_id from judge_pair))),
    h as (select distinct doc_id, cid, unnest({GRAMS.format('w')}) as gram from c), m as (select ref, cid, gram from a join h using (doc_id, gram)),
    b as (select ref, max(c) as best from (select ref, cid, count(*) as c from m group by 1, 2) group by 1), d as (select ref, count(distinct gram) as d from m group by 1),
    s as (select ref, count(*) as grams from a group by 1)
    select ref, grams, round(coalesce(d / grams, 0.0), 6) as in_doc, round(coalesce(best / grams, 0.0), 6) as in_chunk from s left join d using (ref) left join b using (ref)""")
def passage_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the judged passages stands in their document, and in one of its chunks."""
    refs = table(spark, sf, "judge_pair").where("passages is not null").select("pid", "doc_id", F.array_join("passages", "\n").alias("text"))
    chunks = table(spark, sf, "chunks").select("cid", "doc_id", "text").distinct()
    return evaluation.rounded(Q.gram_coverage(refs, "pid", "doc_id", "text", chunks, "doc_id", "cid", "text").drop("best"), "in_doc", "in_chunk")


@query("""with c as (select distinct cid, doc_id, idx from chunks where doc_id is not null and idx is not null)
    select a.cid, a.doc_id, list(b.cid order by b.idx, b.cid) as around from c a join c b on a.doc_id = b.doc_id and b.idx between a.idx - 1 and a.idx + 1 group by 1, 2""")
def chunk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk with the chunks before and after it."""
    return U.neighbours(table(spark, sf, "chunks"))


@query("""select doc_id, unit, key, count(*) as chunks from (select doc_id, case when table_id is not null then 'table' when page_start is not null then 'page' when section is not null then 'section' else 'none' end as unit,
    coalesce(table_id, cast(page_start as varchar), section, '') as key from chunks where doc_id is not null) group by 1, 2, 3""")
def parent_units(spark: SparkSession, sf: str) -> DataFrame:
    """The larger units that chunks belong to."""
    return U.parents(table(spark, sf, "chunks"))


@query()
def stitched_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every section, whatever the kinds of its chunks, overlaps cut once; sections of over 512 chunks in numbered pieces."""
    c = table(spark, sf, "chunks").where("section is not null and doc_id is not null")
    return U.stitched(c, ["doc_id", "section"])


WORDS = "' ' || array_to_string(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), ' ') || ' '"


def card(text: str, label: str, column: str) -> str:
    value = f"left(trim({column}), 300)"
    return f"case when coalesce({value} <> '', false) and not contains({WORDS.format('t')}, {WORDS.format(value)}) then t || chr(10) || '{label}: ' || {value} else t end"


@query(f"""with m as (select doc_id, min(title) as title, min(dataset) as dataset, min(key) as key from manifest where doc_id is not null group by 1),
    a as (select *, 'Документ: ' || regexp_replace(regexp_replace(doc_id, '^.*/', ''), '\\.[^.]*$', '') as t from m),
    b as (select * replace ({card('t', 'Название', 'title')} as t) from a), c as (select * replace ({card('t', 'Раздел', 'dataset')} as t) from b),
    d as (select * replace ({card('t', 'Ключ', 'key')} as t) from c) select doc_id, t as text from d""")
def document_cards(spark: SparkSession, sf: str) -> DataFrame:
    """A card per document."""
    return U.cards(table(spark, sf, "manifest"))


@query()
def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut into overlapping pieces."""
    return U.split_texts(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""with c as (select qid, min(cluster) as cluster from {evaluation.BASE} where qid is not null group by 1),
    d as (select qid, cluster, string_split(sha1('split' || chr(0) || cluster), '') as h from c)
    select qid, cluster, case when list_sum(list_transform(h, lambda x: instr('0123456789abcdef', x) - 1)) % 3 = 0 then 'test' else 'dev' end as part from d""")
def dev_test_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split of two thirds and one third by the hash of a question's own base (one hop, see ``clusters``).

    Questions of the same stated base stay together; families that hang together through other spellings or chains of
    bases may be torn. ``p3_splits`` keeps whole families."""
    c = evaluation.clusters(spark, sf)
    return c.select("qid", "cluster", F.when(T.hash_third("split", F.col("cluster")) == 0, "test").otherwise("dev").alias("part"))


@query("""with d as (select doc_id, source, count(*) over (partition by source) as n, count(*) over () as total,
                   row_number() over (partition by source order by md5('20260925|' || doc_id), doc_id) as r from documents)
    select doc_id, source from d where r <= greatest(5, round_even(250.0 * n / total, 0))""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of 250 documents by source, five of each at least (a sampling operator)."""
    return G.stratified(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""with p as (select distinct pid from judge_pair where pid is not null), n as (select pid, row_number() over (order by md5('20260925|' || pid), pid) - 1 as i from p)
    select pid, cast(i // 40 as integer) as batch from n""")
def judging_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in fixed random order, in batches of forty."""
    return G.batches(table(spark, sf, "judge_pair").where("pid is not null").select("pid").distinct(), "pid")


@query("""with p as (select distinct pid from judge_pair), a as (select distinct pid from grades_a where grade between 0 and 3), b as (select distinct pid from grades_b where grade between 0 and 3),
    hi as (select pid from grades_a where pid is not null and grade between 0 and 3 qualify row_number() over (partition by pid order by graded_at nulls last, coalesce(assessor, ''), grade) = 1 and grade >= 2)
    select 'pairs' as what, count(*) as n from p union all select 'ungraded', count(*) from p where pid not in (select pid from a where pid is not null)
    union all select 'to_verify', count(*) from hi where pid not in (select pid from b where pid is not null)""")
def judging_state(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs, pairs without a grade, and relevant pairs without a second opinion."""
    p = table(spark, sf, "judge_pair").select("pid").distinct()
    a, b = G.first_opinion(table(spark, sf, "grades_a")), G.first_opinion(table(spark, sf, "grades_b"))
    parts = (("pairs", p), ("ungraded", p.join(a, "pid", "left_anti")), ("to_verify", a.where("grade >= 2").join(b, "pid", "left_anti")))
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with q as (select qid, query, base from queries), m as (select distinct doc_id from manifest)
    select 'queries_without_base_row' as what, count(distinct qid) as n from q where base is not null and base not in (select qid from q where qid is not null)
    union all select 'judged_unknown_document', count(*) from judged where doc_id not in (select doc_id from m where doc_id is not null)
    union all select 'judged_unknown_query', count(*) from judged where qid not in (select qid from q where qid is not null)
    union all select 'chunks_unknown_document', count(*) from chunks where doc_id not in (select doc_id from m where doc_id is not null)""")
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Dangling references between the tables."""
    q, m = table(spark, sf, "queries"), table(spark, sf, "manifest").select("doc_id").distinct()
    qids, judged, chunks = q.select("qid").distinct(), table(spark, sf, "judged"), table(spark, sf, "chunks").select("doc_id")

    def line(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    lost = q.where("base is not null").join(qids.withColumnRenamed("qid", "base"), "base", "left_anti").select("qid").distinct()
    out = line("queries_without_base_row", lost).unionByName(line("judged_unknown_document", judged.where("doc_id is not null").join(m, "doc_id", "left_anti")))
    out = out.unionByName(line("judged_unknown_query", judged.where("qid is not null").join(qids, "qid", "left_anti")))
    return out.unionByName(line("chunks_unknown_document", chunks.where("doc_id is not null").join(m, "doc_id", "left_anti")))


@query("""select event_type, count(*) as n, count(distinct user_id) as users, round(median(value), 6) as median_value, round(avg(cast(json_extract_string(props, '$.k') as double)), 6) as mean_k from events group by 1""")
def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSON fields and medians by event type."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.median("value").alias("median_value"), F.avg("k").alias("mean_k"))
    return evaluation.rounded(g, "median_value", "mean_k")


@query("""select dataset, scenario, count(*) as n, cast(grouping_id(dataset, scenario) as bigint) as level from queries group by grouping sets ((dataset), (scenario), (dataset, scenario), ())""")
def query_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Questions by dataset, by scenario, by both and in total, in one pass."""
    q = table(spark, sf, "queries").select("dataset", "scenario")
    return q.groupingSets([["dataset"], ["scenario"], ["dataset", "scenario"], []], "dataset", "scenario").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
