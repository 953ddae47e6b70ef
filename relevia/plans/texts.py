"""Queries over passages and answers: coverage, best lines, packing, windows, answers in emitted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.operators import answers as A
from relevia.operators import quality as Q
from relevia.operators import ranking as R
from relevia.operators import retrieval as S
from relevia.operators import units as U
from relevia.plans import evaluation, search
from relevia.plans.corpus import GRAMS, TOK
from relevia.plans.register import register
from relevia.sources import materialize, table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

COVERAGE = f"""p as (select pid, doc_id, {TOK.format("array_to_string(passages, chr(10))")} as w from judge_pair where passages is not null and pid is not null),
    a as (select distinct pid as ref, doc_id, unnest({GRAMS.format('w')}) as gram from p),
    c as (select cid, doc_id, {TOK.format('text')} as w from (select distinct cid, doc_id, text from chunks where doc_id in (select doc_id from judge_pair))),
    h as (select distinct doc_id, cid, unnest({GRAMS.format('w')}) as gram from c), m as (select ref, cid, gram from a join h using (doc_id, gram)),
    k as (select ref, cid, count(*) as c from m group by 1, 2), b as (select ref, max(c) as most, arg_min(cid, (-c, cid)) as best from k group by 1), d as (select ref, count(distinct gram) as d from m group by 1),
    s as (select ref, any_value(doc_id) as doc_id, count(*) as grams from a group by 1),
    cov as (select ref, doc_id, coalesce(d / grams, 0.0) as in_doc, coalesce(most / grams, 0.0) as in_chunk, best from s left join d using (ref) left join b using (ref))"""


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """(ref, doc_id, in_doc, in_chunk, best) of the passages of every judged pair, as a table."""
    refs = table(spark, sf, "judge_pair").where("passages is not null and pid is not null").select("pid", "doc_id", F.array_join("passages", "\n").alias("text"))
    chunks = table(spark, sf, "chunks").select("cid", "doc_id", "text").distinct()
    got = Q.gram_coverage(refs, "pid", "doc_id", "text", chunks, "doc_id", "cid", "text")
    return materialize(got.join(refs.select(F.col("pid").alias("ref"), "doc_id").distinct(), "ref"))


@query(f"""with {COVERAGE} select regexp_extract(lower(doc_id), '\\.([^./]+)$', 1) as format, count(*) as n, round(avg(in_doc), 6) as mean, round(min(in_doc), 6) as least, count(*) filter (in_doc >= 0.8) as covered,
    count(*) filter (in_doc < 0.8) as below, cast(grouping_id(format) as bigint) as level from cov group by grouping sets ((format), ())""")
def coverage_by_format(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the judged passages stand in their documents, by format and in total."""
    rows = coverage(spark, sf).withColumn("format", T.extension(F.col("doc_id")))
    return evaluation.rounded(Q.coverage_report(rows, "format", "in_doc"), "mean", "least")


@query(f"""with {COVERAGE}, r as (select qid, count(*) filter (in_chunk >= 0.8) as in_chunk, count(*) filter (in_doc >= 0.8) as in_doc, count(*) as n, max(in_chunk) as top from cov join (select distinct pid as ref, qid from judge_pair) using (ref) group by 1)
    select count(*) as questions, cast(sum(n) as bigint) as passages, cast(sum(in_doc) as bigint) as in_doc, cast(sum(in_chunk) as bigint) as in_chunk, count(*) filter (in_chunk > 0) as questions_in_chunk, round(avg(top), 6) as mean_top from r""")
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Questions whose passages stand in the index: in a document or within one chunk, from a share of 0.8 on."""
    named = coverage(spark, sf).join(table(spark, sf, "judge_pair").select(F.col("pid").alias("ref"), "qid").distinct(), "ref")
    per = named.groupBy("qid").agg(F.count_if(F.col("in_chunk") >= 0.8).alias("c"), F.count_if(F.col("in_doc") >= 0.8).alias("d"), F.count(F.lit(1)).alias("n"), F.max("in_chunk").alias("top"))
    out = per.agg(F.count(F.lit(1)).alias("questions"), F.sum("n").alias("passages"), F.sum("d").alias("in_doc"), F.sum("c").alias("in_chunk"), F.count_if(F.col("c") > 0).alias("questions_in_chunk"), F.avg("top").alias("mean_top"))
    return evaluation.rounded(out, "mean_top")


@query(f"""with {COVERAGE},
    f as (select ref, {TOK.format("array_to_string(passages, chr(10))")} as f, best from cov join (select distinct pid as ref, passages from judge_pair) using (ref) where best is not null),
    t as (select ref, f, string_split(text, chr(10)) as lines from f join (select distinct cid as best, text from chunks) using (best)),
    l as (select ref, f, unnest(range(0, len(lines))) as i, unnest(list_transform(lines, lambda x: {TOK.format('x')})) as w from t),
    g as (select x.ref, x.i as first, y.i as last from l x join l y on x.ref = y.ref and y.i between x.i and x.i + 7),
    z as (select g.ref, first, last, sum(len(w)) as size from g join l on l.ref = g.ref and l.i between first and last group by 1, 2, 3),
    u as (select ref, i, unnest(w) as word from l), q as (select g.ref, first, last, word, count(*) as c from g join u on u.ref = g.ref and u.i between first and last group by 1, 2, 3, 4),
    n as (select ref, word, count(*) as want from (select ref, unnest(f) as word from f) group by 1, 2), nn as (select ref, sum(want) as n from n group by 1),
    o as (select q.ref, first, last, sum(least(c, want)) as hits from q join n using (ref, word) group by 1, 2, 3),
    v as (select ref, first, last, round(2 * hits / (n + size), 9) as f1 from o join z using (ref, first, last) join nn using (ref))
    select ref, f1, cast(first as integer) as first, cast(last as integer) as last from v qualify row_number() over (partition by ref order by f1 desc, first, last) = 1""")
def best_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a passage's best chunk that are nearest to it."""
    near = coverage(spark, sf).where("best is not null").select("ref", F.col("best").alias("cid"))
    facts = table(spark, sf, "judge_pair").select(F.col("pid").alias("ref"), F.array_join("passages", "\n").alias("fact")).distinct()
    lines = table(spark, sf, "chunks").select("cid", F.split("text", "\n").alias("lines")).distinct()
    return U.best_windows(near.join(facts, "ref").join(lines, "cid").select("ref", "fact", "lines"))


@query("""with recursive p as (select doc_id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_matches(x, '[^\\s\\p{Z}]')) as p from documents where text is not null),
    c as (select doc_id, generate_subscripts(p, 1) as i, len(regexp_extract_all(unnest(p), '[^\\s\\p{Z}]+')) as n from p),
    g(doc_id, i, part, words, n) as (select doc_id, i, 1, n, n from c where i = 1
        union all select c.doc_id, c.i, case when g.words + c.n > 200 then g.part + 1 else g.part end, case when g.words + c.n > 200 then c.n else g.words + c.n end, c.n from g join c on c.doc_id = g.doc_id and c.i = g.i + 1)
    select doc_id, part, count(*) as paragraphs, cast(sum(n) as bigint) as words from g group by 1, 2""")
def packed_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of the documents packed into parts of at most 200 words."""
    return U.packed(table(spark, sf, "documents"), "doc_id", "text", 200)


@query()
def window_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text that is given out for every chunk: itself with its neighbours, 1,800 characters around it."""
    c = table(spark, sf, "chunks").where("doc_id is not null and idx is not null and text is not null and coalesce(kind, '') <> 'card'")
    return A.windows(c)


@query(f"""with {evaluation.RANKING}, {evaluation.GOLD},
    ref as (select distinct j.qid, j.doc_id, p as passage, {GRAMS.format(TOK.format('p'))} as g from (select qid, doc_id, unnest(passages) as p from judge_pair where passages is not null) j join grades using (qid, doc_id) where grade >= 2),
    refs as (select * from ref where len(g) > 0), asked as (select distinct qid from refs),
    last2 as (select run_id, qid, results from (select run_id, qid, results, row_number() over (partition by run_id, qid order by asked_at desc nulls last, received_at desc nulls last, ms desc nulls last) as i
              from responses_hybrid where http = 200 and qid is not null and run_id is not null and results is not null) where i = 1),
    h as (select run_id, qid, unnest(results) as r, generate_subscripts(results, 1) as pos from last2),
    f as (select run_id, qid, regexp_replace(r.absolute_path, '^.*?/corpus/', '', 's') as doc_id, left(array_to_string(list_transform(list_filter(coalesce(r.chunks, []), lambda c: c.content is not null)[1:3], lambda c: c.content), chr(10)), 1800) as emitted
          from h where r.absolute_path is not null qualify row_number() over (partition by run_id, qid, doc_id order by pos) = 1),
    e as (select f.run_id, f.qid, k.rank, max(case when len(list_intersect(refs.g, {GRAMS.format(TOK.format('emitted'))})) >= 0.8 * len(refs.g) then 1 else 0 end) as ok
          from f join ranking k using (run_id, qid, doc_id) join refs on refs.qid = f.qid and refs.doc_id = f.doc_id where k.rank <= 3 group by 1, 2, 3),
    per as (select n.run_id, a.qid, max(case when e.rank = 1 then e.ok else 0 end) as a1, max(coalesce(e.ok, 0)) as a3, max(case when e.rank is not null then 1 else 0 end) as d3
            from asked a cross join (select distinct run_id from ranking) n left join e on e.run_id = n.run_id and e.qid = a.qid group by 1, 2)
    select run_id, count(*) as n, round(avg(a1), 6) as answer_1, round(avg(a3), 6) as answer_3, round(avg(d3), 6) as document_3 from per group by 1""")
def answers_at(spark: SparkSession, sf: str) -> DataFrame:
    """How often one of the first documents is right and the text given out for it covers a judged passage, by run."""
    g = evaluation.grades(spark, sf)
    refs = table(spark, sf, "judge_pair").where("passages is not null").select("qid", "doc_id", F.explode("passages").alias("passage")).distinct()
    refs = refs.join(g.where(F.col("grade") >= R.RELEVANT).select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    emitted = A.emitted(table(spark, sf, "responses_hybrid"))
    return evaluation.rounded(A.answers_at(emitted, evaluation.ranking(spark, sf), refs), "answer_1", "answer_3", "document_3")


@query(f"""with {search.okapi("select cid as key, doc_id as grp, text from (select distinct cid, doc_id, text from chunks) where doc_id is not null", "select qid, min(query) as query from queries where scenario = 6 and qid is not null group by 1")}
    select qid, key as doc_id, score, cast(rank as integer) as rank from bm""")
def no_answer_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for every question that should have no answer, to be judged."""
    asked = table(spark, sf, "queries").where("scenario = 6 and qid is not null").groupBy("qid").agg(F.min("query").alias("query"))
    units = table(spark, sf, "chunks").where("doc_id is not null").select("cid", "doc_id", "text").distinct()
    return S.bm25(units, "cid", "text", asked, "qid", "query", group="doc_id").withColumnRenamed("key", "doc_id")


@query()
def answers_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a judged passage stands in its best chunk, word for word or nearly."""
    near = coverage(spark, sf).where("best is not null").select("ref", F.col("best").alias("cid"))
    facts = table(spark, sf, "judge_pair").select(F.col("pid").alias("ref"), F.array_join("passages", "\n").alias("answer"), F.col("need").alias("question")).distinct()
    pages = table(spark, sf, "chunks").select("cid", F.col("text").alias("page")).distinct()
    return A.on_page(near.join(facts, "ref").join(pages, "cid"), "ref")


