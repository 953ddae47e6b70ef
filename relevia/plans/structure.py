"""Queries over order, names, copies and samples, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.operators import judging as J
from relevia.operators import retrieval as S
from relevia.operators import structure as O
from relevia.plans import evaluation, pools, search
from relevia.plans.corpus import NORM, TOK
from relevia.plans.register import register
from relevia.sources import table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


@query("""with r as (select distinct section from chunks where section is not null) select split_part(section, ' ', 1) as chapter, coalesce(try_cast(split_part(section, ' ', 1) as integer), 999) as number, count(*) as n from r group by 1""")
def section_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Sections by their first word, with its number."""
    return O.chapters(table(spark, sf, "chunks"), "section", " ")


@query(f"""with d as (select distinct cid, sha256({NORM.format('text')}) as h from chunks where cid is not null and text is not null),
    g as (select h, min(cid) as kept from d group by 1 having count(*) > 1) select cid, min(kept) as kept from d join g using (h) group by 1""")
def copied_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose text another chunk has as well, with the first of them."""
    return O.copies(table(spark, sf, "chunks"), "cid", "text")


@query(f"""with d as (select distinct doc_id, sha256({NORM.format('title')}) as h from manifest where doc_id is not null and title is not null),
    g as (select h, min(doc_id) as kept from d group by 1 having count(*) > 1), m as (select doc_id, min(kept) as kept from d join g using (h) group by 1)
    select qid, coalesce(kept, doc_id) as doc_id, max(grade) as grade, count(*) as n from judged left join m using (doc_id) where qid is not null and doc_id is not null and grade is not null group by 1, 2""")
def remapped_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier grades with documents of one title under the first of them."""
    kept = O.copies(table(spark, sf, "manifest"), "doc_id", "title")
    j = table(spark, sf, "judged").where("qid is not null and doc_id is not null and grade is not null")
    return O.remapped(j, "doc_id", kept).groupBy("qid", "doc_id").agg(F.max("grade").alias("grade"), F.count(F.lit(1)).alias("n"))


@query("""with a as (select distinct qid, doc_id from judged where qid is not null), h as (select distinct doc_id from chunks where doc_id is not null)
    select qid, count(a.doc_id) as keys, count(a.doc_id) > 0 and count(h.doc_id) = count(*) as complete from a left join h using (doc_id) group by 1""")
def complete_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions all of whose judged documents have chunks."""
    return O.all_known(table(spark, sf, "judged"), "qid", "doc_id", table(spark, sf, "chunks"))


@query("""with k as (select distinct doc_id from manifest where doc_id is not null), n as (select doc_id, count(*) as rows from chunks group by 1) select doc_id, coalesce(rows, 0) as rows from k left join n using (doc_id)""")
def rows_per_document(spark: SparkSession, sf: str) -> DataFrame:
    """How many chunks every document of the list has, also none."""
    return O.rows_per_key(table(spark, sf, "manifest"), "doc_id", table(spark, sf, "chunks"))


@query("""with m as (select doc_id, coalesce(min(dataset), '') as folder, coalesce(min(title), regexp_replace(regexp_replace(doc_id, '^.*/', ''), '\\.[^.]*$', '')) as title, regexp_extract(lower(doc_id), '\\.([^./]+)$', 1) as s from manifest where doc_id is not null group by doc_id),
    t as (select *, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(title, '[\\\\/:*?"<>|\\x00-\\x1F]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 90), '[ .]+$', '') as t from m),
    n as (select *, row_number() over (partition by folder, lower(t), lower(s) order by doc_id) as n from t)
    select doc_id, folder, t || case when n > 1 then ' (' || n || ')' else '' end || case when s <> '' then '.' || s else '' end as name from n""")
def unique_file_names(spark: SparkSession, sf: str) -> DataFrame:
    """A file name per document that is unique in its folder."""
    stem = F.regexp_replace(F.regexp_replace("doc_id", "^.*/", ""), r"\.[^.]*$", "")
    m = table(spark, sf, "manifest").where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.min("dataset"), F.lit("")).alias("folder"), F.min("title").alias("title"))
    return O.file_names(m, "doc_id", F.col("folder"), F.coalesce("title", stem), T.extension(F.col("doc_id")))


@query("""select doc_id, cast((row_number() over (order by doc_id) - 1) % 3 as integer) as part from (select distinct doc_id from manifest where doc_id is not null)""")
def dealt_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dealt to three parts in turn."""
    return O.round_robin(table(spark, sf, "manifest"), "doc_id", 3)


@query("""select doc_id, max(fetched_at) as fetched_at from documents where doc_id is not null and fetched_at is not null group by 1 order by 2 desc, 1 limit 20""")
def newest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty documents fetched last (a report of twenty)."""
    return O.latest(table(spark, sf, "documents"), "doc_id", "fetched_at", 20)


@query(f"""with p as (select doc_id, page_start as page, sum(len({TOK.format('text')})) as words from (select distinct cid, doc_id, page_start, text from chunks where doc_id is not null and page_start is not null and text is not null) group by 1, 2),
    d as (select *, row_number() over (partition by doc_id order by page) - 1 as i from p where words >= 20) select doc_id, page, cast(words as bigint) as words from d where i % 3 = 0""")
def sampled_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every third page of at least twenty words (a sampling operator)."""
    c = table(spark, sf, "chunks").where("doc_id is not null and page_start is not null and text is not null").select("cid", "doc_id", F.col("page_start").alias("page"), "text").distinct()
    pages = c.groupBy("doc_id", "page").agg(F.sum(F.size(T.tokens(F.col("text"))).cast("bigint")).alias("words")).where("words >= 20")
    return O.every_nth(pages, "doc_id", ["page"], 3)


@query(f"""with c as (select distinct cid, text from chunks where cid is not null and text is not null and coalesce(kind, '') <> 'card'),
    o as (select len({TOK.format('text')}) as v from c order by md5('20260925|' || cid), cid limit 2000) select count(v) as n, round(avg(v), 6) as mean from o""")
def mean_chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    """The mean number of words of two thousand chunks, cards aside (a sampling operator)."""
    c = table(spark, sf, "chunks").where("cid is not null and text is not null and coalesce(kind, '') <> 'card'").select("cid", "text").distinct()
    return evaluation.rounded(O.sampled_mean(c, "cid", F.size(T.tokens(F.col("text")))), "mean")


@query("""with r as (select distinct cid as row, table_id, list_distinct(regexp_split_to_array(trim(text), '[\\s\\p{Z}]+')) as c from chunks where kind = 'table_row' and table_id is not null and text is not null),
    u as (select distinct cid as unit, doc_id || '|' || table_id as g, table_id, list_distinct(regexp_split_to_array(trim(text), '[\\s\\p{Z}]+')) as w from chunks where kind = 'table' and table_id is not null and text is not null),
    x as (select r.row, len(r.c) as cells, coalesce(bool_or(len(list_intersect(r.c, u.w)) = len(r.c)), false) as held from r left join u using (table_id) group by 1, 2)
    select row, cells, held from x""")
def rows_in_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all words of a table's row stand in one chunk of a whole table of that name."""
    c = table(spark, sf, "chunks").where("table_id is not null and text is not null")
    rows = c.where("kind = 'table_row'").select(F.col("cid").alias("row"), "table_id", F.split(F.trim("text"), T.SPACE).alias("cells")).distinct()
    units = c.where("kind = 'table'").select(F.col("cid").alias("unit"), "table_id", "text").distinct()
    return O.rows_in_one(rows, units, "cells", "table_id")


CARDS = "select doc_id as key, doc_id as grp, {0} || ' ' || coalesce(min(title), '') || ' ' || coalesce(min(key), '') as text from manifest where doc_id is not null group by doc_id".format(pools.STEM)


@query(f"""with {pools.NAVIGATION}, {search.okapi(CARDS, "select type || ':' || doc_id as qid, query from nav where " + search.TWENTIETH)},
    w as (select type || ':' || doc_id as qid, unnest(regexp_split_to_array(query, '[\\s\\p{{Z}}]+')) as raw from nav where {search.TWENTIETH}),
    k as (select distinct qid, {pools.LETTERS.format("regexp_replace(raw, '^[.,;:!?«»\"''()\\[\\]]+|[.,;:!?«»\"''()\\[\\]]+$', '', 'g')")} as n from w where regexp_matches(raw, '[0-9]') and regexp_matches(raw, '[\\p{{L}}_]')),
    d as (select distinct doc_id, ' ' || {pools.LETTERS.format(pools.STEM)} || ' ' as name from manifest where doc_id is not null),
    h as (select n, doc_id from (select distinct n from k) join d on contains(name, ' ' || n || ' ')), o as (select n from h group by 1 having count(*) <= 3),
    m as (select distinct qid, doc_id from k semi join o using (n) join h using (n)),
    a as (select n.type || ':' || n.doc_id as qid, b.rank, exists (select 1 from m where m.qid = n.type || ':' || n.doc_id and m.doc_id = n.doc_id) as hit from nav n left join bm b on b.qid = n.type || ':' || n.doc_id and b.key = n.doc_id where cast('0x' || substr(md5(n.type || n.doc_id), 1, 8) as bigint) % 20 = 0)
    select count(*) as questions, count(*) filter (qid in (select qid from m)) as fired, count(*) filter (hit) as right_named, round(avg(coalesce(1.0 / rank, 0.0)) filter (qid in (select qid from m)), 6) as mrr_before from a""")
def rule_effect(spark: SparkSession, sf: str) -> DataFrame:
    """For how many of the navigation questions searched the designation rule fires, names the right document, and how these fared without it."""
    m = table(spark, sf, "manifest").where("doc_id is not null")
    g = m.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("key").alias("k"))
    stem = F.regexp_replace(F.regexp_replace("doc_id", "^.*/", ""), r"\.[^.]*$", "")
    nav = J.navigation(table(spark, sf, "manifest"), table(spark, sf, "chunks")).where(F.conv(F.left(F.md5(F.concat("type", "doc_id").cast("binary")), F.lit(8)), 16, 10).cast("bigint") % 20 == 0)
    nav = nav.withColumn("qid", F.concat_ws(":", "type", "doc_id"))
    found = S.bm25(g.select("doc_id", F.concat_ws(" ", stem, "title", "k").alias("text")), "doc_id", "text", nav, "qid", "query")
    named = J.named_documents(nav, "qid", "query", m)
    rows = nav.join(found.select("qid", F.col("key").alias("doc_id"), "rank"), ["qid", "doc_id"], "left")
    rows = rows.join(named.select("qid", "doc_id", F.lit(True).alias("hit")), ["qid", "doc_id"], "left").join(named.select("qid", F.lit(True).alias("fired")).distinct(), "qid", "left")
    out = rows.agg(F.count(F.lit(1)).alias("questions"), F.count("fired").alias("fired"), F.count("hit").alias("right_named"), F.avg(F.when(F.col("fired"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))).alias("mrr_before"))
    return evaluation.rounded(out, "mrr_before")


@query(f"""with {search.VECTORS}, {search.okapi(search.DOCS, search.TITLES, "bm", 50)},
    t as (select distinct qid from bm), n as (select * from near where rank <= 50),
    f as (select coalesce(n.qid, b.qid) as qid, coalesce(n.key, b.key) as key, n.rank as rv, b.rank as rt, round(coalesce(1 / (60.0 + n.rank), 0) + coalesce(1 / (60.0 + b.rank), 0), 9) as score
          from (select * from n where qid in (select qid from t)) n full join bm b on n.qid = b.qid and n.key = b.key)
    select qid, key, score, rank, false as fallback from (select qid, key, score, cast(row_number() over (partition by qid order by score desc, rv nulls last, rt nulls last) as integer) as rank from f) where rank <= 50
    union all select qid, key, round(score - 1, 9), cast(rank as integer), true from n where qid not in (select qid from t)""")
def hybrid_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and title search fused; questions whose title finds nothing keep their vector list with a negative score."""
    docs = table(spark, sf, "documents")
    asked = docs.where("doc_id % 20 = 0").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return S.with_fallback(search.nearest(spark, sf, 50), S.bm25(docs, "doc_id", "text", asked, "doc_id", "title", k=50))


@query(f"""with {evaluation.GOLD},
    q as (select distinct qid, unnest(regexp_extract_all(lower(query), '[0-9]{{1,5}}-[а-я]{{1,3}}')) as number from queries where qid is not null), g as (select distinct qid, doc_id from grades where grade >= 2),
    h as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[0-9]{{1,5}}-[а-я]{{1,3}}')) as number from chunks where doc_id is not null and text is not null)
    select qid, number from q where qid in (select qid from g) and not exists (select 1 from g join h using (doc_id) where g.qid = q.qid and h.number = q.number)""")
def missing_designations(spark: SparkSession, sf: str) -> DataFrame:
    """Act numbers of a question that none of its relevant documents mentions."""
    numbers = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[0-9]{1,5}-[а-я]{1,3}"), 0)).alias("number")
    asked = table(spark, sf, "queries").select("qid", numbers(F.col("query")))
    held = table(spark, sf, "chunks").where("doc_id is not null and text is not null").select("doc_id", numbers(F.col("text")))
    return O.missing_designations(asked, evaluation.grades(spark, sf).where("grade >= 2"), held)
