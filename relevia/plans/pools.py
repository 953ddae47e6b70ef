"""Queries over what to judge and ask next, each with the same result in SQL where SQL can hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.operators import grades as G
from relevia.operators import judging as J
from relevia.operators import quality as Q
from relevia.operators import ranking as R
from relevia.operators import units as U
from relevia.plans import evaluation
from relevia.plans.corpus import NORM, OWN, TOK
from relevia.plans.register import register
from relevia.sources import table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

STEM = "regexp_replace(regexp_replace(doc_id, '^.*/', ''), '\\.[^.]*$', '')"


@query(f"""with {evaluation.RANKING}, {evaluation.GOLD},
    t as (select * from ranking where rank <= 10 and run_id in ('P3', 'P4')),
    f as (select run_id, qid, min(rank) as first from t join grades using (qid, doc_id) where grade >= 2 group by 1, 2),
    s as (select qid, doc_id, count(distinct run_id) as runs from t group by 1, 2)
    select distinct t.qid, t.doc_id from t join s using (qid, doc_id) left join f on f.run_id = t.run_id and f.qid = t.qid
    where (runs = 1 or rank < coalesce(first, 10)) and not exists (select 1 from grades g where g.qid = t.qid and g.doc_id = t.doc_id)""")
def differing_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Ungraded documents that tell two runs apart."""
    return J.differing_pool(evaluation.ranking(spark, sf).where("run_id in ('P3', 'P4')"), evaluation.grades(spark, sf))


@query(f"""with {evaluation.RANKING}, {evaluation.GOLD},
    o as (select run_id, qid, doc_id, coalesce(grade >= 2, false) as rel from ranking left join grades using (qid, doc_id) where rank = 1)
    select count(*) as queries, count(*) filter (a.doc_id <> b.doc_id) as differ, count(*) filter (a.doc_id <> b.doc_id and a.rel and not b.rel) as only_a,
           count(*) filter (a.doc_id <> b.doc_id and not a.rel and b.rel) as only_b from o a join o b using (qid) where a.run_id = 'P3' and b.run_id = 'P4'""")
def first_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    """Where two runs put another document first."""
    return J.first_disagreement(evaluation.ranking(spark, sf), evaluation.grades(spark, sf), "P3", "P4")


@query(f"""with p as (select distinct pid, doc_id, need from judge_pair where pid is not null and need is not null),
    q as (select pid, doc_id, term, count(*) as qtf from (select pid, doc_id, unnest({TOK.format('need')}) as term from p) group by 1, 2, 3),
    c as (select * from (select cid, doc_id, {TOK.format('text')} as w from (select distinct cid, doc_id, text from chunks where doc_id in (select doc_id from p))) where len(w) > 0),
    z as (select doc_id, count(*) as units, avg(len(w)) as avg from c group by 1),
    tf as (select doc_id, cid, len, term, count(*) as tf from (select doc_id, cid, len(w) as len, unnest(w) as term from c) group by 1, 2, 3, 4),
    r as (select doc_id, term, max(avg) as avg, ln((max(units) - count(*) + 0.5) / (count(*) + 0.5)) as raw from tf join z using (doc_id) group by 1, 2),
    e as (select doc_id, avg(raw) * 0.25 as eps from r group by 1),
    s as (select pid, cid, round(sum(qtf * case when raw < 0 then eps else raw end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg))), 6) as score
          from q join r using (doc_id, term) join e using (doc_id) join tf using (doc_id, term) group by 1, 2)
    select pid, cid, score, cast(rank as integer) as rank from (select *, row_number() over (partition by pid order by score desc, cid) as rank from s where score > 0) where rank <= 3""")
def judge_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The three best chunks to show with every pair (a top-three operator)."""
    pairs = table(spark, sf, "judge_pair").select("pid", "doc_id", "need").distinct()
    return J.passages(pairs, table(spark, sf, "chunks").where("doc_id is not null").select("cid", "doc_id", "text").distinct())


LETTERS = "trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
PADDED = "' ' || trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g')) || ' '"
CUT = "array_to_string(regexp_split_to_array(trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g')), ' ')[1:15], ' ')"
NAVIGATION = f"""
    nm as (select doc_id, trim(min(title)) as title, {STEM} as stem from manifest where doc_id is not null group by doc_id),
    nc as (select doc_id, code, pos, {LETTERS.format('code')} as n from (select doc_id, unnest(w) as code, generate_subscripts(w, 1) as pos from (select doc_id, regexp_split_to_array(stem, '[\\s\\p{{Z}}]+') as w from nm))
           where regexp_matches(code, '[0-9]') and regexp_matches(code, '[\\p{{L}}_]')),
    nu as (select n from nc group by 1 having count(distinct doc_id) = 1),
    nh as (select distinct doc_id, h, {LETTERS.format('h')} as n from (select doc_id, trim(regexp_replace(section, '^.* › ', '')) as h from chunks
           where section is not null and doc_id is not null and coalesce(kind, '') <> 'card' and regexp_extract(lower(doc_id), '\\.([^./]+)$', 1) in ('pdf', 'docx', 'pptx', 'txt'))),
    nl as (select n from nh group by 1 having count(distinct doc_id) = 1),
    nx as (select 'name' as type, stem as x, doc_id from nm
           union all select 'title', {CUT.format('title')}, doc_id from nm where coalesce(title <> '', false) and not contains({PADDED.format('stem')}, {PADDED.format('title')})
           union all select 'code', arg_max(code, pos), doc_id from nc semi join nu using (n) group by doc_id
           union all select 'heading', {CUT.format("arg_min(h, md5('20260925|' || h) || h)")}, doc_id from nh semi join nl using (n) where len(regexp_split_to_array(h, '[\\s\\p{{Z}}]+')) >= 3 group by doc_id),
    nav as (select type, doc_id, replace(case type when 'name' then ['Найди файл #', 'Где документ #', 'Открой #', '#'][p % 4 + 1] when 'code' then ['Найди файл #', 'Где файл #', 'Открой документ #', '#'][p % 4 + 1]
                when 'title' then ['Найди документ #', 'Где документ «#»', '#'][p % 3 + 1] else ['Найди раздел #', 'Где раздел «#»', '#'][p % 3 + 1] end, '#', x) as query
            from (select *, cast('0x' || substr(md5('20260925|' || type || '|' || doc_id), 1, 8) as bigint) as p from nx))"""


@query(f"with {NAVIGATION} select type, query, doc_id from nav")
def navigation_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with one document as their answer."""
    return J.navigation(table(spark, sf, "manifest"), table(spark, sf, "chunks"))


@query(f"""with {evaluation.GOLD}, i as (select distinct doc_id from chunks where doc_id is not null), a as (select distinct qid from grades where grade >= 2),
    x as (select distinct qid from grades join i using (doc_id) where grade >= 2)
    select qid, qid in (select qid from x) as indexed from a""")
def answerable_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with a relevant document, and whether such a document is in the chunk table."""
    g = evaluation.grades(spark, sf)
    ok = R.indexed_answerable(g, table(spark, sf, "chunks").where("doc_id is not null")).withColumn("indexed", F.lit(True))
    return R.answerable(g).join(ok, "qid", "left").select("qid", F.coalesce("indexed", F.lit(False)).alias("indexed"))


FLAT = "regexp_replace(regexp_replace({0}, '([0-9])[\\s\\p{{Z}},.]([0-9])', '\\1\\2', 'g'), '([0-9])[\\s\\p{{Z}},.]([0-9])', '\\1\\2', 'g')"


@query(f"""with w as (select distinct pid as ref, doc_id, unnest(list_filter(list_transform(regexp_extract_all(need, '[0-9][0-9\\s\\p{{Z}},.]*[0-9]'), lambda x: regexp_replace(x, '[\\s\\p{{Z}},.]', '', 'g')),
                 lambda x: length(x) >= 4 and not regexp_matches(x, '^20[12][0-9]$'))) as num from judge_pair where need is not null),
    c as (select distinct doc_id, {FLAT.format('text')} as flat from chunks where doc_id is not null and text is not null),
    h as (select distinct ref, doc_id, num from w join c using (doc_id) where contains(flat, num))
    select ref, count(*) as numbers, count(h.num) as found from w left join h using (ref, doc_id, num) group by 1""")
def number_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of the judged needs that their document holds."""
    refs = table(spark, sf, "judge_pair").where("need is not null").select("pid", "doc_id", F.col("need").alias("text"))
    return Q.number_coverage(refs, "pid", "doc_id", "text", table(spark, sf, "chunks").where("text is not null"))


@query("""with s as (select distinct cid as span, doc_id, page_start, greatest(page_start, coalesce(page_end, page_start)) as page_end from chunks where kind = 'notes' and page_start is not null and doc_id is not null),
    c as (select distinct cid, doc_id, page_start, greatest(page_start, coalesce(page_end, page_start)) as page_end from chunks where page_start is not null and doc_id is not null)
    select distinct span, cid from s join c on s.doc_id = c.doc_id and c.page_start <= s.page_end and s.page_start <= c.page_end""")
def overlapping_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks on the pages of notes."""
    c = table(spark, sf, "chunks")
    return U.overlapping_pages(c, c.where("kind = 'notes'").select(F.col("cid").alias("span"), "doc_id", "page_start", "page_end"))


@query(f"""with t as (select distinct cid, {NORM.format('text')} as low, list_transform(list_filter({TOK.format("regexp_replace(title, '\\.(pdf|docx|pptx|txt|xlsx)$', '')")}, lambda x: length(x) >= 4 and not regexp_matches(x, '^[0-9]+$')), lambda x: left(x, 5))[1:6] as stems,
                 doc_id, title, text from chunks where title is not null and text is not null)
    select cid, len(stems) > 0 and len(list_filter(stems, lambda s: contains(low, s))) * 2 >= len(stems) as has_title from t""")
def title_in_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a chunk speaks of its document's title."""
    return Q.context(table(spark, sf, "chunks").select("cid", "doc_id", "title", "text").distinct()).select("cid", "has_title")


@query(f"""with t as (select distinct cid, doc_id, title, {NORM.format('text')} as low, {NORM.format('title')} as name from chunks where title is not null and text is not null),
    w as (select *, list_transform(list_filter({TOK.format("regexp_replace(title, '\\.(pdf|docx|pptx|txt|xlsx)$', '')")}, lambda x: length(x) >= 4 and not regexp_matches(x, '^[0-9]+$')), lambda x: left(x, 5))[1:6] as stems,
                 nullif(regexp_extract(' ' || name || ' ', '[^0-9]([0-9]{{1,5}}-[а-я]{{1,3}})[^а-я]', 1), '') as number, nullif(regexp_extract(' ' || title || ' ', '[^0-9]((?:19|20)[0-9]{{2}})[^0-9]', 1), '') as year from t)
    select cid, doc_id, len(stems) > 0 and len(list_filter(stems, lambda s: contains(low, s))) * 2 >= len(stems) as has_title,
           case when number is not null then regexp_matches(' ' || low || ' ', '[^0-9]' || split_part(number, '-', 1) || '\\s*[^\\p{{L}}\\p{{N}}_]?\\s*' || split_part(number, '-', 2) || '[^а-я]') end as has_number,
           case when year is not null then regexp_matches(' ' || low || ' ', '[^0-9]' || year || '[^0-9]') end as has_year from w""")
def chunk_context(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a chunk speaks of its document's title, act number and year."""
    return Q.context(table(spark, sf, "chunks").select("cid", "doc_id", "title", "text").distinct())


@query(f"""with c as (select split_part(doc_id, '/', 1) as grp, {OWN.format('text')} as t from chunks where text is not null)
    select grp, count(*) as chunks, sum(len(regexp_extract_all(t, '[A-Za-zА-Яа-яЁё][-\\x{{00AD}}\\x{{2010}}\\x{{00AC}}\\x02\\x1F]\\s*\\n\\s*[a-zа-яё]')))::bigint as breaks,
           sum(len(regexp_extract_all(t, '[A-Za-zА-Яа-яЁё][\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]\\s*\\n?\\s*[a-zа-яё]')))::bigint as control_breaks,
           count(*) filter (contains(t, chr(173))) as soft_hyphens, count(*) filter (regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) as controls,
           count(*) filter (regexp_matches(t, 'БАНК\\s+РОССИИ')) as phrase_upper, count(*) filter (regexp_matches(lower(t), 'банк\\s+россии')) as phrase_any from c group by 1""")
def text_defects(spark: SparkSession, sf: str) -> DataFrame:
    """Traces of page layout left in the chunks, by dataset."""
    return Q.text_defects(table(spark, sf, "chunks"), F.split_part("doc_id", F.lit("/"), F.lit(1)), r"банк\s+россии")


@query(f"""with recursive {evaluation.RANKING},
    l as (select run_id, qid, score, doc_id, row_number() over (partition by run_id, qid order by rank) as i from ranking where run_id in ('P3', 'P4') and rank <= 10 and score is not null),
    g(run_id, qid, i, first, grp, doc_id) as (select run_id, qid, i, score, 1, doc_id from l where i = 1
        union all select l.run_id, l.qid, l.i, case when abs(g.first - l.score) <= 1e-6 then g.first else l.score end, case when abs(g.first - l.score) <= 1e-6 then g.grp else g.grp + 1 end, l.doc_id
        from g join l on l.run_id = g.run_id and l.qid = g.qid and l.i = g.i + 1),
    k as (select run_id, qid, grp, list(doc_id order by doc_id) as docs from g group by 1, 2, 3), t as (select run_id, qid, list(docs order by grp) as groups from k group by 1, 2)
    select a.qid, cast(len(a.groups) as integer) as groups_a, cast(len(b.groups) as integer) as groups_b, a.groups = b.groups as same from t a join t b using (qid) where a.run_id = 'P3' and b.run_id = 'P4'""")
def tied_places(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of two runs compared by groups of equal scores."""
    r = evaluation.ranking(spark, sf).where("run_id in ('P3', 'P4') and rank <= 10 and score is not null")
    lists = r.groupBy("run_id", "qid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "doc_id"))).alias("l"))
    groups = lists.select("run_id", "qid", J.tie_groups(F.transform("l", lambda x: x["score"]), F.transform("l", lambda x: x["doc_id"])).alias("g"))
    both = groups.where("run_id = 'P3'").join(groups.where("run_id = 'P4'").select("qid", F.col("g").alias("h")), "qid")
    return both.select("qid", F.size("g").alias("groups_a"), F.size("h").alias("groups_b"), (F.col("g") == F.col("h")).alias("same"))


@query("""with p as (select distinct pid from judge_pair where pid is not null), n as (select greatest(1, floor(count(*) * 0.2)) as k from p),
    o as (select pid, row_number() over (order by md5('20260925/second|' || pid), pid) as i from p), s as (select pid from o, n where i <= k)
    select pid, cast((row_number() over (order by md5('20260925/order|' || pid), pid) - 1) // 40 as integer) as batch from s""")
def second_opinions(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the pairs for a second opinion, in batches (a sampling operator)."""
    return G.second_opinions(table(spark, sf, "judge_pair").where("pid is not null").select("pid").distinct(), "pid")


BATCHED = "b as (select pid, cast((row_number() over (order by md5('20260925|' || pid), pid) - 1) // 40 as integer) as batch from (select distinct pid from judge_pair where pid is not null))"


def graded(which: str) -> str:
    return f"select distinct pid from grades_{which} where pid is not null and grade between 0 and 3"


@query(f"""with {BATCHED}, g as (select 'a' as opinion, pid from ({graded('a')}) union all select 'b', pid from ({graded('b')})),
    r as (select o.opinion, b.batch, b.pid, exists (select 1 from g where g.opinion = o.opinion and g.pid = b.pid) as done from b cross join (select unnest(['a', 'b']) as opinion) o)
    select opinion, batch, count(*) as pairs, count(*) filter (not done) as ungraded from r group by 1, 2 having count(*) filter (not done) > 0""")
def open_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches that still have a pair without a first or without a second opinion."""
    b = G.batches(table(spark, sf, "judge_pair").where("pid is not null").select("pid").distinct(), "pid")
    out = None
    for which in ("a", "b"):
        done = G.first_opinion(table(spark, sf, f"grades_{which}")).select("pid", F.lit(1).alias("done"))
        one = b.join(done, "pid", "left").groupBy("batch").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("done").isNull()).alias("ungraded")).where("ungraded > 0")
        one = one.select(F.lit(which).alias("opinion"), "batch", "pairs", "ungraded")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {evaluation.RANKING},
    t as (select distinct pid, qid, doc_id from judge_pair where pid is not null and pid not in ({graded('b')})),
    n as (select distinct qid, doc_id from ranking where rank <= 10), f as (select distinct t.pid, exists (select 1 from n where n.qid = t.qid and n.doc_id = t.doc_id) as need from t),
    g as (select pid, bool_or(need) as need from f group by 1)
    select pid, case when need then 'p' else 'q' end as part, cast((row_number() over (partition by need order by md5('20260925|' || pid), pid) - 1) // 40 as integer) as batch from g""")
def rebatched_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs without a second opinion: those among the first ten of a run first, the others after them."""
    pairs = table(spark, sf, "judge_pair").where("pid is not null").select("pid", "qid", "doc_id").distinct()
    return G.rebatched(pairs, "pid", G.first_opinion(table(spark, sf, "grades_b")), evaluation.ranking(spark, sf).where("rank <= 10"))


@query("""with a as (select pid, grade from grades_a where pid is not null and grade between 0 and 3 qualify row_number() over (partition by pid order by graded_at nulls last, coalesce(assessor, ''), grade) = 1),
    ok as (select distinct pid from judge_pair p join judged j using (qid, doc_id) where j.grade is not null),
    t as (select pid from a where grade >= 2 and pid not in (select pid from grades_b where pid is not null and grade between 0 and 3) and pid not in (select pid from ok where pid is not null))
    select pid, cast((row_number() over (order by md5('20260925|' || pid), pid) - 1) // 40 as integer) as batch from t""")
def pairs_to_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant pairs without a second opinion, except those that an earlier round has graded."""
    a, b = (G.first_opinion(table(spark, sf, f"grades_{x}")) for x in "ab")
    known = table(spark, sf, "judge_pair").select("pid", "qid", "doc_id").join(table(spark, sf, "judged").where("grade is not null").select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    return G.to_verify(a, b, known)
