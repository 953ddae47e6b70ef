"""Queries that compare runs: paired differences by slice, intervals, repeats, common sets, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.operators import grades as G
from relevia.operators import inference as I
from relevia.operators import ranking as R
from relevia.operators import retrieval as S
from relevia.plans import evaluation, search
from relevia.plans.register import register
from relevia.sources import table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

BASELINE = "P3"  # the run that others are compared with

SLICES = """
    qs as (select qid, min(scenario) as scenario, min(dataset) as dataset, max(case when extras['explicit_act'] is not null then 1 else 0 end) as named from queries where qid is not null group by 1),
    best as (select qid, max(grade) as m from grades group by 1 having max(grade) >= 2),
    prime as (select distinct g.qid, g.doc_id from grades g join best b on b.qid = g.qid and g.grade = b.m),
    slices as (select qid, 'total' as slice from spine union select qid, 'scenario:' || scenario from qs where scenario is not null union select qid, 'dataset:' || dataset from qs where dataset is not null
               union select qid, 'format:' || lower(regexp_extract(doc_id, '\\.([^./]+)$', 1)) from prime union select qid, 'source:' || split_part(doc_id, '/', 1) from prime
               union select s.qid, case when coalesce(q.named, 0) = 1 then 'named:in' else 'named:out' end from spine s left join qs q using (qid))"""
HOPEFUL = """
    opt as (select qid, doc_id, grade from grades union all
            select distinct qid, doc_id, 2 from ranking r where rank <= 10 and not exists (select 1 from grades g where g.qid = r.qid and g.doc_id = r.doc_id)),
    oideal as (select qid, sum(case when i <= 10 then grade / log2(i + 1) else 0 end) as idcg from (select qid, grade, row_number() over (partition by qid order by grade desc) as i from opt) group by 1),
    ogot as (select run_id, qid, sum(grade / log2(rank + 1)) as dcg from ranking join opt using (qid, doc_id) where rank <= 10 group by 1, 2),
    oper as (select n.run_id, s.qid, coalesce(dcg / nullif(idcg, 0), 0.0) as ndcg from spine s cross join (select distinct run_id from ranking) n join oideal using (qid) left join ogot g on g.run_id = n.run_id and g.qid = s.qid),
    lists as (select run_id, qid, list(doc_id order by rank) as docs from ranking where rank <= 10 group by 1, 2)"""


def slices(spark: SparkSession, sf: str, grades: DataFrame) -> DataFrame:
    """(qid, slice): total, scenario, dataset, format and source of the best-graded documents, and questions that name an act
    against the others; a question may fall into several slices."""
    spine = evaluation.spine(spark, sf, grades)
    q = table(spark, sf, "queries").where("qid is not null").groupBy("qid").agg(
        F.min("scenario").alias("scenario"), F.min("dataset").alias("dataset"), F.max(F.try_element_at("extras", F.lit("explicit_act")).isNotNull()).alias("named")
    )
    best = grades.groupBy("qid").agg(F.max("grade").alias("m")).where("m >= 2")
    prime = grades.join(best, "qid").where("grade = m").select("qid", "doc_id")
    named = spine.join(q, "qid", "left").select("qid", F.when(F.coalesce("named", F.lit(False)), "named:in").otherwise("named:out").alias("slice"))
    own = q.select("qid", F.explode(F.array(F.concat(F.lit("scenario:"), F.col("scenario").cast("string")), F.concat(F.lit("dataset:"), "dataset"))).alias("slice")).where("slice is not null")
    docs = prime.select("qid", F.explode(F.array(F.concat(F.lit("format:"), T.extension(F.col("doc_id"))), F.concat(F.lit("source:"), F.split_part("doc_id", F.lit("/"), F.lit(1))))).alias("slice"))
    return spine.withColumn("slice", F.lit("total")).unionByName(named).unionByName(own).unionByName(docs).distinct()


@query(f"""with {evaluation.RANKING}, {evaluation.GOLD}, {evaluation.METRICS}, {SLICES}, {HOPEFUL},
    d as (select b.run_id, b.qid, a.ndcg as x, b.ndcg as y, b.ndcg - a.ndcg as d, pb.ndcg - pa.ndcg as o, a.unjudged as ua, b.unjudged as ub, coalesce(la.docs, []) = coalesce(lb.docs, []) as same
          from per a join per b using (qid) join oper pa on pa.qid = a.qid and pa.run_id = a.run_id join oper pb on pb.qid = b.qid and pb.run_id = b.run_id
          left join lists la on la.qid = a.qid and la.run_id = a.run_id left join lists lb on lb.qid = b.qid and lb.run_id = b.run_id where a.run_id = '{BASELINE}' and b.run_id <> '{BASELINE}')
    select run_id, slice, count(*) as n, round(avg(x), 6) as mean_a, round(avg(y), 6) as mean_b, round(avg(d), 6) as delta, round(avg(o), 6) as delta_hopeful,
           count(*) filter (d > 1e-9) as wins, count(*) filter (d < -1e-9) as losses, count(*) filter (same) as same_list, cast(sum(ua) as bigint) as unjudged_a, cast(sum(ub) as bigint) as unjudged_b
    from d join slices using (qid) group by 1, 2""")
def paired_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Every run against the baseline in every slice: means, difference, difference if unjudged documents are right, wins,
    losses, equal lists, unjudged places."""
    g, r = evaluation.grades(spark, sf), evaluation.ranking(spark, sf)
    per = R.per_query(r, g, evaluation.spine(spark, sf, g)).select("run_id", "qid", "ndcg", "unjudged")
    hope = R.per_query(r, R.optimistic(r, g), evaluation.spine(spark, sf, g)).select("run_id", "qid", F.col("ndcg").alias("hope"))
    top = r.where("rank <= 10").groupBy("run_id", "qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    full = per.join(hope, ["run_id", "qid"]).join(top, ["run_id", "qid"], "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    a = full.where(F.col("run_id") == BASELINE).select("qid", F.col("ndcg").alias("x"), F.col("hope").alias("hx"), F.col("unjudged").alias("ua"), F.col("docs").alias("da"))
    d = full.where(F.col("run_id") != BASELINE).join(a, "qid").withColumn("d", F.col("ndcg") - F.col("x"))
    out = d.join(slices(spark, sf, g), "qid").groupBy("run_id", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_a"), F.avg("ndcg").alias("mean_b"), F.avg("d").alias("delta"), F.avg(F.col("hope") - F.col("hx")).alias("delta_hopeful"),
        F.count_if(F.col("d") > 1e-9).alias("wins"), F.count_if(F.col("d") < -1e-9).alias("losses"), F.count_if(F.col("docs") == F.col("da")).alias("same_list"),
        F.sum("ua").alias("unjudged_a"), F.sum("unjudged").alias("unjudged_b"),
    )
    return evaluation.rounded(out, "mean_a", "mean_b", "delta", "delta_hopeful")


@query(f"""with {evaluation.RANKING}, {evaluation.GOLD}, {evaluation.METRICS},
    cl as (select qid, min(cluster) as cluster from {evaluation.BASE} group by 1),
    long as (select run_id, qid, m as metric, v from (select run_id, qid, unnest(['ndcg', 'hit_1', 'hit_k', 'mrr', 'recall']) as m, unnest([ndcg, hit_1, hit_k, mrr, recall]) as v from per)),
    d as (select b.run_id, b.metric, b.qid, b.v as mean, b.v - a.v as delta from long a join long b using (qid, metric) where a.run_id = '{BASELINE}' and b.run_id <> '{BASELINE}'),
    keys as (select cluster, row_number() over (order by cluster) - 1 as k from (select distinct cluster from d join cl using (qid))),
    s as (select k, run_id, metric, sum(delta) as s, count(*) as m from d join cl using (qid) join keys using (cluster) group by 1, 2, 3),
    n as (select count(*) as n from keys),
    w as (select rep, k, count(*) as times from (select rep, cast(('0x' || substr(md5(rep || '-' || slot), 1, 15)) as bigint) % n as k from n, range(200) t(rep), range(n) u(slot)) group by 1, 2),
    r as (select run_id, metric, rep, sum(times * s) / sum(times * m) as x from w join s using (k) group by 1, 2, 3),
    o as (select run_id, metric, list_sort(list(x)) as x from r group by 1, 2),
    e as (select run_id, metric, avg(mean) as mean, avg(delta) as delta from d group by 1, 2)
    select run_id, metric, round(mean, 6) as mean, round(delta, 6) as delta, round(x[6], 6) as lo, round(x[196], 6) as hi from e join o using (run_id, metric)""")
def mode_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Every run's metrics with their difference to the baseline and its interval; 200 replicates over clusters, which SQL can repeat."""
    per = evaluation.per_query(spark, sf)
    a = per.where(F.col("run_id") == BASELINE).select("qid", *[F.col(m).alias(f"{m}_a") for m in R.METRICS])
    d = per.where(F.col("run_id") != BASELINE).join(a, "qid").select("run_id", "qid", *R.METRICS, *[(F.col(m) - F.col(f"{m}_a")).alias(f"d_{m}") for m in R.METRICS])
    cut = I.bootstrap_by(d.join(evaluation.clusters(spark, sf), "qid"), "run_id", [f"d_{m}" for m in R.METRICS], "cluster", n=200)
    means = d.groupBy("run_id").agg(*[F.avg(m).alias(m) for m in R.METRICS]).select("run_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean")) for m in R.METRICS])).alias("e"))
    out = cut.select("run_id", F.substring("value", 3, 20).alias("metric"), F.col("mean").alias("delta"), "lo", "hi").join(means.select("run_id", "e.metric", "e.mean"), ["run_id", "metric"])
    return evaluation.rounded(out, "mean", "delta", "lo", "hi").select("run_id", "metric", "mean", "delta", "lo", "hi")


ANSWERS = """
    full_ as (select run_id, qid, results from (select run_id, qid, results, row_number() over (partition by run_id, qid order by asked_at desc nulls last, received_at desc nulls last, ms desc nulls last) as i
              from responses_hybrid where http = 200 and qid is not null and run_id is not null and results is not null) where i = 1),
    docs_ as (select run_id, qid, list_transform(results, lambda r: {'doc_id': regexp_replace(r.absolute_path, '^.*?/corpus/', '', 's'), 'score': case when r.score is null or isnan(r.score) then 0.0 else r.score end}) as docs,
              list_sort(list_transform(flatten(list_transform(results, lambda r: coalesce(r.chunks, []))), lambda c: case when c.score is null or isnan(c.score) then 0.0 else c.score end)) as scores from full_)"""


@query(f"""with {ANSWERS},
    p as (select b.run_id, b.qid, coalesce(a.docs, []) as da, b.docs as db, coalesce(a.scores, []) as sa, b.scores as sb from docs_ b left join docs_ a on a.qid = b.qid and a.run_id = '{BASELINE}' where b.run_id <> '{BASELINE}'),
    f as (select *, len(da) = len(db) and len(list_filter(list_zip(da, db), lambda z: abs(z[1].score - z[2].score) > 1e-6)) = 0 as near,
                 len(list_filter(da, lambda d: len(list_filter(db, lambda e: e.doc_id = d.doc_id and abs(e.score - d.score) <= 1e-6)) = 0)) = 0
                   and len(list_filter(db, lambda d: len(list_filter(da, lambda e: e.doc_id = d.doc_id and abs(e.score - d.score) <= 1e-6)) = 0)) = 0 as same,
                 len(sa) = len(sb) and len(sa) > 0 and len(list_filter(list_zip(sa, sb), lambda z: abs(z[1] - z[2]) > 1e-6)) = 0 as chunks,
                 list_concat(list_filter(da, lambda d: not list_contains(db, d)), list_filter(db, lambda d: not list_contains(da, d))) as apart from p),
    c as (select run_id, case when near and list_transform(da, lambda d: d.doc_id) = list_transform(db, lambda d: d.doc_id) then 'exact' when near and same then 'ties'
                              when chunks and len(list_filter(apart, lambda d: abs(d.score - sa[1]) > 1e-6)) = 0 then 'cut' else 'other' end as verdict from f)
    select run_id, verdict, count(*) as n from c group by 1, 2""")
def repeated_answers(spark: SparkSession, sf: str) -> DataFrame:
    """How far every run repeats the answers of the baseline: exactly, up to ties, up to the cut, or not."""
    r = table(spark, sf, "responses_hybrid").where("http = 200 and qid is not null and run_id is not null and results is not null")
    last = r.groupBy("run_id", "qid").agg(F.max(F.struct("asked_at", "received_at", "ms", F.transform("results", lambda x: F.struct(x["absolute_path"].alias("path"), x["score"].alias("score"), F.transform(F.coalesce(x["chunks"], F.array().cast("array<struct<content:string,score:double>>")), lambda c: c["score"]).alias("chunks"))).alias("results")))["results"].alias("results"))
    sound = lambda c: F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))
    docs = last.select("run_id", "qid", F.transform("results", lambda x: F.struct(T.document_of(x["path"]).alias("doc_id"), sound(x["score"]).alias("score"))).alias("docs"), F.transform(F.flatten(F.transform("results", lambda x: x["chunks"])), sound).alias("scores"))
    base = docs.where(F.col("run_id") == BASELINE).drop("run_id")
    others = docs.where(F.col("run_id") != BASELINE)
    keyed = others.select(F.struct("run_id", "qid").alias("qid"), "docs", "scores")
    mine = others.select("run_id", "qid").join(base, "qid").select(F.struct("run_id", "qid").alias("qid"), "docs", "scores")
    got = R.repeat_classes(mine, keyed)
    return got.groupBy(F.col("qid.run_id").alias("run_id"), "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {evaluation.RANKING}, {evaluation.GOLD},
    held as (select distinct run_id, doc_id from ranking), ok as (select distinct h.run_id, g.qid from grades g join held h using (doc_id) where g.grade >= 2),
    runs as (select count(distinct run_id) as n from ranking)
    select qid, count(*) as runs, count(*) = max(n) as in_all from ok, runs group by qid""")
def answerable_in_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with a relevant document among the documents that a run has shown, in how many runs, and whether in all."""
    r, g = evaluation.ranking(spark, sf), evaluation.grades(spark, sf)
    held = r.select("run_id", "doc_id").distinct()
    ok = g.where(F.col("grade") >= R.RELEVANT).join(held, "doc_id").select("run_id", "qid").distinct()
    runs = held.agg(F.count_distinct("run_id").alias("n"))
    return ok.groupBy("qid").agg(F.count(F.lit(1)).alias("runs")).join(F.broadcast(runs), F.lit(True)).select("qid", "runs", (F.col("runs") == F.col("n")).alias("in_all"))


@query("""with a as (select doc_id, trim(text) as t from chunks where kind = 'text' and text is not null and doc_id is not null), b as (select doc_id, trim(text) as t from chunks where coalesce(kind, '') <> 'text' and text is not null and doc_id is not null),
    c as (select * from a intersect all select * from b), d as (select * from a except all select * from b)
    select (select count(*) from a) as rows_a, (select count(*) from b) as rows_b, (select count(*) from c) as common, (select count(*) from d) as only_a""")
def common_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that stand in a document both as running text and as chunks of other kinds: common rows of two sources, repeats counted."""
    c = table(spark, sf, "chunks").where("text is not null and doc_id is not null").select("doc_id", F.trim("text").alias("t"), F.coalesce(F.col("kind") == "text", F.lit(False)).alias("plain"))
    a, b = c.where("plain").drop("plain"), c.where("not plain").drop("plain")
    out = None
    for name, df in (("rows_a", a), ("rows_b", b), ("common", a.intersectAll(b)), ("only_a", a.exceptAll(b))):
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(F.broadcast(one), F.lit(True))  # one row each
    return out


@query("""with r as (select doc_id, cid, md5(coalesce(text, '')) as h, count(*) as n from chunks where doc_id is not null group by 1, 2, 3)
    select doc_id, cast(sum(n) as bigint) as rows, count(*) as different, cast(sum(n - 1) as bigint) as extra from r group by 1 having sum(n - 1) > 0""")
def changed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose chunk rows differ from their distinct rows, as multisets."""
    c = table(spark, sf, "chunks").where("doc_id is not null").select("doc_id", "cid", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    extra = c.exceptAll(c.distinct()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("extra"))
    sizes = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.join(extra, "doc_id").select("doc_id", "rows", (F.col("rows") - F.col("extra")).alias("different"), "extra")


@query(f"""with {search.okapi(search.DOCS, search.ITEMS, "bm")}, {search.okapi(search.DOCS, search.ITEMS.replace("question as query", "upper(question) as query"), "up")},
    a as (select qid, list(key order by rank) as docs from bm group by 1), b as (select qid, list(key order by rank) as docs from up group by 1)
    select count(*) as queries, count(*) filter (a.docs = b.docs) as same_list from a full join b using (qid)""")
def case_invariance(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every 20th evaluation question finds the same documents in capitals; one index serves both."""
    from relevia.sources import materialize

    asked = table(spark, sf, "eval_items").where("item_id % 20 = 0")
    index = materialize(S.postings(table(spark, sf, "documents"), "doc_id", "text"))
    lists = []
    for name, q in (("x", F.col("question")), ("y", F.upper("question"))):
        found = S.search_postings(index, asked.select("item_id", q.alias("q")), "item_id", "q")
        lists.append(found.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "key"))), lambda r: r["key"]).alias(name)))
    both = lists[0].join(lists[1], "qid", "full")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("x") == F.col("y")).alias("same_list"))


@query(f"""with {evaluation.GOLD},
    v as (select distinct qid, case when trim(lower(base), ' ' || chr(9)) like 'q\\_%' escape '\\' then 'ai_' || substr(trim(lower(base), ' ' || chr(9)), 3) else trim(lower(base), ' ' || chr(9)) end as base from queries where qid is not null and base is not null),
    w as (select * from v where qid <> base and qid not in (select qid from grades))
    select w.qid, g.doc_id, max(g.grade) as grade from w join grades g on g.qid = w.base group by 1, 2""")
def inherited_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Grades that variants of a question take from their base, also where it is spelled ``q_`` for ``ai_``."""
    base = F.regexp_replace(F.regexp_replace(F.lower("base"), r"^[ \t]+|[ \t]+$", ""), "^q_", "ai_")
    return G.inherited(evaluation.grades(spark, sf), table(spark, sf, "queries").select("qid", base.alias("base")))


@query("""with a as (select doc_id, regexp_extract(lower(title), '([0-9]{1,5}-[а-я]{1,3})', 1) as number from manifest where title is not null and doc_id is not null),
    t as (select distinct doc_id, number from a where number <> ''),
    s as (select doc_id as source, unnest(regexp_extract_all(lower(text), '[0-9]{1,5}-[а-я]{1,3}')) as number from chunks where doc_id is not null and text is not null),
    o as (select doc_id as source, number, 3 as grade from t where doc_id in (select doc_id from chunks) union select distinct source, number, 2 from s)
    select source, doc_id, max(grade) as grade from o join t using (number) group by 1, 2""")
def cited_acts(spark: SparkSession, sf: str) -> DataFrame:
    """Acts that a document's chunks cite: grade 3 for the act the document is itself, 2 for others."""
    code = F.lit("[0-9]{1,5}-[а-я]{1,3}")
    acts = table(spark, sf, "manifest").where("title is not null and doc_id is not null").select("doc_id", F.regexp_extract(F.lower("title"), "([0-9]{1,5}-[а-я]{1,3})", 1).alias("number")).where("number <> ''").distinct()
    said = table(spark, sf, "chunks").where("doc_id is not null")
    refs = said.where("text is not null").select(F.col("doc_id").alias("source"), F.array_distinct(F.regexp_extract_all(F.lower("text"), code, 0)).alias("refs")).where("size(refs) > 0").withColumn("own", F.lit(None).cast("string"))
    own = acts.join(said.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("source"), F.array().cast("array<string>").alias("refs"), F.col("number").alias("own"))
    return G.cited(refs.unionByName(own), acts)
