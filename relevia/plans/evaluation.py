"""Queries over runs and grades, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.operators import grades as G
from relevia.operators import inference as I
from relevia.operators import ranking as R
from relevia.plans.register import register
from relevia.sources import materialize, table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

RANKING = r"""
    last as (select run_id, qid, results from responses_hybrid
             where http = 200 and qid is not null and run_id is not null and results is not null
             qualify row_number() over (partition by run_id, qid order by asked_at desc nulls last, received_at desc nulls last, ms desc nulls last) = 1),
    hits as (select run_id, qid, unnest(results) as r, generate_subscripts(results, 1) as pos from last),
    docs as (select run_id, qid, regexp_replace(r.absolute_path, '^.*?/corpus/', '', 's') as doc_id, min(pos) as pos, arg_min_null(case when not isnan(r.score) then r.score end, pos) as score
             from hits where r.absolute_path is not null group by 1, 2, 3),
    ranking as (select run_id, qid, doc_id, score, row_number() over (partition by run_id, qid order by pos) as rank from docs)"""
GOLD = """
    first_a as (select pid, grade, graded_at from grades_a where pid is not null and grade between 0 and 3
                qualify row_number() over (partition by pid order by graded_at nulls last, coalesce(assessor, ''), grade) = 1),
    first_b as (select pid, grade, graded_at from grades_b where pid is not null and grade between 0 and 3
                qualify row_number() over (partition by pid order by graded_at nulls last, coalesce(assessor, ''), grade) = 1),
    merged as (select a.pid, a.grade as grade_a, b.grade as grade_b from first_a a left join first_b b using (pid)),
    pairs as (select distinct pid, qid, doc_id from judge_pair),
    grades as (select qid, doc_id, grade from (
                 select qid, doc_id, 0 as p, '' as round, grade_a as grade from merged join pairs using (pid)
                 union all select qid, doc_id, 1, coalesce(round, ''), grade from judged where grade is not null)
               where qid is not null and doc_id is not null
               qualify row_number() over (partition by qid, doc_id order by p, round, grade) = 1)"""
METRICS = """
    top as (select r.run_id, r.qid, r.rank, g.grade from ranking r left join grades g using (qid, doc_id) where rank <= 10),
    got as (select run_id, qid, sum(coalesce(grade, 0) / log2(rank + 1)) as dcg, max(case when rank = 1 and grade >= 2 then 1 else 0 end) as hit_1,
                   max(case when grade >= 2 then 1 else 0 end) as hit_k, min(case when grade >= 2 then rank end) as first,
                   count(*) filter (grade >= 2) as found, count(*) filter (grade is null) as unjudged from top group by 1, 2),
    ideal as (select qid, sum(case when i <= 10 then grade / log2(i + 1) else 0 end) as idcg, count(*) filter (grade >= 2) as rel
              from (select qid, grade, row_number() over (partition by qid order by grade desc) as i from grades) group by 1),
    spine as (select distinct qid from grades where grade >= 2 and qid not in (select qid from queries where scenario = 6 and qid is not null)),
    per as (select n.run_id, s.qid, coalesce(dcg / nullif(idcg, 0), 0.0) as ndcg, cast(coalesce(hit_1, 0) as double) as hit_1, cast(coalesce(hit_k, 0) as double) as hit_k,
                   coalesce(1.0 / first, 0.0) as mrr, coalesce(found / nullif(rel, 0), 0.0) as recall, coalesce(unjudged, 0) as unjudged
            from spine s cross join (select distinct run_id from ranking) n join ideal using (qid) left join got g on g.run_id = n.run_id and g.qid = s.qid)"""
BASE = """(select qid, case when trim(lower(coalesce(base, '')), ' ' || chr(9)) in ('', '-', '—', 'n/a', 'na', 'none', 'null', 'нет') then qid
                 else trim(lower(base), ' ' || chr(9)) end as cluster from queries)"""


def ranking(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranking_of(table(spark, sf, "responses_hybrid"))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return G.merge_opinions(G.first_opinion(table(spark, sf, "grades_a")), G.first_opinion(table(spark, sf, "grades_b")))


def grades(spark: SparkSession, sf: str) -> DataFrame:
    named = merged(spark, sf).join(table(spark, sf, "judge_pair").select("pid", "qid", "doc_id").distinct(), "pid")
    return materialize(G.resolve(named, table(spark, sf, "judged")))


def spine(spark: SparkSession, sf: str, g: DataFrame) -> DataFrame:
    """Questions with a relevant document, without those of scenario 6, which should have no answer."""
    return R.answerable(g, table(spark, sf, "queries").where("scenario = 6"))


def per_query(spark: SparkSession, sf: str) -> DataFrame:
    g = grades(spark, sf)
    return R.per_query(ranking(spark, sf), g, spine(spark, sf, g))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, cluster): the base of a query, or the query itself.

    One hop, as SQL has it: blanks and tabs around a base don't count, ``q_`` and ``ai_`` are different spellings, the base
    of a base isn't followed, and of several bases the smallest is taken. Whole families are those of ``p3_found``."""
    base = F.regexp_replace(F.lower("base"), r"^[ \t]+|[ \t]+$", "")
    none = F.coalesce(base, F.lit("")).isin("", "-", "—", "n/a", "na", "none", "null", "нет")
    return table(spark, sf, "queries").where("qid is not null").groupBy("qid").agg(F.min(F.when(none, F.col("qid")).otherwise(base)).alias("cluster"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"with {RANKING} select run_id, qid, cast(rank as integer) as rank, doc_id, score from ranking")
def ranked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking of every run."""
    return ranking(spark, sf).select("run_id", "qid", "rank", "doc_id", "score")


@query(f"with {GOLD} select qid, doc_id, grade from grades")
def resolved_grades(spark: SparkSession, sf: str) -> DataFrame:
    """One grade per pair: gold first, then earlier rounds."""
    return grades(spark, sf)


@query(f"""with {RANKING}, {GOLD}, {METRICS}
    select run_id, qid, round(ndcg, 6) as ndcg, hit_1, hit_k, round(mrr, 6) as mrr, round(recall, 6) as recall, unjudged from per""")
def metrics_per_query(spark: SparkSession, sf: str) -> DataFrame:
    """Five ranking metrics of every run and answerable query."""
    return rounded(per_query(spark, sf), "ndcg", "mrr", "recall")


@query(f"""with {RANKING}, {GOLD}, {METRICS}
    select run_id, count(*) as n, round(avg(ndcg), 6) as ndcg, round(avg(hit_1), 6) as hit_1, round(avg(hit_k), 6) as hit_k,
           round(avg(mrr), 6) as mrr, round(avg(recall), 6) as recall from per group by 1""")
def metrics_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean metrics of every run."""
    return rounded(R.means(per_query(spark, sf), ["run_id"]), *R.METRICS)


@query(f"""with {RANKING}, {GOLD}, {METRICS},
    kinds as (select qid, min(scenario) as scenario from queries group by 1)
    select run_id, coalesce(cast(scenario as varchar), 'total') as slice, count(*) as n, round(avg(ndcg), 6) as ndcg, round(avg(hit_1), 6) as hit_1,
           round(avg(hit_k), 6) as hit_k, round(avg(mrr), 6) as mrr, round(avg(recall), 6) as recall
    from per join kinds using (qid) group by grouping sets ((run_id, scenario), (run_id))""")
def metrics_by_scenario(spark: SparkSession, sf: str) -> DataFrame:
    """Mean metrics by scenario with the total."""
    kinds = table(spark, sf, "queries").groupBy("qid").agg(F.min("scenario").alias("scenario"))
    rows = per_query(spark, sf).join(kinds, "qid")
    sliced = rows.select("*", F.explode(F.array(F.coalesce(F.col("scenario").cast("string"), F.lit("total")), F.lit("total"))).alias("slice"))
    return rounded(R.means(sliced, ["run_id", "slice"]), *R.METRICS)


@query(f"""with {RANKING}, {GOLD}, {METRICS},
    best as (select qid, max(grade) as m from grades group by 1 having max(grade) >= 2),
    primaries as (select distinct g.qid, lower(regexp_extract(doc_id, '\\.([^./]+)$', 1)) as slice from grades g join best b on b.qid = g.qid and g.grade = b.m)
    select run_id, slice, count(*) as n, round(avg(ndcg), 6) as ndcg, round(avg(hit_1), 6) as hit_1, round(avg(hit_k), 6) as hit_k,
           round(avg(mrr), 6) as mrr, round(avg(recall), 6) as recall from per join primaries using (qid) group by 1, 2""")
def metrics_by_format(spark: SparkSession, sf: str) -> DataFrame:
    """Mean metrics by the formats of the best-graded documents; a query may fall into several slices."""
    g = grades(spark, sf)
    best = g.groupBy("qid").agg(F.max("grade").alias("m")).where("m >= 2")
    primary = g.join(best, "qid").where("grade = m").select("qid", T.extension(F.col("doc_id")).alias("slice")).distinct()
    per = R.per_query(ranking(spark, sf), g, spine(spark, sf, g))
    return rounded(R.means(per.join(primary, "qid"), ["run_id", "slice"]), *R.METRICS)


@query(f"""with {RANKING}, {GOLD}, {METRICS},
    d as (select a.qid, a.ndcg as x, b.ndcg as y, b.ndcg - a.ndcg as d from per a join per b using (qid) where a.run_id = 'P3' and b.run_id = 'P4')
    select count(*) as n, round(avg(x), 6) as mean_a, round(avg(y), 6) as mean_b, round(avg(d), 6) as delta,
           count(*) filter (d > 1e-9) as wins, count(*) filter (d < -1e-9) as losses from d""")
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs side by side: means, difference, wins and losses."""
    c = I.compare(R.paired(per_query(spark, sf), "P3", "P4").withColumn("slice", F.lit("total")), ["slice"], "ndcg")
    return rounded(c, "mean_a", "mean_b", "delta").drop("slice", "p")


@query(f"""with {RANKING}, {GOLD}, {METRICS}, kinds as (select qid, min(scenario) as scenario from queries group by 1),
    d as (select scenario, a.ndcg as x, b.ndcg as y, b.ndcg - a.ndcg as d from per a join per b using (qid) join kinds using (qid) where a.run_id = 'P3' and b.run_id = 'P4'),
    g as (select scenario, count(*) as n, round(avg(x), 6) as mean_a, round(avg(y), 6) as mean_b, round(avg(d), 6) as delta, count(*) filter (d > 1e-9) as wins, count(*) filter (d < -1e-9) as losses from d group by 1)
    select *, round(case when wins + losses = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1),
        lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) end, 6) as p from g""")
def compare_runs_sign_test(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs by scenario with the exact sign test."""
    kinds = table(spark, sf, "queries").groupBy("qid").agg(F.min("scenario").alias("scenario"))
    return rounded(I.compare(R.paired(per_query(spark, sf), "P3", "P4").join(kinds, "qid"), ["scenario"], "ndcg"), "mean_a", "mean_b", "delta", "p")


@query(f"""with {RANKING}, {GOLD}, {METRICS},
    d as (select a.qid, b.ndcg - a.ndcg as d from per a join per b using (qid) where a.run_id = 'P3' and b.run_id = 'P4')
    select 'gain' as side, qid, round(d, 6) as ndcg_delta from (select * from d where d > 1e-9 order by round(d, 9) desc, qid desc limit 5)
    union all select 'loss', qid, round(d, 6) from (select * from d where d < -1e-9 order by round(d, 9), qid limit 5)""")
def top_movers(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest gains and losses between two runs (a report of five)."""
    p = R.paired(per_query(spark, sf), "P3", "P4").withColumn("ndcg_delta", F.round("ndcg_delta", 9))
    return rounded(R.movers(p, "ndcg_delta"), "ndcg_delta")


@query(f"""with {RANKING},
    l as (select run_id, qid, list(doc_id order by rank) as docs from ranking where rank <= 10 group by 1, 2)
    select count(*) as queries, count(*) filter (a.docs = b.docs) as same_list, count(*) filter (list_sort(a.docs) = list_sort(b.docs)) as same_set,
           count(*) filter (a.docs[1] = b.docs[1]) as same_first from l a join l b using (qid) where a.run_id = 'P3' and b.run_id = 'P4'""")
def identical_lists(spark: SparkSession, sf: str) -> DataFrame:
    """How many lists of two runs are the same."""
    return R.same_lists(ranking(spark, sf), "P3", "P4")


@query(f"""with {RANKING}, {GOLD} select run_id, qid, cast(rank as integer) as rank, doc_id from ranking r
    where rank <= 10 and not exists (select 1 from grades g where g.qid = r.qid and g.doc_id = r.doc_id)""")
def unjudged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The pool of documents to judge: first places without a grade."""
    return R.unjudged(ranking(spark, sf), grades(spark, sf)).select("run_id", "qid", "rank", "doc_id")


@query(f"""with {RANKING}, {GOLD},
    opt as (select qid, doc_id, grade from grades union all
            select distinct qid, doc_id, 2 from ranking r where rank <= 10 and not exists (select 1 from grades g where g.qid = r.qid and g.doc_id = r.doc_id)),
    ideal as (select qid, sum(case when i <= 10 then grade / log2(i + 1) else 0 end) as idcg from (select qid, grade, row_number() over (partition by qid order by grade desc) as i from opt) group by 1),
    got as (select run_id, qid, sum(grade / log2(rank + 1)) as dcg from ranking join opt using (qid, doc_id) where rank <= 10 group by 1, 2),
    spine as (select distinct qid from grades where grade >= 2 and qid not in (select qid from queries where scenario = 6 and qid is not null))
    select n.run_id, count(*) as n, round(avg(coalesce(dcg / nullif(idcg, 0), 0.0)), 6) as ndcg
    from spine s cross join (select distinct run_id from ranking) n join ideal using (qid) left join got g on g.run_id = n.run_id and g.qid = s.qid group by 1""")
def metrics_optimistic(spark: SparkSession, sf: str) -> DataFrame:
    """Mean nDCG if all unjudged documents were relevant."""
    g, r = grades(spark, sf), ranking(spark, sf)
    return rounded(R.means(R.per_query(r, R.optimistic(r, g), spine(spark, sf, g)), ["run_id"], ["ndcg"]), "ndcg")


@query(f"""with {GOLD},
    p as (select grade_a as a, grade_b as b from merged where grade_b is not null),
    o as (select count(*) as n, avg(case when a = b then 1.0 else 0.0 end) as exact, avg(pow((a - b) / 3, 2)) as d from p),
    e as (select sum(pow((x.a - y.b) / 3, 2) * x.n * y.n) / (sum(x.n * y.n)) as e from (select a, count(*) as n from p group by 1) x, (select b, count(*) as n from p group by 1) y)
    select n, round(exact, 6) as exact, round(1 - d / e, 6) as kappa from o, e""")
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Quadratically weighted kappa of the first and second opinions."""
    return rounded(G.weighted_kappa(merged(spark, sf), "grade_a", "grade_b"), "exact", "kappa")


KAPPA = """select count(*) as n, 1 - avg(pow((a - b) / 3, 2)) / nullif((select sum(pow((x.a - y.b) / 3, 2) * x.n * y.n) / (sum(x.n) * 1.0 / count(distinct y.b) * sum(y.n) / count(distinct x.a))
    from (select a, count(*) as n from {0} group by 1) x, (select b, count(*) as n from {0} group by 1) y), 0) as kappa from {0}"""


@query(f"""with {GOLD},
    p as (select grade_a as a, grade_b as b from merged where grade_b is not null), z as (select * from p where greatest(a, b) >= 1), ka as ({KAPPA.format('p')}), kz as ({KAPPA.format('z')})
    select (select n from ka) as pairs, round((select kappa from ka), 6) as kappa, round((select kappa from kz), 6) as kappa_relevant, round((select avg(case when a = b then 1.0 else 0.0 end) from p), 6) as exact,
           (select count(*) from p where a <> b and greatest(a, b) >= 2) as conflicts, (select count(distinct pid) from judge_pair where pid is not null and pid not in (select pid from first_a)) as missing""")
def agreement_record(spark: SparkSession, sf: str) -> DataFrame:
    """The agreement of both opinions in one row: kappa over all pairs and over those that one calls at least slightly relevant,
    equal grades, conflicts, pairs without a first opinion."""
    m = merged(spark, sf).where("grade_b is not null")
    both, some = G.weighted_kappa(m, "grade_a", "grade_b"), G.weighted_kappa(m.where("greatest(grade_a, grade_b) >= 1"), "grade_a", "grade_b")
    lost = table(spark, sf, "judge_pair").where("pid is not null").select("pid").distinct().join(G.first_opinion(table(spark, sf, "grades_a")), "pid", "left_anti")
    parts = [both.select(F.col("n").alias("pairs"), "kappa", "exact"), some.select(F.col("kappa").alias("kappa_relevant")), G.conflicts(m).agg(F.count(F.lit(1)).alias("conflicts")), lost.agg(F.count(F.lit(1)).alias("missing"))]
    out = parts[0]
    for one in parts[1:]:
        out = out.join(F.broadcast(one), F.lit(True))  # one row each
    return rounded(out, "kappa", "kappa_relevant", "exact").select("pairs", "kappa", "kappa_relevant", "exact", "conflicts", "missing")


@query(f"with {GOLD} select grade_a as a, grade_b as b, count(*) as n from merged where grade_b is not null group by 1, 2")
def opinion_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every pair of opinions."""
    return G.confusion(merged(spark, sf), "grade_a", "grade_b")


@query(f"with {GOLD} select pid, grade_a, grade_b from merged where grade_a <> grade_b and greatest(grade_a, grade_b) >= 2")
def opinion_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that need a third opinion."""
    return G.conflicts(merged(spark, sf)).select("pid", "grade_a", "grade_b")


@query(f"""with {RANKING},
    top as (select run_id, qid, score from ranking where rank = 1 and score is not null and not isnan(score)),
    k as (select qid, min(scenario) as scenario from queries group by 1),
    r as (select score, scenario <> 6 as pos from top join k using (qid) where scenario is not null),
    x as (select pos, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from r),
    s as (select sum(rk) filter (pos) as rp, count(*) filter (pos) as np, count(*) filter (not pos) as nn from x)
    select round((rp - np * (np + 1) / 2.0) / nullif(np * nn, 0), 6) as auc from s""")
def answer_auc(spark: SparkSession, sf: str) -> DataFrame:
    """How well the first score tells questions with an answer from those without."""
    return rounded(I.roc_auc(first_scores(spark, sf), "score", "pos"), "auc")


def first_scores(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "queries").groupBy("qid").agg(F.min("scenario").alias("scenario")).where("scenario is not null")
    return ranking(spark, sf).where("rank = 1").join(kinds, "qid").select("score", (F.col("scenario") != 6).alias("pos"))


@query(f"""with {RANKING},
    k as (select qid, min(scenario) as scenario from queries group by 1),
    r as (select score as tau, count(*) filter (scenario <> 6) as p, count(*) filter (scenario = 6) as q from ranking join k using (qid)
          where rank = 1 and score is not null and not isnan(score) and scenario is not null group by 1),
    c as (select tau, coalesce(sum(p) over w, 0) / sum(p) over () as loss, coalesce(sum(q) over w, 0) / sum(q) over () as empty
          from r window w as (order by tau rows between unbounded preceding and 1 preceding))
    select tau, round(loss, 6) as loss, round(empty, 6) as empty from c where loss <= 0.05 order by empty desc, tau desc limit 1""")
def answer_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The score below which a response should count as no answer."""
    return rounded(I.threshold(first_scores(spark, sf), "score", "pos"), "loss", "empty")


@query(f"""with {RANKING}, {GOLD}, {METRICS},
    cl as (select qid, min(cluster) as cluster from {BASE} group by 1),
    s as (select row_number() over (order by cluster) - 1 as k, sum(ndcg) as s, count(*) as c from per join cl using (qid) where run_id = 'P4' group by cluster),
    n as (select count(*) as n from s),
    d as (select rep, cast(('0x' || substr(md5(rep || '-' || slot), 1, 15)) as bigint) % n as k from n, range(200) t(rep), range(n) u(slot)),
    r as (select rep, sum(s) / sum(c) as x from d join s using (k) group by rep),
    o as (select list_sort(list(x)) as x from r)
    select round((select sum(s) / sum(c) from s), 6) as mean, round(x[6], 6) as lo, round(x[196], 6) as hi from o""")
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster bootstrap of the mean nDCG of one run, 200 replicates over questions of the same base, which SQL can repeat."""
    return interval(spark, sf, 200)


@query()
def bootstrap_interval_full(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the 2,000 replicates of production."""
    return interval(spark, sf, 2000)


def interval(spark: SparkSession, sf: str, n: int) -> DataFrame:
    t = per_query(spark, sf).where("run_id = 'P4'").join(clusters(spark, sf), "qid")
    return rounded(I.bootstrap(t, "ndcg", "cluster", n=n), "mean", "lo", "hi")


@query("""select coalesce(cast(http as varchar), 'null') as http, count(*) as n, count(*) filter (error is not null) as errors,
           count(*) filter (results[1].score < 0) as fallbacks, round(median(ms), 6) as median_ms, round(max(ms), 6) as max_ms
    from responses_hybrid group by 1""")
def response_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Responses by status: errors, fallbacks (negative first score), latency."""
    r = table(spark, sf, "responses_hybrid").select(F.coalesce(F.col("http").cast("string"), F.lit("null")).alias("http"), "error", "ms", F.get("results", F.lit(0))["score"].alias("first"))
    g = r.groupBy("http").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"), F.count_if(F.col("first") < 0).alias("fallbacks"), F.median("ms").alias("median_ms"), F.max("ms").alias("max_ms"))
    return rounded(g, "median_ms", "max_ms")
