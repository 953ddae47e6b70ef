"""Queries over search operators, each with the same result in SQL where SQL can hold it."""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.functions import text as T
from relevia.operators import judging as J
from relevia.operators import ranking as R
from relevia.operators import retrieval as S
from relevia.plans import evaluation, pools
from relevia.plans.register import register
from relevia.sources import table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

TOK = "regexp_extract_all(replace(lower({0}), 'ё', 'е'), '[0-9a-zа-я]+')"
VECTORS = """
    v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where embedding is not null and vec_id is not null),
    cos as (select a.vec_id as qid, b.vec_id as key, round(list_cosine_similarity(a.e, b.e), 6) as score
            from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
    near as (select qid, key, score, row_number() over (partition by qid order by score desc, key) as rank from cos)"""


def okapi(units: str, asked: str, out: str = "bm", pool: int = 10) -> str:
    return f"""
    {out}_u as (select key, grp, w from (select key, grp, {TOK.format('text')} as w from ({units})) where len(w) > 0),
    {out}_q as (select qid, term, count(*) as qtf from (select qid, unnest({TOK.format('query')}) as term from ({asked})) group by 1, 2),
    {out}_s as (select count(*) as n, avg(len(w)) as avg from {out}_u),
    {out}_p as (select key, grp, len, term, count(*) as tf from (select key, grp, len(w) as len, unnest(w) as term from {out}_u) group by 1, 2, 3, 4),
    {out}_d as (select term, ln(((select n from {out}_s) - count(*) + 0.5) / (count(*) + 0.5)) as raw from {out}_p group by 1),
    {out}_i as (select term, case when raw < 0 then (select avg(raw) * 0.25 from {out}_d) else raw end as idf from {out}_d),
    {out}_c as (select qid, grp, key, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (select avg from {out}_s)))), 6) as score
                from {out}_q join {out}_i using (term) join {out}_p using (term) group by 1, 2, 3),
    {out}_g as (select qid, grp as key, max(score) as score from {out}_c where score > 0 group by 1, 2),
    {out} as (select * from (select qid, key, score, row_number() over (partition by qid order by score desc, key) as rank from {out}_g) where rank <= {pool})"""


ITEMS = "select item_id as qid, question as query from eval_items where item_id % 20 = 0"
DOCS = "select doc_id as key, doc_id as grp, text from documents"
TITLES = "select doc_id as qid, title as query from documents join embeddings on vec_id = doc_id where doc_id % 20 = 0"


def nearest(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return S.vector_search(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 64, k)


@query(f"with {VECTORS} select qid, key, score, cast(rank as integer) as rank from near where rank <= 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact nearest vectors of every 20th vector."""
    return nearest(spark, sf)


@query(f"""with {VECTORS},
    r as (select qid, rank, case when a.label = b.label then 3 else 0 end as g from near join v a on a.vec_id = qid join v b on b.vec_id = key where rank <= 10),
    n as (select label, count(*) - 1 as n from v group by 1)
    select qid, round(sum(g / log2(rank + 1)) / (select sum(3 / log2(i + 1)) from range(1, 11) t(i)), 6) as ndcg,
           coalesce(round(1.0 / min(case when g > 0 then rank end), 6), 0.0) as mrr, coalesce(round(count(*) filter (g > 0) / nullif(max(n), 0), 6), 0.0) as recall
    from r join v on v.vec_id = qid join n using (label) group by qid""")
def vector_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking metrics of vector search with equal labels as relevant."""
    e = table(spark, sf, "embeddings").where("vec_id is not null and embedding is not null")
    near = nearest(spark, sf)
    q, d = e.select(F.col("vec_id").alias("qid"), "label"), e.select(F.col("vec_id").alias("key"), F.col("label").alias("other"))
    n = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    g = F.when(F.col("label") == F.col("other"), 3.0).otherwise(0.0)
    ideal = sum(3 / log2(i + 1) for i in range(1, 11))
    per = near.join(q, "qid").join(d, "key").join(n, "label").groupBy("qid").agg(
        F.round(F.sum(g / F.log2(F.col("rank") + 1.0)) / ideal, 6).alias("ndcg"),
        F.coalesce(F.round(1.0 / F.min(F.when(g > 0, F.col("rank"))), 6), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.round(F.try_divide(F.count_if(g > 0), F.max("n")), 6), F.lit(0.0)).alias("recall"),
    )
    return per


@query()
def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the cell index against exact search."""
    e = table(spark, sf, "embeddings")
    found = S.ivf_search(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 64)
    return S.recall_at(found, nearest(spark, sf)).select("queries", F.round("recall", 4).alias("recall"))


@query(f"with {okapi(DOCS, ITEMS)} select qid, key, score, cast(rank as integer) as rank from bm")
def bm25_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Best documents for every 20th evaluation question."""
    asked = table(spark, sf, "eval_items").where("item_id % 20 = 0")
    return S.bm25(table(spark, sf, "documents"), "doc_id", "text", asked, "item_id", "question")


@query(f"""with {okapi("select cid as key, doc_id as grp, text from (select distinct cid, doc_id, text from chunks) where doc_id is not null", ITEMS)}
    select qid, key, score, cast(rank as integer) as rank from bm""")
def bm25_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Best documents by their best chunk for every 20th evaluation question."""
    asked = table(spark, sf, "eval_items").where("item_id % 20 = 0")
    units = table(spark, sf, "chunks").where("doc_id is not null").select("cid", "doc_id", "text").distinct()
    return S.bm25(units, "cid", "text", asked, "item_id", "question", group="doc_id")


@query(f"""with {VECTORS}, {okapi(DOCS, TITLES, "bm", 50)},
    f as (select coalesce(n.qid, b.qid) as qid, coalesce(n.key, b.key) as key, n.rank as rv, b.rank as rt,
                 round(coalesce(1 / (60.0 + n.rank), 0) + coalesce(1 / (60.0 + b.rank), 0), 9) as score
          from (select * from near where rank <= 50) n full join bm b on n.qid = b.qid and n.key = b.key)
    select * from (select qid, key, score, cast(row_number() over (partition by qid order by score desc, rv nulls last, rt nulls last) as integer) as rank from f) where rank <= 50""")
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and title search fused by reciprocal ranks, pool of 50 (the pool is the operator's own)."""
    docs = table(spark, sf, "documents")
    asked = docs.where("doc_id % 20 = 0").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return S.reciprocal_ranks(nearest(spark, sf, 50), S.bm25(docs, "doc_id", "text", asked, "doc_id", "title", k=50))


@query(f"""with {evaluation.RANKING},
    c as (select distinct doc_id, idx, text from chunks where doc_id is not null and text is not null),
    m as (select doc_id, count(*) || ':' || sum(cast('0x' || substr(md5(coalesce(cast(idx as varchar), '') || '|' || text), 1, 15) as bigint)) as digest from c group by 1),
    r as (select run_id, qid, rank, digest, row_number() over (partition by run_id, qid, digest order by rank) as n from ranking left join m using (doc_id)),
    p as (select run_id, qid, count(*) as slots, count(*) filter (digest is not null) as known, count(*) filter (digest is not null and n > 1) as copies from r group by 1, 2)
    select cast(sum(slots) as bigint) as slots, cast(sum(known) as bigint) as known, cast(sum(copies) as bigint) as copies, count(*) filter (copies > 0) as lists_with_copies from p""")
def copies_in_results(spark: SparkSession, sf: str) -> DataFrame:
    """Places taken by documents whose content, as a sum over its chunks, stood higher in the same list."""
    c = table(spark, sf, "chunks").where("doc_id is not null and text is not null").select("doc_id", "idx", "text").distinct()
    part = F.conv(F.left(F.md5(F.concat_ws("|", F.coalesce(F.col("idx").cast("string"), F.lit("")), F.col("text")).cast("binary")), F.lit(15)), 16, 10).cast("decimal(20,0)")
    digests = c.groupBy("doc_id").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(part).cast("string")).alias("digest"))
    r = evaluation.ranking(spark, sf).join(digests, "doc_id", "left").select(F.struct("run_id", "qid").alias("qid"), "rank", "digest")
    known = r.agg(F.count("digest").alias("known"))
    return S.copy_slots(r, "digest").join(F.broadcast(known), F.lit(True)).select("slots", "known", "copies", "lists_with_copies")


@query(f"""with {pools.NAVIGATION},
    q as (select qid, query from queries where qid is not null union select 'nav:' || type || ':' || doc_id, query from nav),
    w as (select qid, unnest(x) as raw, generate_subscripts(x, 1) as pos from (select qid, regexp_split_to_array(query, '[\\s\\p{{Z}}]+') as x from q)),
    b as (select qid, pos, regexp_replace(raw, '^[.,;:!?«»"''()\\[\\]]+|[.,;:!?«»"''()\\[\\]]+$', '', 'g') as code from w),
    k as (select qid, pos, {pools.LETTERS.format('code')} as n from b where regexp_matches(code, '[0-9]') and regexp_matches(code, '[\\p{{L}}_]')),
    d as (select distinct doc_id, ' ' || {pools.LETTERS.format(pools.STEM)} || ' ' as name from manifest where doc_id is not null),
    h as (select n, doc_id from (select distinct n from k) join d on contains(name, ' ' || n || ' ')),
    o as (select n from h group by 1 having count(*) <= 3),
    m as (select qid, doc_id, min(pos) as pos from k semi join o using (n) join h using (n) group by 1, 2)
    select qid, doc_id, cast(row_number() over (partition by qid order by pos, doc_id) as integer) as hit_no from m""")
def code_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Documents named by a designation of the question, where at most three documents carry it; questions of the table and for navigation."""
    m = table(spark, sf, "manifest")
    nav = J.navigation(m, table(spark, sf, "chunks")).select(F.concat_ws(":", F.lit("nav"), "type", "doc_id").alias("qid"), "query")
    asked = table(spark, sf, "queries").select("qid", "query").union(nav).distinct()
    return J.named_documents(asked, "qid", "query", m)


TWENTIETH = "cast('0x' || substr(md5(type || doc_id), 1, 8) as bigint) % 20 = 0"


@query(f"""with {pools.NAVIGATION},
    {okapi("select doc_id as key, doc_id as grp, {0} || ' ' || coalesce(min(title), '') || ' ' || coalesce(min(key), '') as text from manifest where doc_id is not null group by doc_id".format(pools.STEM), "select type || ':' || doc_id as qid, query from nav where " + TWENTIETH)},
    r as (select n.type, b.rank from nav n left join bm b on b.qid = n.type || ':' || n.doc_id and b.key = n.doc_id where cast('0x' || substr(md5(n.type || n.doc_id), 1, 8) as bigint) % 20 = 0)
    select coalesce(type, 'all') as type, count(*) as n, round(avg(case when rank = 1 then 1.0 else 0.0 end), 6) as hit_1, round(avg(case when rank is not null then 1.0 else 0.0 end), 6) as hit_10,
           round(avg(coalesce(1.0 / rank, 0.0)), 6) as mrr from r group by grouping sets ((type), ())""")
def navigation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """How well lexical search over the document cards finds the document of every twentieth navigation question, by type."""
    m = table(spark, sf, "manifest").where("doc_id is not null").groupBy("doc_id").agg(F.min("title").alias("title"), F.min("key").alias("k"))
    stem = F.regexp_replace(F.regexp_replace("doc_id", "^.*/", ""), r"\.[^.]*$", "")
    cards = m.select("doc_id", F.concat_ws(" ", stem, "title", "k").alias("text"))
    nav = J.navigation(table(spark, sf, "manifest"), table(spark, sf, "chunks")).where(F.conv(F.left(F.md5(F.concat("type", "doc_id").cast("binary")), F.lit(8)), 16, 10).cast("bigint") % 20 == 0)
    nav = nav.withColumn("qid", F.concat_ws(":", "type", "doc_id"))
    found = S.bm25(cards, "doc_id", "text", nav, "qid", "query")
    at = nav.join(found.select("qid", F.col("key").alias("doc_id"), "rank"), ["qid", "doc_id"], "left")
    return evaluation.rounded(R.place_metrics(at, "type"), "hit_1", "hit_10", "mrr")


@query(f"""with {evaluation.RANKING}, q as (select qid, min(dataset) as qd from queries group by 1),
    d as (select doc_id, min(dataset) as dd from manifest group by 1), {evaluation.GOLD},
    ok as (select distinct qd, dd from grades join q using (qid) join d using (doc_id) where grade >= 2)
    select distinct r.qid, r.doc_id, 0 as grade from ranking r join q using (qid) join d using (doc_id)
    where not exists (select 1 from ok where ok.qd = q.qd and ok.dd = d.dd) and not exists (select 1 from grades g where g.qid = r.qid and g.doc_id = r.doc_id)
      and qd is not null and dd is not null""")
def foreign_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Ungraded results from datasets that never answered a question of the query's dataset."""
    from relevia.operators import grades as G

    q = table(spark, sf, "queries").groupBy("qid").agg(F.min("dataset").alias("query_dataset")).where("query_dataset is not null")
    d = table(spark, sf, "manifest").groupBy("doc_id").agg(F.min("dataset").alias("doc_dataset")).where("doc_dataset is not null")
    g = evaluation.grades(spark, sf)
    ok = g.where(F.col("grade") >= R.RELEVANT).join(q, "qid").join(d, "doc_id").select("query_dataset", "doc_dataset")
    named = evaluation.ranking(spark, sf).select("qid", "doc_id").distinct().join(q, "qid").join(d, "doc_id")
    return G.foreign_zero(named, ok, g)


@query("""select qid, dataset, case when scenario between 2 and 4 then coalesce(b.query, q.query) else q.query end as need
    from (select distinct qid, dataset, scenario, query, base from queries) q left join (select qid as base, min(query) as query from queries group by 1) b using (base)""")
def needs(spark: SparkSession, sf: str) -> DataFrame:
    """The information need behind every question."""
    q = table(spark, sf, "queries").select("qid", "dataset", "scenario", "query", "base").distinct()
    b = q.groupBy(F.col("qid").alias("base")).agg(F.min("query").alias("base_query"))
    return q.join(b, "base", "left").select("qid", "dataset", T.need_text(F.col("scenario"), F.col("query"), F.col("base_query")).alias("need"))
