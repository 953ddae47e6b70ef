"""Registered queries of the llm operators, over the whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.llm import bpe, leaks, levels, lookalike, ocr
from relevia.llm import consensus as C
from relevia.llm import splits as S
from relevia.llm import topn
from relevia.sources import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every qid."""
    docs = topn.result_documents(table(spark, sf, "responses_hybrid"))
    return topn.top_n_per_group(docs, "qid", "doc_id", "score", 10).select("qid", "rank_no", "doc_id")


def _votes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    grades = C.usable_grades(table(spark, sf, "grades_a").unionByName(table(spark, sf, "grades_b")))
    return grades, grades.unionByName(C.round_grades(table(spark, sf, "judged"), table(spark, sf, "judge_pair")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The agreed grade of every pid graded by three assessors or more."""
    grades, votes = _votes(spark, sf)
    enough = grades.groupBy("pid").count().where("count >= 3").select("pid")
    return C.consensus(votes, "pid", "annotator", "grade").labels.join(enough, "pid", "left_semi").select("pid", "grade")


def p2_annotators(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability and bias of every assessor and earlier round."""
    a = C.consensus(_votes(spark, sf)[1], "pid", "annotator", "grade").annotators
    return a.select("annotator", "n_votes", F.round("reliability", 4).alias("reliability"), F.round("bias", 4).alias("bias"))


def p2_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Chance-corrected agreement of the assessors."""
    grades, _ = _votes(spark, sf)
    a = C.chance_corrected_agreement(grades, "pid", "grade")
    return a.select("n_items", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def _members(spark: SparkSession, sf: str) -> DataFrame:
    base = S.identifier(F.col("base"))
    link = F.when(~base.isin(S.NO_BASE), base)
    return table(spark, sf, "queries").select("qid", S.identifier(F.col("qid")).alias("key"), link.alias("link"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The family of every qid."""
    return S.families(_members(spark, sf), "qid", "key", "link")


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every qid with its family and split."""
    fam = S.families(_members(spark, sf), "qid", "key", "link")
    return fam.join(S.deal_splits(fam, "group_key").select("group_key", "split"), "group_key").select("qid", "group_key", "split")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks, and of queries, that look the same in print."""
    chunks = table(spark, sf, "chunks").select(F.lit("chunks").alias("field"), F.col("cid").alias("number"), F.col("cid").cast("string").alias("key"), "text")
    asked = table(spark, sf, "queries").select(F.lit("queries"), F.lit(0).cast("bigint"), "qid", "query")
    return lookalike.lookalike_pairs(chunks.union(asked), "field", "key", "number", "text")


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk and query whose text looks like an unequal one, with the smallest key of its class and the rows of the class."""
    chunks = table(spark, sf, "chunks").select(F.lit("chunks").alias("field"), F.col("cid").alias("number"), F.col("cid").cast("string").alias("key"), "text")
    asked = table(spark, sf, "queries").select(F.lit("queries"), F.lit(0).cast("bigint"), "qid", "query")
    c = lookalike.lookalike_classes(chunks.union(asked), "field", "key", "number", "text")
    least = c.groupBy("field", "class").agg(F.min(F.struct("number", "key"))["key"].alias("class_key"))
    return c.join(least, ["field", "class"]).select("field", "class_key", "key", "keys").distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of scan noise in every chunk."""
    return ocr.repair_scans(table(spark, sf, "chunks")).noise


def p5_text(spark: SparkSession, sf: str) -> DataFrame:
    """The repaired text of every scanned chunk."""
    return ocr.repair_scans(table(spark, sf, "chunks")).text


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.encode_corpus(docs, "doc_id", "text", bpe.ranks_of(spark))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that give away test items."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return leaks.leaked_items(docs, "doc_id", "text", table(spark, sf, "eval_items"), "item_id", ["question", "passage"])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The reading level of every document of running prose."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = levels.reading_levels(docs, "doc_id", "text", table(spark, sf, "level_samples"), "text", "reading_level")
    return got.select("doc_id", F.col("level").alias("reading_level"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_annotators, p2_agreement, p3_found, p3_splits, p4_found, p4_classes, p5_found, p5_text, p6_ids, p7_found, p8_found)}

# Fixed values of the SQL, written apart from the operator's: Cyrillic, Greek and other letters that look like Latin ones; ё as Latin ë.
_OLD = "асеіјорѕхуАВСЕНІЈКМОРЅТХ" + "οΑΒΕΗΙΚΜΝΟΡΤΧΥΖ" + "\u212aёЁ"
_NEW = "aceijopsxyABCEHIJKMOPSTX" + "oABEHIKMNOPTXYZ" + "KëË"

_FAMILIES = """raw as (select qid, regexp_replace(trim(lower(qid), ' ' || chr(9)), '^q_', 'ai_') as k,
                                      regexp_replace(trim(lower(base), ' ' || chr(9)), '^q_', 'ai_') as b from queries where qid is not null),
             link as (select k, b from raw where b not in ('', '-', '—', 'n/a', 'na', 'none', 'null', 'нет') and b <> k),
             e as (select k as x, b as y from link union select b, k from link),
             reach(x, y) as (select k, k from raw union select r.x, e.y from reach r join e on r.y = e.x),
             least as (select x, min(y) as g from reach group by 1),
             fam as (select qid, min(g) as group_key from raw join least on k = x group by 1)"""
_CANON = f"""t as (select 'chunks' as field, cid as number, cast(cid as varchar) as key, text from chunks
                   union all select 'queries', 0, qid, query from queries),
             c as (select distinct field, number, key, text,
                          translate(nfc_normalize(translate(regexp_replace(replace(replace(text, chr(64257), 'fi'), chr(13) || chr(10), chr(10)),
                              '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g'),
                              '{lookalike.BLANKS + lookalike.FULL}', '{" " * len(lookalike.BLANKS) + lookalike.ASCII.replace("'", "''")}')), '{_OLD}', '{_NEW}') as canon
                   from t where text is not null and key is not null)"""

ORACLES = {
    "p3_found": f"with recursive {_FAMILIES} select qid, group_key from fam",
    "p3_splits": f"""
        with recursive {_FAMILIES},
             sizes as (select group_key, count(*) as size from fam group by 1),
             b as (select *, row_number() over (partition by floor(log2(size)) order by md5('7|' || group_key), group_key) - 1 as i from sizes),
             t as (select *, floor((i + 1) * 0.1::double + 1e-9) > floor(i * 0.1::double + 1e-9) as test, i - floor(i * 0.1::double + 1e-9) as j from b),
             v as (select *, floor((j + 1) * (0.1::double / 0.9::double) + 1e-9) > floor(j * (0.1::double / 0.9::double) + 1e-9) as validation from t)
        select qid, group_key, case when test then 'test' when validation then 'validation' else 'train' end as split from fam join v using (group_key)""",
    "p4_found": f"""
        with {_CANON}
        select distinct a.field, a.key as key_1, b.key as key_2 from c a join c b
          on a.field = b.field and a.canon = b.canon and a.text <> b.text and (a.number < b.number or (a.number = b.number and a.key < b.key))""",
    "p4_classes": f"""
        with {_CANON},
             m as (select field, canon, count(*) as keys, arg_min(key, (number, key)) as class_key from c group by 1, 2 having count(distinct text) > 1)
        select distinct field, class_key, key, keys from c join m using (field, canon)""",
    "p1_found": """
        with r as (select qid, unnest(results) as x from responses_hybrid where http = 200 and qid is not null),
             d as (select qid, regexp_replace(x.absolute_path, '^.*?/corpus/', '', 's') as doc_id, max(x.score) as score
                   from r where x.score is not null and not isnan(x.score) and x.absolute_path is not null group by 1, 2)
        select qid, cast(rank_no as integer) as rank_no, doc_id
        from (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as rank_no from d)
        where rank_no <= 10""",
    "p2_agreement": """
        with g as (select * from grades_a union all select * from grades_b),
             f as (select pid, assessor, grade from g
                   where pid is not null and assessor is not null and grade between 0 and 3
                   qualify row_number() over (partition by pid, assessor order by graded_at nulls last, grade) = 1),
             n as (select pid, count(*) as n, count(*) filter (grade = 0) as n0, count(*) filter (grade = 1) as n1,
                          count(*) filter (grade = 2) as n2, count(*) filter (grade = 3) as n3
                   from f group by pid having count(*) > 1),
             s as (select count(*) as n_items,
                          avg((n0 * (n0 - 1) + n1 * (n1 - 1) + n2 * (n2 - 1) + n3 * (n3 - 1)) / (n * (n - 1))) as observed,
                          pow(sum(n0) / sum(n), 2) + pow(sum(n1) / sum(n), 2) + pow(sum(n2) / sum(n), 2)
                          + pow(sum(n3) / sum(n), 2) as expected from n)
        select n_items, round(observed, 6) as observed, round(expected, 6) as expected,
               round((observed - expected) / (1 - expected), 6) as kappa from s""",
}
