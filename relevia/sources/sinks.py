"""Writing results: JSON lines, grades, batches, replaced rounds, resumable appends, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from relevia.operators.grades import batches


def write_json_lines(df: DataFrame, path: str, force: bool = False) -> None:
    """JSON lines; an existing target is an error unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def write_grades(grades: DataFrame, path: str, force: bool = False) -> None:
    """Tab-separated grades with a header, ordered by query and document within and across files."""
    grades.select("qid", "doc_id", "grade", "source").orderBy("qid", "doc_id").write.mode("overwrite" if force else "errorifexists").csv(path, sep="\t", header=True, quote="")


def replace_rounds(judged: DataFrame, path: str) -> None:
    """Write grades partitioned by round: rounds in ``judged`` replace theirs, other rounds stay."""
    judged.select("qid", "doc_id", "grade", "round").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys aren't written yet, one per key; how many. A rerun after a stop adds only what is missing."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(keys).join(_keys(spark, path, rows, keys), keys, "left_anti")
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def _keys(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    try:
        return spark.read.schema(rows.schema).parquet(path).select(*keys).distinct()
    except AnalysisException:
        return rows.select(*keys).where("false")


def write_batches(pairs: DataFrame, key: str, path: str, size: int = 40) -> None:
    """A folder per batch of ``size`` rows in fixed random order."""
    batches(pairs, key, size).write.mode("overwrite").partitionBy("batch").json(path)


def markdown(report: DataFrame, columns: list[str], limit: int = 500) -> str:
    """A small result table as Markdown; more than ``limit`` rows are an error, as a report is read by people."""
    rows = report.select(*[F.col(c).cast("string") for c in columns]).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if x is None else x for x in r) + " |" for r in rows)]) + "\n"
