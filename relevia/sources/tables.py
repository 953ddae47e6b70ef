"""Reading the test tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder on one machine
    (``local`` masters, as in tests), an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        path = _own[0]
    return path


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike ``checkpoint()`` the last stage runs once, and the scan knows its size, so Spark itself decides whether a
    later join may broadcast it. The files outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relevia-{uuid.uuid4().hex}"
    _written.append(path)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` of this process has written; results still to be read must be written before."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the highest counts, ``most`` at most and classes of nearly equal counts whole.

    The cut comes from the sizes of the classes (sixteen per doubling, so some hundred rows reach the driver) and nothing is
    sorted; where even the first class is larger than ``most``, the result is empty."""
    level = F.floor(F.log2(count) * 16)
    sizes = sorted(((r.level, r["count"]) for r in rows.where(F.col(count) > 0).groupBy(level.alias("level")).count().collect()), reverse=True)
    total, cut = 0, None
    for at, n in sizes:
        if (total := total + n) > most:
            break
        cut = at
    return rows.where(F.lit(False)) if cut is None else rows.where((F.col(count) > 0) & (level >= cut))
