"""Train, validation and test splits that keep connected records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevia.sources import materialize

# Spellings of "no base".
NO_BASE = ["", "-", "—", "n/a", "na", "none", "null", "нет"]


def identifier(raw: Column) -> Column:
    """An identifier in the spelling of the table: lower case, no outer blanks, ``ai_`` for questions written ``q_``."""
    trimmed = F.lower(F.regexp_replace(raw, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.regexp_replace(trimmed, "^q_", "ai_")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contract every vertex along its smallest edge, again and again: (forest edges a, b; labels v, root).

    ``edges`` has string columns a and b; nulls and loops are left out, repeated and reversed edges count once. Both
    results are tables in the shared folder. Edges are totally ordered by their two ends, so the chosen edges form trees
    whose only cycles are pairs of vertices that chose each other; the smaller of such a pair becomes the root. A vertex
    of huge degree is met only in partial minima and in joins against unique keys."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = materialize(e.select("a", "b", F.struct("a", "b").alias("w")))
    labels = materialize(e.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("root")))
    forest = None
    while e.limit(1).count():
        half = e.select(F.col("a").alias("c"), F.col("b").alias("o"), "w").union(e.select("b", "a", "w"))
        pick = half.groupBy("c").agg(F.min(F.struct("w", "o")).alias("m")).select("c", F.col("m.o").alias("p"), F.col("m.w").alias("w"))
        pick = materialize(pick)
        chosen = pick.select("w.a", "w.b").distinct()
        forest = chosen if forest is None else forest.union(chosen)
        back = pick.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = pick.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        up = materialize(up)
        while True:  # pointer jumping: every vertex to the root of its tree
            jump = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            new = materialize(up.join(jump, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            up = new.select("c", "p")
            if not new.where("moved").limit(1).count():
                break
        labels = materialize(labels.join(up, labels.root == up.c, "left").select("v", F.coalesce("p", "root").alias("root")))
        ends = e.join(up.select(F.col("c").alias("a"), F.col("p").alias("ra")), "a").join(up.select(F.col("c").alias("b"), F.col("p").alias("rb")), "b").where("ra <> rb")
        e = materialize(ends.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("w").alias("w")))
    forest = materialize(forest if forest is not None else e.select("a", "b"))
    return forest, labels


def families(members: DataFrame, member: str, key: str, link: str) -> DataFrame:
    """(member, group_key): the smallest key among all that hang together through (key, link) rows.

    A null link leaves a member in the group of its own key. ``members`` may repeat rows; a null member is left out."""
    rows = members.select(F.col(member).alias("m"), F.col(key).alias("k"), F.col(link).alias("t")).where("m is not null and k is not null")
    _, labels = spanning_forest(rows.select(F.col("k").alias("a"), F.col("t").alias("b")))
    least = labels.groupBy("root").agg(F.min("v").alias("g"))
    named = labels.join(least, "root").select(F.col("v").alias("k"), "g")
    own = rows.groupBy("m").agg(F.min("k").alias("k"))
    return own.join(named, "k", "left").select(F.col("m").alias(member), F.coalesce("g", "k").alias("group_key"))


def deal_splits(grouped: DataFrame, group: str, parts: dict[str, float] | None = None, seed: int = 7, per_bucket: int = 100_000) -> DataFrame:
    """(group, size, split): whole groups dealt to ``parts`` in proportion, separately within bands of doubling size.

    Groups of a band are put in the order of their MD5 and dealt in turn: a part receives group i when its running quota
    passes a whole number there, so the first groups of a band, and the only one of a band, go to the first part.
    Positions come from counts per (band, bucket); buckets are ranges of the MD5, more of them the more groups there are,
    so no band is sorted in one task and the order doesn't depend on their number."""
    parts = parts or {"train": 0.8, "validation": 0.1, "test": 0.1}
    sizes = grouped.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes.select("g", "size", (F.length(F.bin("size")) - 1).alias("band"), F.md5(F.concat(F.lit(f"{seed}|"), F.col("g").cast("string")).cast("binary")).alias("h")))
    buckets = max(16, -(-sizes.count() // per_bucket))
    sizes = sizes.withColumn("u", F.floor(F.conv(F.left("h", F.lit(7)), 16, 10).cast("bigint") * buckets / 2**28).cast("int"))
    offs = sizes.groupBy("band", "u").count().withColumn("off", F.sum("count").over(Window.partitionBy("band").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)))
    nth = F.row_number().over(Window.partitionBy("band", "u").orderBy("h", "g")) - 1
    placed = sizes.withColumn("i", nth).join(offs.select("band", "u", F.coalesce("off", F.lit(0)).alias("off")), ["band", "u"]).withColumn("i", F.col("i") + F.col("off"))
    names = list(parts)
    split, left, i = F.lit(names[0]), 1.0, F.col("i").cast("double")
    rules = []
    for name in reversed(names[1:]):
        q = parts[name] / left
        turn = F.floor((i + 1) * q + 1e-9) > F.floor(i * q + 1e-9)
        rules.append((turn, name))
        i, left = i - F.floor(i * q + 1e-9), left - parts[name]
    for turn, name in reversed(rules):
        split = F.when(turn, F.lit(name)).otherwise(split)
    return placed.select(F.col("g").alias(group), "size", split.alias("split"))
