"""Mixing sources to target weights: hash-random keys, range order within each source, distributed prefix sums, exact cuts.

A document's key is the MD5 of a seed and its id, so a source's documents stand in a random order that no rerun changes.
The leading bits of the key deal each source into ``buckets`` ranges of that order; a source of any size spreads over all
of them. Bucket totals give each range its offset (a table of sources x buckets rows at most), and a running sum inside each
range gives every document its place. An epoch is one pass through a source in that order: a target beyond the source's
size repeats it, and the last epoch is cut at the exact word.

Edge cases: null texts and texts without words have size 0 and are taken 0 times; a null source is a source, the last; a null
id has a key like any other; equal ids are ordered by size; an empty table gives an empty mix; a source without words gets 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPACE = r"\x20\x09-\x0D"
WEIGHTS, SHARE, MOST, BUCKETS, SEED = (5, 2, 1), 1.5, 2, 512, "mix"


def count_tokens(text: Column) -> Column:
    """How many runs of [^\\x20\\x09-\\x0D] a text has. Each run with the white space around it becomes one letter, so no array of words is made."""
    runs = F.length(F.regexp_replace(text, rf"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "w"))
    return F.when(text.rlike(f"[^{SPACE}]"), runs).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds target: water is poured over the sources by weight, and none holds more than most x its size.

    In the order of cap by weight, the sources before the level are full, and the rest share what is left by weight.
    """
    first = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    s = sizes.withColumn("n", F.row_number().over(first) - 1)
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("n") % len(weights)).cast("long")).withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("left", F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(after)).withColumn("open", F.col("left") * F.col("weight") / F.col("rest") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("n"), F.col("left"), F.col("rest")))).over(Window.partitionBy())
    s = s.withColumn("level", level)
    share_of = F.col("level.left") * F.col("weight") / F.col("level.rest")
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (share_of >= F.col("cap")), F.col("cap").cast("double")).otherwise(share_of).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, cut: str = "words", buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target, taken. cut="words" ends at the exact word; "documents" takes the last document whole if over half of it fits."""
    size = count_tokens(F.coalesce(F.col(text_col), F.lit("")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    # A scan's tasks would each write a small file; the rows without their texts are packed into files of a useful size first.
    slim = common.stored(slim.withColumn("bucket", (F.conv(F.substring("key", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int")).hint("rebalance"), "mix")
    totals = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    offsets = totals.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    known = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    known = common.stored(known.select(F.col("o.source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target"), "mix_offsets", files=8)
    place = Window.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("before", F.coalesce(F.sum("size").over(place), F.lit(0)))
    side = common.small_side(known, 1_000_000)
    placed = placed.join(side, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("before", F.col("before") + F.col("offset"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("before")
    last = F.least(F.col("size"), F.greatest(rest, F.lit(0))) if cut == "words" else F.when(rest * 2 > F.col("size"), F.col("size")).otherwise(0)
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", broadcast_ids: int = 2_000_000, **how) -> DataFrame:
    """The mix itself: every document as many times as it is taken, in whole documents; the columns of docs."""
    mixed = mix_sources(docs, cut="documents", id_col=id_col, **how).where("taken > 0")
    own, times, time = common.unused(docs, "_id", "_times", "_time")
    counted = mixed.groupBy(F.col(id_col).alias(own)).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias(times))
    side = common.small_side(common.stored(counted.hint("rebalance"), "times"), broadcast_ids)
    joined = docs.join(side, F.col(id_col).eqNullSafe(F.col(own)))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(time)).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    return mix_sources(common.table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s0),
s2 AS (SELECT *, [5, 2, 1][CAST(n % 3 AS INT) + 1] AS weight, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *, CAST((SELECT sum(source_size) FROM s0) * 1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
  CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest FROM s2),
lv AS (SELECT rem, rest FROM s3 WHERE rem * weight / rest < cap ORDER BY cap / weight, n LIMIT 1),
t AS (SELECT s3.source, s3.source_size, CASE WHEN lv.rem IS NULL OR lv.rem * s3.weight / lv.rest >= cap THEN CAST(cap AS DOUBLE) ELSE lv.rem * s3.weight / lv.rest END AS target FROM s3 LEFT JOIN lv ON true),
p AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, floor(target) AS budget, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(budget - epochs * source_size - before, 0)) AS BIGINT) AS taken FROM e
"""
