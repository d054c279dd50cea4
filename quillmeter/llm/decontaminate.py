"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, probed by every token window.

Each training text is scanned once. Every window of n words is hashed inside generated code and looked up in the broadcast
n-grams by that 64-bit hash and the window's length; only where both agree are the words compared, one by one. Only hits leave
the scan, so the shuffle carries a row per document and per hit, never texts. The broadcast is bounded by rows and bytes: beyond
``broadcast_grams`` n-grams the windows meet them in a shuffled join instead, each with its own n words only.

Edge cases: null texts and texts without a word have no windows, and aren't contaminated; an item of fewer than n words is
one window of its own length; an item without words is none; items with equal windows are all reported; rows repeated in the
input are repeated in the result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N, BROADCAST_GRAMS = 10, 1_000_000


def benchmark_grams(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row per distinct window of the items: key (hash), m (words in it), gram (its words), items (the ids that hold it)."""
    item = benchmark.select(F.col(id_col).cast("string").alias("item"), common.words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))))
    grams = item.select("item", "w", starts.alias("i")).select("item", F.slice("w", F.col("i") + 1, n).alias("gram"))
    grams = grams.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    m = F.size("gram")
    key = F.coalesce(*(F.when(m == k, common.bag(F.col("gram"), F.lit(0), k)) for k in range(n, 0, -1)))
    return grams.select(key.alias("key"), m.alias("m"), "gram", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Per document: its id, n_words, n_hit, items (array of strings, sorted) and spans (arrays of first word and end, merged)."""
    grams = common.stored(benchmark_grams(benchmark, n), "grams", files=8)
    lengths = [r.m for r in grams.select("m").distinct().orderBy(F.desc("m")).collect()] or [n]  # n numbers at most
    side = common.small_side(grams, broadcast_grams)
    wide = side is grams
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col, F.reverse(text_col)).alias("row"), common.words(F.col(text_col)).alias("w"))
    # The window that starts at -1 stands for the document itself.
    at = text.select("id", "row", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - min(lengths), F.lit(-1)))).alias("i"))
    inside = {m: (F.col("i") >= 0) & (F.col("i") + m <= F.size("w")) for m in lengths}
    if len(lengths) == 1:
        at = at.withColumn("len", F.lit(lengths[0])).withColumn("h", F.when(inside[lengths[0]], common.bag(F.col("w"), F.col("i"), lengths[0])))
    else:
        each = F.array(*(F.struct(F.lit(m).alias("len"), F.when(inside[m], common.bag(F.col("w"), F.col("i"), m)).alias("h")) for m in lengths))
        at = at.select("id", "row", "w", "i", F.inline(each)).where(F.col("h").isNotNull() | (F.col("i") < 0) & (F.col("len") == lengths[0]))
    at = at.withColumn("n_words", F.when(F.col("i") < 0, F.size("w")))
    if wide:  # a shuffled row carries its window, not the text
        at = at.withColumn("w", F.slice("w", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("len"))).withColumn("from", F.lit(0))
    else:
        at = at.withColumn("from", F.greatest(F.col("i"), F.lit(0)))
    met = at.join(side, (at.h == side.key) & (at.len == side.m) & common.same_array(F.slice("w", F.col("from") + 1, F.col("len")), F.col("gram")), "left")
    met = met.where(F.col("items").isNotNull() | (F.col("i") < 0))
    met = met.select("id", "row", "i", "len", "n_words", "items")
    own = F.col("i") < 0
    by = met.groupBy("id", "row").agg(
        F.count(F.when(own, 1)).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(~own, F.struct("i", (F.col("i") + F.col("len")).alias("j"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    start = F.array().cast("array<struct<i:int,j:int>>")

    def merge(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["i"].alias("i"), F.greatest(last["j"], x["j"]).alias("j"))))
        return F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["j"], F.lit(-1)) >= x["i"]), joined).otherwise(F.concat(acc, F.array(x)))

    by = by.withColumn("spans", F.when(F.size("hits") > 0, F.aggregate("hits", start, merge)).otherwise(start))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["j"] - x["i"])
    by = by.withColumn("n_hit", hit)
    return by.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "*").select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, how: str = "documents", n: int = N, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 2_000_000) -> DataFrame:
    """docs without the contaminated documents, or (how="spans") with the hit words and what follows each up to the next word cut out.

    The columns stay as they are. A document is known by its id; rows that share an id share its fate.
    """
    hit, spans = common.unused(docs, "_hit", "_spans")
    found = find_contamination(docs, benchmark, n, id_col, text_col).where("n_hit > 0")
    known = F.col(id_col).eqNullSafe(F.col(hit))
    if how == "documents":
        found = common.stored(found.select(F.col(id_col).alias(hit)).distinct(), "hits")
        return docs.join(common.small_side(found, broadcast_ids), known, "left_anti")
    found = common.stored(found.groupBy(F.col(id_col).alias(hit)).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias(spans)), "hits")
    joined = docs.join(common.small_side(found, broadcast_ids), known, "left")
    any_case = common.WORD.replace(r"\x60", r"\x40\x5B-\x60")
    word, gap = F.regexp_extract_all(text_col, F.lit(any_case), F.lit(0)), F.split(text_col, any_case, -1)
    kept = F.transform(word, lambda w, k: F.when(F.exists(spans, lambda s: (s["i"] <= k) & (k < s["j"])), F.lit("")).otherwise(F.concat(w, F.get(gap, k + 1))))
    cut = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.concat(F.get(gap, F.lit(0)), F.array_join(kept, "")))
    return joined.withColumn(text_col, cut).select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(common.table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g0 AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + 10) AS gram FROM g0),
ms AS (SELECT DISTINCT len(gram) AS m FROM g),
p AS (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, ms WHERE len(w) >= m),
h AS (SELECT p.doc_id, p.i, p.m, g.item_id FROM p JOIN g ON list_slice(p.w, p.i + 1, p.i + p.m) = g.gram),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
