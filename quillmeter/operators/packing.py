"""Ranked hits packed into a token budget: best value per token first, nothing paid twice, everything accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens
from .headroom import policy

#: Fixed value: a hit with so large a part of its lines in selected ranges is dropped.
OVERLAP = 0.70
STUB_LEAST = 40
SECTION = "struct<id:string,citation:string,path:string,symbol:string,kind:string,score:double,tokens:bigint,text:string,i:int,j:int>"


def overhead(citation: Column) -> Column:
    """What a section's frame costs."""
    return tokens.estimate_tokens(F.concat(F.lit("--- "), citation, F.lit(" ---"))) + 2


def density_order(score: Column, cost: Column, id_: Column) -> list[Column]:
    return [-(score / F.greatest(cost, F.lit(1))), -score, id_]


def overlap_ratio(i: Column, j: Column, ranges: Column) -> Column:
    """The share of lines i..j that are in any of ranges (i, j), ends included."""
    cut = F.filter(F.transform(ranges, lambda r: F.struct(F.greatest(r["i"], i).alias("i"), F.least(r["j"], j).alias("j"))), lambda r: r["i"] <= r["j"])
    start = F.struct((i - 1).alias("to"), F.lit(0).alias("n"))
    covered = F.aggregate(F.array_sort(cut), start, lambda a, r: F.struct(F.greatest(a["to"], r["j"]).alias("to"), (a["n"] + F.greatest(F.lit(0), r["j"] - F.greatest(a["to"], r["i"] - 1))).alias("n")), lambda a: a["n"])
    return covered / F.greatest(F.lit(1), j - i + 1)


def pack_hits(hits: DataFrame, budget: Column | int, band: Column | str = "cool", section_cap: int | None = None, dedupe: bool = True) -> DataFrame:
    """hits: query_id and a chunk's id, path, start, end, tokens, symbol, kind, signature, text, and score.

    Per query: text, tokens, budget, used, sections and dropped (arrays), pressure, strategy. The fold over a query's hits skips
    what doesn't fit and goes on. Hits of a query are few, as search bounds them.
    """
    budget = (budget if isinstance(budget, Column) else F.lit(budget)).cast("long")
    band = band if isinstance(band, Column) else F.lit(band)
    h = hits.withColumn("citation", T.citation(F.col("path"), F.col("start"), F.col("end"), F.col("symbol")))
    h = h.withColumn("frame", overhead(F.col("citation"))).withColumn("full", F.col("tokens").cast("long"))
    if section_cap:
        cut = tokens.trim_to_budget(F.col("text"), section_cap, "head", F.concat(F.lit("Full range: "), F.col("citation")))
        h = h.withColumn("cut", F.when(F.col("full") > section_cap, cut))
        h = h.withColumn("text", F.coalesce("cut.text", "text")).withColumn("tokens", F.coalesce("cut.tokens", "full"))
    stub = T.citation(F.col("path"), F.col("start"), F.col("end"), F.col("symbol"))
    stub = tokens.trimmed(F.concat(F.lit("# "), stub, F.lit(" — elided ("), F.col("full").cast("string"), F.lit(" tokens). "), F.coalesce("signature", F.lit(""))))
    h = h.withColumn("stub", stub).withColumn("stub_tokens", tokens.estimate_tokens(F.col("stub")))
    order = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(density_order(F.col("score").cast("double"), F.col("full"), F.col("id")))))
    row = F.struct(order.alias("o"), "id", "citation", "path", F.coalesce("symbol", F.lit("")).alias("symbol"), "kind", F.col("score").cast("double").alias("score"), F.col("tokens").cast("long").alias("tokens"), F.col("start").cast("int").alias("i"), F.col("end").cast("int").alias("j"), F.col("frame").cast("long").alias("frame"), "full", "stub", "stub_tokens", "text")
    q = hits_of(h, row).withColumn("band", band).withColumn("policy", policy(F.col("band"))).withColumn("budget", budget)
    dropped = "array<struct<citation:string,tokens:bigint,reason:string>>"
    state = f"struct<used:bigint,sections:array<{SECTION}>,dropped:{dropped},claimed:array<struct<path:string,i:int,j:int>>>"
    start = F.struct(F.lit(0), F.array(), F.array(), F.array()).cast(state)

    def section(x, text, cost, kind):
        return F.array(F.struct(x["id"], x["citation"], x["path"], x["symbol"], kind, x["score"], cost, text, x["i"], x["j"]).cast(SECTION))

    def step(acc, x):
        share = overlap_ratio(x["i"], x["j"], F.filter(acc["claimed"], lambda r: r["path"] == x["path"])) if dedupe else F.lit(0.0)
        drop = lambda cost, why: F.struct(acc["used"], acc["sections"], F.concat(acc["dropped"], F.array(F.struct(x["citation"], cost, why)).cast(dropped)), acc["claimed"]).cast(state)
        remaining = F.col("budget") - acc["used"] - x["frame"]
        stubbed = F.col("policy.elide_bodies") & (remaining > STUB_LEAST) & (x["symbol"] != "") & (x["stub_tokens"] <= remaining)
        return (
            F.when(share >= OVERLAP, drop(x["full"], F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("% already covered by selected ranges"))))
            .when(x["tokens"] <= remaining, F.struct(acc["used"] + x["tokens"] + x["frame"], F.concat(acc["sections"], section(x, x["text"], x["tokens"], x["kind"])), acc["dropped"], F.concat(acc["claimed"], F.array(F.struct(x["path"], x["i"], x["j"])))).cast(state))
            .when(stubbed, F.struct(acc["used"] + x["stub_tokens"] + x["frame"], F.concat(acc["sections"], section(x, x["stub"], x["stub_tokens"], F.lit("stub"))), acc["dropped"], acc["claimed"]).cast(state))
            .otherwise(drop(x["tokens"], F.lit("over budget")))
        )

    q = q.withColumn("s", F.aggregate("hits", start, step))
    reading = F.transform(F.array_sort(F.transform("s.sections", lambda x: F.struct(x["path"], x["symbol"], x["citation"], x.alias("x")))), lambda y: y["x"])
    q = q.withColumn("sections", reading)
    q = q.withColumn("text", F.array_join(F.transform("sections", lambda x: F.concat(F.lit("--- "), x["citation"], F.lit(" ---\n"), x["text"])), "\n\n"))
    return q.select("query_id", "text", tokens.estimate_tokens(F.col("text")).alias("tokens"), "budget", F.col("s.used").alias("used"), "sections", F.col("s.dropped").alias("dropped"), F.col("band").alias("pressure"), F.col("policy.detail").alias("strategy"), F.size("hits").alias("candidates"))


def hits_of(h: DataFrame, row: Column) -> DataFrame:
    return h.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))


def manifest(packed: DataFrame) -> DataFrame:
    """packed with its account as text: what is in, the first ten that aren't, and how many more."""
    kept = F.transform("sections", lambda x: F.format_string("  + %-52s %6st  score %.3f", x["citation"], x["tokens"].cast("string"), x["score"]))
    out = F.transform(F.slice("dropped", 1, 10), lambda x: F.format_string("  - %-52s %6st  %s", x["citation"], x["tokens"].cast("string"), x["reason"]))
    more = F.when(F.size("dropped") > 10, F.array(F.format_string("  - ... and %d more dropped", F.size("dropped") - 10))).otherwise(F.array().cast("array<string>"))
    head = F.format_string("packed %d/%d tokens (%d sections, %d dropped, strategy=%s, pressure=%s)", "tokens", "budget", F.size("sections"), F.size("dropped"), "strategy", "pressure")
    return packed.withColumn("manifest", F.array_join(F.concat(F.array(head), kept, out, more), "\n"))


def pack_query(hits: DataFrame, chunks: DataFrame, budget: Column | int, band: Column | str = "cool", section_cap: int | None = None) -> DataFrame:
    """hits: query_id, id, score in whole billionths (from a search for three times what the band allows)."""
    from .retrieval import UNIT

    met = hits.select("query_id", "id", (F.col("score") / UNIT).alias("score")).join(chunks, "id")
    return pack_hits(met, budget, band, section_cap)


def pack_files(files: DataFrame, budget: int) -> DataFrame:
    """files: request_id, path, text, tokens, skeleton (empty without structure), skeleton_tokens. Whole files first, the smallest first.

    Per request: used, sections and dropped. A request names its files, so its group is as large as the call.
    """
    row = F.struct("tokens", "path", overhead(F.col("path")).alias("frame"), overhead(F.col("path")).alias("skeleton_frame"), "skeleton_tokens", (F.coalesce("skeleton", F.lit("")) != "").alias("has"), "text", "skeleton")
    q = files.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("files"))
    sections, dropped = "array<struct<citation:string,tokens:bigint,score:double,kind:string,text:string>>", "array<struct<citation:string,tokens:bigint>>"
    state = f"struct<used:bigint,sections:{sections},dropped:{dropped}>"

    def step(acc, x):
        fits = acc["used"] + x["tokens"] + x["frame"] <= budget
        short = x["has"] & (acc["used"] + x["skeleton_tokens"] + x["skeleton_frame"] <= budget)
        add = lambda cost, cite, score, kind, text: F.struct(acc["used"] + cost + x["frame"], F.concat(acc["sections"], F.array(F.struct(cite, cost, F.lit(score), F.lit(kind), text)).cast(sections)), acc["dropped"]).cast(state)
        return (
            F.when(fits, add(x["tokens"], x["path"], 1.0, "file", x["text"]))
            .when(short, add(x["skeleton_tokens"], F.concat(x["path"], F.lit(" (skeleton)")), 0.5, "skeleton", x["skeleton"]))
            .otherwise(F.struct(acc["used"], acc["sections"], F.concat(acc["dropped"], F.array(F.struct(x["path"], x["tokens"])).cast(dropped))).cast(state))
        )

    q = q.withColumn("s", F.aggregate("files", F.struct(F.lit(0), F.array(), F.array()).cast(state), step))
    q = q.withColumn("text", F.array_join(F.transform("s.sections", lambda x: F.concat(F.lit("--- "), x["citation"], F.lit(" ---\n"), x["text"])), "\n\n"))
    return q.select("request_id", "text", tokens.estimate_tokens(F.col("text")).alias("tokens"), F.lit(budget).alias("budget"), F.col("s.used").alias("used"), F.col("s.sections").alias("sections"), F.col("s.dropped").alias("dropped"), F.size("files").alias("files"))


def violations(packed: DataFrame) -> DataFrame:
    """Rows that break the promise; none should."""
    return packed.where(F.col("used") > F.col("budget"))
