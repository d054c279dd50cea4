"""Logical tables derived from the stored ones, for the queries: all rows of each, nothing drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import governance
from ..schemas import PRICES
from ..sources import tables

AS_OF, MODELS = "2024-01-31 00:00:00", [p[0] for p in PRICES]
WINDOW, RESERVE = 4000, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.spread(table(spark, sf_dir, "documents"), f"{sf_dir}/documents.parquet")
    return d.withColumn("text", F.coalesce("text", F.lit("")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string")).alias("path"), "text")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with headings and fences put before some of their lines, by the line's place."""
    lines = F.split("text", "\n", -1)
    made = F.transform(lines, lambda x, i: F.when(i % 11 == 6, F.concat(F.lit("```\n"), x)).when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (F.lit(1) + (i * 7 + F.length(x)) % 4).cast("int")), F.lit(" "), x)).otherwise(x))
    return corpus(spark, sf_dir).select("path", F.array_join(made, "\n").alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), tokens.estimate_tokens(F.col("text")).alias("tokens"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    sums = lambda to: F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, to)), F.lit(0)).cast("long")
    t = turns(spark, sf_dir).withColumn("input_tokens", sums(-1)).withColumn("cache_read_tokens", sums(-2)).where("role = 'assistant'")
    models = F.array(*map(F.lit, MODELS))
    hours = F.expr("timestamp_seconds(1704067200 + conv_id * 3600 + turn * 60)")
    u = t.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), hours.alias("ts"), F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("team"), (F.col("conv_id") % 5).cast("string")).alias("project"),
        F.get(models, (F.col("conv_id") % len(MODELS)).cast("int")).alias("model"), "input_tokens", F.col("tokens").alias("output_tokens"), "cache_read_tokens", F.lit(0).cast("long").alias("cache_write_tokens"),
    )
    return u.withColumn("cost_usd", governance.cost_usd(F.col("model"), *(F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"))))


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir)
    saved = F.floor(F.col("input_tokens") / 10).cast("long")
    return u.select("ts", F.concat(F.lit("by"), (F.length("message_id") % 3).cast("string")).alias("source"), "project", saved.alias("tokens_saved"), (saved * 3.0 / 1e6).alias("usd_saved"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views offer a cheaper read of the user's path, clicks are narrow reads."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    kind = F.when(F.col("event_type") == "view", "suggested").otherwise("read")
    return e.select(F.col("event_id").cast("long").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), F.col("user_id").cast("string").alias("path"), F.floor(F.col("value") * 100).cast("long").alias("tokens_full"), F.floor(F.col("value") * 10).cast("long").alias("tokens_served"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select(
        "doc_id", "lang", "source", "text", F.regexp_count("text", F.lit(r"[^ \t-\r]+")).alias("ast_node_count"), (tokens.newlines(F.col("text")) % 15).alias("dependency_depth"), ((F.length("text") % 101) / 100).alias("transform_density"),
        ((F.col("doc_id") % 11) / 10).alias("branch_density"), (F.col("doc_id") % 6).alias("external_system_count"), (F.col("doc_id") % 9).alias("unsupported_construct_count"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call per document; some have no score, some a tier that doesn't exist."""
    s = governance.scored(features(spark, sf_dir))
    n = tokens.estimate_tokens(F.col("text"))
    model = F.get(F.array(*map(F.lit, MODELS)), (F.col("doc_id") % len(MODELS)).cast("int"))
    score = F.when(F.col("doc_id") % 97 != 0, F.col("raw"))
    s = s.select(F.coalesce("source", F.lit("none")).alias("session_id"), F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("artifact_id"), F.col("text").alias("payload"), n.alias("candidate_tokens"), score.alias("complexity_score"), F.when(F.col("doc_id") % 89 == 0, "nowhere").otherwise(F.col("tier")).alias("tier"), F.lit("recorded").alias("provider"), model.alias("model"))
    zero = F.lit(0)
    return s.withColumn("estimated_cost_usd", governance.cost_usd(F.col("model"), F.col("candidate_tokens"), zero, zero, zero))


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.admission(envelopes(spark, sf_dir), compressor=governance.by_prefix)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded response per document: a sixth of its tokens, a thousandth of them in cost, and its label."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = documents(spark, sf_dir).join(labels, "doc_id", "left")
    out = F.floor(tokens.estimate_tokens(F.col("text")) / 2).cast("long")
    status = F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").otherwise("pending")
    return d.select(F.coalesce("source", F.lit("none")).alias("session_id"), F.col("doc_id").cast("string").alias("artifact_id"), out.alias("output_tokens"), (out / 1024.0).alias("actual_cost_usd"), status.alias("quality_status"))


def reservation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order reserves its price against a budget of its customer; prices are whole, so sums are exact."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    outcome = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "P", "released")
    met = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return met.select(F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").cast("string").alias("reservation_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.floor("o_totalprice").cast("double").alias("estimated_cost_usd"), (F.floor("c_acctbal") * 100).cast("double").alias("session_budget_usd"), outcome.alias("outcome"), F.floor("o_totalprice").cast("double").alias("actual_cost_usd"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of a user's artifact: a version per event."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(order)
    return e.select(F.col("event_id").cast("string").alias("change_id"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("user_id").cast("string").alias("artifact_id"), F.col("event_type").alias("change_type"), n.alias("n"), F.lag("event_id").over(order).cast("string").alias("before"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda c: F.concat(F.lit("1."), c.cast("string"))
    return log(spark, sf_dir).select("change_id", "occurred_at", "artifact_id", "change_type", v(F.col("n") - 1).alias("from_version"), v(F.col("n")).alias("to_version"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    supersedes = F.when(F.col("change_type") == "purchase", F.col("before"))
    return log(spark, sf_dir).select(F.col("change_id").alias("decision_id"), "occurred_at", F.lit("p").alias("project_id"), "artifact_id", F.col("change_type").alias("decision"), F.lit("accepted").alias("status"), supersedes.alias("supersedes_decision_id"))
