"""Reports over usage, savings, the ledger and its histories. Time is always given as as_of; nothing asks the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a group is large enough to advise on, and what advice it gets.
RIGHTSIZE_USD, LARGE_MODELS, SHORT_OUTPUT, LOW_CACHE, LOW_CACHE_INPUT, HIGH_VOLUME_USD = 0.5, ("opus", "fable"), 300, 0.5, 100_000, 20.0
LANGUAGE_FILES, NARROW_LINES = 3, 8
#: What a ledger event's contract allows.
CONTRACT = {
    "gate": ("admission", "compression", "dispatch", "audit", "quality"),
    "decision": ("deterministic", "admit", "compress", "dispatch", "reject", "escalate", "accept", "repair"),
    "measurement_basis": ("measured", "estimated", "counterfactual"),
    "tier": ("solar", "daylight", "horizon", "twilight", "starlight", "aurora", "unassigned"),
    "status": ("completed", "blocked", "failed", "pending_approval"),
}
CONTRACT_NULLABLE = {"platform": ("generic_code", "sql", "informatica_xml", "datastage", "ssis"), "value_status": ("accepted", "partially_accepted", "rejected", "unknown")}
CONTRACT_REQUIRED = ("event_id", "timestamp", "artifact_id", "run_id", "gate", "decision", "measurement_basis", "candidate_tokens", "admitted_tokens", "transmitted_tokens", "rejected_tokens", "tier", "status")
CONTRACT_COUNTS = ("candidate_tokens", "admitted_tokens", "transmitted_tokens", "rejected_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "budget_input_tokens", "budget_output_tokens", "cost_usd")


def _money(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _count(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def last_days(df: DataFrame, as_of, days: int, ts: str = "ts") -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(ts) >= since)


def cost_report(usage: DataFrame, as_of, days: int = 30, by: str = "project", project: str | None = None) -> DataFrame:
    """by project, model or day: tokens in, out, read from and written to caches, cost, messages; the most expensive first."""
    group = {"project": F.col("project"), "model": F.col("model"), "day": F.to_date("ts").cast("string")}[by]
    rows = last_days(usage, as_of, days)
    rows = rows if project is None else rows.where(F.col("project") == project)
    out = rows.groupBy(group.alias("grp")).agg(_count("input_tokens").alias("input_tokens"), _count("output_tokens").alias("output_tokens"), _count("cache_read_tokens").alias("cache_read_tokens"), _count("cache_write_tokens").alias("cache_write_tokens"), _money("cost_usd").alias("cost_usd"), F.count("*").alias("messages"))
    return out.orderBy(F.desc("cost_usd"), "grp")


def cost_total(usage: DataFrame, as_of, days: int = 30) -> DataFrame:
    return last_days(usage, as_of, days).agg(_money("cost_usd").alias("cost_usd"), F.count("*").alias("messages"))


def savings_by_source(savings: DataFrame, as_of, days: int = 30) -> DataFrame:
    return last_days(savings, as_of, days).groupBy("source").agg(_count("tokens_saved").alias("tokens_saved"), _money("usd_saved").alias("usd_saved"))


def rightsizing(usage: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Groups of project and model that cost enough and deserve advice: usd, n, avg_out, cache_ratio and tags."""
    g = last_days(usage, as_of, days).groupBy("project", F.coalesce("model", F.lit("?")).alias("model")).agg(_count("input_tokens").alias("i"), _count("output_tokens").alias("o"), _count("cache_read_tokens").alias("c"), _money("cost_usd").alias("usd"), F.count("*").alias("n"))
    g = g.where(F.col("usd") > RIGHTSIZE_USD)
    g = g.withColumn("avg_out", F.col("o") / F.greatest(F.col("n"), F.lit(1))).withColumn("cache_ratio", F.col("c") / F.greatest(F.col("i") + F.col("c"), F.lit(1)))
    large = F.lit(False)
    for name in LARGE_MODELS:
        large = large | F.contains(F.col("model"), F.lit(name))
    tags = F.array(F.when(large & (F.col("avg_out") < SHORT_OUTPUT), F.lit("downgrade")), F.when((F.col("cache_ratio") < LOW_CACHE) & (F.col("i") > LOW_CACHE_INPUT), F.lit("low_cache")), F.when(F.col("usd") > HIGH_VOLUME_USD, F.lit("high_volume")))
    g = g.withColumn("tags", F.filter(tags, lambda t: t.isNotNull())).where(F.size("tags") > 0)
    return g.select("project", "model", "usd", "n", "avg_out", "cache_ratio", "tags").orderBy(F.desc("usd"), "project", "model")


def top_projects(usage: DataFrame, as_of, days: int = 30, limit: int = 15) -> DataFrame:
    """The most expensive projects, with the total of all."""
    g = last_days(usage, as_of, days).groupBy("project").agg(_money("cost_usd").alias("cost_usd"), _count(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    total = g.agg(_money("cost_usd").alias("total_usd"))
    return g.orderBy(F.desc("cost_usd"), "project").limit(limit).crossJoin(F.broadcast(total))


def cost_by_day(usage: DataFrame, as_of, days: int = 30) -> DataFrame:
    return last_days(usage, as_of, days).groupBy(F.to_date("ts").alias("day")).agg(_money("cost_usd").alias("cost_usd")).orderBy("day")


def registry_listing(registry: DataFrame) -> DataFrame:
    return registry.select("name", "project", "model", "status", "owner", "updated_at").orderBy(F.desc("updated_at"), "name")


def registry_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("project").agg(F.count("*").alias("agents")).orderBy(F.desc("agents"), "project")


def registry_upsert(registry: DataFrame, found: DataFrame, as_of) -> DataFrame:
    """found: name, project, model, owner. New agents are drafts; known ones get the new project, and the new model unless it is empty."""
    f = found.groupBy(F.concat_ws("/", "project", "name").alias("name")).agg(F.max(F.struct("model", "project", "owner")).alias("f"))
    met = registry.alias("r").join(f.alias("f"), "name", "full")
    new = F.col("f.f").isNotNull()
    return met.select(
        "name", F.coalesce("f.f.project", "r.project").alias("project"), F.coalesce(F.nullif("f.f.model", F.lit("")), F.col("r.model"), F.lit("")).alias("model"), F.coalesce("r.status", F.lit("draft")).alias("status"),
        F.coalesce("r.owner", "f.f.owner").alias("owner"), F.when(new, F.lit(as_of).cast("timestamp")).otherwise(F.col("r.updated_at")).alias("updated_at"), F.coalesce("r.notes", F.lit("auto-registered")).alias("notes"),
    )


def ledger_totals(ledger: DataFrame, per_call: bool = False) -> DataFrame:
    """Sums over all events; per_call: over each call's last admission event only, so that no call counts twice."""
    e = ledger.where((F.col("gate") == "admission") | (F.col("decision") == "blocked")) if per_call else ledger
    n = lambda d: F.count(F.when(F.col("decision") == d, 1))
    t = e.agg(F.countDistinct("artifact_id").alias("artifacts"), _count("tokens_candidate").alias("tokens_candidate"), _count("tokens_transmitted").alias("tokens_transmitted"), _count("tokens_rejected").alias("tokens_rejected"), _money("actual_cost_usd").alias("actual_cost_usd"), n("blocked").alias("blocked_events"), n("admitted").alias("admitted_events"))
    return t.withColumn("blended_reduction", F.when(F.col("tokens_candidate") > 0, 1 - F.col("tokens_transmitted") / F.nullif("tokens_candidate", F.lit(0))).otherwise(0.0))


def by_tier(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("tier").agg(F.count("*").alias("events"), _count("tokens_transmitted").alias("tokens_transmitted"), _money("actual_cost_usd").alias("actual_cost_usd")).orderBy(F.desc("events"), "tier")


def by_reason(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("reason_code").isNotNull()).groupBy("reason_code").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "reason_code")


def active_reservations(reserved: DataFrame) -> DataFrame:
    return reserved.agg(F.count(F.when(F.col("status") == "active", 1)).alias("active"))


def budget_status(usage: DataFrame, budgets: DataFrame, as_of) -> DataFrame:
    """budgets: project, monthly_usd, alert_pct. The month's spend so far, its linear projection to the month's end, and OK, ALERT or OVER."""
    at = F.lit(as_of).cast("timestamp")
    month = usage.where((F.col("ts") >= F.date_trunc("month", at)) & (F.col("ts") <= at)).groupBy("project").agg(F.sum("cost_usd").alias("s"))
    b = budgets.join(month, "project", "left").withColumn("spent_usd", F.coalesce("s", F.lit(0.0)))
    b = b.withColumn("projected_usd", F.col("spent_usd") / F.dayofmonth(at) * F.dayofmonth(F.last_day(at)))
    share = F.col("spent_usd") / F.nullif("monthly_usd", F.lit(0.0))
    status = F.when(share >= 1, "OVER").when(share >= F.col("alert_pct"), "ALERT").otherwise("OK")
    return b.select("project", "monthly_usd", "spent_usd", "projected_usd", status.alias("status"))


# Histories


def decision_history(decisions: DataFrame, project: str | None = None, artifact: str | None = None) -> DataFrame:
    d = decisions if project is None else decisions.where(F.col("project_id") == project)
    d = d if artifact is None else d.where(F.col("artifact_id") == artifact)
    return d.orderBy("occurred_at", "decision_id")


def superseded(decisions: DataFrame) -> DataFrame:
    """decisions with status superseded where another names them."""
    gone = decisions.where(F.col("supersedes_decision_id").isNotNull()).select(F.col("supersedes_decision_id").alias("decision_id"), F.lit(1).alias("_g")).distinct()
    return decisions.join(gone, "decision_id", "left").withColumn("status", F.when(F.col("_g") == 1, "superseded").otherwise(F.col("status"))).drop("_g")


def current_decisions(decisions: DataFrame) -> DataFrame:
    gone = decisions.select(F.col("supersedes_decision_id").alias("decision_id")).where("decision_id IS NOT NULL")
    return decisions.join(gone, "decision_id", "left_anti")


def change_history(changes: DataFrame, artifact: str) -> DataFrame:
    return changes.where(F.col("artifact_id") == artifact).orderBy("occurred_at", "change_id")


def latest_version(changes: DataFrame) -> DataFrame:
    return changes.groupBy("artifact_id").agg(F.max_by("to_version", F.struct("occurred_at", "change_id")).alias("version"))


def changes_between(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """spans: artifact_id, from_version, to_version. Changes after the first one to from_version up to the first to to_version; a missing end is open."""
    c = changes.withColumn("_n", F.row_number().over(Window.partitionBy("artifact_id").orderBy("occurred_at", "change_id")))
    met = c.join(spans.select("artifact_id", F.col("from_version").alias("_from"), F.col("to_version").alias("_to")), "artifact_id")
    whole = Window.partitionBy("artifact_id", "_from", "_to")
    met = met.withColumn("_a", F.min(F.when(F.col("to_version") == F.col("_from"), F.col("_n"))).over(whole)).withColumn("_b", F.min(F.when(F.col("to_version") == F.col("_to"), F.col("_n"))).over(whole))
    inside = (F.col("_n") > F.coalesce("_a", F.lit(0))) & (F.col("_b").isNull() | (F.col("_n") <= F.col("_b")))
    return met.where(inside).drop("_a", "_b", "_n").withColumnRenamed("_from", "span_from").withColumnRenamed("_to", "span_to")


# Reductions


def reduction_by_language(files: DataFrame, price_per_mtok: float = 3.0, least: int = LANGUAGE_FILES) -> DataFrame:
    """files: language, full, skeleton (tokens), symbols. Per language of enough files, and over all those: sums, their ratio, the median of the files' ratios, and cost."""
    f = files.where("skeleton > 0 AND full > 0").withColumn("r", F.col("skeleton") / F.col("full"))
    enough = f.groupBy("language").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("language")
    f = f.join(F.broadcast(enough), "language", "left_semi")
    g = f.rollup("language").agg(F.count("*").alias("files"), _count("full").alias("tokens_full"), _count("skeleton").alias("tokens_skeleton"), _count("symbols").alias("symbols"), (1 - F.percentile("r", 0.5)).alias("median_reduction"), F.grouping_id().alias("_g"))
    g = g.withColumn("reduction", 1 - F.col("tokens_skeleton") / F.nullif("tokens_full", F.lit(0)))
    usd = lambda c: F.col(c) / 1e6 * price_per_mtok
    return g.where("files > 0").select(F.when(F.col("_g") == 1, "all").otherwise(F.col("language")).alias("language"), "files", "tokens_full", "tokens_skeleton", "symbols", "reduction", "median_reduction", usd("tokens_full").alias("usd_full"), usd("tokens_skeleton").alias("usd_skeleton"))


def longest(symbols: DataFrame, least: int = NARROW_LINES) -> DataFrame:
    """symbols: path, qualname, start, end. Each file's longest symbol of more than so many lines, the first of equal ones."""
    lines = F.col("end") - F.col("start") + 1
    one = symbols.where(lines > least).groupBy("path").agg(F.max_by(F.struct("qualname", "start", "end"), F.struct(lines, -F.col("start"), "qualname")).alias("s"))
    return one.select("path", "s.*")


def narrow_reads(symbols: DataFrame, least: int = NARROW_LINES) -> DataFrame:
    """symbols: path, qualname, start, end, tokens, tokens_file. Per file its longest symbol, and what reading only that saves."""
    s = symbols.withColumn("lines", F.col("end") - F.col("start") + 1).where(F.col("lines") > least)
    one = s.groupBy("path").agg(F.max_by(F.struct("qualname", "tokens", "tokens_file"), F.struct("lines", -F.col("start"), "qualname")).alias("s"))
    return one.select("path", F.col("s.qualname").alias("symbol"), F.col("s.tokens_file").alias("tokens_full_file"), F.col("s.tokens").alias("tokens_one_symbol"), (1 - F.col("s.tokens") / F.col("s.tokens_file")).alias("reduction")).orderBy(F.desc("reduction"), "path")


def latency(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.percentile(col, 0.5).alias("p50"), F.max(col).alias("max"), F.count("*").alias("n"))


def contract_violations(events: DataFrame) -> DataFrame:
    """events in the interchange contract's columns (others are taken as absent): event_id and the rules that each breaks, none left out."""
    col = lambda n: F.col(n) if n in events.columns else F.lit(None)
    checks = [F.when(col(n).isNull() | (col(n).cast("string") == ""), F.lit(f"required:{n}")) for n in CONTRACT_REQUIRED]
    checks += [F.when(col(n).isNotNull() & ~col(n).isin(*allowed), F.lit(f"enum:{n}")) for n, allowed in {**CONTRACT, **CONTRACT_NULLABLE}.items()]
    checks += [F.when(col(n) < 0, F.lit(f"minimum:{n}")) for n in CONTRACT_COUNTS if n in events.columns]
    if "complexity_score" in events.columns:
        checks.append(F.when((F.col("complexity_score") < 0) | (F.col("complexity_score") > 100), F.lit("range:complexity_score")))
    checks.append(F.when((col("measurement_basis") == "estimated") & col("estimator").isNull(), F.lit("estimated:estimator")))
    fixed = (F.coalesce(col("transmitted_tokens"), F.lit(0)) != 0) | (F.coalesce(col("tier"), F.lit("solar")) != "solar")
    checks.append(F.when((col("decision") == "deterministic") & fixed, F.lit("deterministic:solar")))
    return events.select("event_id", F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("rules")).where(F.size("rules") > 0)
