"""Offers of a cheaper read, and the savings that count because somebody took them.

An offer is claimed once, by the next read of its path within a window; the newest offer goes first. Offers are thus a stack
per path that a pause longer than the window empties, so a path's events are cut at such pauses and each run of events is
folded by itself: a busy path is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Seconds that an offer stands; below what size and saving none is made.
WINDOW, LEAST_FILE, LEAST_SAVING = 900, 1200, 600
#: What hosts call their tools.
READ_TOOLS = ("Read", "read_file", "view", "cat", "open_file")
SEARCH_TOOLS = ("Grep", "grep", "search", "rg", "ripgrep")
NARROW_TOOLS = ("host/narrow-read", "HostNarrowRead")
ACCEPT_TOOLS = ("host/accepted", "HostAccepted")
KINDS = ("suggested", "accepted", "ignored", "packed")


def recorded(events: DataFrame) -> DataFrame:
    """events with an unknown kind refused."""
    return events.withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null"))))))


def claims(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """events: id, ts (seconds), kind (suggested, or read), path, tokens_full, tokens_served. A row per read that claims an offer.

    read_id, offer_id, path, ts, tokens_full, tokens_served, saved (no less than 0).
    """
    order = Window.partitionBy("path").orderBy("ts", "id")
    e = events.where(F.col("path").isNotNull() & F.col("kind").isin("suggested", "read"))
    e = e.withColumn("_run", F.sum(F.when(F.col("ts") - F.lag("ts").over(order) > window, 1).otherwise(0)).over(order))
    runs = e.groupBy("path", "_run").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "kind", "tokens_full", "tokens_served"))).alias("e"))
    offer, claim = "array<struct<ts:bigint,id:bigint,full:bigint>>", "array<struct<read:bigint,offer:bigint,ts:bigint,full:bigint,served:bigint>>"
    state = f"struct<stack:{offer},out:{claim}>"

    def step(acc, x):
        push = F.concat(acc["stack"], F.array(F.struct(x["ts"], x["id"], x["tokens_full"])).cast(offer))
        newest = F.try_element_at(acc["stack"], F.lit(-1))
        stands = F.coalesce(newest["ts"] >= x["ts"] - window, F.lit(False))
        rest = F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))
        got = F.concat(acc["out"], F.array(F.struct(x["id"], newest["id"], x["ts"], newest["full"], x["tokens_served"])).cast(claim))
        return F.when(x["kind"] == "suggested", F.struct(push, acc["out"]).cast(state)).when(stands, F.struct(rest, got).cast(state)).otherwise(F.struct(F.array().cast(offer), acc["out"]).cast(state))

    done = runs.select("path", F.inline(F.aggregate("e", F.struct(F.array(), F.array()).cast(state), step)["out"]))
    return done.select(F.col("read").alias("read_id"), F.col("offer").alias("offer_id"), "path", "ts", F.col("full").alias("tokens_full"), F.col("served").alias("tokens_served"), F.greatest(F.col("full") - F.col("served"), F.lit(0)).alias("saved"))


def settled(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """The ledger after all claims: the offers, with claimed set, and an accepted event for each claim."""
    got = claims(events, window)
    offers = events.where("kind = 'suggested'").join(got.select(F.col("offer_id").alias("id"), F.lit(1).alias("_c")), "id", "left")
    offers = offers.select("id", "ts", "kind", "path", "tokens_full", "tokens_served", F.coalesce("_c", F.lit(0)).alias("claimed"))
    taken = got.select(F.col("read_id").alias("id"), "ts", F.lit("accepted").alias("kind"), "path", "tokens_full", "tokens_served", F.lit(1).alias("claimed"))
    return offers.unionByName(taken)


def pending(ledger: DataFrame, as_of: int, window: int = WINDOW) -> DataFrame:
    return ledger.where((F.col("kind") == "suggested") & (F.col("claimed") == 0) & (F.col("ts") >= as_of - window) & (F.col("ts") <= as_of) & F.col("path").isNotNull()).select("path").distinct()


def realized(ledger: DataFrame) -> DataFrame:
    """Per path: offers, accepted, tokens_saved (which a read larger than its file lowers)."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias
    saved = F.coalesce(F.sum(F.when(F.col("kind") == "accepted", F.col("tokens_full") - F.col("tokens_served"))), F.lit(0)).cast("long")
    return ledger.where(F.col("path").isNotNull()).groupBy("path").agg(n("suggested")("offers"), n("accepted")("accepted"), saved.alias("tokens_saved"))


def best_savings(ledger: DataFrame, limit: int = 20) -> DataFrame:
    return realized(ledger).orderBy(F.desc("tokens_saved"), "path").limit(limit)


def summary(ledger: DataFrame) -> DataFrame:
    total = realized(ledger).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("offers", "accepted", "tokens_saved")))
    events = ledger.agg(F.count("*").alias("events"))
    return events.crossJoin(total).withColumn("acceptance_rate", F.when(F.col("offers") > 0, F.bround(F.col("accepted") / F.col("offers"), 3)).otherwise(0.0))


def read_advice(full: Column, skeleton: Column, symbols: Column, band: Column, path: Column, least: int = LEAST_FILE, saving: int = LEAST_SAVING) -> Column:
    """What to say to a read of a whole file: a struct (action, reason, savings). full and skeleton are tokens."""
    saves = full - skeleton
    passes = lambda why: F.struct(F.lit("pass").alias("action"), why.alias("reason"), F.lit(0).cast("long").alias("savings"))
    text = lambda x: x.cast("string")
    offer = F.concat(path, F.lit(" costs "), text(full), F.lit(" tokens in full. Its skeleton is "), text(skeleton), F.lit(" ("), text(F.floor(saves * 100 / F.greatest(F.lit(1), full))), F.lit("% smaller) and lists all "), text(symbols), F.lit(" symbols with line ranges. Read one symbol from it, or the lines you need, instead of the whole file."))
    return (
        F.when(full < least, passes(F.concat(F.lit("file is only "), text(full), F.lit(" tokens; a full read is cheapest"))))
        .when((band == "cool") & (full < least * 4), passes(F.lit("context is cool and the file is moderate; full read is fine")))
        .when(symbols == 0, passes(F.lit("no symbols extracted; nothing better to offer than the file")))
        .when(saves < saving, passes(F.concat(F.lit("skeleton saves only "), text(saves), F.lit(" tokens; not worth the detour"))))
        .otherwise(F.struct(F.lit("suggest").alias("action"), offer.alias("reason"), saves.cast("long").alias("savings")))
    )


def route(tool: Column) -> Column:
    """Which of the hook's answers a tool gets."""
    return F.when(tool.isin(*READ_TOOLS), "read").when(tool.isin(*SEARCH_TOOLS), "search").when(tool.isin(*NARROW_TOOLS), "narrow").when(tool.isin(*ACCEPT_TOOLS), "accept").otherwise("pass")


def routed(payloads: DataFrame, root: str = "/workspace") -> DataFrame:
    """payloads: a JSON string each. tool, route, path (resolved under root; null if it leaves it), query, used."""
    j = lambda *names: F.coalesce(*(F.get_json_object("payload", f"$.{n}") for n in names))
    p = payloads.withColumn("tool", F.coalesce(j("tool", "tool_name"), F.lit("")))
    p = p.withColumn("route", route(F.col("tool")))
    path = j("input.file_path", "tool_input.file_path", "input.path", "tool_input.path", "input.filename", "tool_input.filename")
    query = j("input.pattern", "tool_input.pattern", "input.query", "tool_input.query")
    return p.withColumn("path", T.resolved(path, root)).withColumn("query", query).withColumn("used", F.get_json_object("payload", "$.context_used").try_cast("long"))
