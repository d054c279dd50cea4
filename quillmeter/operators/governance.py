"""Admission of model calls: how complex they are, which tier they get, what fits, what is spent, and what is written down."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..schemas import CACHE_READ, CACHE_WRITE, DEFAULT_PRICE, PRICES, SCORE_CEILING, SIZE_TIERS, TIERS, tier_table
from ..sources import tables
from .structure import compressed

#: The most points of each part of the score, and where it is full.
AST_POINTS, AST_FULL, DEPTH_POINTS, DEPTH_FULL, TRANSFORM_POINTS, BRANCH_POINTS, SYSTEM_POINTS, SYSTEM_FULL, UNSUPPORTED_POINTS, UNSUPPORTED_FULL = 25.0, 5000, 20.0, 12.0, 20.0, 15.0, 10.0, 5.0, 10.0, 8.0
#: The fields of a request that may hold its text, in this order.
GATED_FIELDS = ("prompt", "query", "content", "text", "input", "message")
TTL = 300
FEATURES = ("ast_node_count", "dependency_depth", "transform_density", "branch_density", "external_system_count", "unsupported_construct_count")


# Scores and tiers


def feature_faults() -> Column:
    """The rules that a row of features breaks: an array of texts."""
    counts, shares = [FEATURES[k] for k in (0, 1, 4, 5)], FEATURES[2:4]
    checks = [F.when(F.col(f).isNull(), F.lit(f"{f} is missing")) for f in FEATURES]
    checks += [F.when(F.col(f) < 0, F.lit(f"{f} must be non-negative")) for f in counts]
    checks += [F.when((F.col(f) < 0) | (F.col(f) > 1), F.lit(f"{f} must be between 0 and 1")) for f in shares]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def score_parts() -> Column:
    """A struct of the score's parts, unrounded, from columns named as FEATURES."""
    c = F.col
    size = F.when(c("ast_node_count") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(c("ast_node_count").cast("double")) / F.log1p(F.lit(float(AST_FULL)))))
    return F.struct(
        (AST_POINTS * size).alias("ast_size"),
        (DEPTH_POINTS * F.least(c("dependency_depth") / DEPTH_FULL, F.lit(1.0))).alias("dependency_depth"),
        (TRANSFORM_POINTS * c("transform_density")).alias("transform_density"),
        (BRANCH_POINTS * c("branch_density")).alias("branch_density"),
        (SYSTEM_POINTS * F.least(c("external_system_count") / SYSTEM_FULL, F.lit(1.0))).alias("external_systems"),
        (UNSUPPORTED_POINTS * F.least(c("unsupported_construct_count") / UNSUPPORTED_FULL, F.lit(1.0))).alias("unsupported_constructs"),
    )


def scored(features: DataFrame) -> DataFrame:
    """Adds parts, raw (their sum, at most 100), score (to two places) and tier. Rows that break a rule have neither score nor tier."""
    names = ("ast_size", "dependency_depth", "transform_density", "branch_density", "external_systems", "unsupported_constructs")
    out = features.withColumn("faults", feature_faults()).withColumn("parts", F.when(F.size("faults") == 0, score_parts()))
    total = F.col(f"parts.{names[0]}")
    for n in names[1:]:
        total = total + F.col(f"parts.{n}")
    out = out.withColumn("raw", F.when(total.isNotNull(), F.least(F.lit(100.0), total))).withColumn("score", F.bround("raw", 2))
    return out.withColumn("tier", tier_for_score(F.col("score")))


def tier_for_score(score: Column) -> Column:
    """By the score rounded up; null for null, an error outside 0..100."""
    whole, out = F.ceil(score), F.lit(TIERS[-1][0])
    for name, _, top, *_ in reversed(TIERS[:-1]):
        out = F.when(whole <= top, name).otherwise(out)
    return F.when(score.isNull(), None).when((score < 0) | (score > 100), F.raise_error(F.lit("score must be between 0 and 100"))).otherwise(out)


def size_tier(cost: Column) -> Column:
    return F.when(cost <= SIZE_TIERS[0][1], SIZE_TIERS[0][0]).when(cost <= SIZE_TIERS[1][1], SIZE_TIERS[1][0]).otherwise(SIZE_TIERS[2][0])


def size_score(cost: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), cost / SCORE_CEILING * 100))


def gated_field(request: Column) -> Column:
    """The name of the field of a JSON object that holds its text; null if none does."""
    out = F.lit(None).cast("string")
    for name in reversed(GATED_FIELDS):
        value = F.get_json_object(request, f"$.{name}")
        quoted = F.schema_of_variant(F.try_variant_get(F.try_parse_json(request), f"$.{name}", "variant"))
        out = F.when((F.coalesce(value, F.lit("")) != "") & (quoted == "STRING"), name).otherwise(out)
    return out


def gated_text(request: Column) -> Column:
    field = gated_field(request)
    out = request
    for name in GATED_FIELDS:
        out = F.when(field == name, F.get_json_object(request, f"$.{name}")).otherwise(out)
    return out


# Compressors: functions from (payload, cap) to text


def by_prefix(payload: Column, cap: Column) -> Column:
    return F.substring(payload, F.lit(1), F.greatest(cap * 4, F.lit(0)).cast("int"))


def by_lines(payload: Column, cap: Column, keep: str = "both") -> Column:
    return tokens.trim_to_budget(payload, cap, keep)["text"]


def by_structure(payload: Column, cap: Column) -> Column:
    return compressed(payload, cap)


def with_fallback(first, second):
    """The first compressor's text, or the second's where it gives none."""
    return lambda payload, cap: F.coalesce(first(payload, cap), second(payload, cap))


# Admission


def admission(envelopes: DataFrame, tiers: DataFrame | None = None, compressor=by_lines, count=tokens.estimate_tokens, gate: DataFrame | None = None, attempts: int = 2) -> DataFrame:
    """envelopes: see schemas.ENVELOPE. Per envelope: events (array, in order), decision, reason, admitted, rejected, payload (as sent), attempt.

    The gates come in this order: score, tier, budgets (gate: session_id, artifact_id, budget_reason from ``budget_gate``), size.
    Too large payloads are compressed up to attempts times, in a fold inside the row.
    """
    spark = envelopes.sparkSession
    tiers = tier_table(spark) if tiers is None else tiers
    e = envelopes.join(F.broadcast(tiers), "tier", "left")
    e = e.withColumn("candidate", F.coalesce(F.nullif("candidate_tokens", F.lit(0)), count(F.col("payload"))))
    e = e.join(gate, ["session_id", "artifact_id"], "left") if gate is not None else e.withColumn("budget_reason", F.lit(None).cast("string"))
    refused = F.when(F.col("complexity_score").isNull(), "MISSING_SCORE").when(F.col("input_token_cap").isNull(), "INVALID_TIER").otherwise(F.col("budget_reason"))
    event = "struct<gate:string,decision:string,admitted:bigint,rejected:bigint,reason:string,attempt:int>"
    state = f"struct<text:string,n:bigint,open:boolean,attempt:int,events:array<{event}>>"

    def make(gate, decision, admitted, rejected, reason, attempt):
        return F.array(F.struct(F.lit(gate), F.lit(decision), admitted, rejected, reason, attempt).cast(event))

    zero, cap = F.lit(0), F.col("input_token_cap")

    def attempt(acc, _):
        over = make("compression", "recompress", zero, acc["n"] - cap, F.lit("TIER_INPUT_CAP_EXCEEDED"), acc["attempt"])
        out = make("compression", "blocked", zero, acc["n"], F.lit("RECOMPRESSION_EXHAUSTED"), acc["attempt"])
        ended = F.struct(acc["text"], acc["n"], F.lit(False), acc["attempt"], F.concat(acc["events"], over, out)).cast(state)

        def tried(x):
            stuck = x["m"] >= acc["n"]
            none = make("compression", "blocked", zero, x["m"], F.lit("RECOMPRESSION_NO_PROGRESS"), acc["attempt"] + 1)
            events = F.concat(acc["events"], over, F.when(stuck, none).otherwise(F.array().cast(f"array<{event}>")))
            return F.struct(x["new"], x["m"], ~stuck, acc["attempt"] + 1, events).cast(state)

        new = tokens.bound(compressor(acc["text"], cap), lambda t: F.struct(t.alias("new"), count(t).alias("m")))
        return F.when(~acc["open"] | (acc["n"] <= cap), acc).when(acc["attempt"] >= F.col("max_attempts"), ended).otherwise(tokens.bound(new, tried))

    start = F.struct(F.col("payload"), count(F.col("payload")), F.lit(True), F.lit(0), F.array().cast(f"array<{event}>")).cast(state)
    sized = F.aggregate(F.sequence(F.lit(0), F.lit(attempts)), start, attempt)

    def admitted(x):
        last = make("admission", "admitted", x["n"], F.greatest(F.col("candidate") - x["n"], zero), F.lit("WITHIN_TIER_AND_COST_BUDGET"), x["attempt"])
        return F.when(x["open"], F.struct(x["text"], x["n"], x["open"], x["attempt"], F.concat(x["events"], last)).cast(state)).otherwise(x)

    blocked = F.struct(F.lit(None).cast("string"), zero, F.lit(False), zero, make("admission", "blocked", zero, F.col("candidate"), F.col("_refused"), zero)).cast(state)
    # A generator's row, not a column: else filters on what comes out would repeat the fold below themselves, once for each condition.
    e = e.withColumn("_refused", refused).withColumn("_s", F.explode(F.array(F.when(F.col("_refused").isNotNull(), blocked).otherwise(tokens.bound(sized, admitted)))))
    keep = [c for c in envelopes.columns if c not in ("payload", "candidate_tokens")]
    last, ok = F.element_at("_s.events", -1), F.col("_s.open")
    return e.select(*keep, F.col("candidate").alias("candidate_tokens"), "output_token_cap", F.col("_s.events").alias("events"), last["decision"].alias("decision"), last["reason"].alias("reason"), F.when(ok, F.col("_s.n")).otherwise(0).cast("long").alias("admitted"), last["rejected"].alias("rejected"), F.when(ok, F.col("_s.text")).alias("payload"), F.col("_s.attempt").alias("attempt"))


def ledger_events(admitted: DataFrame) -> DataFrame:
    """A ledger row per event of each envelope; event_id follows from the envelope and the event's place."""
    a = admitted.select("session_id", "artifact_id", "complexity_score", "tier", "provider", "model", F.col("candidate_tokens").alias("tokens_candidate"), "estimated_cost_usd", F.posexplode("events").alias("_k", "e"))
    return a.select(
        F.concat_ws("/", "session_id", "artifact_id", F.col("_k").cast("string")).alias("event_id"), "session_id", "artifact_id", F.lit("provider_call").alias("event_type"), F.col("e.gate").alias("gate"), F.col("e.decision").alias("decision"),
        "complexity_score", "tier", "provider", "model", "tokens_candidate", F.col("e.admitted").alias("tokens_admitted"), F.col("e.admitted").alias("tokens_transmitted"), F.col("e.rejected").alias("tokens_rejected"),
        "estimated_cost_usd", F.lit(None).cast("double").alias("actual_cost_usd"), F.col("e.attempt").alias("recompress_attempt"), F.lit(None).cast("string").alias("quality_status"), F.lit("estimated").alias("evidence_basis"), F.col("e.reason").alias("reason_code"),
    )


def completions(admitted: DataFrame, responses: DataFrame) -> DataFrame:
    """responses: session_id, artifact_id, output_tokens, actual_cost_usd, quality_status. The audit event of each admitted call.

    An output over the tier's cap is a violation: its cost is booked, its evidence stays estimated, and rejected is the overage.
    """
    met = admitted.where("decision = 'admitted'").join(responses, ["session_id", "artifact_id"])
    over = F.col("output_tokens") > F.col("output_token_cap")
    return met.select(
        F.concat_ws("/", "session_id", "artifact_id", F.lit("audit")).alias("event_id"), "session_id", "artifact_id", F.lit("provider_call").alias("event_type"), F.lit("audit").alias("gate"), F.when(over, "violated").otherwise("completed").alias("decision"),
        "complexity_score", "tier", "provider", "model", F.col("candidate_tokens").alias("tokens_candidate"), F.col("admitted").alias("tokens_admitted"), F.col("admitted").alias("tokens_transmitted"), F.when(over, F.col("output_tokens") - F.col("output_token_cap")).otherwise(F.col("rejected")).cast("long").alias("tokens_rejected"),
        "estimated_cost_usd", "actual_cost_usd", F.col("attempt").alias("recompress_attempt"), "quality_status", F.when(over, "estimated").otherwise("measured").alias("evidence_basis"), F.when(over, "TIER_OUTPUT_CAP_EXCEEDED").otherwise("CALL_COMPLETED").alias("reason_code"),
    )


def spend(ledger: DataFrame, by: str = "session_id") -> DataFrame:
    """Measured cost by session or artifact; a cost that is null wasn't measured and doesn't count."""
    return ledger.groupBy(by).agg(F.coalesce(F.sum("actual_cost_usd"), F.lit(0.0)).alias("spent_usd"))


def sessions(upserts: DataFrame) -> DataFrame:
    """upserts: session_id, project_id, budget_usd, ts. Each session's first project and its last budget that isn't null."""
    order = F.struct("ts", "project_id")
    return upserts.groupBy("session_id").agg(F.min_by("project_id", order).alias("project_id"), F.max_by("budget_usd", F.when(F.col("budget_usd").isNotNull(), F.col("ts"))).alias("budget_usd"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def budget_gate(requests: DataFrame) -> DataFrame:
    """requests: session_id, artifact_id, seq, estimated_cost_usd, actual_cost_usd, artifact_budget_usd, session_budget_usd; an artifact belongs to one session.

    What a call may spend depends on the calls admitted before it, so each session is read in order: a blocked call spends
    nothing. Adds budget_reason, null where the call is admitted. The state is a sum per artifact and one for the session, so a
    session of any length is one pass over sorted rows.
    """

    def start():
        spent, by = 0.0, {}

        def step(x):
            nonlocal spent
            own, cost = by.get(x["artifact_id"], 0.0), x["estimated_cost_usd"]
            if None not in (cost, x["artifact_budget_usd"]) and own + cost > x["artifact_budget_usd"]:
                why = "ARTIFACT_BUDGET_EXCEEDED"
            elif None not in (cost, x["session_budget_usd"]) and spent + cost > x["session_budget_usd"]:
                why = "SESSION_BUDGET_EXCEEDED"
            else:
                why, actual = None, x["actual_cost_usd"] or 0.0
                spent, by[x["artifact_id"]] = spent + actual, own + actual
            return {"artifact_id": x["artifact_id"], "seq": x["seq"], "budget_reason": why}

        return step

    order = ["seq", "artifact_id", "estimated_cost_usd", "actual_cost_usd", "artifact_budget_usd", "session_budget_usd"]
    return folded(requests, order, start, "artifact_id string, seq long, budget_reason string")


def folded(requests: DataFrame, order: list[str], start, schema: str) -> DataFrame:
    """A row for each row of a session, read in order by a step that start() makes for each session: session_id and schema's columns.

    Rows are sorted on disk and streamed, so a session's length is no matter of memory.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    rows = requests.select("session_id", *order).repartition("session_id").sortWithinPartitions("session_id", *order)
    schema = f"session_id {requests.schema['session_id'].dataType.simpleString()}, {schema}"

    def run(batches):
        own, step, kinds = None, None, None
        for batch in batches:
            if kinds is None:
                kinds = pa.schema([pa.field("session_id", batch.schema.field("session_id").type), *(pa.field(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in schema.split(", ")[1:]))])
            out = []
            for x in batch.to_pylist():
                if step is None or x["session_id"] != own:
                    own, step = x["session_id"], start()
                out.append({"session_id": own, **step(x)})
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.mapInArrow(run, schema).select("session_id", *names)


# Reservations


def reservations(requests: DataFrame, ttl: int = TTL) -> DataFrame:
    """requests: session_id, reservation_id, ts (seconds), estimated_cost_usd, session_budget_usd, outcome (committed, released, or null), actual_cost_usd.

    A request is granted if measured spend, what stands reserved and the estimate fit the budget (null: no limit). A granted
    one is committed or released at once, or stands until it expires. Folded per session in order of time; the state holds
    the session's spend and what stands only. Per request: granted and status.
    """
    rows = requests.select("session_id", "ts", "reservation_id", F.col("estimated_cost_usd").alias("est"), F.col("session_budget_usd").alias("budget"), "outcome", F.coalesce("actual_cost_usd", "estimated_cost_usd").alias("actual"))
    unit = 1 << 1074  # every double is a whole number of these, so that what stands is summed exactly and can be taken off again

    def start():
        spent, reserved, held = 0.0, 0, deque()

        def step(x):
            nonlocal spent, reserved
            while held and (x["ts"] is None or held[0][0] <= x["ts"]):
                reserved -= held.popleft()[1]
            est, outcome = x["est"], x["outcome"]
            ok = est is None or x["budget"] is None or spent + reserved / unit + est <= x["budget"]
            if ok and outcome is None and x["ts"] is not None:
                top, bottom = (est or 0.0).as_integer_ratio()
                held.append((x["ts"] + ttl, top * (unit // bottom)))
                reserved += held[-1][1]
            if ok and outcome == "committed":
                spent += x["actual"] or 0.0
            return {"reservation_id": x["reservation_id"], "granted": ok, "status": (outcome or "active") if ok else "rejected"}

        return step

    return folded(rows, ["ts", "reservation_id", "est", "budget", "outcome", "actual"], start, "reservation_id string, granted boolean, status string")


def expired(reserved: DataFrame, as_of: Column) -> DataFrame:
    """reserved: status, expires_at. Those that still stand but are over get the status expired."""
    return reserved.withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_at") <= as_of), "expired").otherwise(F.col("status")))


def transitions(log: DataFrame) -> DataFrame:
    """log: reservation_id, seq, status. Adds legal: only an active reservation is committed, released or expired, and only a new one is active."""
    before = F.lag("status").over(Window.partitionBy("reservation_id").orderBy("seq"))
    return log.withColumn("legal", F.when(F.col("status") == "active", before.isNull()).otherwise(F.coalesce(before == "active", F.lit(False))))


def states(log: DataFrame) -> DataFrame:
    """Each reservation's status after its last legal transition."""
    return transitions(log).where("legal").groupBy("reservation_id").agg(F.max_by("status", "seq").alias("status"))


def guarded(envelopes: DataFrame, responses: DataFrame, requests: DataFrame, **how) -> DataFrame:
    """Admission, reservation, recorded response, audit: the ledger of all calls. A call whose reservation is refused has no audit."""
    a = tables.stored(admission(envelopes, **how).drop("payload"), "admitted")
    granted = reservations(requests).where("granted").select("session_id", F.col("reservation_id").alias("artifact_id"))
    done = completions(a, responses.join(granted, ["session_id", "artifact_id"], "left_semi"))
    first = ledger_events(a)
    return first.unionByName(done)


# Prices


def model_rate(model: Column, prices=PRICES) -> Column:
    """A struct (input, output), US$ per token, of the first prefix that fits, else the default."""
    rate = lambda i, o: F.struct(F.lit(i / 1e6).alias("input"), F.lit(o / 1e6).alias("output"))
    out = rate(*DEFAULT_PRICE)
    for prefix, i, o in reversed(prices):
        out = F.when(F.startswith(model, F.lit(prefix)), rate(i, o)).otherwise(out)
    return out


def cost_usd(model: Column, input_: Column, output: Column, cache_read: Column, cache_write: Column, prices=PRICES) -> Column:
    rate = model_rate(F.coalesce(model, F.lit("")), prices)
    return input_ * rate["input"] + output * rate["output"] + cache_read * rate["input"] * CACHE_READ + cache_write * rate["input"] * CACHE_WRITE


def provider_cost(input_: Column, output: Column, cache_write: Column, cache_read: Column, rates: tuple[float, float, float, float]) -> Column:
    """A struct (input_tokens, cost_usd) as a provider bills it: rates are US$ per million in, out, cache write and read; cached tokens count as input."""
    cost = (input_ * rates[0] + output * rates[1] + cache_write * rates[2] + cache_read * rates[3]) / 1_000_000
    return F.struct((input_ + cache_write + cache_read).cast("long").alias("input_tokens"), cost.alias("cost_usd"))
