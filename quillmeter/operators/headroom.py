"""A context window's budget: what is used, how tight it is, and how the rest is shared between lanes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LANES, PRESSURE


def effective(window: Column | int, reserve_output: Column | int = 8000, reserve_system: Column | int = 0, margin: Column | float = 0.02) -> Column:
    """Tokens left for content after reserves and the safety margin."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    gross = of(window) - F.greatest(of(reserve_output), F.lit(0)) - F.greatest(of(reserve_system), F.lit(0))
    return F.greatest((gross * (F.lit(1.0) - of(margin))).cast("long"), F.lit(0).cast("long"))


def ratio(used: Column, of: Column) -> Column:
    return F.when(of == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), used / F.nullif(of, F.lit(0))))


def pressure(share: Column) -> Column:
    out = F.lit(PRESSURE[-1][0])
    for name, top, *_ in reversed(PRESSURE[:-1]):
        out = F.when(share < top, name).otherwise(out)
    return out


def policy(band: Column) -> Column:
    """A struct (detail, slice_mode, semantic_k, elide_bodies); an unknown band gets the strictest."""
    make = lambda p: F.struct(F.lit(p[2]).alias("detail"), F.lit(p[3]).alias("slice_mode"), F.lit(p[4]).alias("semantic_k"), F.lit(p[5]).alias("elide_bodies"))
    out = make(PRESSURE[-1])
    for p in PRESSURE[:-1]:
        out = F.when(band == p[0], make(p)).otherwise(out)
    return out


def session_headroom(spends: DataFrame, window: int = 200_000, reserve_output: int = 8000, reserve_system: int = 0, margin: float = 0.02) -> DataFrame:
    """spends: session_id, lane, tokens. Per session: lanes (array, largest first), effective, used, available, ratio, pressure and its policy.

    Spends are summed per session and lane first, so a hot session arrives as one row per lane and task.
    """
    if window <= 0 or not 0 <= margin < 1:
        raise ValueError("window must be positive and margin in [0, 1)")
    refused = F.when(F.col("tokens") < 0, F.raise_error(F.lit("tokens must not be negative"))).otherwise(F.col("tokens"))
    lanes = spends.groupBy("session_id", "lane").agg(F.sum(refused).cast("long").alias("tokens"))
    s = lanes.groupBy("session_id").agg(F.sum("tokens").cast("long").alias("used"), F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("less"), "lane"))).alias("lanes"))
    s = s.withColumn("lanes", F.transform("lanes", lambda x: F.struct(x["lane"].alias("lane"), (-x["less"]).alias("tokens"))))
    s = s.withColumn("effective", effective(window, reserve_output, reserve_system, margin))
    s = s.withColumn("available", F.greatest(F.col("effective") - F.col("used"), F.lit(0))).withColumn("ratio", ratio(F.col("used"), F.col("effective")))
    s = s.withColumn("pressure", pressure(F.col("ratio")))
    return s.select("*", policy(F.col("pressure")).alias("policy"))


def running_spend(spends: DataFrame) -> DataFrame:
    """spends: session_id, lane, seq, tokens. Adds what its lane has spent so far, this row with it."""
    return spends.withColumn("spent", F.sum("tokens").over(Window.partitionBy("session_id", "lane").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def released(spends: DataFrame, lane: str) -> DataFrame:
    return spends.where(F.col("lane") != lane)


def fits(tokens: Column, available: Column) -> Column:
    return tokens <= available


def gauge(share: Column, width: int = 40) -> Column:
    full = F.bround(share * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full), F.lit("]"))


def plan_lanes(budget: Column, lanes: Sequence[tuple] = LANES) -> Column:
    """budget shared between lanes (name, weight, minimum, maximum, priority): an array of (lane, tokens, weight, clamped) in their order.

    Floors are paid by priority, and a lane whose floor doesn't fit is dropped. What is left goes out by weight, whole tokens
    first, then one each to the largest fractions; a full lane gives back, and rounds go on until nothing moves. Every further
    round fills a lane or empties the pool, so there are no more rounds than lanes, and one.
    """
    order = sorted(range(len(lanes)), key=lambda k: (-lanes[k][4], -lanes[k][1], lanes[k][0]))
    top = (1 << 62) - 1
    sorted_lanes = F.array(*(F.struct(F.lit(k).alias("at"), F.lit(float(lanes[k][1])).alias("weight"), F.lit(min(lanes[k][2], lanes[k][3]) if lanes[k][3] is not None else lanes[k][2]).cast("long").alias("floor"), F.lit(top if lanes[k][3] is None else lanes[k][3]).cast("long").alias("top")) for k in order))
    lane = "struct<at:int,weight:double,top:bigint,tokens:bigint,state:string>"
    state = f"struct<pool:bigint,lanes:array<{lane}>>"

    def pay(acc, x):
        short = x["floor"] > acc["pool"]
        new = F.struct(x["at"], x["weight"], x["top"], F.when(short, F.lit(0)).otherwise(x["floor"]), F.when(short, F.lit("dropped")))
        return F.struct(F.when(short, acc["pool"]).otherwise(acc["pool"] - x["floor"]), F.concat(acc["lanes"], F.array(new).cast(f"array<{lane}>"))).cast(state)

    start = F.struct(F.greatest(budget.cast("long"), F.lit(0).cast("long")), F.array().cast(f"array<{lane}>")).cast(state)
    open_ = lambda x: (F.coalesce(x["state"], F.lit("")) != "dropped") & (x["tokens"] < x["top"])
    bind = lambda value, use: F.transform(F.array(value), use)[0]

    def share(acc, _):
        total = F.aggregate(acc["lanes"], F.lit(0.0), lambda a, x: a + F.when(open_(x) & (x["weight"] > 0), x["weight"]).otherwise(0.0))

        def with_total(total):
            exact = F.transform(acc["lanes"], lambda x, i: F.struct(i.alias("i"), F.when(open_(x), acc["pool"] * (x["weight"] / total)).otherwise(0.0).alias("exact"), open_(x).alias("open")))

            def with_exact(exact):
                whole = F.transform(exact, lambda x: F.floor(x["exact"]))
                rest = acc["pool"] - F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a + x)
                rank = F.transform(F.array_sort(F.transform(F.filter(exact, lambda x: x["open"]), lambda x: F.struct((-(x["exact"] - F.floor(x["exact"]))).alias("f"), x["i"].alias("i")))), lambda x: x["i"])

                def with_rank(rank):
                    def grant(x, i):
                        place = F.array_position(rank, i)
                        due = F.when(exact[i]["open"], whole[i] + F.when((place > 0) & (place <= rest), 1).otherwise(0)).otherwise(0)
                        over = x["tokens"] + due > x["top"]
                        return F.struct(x["at"], x["weight"], x["top"], F.when(over, x["top"]).otherwise(x["tokens"] + due), F.when(over & (due > 0), F.lit("maximum")).otherwise(x["state"])).cast(lane)

                    new = F.transform(acc["lanes"], grant)
                    given = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
                    return bind(new, lambda new: F.struct(acc["pool"] - given(new) + given(acc["lanes"]), new).cast(state))

                return bind(rank, with_rank)

            return F.when((acc["pool"] > 0) & (total > 0), bind(exact, with_exact)).otherwise(acc)

        return bind(total, with_total)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(len(lanes))), F.aggregate(sorted_lanes, start, pay), share)

    def at_place(k):
        return lambda x: x["at"] == k

    def final(done):
        out = []
        for k, (name, weight, minimum, *_) in enumerate(lanes):
            own = F.filter(done["lanes"], at_place(k))[0]
            clamp = F.when(own["state"].isNull() & F.lit(bool(minimum)) & (own["tokens"] == minimum), F.lit("minimum")).otherwise(own["state"])
            out.append(F.struct(F.lit(name).alias("lane"), own["tokens"].alias("tokens"), F.lit(float(weight)).alias("weight"), clamp.alias("clamped")))
        return F.array(*out)

    return bind(done, final)
