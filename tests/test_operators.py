import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quillmeter.functions import text as T
from quillmeter.operators import chunking, finops, governance, headroom, offers, packing, retrieval, scenarios, structure
from quillmeter.plans.queries import QUERIES
from quillmeter.schemas import ENVELOPE


def plan(spark, budget, lanes):
    row = spark.range(1).select(headroom.plan_lanes(F.lit(budget), lanes).alias("p")).first()
    return {x.lane: (x.tokens, x.clamped) for x in row.p}


def test_lane_goldens(spark):
    assert {k: v[0] for k, v in plan(spark, 10000, [("a", 1.0, 0, None, 0), ("b", 3.0, 0, None, 0)]).items()} == {"a": 2500, "b": 7500}
    assert plan(spark, 10000, [("capped", 3.0, 0, 1000, 0), ("open", 1.0, 0, None, 0)]) == {"capped": (1000, "maximum"), "open": (9000, None)}
    got = plan(spark, 10000, [("low", 1.0, 8000, None, 0), ("high", 1.0, 8000, None, 5)])
    assert got["low"] == (0, "dropped") and got["high"][0] == 10000
    assert sum(v[0] for v in plan(spark, 1000, [("a", 1.0, 0, 100, 0), ("b", 1.0, 0, 100, 0)]).values()) == 200


def test_pressure(spark):
    d = spark.createDataFrame([("s", "a", 0), ("t", "a", 5880), ("u", "a", 7840), ("v", "a", 9400)], "session_id string, lane string, tokens long")
    got = {r.session_id: r.pressure for r in headroom.session_headroom(d, 10000, 0).collect()}
    assert got == {"s": "cool", "t": "warm", "u": "hot", "v": "critical"}


def model_windows(costs, most, overlap):
    out, cur = [], 0
    while True:
        end, used = cur + 1, costs[cur]
        while end < len(costs) and used + costs[end] <= most:
            used, end = used + costs[end], end + 1
        out.append((cur, end))
        if end >= len(costs):
            return out
        cur = max(end - overlap, cur + 1)


def test_windows_against_a_model(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([1, 2, 5, 20, 70]) for _ in range(rng.randint(1, 40))]) for k in range(200)]
    got = {k: chunking.line_windows(c, 64, 4) for k, c in rows}
    assert all(got[k] == model_windows(c, 64, 4) for k, c in rows)


SOURCE = "X = 1\n\nclass A:\n    def f(self):\n        return 1\n\n\ndef big():\n" + "".join(f"    x{i} = {i} + {i}\n" for i in range(400))


def test_structure(spark):
    s = spark.createDataFrame([("m.py", SOURCE), ("t.ts", "export class B {\n  go(x: number) {\n    return '}';\n  }\n}\n"), ("bad.py", "def ("), ("e.py", "  \n")], "path string, text string")
    symbols = structure.extract_symbols(s)
    names = {(r.path, r.qualname, r.kind, r.start, r.end) for r in symbols.collect()}
    assert {("m.py", "X", "const", 1, 1), ("m.py", "A", "class", 3, 5), ("m.py", "A.f", "method", 4, 5), ("t.ts", "B", "class", 1, 5), ("t.ts", "B.go", "method", 2, 4)} <= names
    chunks = structure.structure_chunks(s, most=200)
    got = chunks.collect()
    assert not structure.unquoted(chunks, s).collect() and len({c.id for c in got}) == len(got)
    big = [c for c in got if c.symbol == "big"]
    assert len(big) > 1 and all(c.path != "e.py" for c in got) and any(c.path == "bad.py" and c.kind == "window" for c in got)
    chosen = spark.createDataFrame([("m.py", "f"), ("m.py", "A.f"), ("m.py", "nope")], "path string, selector string")
    assert {(r.selector, r.qualname) for r in structure.find_symbol(symbols, chosen).collect()} == {("f", "A.f"), ("A.f", "A.f")}
    text = {r.path: r.skeleton for r in structure.skeletons(s, symbols).collect()}
    assert "class A:" in text["m.py"] and "... 1 lines (4-5)" in text["m.py"] and text["bad.py"] == ""


def test_search_prefers_the_right_function(spark):
    rows = [("a", "auth.py", "refresh_token", "def refresh_token(session): return renew the access token"), ("b", "bill.py", "invoice_pdf", "def invoice_pdf(order): render the invoice as pdf"), ("c", "ship.py", "shipping_cost", "def shipping_cost(weight): price of the parcel")]
    chunks = spark.createDataFrame(rows, "id string, path string, symbol string, text string")
    queries = spark.createDataFrame([(1, "refresh the access token"), (2, "invoicePdf"), (3, "the of")], "query_id int, text string")
    got = {(r.query_id, r.rank): r.id for r in retrieval.lexical_search(queries, chunks, 3).collect()}
    assert got[1, 1] == "a" and got[2, 1] == "b" and not any(q == 3 for q, _ in got)


def test_whole_queries_search_every_term(spark):
    sf = "/root/testdata/sf0.001"
    bag = lambda table, key: {r[0]: list(r[1]) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key, T.terms(F.col("text"))).collect()}
    held, asked = bag("documents", "doc_id"), bag("benchmark", "item_id")
    assert any(len(t) > 8 for t in asked.values())
    mean, df = sum(max(len(t), 1) for t in held.values()) / len(held), Counter(x for t in held.values() for x in set(t))
    want = {}
    for q, words in asked.items():
        scores = Counter()
        for i, t in held.items():
            tf = Counter(t)
            for x in set(words) & set(tf):
                idf = max(0.0, math.log(1 + (len(held) - df[x] + 0.5) / (df[x] + 0.5)))
                scores[i] += math.floor(idf * tf[x] * 2.5 / (tf[x] + 1.5 * (0.25 + 0.75 * len(t) / mean)) * 1e9)
        want |= {(q, k + 1): (i, n / 1000) for k, (i, n) in enumerate(sorted(((i, n) for i, n in scores.items() if n > 0), key=lambda x: (-x[1], x[0]))[:10])}
    got = {(r.query_id, r.rank): (r.id, r.score) for r in QUERIES["r4_bm25_topk"](spark, sf).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) <= 1.001 for k in want)


def test_whole_decision_history(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["f13_decision_history"](spark, sf).collect()
    events = {(str(r.user_id), str(r.event_id), r.event_type) for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    assert {tuple(r) for r in got} == events and len(got) == len(events) and len({r.artifact_id for r in got}) > 1


def test_packs_find_late_terms(spark, tmp_path):
    spark.createDataFrame([(1, "a zebra walks", "s"), (2, "nothing here", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "alpha bravo charlie delta echo foxtrot golf hotel india juliet zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("p5_section_cap", "p3_pack"):
        assert [(r.query_id, r.sections) for r in QUERIES[name](spark, str(tmp_path)).collect()] == [(7, 1)]
    assert [r.id for r in QUERIES["r5_stored_search"](spark, str(tmp_path)).collect()] == [1]
    assert [(r.band, r.sections) for r in QUERIES["p9_pack_query_under_pressure"](spark, str(tmp_path)).orderBy("band").collect()] == [("cool", 1), ("hot", 1)]


def hit(id_, path, i, j, cost, score, symbol="", text="x"):
    return (1, id_, path, i, j, cost, symbol, "window", "", text, score)


def test_packing(spark):
    schema = "query_id int, id string, path string, start int, end int, tokens long, symbol string, kind string, signature string, text string, score double"
    rows = [hit("big", "a", 1, 100, 1200, 9.0), hit("s1", "b", 1, 10, 150, 4.0), hit("s2", "b", 2, 10, 150, 3.9), hit("s3", "b", 10, 30, 150, 3.8)]
    for budget in (100, 500, 2000, 10000):
        p = packing.pack_hits(spark.createDataFrame(rows, schema), budget).first()
        assert p.used <= budget and len(p.sections) + len(p.dropped) == 4
    kept = {s.id for s in p.sections}
    assert kept == {"big", "s1", "s3"} and [s.path for s in p.sections] == ["a", "b", "b"] and "covered" in p.dropped[0].reason
    tight = packing.pack_hits(spark.createDataFrame([hit("f", "c", 1, 9, 500, 5.0, "run")], schema), 150, "critical").first()
    assert tight.sections[0].kind == "stub"


def test_offers_are_claimed_once_and_in_time(spark):
    e = spark.createDataFrame([(1, 1000, "suggested", "p", 5000, 0), (2, 1100, "read", "p", 0, 600), (3, 1200, "read", "p", 0, 600), (4, 2000, "suggested", "q", 10, 0), (5, 5600, "read", "q", 0, 1), (6, 100, "suggested", "r", 10, 0), (7, 200, "read", "r", 0, 50)], "id long, ts long, kind string, path string, tokens_full long, tokens_served long")
    assert {(r.path, r.read_id, r.saved) for r in offers.claims(e).collect()} == {("p", 2, 4400), ("r", 7, 0)}
    ledger = offers.settled(e)
    assert {r.path for r in offers.pending(ledger, 2100).collect()} == {"q"}
    s = offers.summary(ledger).first()
    assert (s.offers, s.accepted, s.tokens_saved) == (3, 2, 4360)


def test_scores_and_tiers(spark):
    f = spark.createDataFrame([(0, 0, 0.0, 0.0, 0, 0), (5000, 12, 1.0, 1.0, 5, 8), (-1, 0, 0.0, 0.0, 0, 0)], ", ".join(f"{n} {'double' if 'density' in n else 'int'}" for n in governance.FEATURES))
    got = governance.scored(f).collect()
    assert [(r.score, r.tier) for r in got[:2]] == [(0.0, "solar"), (100.0, "aurora")] and got[2].tier is None
    edges = spark.createDataFrame([(x,) for x in (15.0, 15.01, 30.0, 30.01, 60.0, 60.01, 80.0, 80.01)], "s double")
    assert [r.t for r in edges.select(governance.tier_for_score(F.col("s")).alias("t")).collect()] == ["solar", "daylight", "daylight", "horizon", "twilight", "starlight", "starlight", "aurora"]


def test_admission(spark):
    words = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, " "))).cast("long")
    halve = lambda p, cap: F.array_join(F.slice(F.split(p, " "), 1, F.greatest(F.lit(1), F.floor(F.size(F.split(p, " ")) / 2).cast("int"))), " ")
    rows = [("s", "p", "ok", "a b c d e f g h", 8, 10.0, "t", "x", "m", 0.1), ("s", "p", "unscored", "a", 1, None, "t", "x", "m", 0.1), ("s", "p", "untiered", "a", 1, 1.0, "none", "x", "m", 0.1), ("s", "p", "long", " ".join("x" * 40), 40, 1.0, "t", "x", "m", 0.1)]
    e = spark.createDataFrame(rows, ENVELOPE.split(", artifact_budget_usd")[0])
    tiers = spark.createDataFrame([("t", 4, 2, 2)], "tier string, input_token_cap long, output_token_cap long, max_attempts int")
    a = governance.admission(e, tiers, halve, words)
    got = {r.artifact_id: r for r in a.collect()}
    assert (got["ok"].admitted, got["ok"].attempt, got["ok"].rejected, got["ok"].decision) == (4, 1, 4, "admitted")
    assert [x.decision for x in got["ok"].events] == ["recompress", "admitted"]
    assert got["unscored"].reason == "MISSING_SCORE" and got["untiered"].reason == "INVALID_TIER" and got["long"].reason == "RECOMPRESSION_EXHAUSTED"
    done = governance.completions(a, spark.createDataFrame([("s", "ok", 3, 0.5, "pass")], "session_id string, artifact_id string, output_tokens long, actual_cost_usd double, quality_status string")).first()
    assert (done.decision, done.evidence_basis, done.tokens_rejected) == ("violated", "estimated", 1)


def test_budgets_and_reservations(spark):
    r = spark.createDataFrame([("s", "a", 1, 0.6, 0.6, 1.0, None), ("s", "a", 2, 0.5, 0.5, 1.0, None), ("s", "b", 3, 0.5, 0.5, None, 1.0), ("s", "b", 4, 0.4, 0.4, None, 1.0)], "session_id string, artifact_id string, seq long, estimated_cost_usd double, actual_cost_usd double, artifact_budget_usd double, session_budget_usd double")
    got = {x.seq: x.budget_reason for x in governance.budget_gate(r).collect()}
    assert got == {1: None, 2: "ARTIFACT_BUDGET_EXCEEDED", 3: "SESSION_BUDGET_EXCEEDED", 4: None}
    q = spark.createDataFrame([("s", "1", 0, 6.0, 10.0, None, None), ("s", "2", 1, 6.0, 10.0, None, None), ("s", "3", 400, 6.0, 10.0, "committed", 6.0), ("s", "4", 401, 6.0, 10.0, None, None)], "session_id string, reservation_id string, ts long, estimated_cost_usd double, session_budget_usd double, outcome string, actual_cost_usd double")
    assert {x.reservation_id: x.status for x in governance.reservations(q).collect()} == {"1": "active", "2": "rejected", "3": "committed", "4": "rejected"}


def test_provider_cost(spark):
    c = governance.provider_cost(F.lit(100), F.lit(20), F.lit(10), F.lit(5), (3.0, 15.0, 3.75, 0.3))
    r = spark.range(1).select(c.alias("c")).first().c
    assert r.input_tokens == 115 and abs(r.cost_usd - (300 + 300 + 37.5 + 1.5) / 1e6) < 1e-15


def test_changes_between(spark):
    rows = [("c%d" % k, k, "a", f"1.{k}") for k in range(4)]
    c = spark.createDataFrame(rows, "change_id string, occurred_at int, artifact_id string, to_version string")
    span = lambda a, b: spark.createDataFrame([("a", a, b)], "artifact_id string, from_version string, to_version string")
    got = lambda a, b: [r.to_version for r in finops.changes_between(c, span(a, b)).orderBy("occurred_at").collect()]
    assert got("1.0", "1.2") == ["1.1", "1.2"] and got("x", "1.1") == ["1.0", "1.1"] and got("1.2", "x") == ["1.3"]


def test_scenarios(spark):
    got = scenarios.replay(spark).collect()
    caps = {t[0]: t[1] for t in scenarios.CAPS}
    assert len(got) == 7 and all(r.admitted <= caps[r.tier] and (r.saved_usd is not None) == (r.decision == "admitted" and r.rejected > 0) for r in got)
