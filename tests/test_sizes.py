"""Odd inputs and large ones: results as the SQL has them, work that grows no faster than the input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmeter.operators import structure
from quillmeter.plans import queries as plans

JSON = ("", " ", "1", "1 2", "4703443633947811 and words", '{"a":1} x', "[1,2] ]", '{"a":1,"a":2}', "[1,]", "[,]", "{,}", "NaN", "-inf", "01", "1.", "+1", '"\\ud800"', '"\\ud83d\\ude00"', '"a\nb"', "[" * 1200 + "]" * 1200, "1" * 2000, "nullx", "﻿{}", "/*c*/1")


def test_json_gate_reads_whole_texts(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate((*JSON, None))]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows, "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for name in ("documents", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = plans.QUERIES["a12_json_gate"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(plans.SQL["a12_json_gate"]).fetchall())
    assert [structure.is_json(x) for x in JSON] == [con.execute("SELECT json_valid(?::VARCHAR)", [x]).fetchone()[0] for x in JSON]



@pytest.fixture(scope="module")
def index(spark):
    from quillmeter.operators import retrieval

    words = F.array(*(F.concat(F.lit(w), ((F.col("id") * k) % m).cast("string")) for w, k, m in (("ant", 7, 5), ("bee", 3, 11), ("cat", 11, 23), ("dog", 1, 40))))
    chunks = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.array_join(F.concat(words, F.slice(words, 1, (F.col("id") % 4 + 1).cast("int"))), " ").alias("text"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.explode(F.array(*(F.concat(F.lit(w), (F.col("id") % m).cast("string")) for w, m in (("ant", 5), ("bee", 11), ("cat", 23), ("eel", 3))))).alias("term"))
    return retrieval.Index(chunks), asked


def test_search_never_makes_pairs(spark, index):
    """Queries and chunks met as rows before; now a task gives its best only."""
    from quillmeter.operators import retrieval

    held, asked = index
    scan = retrieval._scan(asked, held.held, held.size)
    made = []
    run = scan.run
    scan.run = lambda fold, more: made.append(run(fold, more)) or made[-1]
    got = sorted(map(tuple, scan.best(5).collect()))
    want = sorted(map(tuple, retrieval.top(retrieval.bm25(asked, retrieval.exploded(held.held), size=held.size), 5).select("query_id", "id", "score", "rank").collect()))
    assert got == want and len(got) == 250
    pairs = retrieval.bm25(asked, retrieval.exploded(held.held), size=held.size).count()
    assert made[0].count() <= 250 * held.held.rdd.getNumPartitions() and pairs > 10 * 250


def test_search_for_more_queries_than_one_place_holds(spark, index, monkeypatch):
    from quillmeter.operators import retrieval

    held, asked = index
    want = sorted(map(tuple, retrieval.best(asked, held.held, held.size, 7).collect()))
    pairs = retrieval.bm25(asked, retrieval.exploded(held.held), size=held.size)
    hits = sorted(map(tuple, pairs.groupBy("query_id").agg(F.count("*"), F.max("score")).collect()))
    assert sorted(map(tuple, retrieval.hits(asked, held.held, held.size).collect())) == hits
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 3)
    assert sorted(map(tuple, retrieval.best(asked, held.held, held.size, 7).select("query_id", "id", "score", "rank").collect())) == want
    assert sorted(map(tuple, retrieval.hits(asked, held.held, held.size).collect())) == hits


def test_terms_are_counted_by_lines():
    from collections import Counter

    from quillmeter.functions.text import TermCounter

    lines = ["getUserToken 9lives42 the", "", "snake_case x1 getUserToken", "ä ABCd"] * 3
    whole = Counter(t for x in lines for w in TermCounter().word.findall(x) for t in TermCounter().expand(w))
    small = TermCounter(most=2, lines=1, terms_=3)
    assert small.count("\n".join(lines)) == whole == TermCounter().count("\n".join(lines)) and len(small.known) <= 2 and len(small.lines) <= 1


def planned(df, mark):
    """How often mark stands in the optimized plan: each time it is computed anew."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(mark)


@pytest.fixture(scope="module")
def calls(spark):
    from quillmeter.schemas import ENVELOPE

    rows = [("s", "p", "long", "abc def " * 9000, 0, 10.0, "daylight", "x", "m", 0.1), ("s", "p", "short", "abc", 0, 10.0, "daylight", "x", "m", 0.1), ("s", "p", "none", "abc", 0, None, "daylight", "x", "m", 0.1)]
    return spark.createDataFrame(rows, ENVELOPE.split(", artifact_budget_usd")[0])


def marked(payload, cap):
    return F.substring(F.replace(payload, F.lit("compressor's mark"), F.lit("")), F.lit(1), (cap * 4).cast("int"))


@pytest.mark.parametrize("gate, rows", [("compression", {("recompress", "long")}), ("admission", {("admitted", "long"), ("admitted", "short"), ("blocked", "none")})])
def test_admission_is_folded_once_for_its_events(spark, calls, gate, rows):
    from quillmeter.operators import governance

    e = governance.ledger_events(governance.admission(calls, compressor=marked)).where(F.col("gate") == gate)
    assert planned(e, "compressor's mark") == 1
    assert {(r.decision, r.artifact_id) for r in e.collect()} == rows


def test_admission_is_folded_once_for_guarded_calls(spark, calls):
    from quillmeter.operators import governance

    assert planned(governance.admission(calls, compressor=marked).where("decision = 'admitted'"), "compressor's mark") == 1
    answers = spark.createDataFrame([("s", x, 3, 0.5, "pass") for x in ("long", "short", "none")], "session_id string, artifact_id string, output_tokens long, actual_cost_usd double, quality_status string")
    asked = spark.createDataFrame([("s", "long", 1, 1.0, 10.0, "released", None), ("s", "short", 2, 1.0, 0.0, "released", None)], "session_id string, reservation_id string, ts long, estimated_cost_usd double, session_budget_usd double, outcome string, actual_cost_usd double")
    g = governance.guarded(calls, answers, asked, compressor=marked)
    assert planned(g, "compressor's mark") == 0
    assert sorted((r.artifact_id, r.decision) for r in g.collect()) == [("long", "admitted"), ("long", "completed"), ("long", "recompress"), ("none", "blocked"), ("short", "admitted")]


def test_structure_rows_come_in_small_batches(spark):
    import pyarrow as pa

    text = "\n".join(f"# h{k}\n" + "word " * 60 for k in range(200))
    batch = pa.record_batch({"path": [f"p{k}" for k in range(400)], "text": [text] * 400})
    kind = pa.schema([("path", pa.string()), ("text", pa.string())])
    out = list(structure._made([batch, batch.slice(0, 0)], lambda r: [{"path": r[0], "text": r[1]}] * 3, kind))
    assert sum(x.num_rows for x in out) == 1200 and max(x.nbytes for x in out) < 6_000_000 and len(out) > 10


def test_windows_of_large_declarations_quote_their_lines(spark):
    body = "\n".join(f"    x{k} = {k}" for k in range(300))
    s = spark.createDataFrame([("m.py", f"import os\n\n\ndef big():\n{body}\n", "python"), ("n.md", "# T\n" + "\n".join(f"line {k} of some words" for k in range(200)), "markdown")], "path string, text string, language string")
    c = structure.structure_chunks(s, most=100)
    assert structure.unquoted(c, s).count() == 0 and c.where("symbol = 'big'").count() > 3 and c.where("path = 'n.md'").count() > 3


def trimmed(text, budget, keep, price):
    """Whole lines of text under a budget, plainly: (kept lines, their text)."""
    lines, body = text.split("\n"), max(1, budget - 48)

    def fit(some, most):
        n = used = 0
        for x in some:
            if used + price[x] + 1 > most:
                break
            used, n = used + price[x] + 1, n + 1
        return n

    if keep != "both":
        n = fit(lines if keep == "head" else lines[::-1], body)
        return n, "\n".join(lines[:n] if keep == "head" else lines[len(lines) - n :])
    half = max(1, body // 2)
    tail = fit(lines[::-1], body - half)
    head = min(fit(lines, half), len(lines) - tail)
    return head + tail, "\n".join([*lines[:head], f"... {len(lines) - tail - head} lines elided ...", *lines[len(lines) - tail :]])


@pytest.mark.parametrize("keep, prices", [("both", 4), ("tail", 3), ("head", 3)])
def test_trimming_prices_few_lines_once(spark, keep, prices):
    """A price is that of the whole, of a line (for both ends two) and of what is left: each line was priced for every use of a count before."""
    import random

    from quillmeter.functions import tokens

    rng = random.Random(5)
    line = lambda: rng.choice(["", "a", "{};()=>" * rng.randint(1, 9), "# t", "\x1b[3\x1b[0m1mred", "word " * rng.randint(1, 40), "x" * 300, "[1, 2]"])
    texts = ["\n".join(line() for _ in range(n)) for n in (1, 2, 5, 30, 200, 900) for _ in range(6)] + ["\n" * 1000, "y" * 5000, ""]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string")
    clean = {r.k: r.c for r in df.select("k", tokens.stripped(F.col("text")).alias("c")).collect()}
    parts = sorted({x for c in clean.values() for x in c.split("\n")})
    price = {r.x: r.n for r in spark.createDataFrame([(x,) for x in parts], "x string").select("x", tokens.estimate_tokens(F.col("x")).alias("n")).collect()}
    for budget in (10, 60, 200):
        cut = df.select("k", tokens.trim_to_budget(F.col("text"), budget, keep).alias("r"))
        for r in cut.where("r.truncated").collect():
            n, body = trimmed(clean[r.k], budget, keep, price)
            assert r.r.kept_lines == n and body == (r.r.text.partition("\n")[2] if keep == "tail" else r.r.text.rpartition("\n")[0])
    assert planned(cut, tokens.MARKDOWN) == prices


def test_only_the_longest_section_is_read(spark):
    from quillmeter.operators import finops

    rows = [("a", "x", 1, 20), ("a", "y", 30, 60), ("a", "z", 70, 100), ("b", "s", 1, 8), ("c", "t", 5, 14), ("c", "u", 5, 14)]
    got = finops.longest(spark.createDataFrame(rows, "path string, qualname string, start int, end int")).collect()
    assert sorted(map(tuple, got)) == [("a", "y", 30, 60), ("c", "u", 5, 14)]


def test_a_file_is_priced_once_for_narrow_reads(spark, tmp_path, monkeypatch):
    from quillmeter.plans import queries

    text = "\n".join(f"line {k} of this text" for k in range(400))
    spark.createDataFrame([(1, text, "s"), (2, text[:300], "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    read = []
    stored = queries.tables.stored
    monkeypatch.setattr(queries.tables, "stored", lambda df, name="table": read.append(stored(df, name)) or read[-1])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, plans.QUERIES["f18_narrow_reads"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(plans.SQL["f18_narrow_reads"]).fetchall()) and [x.count() for x in read] == [len(got)]


def test_scans_hold_few_terms_at_once():
    import pyarrow as pa

    from quillmeter.operators import retrieval

    lists = [["t"] * n for n in (0, 3, 250_000, 1, 60_000, 60_000, 0)]
    got = list(retrieval._slices([pa.record_batch({"id": list(range(7)), "terms": lists})], 1))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(7))
    assert all(b.num_rows == 1 or sum(map(len, b.column(1).to_pylist())) <= retrieval.POSTING_ROWS for b in got)


def test_words_are_remembered_up_to_a_limit():
    from quillmeter.functions.text import TermCounter

    counter = TermCounter()
    for k in range(0, 120_000, 100):
        counter.count("\n".join(f"w{k + j}" for j in range(100)))
    assert len(counter.known) <= 50_000 and len(counter.lines) <= 1_000


PACKED = (
    "p9_pack_query_under_pressure",
    "p11_budget_violations",
    "p8_manifest",
    "p3_pack",
    "p7_assembled",
    "p1_density_order",
    "p2_overlap_ratio",
    "p11_budget_adherence",
    "r11_search_suggestions",
    "p4_section_overhead",
    "p5_section_cap",
)


@pytest.mark.parametrize("name", PACKED)
def test_searches_shuffle_the_best_hits_only(spark, name):
    """All pairs of queries and chunks were shuffled before, more than so many at sf0.01; rows are the SQL's."""
    sf, seen = "/root/testdata/sf0.01", spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        none = spark._jvm.java.util.ArrayList()
        stages = seen.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    df = plans.QUERIES[name](spark, sf)
    names, got = sorted(df.columns), df.collect()
    assert got and shuffled() - before < 40_000
    if name in plans.SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(plans.SQL[name])
        have = [d[0] for d in want.description]
        assert sorted(repr(tuple(r[n] for n in names)) for r in got) == sorted(repr(tuple(r[have.index(n)] for n in names)) for r in want.fetchall())
