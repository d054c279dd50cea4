"""Cases beside the main tests: foreign archives, joins that can't broadcast, shortened prefixes, learned spans, clashing names."""

import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmeter.llm import common, decontaminate, jaccard, licenses, mixing, neighbours, pii, quality, sharding, token_counts, warc, wordhash


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# 1


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<p>hello</p>" * 50
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n%s\r\n" % (len(body[k : k + 100]), body[k : k + 100]) for k in range(0, len(body), 100)) + b"0\r\n\r\n"
    digest = warc.bare_digest(body)
    records = [
        ("warcinfo", "<urn:uuid:1>", "application/warc-fields", b"software: x\r\n", []),
        ("request", "<urn:uuid:2>", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", []),
        ("response", "<urn:uuid:3>", "application/http; msgtype=response", http, [f"WARC-Payload-Digest: sha1:{digest}"]),
        ("response", "<urn:uuid:4>", "application/http;msgtype=response", chunked, []),
        ("revisit", "<urn:uuid:5>", "application/http; msgtype=response", http[: -len(body)], [f"WARC-Payload-Digest: sha1:{digest}", "WARC-Refers-To: <urn:uuid:3>"]),
        ("resource", "<urn:uuid:6>", "text/plain", b"plain \xff", ["WARC-Block-Digest: sha1:x"]),
    ]
    data = b"".join("\r\n".join(["WARC/1.0", f"WARC-Type: {t}", f"WARC-Record-ID: {i}", f"Content-Type: {c}", *more, f"Content-Length: {len(b)}"]).encode() + b"\r\n\r\n" + b + b"\r\n\r\n" for t, i, c, b, more in records)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.warc.gz").write_bytes(squeeze.compress(data) + squeeze.flush())
    done = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string"))
    got = {r.record_id: r for r in warc.read_records(spark.createDataFrame(done.collect(), done.schema), range_bytes=200).collect()}
    assert {k: r.record_type for k, r in got.items()} == {f"urn:uuid:{k + 1}": t for k, (t, *_) in enumerate(records)}
    assert [(got[f"urn:uuid:{k}"].payload_bytes, got[f"urn:uuid:{k}"].payload_digest) for k in (3, 4)] == [(len(body), digest)] * 2
    assert (got["urn:uuid:5"].payload_digest, got["urn:uuid:5"].payload_bytes, got["urn:uuid:5"].refers_to) == (digest, None, "urn:uuid:3")
    assert got["urn:uuid:6"].payload_digest == warc.bare_digest(b"plain \xff")
    wrong = data.replace(body, body[:-1] + b"?", 1)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(wrong))
    done = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/b.warc.gz",)], "path string"))
    with pytest.raises(Exception, match="doesn't match"):
        warc.read_records(spark.createDataFrame(done.collect(), done.schema)).collect()


def test_ranges_begin_at_marks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MARK", 500)
    pages = spark.createDataFrame([(k, None, f"<p>{k}</p>" * 20) for k in range(60)], "page_id long, url string, html string")
    files = warc.write_archives(warc.marked_revisits(pages, "page_id", "html").coalesce(1), f"file://{tmp_path}")
    done = warc.normalise(spark.createDataFrame(files.collect(), files.schema)).collect()
    assert all(len(r.marks) > 5 for r in done)
    assert sorted(int(r.record_id) for r in warc.read_records(spark.createDataFrame(done), range_bytes=700).collect()) == list(range(60))


# 2, 4


def test_decontamination_shuffled(spark, no_broadcast):
    rng = random.Random(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[500:530])), (3, "short one"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long[99_000:99_025])), (2, " ".join(long[510:522])), (3, "Short one")], "item_id long, text string")
    shuffled = decontaminate.find_contamination(docs, bench, broadcast_grams=1)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in shuffled.collect()}
    assert got == {1: (100_000, 37, ["1", "2"]), 2: (30, 12, ["2"]), 3: (2, 2, ["3"]), 4: (0, 0, [])}
    assert "BroadcastHashJoin" not in plan(shuffled) and "SortMergeJoin" in plan(shuffled)


def test_licenses_shuffled(spark, no_broadcast):
    rows = [(1, "x. Released under the MIT License. " + "pad " * 30_000 + licenses.TEMPLATES["ISC-text"]), (2, None), (3, licenses.TEMPLATES["MIT-text"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan_licenses(df, broadcast_shingles=1)
    found = {r.doc_id: {m.template: m.start for m in r.matches} for r in got.collect()}
    assert found == {1: {"MIT": 1, "ISC-text": 30_006}, 2: {}, 3: {"MIT-text": 0, "MIT-permission": 0}}


def test_bands_meet_the_least_similar_window():
    for words in (33, 64, 65, 200):
        scale = 1 << (words - 1).bit_length()
        n = words - 4
        least = 0.8 * n / (2 * scale + 0.2 * n)
        assert 1 - (1 - least) ** licenses.bands_for(n, scale) >= 0.9999


# 3


def luhn(number):
    total = 0
    for k, d in enumerate(reversed(number)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_mistyped_cards_are_added_and_lookalikes_not(spark):
    rng = random.Random(4)

    def number(good):
        while True:
            n = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if luhn(n) == good:
                return n

    texts = []
    for k in range(200):
        texts += [f"pay by card {number(True)}, not card {number(False)}, no {k}", f"parcel {number(False)} of {k} was lost"]
    texts += [f"the card {number(False)}, they said", f"parcel {number(False)} came"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (len(r.base), [(pii.KINDS[s.kind], s.i) for s in r.spans if s.kind != pii.SECRET]) for r in pii.find_pii(df).collect()}
    near, like = len(texts) - 2, len(texts) - 1
    assert got[near] == (0, [("card", texts[near].index("4"))]) and got[like] == (0, [])
    assert all(got[k][0] == 1 and len(got[k][1]) == 2 for k in range(0, 400, 2)) and not any(got[k][1] for k in range(1, 400, 2))


def test_secrets(spark):
    rng = random.Random(6)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = []
    for k in range(120):
        texts += [f'set token = "{value(40)}" for {k}', f"die Donaudampfschifffahrtsgesellschaft {k} und andere", f"see the key: see page {k}", f"at /usr/share/documentation/{k} it is"]
    texts += ['token = "correcthorsebatterystaplecorrecthorsebat"', "Rechtsschutzversicherungsgesellschaften zahlen", "x" * 100_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(texts[r.doc_id][s.i : s.j], pii.KINDS[s.kind]) for s in r.spans if s.kind == pii.SECRET] for r in pii.find_pii(df).collect()}
    assert all(len(got[k]) == 1 and len(got[k][0][0]) == 40 for k in range(0, 480, 4))
    assert not any(got[k] for k in range(480) if k % 4)
    assert got[480] == [("correcthorsebatterystaplecorrecthorsebat", "secret")] and got[481] == got[482] == got[483] == []


def test_threshold_is_set_by_pools():
    assert pii.threshold_of([(3.0, 7, 0)], 0.9) is None and pii.threshold_of([(3.0, 8, 0)], 0.9) == 3.0
    assert pii.threshold_of([(3.0, 970, 0), (1.0, 0, 90)], 0.9) == 3.0  # many right ones above don't carry wrong ones below
    assert pii.threshold_of([(3.0, 4, 0), (2.0, 5, 0), (1.0, 1, 9)], 0.9) == 2.0
    assert pii.threshold_of([(3.0, 1, 1), (2.0, 99, 0), (1.0, 0, 5)], 0.9) == 2.0 and pii.threshold_of([], 0.9) is None


# 6, 7


def test_batches_are_filled_across_arrow_batches(monkeypatch):
    import pyarrow as pa

    sizes = []

    class Counter:
        safe = True

        def __init__(self, path):
            pass

        def count(self, texts):
            sizes.append(sum(len(t.encode()) for t in texts))
            return [len(t.split()) for t in texts]

    monkeypatch.setattr(token_counts, "UnitCounter", Counter)
    texts = ["é é" * 100, None, "a b c"] * 200
    parts = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 6)), pa.array(texts[k : k + 6]), pa.array([0] * 6, pa.int64())], ["id", "text", "n"]) for k in range(0, 600, 6)]
    out = pa.Table.from_batches(token_counts.token_lengths(iter(parts), "", 4000))
    assert out["id"].to_pylist() == list(range(600)) and out["n_tokens"].to_pylist() == [len((t or "").split()) for t in texts]
    assert len(sizes) < 40 and all(4000 <= x < 5200 for x in sizes[:-1])


def test_sharding_against_a_plain_filling(spark):
    names, slots = [f"s{k}" for k in range(7)], 101
    want, turn = {}, [0] * 7
    digest = [hashlib.sha256(n.encode()).digest() for n in names]
    order = [[(int.from_bytes(d[:8], "big") + j * (int.from_bytes(d[8:16], "big") % (slots - 1) + 1)) % slots for j in range(slots)] for d in digest]
    k = 0
    while len(want) < slots:
        while order[k][turn[k]] in want:
            turn[k] += 1
        want[order[k][turn[k]]] = names[k]
        k = (k + 1) % 7
    rows = [(None,), (5,), (5,), (-3,), (10**15,)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long").withColumn("Shard", F.lit(1)), names, slots).collect()
    slot = lambda key: int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16) % slots
    assert sorted((str(r.doc_id), r.slot, r.shard) for r in got) == sorted((str(d), slot(d), want[slot(d)]) for (d,) in rows)


# 8


def test_forest_links_are_the_tries():
    rng = np.random.default_rng(3)
    labels = {(t, rep): tuple(rng.integers(0, 2, 5)) for t in range(2) for rep in range(-40, 60)}
    rows = sorted((t, label, rep) for (t, rep), label in labels.items())
    trie, links = jaccard.Trie(5, 1), []
    for part in (rows[:1], rows[1:77], rows[77:]):
        a, b, shared = trie.read(np.array([t for t, *_ in part]), np.array([x for _, x, _ in part], dtype=np.uint16), np.array([r for *_, r in part]))
        links += list(zip(a.tolist(), b.tolist(), shared.tolist(), strict=True))
    for depth in range(1, 6):
        group = {rep: rep for rep in range(-40, 60)}

        def join(x, y, group=group):
            group.update({k: group[x] for k, v in group.items() if v == group[y]})

        by = defaultdict(list)
        for (t, rep), label in labels.items():
            by[t, label[:depth]].append(rep)
        for members in by.values():
            for other in members[1:]:
                join(members[0], other)
        want = {frozenset(k for k in group if group[k] == g) for g in group.values()}
        group.update({rep: rep for rep in group})
        for a, b, shared in links:
            if shared >= depth:
                join(a, b)
        assert {frozenset(k for k in group if group[k] == g) for g in group.values()} == want


def test_shortened_prefixes_recover_links(spark):
    from test_llm_operators import plain_join

    rng = random.Random(8)
    rows = []
    for k in range(60):
        base = [f"v{rng.randrange(4000)}" for _ in range(120)]
        for j in range(3):
            text = list(base)
            for _ in range(j):
                text[rng.randrange(len(text))] = f"n{rng.randrange(4000)}"
            rows.append((3 * k + j, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sum(n for *_, n in plain_join(rows))
    links = lambda **how: jaccard.jaccard_join(df, trees=3, max_depth=10, start=10, **how).agg(F.sum("n_links")).first()[0]
    long, shortened = links(recall=0.0), links(recall=0.999)
    assert long < 0.9 * want and shortened >= 0.99 * want


def joined_rows_since(spark, first):
    """Rows that the joins of the executions from that number on have made."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    for e in (store.executionsList().apply(k) for k in range(store.executionsList().size())):
        if e.executionId() < first:
            continue
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    made += int(values.get(m.accumulatorId()).get().replace(",", ""))
    return made


def test_components_read_an_edge_while_its_ends_differ(spark):
    rng = random.Random(4)
    names = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(1500)]
    near = [(names[k], names[rng.randrange(k // 2, k)]) for k in range(1, 1000) for _ in range(14)]
    path = list(zip(names[1000:1200], names[1001:1201], strict=True))
    steps = [(k, k + 1) for k in range(100)]
    star = [(names[1499], x) for x in names[1201:1300]] + [(names[1300], names[1300])]
    edges = near + path + steps + star + near[:50] + [(b, a) for a, b in near[50:90]]
    group = {x: {x} for e in edges for x in e}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            group.update(dict.fromkeys(group[b], group[a]))
    want = sorted((x, min(g)) for x, g in group.items() if len(g) > 1)
    df = common.stored(spark.createDataFrame(edges, "a long, b long"), "edges")
    before = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = before.apply(before.size() - 1).executionId() + 1
    found = jaccard.min_components(df)
    made = joined_rows_since(spark, first)
    assert sorted((r.a, r.comp) for r in found.collect()) == want
    # Both ends of an edge are looked up in the first round; later rounds have few edges, and pointers are few rows.
    assert made <= 3.5 * len(set(edges))


def test_links_of_a_large_group_are_as_many_as_its_texts(spark, monkeypatch):
    from test_llm_operators import plain_join

    rng, base, links = random.Random(6), [f"w{k}" for k in range(200)], []
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(160)] + [(200 + k, " ".join(f"v{rng.randrange(3000)}" for _ in range(30))) for k in range(20)]
    search = jaccard.min_components

    def counted(edges, name):
        if name == "roots":
            links.append(edges.count())
        return search(edges, name)

    monkeypatch.setattr(jaccard, "min_components", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(df, block=10).collect()), key=repr)
    assert got == plain_join(rows) and max(n for *_, n in got) == 159
    assert len(links) == 1 and links[0] <= 2 * 160  # in 16 blocks


def test_one_of_a_large_group_stays_and_links_are_read_once(spark, monkeypatch):
    rng, base, read = random.Random(5), [f"w{k}" for k in range(60)], []
    rows = [(k + 7, " ".join(base[:at] + [f"x{k}"] + base[at + 1 :])) for k, at in enumerate(rng.randrange(60) for _ in range(1000))] + [(3, "a text of its own"), (2, None)]
    search, store = jaccard.min_components, spark._jsparkSession.sharedState().statusStore()

    def counted(edges, name):
        edges = common.stored(edges.select("a", "b"), "edges")
        links = edges.distinct().count()
        before = store.executionsList()
        found = search(edges, name)
        read.append((links, joined_rows_since(spark, before.apply(before.size() - 1).executionId() + 1)))
        return found

    monkeypatch.setattr(jaccard, "min_components", counted)
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7]
    assert read[0][0] > 5000 and all(made <= 3.5 * links for links, made in read)


# 9


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)] + [(300, [1e300] + [0.0] * 7), (301, [1e-300] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, every=20, k=5).collect()
    by = dict(rows)
    assert len(got) == 5 * 16 and all(abs(r.score - float(np.dot(by[r.query_id], by[r.vec_id]))) <= 1e-12 * max(1, abs(r.score)) for r in got)


# 10


def test_short_rows_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    column = pa.array(["a b"] * 10_000)
    tracemalloc.start()
    for _, data, bounds in wordhash.chunks(column, quality.CHUNK, quality.ROWS):
        quality.hashed(data, bounds, quality.BUCKETS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    h, row = wordhash.shingles(*wordhash.words(*next(wordhash.chunks(pa.array(["a b", "c", "", "a b", "x y z u v w"])))[1:])[:2], 5)
    by = {int(r): set(h[row == r].tolist()) for r in set(row.tolist())}
    assert by[0] == by[3] and len({frozenset(x) for x in by.values()}) == 3 and len(by[4]) == 2


def test_the_driver_gets_weights_and_not_the_sample(spark):
    import tracemalloc

    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(12)) + (", and so on." if k % 3 else " #### $$$$ ||||")) for k in range(2500)] + [(2500, ""), (2501, None)]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    tracemalloc.start()
    scored = quality.classify(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6  # the sample's matrix has 2,500 rows of 2,048 floats
    got = {r.doc_id: r.keep for r in scored.collect()}
    assert len(got) == 2502 and not got[2500] and not got[2501] and all(got[k] == bool(k % 3) for k in range(2500))


# Names


def test_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(k, text if k < 3 else f"Some other text, number {k}, that is good enough to stay here.", "x") for k in range(20)] + [(None, None, None)]
    names = ["_bad", "_gone", "_hit", "_spans", "_id", "_times", "_time", "_mark", "_of", "_row", "id", "row", "w", "i", "h", "key", "cls", "bucket", "size", "base", "slot"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(n).alias(n) for n in names))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    for done in (quality.keep_good(docs), jaccard.one_of_each(docs), decontaminate.remove_contaminated(docs, bench), decontaminate.remove_contaminated(docs, bench, "spans"), mixing.repeat_documents(docs)):
        assert done.columns == docs.columns and done.count() >= 0
    assert jaccard.one_of_each(docs).count() == 19 and decontaminate.remove_contaminated(docs, bench).count() == 18
    for stage in (quality.keep_good, jaccard.one_of_each, mixing.repeat_documents, lambda d: decontaminate.remove_contaminated(d, bench)):
        assert stage(docs.limit(0)).count() == 0


def test_temporary_tables_go(spark):
    from pathlib import Path

    with common.temporary(spark) as kept:
        one, two = common.stored(spark.range(3), "one"), common.stored(spark.range(4), "two")
        kept.append(common.last_path())
    where = [Path(re.sub("^file:/*", "/", p.rsplit("/", 1)[0])) for p in (two.inputFiles()[0],)]
    assert two.count() == 4 and where[0].exists() and not Path(str(where[0]).replace("two-", "one-")).exists()
    with pytest.raises(Exception, match="."):
        one.collect()
