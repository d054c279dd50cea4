"""The training-data operators against plain versions, on small tables with awkward rows."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmeter.llm import decontaminate, jaccard, licenses, mixing, neighbours, pii, quality, sharding, token_counts, warc

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AWKWARD = [
    (None, "a b c d e f", "x", 1), (1, None, "x", 2), (2, "", None, 3), (3, "one", "x", 4), (4, "one", "y", 5), (4, "one", "y", 5), (5, "  spaces   and\ttabs \n", "y", 6), (6, "É é Straße 日本語 ok", "z", 7),
    (7, "word " * 30000, "x", 8), (8, "x" * 200000, "x", 9), (9, "a b c d e f g h i j k l m n", "x", 10), (10, "A, b! c d e f g h i j k l m n", "y", 11),
]


def words(text):
    return SPLIT.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, source string, items int").withColumn("spans", F.lit("clash"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(df):
    return df.limit(0)


# 1


def test_warc_round_trip(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, None, "other"), (4, "u4", None), (5, "u5", ""), (7, "u\r\n7", "WARC/1.1\r\n\r\n" * 3), (8, "u8", "é" * 300000), (9, "u", "same"), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.record_id: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    for pid, _, html in rows:
        r, data = got[None if pid is None else str(pid)], (html or "").encode()
        twins = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(twins, default=pid)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if pid == first else ("revisit", str(first)))
    assert warc.archive_round_trip(empty(pages)).count() == 0


def test_warc_without_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"p{k % 3}") for k in range(30)], "page_id long, html string")
    both = []
    for bound in (warc.BROADCAST_DIGESTS, 1):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)
        both.append(sorted((r.record_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()))
    assert both[0] == both[1] and sum(t == "response" for _, t, _ in both[0]) == 3


def test_warc_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in warc.op1(spark, SF).collect()}
    for p in pages.collect():
        data = (p.html or "").encode()
        assert (got[p.page_id].payload_bytes, got[p.page_id].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())


def test_warc_members_and_index(spark, tmp_path):
    import gzip
    import json

    pages = spark.createDataFrame([(k, None, f"<p>{k}</p>" * k) for k in range(40)], "page_id long, url string, html string")
    files = warc.write_archives(warc.marked_revisits(pages, "page_id", "html").coalesce(1), f"file://{tmp_path}", file_bytes=3000)
    done = warc.normalise(spark.createDataFrame(files.collect(), files.schema)).collect()
    assert len(done) > 1 and sum(r.records for r in done) == 40
    for r in done:
        data = open(r.path.removeprefix("file://"), "rb").read()
        entries = [json.loads(x) for x in open(r["index"].removeprefix("file://"))]
        assert [e["offset"] for e in entries] == [0, *itertools.accumulate(e["length"] for e in entries)][:-1]
        for e in entries:
            assert warc.parsed(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]))[1] == e["type"]
    small = warc.read_records(spark.createDataFrame(done), range_bytes=100)
    assert small.count() == 40


# 2


def plain_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, other in items:
        b = words(other)
        m = min(10, len(b))
        for g in {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if b else ():
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == g:
                    hit.update(range(i, i + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, awkward):
    items = [(1, "B C d e f g h i j k"), (2, "one"), (10, "one"), (3, None), (4, "?!"), (5, "straße 日本語"), (6, "c d e f g h i j k l m n o")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(awkward, bench).collect()), key=repr)
    assert got == sorted(((d, *plain_hits(t, items)) for d, t, *_ in AWKWARD), key=repr)
    assert decontaminate.find_contamination(empty(awkward), bench).count() == 0
    none = decontaminate.find_contamination(awkward, empty(bench)).collect()
    assert len(none) == len(AWKWARD) and not any(r.n_hit for r in none)
    kept = decontaminate.remove_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 5, 7, 8}
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(awkward, bench, "spans").collect()}
    assert cut[9] == "a " and cut[3] == "" and cut[1] is None and cut[5] == AWKWARD[6][1]
    shuffled = decontaminate.find_contamination(awkward, bench, broadcast_grams=1)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in shuffled.collect()), key=repr) == got


# 3

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and passes(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((pii.KINDS.index(kind), m.start(), m.end()))
    return out


def test_pii_base(spark, docs):
    rng = random.Random(5)
    parts = ["a.b@c.de", "x@y", "@", "p.@q-r.s..t@u.v", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.000.0001.255", "4111 1111 1111 1111", "4111-1111-1111-1111 0", "4111111111111112", "+1 (234) 555-0199", "+12", "+1 2345678901234567", "é日", " ", ". ", "\n", "12", "a@b.c_d@e.f", "++4 12 34 56 78", "😀", "mail", "call 555 123 4567", "bob (at) ex (dot) com"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 25))) for _ in range(400)] + ["1" * 30000, "a" * 60000, "a.b" * 9000 + "@x" + ".y" * 9000, "1.2.3.4 " * 800, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(0)).repartition(8)
    got = {r.doc_id: ([tuple(x) for x in r.base], [tuple(x) for x in r.spans]) for r in pii.find_pii(df).collect()}
    for k, text in enumerate(texts):
        assert got[k][0] == plain_spans(text), text and text[:300]
        assert set(got[k][0]) <= set(got[k][1])
    both = docs.select("doc_id", "text").collect()
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.find_pii(docs).collect()}
    assert all(got[r.doc_id] == plain_spans(r.text) for r in both)
    assert pii.find_pii(empty(docs)).count() == 0


def test_pii_query(spark, docs):
    import hashlib as h

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.op3(spark, SF).collect():
        spans = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{i}:{j}" for k, i, j in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in spans) for n in range(4))
        assert r.base_sha256 == h.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_pii_redacts(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or +1 (234) 555-0199, é a@b.cd")], "doc_id long, text string")
    got = pii.find_pii(df).join(df, "doc_id").select(pii.redacted(F.col("text"), F.col("spans"))).first()[0]
    assert got == "mail [EMAIL] or [PHONE], é [EMAIL]"


def test_pii_adds_loose_phones_and_addresses(spark):
    rng = random.Random(9)
    texts = []
    for k in range(300):
        number = f"{rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        texts += [f"phone +1 ({number} of {k}", f"mail u{k}@ex.com please", f"phone 212 555 {1000 + k} please", f"mail u{k} (at) ex (dot) com please", f"met (at) school{k}. Then", f"sums {10 + k % 90} 345 {100 + k} here"]
    lone = {"phone": "call 415-555-0123 now", "email": "write bob (at) mail (dot) org now"}
    df = spark.createDataFrame(list(enumerate([*texts, *lone.values()])), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.base, [(pii.KINDS[s.kind], s.i, s.j) for s in r.spans]) for r in pii.find_pii(df).collect()}
    assert got[len(texts)] == ([], [("phone", 5, 17)])
    assert got[len(texts) + 1] == ([], [("email", 6, 29)])
    assert [s for k in range(4, len(texts), 6) for s in got[k][1]] == [] == [s for k in range(5, len(texts), 6) for s in got[k][1]]
    assert all(len(got[k][1]) == 1 for k in range(len(texts)) if k % 6 < 4)


def test_boosting_adds_what_looks_alike():
    likely, unlikely = (16, 0, 1, 1, 1), (13, 0, 2, 1, 0)
    cells = [(2, half, x, p, n) for half in (0, 1) for x, p, n in ((likely, 970, 30), (unlikely, 5, 600))]
    first, trees, threshold = pii.fit(cells)[2]
    score = lambda x: first + sum(pii.tree_value(t, x) for t in trees)
    assert score(likely) >= threshold > score(unlikely)
    assert pii.fit([(0, 0, likely, 5, 0)]) == {} and pii.fit([]) == {}


# 4


def test_licenses(spark):
    rows = [(1, "x y. Released under the MIT License. Licensed under CC BY-NC 4.0."), (2, None), (3, "all rights"), (4, "All Rights Reserved"), (4, "All Rights Reserved"), (5, ("pad " * 500) + licenses.TEMPLATES["MIT-permission"].replace("documentation", "docs") + " pad" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(1))
    got = sorted((r.doc_id, [m.template for m in r.matches]) for r in licenses.scan_licenses(df).collect())
    long = words(licenses.TEMPLATES["MIT-permission"])
    grams = {tuple(long[i : i + 5]) for i in range(len(long) - 4)}
    changed = words(rows[-1][1])
    share = len(grams & {tuple(changed[i : i + 5]) for i in range(len(changed) - 4)}) / len(grams)
    assert got == [(1, ["CC-BY-NC-4.0", "MIT"]), (2, []), (3, []), (4, ["reserved"]), (4, ["reserved"]), (5, ["MIT-permission"] if share >= 0.8 else [])]
    assert licenses.scan_licenses(empty(df)).count() == 0


def test_short_licenses_beside_others_without_bands(spark):
    short = [k for k, v in licenses.TEMPLATES.items() if len(words(v)) <= licenses.DIRECT]
    rows = [(f"{a} {b}", f"{licenses.TEMPLATES[a]} {licenses.TEMPLATES[b]}") for a, b in itertools.permutations(short, 2)]
    got = {r.doc_id: {m.template for m in r.matches} for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string"), bands=1).collect()}
    assert [k for k, found in got.items() if not set(k.split()) <= found] == []


# 5


def water(sizes, share=1.5, most=2):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, full = share * sum(sizes.values()), {}
    while True:
        free = {s: left * weights[s] / sum(w for t, w in weights.items() if t not in full) for s in sizes if s not in full}
        over = [s for s, t in free.items() if t > most * sizes[s]]
        if not over:
            return free | full
        for s in over:
            full[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


def test_mixing(spark, awkward, docs):
    for table in (awkward, docs):
        got = mixing.mix_sources(table).collect()
        rows = table.select("doc_id", "text", "source").collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        want = water(sizes)
        assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted((r.doc_id is None, r.doc_id, size(r.text)) for r in rows)
        assert sorted({round(r.target, 6) for r in got}) == sorted({round(x, 6) for x in want.values()})
        taken = {}
        for r in got:
            taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
            assert 0 <= r.taken <= 2 * r.size
        assert all(abs(n / (sum(v == s and abs(want[k] - t) < 1e-6 for k, v in sizes.items()) or 1) - t) < 1 for (s, t), n in taken.items())
        assert sorted(map(repr, mixing.mix_sources(table.repartition(5)).collect())) == sorted(map(repr, got))
    assert mixing.mix_sources(empty(docs)).count() == 0
    mixed = mixing.repeat_documents(docs)
    assert mixed.columns == docs.columns
    whole = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(docs, cut="documents").collect() if r.size}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: n for d, n in whole.items() if n}


# 6


def test_token_counts(spark, awkward, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    odd = [" a", "a ", "  ", " ", "a  b ", "a\n b", "<s> </s>", "▁a ▁▁b", "a▁", "\r\n x\t y", "a 　b", "ﬁ é", "x" * 5000 + " y", "d 1234  56"]
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    for table in (awkward, extra, docs):
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table, batch_bytes=3000).collect()), key=repr)
        want = [(r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in table.collect()]
        assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(empty(docs)).count() == 0


# 7


def test_sharding(spark, awkward):
    table = sharding.fill_table(sharding.shard_names(10), 1009)
    sizes = np.bincount(table, minlength=10)
    assert sizes.sum() == 1009 and sizes.max() - sizes.min() <= 1
    fewer = sharding.fill_table(sharding.shard_names(9), 1009)
    stay = table < 9
    assert (table[stay] == fewer[stay]).mean() > 0.7
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(wrong)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 1000)
    got = sharding.assign_shards(awkward.withColumn("slot", F.lit("clash")), 10, 1009).collect()
    assert len(got) == len(AWKWARD) and all(r.shard == f"shard-{table[r.slot]:05d}" for r in got)
    assert sharding.assign_shards(empty(awkward)).count() == 0


# 8


def plain_join(rows, threshold=0.8):
    sets = []
    for doc, text in rows:
        w = words(text)
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()))
    links = [[b for b, (_, y) in enumerate(sets) if a != b and x and len(x & y) >= threshold * len(x | y)] for a, (_, x) in enumerate(sets)]
    out = []
    for a in range(len(sets)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [sets[k][0] for k in seen if sets[k][0] is not None]
        out.append((sets[a][0], min(ids, default=None), len(links[a])))
    return sorted(out, key=repr)


def test_jaccard_join(spark, awkward):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(30)]
    rows = [(d, t) for d, t, *_ in AWKWARD]
    for k in range(400):
        text = list(base[rng.randrange(30)]) if k < 250 else list(base[0] * 2)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((1000 - k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("cls", F.lit(1))
    want = plain_join(rows)
    for block in (512, 20):
        got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(df, block=block).collect()), key=repr)
        assert got == want
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for d, c, _ in want if d is not None and d == c})
    assert jaccard.jaccard_join(empty(df)).count() == 0 and jaccard.one_of_each(empty(df)).count() == 0


def test_stop_counts_pairs_of_classes():
    import pyarrow as pa

    texts = [" ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(61))]
    h = [x for _, values, _, bounds in jaccard.text_sets(pa.array(texts), 5) for x in np.split(values, bounds[1:-1])]
    one = {"cluster": [1, 1], "i": [0, 0], "j": [0, 0], "block": [0, 0], "rep": [1, 2], "cls": [jaccard.set_name(x) for x in h], "copies": [5000, 4000], "labels": [[1, 2], [1, 3]], "text": texts}
    got = jaccard.verify(pa.table({k: pa.chunked_array([v]) for k, v in one.items()}), 5, 0.8)
    assert sum(got["links"].to_pylist()) == 9000 and sum(got["pairs"].to_pylist()) == 1 and sum(got["once"].to_pylist()) == 1
    assert not jaccard.enough(1, 0, 1, 0.999) and jaccard.enough(1, 500, 2000, 0.999) and jaccard.enough(0, 0, 0, 0.999)


def test_one_of_each_by_row(spark):
    long = [f"w{k}" for k in range(80)]
    near = lambda k: " ".join([*long[:k], "changed", *long[k + 1 :]])
    other = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(None, near(0), "a"), (None, near(79), "b"), (5, near(1), "a"), (None, other("x"), "a"), (None, other("x"), "b"), (None, other("x") + " y", "c"), (1, other("q"), "a"), (9, other("q"), "a"), (9, other("z"), "a"), (None, None, "a"), (None, None, "a"), (7, other("v"), "a"), (7, other("v"), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = [tuple(r) for r in jaccard.one_of_each(df).collect()]
    assert sorted(i for i, *_ in kept if i is not None) == [1, 5, 7, 9]
    assert (9, other("z"), "a") in kept and kept.count((None, None, "a")) == 2
    assert len([t for i, t, _ in kept if i is None and t is not None]) == 1
    assert sorted(map(repr, kept)) == sorted(repr(tuple(r)) for r in jaccard.one_of_each(df.repartition(2, "source")).collect())


def test_depth():
    assert jaccard.depth_for(0.8, 24, 12, 0.999) == 6 and jaccard.depth_for(0.8, 1, 12, 0.999) == 1 and jaccard.depth_for(0.99, 24, 12, 0.9) == 12


# 9


def brute(rows, every, k):
    out = []
    for q, v in rows:
        if q % every == 0:
            score = sorted(((-float(np.dot(np.float64(v), np.float64(w))), c) for c, w in rows if c != q))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(score)]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    rows = [(k, (centre[k % 12] + rng.normal(size=16) * 0.6).astype(np.float32) * np.float32(1 + k % 3)) for k in range(1500)]
    rows += [(k, rows[7][1]) for k in range(1500, 1700)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] * 16), (2080, [None] * 16)]
    data = [(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in [*rows, *bad]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    got = [tuple(r) for r in neighbours.nearest(df, shards=3).select("query_id", "rank", "vec_id", "score").collect()]
    want = brute(rows, 20, 20)
    assert len(got) == len(want)
    assert len({x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}) >= 0.95 * len(want)
    by = dict(rows)
    for q, _, c, s in got:
        assert abs(s - float(np.dot(np.float64(by[q]), np.float64(by[c])))) < 1e-9
    many = [tuple(r) for r in neighbours.search(neighbours.build_index(df, shards=2), df.where("vec_id % 20 = 0"), query_block=10).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(many) == len(want)
    assert neighbours.nearest(empty(df)).count() == 0
    few = df.where("vec_id < 5")
    assert neighbours.nearest(few).count() == 4


def test_neighbours_on_the_table(spark):
    rows = [(r.vec_id, np.array(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id) for r in neighbours.op9(spark, "/root/testdata/sf0.01").collect()}
    want = {(q, c) for q, _, c, _ in brute(rows, 20, 20)}
    assert len(got & want) >= 0.9 * len(want)


# 10


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("keep", "quality").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_quality_awkward(spark, awkward):
    got = quality.classify(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert all(r.score == 0 and not r.keep for r in got if r.doc_id in (1, 2))
    assert quality.classify(empty(awkward)).count() == 0
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns


def test_em_finds_the_odd_labeller():
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.8
        v = np.where(rng.random(9) < 0.1, 1 - y, y) + 1
        v[0] = rng.integers(0, 2) + 1
        counts[int(quality.encode(v[None])[0])] = counts.get(int(quality.encode(v[None])[0]), 0) + 1
    _, rates, prior = quality.weigh(counts)
    assert abs(prior - 0.8) < 0.05 and rates[0, 1] > 0.3 and rates[1:, 1].max() < 0.15 and rates[1:, 0].min() > 0.7


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    benchmark = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(20)) for _ in range(3)]
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows += [(None, rows[0][1], "en", "x"), (5000, rows[1][1] + " more", "en", "x"), (5001, f"{rows[2][1]} {benchmark[0]}", "en", "y"), (5002, None, "en", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bag = lambda df: sorted(repr((r.doc_id, r.text, r.source)) for r in df.collect())
    steps, each = {}, {name: stage for name, stage in corpus_pipeline.STAGES}
    before = held
    for name, stage in each.items():
        steps[name] = (before, stage(spark, before, str(tmp_path)).cache())
        before = steps[name][1]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == before.columns and sorted(map(repr, whole.collect())) == sorted(map(repr, before.collect()))

    source, got = steps["quality classifier"]
    keep = {(r.doc_id, r.keep) for r in quality.classify(source).collect()}
    assert bag(got) == sorted(repr((d, t, s)) for d, t, _, s in rows if (d, True) in keep)

    source, got = steps["n-gram Jaccard join"]
    left = [(r.doc_id, r.text) for r in source.collect()]
    grams = lambda t: {tuple(words(t)[k : k + 5]) for k in range(max(len(words(t)) - 5, 0) + 1)} if words(t) else set()
    sets, comp = [grams(t) for _, t in left], list(range(len(left)))
    for a, b in itertools.combinations(range(len(left)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            comp = [comp[a] if c == comp[b] else c for c in comp]
    first = {c: min((k for k in range(len(left)) if comp[k] == c), key=lambda k: (left[k][0] is None, left[k][0] or 0)) for c in set(comp)}
    assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == sorted(repr(left[k]) for k in first.values())

    source, got = steps["benchmark decontamination"]
    tens = lambda t: {tuple(words(t)[k : k + 10]) for k in range(len(words(t)) - 9)}
    known = set().union(*map(tens, benchmark))
    assert bag(got) == sorted(repr((r.doc_id, r.text, r.source)) for r in source.collect() if not tens(r.text) & known)

    source, got = steps["mixing sources"]
    assert set(bag(got)) <= set(bag(source)) and max(Counter(bag(got)).values()) <= 2
    source, got = steps["sharding"]
    assert bag(got) == bag(source) and set(got.columns) > set(source.columns)
