"""PII: high-recall generators propose overlapping spans, boosted trees score format and context, calibrated thresholds select.

The generators of each kind are the base rule without its validation, and looser forms: an address spelled out with "(at)", a
telephone number without a plus, and for secrets (keys, tokens, passwords), which have no base rule, runs of 20 or more key
characters with a digit among them, and values assigned to names like ``token``. Base spans, which pass their validation, are always redacted. What
else is redacted is up to the trees. A candidate's features are its form and what stands around it. Its label is evidence
that is not among them: a loose candidate is right if its normalised form is valid (``valid_loose``), one that fails its base
rule (a mistyped card number) if the document holds a base span of its kind and, but for addresses of machines, of as many
digits or one more or less. So the trees learn in which forms and contexts
such candidates are right, and add those that stand in them, whether they have the evidence themselves or not.
Loose candidates that meet a base span, such as the inside of a number with a plus, are no examples.

All features are small integers, so the training set is a table of counts per combination, grouped over all documents; its
size is bounded by the number of combinations, not by the documents. Trees of depth two are fitted to it by Newton boosting, and
scored as CASE expressions. Half of the documents, by a hash of the text, train, base spans being right examples among them; the
other half sets each kind's threshold, on candidates that aren't base spans, as these are redacted anyway. Their scores are
calibrated by isotonic regression (neighbouring scores are pooled until higher ones are right more often), and the threshold is
the lowest score such that each pool above it is right in ``precision`` of its cases, and so are all of them together with one
right and one wrong case added (Laplace's rule): a few cases prove nothing, at every size of a corpus.

Offsets are code points. Candidates are found by regex inside each row; a text without the character that a kind needs isn't
searched for it. Java's possessive groups loop without recursion, so long runs can't exhaust the stack.

Edge cases: null is the empty text; equal rows give equal results; other columns are ignored; an empty table gives an empty
result; a kind whose candidates give no evidence, or are seldom right, adds no span to the base ones.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = KINDS.index("secret")
ROUNDS, RATE, PRECISION = 12, 0.5, 0.9
LOCAL = "[A-Za-z0-9._%+-]"
#: The base rules. The look-behinds only skip starts that a match from further left would have covered.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAMES = "secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key"
LOOSE = {
    "email": [r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)++"],
    "phone": [r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])"],
    "secret": [r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+=*+(?![A-Za-z0-9_+/-])", rf"(?<=(?i:{NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)[^\s\"']{{6,}}+"],
}
NEEDS = {"email": "@", "phone": "+"}
#: What a text must hold, all of it, to be searched: cheap patterns first.
LOOSE_NEEDS = {"email": [[r"[(\[](?:at|AT)[)\]]"]], "phone": [["[0-9]"]], "secret": [["[0-9]", "[A-Za-z0-9_+/-]{20}"], ["[:=]", rf"(?=[aApPsStT])(?i:{NAMES})[\"']?\s{{0,3}}[:=]"]]}
CUES = {"email": "mail|write|contact", "ip": "(?<![a-z])ip|host|server|addr", "card": "card|visa|pay|account", "phone": "phone|tel|call|fax|mobile", "secret": "secret|token|passw|pwd|key|bearer|auth"}
AROUND = 24
#: The form of a candidate from a loose generator is at least this.
FROM_LOOSE = 5
CANDIDATE = "struct<kind:int,i:int,j:int,base:boolean,ok:boolean,ndig:int,form:int,left:int,right:int,cue:int>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    at = F.sequence(F.lit(1), F.length(number))

    def value(k):
        d = F.substring(F.reverse(number), k, F.lit(1)).cast("int")
        twice = F.when(k % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.coalesce(F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0, F.lit(False))


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        n = F.length(digits(x))
        return F.when((n >= 16) & (n <= 19), luhn(digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(x)).between(8, 15)
    return F.lit(True)


def valid_loose(kind: str, x: Column) -> Column:
    """Whether a loose candidate, written as its base rule wants it, is one: an address whose "(at)" and "(dot)" are replaced and
    which ends in letters; a number that is national: an area code from 2 to 9 in groups of 3, 3 and 4, or a trunk 0 and 9 to 11 digits;
    a secret that looks drawn at random, with letters and three groups of digits or more.
    """
    if kind == "secret":
        return (F.length(digits(x)) >= 4) & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 2) & (F.regexp_count(x, F.lit("[0-9]+")) >= 3)
    if kind == "email":
        at = F.regexp_replace(x, r" ?[(\[](?:at|AT)[)\]] ?", "@")
        return F.regexp_replace(at, r" ?[(\[](?:dot|DOT)[)\]] ?", ".").rlike(rf"^{LOCAL}++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{{2,}}$")
    return x.rlike(r"^(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[\x20.-][0-9]{3}[\x20.-][0-9]{4}$") | (x.rlike(r"^\(?0[1-9]") & F.length(digits(x)).between(9, 11))


def char_class(c: Column) -> Column:
    """0: none, 1: white space, 2: letter, 3: digit, 4: anything else."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def form_of(kind: str, x: Column, loose: bool, which: int = 0) -> Column:
    """0-4: how the candidate is written, or for secrets which generator proposed it; 5-9: the same from a loose generator."""
    if kind == "secret":
        form = F.lit(which)
    elif kind == "email":
        form = F.when(F.length(x) > 40, 1).otherwise(0)
        if loose:
            form = F.when(x.rlike(r" \.|\. "), 3).when(x.rlike("dot|DOT"), 2).otherwise(form)
    elif kind == "ip":
        form = F.when(x.rlike(r"(^|\.)0[0-9]"), 1).otherwise(0)
    else:
        form = F.when(x.rlike(r"\("), 4).when(F.contains(x, F.lit("-")) & F.contains(x, F.lit(" ")), 3).when(F.contains(x, F.lit("-")), 2).when(F.contains(x, F.lit(" ")), 1).otherwise(0)
    return (form + (FROM_LOOSE if loose else 0)).cast("int")


def found(text: Column, pattern: str) -> Column:
    """The matches of pattern, leftmost first, as (i, j, x): code points and what matched."""
    x, gap = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,j:int,x:string>>").alias("out"))

    def step(acc, pair):
        i = acc["at"] + F.length(pair["gap"])
        j = i + F.length(pair["x"])
        return F.struct(j.alias("at"), F.concat(acc["out"], F.array(F.struct(i.alias("i"), j.alias("j"), pair["x"].alias("x")))).alias("out"))

    return F.aggregate(F.arrays_zip(x.alias("x"), F.slice(gap, 1, F.size(x)).alias("gap")), start, step, lambda acc: acc["out"])


def described(text: Column, kind: str, number: int, loose: bool, which: int = 0):
    """A function from a match (i, j, x) to a CANDIDATE."""

    def make(m: Column) -> Column:
        before = F.when(m["i"] > 0, F.substring(text, F.greatest(m["i"] - AROUND + 1, F.lit(1)), F.least(m["i"], F.lit(AROUND)))).otherwise("")
        after = F.substring(text, m["j"] + 1, F.lit(1))
        return F.struct(
            F.lit(number).alias("kind"), m["i"].alias("i"), m["j"].alias("j"),
            (F.lit(False) if loose else valid(kind, m["x"])).alias("base"), (valid_loose if loose else valid)(kind, m["x"]).alias("ok"),
            F.least((F.length(m["x"]) / 4).cast("int") if kind == "secret" else F.length(digits(m["x"])), F.lit(20)).alias("ndig"), form_of(kind, m["x"], loose, which).alias("form"),
            char_class(F.substring(before, -1, 1)).alias("left"), char_class(after).alias("right"),
            F.when(F.lower(before).rlike(CUES[kind]), 1).otherwise(0).alias("cue"),
        )

    return make


def candidates(text: Column) -> Column:
    """All proposals of all generators: an array of CANDIDATE."""
    none, parts = F.array().cast(f"array<{CANDIDATE}>"), []
    for number, kind in enumerate(KINDS):
        loose = zip(LOOSE.get(kind, ()), LOOSE_NEEDS.get(kind, ()), strict=True)
        ways = [(pattern, reduce(and_, map(text.rlike, needs)), True, k) for k, (pattern, needs) in enumerate(loose)]
        if kind in BASE:
            ways.append((BASE[kind], F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]"), False, 0))
        for pattern, need, is_loose, which in ways:
            parts.append(F.when(need, F.transform(found(text, pattern), described(text, kind, number, is_loose, which)).cast(f"array<{CANDIDATE}>")).otherwise(none))
    return F.concat(*parts)


#: Of equally good cuts the first is taken: form and context before length.
FEATURES = ("form", "cue", "left", "right", "ndig")


def boost(rows: list[tuple[tuple[int, ...], int, int]], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list]:
    """Newton boosting of the logistic loss on counts. rows: features, positives, negatives. Returns the first score and trees.

    A tree is (feature, cut, left, right), value <= cut to the left, down to numbers; it is at most two levels deep.
    """
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not pos or not neg:
        return 0.0, []
    first = math.log(pos / neg)
    score, trees = [first] * len(rows), []

    def leaf(g, h):
        return rate * g / (h + 1.0)

    def grow(which, depth):
        grad = {k: rows[k][1] - (rows[k][1] + rows[k][2]) / (1 + math.exp(-score[k])) for k in which}
        hess = {k: (rows[k][1] + rows[k][2]) * (p := 1 / (1 + math.exp(-score[k]))) * (1 - p) for k in which}
        total_g, total_h = sum(grad.values()), sum(hess.values())
        best = (1e-9, None)
        for f in range(len(rows[0][0])):
            by = defaultdict(lambda: [0.0, 0.0])
            for k in which:
                by[rows[k][0][f]][0] += grad[k]
                by[rows[k][0][f]][1] += hess[k]
            g = h = 0.0
            for cut in sorted(by)[:-1]:
                g, h = g + by[cut][0], h + by[cut][1]
                gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                if gain > best[0] * (1 + 1e-9) + 1e-12:
                    best = (gain, (f, cut))
        if best[1] is None or not depth:
            value = leaf(total_g, total_h)
            for k in which:
                moved[k] = value
            return value
        f, cut = best[1]
        return (f, cut, grow([k for k in which if rows[k][0][f] <= cut], depth - 1), grow([k for k in which if rows[k][0][f] > cut], depth - 1))

    for _ in range(rounds):
        moved = [0.0] * len(rows)
        trees.append(grow(range(len(rows)), 2))
        score = [a + b for a, b in zip(score, moved, strict=True)]
    return first, trees


def tree_value(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_column(tree, x: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[tree[0]] <= tree[1], tree_column(tree[2], x)).otherwise(tree_column(tree[3], x))


def threshold_of(scored: list[tuple[float, int, int]], precision: float) -> float | None:
    """scored: score, right and wrong cases. The lowest score to redact, by pools of an isotonic fit; None if no score will do."""
    bins: dict[float, list[int]] = {}
    for score, p, n in scored:
        cell = bins.setdefault(score, [0, 0])
        cell[0], cell[1] = cell[0] + p, cell[1] + n
    pools: list[list] = []  # lowest score, right, wrong; from the highest score down, right ever more seldom
    for score in sorted(bins, reverse=True):
        pools.append([score, *bins[score]])
        while len(pools) > 1 and pools[-1][1] * (pools[-2][1] + pools[-2][2]) > pools[-2][1] * (pools[-1][1] + pools[-1][2]):
            score_, p, n = pools.pop()
            pools[-1] = [score_, pools[-1][1] + p, pools[-1][2] + n]
    right = wrong = 0
    threshold = None
    for score, p, n in pools:
        if p < precision * (p + n):
            break
        right, wrong = right + p, wrong + n
        if right + 1 >= precision * (right + wrong + 2):
            threshold = score
    return threshold


def fit(cells: list[tuple[int, int, tuple[int, ...], int, int]], precision: float = PRECISION, known: list[tuple[int, int, tuple[int, ...], int]] = ()) -> dict[int, tuple[float, list, float]]:
    """cells: kind, half, features, right and wrong cases among the candidates that aren't base spans; known: kind, half, features and number of base spans.

    By kind: the model's first score, trees and threshold; kinds without any are left out.
    """
    models = {}
    for kind in range(len(KINDS)):
        halves = [[(x, p, n) for k, half, x, p, n in cells if (k, half) == (kind, want)] for want in (0, 1)]
        if not halves[0] or not halves[1]:
            continue
        first, trees = boost(halves[0] + [(x, n, 0) for k, half, x, n in known if (k, half) == (kind, 0)])
        score = lambda x: first + sum(tree_value(t, x) for t in trees)  # noqa: B023, E731
        threshold = threshold_of([(round(score(x), 9), p, n) for x, p, n in halves[1]], precision)
        if threshold is not None:
            models[kind] = (first, trees, threshold)
    return models


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """Per document: its id, base and spans: arrays of (kind, i, j), by kind and start; spans has the base ones and those that the model adds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"), candidates(text).alias("c"))
    rows = common.stored(rows, "pii")
    span = lambda c: F.struct(c["kind"].alias("kind"), c["i"].alias("i"), c["j"].alias("j"))
    meets = lambda b, c: F.when(c["kind"] == SECRET, (b["i"] <= c["i"]) & (c["j"] <= b["j"])).otherwise((b["i"] < c["j"]) & (c["i"] < b["j"]))
    free = lambda c: ~F.exists("base", lambda b: meets(b, c))
    twin = lambda b, c: b["base"] & (b["kind"] == c["kind"]) & ((c["kind"] == KINDS.index("ip")) | (F.abs(b["ndig"] - c["ndig"]) <= 1))
    right = lambda c: F.when(c["base"], True).when(c["form"] >= FROM_LOOSE, c["ok"]).otherwise(F.exists("c", lambda b: twin(b, c)))
    rows = rows.withColumn("base", F.array_sort(F.transform(F.filter("c", lambda c: c["base"]), span)))
    example = lambda c: F.struct(c["kind"].alias("kind"), c["base"].alias("known"), right(c).alias("good"), *(c[f].alias(f) for f in FEATURES))
    one = rows.where(F.size("c") > 0).select("half", F.inline(F.transform(F.filter("c", lambda c: c["base"] | free(c)), example)))
    counted = one.groupBy("kind", "half", "known", *FEATURES).agg(F.count(F.when(F.col("good"), 1)).alias("p"), F.count(F.when(~F.col("good"), 1)).alias("n"))
    # At most a row for each combination of features: 5 * 2 * 2 * 21 * 10 * 5 * 5 * 2, whatever the corpus.
    held = sorted((r.kind, r.half, r.known, tuple(r[f] for f in FEATURES), r.p, r.n) for r in counted.collect())
    models = fit([(k, half, x, p, n) for k, half, known, x, p, n in held if not known], precision, [(k, half, x, p) for k, half, known, x, p, _ in held if known])

    def added(c):
        own = F.lit(False)
        for kind, (first, trees, threshold) in models.items():
            x = [c[f] for f in FEATURES]
            score = F.lit(first)
            for t in trees:
                score = score + tree_column(t, x)
            own = F.when(c["kind"] == kind, score >= threshold - 1e-6).otherwise(own)
        return own

    more = F.transform(F.filter("c", lambda c: ~c["base"] & added(c) & free(c)), span)
    return rows.select(F.col("id").alias(id_col), "base", F.array_sort(F.array_distinct(F.concat("base", more))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with every code point of the spans' union replaced: a span is [KIND], overlapping ones the first's."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["i"].alias("i"), s["j"].alias("j"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        new = s["i"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, s["i"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["j"]).alias("at"), F.when(new, F.concat(acc["out"], F.array(kept, F.get(names, s["kind"])))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(by_start, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["i"].cast("string"), s["j"].cast("string"))), ",")


def op3(spark, sf_dir: str) -> DataFrame:
    done = find_pii(common.table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS) if kind in BASE]
    return done.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def base_spans(spark, sf_dir: str) -> DataFrame:
    """The base rules' part of op3, which SQL can express."""
    return op3(spark, sf_dir).drop("spans")


def base_sql() -> str:
    plain = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "ip": "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "card": "[0-9](?:[\\x20-]?[0-9])+", "phone": "\\+[0-9][\\x20().0-9-]+[0-9]"}
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS x, string_split_regex(t, '{p}') AS g FROM d" for k, (kind, p) in enumerate(plain.items()))
    digit = "CAST(substr(reverse(n), CAST(j AS INT), 1) AS INT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({each}),
u AS (SELECT doc_id, k, kind, x[i] AS v, coalesce(list_sum(list_transform(g[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(x[1:i - 1], lambda s: length(s))), 0) AS a FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM m)),
w AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS n FROM u),
b AS (SELECT * FROM w WHERE CASE kind WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL OR TRY_CAST(p AS HUGEINT) > 255)) = 0
 WHEN 'card' THEN length(n) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0
 WHEN 'phone' THEN length(n) BETWEEN 8 AND 15 ELSE true END),
l AS (SELECT doc_id, count(*) FILTER (k = 0) AS e, count(*) FILTER (k = 1) AS i, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS p, string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(v) AS BIGINT) AS VARCHAR), ',' ORDER BY k, a) AS s FROM b GROUP BY 1)
SELECT d.doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN l USING (doc_id)
"""
