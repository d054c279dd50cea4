"""Pieces of DuckDB SQL for the same logical tables, written independently of the operators where they differ in kind."""

from __future__ import annotations

from ..functions import text as T
from ..functions import tokens as K
from ..schemas import CACHE_READ, CACHE_WRITE, DEFAULT_PRICE, LANES, PRESSURE, PRICES, TIERS

S = K.SPACE
MODEL_LIST = "[" + ", ".join(f"'{p[0]}'" for p in PRICES) + "]"
TRIM = lambda x: rf"regexp_replace({x}, '\A[{S}]+|[{S}]+\z', '', 'g')"
DIV = lambda p: f"CASE {p} " + " ".join(f"WHEN '{n}' THEN CAST({v} AS DOUBLE)" for n, v in K.DIVISORS.items()) + f" ELSE CAST({K.DIVISORS['mixed']} AS DOUBLE) END"
NL = lambda c: f"(length({c}) - length(replace({c}, chr(10), '')))"


def tokens(src: str, name: str, col: str = "t", profile: str | None = None, out: str = "tokens") -> str:
    """CTEs from src to name: all its columns, prof (of col) and out (its tokens). col must not be null."""
    count = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
    prof = f"'{profile}'" if profile else f"""CASE WHEN length(b_) = 0 THEN 'prose'
 WHEN {count('b_', f'[^A-Za-z0-9+/={S}]')} = 0 AND length(b_) - {count('b_', f'[{S}]')} > {K.BASE64_LEAST} AND CAST({count('b_', f'[{S}]')} AS DOUBLE) / length(b_) < {K.BASE64_SPACE} THEN 'base64'
 WHEN b_[1] IN ('[', '{{') AND b_[-1] IN (']', '}}') AND CAST({count('s_', K.JSON_SIGNALS)} AS DOUBLE) / length(s_) > {K.JSON_DENSITY} THEN 'json'
 WHEN CAST({count('s_', K.CODE_SIGNALS)} AS DOUBLE) / length(s_) > {K.CODE_DENSITY} THEN 'code'
 WHEN regexp_matches(s_, '(?m){K.MARKDOWN}') THEN 'markdown'
 WHEN CAST({count('s_', K.CODE_SIGNALS)} AS DOUBLE) / length(s_) > {K.MIXED_DENSITY} THEN 'mixed' ELSE 'prose' END"""
    return f"""{name}_a AS (SELECT *, CASE WHEN contains({col}, chr(27)) THEN regexp_replace({col}, '{K.ANSI}', '', 'g') ELSE {col} END AS c_ FROM {src}),
{name}_b AS (SELECT *, substr(c_, 1, {K.SAMPLE}) AS s_, {TRIM(f'substr(c_, 1, {K.SAMPLE})')} AS b_ FROM {name}_a),
{name}_c AS (SELECT *, {prof} AS prof FROM {name}_b),
{name} AS (SELECT * EXCLUDE (c_, s_, b_), CAST(CASE WHEN c_ = '' THEN 0 ELSE greatest(1, ceil((length(c_) - {NL('c_')}) / ({DIV('prof')})) + {NL('c_')}) END AS BIGINT) AS {out} FROM {name}_c)"""


def terms(x: str) -> str:
    """The list of search terms of a text."""
    stop = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
    parts = r"regexp_extract_all(regexp_replace(replace(w, '_', ' '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+')"
    each = f"list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*|\\p{{Nd}}+'), lambda w: CASE WHEN len({parts}) > 1 THEN list_concat([lower(w)], list_transform({parts}, lambda p: lower(p))) ELSE [lower(w)] END)"
    return f"list_filter(flatten({each}), lambda t: length(t) > 1 AND NOT list_contains({stop}, t))"


def pressure(r: str) -> str:
    return "CASE " + " ".join(f"WHEN {r} < {p[1]} THEN '{p[0]}'" for p in PRESSURE[:-1]) + f" ELSE '{PRESSURE[-1][0]}' END"


def price(model: str, k: int) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({model}, '{p[0]}') THEN CAST({p[1 + k]!r} AS DOUBLE)" for p in PRICES) + f" ELSE CAST({DEFAULT_PRICE[k]!r} AS DOUBLE) END / 1e6"


def cost(model: str, i: str, o: str, r: str, w: str) -> str:
    a, b = price(model, 0), price(model, 1)
    return f"({i} * ({a}) + {o} * ({b}) + {r} * ({a}) * CAST({CACHE_READ} AS DOUBLE) + {w} * ({a}) * CAST({CACHE_WRITE} AS DOUBLE))"


CORPUS = "corpus AS (SELECT coalesce(source, 'none') || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS t FROM documents)"
LINES = "string_split({}, chr(10))"
MARKDOWN = f"""{CORPUS},
md AS (SELECT path, array_to_string(list_transform(string_split(t, chr(10)), lambda x, i: CASE WHEN (i - 1) % 11 = 6 THEN '```' || chr(10) || x WHEN (i - 1) % 4 = 0 THEN repeat('#', CAST(1 + ((i - 1) * 7 + length(x)) % 4 AS BIGINT)) || ' ' || x ELSE x END), chr(10)) AS t FROM corpus)"""
TURNS = "turns0 AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), " + tokens("turns0", "turns")
USAGE = f"""{TURNS},
u0 AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS input_tokens,
 CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, t ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS BIGINT) AS cache_read_tokens FROM turns),
u1 AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS message_id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS ts, CAST(conv_id AS VARCHAR) AS session_id, 'team' || CAST(conv_id % 5 AS VARCHAR) AS project,
 {MODEL_LIST}[CAST(conv_id % {len(PRICES)} AS INT) + 1] AS model, input_tokens, tokens AS output_tokens, cache_read_tokens, CAST(0 AS BIGINT) AS cache_write_tokens FROM u0 WHERE role = 'assistant'),
usage AS (SELECT *, {cost('model', 'input_tokens', 'output_tokens', 'cache_read_tokens', 'cache_write_tokens')} AS cost_usd FROM u1)"""
SINCE = "ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS"
OFFERS = "offers AS (SELECT CAST(event_id AS BIGINT) AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE event_type WHEN 'view' THEN 'suggested' ELSE 'read' END AS kind, CAST(user_id AS VARCHAR) AS path, CAST(floor(value * 100) AS BIGINT) AS tokens_full, CAST(floor(value * 10) AS BIGINT) AS tokens_served FROM events WHERE event_type IN ('view', 'click'))"
CLAIMS = f"""{OFFERS},
oo AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, id) AS n FROM offers),
rc AS (SELECT path, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(ts BIGINT, id BIGINT, f BIGINT)[]) AS st, CAST(NULL AS BIGINT) AS read_id, CAST(NULL AS BIGINT) AS offer_id, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS s FROM (SELECT DISTINCT path FROM oo)
 UNION ALL SELECT o.path, o.n, CASE WHEN o.kind = 'suggested' THEN list_append(rc.st, {{'ts': o.ts, 'id': o.id, 'f': o.tokens_full}}) WHEN len(rc.st) > 0 AND rc.st[-1].ts >= o.ts - 900 THEN list_slice(rc.st, 1, len(rc.st) - 1) ELSE CAST([] AS STRUCT(ts BIGINT, id BIGINT, f BIGINT)[]) END,
 CASE WHEN o.kind = 'read' AND len(rc.st) > 0 AND rc.st[-1].ts >= o.ts - 900 THEN o.id END, CASE WHEN o.kind = 'read' AND len(rc.st) > 0 AND rc.st[-1].ts >= o.ts - 900 THEN rc.st[-1].id END, o.ts, CASE WHEN len(rc.st) > 0 THEN rc.st[-1].f END, o.tokens_served
 FROM rc JOIN oo o ON o.path = rc.path AND o.n = rc.n + 1),
claims AS (SELECT read_id, offer_id, path, ts, f AS tokens_full, s AS tokens_served, greatest(f - s, 0) AS saved FROM rc WHERE read_id IS NOT NULL),
settled AS (SELECT o.id, o.ts, 'suggested' AS kind, o.path, o.tokens_full, o.tokens_served, CASE WHEN c.offer_id IS NULL THEN 0 ELSE 1 END AS claimed FROM offers o LEFT JOIN claims c ON c.offer_id = o.id WHERE o.kind = 'suggested' UNION ALL SELECT read_id, ts, 'accepted', path, tokens_full, tokens_served, 1 FROM claims)"""
REALIZED = "realized AS (SELECT path, count(*) FILTER (kind = 'suggested') AS offers, count(*) FILTER (kind = 'accepted') AS accepted, CAST(coalesce(sum(tokens_full - tokens_served) FILTER (kind = 'accepted'), 0) AS BIGINT) AS tokens_saved FROM settled GROUP BY path)"
FEATURES = r"""f0 AS (SELECT doc_id, lang, coalesce(source, 'none') AS source, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, len(regexp_extract_all(t, '[^ \t-\r]+')) AS a, (length(t) - length(replace(t, chr(10), ''))) % 15 AS d, CAST(length(t) % 101 AS DOUBLE) / 100 AS td, CAST(doc_id % 11 AS DOUBLE) / 10 AS b, doc_id % 6 AS e, doc_id % 9 AS u FROM f0),
raw AS (SELECT *, least(CAST(100 AS DOUBLE), CAST(25 AS DOUBLE) * CASE WHEN a <= 0 THEN 0 ELSE least(CAST(1 AS DOUBLE), ln(CAST(1 + a AS DOUBLE)) / ln(CAST(5001 AS DOUBLE))) END + CAST(20 AS DOUBLE) * least(d / CAST(12 AS DOUBLE), CAST(1 AS DOUBLE)) + CAST(20 AS DOUBLE) * td + CAST(15 AS DOUBLE) * b + CAST(10 AS DOUBLE) * least(e / CAST(5 AS DOUBLE), CAST(1 AS DOUBLE)) + CAST(10 AS DOUBLE) * least(u / CAST(8 AS DOUBLE), CAST(1 AS DOUBLE))) AS raw FROM f),
scored AS (SELECT *, """ + "CASE " + " ".join(f"WHEN ceil(round(raw, 2)) <= {t[2]} THEN '{t[0]}'" for t in TIERS[:-1]) + f" ELSE '{TIERS[-1][0]}' END AS tier FROM raw)"
ADMITTED = f"""{FEATURES},
cap(tier, cap, ocap) AS (VALUES {', '.join(f"('{t[0]}', {t[3]}, {t[4]})" for t in TIERS)}),
{tokens('scored', 'e0', out='n0')},
e1 AS (SELECT e0.* EXCLUDE (tier, prof), CASE WHEN doc_id % 89 = 0 THEN 'nowhere' ELSE e0.tier END AS tier, doc_id % 97 = 0 AS unscored, {MODEL_LIST}[CAST(doc_id % {len(PRICES)} AS INT) + 1] AS model FROM e0),
e2 AS (SELECT e1.*, cap.cap, cap.ocap, CASE WHEN unscored THEN 'MISSING_SCORE' WHEN cap.cap IS NULL THEN 'INVALID_TIER' END AS refused FROM e1 LEFT JOIN cap ON cap.tier = e1.tier),
e3 AS (SELECT *, refused IS NULL AND n0 > cap AS o0, CASE WHEN refused IS NULL AND n0 > cap THEN substr(t, 1, cap * 4) ELSE t END AS t1 FROM e2),
{tokens('e3', 'e4', 't1', out='n1')},
e5 AS (SELECT * EXCLUDE (prof), o0 AND n1 >= n0 AS x1, o0 AND n1 < n0 AND n1 > cap AS o1, CASE WHEN o0 AND n1 < n0 AND n1 > cap THEN substr(t1, 1, cap * 4) ELSE t1 END AS t2 FROM e4),
{tokens('e5', 'e6', 't2', out='n2')},
adm0 AS (SELECT *, o1 AND n2 >= n1 AS x2, o1 AND n2 < n1 AND n2 > cap AS o2 FROM e6),
adm AS (SELECT *, refused IS NULL AND NOT x1 AND NOT x2 AND NOT o2 AS ok, CASE WHEN o1 THEN 2 WHEN o0 THEN 1 ELSE 0 END AS attempt, CASE WHEN o1 THEN n2 WHEN o0 THEN n1 ELSE n0 END AS n FROM adm0),
ev AS (SELECT doc_id, source, lang, tier, 'admission' AS gate, 'blocked' AS decision, n0 AS cand, 0 AS adm, n0 AS rej, refused AS reason, 0 AS att FROM adm WHERE refused IS NOT NULL
 UNION ALL SELECT doc_id, source, lang, tier, 'compression', 'recompress', n0, 0, n0 - cap, 'TIER_INPUT_CAP_EXCEEDED', 0 FROM adm WHERE o0
 UNION ALL SELECT doc_id, source, lang, tier, 'compression', 'blocked', n0, 0, n1, 'RECOMPRESSION_NO_PROGRESS', 1 FROM adm WHERE x1
 UNION ALL SELECT doc_id, source, lang, tier, 'compression', 'recompress', n0, 0, n1 - cap, 'TIER_INPUT_CAP_EXCEEDED', 1 FROM adm WHERE o1
 UNION ALL SELECT doc_id, source, lang, tier, 'compression', 'blocked', n0, 0, n2, 'RECOMPRESSION_NO_PROGRESS', 2 FROM adm WHERE x2
 UNION ALL SELECT doc_id, source, lang, tier, 'compression', 'recompress', n0, 0, n2 - cap, 'TIER_INPUT_CAP_EXCEEDED', 2 FROM adm WHERE o2
 UNION ALL SELECT doc_id, source, lang, tier, 'compression', 'blocked', n0, 0, n2, 'RECOMPRESSION_EXHAUSTED', 2 FROM adm WHERE o2
 UNION ALL SELECT doc_id, source, lang, tier, 'admission', 'admitted', n0, n, greatest(n0 - n, 0), 'WITHIN_TIER_AND_COST_BUDGET', attempt FROM adm WHERE ok)"""
LOG = "log AS (SELECT CAST(event_id AS VARCHAR) AS change_id, event_id, ts, CAST(user_id AS VARCHAR) AS artifact_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)"
CHUNKS = f"""{CORPUS},
cl AS (SELECT path, {LINES.format('t')} AS l FROM corpus WHERE len(regexp_extract_all(t, '[^{S}]')) > 0),
cp AS (SELECT path, l, list_transform(range(0, len(l) + 1), lambda k: coalesce(list_sum(list_transform(list_slice(l, 1, k), lambda x: CASE WHEN x = '' THEN 1 ELSE greatest(1, ceil(length(x) / CAST(3.2 AS DOUBLE))) + 1 END)), 0)) AS pre FROM cl),
cw AS (SELECT path, l, pre, CAST(0 AS BIGINT) AS cur, greatest(1, len(list_filter(pre, lambda v: v <= 512)) - 1) AS fin FROM cp
 UNION ALL SELECT path, l, pre, greatest(fin - 4, cur + 1), greatest(greatest(fin - 4, cur + 1) + 1, len(list_filter(pre, lambda v: v <= pre[greatest(fin - 4, cur + 1) + 1] + 512)) - 1) FROM cw WHERE fin < len(l)),
cc AS (SELECT path || '#' || CAST(cur + 1 AS VARCHAR) || '-' || CAST(fin AS VARCHAR) AS id, path, CAST(cur + 1 AS INT) AS s, CAST(fin AS INT) AS e, array_to_string(list_slice(l, cur + 1, fin), chr(10)) AS t FROM cw),
{tokens('cc', 'chunks')}"""
