"""SQL of the queries of the general data problems."""

from __future__ import annotations

#: The abbreviations of the zones of the feeds, with their offsets in minutes.
ABBREVIATIONS = {
    "Europe/Berlin": {"CET": 60, "CEST": 120},
    "Europe/London": {"GMT": 0, "BST": 60},
    "America/New_York": {"EST": -300, "EDT": -240},
    "America/Chicago": {"CST": -360, "CDT": -300},
    "Australia/Sydney": {"AEST": 600, "AEDT": 660},
    "Asia/Kolkata": {"IST": 330},
    "Asia/Tokyo": {"JST": 540},
}
_ABBR = " ".join(f"WHEN zone = '{z}' AND upper(p.z) = '{a}' THEN {o}" for z, m in ABBREVIATIONS.items() for a, o in m.items())
_LOCAL = "(epoch_us(timezone(tz, make_timestamptz({0}))) - ({0}))"

#: Each bar's instant: null, -1 or microseconds. ICU's zone rules decide about wall times.
INSTANTS = f"""x AS (SELECT bar_id, b.timestamp AS raw, regexp_replace(b.timestamp, '^\\s+|\\s+$', '', 'g') AS s, zone, day_order FROM bars b LEFT JOIN feeds USING (exchange)),
f AS (SELECT *,
 regexp_extract(s, '^(\\d{{4}})[-/.]?(\\d{{2}})[-/.]?(\\d{{2}})[Tt ](\\d{{2}}):?(\\d{{2}}):?(\\d{{2}})(?:[.,](\\d{{1,9}}))? ?([Zz]|[+-]\\d{{2}}:?\\d{{2}}|[A-Z]{{2,5}})?(\\[.+\\])?$', ['y', 'm', 'd', 'h', 'mi', 's', 'f', 'z', 'n']) AS a,
 regexp_extract(s, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})(\\d{{2}})(\\d{{2}})(\\d{{2}})$', ['y', 'm', 'd', 'h', 'mi', 's']) AS c,
 regexp_extract(s, '^(\\d{{1,2}})[./](\\d{{1,2}})[./](\\d{{4}}) (\\d{{1,2}}):(\\d{{2}})(?::(\\d{{2}}))? ?([AP]M)?$', ['p', 'q', 'y', 'h', 'mi', 's', 'ap']) AS e,
 regexp_extract(s, '^(?:[A-Z][a-z]{{2}}, )?(\\d{{1,2}}) ([A-Z][a-z]{{2}}) (\\d{{4}}) (\\d{{2}}):(\\d{{2}}):(\\d{{2}}) ?([+-]\\d{{4}})?$', ['d', 'm', 'y', 'h', 'mi', 's', 'z']) AS g,
 regexp_extract(s, '^([A-Z][a-z]{{2}}) (\\d{{1,2}}), (\\d{{4}}) (\\d{{1,2}}):(\\d{{2}}):(\\d{{2}}) ([AP]M)$', ['m', 'd', 'y', 'h', 'mi', 's', 'ap']) AS k FROM x),
months AS (SELECT ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'] AS l),
q AS (SELECT bar_id, raw, s, zone, CASE
 WHEN a.y <> '' THEN {{'y': a.y, 'm': a.m, 'd': a.d, 'h': a.h, 'mi': a.mi, 's': a.s, 'f': a.f, 'z': a.z, 'n': a.n, 'ap': ''}}
 WHEN c.y <> '' THEN {{'y': c.y, 'm': c.m, 'd': c.d, 'h': c.h, 'mi': c.mi, 's': c.s, 'f': '', 'z': '', 'n': '', 'ap': ''}}
 WHEN e.y <> '' THEN {{'y': e.y, 'm': CASE WHEN day_order = 'dmy' THEN e.q ELSE e.p END, 'd': CASE WHEN day_order = 'dmy' THEN e.p ELSE e.q END, 'h': e.h, 'mi': e.mi, 's': CASE WHEN e.s = '' THEN '0' ELSE e.s END, 'f': '', 'z': '', 'n': '', 'ap': e.ap}}
 WHEN g.y <> '' THEN {{'y': g.y, 'm': CAST(list_position(l, g.m) AS VARCHAR), 'd': g.d, 'h': g.h, 'mi': g.mi, 's': g.s, 'f': '', 'z': g.z, 'n': '', 'ap': ''}}
 WHEN k.y <> '' THEN {{'y': k.y, 'm': CAST(list_position(l, k.m) AS VARCHAR), 'd': k.d, 'h': k.h, 'mi': k.mi, 's': k.s, 'f': '', 'z': '', 'n': '', 'ap': k.ap}}
 WHEN regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN {{'y': s[1:4], 'm': s[6:7], 'd': s[9:10], 'h': '0', 'mi': '0', 's': '0', 'f': '', 'z': 'Z', 'n': '', 'ap': ''}}
 END AS p FROM f, months),
w AS (SELECT bar_id, raw, s, zone, p, TRY_CAST(p.y || '-' || p.m || '-' || p.d AS DATE) AS day,
  CASE WHEN p.ap = '' THEN CAST(p.h AS INT) WHEN CAST(p.h AS INT) BETWEEN 1 AND 12 THEN CAST(p.h AS INT) % 12 + CASE WHEN p.ap = 'PM' THEN 12 ELSE 0 END END AS h, CAST(p.mi AS BIGINT) AS mi, CAST(p.s AS BIGINT) AS se, CAST(rpad(p.f, 6, '0')[1:6] AS BIGINT) AS fr,
  CASE WHEN p.z = '' THEN CASE WHEN p.n = '' THEN zone ELSE p.n[2:-2] END END AS tz,
  CASE WHEN upper(p.z) = 'Z' THEN 0 WHEN p.z[1] IN ('+', '-') THEN CASE WHEN p.z[1] = '-' THEN -1 ELSE 1 END * (CAST(p.z[2:3] AS INT) * 60 + CAST(p.z[-2:] AS INT)) {_ABBR} WHEN upper(p.z) IN ('UTC', 'GMT') THEN 0 END::BIGINT AS off FROM q),
v AS (SELECT *, CASE WHEN mi <= 59 AND se <= 59 AND (h <= 23 OR (h = 24 AND mi = 0 AND se = 0 AND fr = 0)) THEN epoch_us(CAST(day AS TIMESTAMP)) + h * 3600000000 + mi * 60000000 + se * 1000000 + fr END AS t FROM w),
o AS (SELECT *, t - {_LOCAL.format('t - 86400000000')} AS u1, t - {_LOCAL.format('t + 86400000000')} AS u2 FROM v),
r AS (SELECT *, u1 + {_LOCAL.format('u1')} = t AS ok1, u2 + {_LOCAL.format('u2')} = t AS ok2 FROM o),
inst AS (SELECT bar_id, raw, CASE WHEN raw IS NULL THEN NULL ELSE coalesce(CASE
 WHEN p IS NULL AND regexp_full_match(s, '\\d{{9,10}}(\\.\\d+)?') THEN CAST(CAST(s AS DECIMAL(30, 9)) * 1000000 AS BIGINT)
 WHEN p IS NULL AND regexp_full_match(s, '\\d{{11,13}}') THEN CAST(s AS BIGINT) * 1000
 WHEN p IS NULL AND regexp_full_match(s, '\\d{{14,16}}') THEN CAST(s AS BIGINT)
 WHEN p IS NULL AND regexp_full_match(s, '\\d{{17,19}}') THEN CAST(s AS BIGINT) // 1000
 WHEN off IS NOT NULL THEN t - off * 60000000
 WHEN u1 = u2 AND ok1 THEN u1 WHEN ok1 AND NOT ok2 THEN u1 WHEN ok2 AND NOT ok1 THEN u2 END, -1) END AS ts_us FROM r)"""

_SRC = "symbol, exchange, shard, timeframe"
_BARS = "SELECT 'bars.volume' AS field, symbol, exchange, shard, timeframe, ts_us, volume AS v, received_at AS seen_at, bar_id AS id FROM bars JOIN inst USING (bar_id)"
_BOOK = "k AS (SELECT symbol, exchange, shard, epoch_us(timestamp) AS bt, min(book_id) AS book_id FROM orderbook WHERE mid_price IS NOT NULL GROUP BY ALL)"
_TF = "CAST(timeframe[1:-2] AS BIGINT) * CASE timeframe[-1] WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END * 1000000"

ORACLES = {
    "p1_found": f"WITH {INSTANTS} SELECT bar_id, ts_us FROM inst WHERE raw IS NOT NULL AND NOT (regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}T([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\dZ') AND TRY_CAST(raw[1:10] AS DATE) IS NOT NULL)",
    # JSON numbers compare as doubles, fields by name, nulls as missing
    "p2_found": """WITH run AS (SELECT session_id, max(taken_at) AS run_at, arg_max(last_event_index, row(taken_at, snapshot_id)) AS top FROM runtime_snapshots WHERE status = 'committed' GROUP BY 1),
t AS (SELECT session_id, event_index, ingested_at, delivery_id, list_sort(list_filter(list_transform(json_keys(fields), lambda k: k || '=' || CAST(CAST(json_extract_string(fields, '$."' || k || '"') AS DOUBLE) AS VARCHAR)), lambda x: x IS NOT NULL))::VARCHAR AS v FROM tick_updates),
e AS (SELECT t.session_id, event_index, any_value(run.run_at) AS run_at, any_value(run.top) AS top, arg_max(v, row(ingested_at, delivery_id)) AS latest, arg_max(v, row(ingested_at, delivery_id)) FILTER (WHERE ingested_at <= run.run_at) AS before FROM t LEFT JOIN run ON t.session_id = run.session_id GROUP BY 1, 2)
SELECT session_id, event_index FROM e WHERE run_at IS NULL OR event_index > top OR before IS NULL OR before <> latest""",
    "p3_found": f"""WITH {INSTANTS}, a AS ({_BARS} WHERE ts_us <> -1 UNION ALL SELECT 'liquidations.value', symbol, exchange, shard, '', epoch_us(timestamp), value, received_at, liquidation_id FROM liquidations),
one AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY field, {_SRC}, ts_us ORDER BY seen_at DESC, id DESC) = 1),
days AS (SELECT field, {_SRC}, ts_us // 86400000000 AS day, sum(coalesce(CAST(round(v * 100) AS BIGINT), 0)) AS c FROM one GROUP BY ALL),
cal AS (SELECT field, {_SRC}, unnest(range(lo, hi + 1)) AS day FROM (SELECT field, {_SRC}, min(day) AS lo, max(day) AS hi FROM days GROUP BY ALL)),
s AS (SELECT cal.*, coalesce(c, 0) AS c FROM cal LEFT JOIN days USING (field, {_SRC}, day))
SELECT field, {_SRC}, strftime(DATE '1970-01-01' + CAST(day AS INT), '%Y-%m-%d') AS day, CAST(sum(c) OVER (PARTITION BY field, {_SRC} ORDER BY s.day ROWS 6 PRECEDING) AS BIGINT) AS total_7d_cents, CAST(sum(c) OVER (PARTITION BY field, {_SRC} ORDER BY s.day ROWS 29 PRECEDING) AS BIGINT) AS total_30d_cents FROM s""",
    "p4_found": f"""WITH {INSTANTS}, a AS (SELECT 'bars' AS tbl, bar_id AS record_id, symbol, exchange, shard, ts_us AS t FROM bars JOIN inst USING (bar_id) WHERE ts_us <> -1 UNION ALL SELECT 'liquidations', liquidation_id, symbol, exchange, shard, epoch_us(timestamp) FROM liquidations),
{_BOOK}, b AS (SELECT a.*, k.bt AS t0, k.book_id AS b0 FROM a ASOF LEFT JOIN k ON a.symbol = k.symbol AND a.exchange = k.exchange AND a.shard = k.shard AND a.t >= k.bt),
n AS (SELECT b.*, k.bt AS t1, k.book_id AS b1 FROM b ASOF LEFT JOIN k ON b.symbol = k.symbol AND b.exchange = k.exchange AND b.shard = k.shard AND b.t <= k.bt)
SELECT tbl, record_id, CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN b0 ELSE b1 END AS book_id FROM n WHERE least(coalesce(t - t0, 99e9), coalesce(t1 - t, 99e9)) <= 45000000""",
    "p5_found": f"""WITH {INSTANTS}, a AS (SELECT 'bars.close' AS field, {_SRC}, ts_us AS t FROM bars JOIN inst USING (bar_id) WHERE ts_us <> -1 AND "close" IS NOT NULL
 UNION ALL SELECT metric, {_SRC}, epoch_us(p.t) FROM (SELECT metric, {_SRC}, unnest(list_transform(range(1, len(timestamps) + 1), lambda i: {{'t': timestamps[i], 'v': vals[i], 'm': availability_mask IS NULL OR availability_mask[i]}})) AS p FROM metric_series) WHERE p.v IS NOT NULL AND p.m),
s AS (SELECT DISTINCT field, {_SRC}, t // ({_TF}) AS slot, {_TF} AS step FROM a),
g AS (SELECT *, lead(slot) OVER (PARTITION BY field, {_SRC} ORDER BY slot) AS nxt FROM s)
SELECT field, {_SRC}, CAST(x * step AS BIGINT) AS slot_us FROM (SELECT field, {_SRC}, step, unnest(range(slot + 1, nxt)) AS x FROM g WHERE nxt > slot + 1)""",
    "p5_grid": f"""WITH {INSTANTS}, a AS (SELECT 'bars.close' AS field, {_SRC}, ts_us AS t, "close" AS v, bar_id AS version FROM bars JOIN inst USING (bar_id) WHERE ts_us <> -1 AND "close" IS NOT NULL
 UNION ALL SELECT metric, {_SRC}, epoch_us(p.t), p.v, chunk_id FROM (SELECT metric, {_SRC}, chunk_id, unnest(list_transform(range(1, len(timestamps) + 1), lambda i: {{'t': timestamps[i], 'v': vals[i], 'm': availability_mask IS NULL OR availability_mask[i]}})) AS p FROM metric_series) WHERE p.v IS NOT NULL AND p.m),
rd AS (SELECT *, t // step AS slot, lead(t) OVER (PARTITION BY field, {_SRC} ORDER BY t, version) AS nxt FROM (SELECT *, {_TF} AS step FROM a)),
cl AS (SELECT *, unnest(range(slot, greatest(slot, coalesce((nxt - 1) // step, slot)) + 1)) AS cell FROM rd),
hd AS (SELECT *, greatest(0, least(coalesce(least(nxt, t + step), (slot + 1) * step), (cell + 1) * step) - greatest(t, cell * step)) AS held FROM cl)
SELECT field, {_SRC}, CAST(cell * step AS BIGINT) AS slot_us, CAST(sum(CAST(cell = slot AS BIGINT)) AS BIGINT) AS n_readings, round(CASE WHEN sum(held) > 0 THEN sum(v * held) / sum(held) END, 6) AS avg, round(sum(held) / step, 6) AS coverage FROM hd GROUP BY field, {_SRC}, step, cell""",
}
