"""The SQL that states each query's result, straight on the given tables. It never sees the raw text."""

from __future__ import annotations

from tapelake.operators.registry_rules import DEFECT_CODES
from tapelake.plans.encode import PREFIXES
from tapelake.schema import MAIN_PREFIXES, STREAMS

_CODES = ", ".join(f"'{c}'" for c in DEFECT_CODES)
_ALL = ", ".join(f"'{s}'" for s in STREAMS)

_SESSION = "(ms >= 34200000 AND ms < 41400000 OR ms >= 46800000 AND ms < 53820000)"
_STREAM = ("CASE WHEN event_type IN ('click', 'signup') THEN 'orders' WHEN event_type IN ('view', 'error') THEN 'trades' "
           "ELSE 'xinqing' END")


def _symbol(key: str) -> str:
    return (f"lpad(CAST({key} % 1000000 AS VARCHAR), 6, '0') || CASE WHEN {key} % 2 = 0 THEN '.SZ' ELSE '.SH' END")


_RAW = f"""raw AS (
  SELECT event_id, user_id, CAST(ts AS DATE) AS d, strftime(ts, '%Y-%m-%d') AS day, {_STREAM} AS stream,
    {_symbol('user_id')} AS symbol, (epoch_us(ts) // 1000) % 86400000 AS ms, hour(ts) AS h,
    CASE WHEN event_id % 16 = 3 THEN 1201800 WHEN event_id % 16 = 6 THEN 42 WHEN event_id % 16 = 7 THEN -150
         WHEN event_id % 16 = 9 THEN 2151938037 WHEN event_id % 16 < 9 THEN NULL
         ELSE CAST(round(value * 10000) AS BIGINT) END AS price,
    CASE event_id % 16 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 11 WHEN 4 THEN 16 WHEN 5 THEN 20 WHEN 6 THEN 4
         WHEN 7 THEN 8 WHEN 8 THEN 2 WHEN 9 THEN 10
         ELSE length(CAST(CAST(round(value * 10000) AS BIGINT) AS VARCHAR)) END AS price_len,
    upper(substr(event_type, 1, 1)) AS type,
    CASE event_id % 8 WHEN 0 THEN '00' WHEN 1 THEN '20' ELSE hex(substr(event_type, 2, 1)) END AS side,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS vol
  FROM events)"""

_REG = f"""reg AS (
  SELECT p_partkey AS k, p_name, p_type, 'P' || p_partkey AS id, p_size,
    list_extract([{_CODES}], CAST(p_partkey % {len(DEFECT_CODES)} AS INTEGER) + 1) AS code,
    CASE p_size % 4 WHEN 1 THEN 'orders' WHEN 2 THEN 'trades' WHEN 3 THEN 'xinqing' END AS stream,
    p_partkey % 4 <> 0 AS scoped, DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS d1,
    DATE '2024-01-01' + CAST(p_size % 30 AS INTEGER) AS d2,
    list_extract(['active', 'pending', 'rejected', 'active', 'active'], CAST(p_partkey % 5 AS INTEGER) + 1) AS status,
    CASE WHEN p_partkey % 4 = 0 THEN 'none'
         ELSE list_extract(['patch', 'gap', 'none'], CAST(p_partkey % 3 AS INTEGER) + 1) END AS action
  FROM part),
act AS (SELECT k, id, code, action, scoped, d1, d2, s.stream FROM reg JOIN (SELECT unnest([{_ALL}]) AS stream) s
        ON (reg.stream IS NULL OR reg.stream = s.stream) WHERE status = 'active'),
scoped AS (SELECT k, id, code, action, stream, d1 AS d FROM act WHERE scoped
           UNION SELECT k, id, code, action, stream, d2 FROM act WHERE scoped),
patched AS (SELECT DISTINCT d, stream FROM scoped WHERE code = 'time_6digit' AND action = 'patch')"""

_LADDER = ", ".join(f"user_id * 10 + {first + level} AS {name}_{level + 1}" for name, first in
                    (("ask_px", 18), ("ask_sz", 28), ("bid_px", 38), ("bid_sz", 48)) for level in range(10))

_KEYS = "keys AS (SELECT DISTINCT d, day, stream FROM raw)"

_GAP_CODES = """CASE WHEN day = '2024-01-05' THEN 'rescue_partial,seq_empty' WHEN day = '2024-01-07' THEN 'seq_empty'
  WHEN day = '2024-02-06' THEN 'rescue_partial' ELSE '' END"""

_WORD = ("list_extract([" + ", ".join(f"'{p}'" for p in PREFIXES) + "], CAST(user_id % 10 AS INTEGER) + 1) || "
         "lpad(CAST((user_id // 10) % 1000 AS VARCHAR), 3, '0') || CASE WHEN user_id % 2 = 0 THEN '.SZ' ELSE '.SH' END")
_MAIN = ", ".join(f"'{p}'" for p in MAIN_PREFIXES)
_LISTED = f"""listed AS (
  SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%d') AS ymd, {_STREAM} AS stream, {_WORD} AS symbol,
    user_id % 50 AS u FROM events),
files AS (
  SELECT DISTINCT day, ymd, stream, symbol, user_id, u,
    (u = 10 AND stream = 'xinqing') OR (u = 11 AND stream = 'orders') AS emptied,
    '万得代码,' || CASE WHEN u = 13 AND stream = 'trades' THEN 'traded' ELSE stream END || ',时间,c4,c5,' AS header,
    CASE stream WHEN 'orders' THEN '逐笔委托.csv' WHEN 'trades' THEN '逐笔成交.csv' ELSE '行情.csv' END AS name FROM listed),
kept AS (SELECT * FROM files WHERE substr(symbol, 1, 3) IN ({_MAIN})),
by_symbol AS (SELECT day, symbol, count(DISTINCT stream) AS n, list_sort(list(DISTINCT stream)) AS streams FROM kept GROUP BY ALL)"""

_TREES = f"""{_RAW},
trees AS (
  SELECT raw.* EXCLUDE (symbol), list_extract([{", ".join(f"'{p}'" for p in PREFIXES)}], CAST(user_id % 10 AS INTEGER) + 1)
    || lpad(CAST(user_id % 20 AS VARCHAR), 3, '0') || CASE WHEN user_id % 2 = 0 THEN '.SZ' ELSE '.SH' END AS symbol,
    strftime(d, '%Y%m%d') AS ymd, day(d) % 7 = 3 AND event_id % 50 = 0 AS spoilt,
    CASE WHEN event_id % 16 < 10 THEN list_extract(['', ' ', chr(0), '1.2018e+006', '9007199254740993', '18446744073709551615',
      ' 42 ', '-1.5e+02', '1d', '2151938037'], CAST(event_id % 16 AS INTEGER) + 1) ELSE CAST(price AS VARCHAR) END AS price_text,
    CAST(h * 10000000 + (ms // 60000 % 60) * 100000 + ms % 60000 AS VARCHAR) AS clock FROM raw),
kept AS (
  SELECT *, symbol || ',x,' || ymd || ',' || lpad(clock, CASE WHEN h < 10 THEN 8 ELSE 9 END, '0') || ',' || price_text || ',' || event_id
    || CASE WHEN spoilt THEN '"' ELSE '' END AS line FROM trees WHERE substr(symbol, 1, 3) IN ({_MAIN})),
outcomes AS (SELECT t.day, t.ymd, count(DISTINCT k.stream || ' ' || k.symbol) AS n, min(k.stream || ' ' || k.symbol) AS place
  FROM (SELECT DISTINCT day, ymd FROM trees) t LEFT JOIN kept k ON t.day = k.day AND k.spoilt GROUP BY t.day, t.ymd)"""

_WAY = "event_id % 6"
_SHORT_LEN = "CASE WHEN h < 10 THEN 5 ELSE 6 END"
_LONG_LEN = "CASE WHEN h < 10 THEN 8 ELSE 9 END"

_CENTS = "CAST(round(l_extendedprice * 100) AS HUGEINT)"
_SHAPE = "(l_orderkey + l_linenumber + l_suppkey) % 14"

_CHAIN = """nodes AS (
  SELECT 'P' || p_partkey AS id, p_partkey AS k,
    CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 89 = 1 THEN 'X' || p_partkey WHEN p_partkey % 83 = 2 THEN 'P' || p_partkey
         WHEN p_partkey > 0 THEN 'P' || (p_partkey // 2) END AS nxt FROM part),
judged AS (
  SELECT id, nxt, CASE WHEN k % 79 = 3 THEN 'rejected' WHEN nxt IS NOT NULL THEN 'superseded' WHEN k % 5 = 0 THEN 'superseded'
    ELSE 'active' END AS status FROM nodes),
steps AS (
  SELECT a.id, a.nxt, CASE WHEN a.nxt IS NOT NULL AND (b.id IS NULL OR b.status = 'rejected') THEN 'supersede chain is broken'
    WHEN a.nxt IS NULL AND a.status NOT IN ('active', 'pending') THEN 'supersede chain ends in no live entry'
    WHEN a.nxt IS NULL THEN 'ok' END AS e
  FROM judged a LEFT JOIN judged b ON a.nxt = b.id),
walk AS (
  SELECT id AS start, id AS cur FROM steps WHERE nxt IS NOT NULL
  UNION SELECT w.start, s.nxt FROM walk w JOIN steps s ON w.cur = s.id WHERE s.e IS NULL)"""


def _rule(name: str, condition: str) -> str:
    return f"SELECT id, '{name}' AS problem FROM f WHERE code IS NOT NULL AND ({condition})"


_FAULTY = """f AS (
  SELECT k, CASE WHEN k % 101 = 3 THEN 'P3' ELSE id END AS id,
    CASE WHEN k % 103 = 4 THEN 'odd' WHEN k % 107 = 5 THEN 'shape' ELSE 'defect' END AS kind,
    CASE WHEN k % 109 = 6 THEN 'bonds' ELSE stream END AS stream,
    CASE WHEN k % 113 = 7 THEN 'no_such_code' WHEN k % 127 = 8 THEN NULL ELSE code END AS code,
    k % 131 = 9 AS pointed, k % 137 = 10 AS odd_date, k % 139 = 11 AS odd_day,
    (scoped OR k % 139 = 11) AND NOT (k % 149 = 12 AND k % 139 <> 11) AS has_days, k % 151 = 13 AS odd_evidence,
    k % 157 = 14 AS odd_decision, status, action FROM reg)"""

_DOCS = f"""named AS (
  SELECT doc_id AS k, text, source, lang, CASE WHEN doc_id % 31 = 1 THEN '../' ELSE '' END || 'doc_' || doc_id || '.toml' AS file,
    list_extract([{_CODES}, 'odd'], CAST(doc_id % 14 AS INTEGER) + 1) AS code FROM documents),
batches AS (
  SELECT *, CASE WHEN k % 23 = 3 THEN 'scripts/scan' WHEN k % 19 = 4 THEN 'external:probe' ELSE 'tools/scan' END AS scanner
  FROM named WHERE k % 29 <> 2),
live AS (SELECT DISTINCT code FROM reg WHERE status IN ('active', 'pending'))"""

SQL: dict[str, str] = {
    "typed_scan": f"""WITH {_RAW} SELECT day, symbol, ms AS time_ms, event_id AS oid, type, side, price, vol FROM raw
        WHERE stream = 'orders'""",
    "typed_scan_session": f"""WITH {_RAW} SELECT day, symbol, event_id AS oid, type, side, price, vol FROM raw
        WHERE stream = 'orders' AND {_SESSION}""",
    "store_read_session": f"""WITH {_RAW} SELECT day, symbol, ms AS time_ms, price AS seq, price, vol, user_id AS ask_ref,
        event_id % 1000 AS bid_ref FROM raw WHERE stream = 'trades' AND {_SESSION}""",
    "store_read_symbols": f"""WITH {_RAW} SELECT day, symbol, ms AS time_ms, event_id AS oid, vol FROM raw
        WHERE stream = 'orders' AND symbol IN (SELECT {_symbol('s_suppkey')} FROM supplier)""",
    "store_read_long_list": f"""WITH {_RAW} SELECT day, symbol, event_id AS oid, vol FROM raw
        WHERE stream = 'orders' AND CAST(left(symbol, 6) AS INTEGER) % 40 < 2""",
    "store_quotes": f"WITH {_RAW} SELECT day, symbol, ms AS time_ms, price AS last_price, {_LADDER} FROM raw WHERE stream = 'xinqing'",
    "store_gaps": f"""WITH {_RAW},
        days AS (SELECT day FROM raw GROUP BY day HAVING count(DISTINCT stream) = 3),
        absent AS (SELECT day, 'symbol_absent' AS reason, symbol FROM days, (SELECT DISTINCT symbol FROM raw)
                   EXCEPT SELECT day, 'symbol_absent', symbol FROM raw WHERE stream = 'orders'),
        gaps AS (SELECT * FROM absent UNION ALL SELECT unnest(['2024-02-06', '2024-02-07']), 'day_missing', NULL)
        SELECT day, 'orders' AS stream, reason, symbol, {_GAP_CODES} AS defects FROM gaps""",
    "store_order": f"""WITH {_RAW} SELECT day, row_number() OVER (PARTITION BY day ORDER BY symbol, event_id) - 1 AS place, symbol, event_id
        FROM raw WHERE stream = 'orders'""",
    "store_ordered_read": f"WITH {_RAW} SELECT day, symbol, price AS last_price FROM raw WHERE stream = 'xinqing'",
    "store_placed_read": f"""WITH {_RAW} SELECT day, symbol, event_id AS oid, vol,
        row_number() OVER (ORDER BY day DESC, symbol, event_id) - 1 AS place FROM raw WHERE stream = 'orders'""",
    "store_physical_text": f"""WITH {_RAW} SELECT day, price_len AS len, event_id % 16 = 2 AS is_nul, count(*) AS n FROM raw
        WHERE stream = 'orders' GROUP BY ALL""",
    "store_compare": f"""WITH {_RAW}, g AS (
          SELECT stream, day, count(*) AS rows_a, count(*) FILTER (WHERE event_id % 1999 <> 7) AS rows_b,
            count(*) FILTER (WHERE event_id % 89 = 1) + count(*) FILTER (WHERE event_id % 83 = 2) AS emptied,
            count(*) FILTER (WHERE event_id % 97 = 0) AS changed FROM raw GROUP BY ALL)
        SELECT stream, day, rows_a, rows_b, true AS schema_equal, CAST(0 AS BIGINT) AS nulls_a,
          CASE WHEN rows_a = rows_b THEN emptied ELSE 0 END AS nulls_b,
          CASE WHEN rows_a = rows_b THEN emptied + changed ELSE 0 END AS cells_differ,
          rows_a = rows_b AND emptied + changed = 0 AS identical_modulo_null FROM g""",
    "store_days": f"""WITH {_RAW} SELECT day, 'unverified' AS quality FROM raw GROUP BY day HAVING count(DISTINCT stream) = 3""",
    "footer_catalog": f"""WITH {_RAW} SELECT stream, day, count(*) AS rows, min(symbol) AS symbol_min, max(symbol) AS symbol_max
        FROM raw GROUP BY stream, day""",
    "decode_int_shapes": f"""WITH t AS (SELECT CAST({_SHAPE} AS INTEGER) AS shape, {_CENTS} AS c FROM lineitem),
        v AS (SELECT shape, CASE WHEN shape IN (0, 1, 2, 3, 4, 7, 11) THEN c WHEN shape = 5 THEN -c WHEN shape = 12 THEN c * 10
          WHEN shape = 10 AND CAST(CAST(c * 1000000000 + 1 AS DOUBLE) AS HUGEINT) = c * 1000000000 + 1 THEN c * 1000000000 + 1
          WHEN shape = 13 AND CAST(CAST(c * 100000000000000 + 99999999999999 AS DOUBLE) AS HUGEINT) = c * 100000000000000 + 99999999999999
          THEN c * 100000000000000 + 99999999999999 END AS v FROM t)
        SELECT shape, count(*) AS n, count(v) AS n_value, CAST(sum(v % 1000003) AS BIGINT) AS checksum FROM v GROUP BY shape""",
    "decode_time_lengths": f"""WITH {_RAW}, {_REG} SELECT raw.day, symbol, raw.event_id,
        CASE WHEN {_WAY} IN (0, 5) THEN ms WHEN {_WAY} IN (1, 2) AND p.d IS NOT NULL THEN ms - ms % 1000 END AS time_ms
        FROM raw LEFT JOIN patched p ON raw.d = p.d AND raw.stream = p.stream""",
    "short_time_days": f"""WITH {_RAW}, {_REG} SELECT raw.day, raw.stream, count(*) AS n FROM raw
        LEFT JOIN patched p ON raw.d = p.d AND raw.stream = p.stream WHERE p.d IS NULL AND {_WAY} IN (1, 2) GROUP BY ALL""",
    "time_shape_histogram": f"""WITH {_RAW} SELECT day, stream, CAST(CASE WHEN {_WAY} IN (0, 5) THEN {_LONG_LEN} WHEN {_WAY} IN (1, 2)
        THEN {_SHORT_LEN} WHEN {_WAY} = 3 THEN 10 ELSE -1 END AS INTEGER) AS len, count(*) AS count FROM raw GROUP BY ALL""",
    "time_shapes_resumed": f"""WITH {_RAW} SELECT strftime(d, '%Y%m%d') AS day, stream, CAST({_LONG_LEN} AS INTEGER) AS len,
        count(*) AS count FROM raw GROUP BY ALL""",
    "pending_shapes": f"""WITH {_RAW} SELECT day, stream FROM raw GROUP BY day, stream
        HAVING count(*) FILTER (WHERE price > 2500000) = 0""",
    "symbol_stream_differences": f"""WITH {_RAW}, s AS (SELECT DISTINCT day, symbol, stream FROM raw),
        n AS (SELECT day, symbol FROM s GROUP BY day, symbol HAVING count(*) < 3) SELECT day, stream, symbol FROM s JOIN n USING (day, symbol)""",
    "symbols_only_in_stream": f"""WITH {_RAW}, s AS (SELECT DISTINCT day, symbol, stream FROM raw),
        n AS (SELECT day, symbol FROM s GROUP BY day, symbol HAVING count(*) < 3)
        SELECT day, stream, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM s JOIN n USING (day, symbol) GROUP BY day, stream""",
    "copy_compare": f"""WITH {_RAW}, c AS (
        SELECT day, stream, 'column_9' AS "column", 0 AS nulls_b, count(*) FILTER (WHERE event_id % 97 = 0) AS cells_differ FROM raw GROUP BY ALL
        UNION ALL SELECT day, stream, 'column_8', count(*) FILTER (WHERE event_id % 89 = 1), count(*) FILTER (WHERE event_id % 89 = 1)
        FROM raw GROUP BY ALL
        UNION ALL SELECT day, stream, 'column_10', count(*) FILTER (WHERE event_id % 83 = 2), count(*) FILTER (WHERE event_id % 83 = 2)
        FROM raw GROUP BY ALL
        UNION ALL SELECT day, stream, 'column_13', count(*) FILTER (WHERE event_id % 2 = 0), 0 FROM raw GROUP BY ALL)
        SELECT * FROM c WHERE nulls_b > 0 OR cells_differ > 0""",
    "registry_entries_for_day": f"""WITH {_RAW}, {_REG}, {_KEYS}
        SELECT day, keys.stream, id, code, false AS structural FROM keys JOIN scoped ON keys.d = scoped.d AND keys.stream = scoped.stream
        UNION ALL SELECT day, keys.stream, id, code, true FROM keys JOIN act ON keys.stream = act.stream WHERE NOT act.scoped""",
    "registry_patches_for_day": f"""WITH {_RAW}, {_REG}, {_KEYS} SELECT day, keys.stream, id, code FROM keys
        JOIN scoped ON keys.d = scoped.d AND keys.stream = scoped.stream WHERE action = 'patch'""",
    "registry_defect_codes": f"""WITH {_RAW}, {_REG}, {_KEYS},
        first AS (SELECT d, stream, code, min(k) AS k FROM scoped WHERE action <> 'none' GROUP BY ALL)
        SELECT day, keys.stream, coalesce(string_agg(code, ',' ORDER BY k), '') AS defects FROM keys
        LEFT JOIN first ON keys.d = first.d AND keys.stream = first.stream GROUP BY day, keys.stream""",
    "registry_rule_problems": f"WITH {_REG}, {_FAULTY} SELECT id, 'missing code' AS problem FROM f WHERE code IS NULL UNION ALL " + " UNION ALL ".join([
        _rule("kind, status or action outside its values", "kind = 'odd'"),
        _rule("unknown stream", "stream = 'bonds'"),
        _rule("unknown code", "code = 'no_such_code' AND status IN ('active', 'pending')"),
        _rule("superseded and superseded_by go together", "pointed"),
        _rule("created_at is no exact date", "odd_date"),
        _rule("days hold no exact date", "odd_day"),
        _rule("patch and gap need days", "action IN ('patch', 'gap') AND NOT has_days"),
        _rule("an active shape needs decision_ref", "kind = 'shape' AND status = 'active'"),
        _rule("evidence_sha256 is no digest", "odd_evidence"),
        _rule("decision_sha256 is no digest", "odd_decision"),
        _rule("patch code without handler", "action = 'patch' AND code <> 'time_6digit'"),
        _rule("decision_ref and decision_sha256 go together", "odd_decision"),
    ]) + " UNION ALL SELECT id, 'repeated id' FROM f GROUP BY id HAVING count(*) > 1",
    "registry_chain_problems": f"""WITH RECURSIVE {_CHAIN}, ends AS (
        SELECT w.start, coalesce(max(s.e), 'supersede chain circles') AS e FROM walk w LEFT JOIN steps s ON w.cur = s.id GROUP BY w.start)
        SELECT start AS id, e AS problem FROM ends WHERE e <> 'ok'""",
    "registry_snapshot_problems": f"""WITH {_REG}, left_over AS (SELECT * FROM reg WHERE k % 61 <> 1)
        SELECT id, 'entry deleted' AS problem FROM reg WHERE k % 61 = 1
        UNION ALL SELECT id, 'status change not allowed' FROM left_over WHERE k % 7 = 0 AND k % 5 = 3
        UNION ALL SELECT id, 'note changed' FROM left_over WHERE k % 59 = 2
        UNION ALL SELECT id, 'code changed' FROM left_over WHERE k % 67 = 1
        UNION ALL SELECT id, 'kind changed' FROM left_over WHERE k % 71 = 2
        UNION ALL SELECT id, 'created_at changed' FROM left_over WHERE k % 73 = 3
        UNION ALL SELECT id, 'evidence changed' FROM left_over WHERE k % 79 = 4
        UNION ALL SELECT id, 'evidence_sha256 changed' FROM left_over WHERE k % 83 = 5
        UNION ALL SELECT id, 'read_layer_action changed' FROM left_over WHERE k % 89 = 8
        UNION ALL SELECT id, 'decision_ref changed' FROM left_over WHERE k % 41 = 6 AND k % 4 = 1
        UNION ALL SELECT id, 'decision_sha256 changed' FROM left_over WHERE k % 43 = 7 AND k % 4 = 1
        UNION ALL SELECT id, 'superseded_by changed' FROM left_over WHERE k % 47 = 9 AND k % 4 = 2
        UNION ALL SELECT id, 'stream scope changed' FROM left_over WHERE k % 53 = 3 AND stream IS NOT NULL
        UNION ALL SELECT id, CASE WHEN scoped THEN 'days removed' ELSE 'structural entry narrowed to days' END FROM left_over
          WHERE k % 47 = 4
        UNION ALL SELECT 'N' || k, 'new entry not pending' FROM reg WHERE k % 37 = 0 AND status <> 'pending'""",
    "observed_unregistered": f"""WITH {_REG}, o AS (SELECT CASE WHEN l_partkey % 17 < 13
        THEN list_extract([{_CODES}], CAST(l_partkey % 17 AS INTEGER) + 1) ELSE 'odd_' || (l_partkey % 17) END AS code FROM lineitem)
        SELECT code, count(*) AS n FROM o WHERE code NOT IN (SELECT code FROM reg WHERE status IN ('active', 'pending')) GROUP BY code""",
    "code_sets_differ": f"""WITH {_REG}, o AS (SELECT DISTINCT CASE WHEN l_partkey % 17 < 13
        THEN list_extract([{_CODES}], CAST(l_partkey % 17 AS INTEGER) + 1) ELSE 'odd_' || (l_partkey % 17) END AS code FROM lineitem),
        declared AS (SELECT code FROM o WHERE code <> 'seq_empty'),
        live AS (SELECT DISTINCT code FROM reg WHERE status IN ('active', 'pending'))
        SELECT code, 'declared only' AS side FROM declared WHERE code NOT IN (SELECT code FROM live)
        UNION ALL SELECT code, 'registry only' FROM live WHERE code NOT IN (SELECT code FROM declared)""",
    "observation_batches": f"""WITH {_REG}, {_DOCS}
        SELECT file, 'missing input_sha256' AS problem FROM batches WHERE k % 17 = 5
        UNION ALL SELECT file, 'file is no plain name' FROM batches WHERE k % 31 = 1
        UNION ALL SELECT file, 'scanner is neither a tool nor external' FROM batches WHERE scanner = 'scripts/scan'
        UNION ALL SELECT file, 'external scanner without digest' FROM batches WHERE scanner = 'external:probe' AND k % 2 = 0
        UNION ALL SELECT file, 'file missing' FROM batches WHERE k % 13 = 6
        UNION ALL SELECT file, 'file altered' FROM batches WHERE k % 13 <> 6 AND k % 11 = 7 AND text <> 'altered'
        UNION ALL SELECT file, 'file in no batch' FROM named WHERE k % 29 = 2 AND k % 13 <> 6
        UNION ALL SELECT file, 'unregistered code ' || code FROM batches WHERE k % 13 <> 6 AND code NOT IN (SELECT code FROM live)""",
    "ingest_receipts": f"""WITH {_LISTED}, n AS (SELECT day, stream, symbol, count(*) AS n FROM listed GROUP BY ALL)
        SELECT day, stream, count(*) FILTER (WHERE NOT emptied) AS n_symbols,
          CAST(sum(CASE WHEN emptied THEN 0 ELSE n END) AS BIGINT) AS n_rows_csv, min(hex(header)) FILTER (WHERE NOT emptied) AS header_hex
        FROM kept JOIN n USING (day, stream, symbol) GROUP BY day, stream""",
    "ingest_quote_only": f"WITH {_LISTED} SELECT day, symbol FROM by_symbol WHERE streams = ['xinqing']",
    "ingest_dropped": f"""WITH {_LISTED} SELECT day, substr(symbol, 1, 3) AS prefix, count(DISTINCT symbol) AS symbols FROM files
        WHERE substr(symbol, 1, 3) NOT IN ({_MAIN}) GROUP BY ALL""",
    "ingest_path_problems": f"""WITH {_LISTED}, lacking AS (
          SELECT day, symbol, s.stream FROM by_symbol, (SELECT unnest([{_ALL}]) AS stream) s
          WHERE n < 3 AND streams <> ['xinqing'] AND NOT list_contains(streams, s.stream))
        SELECT day, 'symbol lacks a stream' AS problem, symbol || ' ' || string_agg(stream, ' ' ORDER BY stream) AS detail
          FROM lacking GROUP BY day, symbol
        UNION ALL SELECT DISTINCT day, 'unregistered file name', ymd || '/' || symbol || '/readme.txt' FROM files WHERE u = 7
        UNION ALL SELECT DISTINCT day, 'unregistered path', 'a/' || ymd || '/' || symbol || '/' || name FROM files WHERE u = 8
        UNION ALL SELECT DISTINCT day, 'malformed symbol folder', 'X' || symbol || '/' || name FROM files WHERE u = 9
        UNION ALL SELECT d.day, 'stream without any file', d.stream
          FROM (SELECT DISTINCT listed.day, s.stream FROM listed, (SELECT unnest([{_ALL}]) AS stream) s) d
          ANTI JOIN kept ON d.day = kept.day AND d.stream = kept.stream""",
    "ingest_file_problems": f"""WITH {_LISTED}, rows AS (SELECT event_id, kept.day, kept.stream, kept.symbol FROM kept
          JOIN listed USING (day, stream, symbol) WHERE NOT emptied),
        bad AS (SELECT DISTINCT day, stream, symbol, CASE WHEN event_id % 997 = 5 THEN 'body is not ASCII'
          WHEN event_id % 991 = 6 THEN 'body holds a quote' WHEN event_id % 983 = 7 THEN 'field count differs from the header'
          WHEN event_id % 977 = 8 THEN 'line break inside a line' END AS problem FROM rows)
        SELECT day, problem, stream || ' ' || symbol AS detail FROM bad WHERE problem IS NOT NULL
        UNION ALL SELECT day, 'empty file in a stream not registered for it', stream || ' ' || symbol FROM kept
          WHERE emptied AND stream <> 'xinqing'
        UNION ALL SELECT day, 'headers differ inside a stream', stream FROM kept WHERE NOT emptied GROUP BY day, stream
          HAVING count(DISTINCT header) > 1
        UNION ALL SELECT day, 'all files of a stream are empty', stream FROM kept GROUP BY day, stream HAVING bool_and(emptied)""",
    "ingest_row_counts": f"""WITH {_LISTED} SELECT day, stream, count(*) AS n_rows_csv, count(*) AS n_rows_parquet FROM listed
        GROUP BY day, stream""",
    "ingest_batch_outcomes": f"""WITH {_TREES}
        SELECT day, ymd || '.7z' AS source, CASE WHEN n = 0 THEN 'ok' ELSE 'failed' END AS status,
          CASE WHEN n > 0 THEN 'body holds a quote: ' || place || ' (' || n || ' in all)' END AS error FROM outcomes""",
    "time_shapes_streamed": f"""WITH {_TREES} SELECT day, stream, CASE WHEN h < 10 THEN 8 ELSE 9 END AS len, count(*) AS count
        FROM kept JOIN outcomes USING (day) WHERE outcomes.n = 0 GROUP BY ALL""",
    "ingest_again": f"""WITH {_TREES},
        changed AS (SELECT day, count(DISTINCT rel) AS a, min(rel) AS first FROM (
          SELECT day, ymd || '/' || symbol || '/' || CASE stream WHEN 'orders' THEN '逐笔委托.csv' WHEN 'trades' THEN '逐笔成交.csv'
            ELSE '行情.csv' END AS rel FROM trees WHERE day(d) % 2 = 0 AND event_id % 61 = 7) GROUP BY day),
        fewer AS (SELECT day, count(DISTINCT stream || ' ' || symbol) AS n, min(stream || ' ' || symbol) AS place FROM kept
          WHERE spoilt AND substr(symbol, 1, 3) <> '{MAIN_PREFIXES[-1]}' GROUP BY day),
        told AS (SELECT 'same' AS run, day, CASE WHEN n > 0 THEN 'body holds a quote: ' || place || ' (' || n || ' in all)' END AS error
            FROM outcomes
          UNION ALL SELECT r.run, day, CASE
            WHEN o.n = 0 AND a > 0 THEN 'already ingested from a source with another sha256: ' || first || ' altered (' || a || ' in all)'
            WHEN o.n = 0 AND r.run = 'prefixes' THEN 'already ingested with other prefixes'
            WHEN r.run = 'altered' AND o.n > 0 THEN 'body holds a quote: ' || o.place || ' (' || o.n || ' in all)'
            WHEN f.n > 0 THEN 'body holds a quote: ' || f.place || ' (' || f.n || ' in all)' END
          FROM outcomes o LEFT JOIN changed USING (day) LEFT JOIN fewer f USING (day), (SELECT unnest(['altered', 'prefixes']) AS run) r)
        SELECT run, day, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, error FROM told""",
    "ingest_manifest": f"""WITH {_TREES},
        heads AS (SELECT unnest([{_ALL}]) AS stream),
        every AS (SELECT DISTINCT ymd, day, symbol, heads.stream FROM kept, heads),
        bodies AS (SELECT day, stream, symbol, string_agg(line || chr(10), '' ORDER BY event_id) AS body, count(*) AS n
          FROM kept GROUP BY ALL),
        files AS (SELECT day, stream, symbol, '万得代码,' || stream || ',日期,时间,价格,编号' AS header, coalesce(body, '') AS body,
          coalesce(n, 0) AS n FROM every LEFT JOIN bodies USING (day, stream, symbol)),
        digests AS (SELECT *, sha256(strlen(symbol) || chr(0) || symbol || strlen(header) || chr(0) || header
          || strlen(body) || chr(0) || body) AS digest FROM files)
        SELECT day, 'self_consistent' AS quality, (SELECT count(DISTINCT symbol) FROM trees t WHERE t.day = digests.day
            AND substr(t.symbol, 1, 3) NOT IN ({_MAIN})) AS n_dropped, stream, count(*) AS n_symbols, CAST(sum(digests.n) AS BIGINT) AS n_rows_csv,
          CAST(sum(digests.n) AS BIGINT) AS n_rows_parquet, CAST(0 AS BIGINT) AS n_short_times, min(header) AS header,
          sha256(string_agg(symbol || chr(0) || digest || chr(10), '' ORDER BY symbol)) AS sha256_csv
        FROM digests JOIN outcomes USING (day) WHERE outcomes.n = 0 GROUP BY day, stream""",
    "ingest_read_back": f"""WITH {_TREES} SELECT day, symbol, stream, ms AS time_ms,
        CASE stream WHEN 'orders' THEN event_id ELSE price END AS value FROM kept JOIN outcomes USING (day) WHERE n = 0""",
    "archive_days": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "archive_repeated_days": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, min(strftime(o_orderdate, '%Y%m%d')) || '.7z'
        AS first, max(strftime(o_orderdate, '%Y%m%d')) || '.7z' AS last FROM orders WHERE o_orderkey % 5 = 0
        GROUP BY day HAVING count(*) > 1""",
    "canonical_digests": """SELECT doc_id, sha256(strlen(lang) || chr(0) || lang || strlen(source) || chr(0) || source
        || strlen(text) || chr(0) || text) AS digest FROM documents""",
    "digest_rollup": f"""WITH {_RAW}, b AS (SELECT day, stream, symbol, event_id // 4096 AS block,
          sha256(string_agg(symbol || '|' || event_id || '|' || coalesce(CAST(vol AS VARCHAR), '') || '|' || user_id || '|' || event_id % 1000
          || chr(10), '' ORDER BY event_id)) AS digest FROM raw GROUP BY ALL),
        e AS (SELECT day, stream, symbol, sha256(string_agg(lpad(CAST(block AS VARCHAR), 20, '0') || chr(0) || digest || chr(10), ''
          ORDER BY block)) AS digest FROM b GROUP BY ALL)
        SELECT day, stream, sha256(string_agg(symbol || chr(0) || digest || chr(10), '' ORDER BY symbol)) AS digest FROM e GROUP BY day, stream""",
    "run_record_ids": f"""WITH {_RAW}, b AS (SELECT '{{"day":"' || day || '","first":' || min(event_id) || ',"n":' || count(*)
          || ',"stream":"' || stream || '"}}' AS body FROM raw GROUP BY day, stream)
        SELECT sha256(body) AS receipt_id, body FROM b""",
    "run_records_appended": f"""WITH {_RAW}, b AS (SELECT '{{"day":"' || day || '","first":' || min(event_id) || ',"n":' || count(*)
          || ',"stream":"' || stream || '"}}' AS body FROM raw GROUP BY day, stream)
        SELECT sha256(body) AS receipt_id, body FROM b""",
    "bound_files": f"""WITH {_RAW}, f AS (SELECT DISTINCT stream || '/' || (event_id // 256) || '.csv' AS path, event_id // 256 AS n FROM raw),
        p AS (SELECT path, CASE WHEN n % 5 = 1 THEN 'missing' WHEN n % 7 = 3 AND n % 4 <> 2 THEN 'moved'
            WHEN n % 7 = 3 THEN 'missing' WHEN n % 4 = 2 THEN 'altered' END AS problem FROM f)
        SELECT path, problem, CASE WHEN problem = 'moved' THEN 'elsewhere/' || path END AS found_at FROM p WHERE problem IS NOT NULL""",
    "run_record_conflicts": f"""WITH {_RAW}, b AS (SELECT '{{"day":"' || day || '","first":' || min(event_id) || ',"n":' || count(*)
          || ',"stream":"' || stream || '"}}' AS body FROM raw WHERE stream = 'orders' GROUP BY day, stream)
        SELECT sha256(body) AS receipt_id FROM b""",
}
