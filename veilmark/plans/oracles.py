"""DuckDB SQL for the registered queries. Its patterns have no look-around, so boundaries are \\b and checks follow."""

from __future__ import annotations

from ..functions.validators import PERMUTED, PRODUCTS
from . import fixtures
from .queries import BODIES, IDENTITIES


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]::DOUBLE[]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({names})"


#: The patterns of the rule tables as this engine writes them.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD = r"\b(?:[0-9][ -]?){12,18}[0-9]\b"
AADHAAR = r"\b[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE = r"(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{2,4}\)[ -]?)?[0-9]{3,5}[ -]?[0-9]{3,5}(?:[ -]?[0-9]{2,4})?"
DOB = r"\b(?:[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})\b"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _luhn(d: str) -> str:
    number = f"substr({d}, length({d}) - i + 1, 1)::INT"
    return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {number} ELSE 2 * {number} - CASE WHEN {number} > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"


def _card(x: str) -> str:
    d = _digits(x)
    return f"(length({d}) IN (13, 14, 15, 16, 19) AND substr({d}, 1, 1) BETWEEN '3' AND '6' AND {_luhn(d)})"


def _phone(x: str) -> str:
    d = _digits(x)
    return f"CASE WHEN ltrim({x}) LIKE '+%' THEN length({d}) BETWEEN 8 AND 15 ELSE regexp_full_match({d}, '[6-9][0-9]{{9}}') END"


def _aadhaar(x: str) -> str:
    d = _digits(x)
    permuted = "[" + ", ".join(f"'{p}'" for p in PERMUTED) + "]"
    digit = f"substr({d}, length({d}) - i, 1)::INT"
    steps = f"list_prepend(0, list_transform(range(0, length({d})), lambda i: substr(({permuted})[i % 8 + 1], {digit} + 1, 1)::INT))"
    return f"(list_reduce({steps}, lambda c, e: ({PRODUCTS})[c * 10 + e + 1]) = 0)"


def _ssn(x: str) -> str:
    return f"(substr({x}, 1, 3) NOT IN ('000', '666') AND substr({x}, 1, 1) != '9' AND substr({x}, 5, 2) != '00' AND substr({x}, 8) != '0000')"


def _found(table: str, id_col: str, text: str, pattern: str, check: str = "true") -> str:
    return f"SELECT {id_col}, value FROM (SELECT {id_col}, unnest(regexp_extract_all({text}, '{pattern}')) AS value FROM {table}) WHERE {check}"


_INGRESS = (("email", EMAIL, "true"), ("card_number+luhn", CARD, _card("m")), ("aadhaar+verhoeff", AADHAAR, _aadhaar("m")), ("pan", PAN, "true"), ("ifsc", IFSC, "true"), ("ssn", SSN, _ssn("m")))
_hit = lambda x, p, c: f"len(list_filter(regexp_extract_all({x}, '{p}'), lambda m: {c})) > 0"
_leaks = lambda x: "(" + " OR ".join(_hit(x, p, c) for _, p, c in _INGRESS) + ")"

_PRF = "tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall"
_SCORED = f"""s AS (SELECT level, key, tp, fp, fn, {_PRF} FROM c)
SELECT level, key, tp, fp, fn, precision, recall, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM s"""
_BOX = "greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0)"
_AREA = "(greatest({0}[3] - {0}[1], 0) * greatest({0}[4] - {0}[2], 0))"
_ROUNDED = lambda *edges: "[" + ", ".join(f"floor({x} + 0.5)" for x in edges) + "]"
_SCREENS = f"""p AS (SELECT l_partkey AS screen_id, (l_orderkey * 10 + l_linenumber) * 100000000 + round(l_extendedprice * 100)::BIGINT AS seq, l_returnflag AS type, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS tier, l_extendedprice / 100000 AS confidence,
  {_ROUNDED('l_quantity * 4', 'l_discount * 1000', 'l_quantity * 4 + 60 + l_linenumber::DOUBLE * 10', 'l_discount * 1000 + 40 + l_tax * 300')} AS b FROM lineitem),
t AS (SELECT CASE WHEN l_suppkey = 1 THEN -l_partkey ELSE l_partkey END AS screen_id, (l_orderkey * 10 + l_linenumber) * 100000000 + round(l_extendedprice * 100)::BIGINT AS item_idx, l_returnflag AS type, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS tier,
  {_ROUNDED('l_quantity * 4 + l_linenumber::DOUBLE * 3', 'l_discount * 1000', 'l_quantity * 4 + 60 + l_linenumber::DOUBLE * 12', 'l_discount * 1000 + 30 + l_tax * 500')} AS a FROM lineitem)"""
_PAIRS = f"""{_SCREENS}, o AS (SELECT p.screen_id, seq, p.tier AS p_tier, item_idx, p.type AS p_type, t.type AS t_type, {_BOX} AS i, {_AREA.format('a')} AS ta, {_AREA.format('b')} AS pa FROM p JOIN t USING (screen_id))"""
_CARD_HTML = """'&lt;&quot;' || replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
_IDENTITY_TEXTS = f"(SELECT doc_id::BIGINT AS id, text FROM documents UNION ALL SELECT -1 - id, text FROM {_values(enumerate(IDENTITIES), 'id, text')})"
#: The tier-1 fields of the page.
_TIER_1 = "'input#secret', 'input#tax-id', 'dd#acct', 'dd#branch-code', 'dd#debit'"
_PLAN_PATHS = ", ".join(f"'{n[3]}'" for n in fixtures.BANK)

SQL = {
    "pii_email_spans": rf"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS v, string_split_regex(text, '{EMAIL}') AS p FROM documents WHERE contains(text, '@')),
e AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m),
s AS (SELECT doc_id, v[i] AS value, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS start FROM e)
SELECT doc_id, start::INT AS start, (start + length(value))::INT AS "end", value FROM s""",
    "pii_email_counts_by_lang": f"SELECT lang, count(*) AS docs, sum(coalesce(len(regexp_extract_all(text, '{EMAIL}')), 0))::BIGINT AS emails FROM documents GROUP BY lang",
    "pii_card_valid": _found("documents", "doc_id", "text", CARD, _card("value")),
    "pii_phone_valid": _found("documents", "doc_id", "text", PHONE, _phone("value")),
    "pii_dates": _found("documents", "doc_id", "text", DOB),
    "pii_dob_context": rf"""WITH t AS (SELECT conv_id, turn, concat_ws(' ', role, CASE WHEN turn = 1 THEN 'born 1990-01-31 or 5/6/77' END, text) AS text FROM conversations)
SELECT conv_id, turn, unnest(regexp_extract_all(text, '{DOB}')) AS value FROM t WHERE regexp_matches(text, '(?i)birth|\bdob\b|born')""",
    "pii_identity_values": " UNION ALL ".join(f"SELECT id, value, '{k}' AS type FROM ({_found(_IDENTITY_TEXTS, 'id', 'text', p, c)})" for k, p, c in (("pan", PAN, "true"), ("ifsc", IFSC, "true"), ("ssn", SSN, _ssn("value")), ("aadhaar", AADHAAR, _aadhaar("value")))),
    "pii_doc_profile": f"""SELECT d.lang, d.source, count(*) AS docs, count(*) FILTER (regexp_matches(d.text, '{EMAIL}')) AS with_email, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY GROUPING SETS ((), (d.lang), (d.source))""",
    "redact_email_partial": rf"SELECT doc_id, regexp_replace(text, '\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+(\.[A-Za-z]{{2,}})\b', '\1***@***\2', 'g') AS text FROM documents WHERE regexp_matches(text, '{EMAIL}')",
    "session_tokens": """WITH k AS (SELECT conv_id, turn, role AS kind, CASE WHEN coalesce(text, '') != '' THEN role || ':' || regexp_replace(lower(text), '[^a-z0-9@.]', '', 'g') ELSE role || '@path' END AS key FROM conversations),
f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, kind, key) AS first FROM k)
SELECT conv_id, turn, kind, upper(kind) || '_' || dense_rank() OVER (PARTITION BY conv_id, kind ORDER BY first) AS token FROM f""",
    "ingress_findings": " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, '{n}' AS pattern, doc_id || '.{f} matches {n}' AS said FROM documents WHERE {_hit(c, p, k)}" for f, c in (("label", "source"), ("value", "text")) for n, p, k in _INGRESS),
    "ingress_scrub": f"SELECT doc_id, CASE WHEN {_leaks('source')} THEN '[REDACTED:INGRESS]' ELSE source END AS label, CASE WHEN {_leaks('text')} THEN '[REDACTED:INGRESS]' ELSE text END AS value FROM documents",
    "ingress_policy": f"SELECT CASE WHEN {_leaks('source')} OR {_leaks('text')} THEN 'rejected' ELSE 'clean' END AS verdict, count(*) AS records FROM documents GROUP BY 1",
    "strict_schema": f"""WITH b AS (SELECT id, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN json_keys(body) END AS k FROM {_values([(f'body:{i}', b) for i, b in enumerate(BODIES)], 'id, body')}
  UNION ALL SELECT conv_id || ':' || turn, list_filter([CASE WHEN turn % 5 != 4 AND conv_id IS NOT NULL THEN 'session_id' END, CASE WHEN text IS NOT NULL THEN 'task_instruction' END, CASE WHEN role = 'assistant' THEN 'role' END], lambda x: x IS NOT NULL) FROM conversations)
SELECT id, coalesce(array_to_string(list_sort(list_filter(k, lambda x: x NOT IN ('session_id', 'task_instruction', 'screenshot_redacted', 'dom_summary', 'redaction_manifest', 'prior_actions'))), ','), '') AS unknown,
  CASE WHEN list_contains(k, 'session_id') THEN '' ELSE 'session_id' END AS missing,
  k IS NOT NULL AND list_contains(k, 'session_id') AND len(list_filter(k, lambda x: x NOT IN ('session_id', 'task_instruction', 'screenshot_redacted', 'dom_summary', 'redaction_manifest', 'prior_actions'))) = 0 AS accepted FROM b""",
    "plan_constrain": rf"""WITH p AS (SELECT * FROM {_values(fixtures.PLANS, 'session_id, n, action, selector, value, value_ref')}),
r AS (SELECT *, CASE
  WHEN action NOT IN ('click', 'type', 'focus', 'scroll', 'read', 'wait') THEN 'unknown verb'
  WHEN action IN ('click', 'type', 'focus') AND coalesce(selector, '') = '' THEN 'requires a selector'
  WHEN coalesce(selector, '') NOT IN ('', {_PLAN_PATHS}) THEN 'selector ''' || selector || ''' was not in dom_summary'
  WHEN regexp_matches(coalesce(value, ''), '\[(?:REDACTED:[A-Z_]+|[A-Z_]+_[0-9]+)\]') THEN 'value echoes a redaction marker'
  WHEN value_ref IS NOT NULL AND NOT regexp_full_match(value_ref, 'user_saved:[A-Za-z0-9_.\-]{{1,64}}') THEN 'value_ref ''' || value_ref || ''' is not a user_saved reference'
  WHEN action = 'type' AND (value IS NULL) = (value_ref IS NULL) THEN 'needs exactly one of value / value_ref'
  WHEN action = 'type' AND value IS NOT NULL AND selector IN ({_TIER_1}) THEN selector || ' is a tier 1 field and must use value_ref, not a literal' END AS rule FROM p)
SELECT n::INT AS position, action, 'action[' || n || '] ' || action || ': ' || rule AS rejection FROM r""",
    "executor_prefix": """WITH f AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM events)
SELECT event_id, user_id, event_type FROM f WHERE failed = 0""",
    "debounce_last": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM b GROUP BY user_id, burst""",
    "activity_ring": "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 60",
    "prior_actions": "SELECT event_id, coalesce(string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS prior FROM events",
    "last_capture": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "selector_lookup": r"""WITH h AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '')) AS host FROM pages)
SELECT page_id, host, CASE WHEN count(*) OVER (PARTITION BY host) = 1 THEN 'ok' ELSE 'selector matched ' || count(*) OVER (PARTITION BY host) || ' elements' END AS lookup FROM h""",
    "iou_matrix": f"WITH {_PAIRS} SELECT screen_id, seq, item_idx, round(coalesce(i / nullif(ta + pa - i, 0), 0), 9) AS iou, round(coalesce(i / nullif(ta, 0), 0), 9) AS inside FROM o WHERE i > 0 AND p_type = t_type",
    "eval_prf": f"""WITH r AS (SELECT CASE WHEN n_chars > 500 AND quality = 1 THEN 'tp' WHEN n_chars > 500 THEN 'fp' WHEN quality = 1 THEN 'fn' END AS o, toxic, lang FROM documents JOIN labels USING (doc_id)),
c AS (SELECT CASE WHEN grouping(toxic) = 1 AND grouping(lang) = 1 THEN 'overall' WHEN grouping(lang) = 1 THEN 'tier' ELSE 'type' END AS level, CASE WHEN grouping(toxic) = 1 AND grouping(lang) = 1 THEN 'all' WHEN grouping(lang) = 1 THEN toxic::VARCHAR ELSE lang END AS key,
  count(*) FILTER (o = 'tp') AS tp, count(*) FILTER (o = 'fp') AS fp, count(*) FILTER (o = 'fn') AS fn FROM r WHERE o IS NOT NULL GROUP BY GROUPING SETS ((), (toxic), (lang))), {_SCORED}""",
    "eval_unscorable": f"WITH {_SCREENS} SELECT DISTINCT screen_id FROM t WHERE screen_id NOT IN (SELECT screen_id FROM p)",
    "redaction_precision": f"""WITH {_PAIRS}, x AS (SELECT p.screen_id, p.seq, p.tier, coalesce(max(coalesce(i / nullif(ta + pa - i, 0), 0)) >= 0.5, false)::INT AS hit FROM p LEFT JOIN o ON p.screen_id = o.screen_id AND p.seq = o.seq GROUP BY ALL)
SELECT tier, sum(hit)::BIGINT AS on_target, count(*) AS masked, sum(hit)::DOUBLE / count(*) AS precision FROM x GROUP BY GROUPING SETS ((), (tier))""",
    "latency_percentiles": """WITH l AS (SELECT event_type, unnest([{'stage': 'capture', 'v': value}, {'stage': 'network', 'v': value * 2}, {'stage': 'total', 'v': value + value * 2}]) AS x FROM events)
SELECT event_type, x.stage AS stage, round(quantile_cont(x.v::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(x.v::DOUBLE, 0.95), 6) AS p95 FROM l GROUP BY event_type, x.stage""",
    "latency_budget": "SELECT event_type, CASE WHEN round(quantile_cont((value + value * 2)::DOUBLE, 0.95), 6) <= 100 THEN 'PASS' ELSE 'OVER' END AS verdict FROM events GROUP BY event_type",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_windows_sliding": "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS start, event_type, value FROM events) GROUP BY 1, 2",
    "stream_tokens": """WITH f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type, props) AS first FROM events)
SELECT user_id::VARCHAR AS session, event_id AS seq, event_type AS type, upper(event_type) || '_' || dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY first) AS token FROM f""",
    "stream_histories": "SELECT user_id::VARCHAR AS session, event_id AS seq, coalesce(string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS prior FROM events",
    "page_hosts": r"""SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS host,
  coalesce(url, '') = '' OR regexp_matches(url, '^(?:chrome|edge|brave|about|devtools|chrome-extension|view-source|moz-extension):') OR starts_with(url, 'https://chrome.google.com/webstore') OR starts_with(url, 'https://chromewebstore.google.com') AS restricted,
  (page_id % 3 = 1 AND url IS NOT NULL) OR page_id % 3 = 2 OR (page_id % 3 = 0 AND coalesce(url, '') = '') OR url IS NULL AS seen_restricted FROM pages""",
    "html_elements": """WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style|head)[ >].*?</(script|style|head)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages)
SELECT page_id, tag, n FROM (SELECT page_id, unnest([{'tag': 'a', 'n': len(regexp_extract_all(h, '<a[ >]'))}, {'tag': 'article', 'n': len(regexp_extract_all(h, '<article[ >]'))}, {'tag': 'h1', 'n': len(regexp_extract_all(h, '<h1[ >]'))}], recursive := true) FROM c) WHERE n > 0""",
    "stable_ids": "SELECT c_custkey, c_name, regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_-]{0,47}') AND NOT regexp_full_match(x, '(?i)[0-9a-f]{8,}') AND len(regexp_extract_all(x, '[0-9]')) * 2 <= length(x) AS stable, repeat('•', least(length(c_name), 12)::INT) AS preview FROM (SELECT *, replace(c_name, '#', '_') AS x FROM customer)",
    "rounding": f"SELECT event_id, floor(-value * 10 + 0.5) AS near, floor(value / 7 * 100 + 0.5) / 100 AS near_2, floor(-value / 7 * 1000 + 0.5) / 1000 AS near_3, floor(value / 7 * 10000 + 0.5) / 10000 AS near_4, CASE WHEN floor(value) < 2 THEN 'now' WHEN floor(value) < 60 THEN floor(value)::BIGINT || 's' ELSE floor(floor(value) / 60 + 0.5)::BIGINT || 'm' END AS ago, {_CARD_HTML} AS html FROM events",
    "perception_timings": "SELECT user_id, " + ", ".join(f"floor(coalesce(sum(value) FILTER (event_type = '{k}'), 0) * 100 + 0.5) / 100 AS {k}_ms" for k in ("view", "click", "error")) + ", floor(coalesce(sum(value) FILTER (event_type IN ('view', 'click', 'error')), 0) * 100 + 0.5) / 100 AS total_ms FROM events GROUP BY user_id",
    "user_chips": "SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, bool_or(event_type = 'purchase') AS bought, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'error') || CASE WHEN count(*) FILTER (event_type = 'error') = 1 THEN ' failure' ELSE ' failures' END AS chip FROM events GROUP BY user_id",
}
SQL["stream_windows"] = SQL["event_windows"]

_PLAN_RULES = f"""p AS (SELECT * FROM {_values([(n[2], n[3], n[5], n[6]) for n in fixtures.BANK], 'node_seq, path, role, label')}),
u AS (SELECT 0 AS k, 'type' AS action, path AS selector, 'user_saved:username' AS value_ref FROM p WHERE role IN ('textbox', 'searchbox') AND path NOT IN ({_TIER_1}) AND regexp_matches(coalesce(label, ''), '(?i)user|customer|login|account *id|email') ORDER BY node_seq LIMIT 1),
s AS (SELECT 1, 'type', 'input#secret', 'user_saved:password'),
b AS (SELECT 2, 'click', path, NULL::VARCHAR FROM p WHERE role = 'button' AND regexp_matches(coalesce(label, ''), '(?i)sign *in|log *in|submit|continue|next') ORDER BY node_seq LIMIT 1),
a AS (SELECT * FROM u UNION ALL SELECT * FROM s UNION ALL SELECT * FROM b)"""
_B = "(b[{0}] {1} (b[{2}] - b[{3}]) * 0.25) * 2"
_REGION = f"""{_SCREENS}, r AS (SELECT screen_id AS image_id, seq AS i, greatest(floor({_B.format(1, '-', 3, 1)}), 0)::BIGINT AS x, greatest(floor({_B.format(2, '-', 4, 2)}), 0)::BIGINT AS y,
  least(ceil({_B.format(3, '+', 3, 1)}), 440)::BIGINT AS x2, least(ceil({_B.format(4, '+', 4, 2)}), 160)::BIGINT AS y2 FROM p)"""
_hit_rows = lambda session, path, field, x, table: " UNION ALL ".join(f"SELECT {session} AS session_id, '{n}' AS pattern FROM {table} WHERE {x} != '' AND {_hit(x, p, k)}" for n, p, k in _INGRESS)
_EDGE_SQL = "[floor(l_quantity::DOUBLE * 10 + 0.5), floor(l_discount::DOUBLE * 1000 + 0.5), floor(l_extendedprice::DOUBLE / 100 + 0.5), floor(l_tax::DOUBLE * 3000 + 0.5)]"
SQL |= {
    "plan_rules": f"WITH {_PLAN_RULES} SELECT 's1' AS session_id, k::INT AS position, action, selector, value_ref, true AS requires_client_secret FROM a",
    "plan_resolved": f"WITH {_PLAN_RULES} SELECT k::INT AS position, action, selector, CASE value_ref WHEN 'user_saved:username' THEN 'ada' WHEN 'user_saved:password' THEN 'pw' END AS text FROM a",
    "blur_regions": f"WITH {_REGION} SELECT image_id, i, x, y, x2 - x AS w, y2 - y AS h, greatest(10.0, floor(least(x2 - x, y2 - y) * 0.45 + 0.5))::DOUBLE AS radius FROM r WHERE x2 > x AND y2 > y",
    "ingress_requests": f"""WITH f AS ({_hit_rows('source', 'doc_id', 'label', 'lang', 'documents')} UNION ALL {_hit_rows('source', 'doc_id', 'value', 'text', 'documents')}
  UNION ALL {_hit_rows('source', '', 'text', 'text', '(SELECT source, min(text) AS text FROM documents GROUP BY source)')})
SELECT session_id, count(*) AS findings, array_to_string(list_sort(list_distinct(list(pattern))), ',') AS patterns FROM f GROUP BY session_id""",
    "find_one": r"""WITH h AS (SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS host FROM pages), n AS (SELECT host, count(*) AS n FROM h GROUP BY host)
SELECT host, CASE WHEN n = 1 THEN 'ok' ELSE n || ' elements match ' || host || ': refusing to guess' END AS lookup FROM n UNION ALL SELECT 'nowhere.example', 'No element matches nowhere.example'""",
    "plan_outcomes": """WITH f AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM events)
SELECT user_id, event_id, CASE WHEN failed > 0 THEN 'not reached' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome FROM f""",
    "saved_values": """SELECT user_id, event_type AS slot, props AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND value >= 10""",
    "manifest_malformed": f"SELECT * FROM {_values(fixtures.ENTRIES, 'snapshot_id, id, type, tier, masking, detector')} WHERE coalesce(id, '') = '' OR coalesce(type, '') = '' OR coalesce(masking, '') = '' OR coalesce(detector, '') = '' OR tier NOT IN (1, 2)",
    "manifest_undeclared": f"SELECT snapshot_id, type FROM {_values(fixtures.EXPECTED, 'snapshot_id, type')} WHERE (snapshot_id, type) NOT IN (SELECT (snapshot_id, type) FROM {_values(fixtures.ENTRIES, 'snapshot_id, id, type, tier, masking, detector')})",
    "latency_stage_sum": "SELECT event_type, round(quantile_cont(value::DOUBLE, 0.5) + quantile_cont((value * 2)::DOUBLE, 0.5), 4) AS p50_sum, 2::BIGINT AS stages FROM events GROUP BY event_type",
    "box_geometry": f"""WITH b AS (SELECT l_orderkey, l_linenumber, {_EDGE_SQL} AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, b[3] > b[1] AND b[4] > b[2] AND b[3] > 0 AND b[4] > 0 AND b[1] < 300 AND b[2] < 80 AS on_screen, b[3] - b[1] >= 32 AND b[4] - b[2] >= 32 AS wide,
  array_to_string(list_transform([least(greatest(floor(b[1] * 1.5 + 0.5), 0), 450), least(greatest(floor(b[2] * 1.5 + 0.5), 0), 120), least(greatest(floor(b[3] * 1.5 + 0.5), 0), 450), least(greatest(floor(b[4] * 1.5 + 0.5), 0), 120)], lambda x: x::INT::VARCHAR), ',') AS device FROM b""",
    "face_decode": f"""WITH o AS (SELECT * FROM {_values(fixtures.FACE_OUTPUT, 'image_id, s, b')}), e AS (SELECT *, unnest(range(0, len(s) // 2)) AS i FROM o)
SELECT image_id, i::INT AS i, floor(s[2 * i + 2] * 1000 + 0.5) / 1000 AS score, concat_ws(',', floor(10 + b[4 * i + 1] * 90 + 0.5)::INT, floor(20 + b[4 * i + 2] * 45 + 0.5)::INT, floor(10 + b[4 * i + 3] * 90 + 0.5)::INT, floor(20 + b[4 * i + 4] * 45 + 0.5)::INT) AS box FROM e WHERE s[2 * i + 2] >= 0.6""",
    "measured_labels": f"""WITH l AS (SELECT * FROM {_values(fixtures.HAND_LABELS, 'snapshot_id, item, selector, needle')}), n AS (SELECT * FROM {_values([(n[0], n[3], n[13], n[9] or n[7]) for n in fixtures.BANK], 'snapshot_id, selector, bbox, content')}),
j AS (SELECT l.*, n.content, n.bbox, n.selector IS NOT NULL AS there FROM l LEFT JOIN n USING (snapshot_id, selector))
SELECT snapshot_id, item::INT AS item, selector, array_to_string(list_transform(bbox, lambda x: x::INT::VARCHAR), ',') AS box, nullif(strpos(content, needle), 0)::INT - 1 AS start,
  CASE WHEN NOT there THEN 'no such node' WHEN needle IS NOT NULL AND strpos(content, needle) = 0 THEN 'text not found' WHEN bbox IS NULL THEN 'no box' END AS problem FROM j""",
    "pii_context_values": " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, value FROM ({_found('documents', 'doc_id', 'text', p)})" for k, p in (("bank_account", r"\b[0-9]{9,18}\b"), ("passport", r"\b[A-PR-WY][0-9]{7}\b"), ("otp", r"\b[0-9]{4,8}\b"))),
}

_IOU = "coalesce({0} / nullif({1} + {2} - {0}, 0), 0)"
#: An ordered fold is a recursion over the rows' ranks: of a screen's predictions, an image's boxes, a text's spans.
_MATCHED = f"""{_SCREENS.replace("p AS (SELECT", "u AS (SELECT", 1)}, p AS (SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY confidence DESC, seq) AS r FROM u),
g AS (SELECT p.screen_id, seq, item_idx, {_BOX} AS i, {_AREA.format('a')} AS ta, {_AREA.format('b')} AS pa FROM p JOIN t USING (screen_id, type)),
h AS (SELECT screen_id, seq, item_idx, CASE WHEN {_IOU.format('i', 'ta', 'pa')} >= 0.5 THEN {_IOU.format('i', 'ta', 'pa')} WHEN coalesce(i / nullif(ta, 0), 0) >= 0.9 THEN 0.5 END AS score FROM g),
w AS (SELECT screen_id, seq, list(item_idx ORDER BY score DESC, item_idx) AS wanted FROM h WHERE score IS NOT NULL GROUP BY screen_id, seq),
q AS (SELECT p.screen_id, r, tier, type, coalesce(wanted, []) AS wanted FROM p LEFT JOIN w USING (screen_id, seq) WHERE p.screen_id IN (SELECT screen_id FROM t)),
m AS (SELECT DISTINCT screen_id, 0::BIGINT AS r, []::BIGINT[] AS claimed, NULL::BIGINT AS got, NULL::INT AS tier, NULL::VARCHAR AS type FROM q
  UNION ALL SELECT screen_id, r, CASE WHEN open IS NULL THEN claimed ELSE list_append(claimed, open) END, open, tier, type
  FROM (SELECT q.screen_id, q.r, m.claimed, list_filter(q.wanted, lambda x: NOT list_contains(m.claimed, x))[1]::BIGINT AS open, q.tier, q.type FROM m JOIN q ON q.screen_id = m.screen_id AND q.r = m.r + 1)),
o AS (SELECT screen_id, CASE WHEN got IS NULL THEN 'fp' ELSE 'tp' END AS outcome, tier, type FROM m WHERE r > 0
  UNION ALL SELECT t.screen_id, 'fn', t.tier, t.type FROM t JOIN (SELECT screen_id, arg_max(claimed, r) AS claimed FROM m GROUP BY screen_id) z USING (screen_id) WHERE NOT list_contains(claimed, item_idx))"""
_FACE_BOX = "greatest(least(x.bbox[3], f.bbox[3]) - greatest(x.bbox[1], f.bbox[1]), 0) * greatest(least(x.bbox[4], f.bbox[4]) - greatest(x.bbox[2], f.bbox[2]), 0)"
_FACES = f"""{_SCREENS}, f0 AS (SELECT screen_id AS image_id, seq AS i, floor(confidence * 1000 + 0.5) / 1000 AS score,
  CASE WHEN tier = 1 THEN b ELSE [b[1] + screen_id % 40, b[2] + screen_id % 25, b[3] + screen_id % 40, b[4] + screen_id % 25] END AS bbox FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, i) AS r FROM f0 WHERE score >= 0.3),
k AS (SELECT DISTINCT image_id, 0::BIGINT AS r, []::STRUCT(i BIGINT, score DOUBLE, bbox DOUBLE[])[] AS kept FROM f
  UNION ALL SELECT f.image_id, f.r, CASE WHEN len(list_filter(kept, lambda x: {_IOU.format(f'({_FACE_BOX})', _AREA.format('x.bbox'), _AREA.format('f.bbox'))} >= 0.3)) = 0 THEN list_append(kept, struct_pack(i := f.i, score := f.score, bbox := f.bbox)) ELSE kept END
  FROM k JOIN f ON f.image_id = k.image_id AND f.r = k.r + 1),
z AS (SELECT image_id, x.i AS i, x.score AS score, x.bbox AS bbox FROM (SELECT image_id, unnest(arg_max(kept, r)) AS x FROM k GROUP BY image_id))"""
#: Type, tier, detector and confidence of the patterns that need no context, with their checks, as listed.
_TEXT_RULES = (
    ("email", 2, "regex:email", 0.95, EMAIL, "true"),
    ("card_number", 1, "regex:card_number+luhn", 0.95, CARD, _card("value")),
    ("aadhaar", 1, "regex:aadhaar+verhoeff", 0.95, AADHAAR, _aadhaar("value")),
    ("pan", 1, "regex:pan", 0.90, PAN, "true"),
    ("ifsc", 1, "regex:ifsc", 0.90, IFSC, "true"),
    ("ssn", 1, "regex:ssn", 0.90, SSN, _ssn("value")),
    ("phone", 2, "regex:phone-intl", 0.75, PHONE, _phone("value")),
)
_SPAN_TYPE = "STRUCT(a INT, b INT, value VARCHAR, type VARCHAR, tier INT, detector VARCHAR, confidence DOUBLE)"
_FOUND_SPANS = f"""m AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS seq, '{t}' AS type, {n} AS tier, '{d}' AS detector, {c} AS confidence, regexp_extract_all(text, '{p}') AS v, string_split_regex(text, '{p}') AS p FROM documents" for k, (t, n, d, c, p, _) in enumerate(_TEXT_RULES))}),
e AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m),
s AS (SELECT *, v[i] AS value, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS a FROM e),
q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, seq) AS r, struct_pack(a := a, b := a + length(value), value := value, type := type, tier := tier, detector := detector, confidence := confidence)::{_SPAN_TYPE} AS x
  FROM s WHERE CASE seq {" ".join(f"WHEN {k} THEN {c}" for k, (*_, c) in enumerate(_TEXT_RULES))} END),
k AS (SELECT DISTINCT doc_id, 0::BIGINT AS r, []::{_SPAN_TYPE}[] AS kept FROM q
  UNION ALL SELECT doc_id, r, CASE WHEN spot = 0 THEN list_append(kept, x)
    WHEN x.tier < kept[spot].tier OR (x.tier = kept[spot].tier AND (x.confidence > kept[spot].confidence OR (x.confidence = kept[spot].confidence AND x.b - x.a > kept[spot].b - kept[spot].a))) THEN list_concat(kept[1:spot-1], [x], kept[spot+1:]) ELSE kept END
  FROM (SELECT q.doc_id, q.r, q.x, kept, coalesce(list_position(list_transform(kept, lambda z: z.a < q.x.b AND q.x.a < z.b), true), 0) AS spot FROM k JOIN q ON q.doc_id = k.doc_id AND q.r = k.r + 1)),
f AS (SELECT doc_id, unnest(kept) AS x, unnest(range(1, len(kept) + 1)) AS i FROM (SELECT doc_id, arg_max(kept, r) AS kept FROM k GROUP BY doc_id))"""
SQL |= {
    "greedy_match": f"WITH RECURSIVE {_MATCHED} SELECT screen_id, outcome, tier, type FROM o",
    "eval_confusion": f"""WITH RECURSIVE {_MATCHED},
c AS (SELECT CASE WHEN grouping(tier) = 1 AND grouping(type) = 1 THEN 'overall' WHEN grouping(type) = 1 THEN 'tier' ELSE 'type' END AS level, CASE WHEN grouping(tier) = 1 AND grouping(type) = 1 THEN 'all' WHEN grouping(type) = 1 THEN tier::VARCHAR ELSE type END AS key,
  count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o GROUP BY GROUPING SETS ((), (tier), (type))), {_SCORED}""",
    "nms_faces": f"WITH RECURSIVE {_FACES} SELECT image_id, i, score FROM z",
    "face_manifest": f"""WITH RECURSIVE {_FACES} SELECT image_id::VARCHAR AS snapshot_id, 'FACE_' || row_number() OVER (PARTITION BY image_id ORDER BY score DESC, i) AS id,
  'face' AS type, 1 AS tier, 'blur' AS masking, 'onnx:ultraface-rfb320' AS detector, score AS confidence FROM z""",
    "face_regions": f"WITH RECURSIVE {_FACES} SELECT image_id::VARCHAR AS snapshot_id, 'blur' AS masking, bbox[1] AS x1, bbox[2] AS y1, bbox[3] AS x2, bbox[4] AS y2 FROM z",
    "pii_all_resolved": f"WITH RECURSIVE {_FOUND_SPANS} SELECT doc_id, x.type AS type, x.tier AS tier, x.detector AS detector, x.a AS start, x.b AS \"end\" FROM f",
    "redact_documents": rf"""WITH RECURSIVE {_FOUND_SPANS},
y AS (SELECT *, min(i) OVER (PARTITION BY doc_id, x.type, regexp_replace(lower(x.value), '[^a-z0-9@.]', '', 'g')) AS first FROM f),
z AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, x.type ORDER BY first) AS n, coalesce(lag(x.b) OVER (PARTITION BY doc_id ORDER BY x.a), 0) AS before FROM y),
c AS (SELECT doc_id, count(*)::INT AS n, max(x.b) AS last, string_agg(substr(text, before + 1, x.a - before) || CASE WHEN x.tier = 1 THEN '[REDACTED:' || upper(x.type) || ']'
    WHEN x.type = 'email' THEN left(x.value, 1) || '***@***' || regexp_extract(x.value, '(\.[^.@]*)$', 1) ELSE '[' || upper(x.type) || '_' || z.n || ']' END, '' ORDER BY x.a) AS head FROM z JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN text ELSE head || substr(text, last + 1) END AS text FROM documents LEFT JOIN c USING (doc_id)""",
}

_LISTED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} IS NOT NULL AND {_hit(c, p, k)} THEN '{f}: {n}' END" for f, c in (("label", "source"), ("value", "text")) for n, p, k in _INGRESS) + "], lambda x: x IS NOT NULL), ', ')"
SQL |= {
    "stream_resets": """WITH e AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events),
f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, epoch, event_type, props) AS first FROM e WHERE event_type != 'error')
SELECT user_id::VARCHAR AS session, event_id AS seq, event_type AS type, upper(event_type) || '_' || dense_rank() OVER (PARTITION BY user_id, epoch, event_type ORDER BY first) AS token FROM f""",
    "stream_debounce": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM b GROUP BY user_id, burst
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)""",
    "stream_stale": """WITH l AS (SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN props END IGNORE NULLS) OVER w AS inspected, last_value(CASE WHEN event_type != 'click' THEN props END IGNORE NULLS) OVER w AS now FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id::VARCHAR AS session, event_id AS seq, inspected IS NOT NULL AND inspected IS DISTINCT FROM now AS stale FROM l""",
    "stream_gate_reject": f"WITH j AS (SELECT doc_id, source, text, {_LISTED} AS patterns FROM documents) SELECT doc_id, CASE WHEN patterns = '' THEN 'clean' ELSE 'rejected' END AS verdict, CASE WHEN patterns = '' THEN source END AS label, CASE WHEN patterns = '' THEN text END AS value, patterns FROM j",
    "stream_gate_redact": f"""WITH j AS (SELECT doc_id, source, text, {_LISTED} AS patterns FROM documents) SELECT doc_id, CASE WHEN patterns = '' THEN 'clean' ELSE 'scrubbed' END AS verdict,
  CASE WHEN contains(patterns, 'label: ') THEN '[REDACTED:INGRESS]' ELSE source END AS label, CASE WHEN contains(patterns, 'value: ') THEN '[REDACTED:INGRESS]' ELSE text END AS value, patterns FROM j""",
}

_UNESCAPED = "replace(replace(replace(replace(regexp_replace({0}, '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), chr(160), ' ')"
_SAID = f"trim(regexp_replace({_UNESCAPED.format('x')}, '\\s+', ' ', 'g'))"
_cut = lambda x, n: f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '…' ELSE {x} END"
#: The given pages are all of one make: what they say stands in links, an advertisement, a heading, paragraphs whose bold is never ended, and a footer.
SQL["html_texts"] = f"""WITH b AS (SELECT page_id, regexp_replace(split_part(html, '<body>', 2), '<!--.*?-->', '', 'gs') AS h FROM pages),
k AS (SELECT page_id, unnest(regexp_extract_all(h, '<[^>]*>[^<]*')) AS k, unnest(range(len(regexp_extract_all(h, '<[^>]*>[^<]*')))) AS i FROM b),
o AS (SELECT page_id, i, regexp_extract(k, '^<(/?[a-z0-9]+)', 1) AS tag, regexp_replace(k, '^<[^>]*>', '') AS x FROM k),
g AS (SELECT *, count(*) FILTER (tag != 'br') OVER (PARTITION BY page_id ORDER BY i) AS owner FROM o),
t AS (SELECT page_id, owner, arg_min(tag, i) AS tag, string_agg(x, '' ORDER BY i) AS x FROM g GROUP BY page_id, owner),
s AS (SELECT page_id, owner, CASE WHEN tag IN ('p', 'footer') THEN 'b' ELSE tag END AS tag, {_SAID} AS said FROM t)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY owner)::INT AS place, tag, CASE WHEN tag = 'a' THEN {_cut('said', 200)} ELSE {_cut('said', 600)} END AS said FROM s WHERE said != ''"""
#: The rule that claims each control or term of the forms.
_CLAIMS = (("password", 1, "dom:input-type-password", 0.99), ("phone", 2, "dom:phone", 0.88), ("otp", 1, "dom:otp", 0.92), ("card_number", 1, "dom:cc-number", 0.95), ("cvv", 1, "dom:cc-csc", 0.95), ("card_expiry", 1, "dom:cc-exp", 0.9), ("aadhaar", 1, "dom:aadhaar", 0.92), ("pan", 1, "dom:pan", 0.9), ("ssn", 1, "dom:ssn", 0.9), ("passport", 1, "dom:passport", 0.9), ("address", 2, "dom:address", 0.82), ("date_of_birth", 2, "dom:dob", 0.88), ("email", 2, "dom:email", 0.9))
_TERMS = (("bank_account", 1, "dom:bank-account", 0.88), ("ifsc", 1, "dom:ifsc", 0.88), ("person_name", 2, "dom:person-name", 0.82))
_row = lambda field, t, n, d, c, a="NULL", b="NULL", where="true": f"SELECT page_id, '{field}' AS field, '{t}' AS type, {n} AS tier, '{d}' AS detector, {c}::DOUBLE AS confidence, {a}::INT AS start, ({b})::INT AS \"end\" FROM f WHERE {where}"
_span = lambda field, t, n, d, c, before, value, where="true": _row(field, t, n, d, c, before, f"{before} + length({value})", where)
_MAIL_AT = "(25 + length(seg) + length(k) + 3)"
SQL["form_detections"] = """WITH f AS (SELECT c_custkey AS page_id, c_custkey::VARCHAR AS k, lower(c_mktsegment) AS seg, '4000 0000 ' || lpad(c_custkey::VARCHAR, 8, '0') AS card, '2345' || lpad(c_custkey::VARCHAR, 8, '0') AS aadhaar, '123-45-' || lpad(left(c_custkey::VARCHAR, 4), 4, '0') AS ssn FROM customer)
""" + " UNION ALL ".join(
    [_row("value", *c) for c in _CLAIMS]
    + [_row("text", *c) for c in _TERMS]
    + [_span("value", "email", 2, "regex:email", 0.95, "9", "seg || k || '@example.net'"), _span("value", "pan", 1, "regex:pan", 0.9, _MAIL_AT, "'ABCDE1234F'"), _span("value", "ssn", 1, "regex:ssn", 0.9, f"{_MAIL_AT} + 12", "'123-45-6789'"), _span("value", "ifsc", 1, "regex:ifsc", 0.9, f"{_MAIL_AT} + 27", "'KOTN0004417'")]
    + [_span("label", "email", 2, "regex:email", 0.95, "0", "'user' || k || '@' || seg || '.example.org'"), _span("label", "phone", 2, "regex:phone-intl", 0.75, "0", "'9876500000'"), _span("label", "otp", 1, "regex:otp(context)", 0.8, "0", "'000000'")]
    + [_span("label", "card_number", 1, "regex:card_number+luhn", 0.95, "0", "card", _card("card")), _span("label", "aadhaar", 1, "regex:aadhaar+verhoeff", 0.95, "0", "aadhaar", _aadhaar("aadhaar")), _span("label", "ssn", 1, "regex:ssn", 0.9, "0", "ssn", _ssn("ssn"))]
)
SQL["form_plans"] = """SELECT c_custkey AS page_id, unnest([{'position': 0, 'action': 'type', 'value_ref': 'user_saved:username', 'rejection': NULL::VARCHAR}, {'position': 1, 'action': 'type', 'value_ref': 'user_saved:password', 'rejection': NULL}, {'position': 2, 'action': 'click', 'value_ref': NULL, 'rejection': NULL}], recursive := true) FROM customer"""
SQL["event_bars"] = "SELECT event_id, repeat('█', CASE WHEN value > 0 THEN greatest(1, round_even(least(value, 100) * 20 / 100, 0)::INT) ELSE 0 END) AS bar FROM events"
SQL["data_urls"] = "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'image/png' ELSE 'text/' || lower(c_mktsegment) END AS mime, c_name AS name FROM customer"
SQL["latency_report"] = "SELECT rpad(event_type, 24, ' ') || lpad(printf('%.3f', floor(round(quantile_cont(value::DOUBLE, 0.5), 6) * 1000 + 0.5) / 1000), 10, ' ') || lpad(printf('%.3f', floor(round(quantile_cont(value::DOUBLE, 0.95), 6) * 1000 + 0.5) / 1000), 10, ' ') AS line FROM events GROUP BY event_type"
