"""DuckDB SQL of the inventory queries."""

from __future__ import annotations

from tidemark.operators import fusion
from tidemark.operators.routing import SAFE_DEFAULTS
from tidemark.plans.inventory_queries import DEFAULTS, KINDS, PROFILES, STAGES, STANDINS, TYPES

lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]" if xs else "CAST([] AS VARCHAR[])"
rows = lambda name, cols, values: f"{name}({cols}) AS (VALUES {', '.join(values)})"
case = lambda col, table: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
text = lambda c: f"array_to_string({c}, ',')"


def ops(source: str = "events", name: str = "ops") -> str:
    return f"""{name}_raw AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_sort(list(DISTINCT event_type)) AS requires, count(*) AS n, min(event_id) AS ord FROM {source} GROUP BY ALL),
{name} AS (SELECT user_id || '/' || day AS id, user_id, day, requires, user_id % 3 = 0 AS optional, n, ord, {lst(STAGES)}[user_id % 6 + 1] AS stage, {lst(fusion.EFFECTS)}[n % 4 + 1] AS effect, {lst(fusion.CONFIDENCE)}[ord % 3 + 1] AS confidence,
 list_filter([CASE WHEN n % 5 = 0 THEN 'irreversible' END, CASE WHEN list_contains(requires, 'signup') THEN 'privacy' END, CASE WHEN user_id % 4 = 0 THEN 'publish' END, CASE WHEN list_contains(requires, 'purchase') THEN 'spend' END], lambda g: g IS NOT NULL) AS gate,
 list_filter(list_transform(requires, lambda c: {case('c', DEFAULTS)}), lambda s: s IS NOT NULL)[1] AS stand_in, CASE WHEN n % 2 = 0 THEN 'n=' || n ELSE '' END AS summary FROM {name}_raw)"""


PROF = rows("prof", "profile, native, mcp", [f"('{p}', {lst(n)}, {lst(m)})" for p, (n, m) in PROFILES.items()])
FID = rows("fid", "stand_in, fidelity", [f"('{s}', CAST({f} AS DOUBLE))" for s, f in STANDINS.items()])
VOC = rows("voc", "capability, kind", [f"('{c}', '{k}')" for c, k in KINDS.items()])
RES = f"""{ops()}, {PROF}, {FID},
bound AS (SELECT *, CASE WHEN list_has_all(native, requires) THEN 'native' WHEN list_has_all(list_concat(native, mcp), requires) AND list_has_any(mcp, requires) THEN 'mcp' WHEN stand_in IS NOT NULL THEN 'script' WHEN optional THEN 'drop' ELSE 'ask-user' END AS binding FROM ops, prof),
res AS (SELECT b.* EXCLUDE (stand_in), b.stand_in AS declared, CASE WHEN binding = 'script' THEN b.stand_in END AS stand_in, CASE WHEN binding = 'script' THEN fidelity END AS fidelity,
 CASE WHEN binding IN ('native', 'mcp', 'script') THEN gate ELSE [] END AS gates, CASE WHEN binding = 'ask-user' THEN gate ELSE [] END AS deferred_gates, list_filter(requires, lambda c: NOT list_contains(native, c) AND NOT list_contains(mcp, c)) AS missing,
 CASE binding WHEN 'native' THEN 1.0 WHEN 'mcp' THEN 0.9 WHEN 'script' THEN coalesce(fidelity, 0.5) WHEN 'ask-user' THEN 0.5 ELSE 0.0 END AS coverage FROM bound b LEFT JOIN fid f ON f.stand_in = b.stand_in)"""
COUNTS = "count(*) AS operations, count(*) FILTER (NOT optional) AS required, count(*) FILTER (optional) AS optional, " + ", ".join(f"count(*) FILTER (binding = '{b}') AS n_{b.replace('-', '_')}" for b in ("native", "mcp", "script", "ask-user", "drop")) + ", count(*) FILTER (NOT optional AND binding IN ('ask-user', 'drop')) = 0 AS executable"
ids = lambda cond: f"count(*) FILTER ({cond})"
names = lambda c: f"array_to_string(list_sort(list_distinct(flatten(list({c})))), ',')"
EFFECT_OF = case("event_type", dict(zip(TYPES, (*fusion.EFFECTS, "read-local"), strict=True)))
SOURCE_OF = case("event_type", dict(zip(TYPES, ("inferred", "documented", "proposed", "declared", "traced"), strict=True)))
EV = f"ev AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS id, {SOURCE_OF} AS source, strftime(ts, '%H') AS loc, event_type AS detail, event_id AS ord FROM events)"
ATTENTION = "CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END, CASE WHEN len(gate) > 0 THEN 0 ELSE 1 END, id"
BOTH = ops("(SELECT * FROM events WHERE event_id % 9 <> 0)", "old") + ", " + ops("(SELECT * FROM events WHERE event_id % 11 <> 0)", "new")
DEFAULT_OF = " ".join(f"WHEN list_contains(deferred_gates, '{g}') THEN '{t}'" for g, t in SAFE_DEFAULTS.items())
FIELDS = {"stage": "{}.stage", "effect": "{}.effect", "requires": "array_to_string({}.requires, ',')", "gate": "array_to_string({}.gate, ',')", "optional": "CAST({}.optional AS VARCHAR)", "confidence": "{}.confidence", "stand_in": "{}.stand_in"}
CHANGES = " UNION ALL ".join(f"SELECT o.id, 'changed' AS change, '{f}' AS field, {x.format('o')} AS old, {x.format('n')} AS new FROM old o JOIN new n USING (id) WHERE {x.format('o')} IS DISTINCT FROM {x.format('n')}" for f, x in FIELDS.items())
MONTH = "m AS (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m') AS month FROM events)"

DAMAGED = f"""{ops()}, dmg AS (SELECT day, user_id % 8 AS r, CASE WHEN user_id % 8 = 1 THEN id ELSE translate(id, '/', '-') END AS id, CASE user_id % 8 WHEN 2 THEN 'later' WHEN 3 THEN NULL ELSE stage END AS stage, effect, confidence,
 CASE WHEN user_id % 8 = 4 THEN [] ELSE requires END AS requires, CASE WHEN user_id % 8 = 5 THEN ['other'] ELSE gate END AS gate FROM ops), dbl AS (SELECT * FROM dmg UNION ALL SELECT * FROM dmg WHERE r = 6)"""
ORDERED = ("executable", "n_ask_user", "n_drop", "n_mcp", "n_native", "n_script", "operations", "optional", "required")

SQL = {
    "op_validate_inventory": f"""WITH {DAMAGED} SELECT day, id, 'id-form' AS rule FROM dbl WHERE NOT regexp_matches(id, '^[a-z0-9]+(-[a-z0-9]+)*$')
UNION ALL SELECT day, id, 'stage' FROM dbl WHERE stage IS NULL OR stage NOT IN {STAGES} UNION ALL SELECT day, id, 'requires-empty' FROM dbl WHERE len(requires) = 0
UNION ALL SELECT day, id, 'gate' FROM dbl WHERE list_contains(gate, 'other') UNION ALL SELECT day, id, 'duplicate-id' FROM dbl GROUP BY day, id HAVING count(*) > 1""",
    "op_validate_inventory_fields": "WITH u AS (SELECT DISTINCT user_id, user_id % 7 AS r FROM events) SELECT 'u' || user_id AS repo, ['repo-class', 'repo-class', 'status', 'schema-version'][r] AS rule FROM u WHERE r BETWEEN 1 AND 4",
    "op_validate_package": "WITH f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END || '-' || doc_id AS name, text FROM documents) SELECT name, 'lines' AS rule FROM f WHERE length(text) - length(replace(text, chr(10), '')) + 1 > 500 UNION ALL SELECT name, 'tokens' FROM f WHERE length(text) // 4 > 5000 UNION ALL SELECT name, 'name' FROM f WHERE NOT regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*$')",
    "snk_report_json": f"WITH {RES}, c AS (SELECT profile, day, {COUNTS} FROM res GROUP BY profile, day) SELECT profile, day, CAST(to_json(struct_pack({', '.join(f'{c} := {c}' for c in ORDERED)})) AS VARCHAR) AS report FROM c",
    "snk_report_text": f"WITH {RES} SELECT profile, id, rpad(id, 24, ' ') || rpad(binding, 10, ' ') || printf('%5.2f', CAST(coverage AS DOUBLE)) || '  ' || {text('gates')} AS line FROM res",
    "snk_review_md": f"WITH {ops()} SELECT id, '- (' || confidence || ') `' || id || '` needs ' || array_to_string(requires, ', ') || CASE WHEN len(gate) > 0 THEN ' [gates: ' || array_to_string(gate, ', ') || ']' ELSE '' END AS line FROM ops",
    "op_route": f"WITH {RES} SELECT profile, id, binding FROM res",
    "op_gates": f"WITH {RES} SELECT profile, id, {text('gates')} AS gates, {text('deferred_gates')} AS deferred_gates FROM res",
    "op_resolve": f"WITH {RES} SELECT profile, id, binding, stand_in, CAST(coverage AS DOUBLE) AS coverage, {text('missing')} AS missing FROM res",
    "op_summarise": f"WITH {RES} SELECT profile, stage, {COUNTS}, {names('gates')} AS gates, CAST(sum(len(gates)) AS BIGINT) AS gate_count, {names('deferred_gates')} AS deferred_gates, {ids('NOT optional AND binding = ' + chr(39) + 'ask-user' + chr(39))} AS n_halted, {ids('optional AND binding = ' + chr(39) + 'ask-user' + chr(39))} AS n_halted_optional, {ids('NOT optional AND binding = ' + chr(39) + 'drop' + chr(39))} AS n_lost, {ids('optional AND binding = ' + chr(39) + 'drop' + chr(39))} AS n_lost_optional, {ids('binding = ' + chr(39) + 'script' + chr(39))} AS n_degraded, CAST(coalesce(sum(CAST(round(coverage * 1000) AS BIGINT)) FILTER (NOT optional), 0) AS BIGINT) AS covered_milli FROM res GROUP BY profile, stage",
    "agg_outcomes": f"WITH {RES} SELECT profile, stage, CASE WHEN binding = 'ask-user' THEN CASE WHEN optional THEN 'halted_optional' ELSE 'halted' END WHEN binding = 'drop' THEN CASE WHEN optional THEN 'lost_optional' ELSE 'lost' END ELSE 'degraded' END AS outcome, id, stand_in, fidelity FROM res WHERE binding IN ('ask-user', 'drop', 'script')",
    "agg_binding_hist": f"WITH {RES} SELECT profile, day, {COUNTS} FROM res GROUP BY profile, day",
    "op_invariants": f"""WITH {RES}, bad AS (SELECT profile, id, user_id, optional, gate, declared, missing, CASE WHEN user_id % 10 = 1 THEN [] ELSE gates END AS gates, CASE WHEN user_id % 10 = 4 THEN [] ELSE deferred_gates END AS deferred, CASE WHEN user_id % 10 = 2 THEN 'drop' ELSE binding END AS binding, CASE WHEN user_id % 10 = 3 THEN 1.5 ELSE fidelity END AS fidelity, binding AS was FROM res)
SELECT profile, id, 'I1' AS invariant FROM bad WHERE binding IN ('native', 'mcp', 'script') AND NOT list_has_all(gates, gate)
UNION ALL SELECT profile, id, 'I2' FROM bad WHERE NOT optional AND binding = 'drop'
UNION ALL SELECT profile, id, 'I3' FROM bad WHERE NOT optional AND len(missing) > 0 AND declared IS NULL AND binding <> 'ask-user'
UNION ALL SELECT profile, id, 'I4' FROM bad WHERE declared IS NOT NULL AND binding = 'script' AND (fidelity IS NULL OR fidelity < 0 OR fidelity >= 1)
UNION ALL SELECT profile, id, 'I5' FROM bad WHERE binding = 'drop' AND NOT (was = 'drop' AND user_id % 10 <> 5)
UNION ALL SELECT profile, id, 'I6' FROM bad WHERE binding IN ('native', 'mcp', 'script') AND list_has_any(gate, ['publish', 'irreversible']) AND NOT list_has_any(gate, gates)
UNION ALL SELECT profile, id, 'I7' FROM bad WHERE len(gate) > 0 AND binding = 'ask-user' AND NOT list_has_all(deferred, gate)""",
    "op_questions": f"WITH {RES} SELECT profile, id, md5('Cannot run ''' || id || ''': missing ' || array_to_string(missing, ', ') || '.' || CASE WHEN len(deferred_gates) > 0 THEN ' Gates: ' || upper(array_to_string(deferred_gates, ', ')) || '.' ELSE '' END || ' Default: ' || CASE {DEFAULT_OF} ELSE 'do not proceed' END || '.') AS question_md5 FROM res WHERE binding = 'ask-user'",
    "prd_deterministic": f"WITH {ops()}, {VOC}, k AS (SELECT id, effect, unnest(requires) AS capability FROM ops) SELECT id, NOT bool_or(kind = 'generative') AND any_value(effect) IN ('read-local', 'effectful-local') AS deterministic FROM k JOIN voc USING (capability) GROUP BY id",
    "jn_standin_default": f"WITH {ops()}, {FID} SELECT id, stand_in, fidelity FROM ops LEFT JOIN fid USING (stand_in)",
    "jn_provider_caps": f"WITH {ops()}, p(provider, caps, hint, ambiguous) AS (VALUES ('shop', ['purchase', 'click'], 'spend', false), ('crm', ['signup'], 'privacy', false), ('web', ['view', 'click'], 'publish', true)) SELECT id, count(DISTINCT provider) AS corroboration, bool_or(ambiguous) AS ambiguous, string_agg(DISTINCT hint, ',' ORDER BY hint) AS gate_hints FROM ops JOIN p ON list_has_any(requires, caps) GROUP BY id",
    "jn_diff": f"WITH {BOTH} SELECT id, 'added' AS change, NULL AS field, NULL AS old, NULL AS new FROM new WHERE id NOT IN (SELECT id FROM old) UNION ALL SELECT id, 'removed', NULL, NULL, NULL FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL {CHANGES}",
    "jn_merge_reviewed": f"WITH {BOTH}, j AS (SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'disappeared' WHEN o.requires = n.requires THEN 'kept' ELSE 'changed' END AS status, n.stage AS ns, n.effect AS ne, n.confidence AS nc, o.stage AS os, o.effect AS oe FROM new n FULL JOIN old o ON o.id = n.id) SELECT id, status, CASE WHEN status IN ('new', 'changed') THEN ns ELSE os END AS stage, CASE WHEN status IN ('new', 'changed') THEN ne ELSE oe END AS effect, CASE WHEN status IN ('new', 'changed') THEN nc ELSE 'high' END AS confidence FROM j",
    "jn_apply_proposals": f"WITH {ops()} SELECT id, CASE WHEN ord % 14 = 0 THEN array_to_string(list_sort(list_distinct(list_append(requires, 'human.review'))), ',') ELSE {text('requires')} END AS requires, CASE WHEN ord % 14 = 0 AND n > 2 THEN array_to_string(list_sort(list_distinct(list_append(gate, 'legal'))), ',') ELSE {text('gate')} END AS gate, CASE WHEN ord % 14 = 0 THEN 'low' ELSE confidence END AS confidence FROM ops UNION ALL SELECT id || 'x', 'human.review', '', 'unknown' FROM ops WHERE ord % 7 = 0 AND ord % 2 <> 0",
    "snk_digest": f"WITH {ops()} SELECT id, stage, effect, {text('requires')} AS requires, {text('gate')} AS gate, confidence, array_to_string(list_sort(list_distinct(list_transform(requires, lambda c: CASE WHEN c = 'view' THEN 'traced' ELSE 'declared' END))), ',') AS sources FROM ops",
    "agg_merge_ops": f"WITH {ops()} SELECT day, stage, effect, {text('requires')} AS requires, {text('gate')} AS gate, optional, arg_min(id, ord) AS id, arg_min(confidence, ord) AS confidence, min(ord) AS ord, arg_min(summary, ord) FILTER (summary <> '') AS summary, string_agg(id, ',' ORDER BY ord) AS merged_ids FROM ops WHERE len(requires) > 0 OR len(gate) > 0 GROUP BY day, stage, effect, ops.requires, ops.gate, optional",
    "agg_merge_evidence": f"WITH {ops()}, m AS (SELECT *, arg_min(id, ord) OVER (PARTITION BY day, stage, effect, requires, gate, optional) AS merged_id FROM ops WHERE len(requires) > 0 OR len(gate) > 0) SELECT day, merged_id, ord, CAST(0 AS BIGINT) AS place, 'traced' AS source, CAST(ord AS VARCHAR) AS loc FROM m UNION ALL SELECT day, merged_id, ord, 1, 'declared', CAST(n AS VARCHAR) FROM m",
    "topk_class_cap": f"WITH {ops()}, r AS (SELECT day, id, ['library', 'cli-tool', 'service-app', 'agent-system'][CAST(substr(day, 9, 2) AS INT) % 4 + 1] AS cls, row_number() OVER (PARTITION BY day ORDER BY CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, id) AS place FROM ops) SELECT day, id, place FROM r WHERE place <= CASE cls WHEN 'library' THEN 25 WHEN 'cli-tool' THEN 60 WHEN 'service-app' THEN 80 ELSE 40 END",
    "sort_attention": f"WITH {ops()} SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY {ATTENTION}) AS place FROM ops",
    "agg_dominant_effect": f"WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS hour, {EFFECT_OF} AS effect FROM events WHERE event_type <> 'signup' OR user_id % 2 = 0) SELECT user_id, hour, {lst(fusion.EFFECTS)}[max(list_position({lst(fusion.EFFECTS)}, effect))] AS effect FROM e GROUP BY user_id, hour",
    "agg_first_opid": "SELECT user_id, event_type, event_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "agg_evidence_dedupe": f"WITH {EV}, o AS (SELECT id, source, loc, detail, min(ord) AS ord FROM ev GROUP BY ALL) SELECT id, string_agg(source || ':' || loc || ':' || detail, ',' ORDER BY list_position({lst(fusion.SOURCES)}, source), loc, ord) AS evidence FROM o GROUP BY id",
    "fn_confidence_fuse": f"""WITH {EV}, s AS (SELECT id, list(DISTINCT source) AS s, count(DISTINCT loc) AS places, min(ord) % 5 = 0 AS amb, CASE WHEN min(ord) % 7 = 0 THEN 'medium' ELSE 'high' END AS high, min(ord) % 11 = 0 AS ph FROM ev GROUP BY id)
SELECT id, CASE WHEN len(list_filter(s, lambda x: x <> 'proposed')) = 0 THEN 'low' WHEN ph THEN 'low' WHEN list_contains(s, 'declared') THEN CASE WHEN amb THEN 'medium' ELSE high END WHEN list_has_all(s, ['traced', 'inferred']) THEN CASE WHEN amb THEN 'medium' ELSE high END WHEN list_contains(s, 'traced') THEN 'medium' WHEN list_contains(s, 'inferred') THEN CASE WHEN amb THEN 'low' WHEN places >= 2 THEN high ELSE 'medium' END ELSE 'low' END AS confidence FROM s""",
    "jn_interval_innermost": f"WITH {MONTH}, r AS (SELECT user_id, month, event_type, min(event_id) AS lo, max(event_id) AS hi FROM m WHERE event_type <> 'error' GROUP BY ALL) SELECT s.event_id, r.event_type, lo, hi FROM m s JOIN r ON r.user_id = s.user_id AND r.month = s.month AND s.event_id BETWEEN lo AND hi WHERE s.event_type = 'error' QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY hi - lo, r.event_type) = 1",
    "jn_leftover": f"WITH {MONTH}, r AS (SELECT user_id, month, min(event_id) AS lo, max(event_id) AS hi FROM m WHERE event_type = 'purchase' GROUP BY ALL), o AS (SELECT user_id, month, count(*) AS n, min(event_id) AS owner FROM m WHERE event_type = 'signup' GROUP BY ALL) SELECT s.event_id, CASE WHEN n = 1 THEN owner END AS owner, n = 1 AS weak FROM m s JOIN o USING (user_id, month) WHERE s.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = s.user_id AND r.month = s.month AND s.event_id BETWEEN lo AND hi)",
    "jn_enclosing_service": "WITH x AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS as_of FROM conversations) SELECT conv_id, turn, as_of FROM x WHERE role <> 'user'",
    "jn_class_context": "WITH x AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS as_of FROM events) SELECT event_id, as_of FROM x WHERE event_type = 'click'",
    "jn_play_name": "WITH x AS (SELECT *, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER w AS t, last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, CASE WHEN t = 'signup' THEN i END AS name_id FROM x WHERE event_type = 'purchase'",
    "jn_catalog_lookup": "WITH c(p_type, name, provider) AS (VALUES ('ECONOMY', 'brand#1', 'acme'), ('SMALL', 'brand#2', 'beta'), ('PROMO', 'brand#11', 'acme'), ('LARGE', 'brand#25', 'core')) SELECT p_partkey, provider FROM part p LEFT JOIN c ON c.p_type = p.p_type AND c.name = lower(p_brand) WHERE lower(p_brand) NOT IN ('brand#3', 'brand#7', 'brand#9')",
    "src_caps": "WITH x AS (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM documents) SELECT * FROM x WHERE running <= 200000",
    "prd_expiry": "SELECT o_orderpriority, o_orderstatus, count(*) FILTER (CAST(o_orderdate AS DATE) < DATE '1997-01-01') AS expired, count(*) AS n FROM orders GROUP BY ALL",
    "lim_locations": "WITH x AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM events) SELECT user_id, event_type, string_agg(CAST(event_id AS VARCHAR), ', ' ORDER BY event_id) FILTER (p <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS locations FROM x GROUP BY user_id, event_type",
}
