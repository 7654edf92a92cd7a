"""The same queries as SQL for another engine, written from the rules and not from the Spark code.

Where the Spark side works on whole files in array form, the SQL works on a line table with window
frames; where Spark numbers rows in slices, the SQL uses one plain window.
"""

from __future__ import annotations

import re

from .. import fixed_values as fv
from . import corpus
from .catalog import POLICIES, arrival_sql, entry_name_sql, phrase_sql, url_sql, free_spelling_sql

CODE = "('.py', '.js', '.jsx', '.ts', '.tsx')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _squeeze(word: str) -> str:
    return re.sub("[^a-z0-9]", "", word.lower())


def _first(expr: str, words: list[str], key=lambda w: w) -> str:
    whens = " ".join(f"WHEN contains({expr}, {_q(key(w))}) THEN {_q(w)}" for w in words)
    return f"CASE {whens} END"


def _any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_q(w)})" for w in words) + ")"


def _whole(words: list[str]) -> str:
    return _q(r"\b(?:" + "|".join(words) + r")\b")


def _in(words: list[str]) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _base(layout: str = "project") -> str:
    """CTEs: ln (lines), hit (lines with control windows), fnd (all findings), fct (facts per unit)."""
    days = 15 if layout == "project" else 6
    unit = "'u' || user_id" if layout == "project" else "'u' || user_id || '-w' || period"
    frame = lambda k: f"OVER (PARTITION BY unit, path ORDER BY line_no ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    near = lambda cond, k: f"coalesce(bool_or({cond}) {frame(k)}, false)"
    secrets = [p for p, _, _ in fv.SECRET_RULES]
    sev = " ".join(f"WHEN regexp_matches(line, {_q(p)}) THEN {_q(s)}" for p, s, _ in fv.SECRET_RULES)
    name = " ".join(
        f"WHEN regexp_matches(line, {_q(p)}) THEN coalesce(nullif(upper(regexp_extract(line, {_q(p)}, 1)), ''), {_q(d)})"
        for p, _, d in fv.SECRET_RULES)
    fw = " ".join(f"WHEN regexp_matches(line, {_q('(?i)' + p)}) THEN {_q(n)}" for n, p in fv.FRAMEWORK_PATTERNS)
    json_keys = ", ".join(f"CASE WHEN contains(low, {_q(chr(34) + k + chr(34) + ':')}) THEN {_q(k)} END" for k in fv.SENSITIVE_JSON_KEYS)
    return f"""
WITH ev AS (
  SELECT event_id, user_id, props, CAST(date_diff('day', DATE '{corpus.FIRST_DAY}', CAST(ts AS DATE)) // {days} AS INTEGER) AS period,
         {corpus.kind_sql()} AS kind FROM events
), nu AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, period ORDER BY event_id) AS INTEGER) AS line_no,
         count(*) OVER (PARTITION BY user_id, period) AS last_no, {corpus.extension_sql(layout)} AS ext FROM ev
), ln AS (
  SELECT {unit} AS unit, period, ext, {corpus.path_sql(layout)} AS path, line_no, {corpus.line_sql()} AS line FROM nu
), hit AS (
  SELECT *,
    {near(f"regexp_matches(lower(line), {_whole(fv.MITIGATION_APPROVAL_WORDS)})", 15)} AS m_approval,
    {near(f"regexp_matches(lower(line), {_whole(fv.MITIGATION_AUDIT_WORDS)})", 15)} AS m_audit,
    {near(_any("lower(line)", fv.MITIGATION_WRAPPER_WORDS), 15)} AS m_wrapper,
    {near(_any("lower(line)", fv.MASKING_WORDS), 10)} AS m_masking,
    {near(_any("lower(line)", fv.FRAMEWORK_APPROVAL_WORDS), 12)} AS f_approval,
    {near(_any("lower(line)", fv.APPROVAL_WORDS), 10)} AS s_approval,
    {near(_any("lower(line)", fv.AUDIT_WORDS), 15)} AS s_audit,
    CASE WHEN ext = '.py' THEN regexp_extract(line, '(?i)def\\s+(\\w+)\\s*\\(', 1)
         WHEN ext IN {CODE} THEN coalesce(nullif(regexp_extract(line, '(?i)function\\s+(\\w+)\\s*\\(', 1), ''),
           regexp_extract(line, '(?i)(?:const|let|var)\\s+(\\w+)\\s*=\\s*(?:async\\s*)?(?:\\([^)]*\\)|\\w+)\\s*=>', 1))
         ELSE '' END AS fn,
    CASE WHEN ext IN {CODE} THEN CASE {fw} END END AS framework
  FROM ln
), named AS (
  SELECT *, regexp_replace(lower(fn), '[^a-z0-9]', '', 'g') AS squeezed, regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS sline FROM hit
), words AS (
  SELECT *, {_first("squeezed", fv.CRITICAL_TOOL_WORDS, _squeeze)} AS critical_word,
    {_first("squeezed", fv.HIGH_TOOL_WORDS, _squeeze)} AS high_word,
    {_first("lower(fn)", fv.DATA_ACCESS_WORDS)} AS data_word,
    CASE WHEN framework IS NOT NULL THEN {_first("sline", fv.FRAMEWORK_RISK_WORDS, _squeeze)} END AS fw_word
  FROM named
), tool AS (
  SELECT unit, path, line_no, line, fn, coalesce(critical_word, high_word) AS keyword, m_approval OR m_audit AS partial, s_approval, s_audit,
    'Risky function ''' || fn || ''' detected' AS title,
    CASE WHEN m_approval OR m_audit THEN CASE WHEN critical_word IS NOT NULL THEN 'Medium' ELSE 'Low' END
         WHEN critical_word IS NOT NULL THEN 'Critical' ELSE 'High' END AS severity
  FROM words WHERE (critical_word IS NOT NULL OR high_word IS NOT NULL) AND NOT ((m_approval AND m_audit) OR m_wrapper)
), frame AS (
  SELECT unit, path, line_no, line, framework, fw_word AS keyword, s_approval, s_audit,
    'Risky agent tool registration detected in ' || framework AS title,
    CASE WHEN fw_word IN {_in(fv.FRAMEWORK_HIGH_WORDS)} THEN 'High' ELSE 'Medium' END AS severity
  FROM words WHERE fw_word IS NOT NULL AND NOT f_approval
), json_files AS (
  SELECT unit, path, string_agg(line, chr(10) ORDER BY line_no) AS body, min(line) FILTER (line_no = 1) AS line FROM ln WHERE ext = '.json' GROUP BY 1, 2
), json_found AS (
  SELECT *, list_filter([{json_keys}], lambda k: k IS NOT NULL) AS keys FROM (SELECT *, lower(body) AS low FROM json_files WHERE json_valid(body))
), fnd AS (
  SELECT unit, path, line_no, 0 AS stage, 0 AS sub_ord, 'secret' AS rule, 'Hardcoded ' || (CASE {name} END) || ' detected' AS title,
    CASE {sev} END AS severity, 'Secret Exposure Risk' AS category, line, CASE {name} END AS subject, CAST(NULL AS VARCHAR) AS keyword, CAST(NULL AS BOOLEAN) AS partial
  FROM ln WHERE {" OR ".join(f"regexp_matches(line, {_q(p)})" for p in secrets)}
  UNION ALL SELECT unit, path, 1, 0, 1, 'prompt', {_q(fv.PROMPT_TITLE)}, 'Medium', 'Prompt Injection Risk', line, NULL, NULL, NULL
  FROM ln WHERE ext = '.txt' AND line_no = 1
  UNION ALL SELECT unit, path, line_no, 1, 0, 'tool', title, severity, 'Tool Permission Risk', line, fn, keyword, partial FROM tool
  UNION ALL SELECT unit, path, line_no, 1, 1, 'data', 'Data-access function ''' || fn || ''' without masking', 'High', 'Data Exposure Risk', line, fn, data_word, NULL
  FROM words WHERE data_word IS NOT NULL AND NOT m_masking
  UNION ALL SELECT unit, path, 1, 1, 0, 'json', {_q(fv.JSON_TITLE)}, 'Medium', 'Data Exposure Risk', line, NULL,
    array_to_string(list_transform(keys, lambda k: '''' || k || ''''), ', '), NULL
  FROM json_found WHERE len(keys) > 0
  UNION ALL SELECT unit, path, line_no, 2, 0, 'framework', title, severity, 'Tool Permission Risk', line, framework, keyword, NULL FROM frame
  UNION ALL SELECT unit, path, line_no, 3, 0, 'approval', 'No human approval gate found near ''' || title || '''', severity, 'Human Approval Risk', line, fn, NULL, NULL FROM tool WHERE NOT s_approval
  UNION ALL SELECT unit, path, line_no, 4, 0, 'approval', 'No human approval gate found near ''' || title || '''', severity, 'Human Approval Risk', line, framework, NULL, NULL FROM frame WHERE NOT s_approval
  UNION ALL SELECT unit, path, line_no, 5, 0, 'audit', 'No audit logging found near ''' || title || '''', CASE severity WHEN 'Critical' THEN 'High' ELSE 'Medium' END, 'Auditability Risk', line, fn, NULL, NULL FROM tool WHERE NOT s_audit
  UNION ALL SELECT unit, path, line_no, 6, 0, 'audit', 'No audit logging found near ''' || title || '''', CASE severity WHEN 'Critical' THEN 'High' ELSE 'Medium' END, 'Auditability Risk', line, framework, NULL, NULL FROM frame WHERE NOT s_audit
), units AS (SELECT DISTINCT unit FROM ln)"""


def _facts_cte() -> str:
    weight = "CASE severity WHEN 'Critical' THEN 40 WHEN 'High' THEN 25 WHEN 'Medium' THEN 15 WHEN 'Low' THEN 5 ELSE 0 END"
    scores = ", ".join(
        f"CAST(least(coalesce(sum({weight}) FILTER (category = {_q(c)}), 0), 100) AS INTEGER) AS score_{k}, "
        f"count(*) FILTER (category = {_q(c)}) AS n_{k}" for c, k in fv.CATEGORY_KEYS.items())
    counts = ", ".join(f"count(*) FILTER (severity = '{s.capitalize()}') AS n_{s}" for s in fv.SEVERITY_RANKS)
    risk = " + ".join(f"score_{k} * {w}::DOUBLE" for k, w in fv.CATEGORY_WEIGHTS.items())
    return f""", fct AS (
  SELECT unit, {counts}, {scores},
    count(*) FILTER (category = 'Secret Exposure Risk') AS blocking_secrets,
    count(*) FILTER (category = 'Human Approval Risk' AND severity IN ('Critical', 'High')) AS blocking_approvals,
    count(*) FILTER (category = 'Tool Permission Risk' AND severity IN ('Critical', 'High')) AS blocking_tools
  FROM units LEFT JOIN fnd USING (unit) GROUP BY unit
), scr AS (
  SELECT *, CASE WHEN safety_score <= 25 THEN 'Critical Risk' WHEN safety_score <= 50 THEN 'High Risk' WHEN safety_score <= 75 THEN 'Moderate Risk'
    WHEN safety_score <= 90 THEN 'Low Risk' ELSE 'Strong' END AS status
  FROM (SELECT *, CAST(greatest(0, least(100, round_even(100.0::DOUBLE - (0.0::DOUBLE + {risk}), 0))) AS INTEGER) AS safety_score FROM fct)
)"""


def _policy_rows(policies: dict) -> str:
    rows = []
    for name, policy in policies.items():
        p = {**fv.DEFAULT_POLICY, **policy}
        rows.append(f"({_q(name)}, {p['minimum_safety_score']}, " + ", ".join(
            str(p[k]).lower() for k in ("block_on_critical", "block_on_secrets", "block_on_missing_approval", "block_on_unsafe_tools")) + ")")
    return "(VALUES " + ", ".join(rows) + ") AS p(policy_id, minimum_safety_score, b_critical, b_secrets, b_approval, b_tools)"


def _gate_cte(source: str) -> str:
    """jdg: one row per unit and policy row of `source` (a FROM clause over scr and policies)."""
    return f""", bl AS (
  SELECT *, list_filter([
      CASE WHEN safety_score < minimum_safety_score THEN 'Safety score is below ' || minimum_safety_score || '.' END,
      CASE WHEN b_critical AND n_critical > 0 THEN 'Critical findings are present (' || n_critical || ').' END,
      CASE WHEN b_secrets AND blocking_secrets > 0 THEN {_q(fv.BLOCKER_SECRETS)} END,
      CASE WHEN b_approval AND blocking_approvals > 0 THEN {_q(fv.BLOCKER_APPROVAL)} END,
      CASE WHEN b_tools AND blocking_tools > 0 THEN {_q(fv.BLOCKER_TOOLS)} END], lambda x: x IS NOT NULL) AS blockers
  FROM {source}
), jdg AS (
  SELECT *, CASE WHEN len(blockers) > 0 THEN 'BLOCK' WHEN n_high > 0 OR n_medium > 0 THEN 'REVIEW' ELSE 'ALLOW' END AS decision,
    CAST(greatest(0, least(100, safety_score - least(8 * len(blockers), 32) - CASE WHEN n_critical > 0 THEN 10 ELSE 0 END)) AS INTEGER) AS gate_score
  FROM bl
)"""


def _list(column: str) -> str:
    return f"array_to_string({column}, ' | ')"


def _history_cte() -> str:
    week = "CAST(regexp_extract(unit, '-w([0-9]+)$', 1) AS INTEGER)"
    user = "CAST(regexp_extract(unit, '^u([0-9]+)-', 1) AS BIGINT)"
    return _base("snapshot") + _facts_cte() + _gate_cte(f"scr CROSS JOIN {_policy_rows({'default': {}})}") + f""", rep AS (
  SELECT unit AS id, 'owner' || ({user} % 10) AS user_id, 'p' || ({user} // 2) AS project_name, 'upload' AS scan_type,
    {user} AS usr, TIMESTAMP '{corpus.FIRST_DAY} 08:00:00' + to_minutes(CAST({week} * 8640 + {user} % 7 AS INTEGER)) AS seen_at, safety_score, status, decision,
    n_critical || '/' || n_high || '/' || n_medium || '/' || n_low AS summary, CASE WHEN {user} % 9 <> 0 THEN
    TIMESTAMP '{corpus.FIRST_DAY} 08:00:00' + to_minutes(CAST({week} * 8640 + {user} % 7 AS INTEGER)) END AS created_at
  FROM jdg
)"""


def _pairs_cte() -> str:
    return """, pr AS (
  SELECT a.unit AS pair_id, a.unit AS before_id, b.unit AS after_id
  FROM (SELECT unit, split_part(unit, '-w', 1) AS u, CAST(split_part(unit, '-w', 2) AS INTEGER) AS w FROM units) a
  JOIN (SELECT unit, split_part(unit, '-w', 1) AS u, CAST(split_part(unit, '-w', 2) AS INTEGER) AS w FROM units) b ON a.u = b.u AND b.w = a.w + 1
)"""


_ORDER = "stage, path, line_no, sub_ord, title"
_KEY = "replace(replace(replace(lower(category), ' risk', ''), ' ', '_'), '/', '_')"
_IDS = f""", idf AS (
  SELECT *, {_KEY} || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY unit, category ORDER BY {_ORDER}) AS n FROM fnd)
)"""
def _blank(line: str) -> str:
    """Values of secrets blanked out."""
    return (
        f"regexp_replace(regexp_replace(regexp_replace({line}, '([\"''])[^\"''\\s]{{8,}}[\"'']', '\\1***\\1', 'g'), "
        f"'\\b(sk-|AIza)[A-Za-z0-9_-]{{16,}}', '\\1***', 'g'), '(://[^\\s:/@\"'']+):[^\\s:/@\"'']+@', '\\1:***@', 'g')")


_EVIDENCE = f"left(trim(CASE WHEN rule = 'secret' THEN {_blank('line')} ELSE line END), 220)"

_MOVES = ", mv AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT pair_id, {i} AS category_ord, {_q(k)} AS category_key, b.score_{k} AS before_risk, a.score_{k} AS after_risk, "
    f"b.score_{k} - a.score_{k} AS risk_reduction FROM pr JOIN scr b ON b.unit = before_id JOIN scr a ON a.unit = after_id"
    for i, k in enumerate(fv.CATEGORY_WEIGHTS)) + "\n)"

_SIDES = """, bf AS (SELECT pair_id, 'fixed' AS change, f.*, {key} AS k FROM pr JOIN {src} f ON f.unit = before_id),
 af AS (SELECT pair_id, 'new' AS change, f.*, {key} AS k FROM pr JOIN {src} f ON f.unit = after_id),
 ch AS (SELECT * FROM bf WHERE NOT EXISTS (SELECT 1 FROM af WHERE af.pair_id = bf.pair_id AND af.k = bf.k)
        UNION ALL SELECT * FROM af WHERE NOT EXISTS (SELECT 1 FROM bf WHERE bf.pair_id = af.pair_id AND bf.k = af.k))"""
_STABLE = "concat_ws('::', category, title, path, CAST(line_no AS VARCHAR))"

_NODE = "coalesce(nullif(regexp_extract(title, 'Risky function ''([^'']+)'' detected', 1), ''), lower(replace(title, ' ', '_')))"
_TOOLS = f""", tl AS (
  SELECT t.*, {_NODE} AS node,
    EXISTS (SELECT 1 FROM fnd x WHERE x.category = 'Human Approval Risk' AND x.unit = t.unit AND x.path = t.path AND x.line_no = t.line_no) AS no_gate,
    EXISTS (SELECT 1 FROM fnd x WHERE x.category = 'Auditability Risk' AND x.unit = t.unit AND x.path = t.path AND x.line_no = t.line_no) AS no_trail
  FROM fnd t WHERE category = 'Tool Permission Risk'
)"""


def _texts_cte() -> str:
    fmt = lambda text, *cols: "format(" + _q(text.replace("{", "{{").replace("}", "}}").replace("%s", "{}")) + "".join(f", {c}" for c in cols) + ")"
    return f""", txt AS (
  SELECT *, CASE rule
      WHEN 'tool' THEN CASE WHEN partial THEN {fmt(fv.TOOL_WHY_PARTIAL, 'subject', 'keyword')} ELSE {fmt(fv.TOOL_WHY, 'subject', 'keyword')} END
      WHEN 'data' THEN {fmt(fv.DATA_WHY, 'subject')} WHEN 'json' THEN {fmt(fv.JSON_WHY, 'keyword')}
      WHEN 'framework' THEN {fmt(fv.FRAMEWORK_WHY, 'keyword', 'subject')} WHEN 'approval' THEN {_q(fv.APPROVAL_WHY)}
      WHEN 'audit' THEN {_q(fv.AUDIT_WHY)} WHEN 'secret' THEN {_q(fv.SECRET_WHY)} ELSE {_q(fv.PROMPT_WHY)} END AS why_it_matters,
    CASE rule
      WHEN 'tool' THEN CASE WHEN partial THEN {fmt(fv.TOOL_FIX_PARTIAL, 'subject')} ELSE {fmt(fv.TOOL_FIX, 'subject')} END
      WHEN 'data' THEN {fmt(fv.DATA_FIX, 'subject')} WHEN 'json' THEN {_q(fv.JSON_FIX)}
      WHEN 'framework' THEN {_q(fv.FRAMEWORK_FIX)} WHEN 'approval' THEN {_q(fv.APPROVAL_FIX)}
      WHEN 'audit' THEN {_q(fv.AUDIT_FIX)} WHEN 'secret' THEN {_q(fv.SECRET_FIX)} ELSE {_q(fv.PROMPT_FIX)} END AS suggested_fix
  FROM fnd
)"""


def _phrase() -> str:
    whens = " ".join(
        f"WHEN contains(lower(category), {_q(n)}) OR {_any('lower(title)', ws)} THEN {_q(t)}" for n, ws, t in fv.FIX_PHRASES)
    return f"CASE {whens} ELSE {_q(fv.FIX_PHRASE_DEFAULT)} END"


def _checklist_cte() -> str:
    standing = ", ".join(f"CASE WHEN n_{k} > 0 THEN {_q(t)} END" for k, t in fv.CHECKLIST_CONDITIONAL)
    default = ", ".join(_q(t) for t in fv.CHECKLIST_DEFAULT)
    return _texts_cte() + f""", urg AS (
  SELECT unit, suggested_fix, row_number() OVER (PARTITION BY unit ORDER BY seen) AS r FROM (
    SELECT unit, suggested_fix, min(rn) AS seen FROM (
      SELECT *, row_number() OVER (PARTITION BY unit ORDER BY {_ORDER}) AS rn FROM txt WHERE severity IN ('Critical', 'High')) GROUP BY 1, 2)
), chk AS (
  SELECT unit, CASE WHEN len(every) > 0 THEN every[1:8] ELSE [{default}] END AS checklist FROM (
    SELECT unit, list_concat(coalesce(urgent, []), list_filter([{standing}], lambda x: x IS NOT NULL)) AS every
    FROM fct LEFT JOIN (SELECT unit, list(suggested_fix ORDER BY r) AS urgent FROM urg GROUP BY unit) USING (unit))
)"""


def _case(expr: str, table: dict, i: int | None = None) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {_q(k)} THEN {_q(v if i is None else v[i])}" for k, v in table.items()) + " END"


def _scenario_cte(limit: int | None = 8) -> str:
    kinds = " ".join(f"WHEN contains(lower(category), {_q(n)}) THEN {_q(t)}" for n, t in fv.SCENARIO_TYPES)
    text = f"lower(title || ' ' || {_EVIDENCE})"
    risky = "refund|delete|email|shell|exec|execute|customer|payment|file|database|db"
    tool = (
        f"coalesce(nullif(regexp_extract({text}, '(?:function|def)\\s+[''\"]?([a-zA-Z_]\\w*)', 1), ''), "
        f"nullif(regexp_extract({text}, '\\b([a-zA-Z_]\\w*(?:{risky})[a-zA-Z_\\d]*)\\b', 1), ''), "
        f"{_first(text, fv.TOOL_HINTS)}, {_q(fv.TOOL_HINT_DEFAULT)})")
    caps = "CASE " + " ".join(f"WHEN contains(lower(tool), {_q(h)}) THEN {_q(c)}" for h, c in fv.TOOL_CAPABILITIES) + f" ELSE {_q(fv.TOOL_CAPABILITY_DEFAULT)} END"
    secret = f"coalesce({_first(f'upper(title || chr(10) || {_EVIDENCE})', fv.SECRET_NAMES)}, {_q(fv.SCENARIO_SECRET_DEFAULT)})"
    return f""", sc AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY priority_score DESC, seq) AS ord FROM (
    SELECT *, CASE severity WHEN 'Critical' THEN 100 WHEN 'High' THEN CASE WHEN bonus THEN 90 ELSE 80 END ELSE CASE WHEN bonus THEN 65 ELSE 55 END END AS priority_score,
      CASE WHEN kind IN ('tool_abuse', 'approval_bypass', 'audit_gap') THEN {tool} END AS tool, {secret} AS secret
    FROM (SELECT *, CASE {kinds} END AS kind, category IN ('Secret Exposure Risk', 'Tool Permission Risk', 'Human Approval Risk') AS bonus,
            row_number() OVER (PARTITION BY unit ORDER BY {_ORDER}) AS seq FROM idf WHERE severity IN ('Critical', 'High', 'Medium')) WHERE {'true' if limit is None else f'seq <= {limit}'})
), scn AS (
  SELECT *, CASE WHEN kind = 'tool_abuse' THEN {caps} END AS capability,
    CASE kind WHEN 'tool_abuse' THEN 'Unsafe ' || tool || ' tool path' WHEN 'secret_reuse' THEN secret || ' leakage path'
      ELSE {_case('kind', fv.SCENARIO_TITLES)} END AS scenario_title FROM sc
)"""


def _fix_cte(limit: int | None = 8) -> str:
    kinds = " ".join(f"WHEN contains(lower(category), {_q(n)}) OR {_any('lower(title)', ws)} THEN {_q(t)}" for n, ws, t in fv.FIX_TYPES)
    text = f"title || chr(10) || {_EVIDENCE}"
    tool = (
        f"coalesce(nullif(regexp_extract({text}, '(?:def|function)\\s+([a-zA-Z_]\\w*)', 1), ''), "
        f"nullif(regexp_extract({text}, '[''\"]([a-zA-Z_]\\w*)[''\"]', 1), ''), {_first(f'lower({text})', fv.FIX_TOOL_HINTS)}, {_q(fv.FIX_TOOL_DEFAULT)})")
    secret = (
        f"coalesce({_first(f'upper({text})', fv.SECRET_NAMES)}, nullif(regexp_extract(upper({text}), '\\b([A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD))\\b', 1), ''), "
        f"{_q(fv.SECRET_NAME_DEFAULT)})")
    slug = lambda c: f"trim(regexp_replace(lower({c}), '[^a-zA-Z0-9]+', '-', 'g'), '-')"
    return f""", fx AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY {_ORDER}) AS ord FROM (SELECT *, CASE {kinds} END AS patch_type FROM idf) WHERE patch_type IS NOT NULL
), fix AS (
  SELECT *, {tool} AS tool, {secret} AS secret, {slug('id')} || '-' || {slug('patch_type')} || '.patch' AS patch_filename,
    CASE WHEN patch_type = 'tool_scope_guard' OR (patch_type = 'prompt_input_sanitization' AND path LIKE '%.txt') THEN 'low' ELSE 'medium' END AS confidence
  FROM fx WHERE {'true' if limit is None else f'ord <= {limit}'}
)"""


def oracle_sql() -> dict[str, str]:
    P, S = _base(), _base("snapshot")
    F = _facts_cte()
    unit = "unit AS project_id"
    place = f"{unit}, path, line_no"
    judged = P + F + _gate_cte(f"scr CROSS JOIN {_policy_rows(POLICIES)}")
    hist = _history_cte()
    number = "CAST(substr(unit, 2) AS BIGINT)"
    out: dict[str, str] = {}

    breaks = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
    out["document_lines"] = f"""
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, CAST(len(list_filter(l, lambda x: x = '')) AS INTEGER) AS n_empty,
  CAST(coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS INTEGER) AS longest
FROM (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS l
      FROM (SELECT doc_id, string_split_regex(text, '{breaks}') AS p FROM documents))"""
    out["function_definitions"] = P + f"""
SELECT {place}, fn, coalesce(critical_word, high_word) AS tool_word,
  CASE WHEN critical_word IS NOT NULL THEN 'Critical' WHEN high_word IS NOT NULL THEN 'High' END AS tool_tier, data_word
FROM words WHERE fn <> ''"""
    out["scan_findings"] = P + f" SELECT {place}, stage, sub_ord, rule, title, severity, category FROM fnd"
    out["tool_findings"] = P + f" SELECT {place}, title, severity, keyword, partial FROM fnd WHERE rule = 'tool'"
    for name, rule in [("data_exposure_findings", "data"), ("framework_findings", "framework"), ("json_key_findings", "json")]:
        out[name] = P + f" SELECT {place}, title, severity, keyword FROM fnd WHERE rule = '{rule}'"
    out["secret_findings"] = P + f" SELECT {place}, title, severity, category FROM fnd WHERE rule IN ('secret', 'prompt')"

    sev = " ".join(f"WHEN regexp_matches(line, {_q(p)}) THEN {_q(s)}" for p, s, _ in fv.SECRET_RULES)
    name = " ".join(
        f"WHEN regexp_matches(line, {_q(p)}) THEN coalesce(nullif(upper(regexp_extract(line, {_q(p)}, 1)), ''), {_q(d)})" for p, _, d in fv.SECRET_RULES)
    ws = r"[\s\x1C-\x1F\x{85}\x{A0}\p{Z}]"
    trimmed = f"regexp_replace(line, '^{ws}+|{ws}+$', '', 'g')"
    blank = f"left({_blank(trimmed)}, 220)"
    out["document_secrets"] = f"""
WITH ln AS (SELECT source, doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no
            FROM (SELECT source, doc_id, string_split_regex(text, '{breaks}') AS p FROM documents)),
found AS (SELECT *, CASE {sev} END AS severity, CASE {name} END AS name FROM ln)
SELECT source AS project_id, 'd' || doc_id || '.txt' AS path, CAST(line_no AS INTEGER) AS line_no, 'Hardcoded ' || name || ' detected' AS title, severity, {blank} AS evidence
FROM found WHERE severity IS NOT NULL"""
    out["custom_rules"] = P + f""", given AS (
  SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'sk-demo-' || c_custkey || '-value' WHEN 1 THEN 'jwt-demo-' || c_custkey || '-' ELSE 'pw' || c_custkey || '@' END AS phrase,
    CASE c_custkey % 3 WHEN 0 THEN 'Critical' ELSE 'High' END AS severity FROM customer
), shown AS (SELECT unit, path, line_no, lower(line) AS low,
  coalesce(bool_or(contains(lower(line), 'mask_fields') OR contains(lower(line), 'sanitize')) OVER (PARTITION BY unit, path ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), false) AS excused FROM ln)
SELECT {place}, CAST(k AS VARCHAR) AS rule, severity, 'Known key ' || k || ' in use' AS title, phrase AS keyword
FROM (SELECT * FROM shown WHERE contains(low, '-demo-') OR contains(low, 'pw')) s JOIN given ON contains(low, phrase) WHERE NOT (k % 2 = 0 AND excused)"""
    said = lambda script: " ".join(
        f"WHEN {k} THEN {_q(re.search(r'([A-Za-z_]+)[(]', t[script].replace('api.', ''))[1])}" for k, t in corpus.FLOW_LINES.items() if k in (2, 3, 8, 10, 12, 15) and "(" in t[script])
    out["input_reaches_action"] = f"""
WITH ln AS (
  SELECT doc_id, doc_id % 2 = 0 AS py, unnest(range(len(p))) + 1 AS line_no, length(unnest(p)) % {corpus.FLOWS} AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS p FROM documents)
), lv AS (
  SELECT *, CASE WHEN py THEN CASE WHEN k IN (0, 6) THEN 0 WHEN k IN (8, 15) THEN 8 ELSE 4 END
    ELSE coalesce(sum(CASE WHEN k IN (0, 7, 13) THEN 1 WHEN k IN (6, 14, 15) THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS level
  FROM ln
), st AS (SELECT * FROM lv WHERE NOT (py AND k = 14)),
df AS (SELECT doc_id, line_no AS begun, level AS base, k AS opener FROM st WHERE k IN (0, 13)),
ends AS (SELECT df.doc_id, begun, min(line_no) AS past FROM df JOIN st ON df.doc_id = st.doc_id AND line_no > begun AND level <= base GROUP BY ALL),
blocks AS (SELECT df.*, coalesce(past, 1 << 30) AS past FROM df LEFT JOIN ends USING (doc_id, begun)),
inn AS (SELECT b.begun, b.opener, s.* FROM blocks b JOIN st s ON b.doc_id = s.doc_id AND s.line_no > b.begun AND s.line_no < b.past),
o AS (SELECT *, coalesce(last_value(CASE WHEN k = 1 THEN opener = 0 WHEN k IN (4, 5) THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id, begun ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opener = 13) AS ordered FROM inn),
t AS (SELECT *, coalesce(bool_or(k = 11 AND ordered) OVER (PARTITION BY doc_id, begun ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS totalled,
    CASE WHEN py THEN CASE k {said(0)} END ELSE CASE k {said(1)} END END AS subject,
    CASE opener WHEN 0 THEN 'task_' ELSE 'inner_' END || begun AS keyword FROM o)
SELECT 'd' || doc_id AS project_id, CASE WHEN py THEN 'src/flow.py' ELSE 'src/flow.ts' END AS path, CAST(line_no AS INTEGER) AS line_no, CAST(begun AS INTEGER) AS input_line,
  'Input of ''' || keyword || ''' reaches privileged call ''' || subject || '''' AS title, CASE WHEN k = 8 THEN 'High' ELSE 'Critical' END AS severity, subject, keyword
FROM t WHERE CASE WHEN k IN (2, 8) THEN ordered WHEN k IN (3, 10) THEN opener = 0 WHEN k = 12 THEN totalled WHEN k = 15 AND py THEN ordered OR totalled ELSE false END"""
    out["split_lines"], out["split_scan"] = out["document_lines"], out["scan_findings"]
    out["streamed_secrets"] = out["document_secrets"].replace(f", severity, {blank} AS evidence", ", severity")
    out["finding_texts"] = P + _texts_cte() + f" SELECT {place}, title, why_it_matters, suggested_fix FROM txt"
    out["mitigation_flags"] = P + f"""
SELECT {place}, fn, m_approval AS near_approval, m_audit AS near_audit, m_wrapper AS near_wrapper, m_masking AS near_masking FROM words WHERE fn <> ''"""
    for name, rule in [("missing_approval", "approval"), ("missing_audit", "audit")]:
        out[name] = P + f" SELECT {place}, stage, title, severity, category FROM fnd WHERE rule = '{rule}'"
    out["merged_findings"] = P + f" SELECT {place}, min(stage) AS stage, title, min(severity) AS severity FROM fnd WHERE rule IN ('tool', 'framework') GROUP BY unit, path, line_no, title, category"
    out["finding_ids"] = P + _IDS + f" SELECT {place}, id, title FROM idf"
    out["finding_evidence"] = P + f" SELECT {place}, title, {_EVIDENCE} AS evidence FROM fnd"

    out["category_scores"] = P + F + " " + " UNION ALL ".join(
        f"SELECT {unit}, {i} AS category_ord, '{k}' AS category_key, score_{k} AS score FROM fct" for i, k in enumerate(fv.CATEGORY_WEIGHTS))
    out["severity_summary"] = P + F + f" SELECT {unit}, n_critical, n_high, n_medium, n_low FROM fct"
    out["safety_scores"] = P + F + f" SELECT {unit}, safety_score, status FROM scr"
    out["category_presence"] = P + F + f" SELECT {unit}, " + ", ".join(f"n_{k} > 0 AS has_{k}" for k in fv.CATEGORY_WEIGHTS) + " FROM fct"
    ranked = " UNION ALL ".join(
        f"SELECT unit, score_{k} AS s, {i} AS o, '{k.replace('_', ' ')}' AS label FROM fct" for i, k in enumerate(fv.CATEGORY_WEIGHTS))
    out["top_categories"] = P + F + f"""
SELECT {unit}, string_agg(label, ' | ' ORDER BY r) FILTER (r <= 2) AS top2, string_agg(label, ' | ' ORDER BY r) FILTER (r <= 3) AS top3
FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY s DESC, o) AS r FROM ({ranked})) GROUP BY unit"""
    out["normalized_labels"] = """
WITH l AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' CRITICAL ' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'Info' ELSE event_type END AS s,
  CASE event_id % 7 WHEN 0 THEN 'prompt injection' WHEN 1 THEN 'SECRET EXPOSURE' WHEN 2 THEN 'Tool Permission Risk' WHEN 3 THEN 'Human Approval / Gate'
    WHEN 4 THEN 'data exposure risk' WHEN 5 THEN 'audit trail' ELSE event_type END AS c FROM events)
SELECT event_id, CASE lower(trim(s)) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity_rank,
  CASE lower(s) WHEN 'critical' THEN 40 WHEN 'high' THEN 25 WHEN 'medium' THEN 15 WHEN 'low' THEN 5 ELSE 0 END AS weight,
  CASE WHEN lower(c) LIKE '%prompt injection%' THEN 'Prompt Injection Risk' WHEN lower(c) LIKE '%secret exposure%' THEN 'Secret Exposure Risk'
    WHEN lower(c) LIKE '%tool permission%' THEN 'Tool Permission Risk' WHEN lower(c) LIKE '%human approval%' THEN 'Human Approval Risk'
    WHEN lower(c) LIKE '%data exposure%' THEN 'Data Exposure Risk' WHEN lower(c) LIKE '%audit%' THEN 'Auditability Risk' ELSE c END AS category,
  replace(replace(replace(lower(c), ' risk', ''), ' ', '_'), '/', '_') AS category_key FROM l"""

    out["gate_decisions"] = judged + f"""
SELECT {unit}, policy_id, minimum_safety_score, safety_score, decision, gate_score, {_list('blockers')} AS blockers, blocking_secrets, blocking_approvals, blocking_tools FROM jdg"""
    actions = f"""CASE decision WHEN 'REVIEW' THEN {_q(' | '.join(fv.REVIEW_ACTIONS))} WHEN 'ALLOW' THEN {_q(' | '.join(fv.ALLOW_ACTIONS))}
  ELSE array_to_string((list_filter([CASE WHEN list_contains(blockers, {_q(fv.BLOCKER_SECRETS)}) THEN {_q(fv.BLOCK_ACTION_SECRET)} END,
    {_q(fv.BLOCK_ACTIONS[0])}, {_q(fv.BLOCK_ACTIONS[1])}, CASE WHEN list_contains(blockers, {_q(fv.BLOCKER_APPROVAL)}) THEN {_q(fv.BLOCK_ACTION_APPROVAL)} END,
    CASE WHEN list_contains(blockers, {_q(fv.BLOCKER_TOOLS)}) THEN {_q(fv.BLOCK_ACTION_TOOL)} END], lambda x: x IS NOT NULL))[1:5], ' | ') END"""
    block = "format(" + _q(fv.GATE_SUMMARIES["BLOCK"].replace("%s", "{}")) + ", safety_score, minimum_safety_score, len(blockers))"
    out["gate_actions"] = judged + f""", sm AS (SELECT *, CASE decision WHEN 'BLOCK' THEN {block} WHEN 'REVIEW' THEN {_q(fv.GATE_SUMMARIES['REVIEW'])} ELSE {_q(fv.GATE_SUMMARIES['ALLOW'])} END AS gate_summary FROM jdg)
SELECT {unit}, policy_id, {_case('decision', fv.DECISION_BADGES)} AS decision_badge, gate_summary, coalesce(blockers[1], gate_summary) AS decision_reason,
  {_case('decision', fv.REQUIRED_ACTIONS)} AS required_action, {actions} AS next_actions FROM sm"""
    asked = f"""(SELECT *, CAST(CASE WHEN {number} % 3 = 0 THEN 60 WHEN {number} % 3 = 1 THEN 85 ELSE 75 END AS INTEGER) AS minimum_safety_score,
  {number} % 2 <> 0 AS b_critical, true AS b_secrets, true AS b_approval, true AS b_tools FROM scr)"""
    out["gate_requests"] = P + F + _gate_cte(asked) + f" SELECT {unit}, minimum_safety_score, decision, gate_score, {_list('blockers')} AS blockers FROM jdg"
    band = lambda k: f"CASE WHEN score_{k} <= 39 THEN 'lower_risk' WHEN score_{k} <= 69 THEN 'watch_and_review' ELSE 'fix_first' END"
    out["gate_fallback"] = P + F + f"""
SELECT {unit}, CASE WHEN {number} % 4 = 0 THEN 'REVIEW' WHEN safety_score >= 80 THEN 'ALLOW' WHEN safety_score >= 60 THEN 'REVIEW' ELSE 'BLOCK' END AS decision,
  {band('tool_permission')} AS tool_band, {band('data_exposure')} AS data_band FROM scr"""

    out["report_cards"] = hist + " SELECT id, project_name, scan_type, safety_score, status, summary, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM rep"
    out["history_figures"] = hist + " SELECT user_id, count(*) AS reports, arg_max(safety_score, (coalesce(created_at, TIMESTAMP '1900-01-01'), id)) AS latest_score, count(*) FILTER (decision = 'BLOCK') AS blocked FROM rep GROUP BY user_id"
    out["score_series"] = hist + """ SELECT project_name, strftime(date_trunc('minute', created_at), '%Y-%m-%d %H:%M') AS minute, arg_max(safety_score, id) AS safety_score FROM (
  SELECT *, row_number() OVER (PARTITION BY project_name, date_trunc('minute', created_at) ORDER BY created_at DESC, id DESC) AS r FROM rep) WHERE r = 1 GROUP BY 1, 2"""
    out["score_changes"] = hist + " SELECT id, project_name, safety_score, CASE WHEN created_at IS NOT NULL THEN safety_score - lag(safety_score) OVER (PARTITION BY user_id, project_name, created_at IS NULL ORDER BY created_at, id) END AS score_delta FROM rep"
    out["grouped_reports"] = hist + """
SELECT group_id, count(*) AS reports, CAST(sum(safety_score) AS BIGINT) AS score_sum FROM (
  SELECT 'g3' AS group_id, * FROM rep WHERE usr % 3 = 0 UNION ALL SELECT 'g5', * FROM rep WHERE usr % 5 = 0) GROUP BY 1"""
    out["ungrouped_reports"] = hist + " SELECT id, safety_score FROM rep WHERE usr % 3 <> 0 AND usr % 5 <> 0"
    out["stored_reports"] = hist + " SELECT id, user_id, safety_score FROM rep WHERE usr % 4 <> 0"
    one = P + F + _gate_cte(f"scr CROSS JOIN {_policy_rows({'default': {}})}")
    out["exported_reports"] = one + f"""
SELECT {unit}, safety_score, status, CAST(n_critical AS INTEGER) AS critical, score_tool_permission AS tool_permission, decision, CAST(len(blockers) AS INTEGER) AS n_blockers FROM jdg"""
    out["report_documents"] = one + f" SELECT {unit}, 'u/ä ' || unit AS id, safety_score, decision FROM jdg"
    out["streamed_reports"] = one + f" SELECT {unit}, safety_score, status, decision FROM jdg"
    out["tree_changes"] = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'changed' ELSE 'removed' END AS change,
  CASE doc_id % 4 WHEN 0 THEN md5(text || '.') WHEN 1 THEN md5(text || '. v2') END AS digest
FROM documents WHERE doc_id % 4 < 2 OR doc_id % 8 = 3"""
    out["daily_scores"] = hist + " SELECT strftime(seen_at, '%Y-%m-%d') AS day, project_name, count(*) AS reports, min(safety_score) AS lowest, max(safety_score) AS highest FROM rep GROUP BY 1, 2"
    arrival = arrival_sql(f"date_diff('day', DATE '{corpus.FIRST_DAY}', CAST(ts AS DATE))")
    out["late_reports"] = f"""
WITH a AS (SELECT event_id, ts, {arrival} AS k FROM events), m AS (SELECT k, max(ts) AS m FROM a GROUP BY k),
c AS (SELECT x.k, max(y.m) AS mark FROM m x JOIN m y ON y.k < x.k GROUP BY 1)
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM a JOIN c USING (k) WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark - INTERVAL 6 DAY"""
    out["validated_findings"] = """
SELECT event_id, CASE WHEN event_id % 8 >= 4 THEN 'valid' ELSE 'quarantined' END AS outcome, CASE WHEN event_id % 8 >= 4 THEN 't' || event_id END AS title,
  CASE event_id % 8 WHEN 0 THEN 'not json' WHEN 1 THEN 'category is not a text' WHEN 2 THEN 'title is not a text' WHEN 3 THEN 'line is not a whole number' ELSE event_type END AS category,
  CASE WHEN event_id % 8 >= 4 THEN CAST(event_id AS INTEGER) END AS line_no FROM events"""

    out["validated_reports"] = """
SELECT c_custkey, CASE WHEN m = 0 THEN 'valid' ELSE 'quarantined' END AS outcome,
  CASE m WHEN 0 THEN c_name WHEN 1 THEN 'status is not a text' WHEN 2 THEN 'safety_score is not a whole number' WHEN 3 THEN 'summary.low is not a whole number'
    WHEN 4 THEN 'a finding is not valid' ELSE 'not json' END AS detail,
  CASE WHEN m = 0 THEN CAST(c_custkey % 101 AS INTEGER) END AS safety_score, CASE WHEN m = 0 THEN 1 END AS n_findings
FROM (SELECT *, c_custkey % 6 AS m FROM customer)"""
    out["versioned_reports"] = f"""
SELECT c_custkey, CASE m WHEN 0 THEN 'plain' WHEN 1 THEN 'gated' WHEN 2 THEN 'saved' WHEN 3 THEN 'table' END AS version,
  CASE WHEN m = 1 THEN 'r1' END AS id, CASE WHEN m = 2 THEN 'u' END AS user_id, CASE WHEN m < 4 THEN c_name END AS project_name,
  CASE WHEN m < 4 THEN s END AS safety_score,
  CASE WHEN m IN (1, 2) THEN 'REVIEW' WHEN m IN (0, 3) THEN CASE WHEN s >= {fv.FALLBACK_ALLOW_SCORE} THEN 'ALLOW' WHEN s >= {fv.FALLBACK_REVIEW_SCORE} THEN 'REVIEW' ELSE 'BLOCK' END END AS decision,
  CASE WHEN m = 2 THEN '2024' END AS created_at, CASE WHEN m < 3 THEN 1 END AS high, CASE WHEN m < 3 THEN 1 WHEN m = 3 THEN 2 END AS n_findings,
  CASE WHEN m < 4 THEN 'f' END AS path, CASE WHEN m < 4 THEN CAST(c_custkey AS INTEGER) END AS line_no,
  CASE m WHEN 0 THEN 'sector | summary.info' WHEN 3 THEN '' WHEN 4 THEN 'no known version' WHEN 5 THEN 'not json' ELSE 'deployment_gate.blockers | summary.info' END AS unknown,
  CASE WHEN m < 3 THEN 'cwe' WHEN m = 3 THEN 'cwe | ' END AS unknown_of_findings
FROM (SELECT *, c_custkey % 6 AS m, CAST(c_custkey % 101 AS INTEGER) AS s FROM customer)"""
    out["common_categories"] = P + f"""
SELECT {unit}, CAST(r AS INTEGER) AS ord, category, findings FROM (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY findings DESC, seen) AS r FROM (
    SELECT unit, category, count(*) AS findings, min(rn) AS seen FROM (
      SELECT *, row_number() OVER (PARTITION BY unit ORDER BY {_ORDER}) AS rn FROM fnd) GROUP BY 1, 2)) WHERE r <= 3"""

    out["changed_findings"] = S + _pairs_cte() + _SIDES.format(key=_STABLE, src="fnd") + " SELECT pair_id, change, unit AS report_id, path, line_no, title, severity FROM ch"
    out["changed_by_id"] = S + _IDS + _pairs_cte() + _SIDES.format(key=f"id || '::' || {_STABLE}", src="idf") + " SELECT pair_id, change, id, path, line_no, title FROM ch"
    out["category_movement"] = S + F + _pairs_cte() + _MOVES + " SELECT * FROM mv"
    out["largest_reduction"] = S + F + _pairs_cte() + _MOVES + """
SELECT pair_id, category_key, risk_reduction, risk_reduction > 0 AS shown FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY risk_reduction DESC, category_ord) AS r FROM mv) WHERE r = 1"""
    tally = lambda change, sev=None: f"count(*) FILTER (change = '{change}'" + (f" AND severity = '{sev}'" if sev else "") + ")"
    out["comparison_metrics"] = S + F + _pairs_cte() + _SIDES.format(key=_STABLE, src="fnd") + f"""
SELECT pair_id, b.safety_score AS before_score, a.safety_score AS after_score, a.safety_score - b.safety_score AS score_delta,
  CASE WHEN a.safety_score > b.safety_score THEN 'Security posture improved' WHEN a.safety_score < b.safety_score THEN 'Security posture regressed' ELSE 'No material score change' END AS verdict,
  coalesce(fixed, 0) AS fixed, coalesce(added, 0) AS added, coalesce(cf, 0) AS critical_fixed, coalesce(hf, 0) AS high_fixed, coalesce(ca, 0) AS critical_added, coalesce(ha, 0) AS high_added
FROM pr JOIN scr b ON b.unit = before_id JOIN scr a ON a.unit = after_id LEFT JOIN (
  SELECT pair_id, {tally('fixed')} AS fixed, {tally('new')} AS added, {tally('fixed', 'Critical')} AS cf, {tally('fixed', 'High')} AS hf,
    {tally('new', 'Critical')} AS ca, {tally('new', 'High')} AS ha FROM ch GROUP BY pair_id) USING (pair_id)"""

    strongest = "CASE WHEN bool_or(severity = 'Critical') THEN 'critical' WHEN bool_or(severity = 'High') THEN 'high' WHEN bool_or(severity = 'Medium') THEN 'medium' ELSE 'low' END"
    out["graph_edges"] = P + _TOOLS + f"""
SELECT {unit}, 'user' AS source, 'agent' AS target, {strongest} AS risk FROM units LEFT JOIN (SELECT * FROM fnd WHERE category = 'Prompt Injection Risk') USING (unit) GROUP BY unit
UNION ALL SELECT unit, 'agent', 'approval_' || node, 'low' FROM tl WHERE NOT no_gate
UNION ALL SELECT unit, 'approval_' || node, node, lower(severity) FROM tl WHERE NOT no_gate
UNION ALL SELECT unit, 'agent', node, lower(severity) FROM tl WHERE no_gate
UNION ALL SELECT unit, node, 'audit_log', 'low' FROM tl WHERE NOT no_trail"""
    out["graph_nodes"] = P + _TOOLS + f"""
SELECT DISTINCT unit AS project_id, id, label FROM (
  SELECT unit, 'user' AS id, 'User Prompt' AS label FROM units UNION ALL SELECT unit, 'agent', 'LLM Agent' FROM units
  UNION ALL SELECT unit, node, node || '()' FROM tl UNION ALL SELECT unit, 'approval_' || node, 'Approval Gate: ' || node FROM tl WHERE NOT no_gate
  UNION ALL SELECT unit, 'audit_log', 'Audit Log' FROM tl WHERE NOT no_trail)"""
    out["risk_scenarios"] = P + _IDS + _scenario_cte() + f"""
SELECT {unit}, CAST(ord AS INTEGER) AS ord, id AS finding_id, scenario_title, kind AS simulation_type, lower(severity) AS risk_level, priority_score, path || ':' || line_no AS location,
  tool, capability, {_case('kind', fv.SCENARIO_TEXTS, 0)} AS guardrail, {_case('kind', fv.SCENARIO_TEXTS, 1)} AS precondition, {_case('kind', fv.SCENARIO_TEXTS, 2)} AS detection_signal FROM scn"""
    controls = {k: " | ".join(v[0]) for k, v in fv.FIX_TEXTS.items()}
    reduction = {k: v[1] for k, v in fv.FIX_TEXTS.items()}
    steps = "CASE patch_type " + " ".join(f"WHEN {_q(k)} THEN {len(v[2]) + 2}" for k, v in fv.FIX_TEXTS.items()) + " END"
    lang = "CASE lower(split_part(path, '.', -1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.LANGUAGES.items()) + " ELSE 'text' END"
    out["fix_previews"] = P + _IDS + _fix_cte() + f"""
SELECT {unit}, CAST(ord AS INTEGER) AS ord, id AS finding_id,
  CASE patch_type WHEN 'env_secret_fix' THEN 'Move ' || secret || ' to environment configuration' WHEN 'human_approval_wrapper' THEN 'Add human approval before `' || tool || '`'
    WHEN 'audit_logging_addition' THEN 'Add audit logging around `' || tool || '`' WHEN 'tool_scope_guard' THEN 'Scope `' || tool || '` permissions'
    ELSE {_case('patch_type', fv.FIX_TITLES)} END AS fix_title,
  patch_type, {lang} AS language, patch_filename, confidence, CASE WHEN confidence <> 'low' AND patch_type IN {_in(fv.LOW_EFFORT_FIXES)} THEN 'low' ELSE 'medium' END AS estimated_effort,
  {_case('patch_type', controls)} AS affected_controls, {_case('patch_type', reduction)} AS risk_reduction, {steps} AS n_steps FROM fix"""
    out["remediation_texts"] = P + f"""
SELECT {place}, title, {_case('category', fv.REMEDIATION_TEXTS, 0)} AS category_why, {_case('category', fv.REMEDIATION_TEXTS, 1)} AS category_fix,
  {_case('category', fv.REMEDIATION_TEXTS, 2)} AS example_fix, {_phrase()} AS fix_phrase, {lang} AS language FROM fnd"""
    out["remediation_checklist"] = P + F + _checklist_cte() + f" SELECT {unit}, {_list('checklist')} AS checklist FROM chk"
    rank = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END"
    out["remediation_plan"] = P + F + _checklist_cte() + f""", ph AS (
  SELECT unit, phrase, row_number() OVER (PARTITION BY unit ORDER BY seen) AS r FROM (SELECT unit, phrase, min(rn) AS seen FROM (
    SELECT unit, {_phrase()} AS phrase, row_number() OVER (PARTITION BY unit ORDER BY {rank} DESC, {_ORDER}) AS rn FROM fnd WHERE {rank} >= 2) GROUP BY 1, 2)
)
SELECT {unit}, coalesce(phrases, array_to_string(list_transform(checklist[1:5], lambda t: CASE WHEN regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END), ' | ')) AS plan
FROM chk LEFT JOIN (SELECT unit, string_agg(phrase, ' | ' ORDER BY r) AS phrases FROM ph WHERE r <= 5 GROUP BY unit) USING (unit)"""
    steps_list = ", ".join(f"CASE WHEN n_{k} > 0 THEN {_q(t)} END" for k, t in fv.NEXT_STEPS) + f", {_q(fv.NEXT_STEP_LAST)}"
    out["next_steps"] = P + F + f" SELECT {unit}, array_to_string((list_filter([{steps_list}], lambda x: x IS NOT NULL))[1:5], ' | ') AS next_steps FROM fct"
    speaks = lambda w: f"contains(lower(array_to_string(blockers, ' ')), '{w}')"
    out["first_fix"] = judged + f"""
SELECT {unit}, policy_id, decision, path, line_no, title, severity, category FROM (
  SELECT j.unit, j.policy_id, j.decision, f.path, f.line_no, f.title, f.severity, f.category, row_number() OVER (PARTITION BY j.unit, j.policy_id ORDER BY
      CASE WHEN ({speaks('secret')} AND lower(category) LIKE '%secret%') OR ({speaks('approval')} AND lower(category) LIKE '%approval%')
        OR ({speaks('tool')} AND lower(category) LIKE '%tool%') OR ({speaks('critical')} AND severity = 'Critical') THEN 0 ELSE 1 END,
      {rank} DESC, stage, path, line_no, sub_ord, title) AS r
  FROM jdg j LEFT JOIN fnd f ON f.unit = j.unit) WHERE r = 1"""
    out["linked_artifacts"] = P + _IDS + _scenario_cte(None) + _fix_cte(None) + f"""
SELECT i.{unit}, i.id, fix.patch_type, scn.kind AS simulation_type FROM idf i LEFT JOIN fix ON fix.unit = i.unit AND fix.id = i.id LEFT JOIN scn ON scn.unit = i.unit AND scn.id = i.id"""
    out["dangling_artifacts"] = P + _IDS + _fix_cte(None) + f" SELECT {unit}, id AS finding_id, patch_type FROM fix WHERE {number} % 3 = 0 AND rule = 'secret'"
    cases = ", ".join(f"({_q(a)}, {_q(s)}, {_q(c)})" for a, s, c in fv.ATTACK_CASES)
    out["case_coverage"] = P + f"""
SELECT u.{unit}, attack_type, c.severity, c.category, count(f.unit) AS findings FROM units u CROSS JOIN (VALUES {cases}) AS c(attack_type, severity, category)
LEFT JOIN fnd f ON f.unit = u.unit AND f.category = c.category GROUP BY ALL"""

    plan_sql = out["remediation_plan"]
    out["full_reports"] = one + _IDS + _scenario_cte() + _fix_cte() + plan_sql[len(P + F):].replace(
        "\nSELECT " + unit, ", pln AS (\nSELECT unit", 1) + f""")
SELECT j.{unit}, safety_score, decision, CAST(coalesce(ns, 0) AS INTEGER) AS n_scenarios, CAST(coalesce(nf, 0) AS INTEGER) AS n_fixes, first_scenario, last_fix,
  CAST(len(checklist) AS INTEGER) AS n_checklist, split_part(plan, ' | ', 1) AS first_step,
  (list_filter([{steps_list}], lambda x: x IS NOT NULL))[1] AS next_step
FROM jdg j LEFT JOIN (SELECT unit, count(*) AS ns, arg_min(scenario_title, ord) AS first_scenario FROM scn GROUP BY 1) USING (unit)
LEFT JOIN (SELECT unit, count(*) AS nf, arg_max(id, ord) AS last_fix FROM fix GROUP BY 1) USING (unit) LEFT JOIN chk USING (unit) LEFT JOIN pln USING (unit)"""

    ext = r"lower(regexp_extract(split_part(replace(name, '\', '/'), '/', -1), '^\.*[^.].*(\.[^.]*)$', 1))"
    skip = f"""CASE WHEN list_has_any(string_split(replace(name, '\\', '/'), '/'), [{", ".join(_q(d) for d in fv.BLOCKED_DIRS)}]) THEN 'blocked_dir'
  WHEN split_part(replace(name, '\\', '/'), '/', -1) IN {_in(fv.LOCK_FILES)} THEN 'lock_file' WHEN name LIKE '%/' THEN 'directory'
  WHEN ((external_attr >> 28) & 15) = 10 THEN 'symlink' WHEN file_size > 512000 THEN 'too_large' WHEN {ext} NOT IN {_in(fv.SCANNED_EXTENSIONS)} THEN 'extension' END"""
    entries = f"""WITH en AS (SELECT l_orderkey AS archive_id, l_linenumber, {entry_name_sql()} AS name, CAST(floor(l_extendedprice * 8) AS BIGINT) AS file_size,
  CAST(CASE WHEN l_partkey % 29 = 0 THEN 2716663808 ELSE 2175008768 END AS BIGINT) AS external_attr, CAST(l_orderkey % 1000 * 21000 AS BIGINT) AS archive_bytes FROM lineitem),
ej AS (SELECT *, {skip} AS skip_reason, name IN ('../up.py', 'a/../../b.py', '/etc/x.txt') AS leaves_target, CAST(len(string_split(rtrim(name, '/'), '/')) AS INTEGER) AS depth FROM en)"""
    out["entry_filter"] = entries + " SELECT archive_id, l_linenumber, skip_reason, leaves_target, depth FROM ej"
    out["archive_admission"] = entries + """
SELECT archive_id, n_entries, kept_entries, kept_bytes, CASE WHEN bytes > 20971520 THEN 'archive_too_large' WHEN n_entries > 300 THEN 'too_many_entries' WHEN deepest > 6 THEN 'too_deep'
  WHEN escapes THEN 'path_traversal' WHEN kept_bytes > 209715200 THEN 'too_many_bytes' END AS rejected
FROM (SELECT archive_id, max(archive_bytes) AS bytes, count(*) AS n_entries, max(depth) AS deepest, bool_or(leaves_target) AS escapes,
  CAST(coalesce(sum(file_size) FILTER (skip_reason IS NULL), 0) AS BIGINT) AS kept_bytes, count(*) FILTER (skip_reason IS NULL) AS kept_entries FROM ej GROUP BY archive_id)"""
    out["unpacked_archives"] = """SELECT CAST(doc_id AS VARCHAR) AS archive_id, 'src/body.txt' AS path, md5(text) AS digest FROM documents
WHERE doc_id % 13 <> 0 AND doc_id % 7 <> 0 AND strlen(text) <= 512000"""
    out["rejected_archives"] = """
WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS archive_id, doc_id, strlen(text) AS n FROM documents)
SELECT archive_id, CAST(NULL AS VARCHAR) AS name, CASE WHEN doc_id % 13 = 0 THEN 'not_a_zip' ELSE 'path_traversal' END AS reason FROM a WHERE doc_id % 13 = 0 OR doc_id % 7 = 0
UNION ALL SELECT archive_id, 'node_modules/x.js', 'blocked_dir' FROM a WHERE doc_id % 13 <> 0 AND doc_id % 7 <> 0
UNION ALL SELECT archive_id, 'src/body.txt', 'too_large' FROM a WHERE doc_id % 13 <> 0 AND doc_id % 7 <> 0 AND n > 512000"""
    out["tree_files"] = r"""
WITH t AS (SELECT source, unnest(string_split_regex(regexp_replace(text, '[\r\n]', ' ', 'g'), '[\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')) AS line FROM documents)
SELECT source, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM t GROUP BY source"""
    sev_docs = out["document_secrets"].split("SELECT source AS project_id")[0]
    points = "CASE severity WHEN 'Critical' THEN 40 WHEN 'High' THEN 25 WHEN 'Medium' THEN 15 ELSE 5 END"
    out["archive_reports"] = sev_docs + f""", per AS (
  SELECT d.doc_id, least(100, coalesce(sum({points}) FILTER (severity IS NOT NULL), 0)) AS pts, count(severity) AS n, count(*) FILTER (severity = 'Critical') AS crit
  FROM (SELECT * FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 7 <> 0 AND strlen(text) <= 512000) d
  LEFT JOIN (SELECT doc_id, severity FROM found WHERE severity IS NOT NULL) f USING (doc_id) GROUP BY 1
), sc AS (SELECT *, CAST(greatest(0, least(100, round_even(100 - pts * {fv.CATEGORY_WEIGHTS['secret_exposure']}, 0))) AS INTEGER) AS safety_score FROM per)
SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS user_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END || '/a' || (doc_id // 2) || '.zip' AS project_id,
  safety_score, CASE WHEN n > 0 OR safety_score < {fv.DEFAULT_POLICY['minimum_safety_score']} THEN 'BLOCK' ELSE 'ALLOW' END AS decision FROM sc"""
    severity, category = free_spelling_sql()
    spelled = ", ".join(f"CASE WHEN says_{k} THEN {_q(t)} END" for k, t in fv.NEXT_STEPS) + f", {_q(fv.NEXT_STEP_LAST)}"
    says = ", ".join(f"bool_or(contains(lower(c), {_q(w)})) AS says_{k}" for k, w in fv.CATEGORY_WORDS.items())
    ranks = ", ".join(f"count(*) FILTER (trim(lower(s)) = '{n}') AS gate_{n}" for n in fv.SEVERITY_RANKS)
    serious = "trim(lower(s)) IN ('critical', 'high')"
    out["free_spelling_gate"] = f"""
WITH e AS (SELECT user_id, {severity} AS s, {category} AS c FROM events), f AS (
  SELECT user_id, {ranks}, count(*) FILTER (lower(s) = 'critical') AS n_critical, {says}, count(*) FILTER (lower(c) LIKE '%secret exposure%') AS bs,
    count(*) FILTER (lower(c) LIKE '%human approval%' AND {serious}) AS ba, count(*) FILTER (lower(c) LIKE '%tool permission%' AND {serious}) AS bt FROM e GROUP BY user_id),
g AS (SELECT *, CAST((gate_critical > 0)::INT + (bs > 0)::INT + (ba > 0)::INT + (bt > 0)::INT AS INTEGER) AS n_blockers FROM f)
SELECT user_id, CASE WHEN n_blockers > 0 THEN 'BLOCK' WHEN gate_high > 0 OR gate_medium > 0 THEN 'REVIEW' ELSE 'ALLOW' END AS decision,
  gate_critical, gate_high, gate_medium, gate_low, n_critical, n_blockers, array_to_string(list_filter([{spelled}], lambda x: x IS NOT NULL), ' | ') AS next_steps FROM g"""
    out["all_scenarios"] = P + _IDS + _scenario_cte(None) + f" SELECT {unit}, CAST(ord AS INTEGER) AS ord, id AS finding_id, kind AS simulation_type, priority_score FROM scn"
    out["dangling_scenarios"] = P + _IDS + _scenario_cte(None) + f"""
SELECT {unit}, id AS finding_id, 'scenario' AS what FROM scn WHERE {number} % 3 = 0 AND rule = 'secret'
UNION ALL SELECT {unit}, CAST(NULL AS VARCHAR), 'finding' FROM idf WHERE {number} % 5 = 0 AND rule = 'secret'"""
    out["findings_by_severity"] = P + f" SELECT {place}, title, severity, row_number() OVER (PARTITION BY unit ORDER BY {rank} DESC, {_ORDER}) AS ord FROM fnd"
    out["present_findings"] = P + f" SELECT {place}, title, severity FROM fnd WHERE (length(path) + {number}) % 4 <> 0"
    out["ranked_cards"] = hist + " SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, id) AS ord FROM rep"
    out["saved_times"] = """
SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment FROM events"""
    out["all_fixes"] = P + _IDS + _fix_cte(None) + f" SELECT {unit}, CAST(ord AS INTEGER) AS ord, id AS finding_id, patch_type, confidence FROM fix"
    out["user_reports"] = hist + " SELECT user_id, id, safety_score FROM rep WHERE user_id IN ('owner3', 'owner7')"
    out["one_report"] = hist + " SELECT user_id, id, safety_score FROM rep WHERE user_id = 'owner3' AND id = 'u3-w0'"
    out["decoded_texts"] = r"SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') ELSE text END) AS digest FROM documents"
    usable = "m IN (0, 1, 2)"
    owner = "CASE m WHEN 0 THEN 'own' || page_id WHEN 1 THEN 'own' WHEN 2 THEN 'own' END"
    repo = "CASE m WHEN 0 THEN 'repo' WHEN 1 THEN 'repo' || page_id WHEN 2 THEN 'r_' || page_id END"
    err = fv.REPOSITORY_ERRORS
    out["repository_addresses"] = f"""SELECT page_id, {owner} AS owner, {repo} AS repo,
  CASE WHEN m = 1 THEN CASE WHEN page_id % 22 = 1 THEN 'release-' || page_id ELSE 'feature/x' || page_id END END AS branch,
  CASE WHEN {usable} THEN {owner} || '/' || {repo} END AS display_name,
  CASE WHEN m = 8 THEN {_q(err['missing'])} WHEN m IN (3, 9, 10) THEN {_q(err['host'])} WHEN m = 4 THEN {_q(err['parts'])} WHEN m = 5 THEN {_q(err['characters'])}
    WHEN m = 6 THEN {_q(err['path'])} WHEN m = 7 THEN {_q(err['branch'])} END AS error
FROM (SELECT *, page_id % 11 AS m, {url_sql()} AS u FROM pages)"""

    def route(whole: bool) -> str:
        has = (lambda ws: f"regexp_matches(lower(text), {_word_pattern(ws)})") if whole else (lambda ws: _any("lower(text)", ws))
        whens = " ".join(f"WHEN {has(ws)} THEN '{r}'" for r, ws in fv.QUESTION_ROUTES)
        return f"CASE WHEN NOT {has(fv.ON_TOPIC_WORDS)} AND {has(fv.OFF_TOPIC_WORDS)} THEN 'off_topic' {whens} ELSE 'fix_first' END"

    out["question_routes"] = f"SELECT conv_id, turn, {route(False)} AS route, {route(True)} AS route_whole_word FROM conversations"
    out["override_phrases"] = f"SELECT conv_id, turn, {_any('lower(t)', fv.OVERRIDE_PHRASES)} AS suspicious FROM (SELECT *, {phrase_sql()} AS t FROM conversations)"
    return out


def _word_pattern(words: list[str]) -> str:
    """Whole words where letters of any script count as part of a word (no lookaround available)."""
    return _q(r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(words) + r")(?:$|[^\p{L}\p{N}_])")
