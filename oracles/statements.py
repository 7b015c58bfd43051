"""The expected result of each query, as one DuckDB statement per key."""

from __future__ import annotations

from oracles.parts import BASE, FUNCTIONS, IMPORTS, PARTS, SUFFIX, assemble, first_of, q, redact_sql, sha, strip_sql
from sentrel.catalogue import CHECKS
from sentrel.functions import labels, text
from sentrel.operators import blueprints, rollups

FINDING = (
    "repo, id, check_id, category, agent, sub_agent, severity, confidence, file, line::int line, snippet, rule, rule_id, "
    "description, remediation"
)
DOMAIN = f"select {FINDING} from domain"
URL_FTP = "case when page_id % 10 = 0 then 'ftp' || substring(url, strpos(url, ':')) else url end"


def _blueprint(table: str) -> str:
    """The plan text, written out for the parameter cases that occur."""
    marked = (
        "replace(replace(coalesce(route, '/REPLACE_WITH_LOCAL_TEST_PATH'), ':' || parameter, 'TEST_MARKER_123'),"
        " '{' || parameter || '}', 'TEST_MARKER_123')"
    )
    return f"""
      select *, '# Non-executing proof blueprint for ' || check_id || chr(10) || '# Target: ' || file || ':' || line || chr(10)
        || '# 1. curl reproduction block (do NOT run against production):' || chr(10)
        || 'curl -i -X ' || method || ' ''http://127.0.0.1:8000' || target || '''' || chr(10) || chr(10)
        || '# 2. Raw HTTP request spec:' || chr(10) || method || ' ' || target || ' HTTP/1.1' || chr(13) || chr(10)
        || 'Host: 127.0.0.1:8000' || chr(13) || chr(10) || 'Content-Type: application/json' || chr(13) || chr(10)
        || 'Connection: close' || chr(10) || chr(10)
        || '# 3. Expected signal: the benign marker TEST_MARKER_123 should be rejected, encoded, parameterized, or denied by an authorization policy.'
        || chr(10) || '# Safety: this blueprint is never executed by the engine.' poc_payload
      from (select *, marked || case when marked = route0 then '?' || parameter || '=TEST_MARKER_123' else '' end target
            from (select *, {marked} marked, coalesce(route, '/REPLACE_WITH_LOCAL_TEST_PATH') route0 from ({table})))"""


PLANNED = f"""
  select repo, id, check_id, category, file, line, 'GET' as method, null::varchar route,
         regexp_extract(taint_path, '^source (.*?) \\d+(?: >|$)', 1) as parameter from taint
  union all
  select repo, id, check_id, category, file, line, method, route, parameter from logic"""
PARTS["plan"] = _blueprint(PLANNED)
# Every file as a patch: a header of three lines, then its lines, removed and added in turn.
PARTS["patch_lines"] = """
  select 'patch_' || doc_id || '.patch' path, line_no + 3 line_no, case when line_no % 2 = 1 then '-' else '+' end || line as line from corpus
  union all
  select 'patch_' || doc_id || '.patch', n, case n when 1 then '--- a/' || path when 2 then '+++ b/' || path else '@@ -1 +1 @@' end
  from files, range(1, 4) t(n)"""
PARTS["patches"] = "select path, sum(octet_length(encode(line)) + 1)::bigint - 1 size from patch_lines group by path"
PARTS["patch_hits"] = "select * from (" + " union all ".join(
    f"select path, {first_of('line', [(p, p) for p in r.patterns])} as rule from patch_lines" for r in CHECKS if r.patterns
) + ") where rule is not null"

MERGED = "repo, id, check_id, severity, file, line::int line, rule, behavior, behavior_rationale, verification_verdict"
EXCLUDED = "path as original, case doc_id % 5 when 0 then 'node_modules/' || path when 1 then 'lib/.git/' || path else path end path"

SQL: dict[str, str] = {
    "scan_table": """select coalesce(source, 'unknown') repo, 'documents/' || doc_id || '.txt' path, octet_length(encode(text))::bigint size,
        len(string_split(case when suffix(text, chr(10)) then left(text, length(text) - 1) else text end, chr(10)))::int n_lines from documents""",
    "scan_corpus": "select path, size, len(string_split(text, chr(10)))::int n_lines from files",
    "scan_patches": "select path, size, count(m.rule)::bigint hits from patches left join patch_hits m using (path) group by all",
    "load_rules": """select check_id, name, agent, kind, rule_id, severity, confidence, description, remediation,
        count(m.path)::bigint hits from rules left join matches m using (check_id) group by all""",
    "dependency_inventory": "select distinct repo, path from manifest_lines",
    "evidence_scan": f"""select page_id, u url, regexp_extract(u, '^[a-z]+') scheme,
        case when starts_with(u, 'ftp') then 'Unsupported URL scheme: ''ftp''' end error,
        case when not starts_with(u, 'ftp') then octet_length(encode(html)) > 4096 end truncated,
        case when not starts_with(u, 'ftp') then md5(case when octet_length(encode(html)) <= 4096 then html else left(html, fits)
          || case when octet_length(encode(left(html, fits))) < 4096 then chr(65533) else '' end end) end text_md5,
        case when not starts_with(u, 'ftp') then md5(html) end whole_md5
        from (select *, {URL_FTP} u from pages) left join (
          select page_id, max(i) fits from (
            select page_id, i, sum(octet_length(encode(c))) over (partition by page_id order by i) upto
            from (select page_id, unnest(regexp_extract_all(html, '(?s).')) c, generate_subscripts(regexp_extract_all(html, '(?s).'), 1) i from pages))
          where upto <= 4096 group by page_id) using (page_id)""",
    "explode_lines": "select repo, path, line_no, line from corpus",
    "path_features": """select repo, path, regexp_extract(path, '[^/]*$') base_name,
        regexp_extract(lower(path), '[^./][^/]*?(\\.[^./]+)$', 1) suffix, array_to_string(string_split(path, '/'), '|') segments from files""",
    "detect_language": "select repo, path, language from files",
    "filter_paths": f"select repo, path from (select repo, {EXCLUDED} from files) where path = original",
    "redact": f"select repo, path, line_no, {redact_sql('line')} snippet from corpus",
    "finding_ids": f"select path, line_no, 'LINE-' || {sha('path', 'line_no', 'line')} id from corpus",
    "project_finding": DOMAIN,
    "select_checks": f"{DOMAIN} where agent = 'secrets' and check_id in ('01', '09', '99')",
    "strip_code": r"""select repo, path, regexp_replace(regexp_replace(regexp_replace(
        case when language = 'php' then regexp_replace(c, '(?m)#.*$', ' ', 'g') else c end,
        '`(?:\\.|[^`])*`', ' ', 'g'), '''(?:\\.|[^''])*''', ' ', 'g'), '"(?:\\.|[^"])*"', ' ', 'g') code
        from (select *, regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), '(?m)//.*$', ' ', 'g') c from files)
        where language in ('javascript', 'typescript', 'php')""",
    "pattern_scan": "select repo, path, line_no, check_id, rule from matches",
    "pattern_join": "select repo, path, line_no, check_id, rule from matches",
    "pattern_scan_exclude": """select repo, path, line_no, 'X1' check_id, '(?i)password' as rule from corpus
        where regexp_matches(line, '(?i)password') and not regexp_matches(line, '(?i)changeme|admin')""",
    "filename_scan": "select repo, path, line_no::int line_no, check_id, rule from name_hits",
    "code_event_scan": "select repo, path, line_no, check_id, rule from event_hits",
    "dedupe_findings": "select repo, path, line_no, check_id, rule from line_hits",
    "audit_agent": f"{DOMAIN} where agent = 'injection'",
    "dep_unpinned": "select repo, path, line_no, line from supply_hits where rule = 'unpinned-dependency'",
    "dep_install_hook": "select repo, path, line_no, line from supply_hits where rule = 'install-script-network-execution'",
    "dep_scripts": "select repo, path, line_no::int line_no, line from supply_hits where rule = 'package-script-download-execute'",
    "dep_requested_by": "select distinct repo, 'infra,injection,secrets' requested_by from manifest_lines",
    "audit_supply_chain": f"select {FINDING} from supply",
    "functions_py": "select repo, path, qualname, kind, start_line, end_line, params, signature, calls, decorators from fn where language = 'python'",
    "functions_structural": "select repo, path, qualname, kind, start_line, end_line, params, signature, calls, decorators from fn where language <> 'python'",
    "imports": "select repo, path, line_no, text, names, false side_effect from imp",
    "call_edges": "select repo, path caller_path, caller, call_name, call_segment, callee from edges",
    "callers": "select repo, path, callee qualname, string_agg(distinct caller, '|' order by caller) callers from edges where callee is not null group by all",
    "enclosing_function": """select p.repo, p.path, p.line_no, arg_min(f.qualname, f.end_line - f.start_line) narrowest,
        arg_max(f.qualname, f.start_line) latest from points p left join fn f on f.path = p.path and p.line_no between f.start_line and f.end_line group by all""",
    "call_neighbourhood": """select repo, path, seed, qualname, min(depth)::int depth from (
        select repo, path, qualname seed, qualname, 0 depth from fn
        union all select repo, path, a, b, 1 from pairs
        union all select x.repo, x.path, x.a, y.b, 2 from pairs x join pairs y on y.path = x.path and y.a = x.b) group by all""",
    "keep_imports": """select f.repo, f.path, f.qualname slice_id, i.line_no import_line, i.text,
        list_contains(regexp_extract_all(string_agg(c.line, chr(10)), '[A-Za-z_][A-Za-z0-9_]*'), i.names) kept
        from fn f join imp i on i.path = f.path join corpus c on c.path = f.path and c.line_no between f.start_line and f.end_line
        group by f.repo, f.path, f.qualname, i.line_no, i.text, i.names""",
    "build_call_tree": """select f.repo, f.path, f.language, count(distinct n.qualname)::bigint functions,
        count(distinct i.line_no)::bigint imports, count(distinct (e.caller, e.call_name)) filter (where e.caller is not null)::bigint calls, count(distinct (e.caller, e.callee)) filter (where e.callee is not null)::bigint edges
        from files f left join fn n on n.path = f.path left join imp i on i.path = f.path left join edges e on e.path = f.path
        where f.language is not null group by all""",
    "label_sources": "select repo, path, line_no, source, matched from sources",
    "label_sinks": "select repo, path, line_no, sink, args from sinks",
    "label_sanitizers": f"select repo, path, line_no, {first_of('line', labels.SANITIZERS)} sanitizer from corpus where sanitizer is not null",
    "assignments": "select repo, path, line_no, var, rhs from assigned",
    "call_sites": """select c.repo, c.path, c.line_no, c.position::int as position, c.name, coalesce(string_agg(argument, '|' order by part) filter (where argument <> ''), '') args
        from line_calls c left join call_parts p using (path, line_no, position) group by all""",
    "taint_intra": "select source_file, source_line, source_kind, sink_file, sink_line, sink_kind, value, sanitized, sanitizer, sink_function, taint_path from flows where depth = 0",
    "taint_inter": "select source_file, source_line, source_kind, sink_file, sink_line, sink_kind, value, sanitized, sanitizer, sink_function, taint_path from flows where depth > 0",
    "taint_flows": "select source_file, source_line, source_kind, sink_file, sink_line, sink_kind, value, sanitized, sanitizer, sink_function, taint_path from flows",
    "taint_findings": f"select {FINDING}, taint_path from taint",
    "taint_counts": "select count(*)::bigint flow_count, count(*) filter (where sanitized)::bigint sanitized_flow_count from flows",
    "trace_dataflow": "select source_file, source_line, sink_file, sink_line, sink_function, taint_path from flows where source_file = 'src/flow_23.py' and sink_function in ('run_23', 'store_23', 'execute')",
    "routes": "select repo, path, line_no, method, route, array_to_string(params, '|') params, framework, text from route",
    "handler_windows": "select repo, path, line_no, framework, body_start, window_start, window_end from win",
    "auth_signals": "select repo, path, line_no, array_to_string(signals, '|') signals, len(signals) > 0 protected from auth",
    "ownership_signal": "select repo, path, line_no, ownership from auth",
    "param_queries": """select repo, path, line_no, parameter, query_line, query_text, 'source ' || line_no || '|propagate ' || query_line || '|sink ' || query_line steps from param_hits""",
    "missing_authorization": f"select {FINDING}, route, method, framework, parameter, query_line, auth_signals from logic where rule = 'missing-authorization'",
    "idor": f"select {FINDING}, route, method, framework, parameter, query_line, auth_signals from logic where rule = 'idor-bola'",
    "checked_routes": "select count(*)::bigint checked_routes from route",
    "sensitive_route": f"select {FINDING} from biz where rule = 'sensitive-route-without-authorization-signal'",
    "client_value": f"select {FINDING} from biz where rule = 'client-controlled-business-value'",
    "business_logic_report": "select rule, count(*)::bigint finding_count from biz group by rule",
    "blueprint_text": "select repo, id, file, line::int line, poc_payload from plan",
    "blueprints": f"""select repo, 'RESEARCH-POC-' || {sha("'POC'", 'file', 'line', 'id')} id, id source_finding_id, check_id,
        'Local verification plan for ' || category title, file, line::int line, md5(poc_payload) poc_md5,
        case when route is null then 'REPLACE_WITH_METHOD' else method end template_method, coalesce(route, 'REPLACE_WITH_LOCAL_TEST_PATH') template_path from plan""",
    "attach_blueprints": """select f.repo, f.id, f.rule, f.file, f.line::int line, p.poc_payload from found f
        left join (select repo, id, max(poc_payload) poc_payload from plan group by all) p using (repo, id)""",
    "expected_usage": "select repo, id, behavior, file, line::int line, rationale from usage",
    "behaviour_counts": """select count(*)::bigint assessed_findings, count(*) filter (where behavior = 'expected')::bigint expected_count,
        count(*) filter (where behavior = 'unexpected')::bigint unexpected_count from usage""",
    "static_verdicts": "select repo, id, check_id, file, line::int line, verdict from verdict",
    "verify_candidates": "select repo, id, check_id, severity, file, line::int line from ordered where position <= 100",
    "verdict_counts": """select count(*)::bigint assessed_findings, 0::bigint verified_count,
        count(*) filter (where verdict = 'static-confirmed')::bigint static_confirmed_count, 0::bigint not_reproduced_count,
        count(*) filter (where verdict = 'static-only')::bigint static_only_count, count(*) filter (where verdict = 'unsupported')::bigint unsupported_count,
        count(*) filter (where verdict = 'not-assessed')::bigint not_assessed_count from verdict""",
    "merge_verification": f"select {MERGED} from merged",
    "valued_findings": f"select {MERGED}, p as policy from merged, (values ('strict'), ('lenient')) v(p) where behavior <> 'expected' and (verification_verdict = 'static-confirmed' or p = 'lenient' and verification_verdict = 'static-only')",
    "all_findings": f"select {FINDING} from found",
    "severity_counts": "select severity, count(*)::bigint findings from found group by severity",
    "check_counts": """select r.check_id, r.name, r.agent, r.agent || '.' || r.check_id sub_agent, count(d.id)::bigint finding_count, 'completed' status
        from rules r left join domain d using (check_id) group by all""",
    "agent_rollup": """select a.agent, display_name, count(d.id)::bigint finding_count, (select count(distinct path) from manifest_lines)::bigint dependency_files,
        (select string_agg(r.agent || '.' || r.check_id, '|' order by r.check_id) from rules r where r.agent = a.agent) sub_agents,
        case when a.agent = 'injection' and broken > 0 then 'injection.16|injection.17' else '' end failed_sub_agents,
        case when a.agent = 'injection' and broken > 0 then 'completed_with_errors' else 'completed' end status
        from (select *, (select count(*) from files where starts_with(path, 'src/broken_')) broken from agents) a left join domain d on d.agent = a.agent group by all""",
    "verification_summary": """select 'completed' behavior_status, 'completed' verification_status, 0::bigint verified_count, 0::bigint not_reproduced_count,
        count(distinct (repo, id)) filter (where verification_verdict = 'unsupported')::bigint unsupported_count,
        count(distinct (repo, id)) filter (where behavior = 'expected')::bigint expected_count,
        count(distinct (repo, id)) filter (where behavior = 'unexpected')::bigint unexpected_count, count(distinct (repo, id))::bigint assessed_findings,
        count(distinct (repo, id)) filter (where verification_verdict = 'static-confirmed')::bigint static_confirmed_count,
        count(distinct (repo, id)) filter (where verification_verdict = 'static-only')::bigint static_only_count,
        count(distinct (repo, id)) filter (where verification_verdict = 'not-assessed')::bigint not_assessed_count,
        count(*) filter (where behavior = 'expected')::bigint noise_filtered_count,
        count(*) filter (where behavior <> 'expected' and verification_verdict = 'static-confirmed')::bigint valued_findings_count,
        'strict' verification_policy, false truncated from merged""",
    "findings_digest": """select position::int position, '- [' || severity || '] check ' || check_id || ' ' || file || ':' || line || ' ' || rule || ' :: ' || substring(snippet, 1, 100) as text
        from ordered where position <= 40
        union all select 41, '- ... and ' || (count(*) - 40) || ' more findings' from found having count(*) > 40""",
    "rule_lookup": f"""select c.check_id, coalesce(asked, r.agent, {q(rollups.FALLBACK_AGENT)}) agent,
          case when ok then r.name end as name, case when ok then r.severity end severity, case when ok then r.confidence end confidence,
          case when ok then r.remediation end remediation,
          case when ok then coalesce((select string_agg(pattern, chr(10) order by position) from patterns p where p.check_id = c.check_id), '') end patterns,
          case when not ok then {q(rollups.NOT_ROUTED)} end note,
          case when not ok then (select string_agg(x.check_id, '|' order by x.check_id) from rules x where x.agent = asked) end available
        from (select q.*, coalesce(r.agent = coalesce(asked, r.agent), false) ok from (
                select distinct check_id, unnest([null, 'infra']) asked from domain
                union all select distinct 'unknown-' || sid, null from docs) q left join rules r using (check_id)) c left join rules r using (check_id)""",
    "evidence_digest": """select 'web methodology' topic, string_agg('URL: ' || url || chr(10) || substring(html, 1, 2000), chr(10) || chr(10) order by page_id) digest
        from (select * from pages order by page_id limit 5)""",
    # The word boundary spelled out over Unicode letters; RE2's own is ASCII only.
    "custom_rules": "select 'conversations' repo, 'conversation/' || conv_id || '/' || turn || '.txt' path, line_no::int line_no, 'C1' check_id from ("
    "select *, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from conversations) where regexp_matches(line, '(?i)(^|[^\\p{L}\\p{N}_])(tion|the|de)($|[^\\p{L}\\p{N}_])')",
    "custom_labels": """select c.path, c.line_no, regexp_extract(line, '(?i)jwt\\.encode') as matched from corpus c where regexp_matches(line, '(?i)jwt\\.encode')""",
    "audit_report": """select 'severity ' || severity item, count(*)::bigint n from found group by all
        union all select 'check ' || check_id, count(d.id) from rules left join domain d using (check_id) group by all
        union all select 'verdict ' || verdict, count(*) from verdict group by all
        union all select 'behavior ' || behavior, count(*) from usage group by all
        union all select 'valued', count(*) from merged where behavior <> 'expected' and verification_verdict = 'static-confirmed'
        union all select 'blueprints', count(*) from plan union all select 'flows', count(*) from flows union all select 'routes', count(*) from route
        union all select 'total', count(*) from found""",
    "write_report": """select *, '{"agent":"' || agent || '","files":' || files || ',"findings":' || findings || '}' "document"
        from (select agent, count(*)::bigint findings, count(distinct file)::bigint files from domain group by agent)""",
    "stream_scan": """select d.repo, d.id, d.check_id, d.severity, d.file, d.line::int line, d.snippet, d.rule from domain d""",
    "stream_dedupe": """select d.repo, d.id, d.check_id, d.file, d.line::int line from domain d""",
    "stream_changes": """select d.repo, d.file, 'appeared' as change, d.id, d.check_id, d.severity, d.line::int line from domain d
        union all select d.repo, d.file, 'vanished', d.id, d.check_id, d.severity, d.line::int
        from domain d join line_hits h on h.path = d.file and h.line_no = d.line and h.check_id = d.check_id where contains(h.line, 'password')""",
    "stream_severity": """select w::timestamp window_start, (w + interval 1 hour)::timestamp window_end, severity, count(*)::bigint findings from (
          select date_trunc('hour', a.arrived) w, severity from domain d join arrivals a on a.path = d.file)
        where w + interval 1 hour <= (select max(arrived) - interval 1 hour from arrivals a join domain d on d.file = a.path) group by all""",
}

PARTS["pairs"] = """
  select distinct repo, path, caller a, callee b from edges where callee is not null
  union select distinct repo, path, callee, caller from edges where callee is not null"""


def _code_slice() -> str:
    return f"""
      select p.repo, p.path, p.line_no, language, qualname target_function, signature target_signature,
        coalesce((select string_agg(distinct caller, '|' order by caller) from edges e where e.path = p.path and e.callee = p.qualname), '') callers,
        coalesce(calls, '') callees, coalesce(included, '') functions_included, coalesce(depths, '') functions_depth,
        case when language is null then '' when qualname is null then ''
             else coalesce((select string_agg(i.text, '|' order by i.line_no) from imp i where i.path = p.path and list_contains(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*'), i.names)), '') end imports_kept,
        case when language is null then '' when qualname is not null then
             coalesce((select string_agg(i.text || chr(10), '' order by i.line_no) from imp i where i.path = p.path and i.line_no <= p.start_line
                        and list_contains(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*'), i.names)), '') || body
             else (select string_agg(c.line, chr(10) order by c.line_no) from corpus c where c.path = p.path and abs(c.line_no - p.line_no) <= 15) end slice,
        case when language is not null then greatest(1, p.line_no - case when qualname is null then 15 else 7 end)::int end focus_start,
        case when language is not null then least(n, p.line_no + case when qualname is null then 15 else 7 end)::int end focus_end
      from (
        select x.*, f.signature, f.calls, f.start_line,
          (select string_agg(m.qualname, '|' order by m.start_line) from nbh b join fn m on m.path = b.path and m.qualname = b.qualname where b.path = x.path and b.seed = x.qualname) included,
          (select string_agg(b.depth::varchar, '|' order by m.start_line) from nbh b join fn m on m.path = b.path and m.qualname = b.qualname where b.path = x.path and b.seed = x.qualname) depths,
          (select string_agg(c.line, chr(10) order by m.start_line, c.line_no) from nbh b join fn m on m.path = b.path and m.qualname = b.qualname
             join corpus c on c.path = m.path and c.line_no between m.start_line and m.end_line where b.path = x.path and b.seed = x.qualname) body
        from enc x left join fn f on f.path = x.path and f.qualname = x.qualname) p
      join files g on g.path = p.path join nlines k on k.path = p.path"""


PARTS["nbh"] = SQL["call_neighbourhood"]
PARTS["enc"] = """select p.repo, p.path, p.line_no, arg_min(f.qualname, f.end_line - f.start_line) qualname
  from points p left join fn f on f.path = p.path and p.line_no between f.start_line and f.end_line group by all"""
SQL["code_slice"] = _code_slice()


def oracle_sql() -> dict[str, str]:
    return {key: assemble(sql) for key, sql in SQL.items()}


__all__ = ["BASE", "FUNCTIONS", "IMPORTS", "SUFFIX", "SQL", "oracle_sql", "strip_sql", "text", "blueprints"]
