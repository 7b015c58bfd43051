"""Named SQL parts; ``assemble`` puts the ones a statement uses in front of it."""

from __future__ import annotations

import re

from sentrel.catalogue import AGENTS, CHECKS
from sentrel.fixtures import JSON_ESCAPES, PAIRED, SKELETONS
from sentrel.functions import calls, labels, text
from sentrel.operators import routes, supply, verdicts


def q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(v):
        return str(v) if isinstance(v, int) else q(v)

    return "(values " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


def first_of(column: str, table) -> str:
    """CASE over (pattern, value) pairs."""
    whens = " ".join(f"when regexp_matches({column}, {q(p)}) then {q(v)}" for p, v in table)
    return f"case {whens} end"


def in_list(items) -> str:
    return "(" + ", ".join(str(i) if isinstance(i, int) else q(i) for i in items) + ")"


def json_escaped(column: str) -> str:
    for mark, escape in JSON_ESCAPES:
        chars = {"\n": "chr(10)", "\r": "chr(13)", "\t": "chr(9)"}
        column = f"replace({column}, {chars.get(mark) or q(mark)}, {q(escape)})"
    return column


def filled(column: str) -> str:
    """A skeleton's text with the ids of the document and of the next one."""
    return f"replace(replace({column}, '{{n}}', doc_id::varchar), '{{m}}', (doc_id + 1)::varchar)"


SKELETON_ROWS = [
    (sid, path, number, line)
    for sid, (path, _, lines) in enumerate(SKELETONS)
    for number, line in enumerate(lines, start=1)
]
PREFIXES = [(sid, path, len(lines), prefix) for sid, (path, prefix, lines) in enumerate(SKELETONS)]

LANGUAGE = "case " + " ".join(
    f"when regexp_extract(lower(path), '[^./][^/]*?(\\.[^./]+)$', 1) in {in_list(suffixes)} then {q(name)}"
    for name, suffixes in text.LANGUAGE_SUFFIXES.items()
) + " end"

# Hand-derived: (skeleton, qualname, kind, start, end, params, calls, decorators).
FUNCTIONS = [
    (1, "callback_2", "function", 2, 5, '"/admin/reports"|(req|res', "get|query|send", ""),
    (1, "callback_6", "function", 6, 10, '"/orders/:oid"|(req|res', "json|post|query", ""),
    (1, "callback_11", "function", 11, 14, '"/invoices/:iid"|requireAuth|(req|res', "findById|get|json", ""),
    (2, "read_item", "function", 4, 6, "item_id", "app.get|cursor.execute", '@app.get("/items/{item_id}")'),
    (2, "read_user", "function", 8, 10, "uid|user", "Depends|app.get|db.query", '@app.get("/users/{uid}")'),
    (2, "calc", "function", 11, 14, "request", "eval|pickle.loads", ""),
    (3, "entry_{n}", "function", 1, 5, "request", "cursor.execute|int|run_{n}", ""),
    (3, "run_{n}", "function", 7, 9, "value", "store_{n}", ""),
    (3, "store_{n}", "function", 11, 12, "stmt", "cursor.execute", ""),
    (5, "show", "function", 3, 5, "$fid", "find", ""),
    (5, "drop", "function", 7, 9, "$tid", "where", ""),
    (10, "test_{n}", "function", 3, 4, "", "", ""),
    (12, "callback_1", "function", 1, 3, '"/billing/:bid"|(req|res', "delete|send", ""),
    (13, "add_{n}", "function", 1, 3, "a|b", "", ""),
    (14, "enter_{n}", "function", 2, 5, "request", "keep|put_row", ""),
    (15, "save_item", "function", 1, 2, "stmt", "cursor.execute", ""),
    (15, "put_row", "function", 4, 5, "row", "db.query", ""),
    (16, "save_item", "function", 1, 2, "stmt", "eval", ""),
    (16, "put_row", "function", 4, 5, "row", "eval", ""),
    (18, "send_{n}", "function", 2, 5, "req", "keepRow", ""),
    (19, "save", "function", 1, 3, "v", "query", ""),
]
# (skeleton, line, names, side effect)
IMPORTS = [(0, 1, "os"), (1, 1, "db"), (2, 1, "Depends"), (2, 2, "pickle"), (14, 1, "keep")]

PATTERN_ROWS = " union all ".join(
    f"select repo, doc_id, sid, path, line_no, line, {q(r.check_id)} check_id, "
    f"{first_of('line', [(p, p) for p in r.patterns])} as rule from corpus"
    for r in CHECKS
    if r.patterns
)
FILENAME_ROWS = " union all ".join(
    f"select repo, doc_id, sid, path, 1 line_no, path line, {q(r.check_id)} check_id, {q(r.rule_id)} as rule from files where "
    + " or ".join(
        f"regexp_extract(lower(path), '[^/]*$') = {q(f.lower())} or suffix(lower(path), {q(f.lower())})" for f in r.filenames
    )
    for r in CHECKS
    if r.filenames
)


def strip_sql(column: str) -> str:
    chars = "".join(c for c in text.WHITESPACE if ord(c) < 128)
    return f"trim({column}, " + "||".join(f"chr({ord(c)})" for c in chars) + ")"


def redact_sql(column: str) -> str:
    inner = f"regexp_replace({column}, {q(text.SECRET_VALUE)}, '\\1\\2\\3[REDACTED]', 'g')"
    return f"substring({strip_sql(f'''regexp_replace({inner}, {q(text.VENDOR_TOKEN)}, '[REDACTED]', 'g')''')}, 1, 500)"


def sha(*columns: str) -> str:
    joined = " || ':' || ".join(f"cast({c} as varchar)" for c in columns)
    return f"substring(sha256({joined}), 1, 16)"


SUFFIX = "regexp_extract(lower(file), '[^./][^/]*?(\\.[^./]+)$', 1)"
BASE = "regexp_extract(lower(file), '[^/]*$')"

ROUTE_BRANCHES = [
    f"when regexp_matches(line, {q(p)}) then {{'fw': {q(name)}, 'method': upper(regexp_extract(line, {q(p)}, 1)), "
    f"'route': regexp_extract(line, {q(p)}, 2)}}"
    for name, p in routes.ROUTES.items()
]

PARTS: dict[str, str] = {
    "sk": f"select * from {values(SKELETON_ROWS)} t(sid, p, ln, t)",
    "skn": f"select * from {values(PREFIXES)} t(sid, p, nl, pre)",
    "docs": f"""
      select doc_id, case when sid in {in_list(PAIRED)} then 'pair_' || (doc_id // {len(SKELETONS)}) else coalesce(source, 'unknown') end repo, text, sid
      from (select *, doc_id % {len(SKELETONS)} sid from documents)""",
    "corpus": f"""
      select repo, doc_id, docs.sid, {filled('p')} path, ln::int line_no,
             replace({filled('t')}, '{{text}}', {json_escaped("coalesce(text, '')")}) line
      from docs join sk on sk.sid = docs.sid
      union all
      select repo, doc_id, sid, {filled('p')}, (nl + pos)::int, pre || l
      from (select repo, doc_id, docs.sid, p, nl, pre,
                   unnest(string_split(rtrim(text, chr(10)), chr(10))) l,
                   generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) pos
            from docs join skn on skn.sid = docs.sid)
      where pre is not null""",
    "files": f"""
      select repo, doc_id, sid, path, text, octet_length(encode(text))::bigint size, {LANGUAGE} as language
      from (select repo, doc_id, sid, path, string_agg(line, chr(10) order by line_no) as text
            from corpus group by all)""",
    "rules": "select * from "
    + values([(r.check_id, r.name, r.agent, r.kind, r.rule_id, r.severity, r.confidence, r.description, r.remediation) for r in CHECKS])
    + " t(check_id, name, agent, kind, rule_id, severity, confidence, description, remediation)",
    "patterns": "select * from "
    + values([(r.check_id, n, p) for r in CHECKS for n, p in enumerate(r.patterns, start=1)])
    + " t(check_id, position, pattern)",
    "agents": f"select * from {values(AGENTS.items())} t(agent, display_name)",
    "matches": f"select * from ({PATTERN_ROWS}) where rule is not null",
    "name_hits": FILENAME_ROWS,
    # Dangerous calls on code lines of Python files, by event text.
    "events": """
      select repo, doc_id, sid, path, line_no, line, message from (
        select *, case when regexp_matches(line, '\\b(eval|exec|compile)\\(')
                         then 'dynamic execution via ' || regexp_extract(line, '\\b(eval|exec|compile)\\(', 1)
                       when regexp_matches(line, '\\b(system|popen)\\(')
                         then 'shell execution via ' || regexp_extract(line, '\\b(system|popen)\\(', 1)
                       when regexp_matches(line, '\\bpickle\\.loads\\(') then 'unsafe pickle deserialization' end message
        from corpus where suffix(path, '.py') and not starts_with(line, '#') and not starts_with(path, 'src/broken_'))
      where message is not null""",
    "event_hits": """
      select repo, doc_id, sid, path, line_no, line, check_id, message as rule
      from events, (values ('16'), ('17')) c(check_id)
      where check_id = '17' or message in ('dynamic execution via eval', 'dynamic execution via exec')""",
    "line_hits": """
      select m.* from matches m anti join event_hits using (path, line_no, check_id)
      union all select * from event_hits""",
    "domain": f"""
      select repo, 'SAST-' || check_id || '-' || {sha('check_id', 'path', 'line_no', 'line')} as id, check_id, name category,
             agent, agent || '.' || check_id sub_agent, severity, confidence, path file, line_no::int line,
             {redact_sql('line')} snippet, rule, rule_id, description, remediation
      from (select * from line_hits union all select * from name_hits) join rules using (check_id)""",
    "manifest_lines": f"select * from corpus where regexp_extract(path, '[^/]*$') in {in_list(('package.json', 'composer.json', 'requirements.txt'))}",
    "supply_hits": f"""
      select repo, path, line_no, line, 'unpinned-dependency' as rule from manifest_lines
      where {' or '.join(f'regexp_matches(line, {q(p)})' for p in supply.UNPINNED)}
      union all
      select repo, path, line_no, line, 'install-script-network-execution' from manifest_lines
      where regexp_matches(line, {q(supply.INSTALL_HOOK)})
      union all
      select repo, path, 1, name || ': ' || script, 'package-script-download-execute' from (
        select repo, path, unnest(json_keys(s)) name, json_extract_string(s, '$.' || unnest(json_keys(s))) script
        from (select repo, path, json_extract(text, '$.scripts') s from files where suffix(path, 'package.json') and json_valid(text)))
      where regexp_matches(script, {q(supply.DOWNLOAD_TO_SHELL)})""",
    "supply_rules": "select * from "
    + values([(rule, *v) for rule, v in supply.SUPPLY_RULES.items()])
    + " t(rule, severity, description, remediation)",
    "supply": f"""
      select repo, 'SAST-SC-' || {sha('path', 'line_no', 'line', 'rule')} as id, 'supply-chain' check_id,
             'Supply Chain' category, 'supply_chain' agent, 'supply_chain.dependency-audit' sub_agent, severity,
             'medium' confidence, path file, line_no::int line, {redact_sql('line')} snippet, rule, rule rule_id,
             description, remediation
      from supply_hits join supply_rules using (rule)""",
    "fn": f"""
      select repo, doc_id, f.sid, path, language, replace(qn, '{{n}}', doc_id::varchar) qualname, kind, s::int start_line,
             e::int end_line, params, replace(calls, '{{n}}', doc_id::varchar) calls, decorators,
             (select {strip_sql('line')} from corpus c where c.path = files.path and c.line_no = f.s) signature
      from files join {values(FUNCTIONS)} f(sid, qn, kind, s, e, params, calls, decorators) using (sid)""",
    "imp": f"""
      select c.repo, c.path, c.line_no, c.line as text, names
      from corpus c join {values(IMPORTS)} i(sid, ln, names) on i.sid = c.sid and i.ln = c.line_no""",
    "fn_calls": """
      select repo, path, qualname caller, call_name, regexp_extract(call_name, '[^.]*$') call_segment
      from (select *, unnest(string_split(calls, '|')) call_name from fn) where call_name <> ''""",
    "edges": """
      select c.*, f.qualname callee from fn_calls c left join fn f
      on f.path = c.path and regexp_extract(f.qualname, '[^.]*$') = c.call_segment""",
    "points": "select distinct repo, path, line_no from matches",
    "sources": f"""
      select repo, path, line_no, line, {first_of('line', labels.SOURCES)} as source,
             case {' '.join(f'when regexp_matches(line, {q(p)}) then regexp_extract(line, {q(p)})' for p, _ in labels.SOURCES)} end matched
      from corpus where source is not null""",
    "sinks": f"""
      select repo, doc_id, path, line_no, sink, case when contains(rest, '(') then
               case when regexp_matches(rest, '^[^(]*\\([^()]*\\)') then regexp_extract(rest, '^[^(]*\\(([^()]*)\\)', 1)
                    else substring(rest, strpos(rest, '(') + 1) end else rest end args
      from (select *, substring(line, strpos(line, hit)) rest from (
        select *, {first_of('line', labels.SINKS)} as sink,
          case {' '.join(f'when regexp_matches(line, {q(p)}) then regexp_extract(line, {q(p)})' for p, _ in labels.SINKS)} end hit
        from corpus) where sink is not null)""",
    "assigned": f"""
      select repo, doc_id, path, line_no, regexp_extract(line, {q(labels.ASSIGNMENT)}, 1) var,
             trim(rtrim(regexp_extract(line, {q(labels.ASSIGNMENT)}, 2), ';')) rhs
      from corpus where regexp_matches(line, {q(labels.ASSIGNMENT)}) and not regexp_matches(rhs, '^[=><!]')""",
    # --- calls: tokens of the line, then of each argument text, with positions and depths as running sums ---
    "line_tokens": f"""
      select *, sum(length(token)) over (partition by path, line_no order by k) upto from (
        select *, unnest(tokens) token, generate_subscripts(tokens, 1) k from (
          select c.repo, c.path, line_no, line, case when language = 'php' then regexp_extract_all(line, {q(calls.CALLS['php'] + '|' + calls.BETWEEN)})
              when language in ('javascript', 'typescript') then regexp_extract_all(line, {q(calls.CALLS['javascript'] + '|' + calls.BETWEEN)})
              else regexp_extract_all(line, {q(calls.CALLS['python'] + '|' + calls.BETWEEN)}) end tokens
          from corpus c join files on files.path = c.path where language is not null and contains(line, '(')))""",
    "line_calls": f"""
      select repo, path, line_no, row_number() over (partition by path, line_no order by k) as position, substring(line, upto::int + 1) rest,
             regexp_replace({strip_sql('left(token, length(token) - 1)')}, {q(calls.NAME_JOINT)}, '.', 'g') as name
      from line_tokens where suffix(token, '(') and regexp_matches(token, '^[A-Za-z_$]')""",
    "call_ends": """
      select path, line_no, position, min(upto)::int stop from (
        select *, 1 + sum(case when suffix(p, '(') then 1 else -1 end) over w depth, sum(length(p)) over w upto from (
          select path, line_no, position, unnest(pieces) p, generate_subscripts(pieces, 1) j
          from (select *, regexp_extract_all(rest, '[^()]*[()]') pieces from line_calls))
        window w as (partition by path, line_no, position order by j))
      where depth = 0 group by all""",
    "call_parts": f"""
      select path, line_no, position, part, {strip_sql("string_agg(case when cut then '' else token end, '' order by i)")} as argument from (
        select *, sum(cut::int) over (partition by path, line_no, position order by i) part from (
          select *, token = ',' and sum(case when token in ('(', '[', '{{') then 1 when token in (')', ']', '}}') then -1 else 0 end)
                    over (partition by path, line_no, position order by i) = 0 cut from (
            select path, line_no, position, unnest(tokens) token, generate_subscripts(tokens, 1) i from (
              select c.*, regexp_extract_all(case when stop is null then rest else left(rest, stop - 1) end, {q(calls.ARGUMENT_TOKEN)}) tokens
              from line_calls c left join call_ends e using (path, line_no, position)))))
      group by all""",
    # --- taint: nodes are definitions (variable, line), propagated edge by edge ---
    "unit": """
      select repo, doc_id, path, qualname, start_line, end_line, params from fn
      union all
      select repo, doc_id, path, '<module>', 1, greatest(1, coalesce((select min(start_line) from fn where fn.path = files.path) - 1,
             len(string_split(text, chr(10))))), '' from files where language is not null""",
    "unit_assign": """
      select u.qualname unit, a.* from assigned a join unit u on u.path = a.path and a.line_no between u.start_line and u.end_line""",
    "src_assign": f"""
      select *, {first_of('rhs', labels.SOURCES)} as kind,
        case {' '.join(f'when regexp_matches(rhs, {q(p)}) then regexp_extract(rhs, {q(p)})' for p, _ in labels.SOURCES)} end matched,
        {first_of('rhs', labels.SANITIZERS)} as sanitizer
      from unit_assign""",
    "calls_in": """
      select c.path, u.qualname unit, c.line_no, f.path callee_path, f.qualname callee, string_split(f.params, '|') params, f.start_line,
             string_split(regexp_extract(c.line, f.qualname || '\\(([^()]*)\\)', 1), ',') args
      from corpus c join unit u on u.path = c.path and c.line_no between u.start_line and u.end_line
      join fn f on f.path = c.path and f.language = 'python' and regexp_matches(c.line, '\\b' || f.qualname || '\\(')
        and c.line_no <> f.start_line
      union all
      select c.path, u.qualname, c.line_no, f.path, f.qualname, string_split(f.params, '|'), f.start_line,
             string_split(regexp_extract(c.line, '\\b' || x.local || '\\(([^()]*)\\)', 1), ',')
      from corpus c join unit u on u.path = c.path and c.line_no between u.start_line and u.end_line
      join across x on x.path = c.path and regexp_matches(c.line, '^\\s+' || x.local || '\\(')
      join fn f on f.repo = x.repo and f.path = x.callee_path and f.qualname = x.callee""",
    # Names that a file imports, read from its import lines; then the callees of calls that leave the file: those of the module
    # if it defines the name, else all functions of that name in the tree.
    "imported": """
      select repo, path, regexp_extract(line, ' as (\\w+)$', 1) as local, regexp_extract(line, ' import (\\w+)', 1) original,
             replace(regexp_extract(line, '^from ([\\w.]+)', 1), '.', '/') || '.py' module_path
      from corpus where regexp_matches(line, '^from [\\w.]+ import \\w+ as \\w+$')
      union all
      select repo, path, regexp_extract(line, ': (\\w+) }', 1), regexp_extract(line, '{ (\\w+):', 1),
             'web/' || regexp_extract(line, '"\\./(\\w+)"', 1) || '.js'
      from corpus where regexp_matches(line, '^const { \\w+: \\w+ } = require')""",
    "across": """
      select e.repo, e.path, e.call_segment as local, f.path callee_path, f.qualname callee, true bound
      from edges e join imported i on i.path = e.path and i.local = e.call_segment
      join fn f on f.repo = e.repo and f.path = i.module_path and f.qualname = i.original where e.callee is null
      union all
      select distinct e.repo, e.path, e.call_segment, f.path, f.qualname, false
      from edges e join fn f on f.repo = e.repo and f.path <> e.path and regexp_extract(f.qualname, '[^.]*$') = e.call_segment
      where e.callee is null and not contains(e.call_name, '.')
        and not exists (select 1 from imported i join fn g on g.path = i.module_path and g.qualname = i.original where i.path = e.path and i.local = e.call_segment)""",
    "reach": """
      select path, unit, line_no, 1 ord, var, path src_path, line_no src_line, kind, false sanitized, null::varchar sanitizer, 0 depth,
             ['source ' || matched || ' ' || line_no, 'propagate ' || var || ' ' || line_no] steps
      from src_assign where kind is not null
      union all
      select * from (
        select r.path, r.unit, a.line_no, 1, a.var, r.src_path, r.src_line, r.kind, r.sanitized or a.sanitizer is not null,
               coalesce(r.sanitizer, a.sanitizer), r.depth,
               r.steps || [case when a.sanitizer is null then 'propagate ' else 'sanitize ' end || r.var || ' ' || a.line_no,
                           'propagate ' || a.var || ' ' || a.line_no]
        from reach r join src_assign a on a.path = r.path and a.unit = r.unit and a.line_no > r.line_no and a.kind is null
          and list_contains(regexp_extract_all(a.rhs, '\\w+'), r.var)
        where not exists (select 1 from unit_assign k where k.path = r.path and k.unit = r.unit and k.var = r.var
                            and k.line_no > r.line_no and k.line_no < a.line_no)
        union all
        select c.callee_path, c.callee, c.start_line - 1, 1, c.params[i], r.src_path, r.src_line, r.kind, r.sanitized, r.sanitizer, r.depth + 1,
               r.steps || ['propagate ' || c.params[i] || ' ' || c.line_no]
        from reach r join calls_in c on c.path = r.path and c.unit = r.unit and c.line_no >= r.line_no, range(1, 5) g(i)
        where r.depth < 2 and i <= len(c.params) and list_contains(regexp_extract_all(c.args[i], '\\w+'), r.var)
          and not exists (select 1 from unit_assign k where k.path = r.path and k.unit = r.unit and k.var = r.var
                            and k.line_no > r.line_no and k.line_no <= c.line_no))""",
    "flow_rows": f"""
      select r.path, r.unit, s.line_no, s.sink, r.var "value", r.src_path, r.src_line, r.kind,
             r.sanitized or {first_of('s.args', labels.SANITIZERS)} is not null sanitized,
             coalesce(r.sanitizer, {first_of('s.args', labels.SANITIZERS)}) sanitizer, r.depth, r.steps
      from reach r join sinks s on s.path = r.path and s.line_no > r.line_no
        and list_contains(regexp_extract_all(s.args, '\\w+'), r.var)
        join unit u on u.path = r.path and u.qualname = r.unit and s.line_no between u.start_line and u.end_line
      where not exists (select 1 from unit_assign k where k.path = r.path and k.unit = r.unit and k.var = r.var
                          and k.line_no > r.line_no and k.line_no < s.line_no)
      union all
      select s.path, u.qualname, s.line_no, s.sink,
             case {' '.join(f'when regexp_matches(s.args, {q(p)}) then regexp_extract(s.args, {q(p)})' for p, _ in labels.SOURCES)} end matched,
             s.path, s.line_no, {first_of('s.args', labels.SOURCES)} as kind, {first_of('s.args', labels.SANITIZERS)} is not null,
             {first_of('s.args', labels.SANITIZERS)}, 0, ['source ' || matched || ' ' || s.line_no]
      from sinks s join unit u on u.path = s.path and s.line_no between u.start_line and u.end_line
      where {first_of('s.args', labels.SOURCES)} is not null""",
    "flows": """
      select repo, f.src_path source_file, f.src_line::int source_line, f.kind source_kind, f.path sink_file, f.line_no::int sink_line,
             f.sink sink_kind, f.value, f.sanitized, arg_min(f.unit, (len(f.steps), array_to_string(f.steps, '>'), f.unit)) sink_function,
             min(f.sanitizer) sanitizer, min(f.depth)::int depth,
             arg_min(array_to_string(f.steps || ['sink ' || f.unit || ' ' || f.line_no], ' > '),
                     (len(f.steps), array_to_string(f.steps, '>'), f.unit)) taint_path
      from flow_rows f join files on files.path = f.path and files.language is not null group by all""",
    "taint": f"""
      select repo, 'RESEARCH-TAINT-' || {sha("'TAINT'", 'sink_file', 'sink_line', 'found')} as id, 'research-taint' check_id,
             'Semantic Taint Flow' category, 'research_taint' agent, 'research_taint.source-to-sink-flow' sub_agent, 'high' severity,
             'high' confidence, sink_file file, sink_line line, substring(found, 1, 500) snippet, 'source-to-sink-flow' as rule,
             'source-to-sink-flow' rule_id, 'Untrusted data from ' || source_kind || ' reaches a ' || sink_kind
               || ' sink without a recognized sanitizer.' description,
             'Validate and constrain the value at the trust boundary, then use a context-safe API at the sink.' remediation, taint_path
      from (select f.*, {strip_sql('c.line')} found from flows f join corpus c on c.path = f.sink_file and c.line_no = f.sink_line)
      where not sanitized
      qualify row_number() over (partition by repo, id order by len(string_split(taint_path, ' > ')), taint_path) = 1""",
    # --- routes ---
    "route": f"""
      select repo, doc_id, path, line_no, r.method, r.route,
             list_transform(regexp_extract_all(r.route, {q(routes.ROUTE_PARAMETER)}), lambda p: regexp_replace(p, '[:{{}}]', '', 'g')) params,
             r.fw framework, {strip_sql('line')} as text
      from (select *, case {' '.join(ROUTE_BRANCHES)} end r from corpus) where r is not null""",
    "nlines": "select path, max(line_no) n from corpus group by path",
    "fast_def": f"""
      select r.path, r.line_no, min(c.line_no) def from route r join corpus c on c.path = r.path
      and c.line_no between r.line_no + 1 and r.line_no + 39 and regexp_matches(c.line, {q(routes.DEFINITION)})
      where r.framework = 'fastapi' group by all""",
    "fast_end": """
      select d.path, d.line_no, d.def, min(c.line_no) stop from fast_def d left join corpus c on c.path = d.path
      and c.line_no between d.def + 1 and d.def + 60 and trim(c.line) <> '' and not regexp_matches(c.line, '^[ \\t]') group by all""",
    "lara": f"""
      select r.path, r.line_no, coalesce(min(c.line_no), any_value(r.line_no)) start from (
        select *, coalesce(nullif(regexp_extract(text, {q(routes.CONTROLLER)}, 2), ''), nullif(regexp_extract(text, {q(routes.CONTROLLER)}, 3), '')) named
        from route where framework = 'laravel') r
      left join corpus c on c.path = r.path and regexp_matches(c.line, '(?i)\\bfunction\\s+' || named || '\\s*\\(') group by all""",
    # Brace depth by running sum from the registration line to the first line that closes it.
    "express": """
      select path, line_no, min(here) stop from (
        select r.path, r.line_no, c.line_no here, sum(length(c.line) - length(replace(c.line, '{', '')) - length(c.line) + length(replace(c.line, '}', '')))
               over (partition by r.path, r.line_no order by c.line_no) depth
        from route r join corpus c on c.path = r.path and c.line_no >= r.line_no where r.framework = 'express')
      where depth <= 0 group by all""",
    "win": """
      select r.*, case framework when 'fastapi' then def + 1 when 'laravel' then l.start else r.line_no end::int body_start,
             case framework when 'laravel' then l.start else r.line_no end::int window_start,
             least(n, case framework when 'fastapi' then coalesce(f.stop - 1, f.def + 61) when 'laravel' then l.start + 60 else e.stop end)::int window_end
      from route r left join fast_end f using (path, line_no) left join lara l using (path, line_no)
      left join express e using (path, line_no) join nlines using (path)""",
    "win_text": """
      select w.path, w.line_no, string_agg(c.line, chr(10) order by c.line_no) window_text
      from win w join corpus c on c.path = w.path and c.line_no between w.window_start and w.window_end group by all""",
    "auth": f"""
      select w.*, window_text, list_filter([
        case when framework = 'express' and regexp_matches(f.text, {q(routes.GLOBAL_MIDDLEWARE)}) then {q(routes.SIGNALS['global'])} end,
        case when framework = 'express' and regexp_matches(window_text, {q(routes.AUTH_NAME)}) then {q(routes.SIGNALS['chain'])} end,
        case when framework = 'express' and regexp_matches(window_text, {q(routes.REQUEST_PRINCIPAL)}) then {q(routes.SIGNALS['request'])} end,
        case when framework = 'fastapi' and regexp_matches(window_text, {q(routes.DEPENDENCY)}) and regexp_matches(window_text, {q(routes.AUTH_WORD)}) then {q(routes.SIGNALS['dependency'])} end,
        case when framework = 'fastapi' and regexp_matches(window_text, {q(routes.PRINCIPAL_NAME)}) then {q(routes.SIGNALS['principal'])} end,
        case when framework = 'laravel' and regexp_matches(w.text || chr(10) || window_text, {q(routes.ROUTE_MIDDLEWARE)}) then {q(routes.SIGNALS['route'])} end,
        case when framework = 'laravel' and regexp_matches(f.text, {q(routes.CONTROLLER_MIDDLEWARE)}) then {q(routes.SIGNALS['controller'])} end,
        case when framework = 'laravel' and regexp_matches(w.text || chr(10) || window_text, {q(routes.LARAVEL_PRINCIPAL)}) then {q(routes.SIGNALS['laravel'])} end
        ], lambda s: s is not null) signals, regexp_matches(window_text, {q(routes.OWNERSHIP)}) ownership
      from win w join win_text using (path, line_no) join files f on f.path = w.path""",
    "param_hits": f"""
      select a.*, param as parameter, c.line_no::int query_line, {strip_sql('c.line')} query_text
      from (select *, unnest(params) param from auth) a join corpus c on c.path = a.path and c.line_no between a.body_start and a.window_end
      where not regexp_matches(c.line, {q(routes.REGISTRATION)}) and regexp_matches(c.line, {q(routes.LOOKUP)})
        and list_contains(regexp_extract_all(c.line, '\\w+'), param)""",
    "logic": f"""
      select repo, 'RESEARCH-LOGIC-' || {sha("'LOGIC'", 'path', 'query_line', 'query_text')} as id, 'research-logic' check_id,
             'Business Logic & Authorization' category, 'research_logic' agent, 'research_logic.' || rule sub_agent, 'high' severity,
             'medium' confidence, path file, query_line line, substring(query_text, 1, 500) snippet, rule, rule rule_id,
             method || ' ' || route || case when miss then ' executes a database query on route parameter ''' || parameter
               || ''' but no authorization guard is present in its handler chain.'
               else ' looks up a resource by route parameter ''' || parameter
               || ''' without comparing resource ownership against the session principal.' end description,
             case when miss then 'Require an explicit server-side authentication and authorization decision before the object access.'
               else 'Bind the object access to the authenticated principal and tenant; return 404 for non-owned resources.' end remediation,
             method, route, framework, parameter, query_line, line_no route_line, array_to_string(signals, '|') auth_signals
      from (select *, len(signals) = 0 miss, case when len(signals) = 0 then 'missing-authorization' else 'idor-bola' end as rule from param_hits)
      where miss or not ownership""",
    "biz": f"""
      select repo, 'RESEARCH-LOGIC-' || {sha("'LOGIC'", 'path', 'line_no', 'found')} as id, 'research-logic' check_id,
             'Context-Aware Business Logic' category, 'research_logic' agent, 'research_logic.' || rule sub_agent, 'high' severity,
             'medium' confidence, path file, line_no line, substring(found, 1, 500) snippet, rule, rule rule_id, description, remediation
      from (
        select *, {strip_sql('line')} found, 'sensitive-route-without-authorization-signal' as rule,
          'A sensitive route has no recognizable authorization control in its local handler context.' description,
          'Require an explicit server-side policy decision for the operation and bind it to the authenticated principal and tenant.' remediation
        from (select *, bool_or(regexp_matches(line, {q(routes.CONTROL_WORD)})) over (partition by path order by line_no rows between current row and 14 following) guarded from corpus)
        where regexp_matches(line, {q(routes.SENSITIVE_REGISTRATION)})
          and regexp_matches(regexp_extract(line, {q(routes.SENSITIVE_REGISTRATION)}, 2), {q(routes.SENSITIVE_WORD)}) and not guarded
        union all
        select *, false, {strip_sql('line')}, 'client-controlled-business-value',
          'A business-critical value appears to be accepted from a request without evidence of server-side recomputation.',
          'Derive prices, roles, ownership, status transitions, and tenant identity from trusted server state.'
        from corpus where regexp_matches(line, {q(routes.CLIENT_VALUE)}))""",
    # --- findings and annotations ---
    "found": """
      select repo, id, check_id, category, agent, sub_agent, severity, confidence, file, line, snippet, rule, rule_id, description, remediation from domain
      union all select repo, id, check_id, category, agent, sub_agent, severity, confidence, file, line, snippet, rule, rule_id, description, remediation from supply
      union all select repo, id, check_id, category, agent, sub_agent, severity, confidence, file, line, snippet, rule, rule_id, description, remediation from taint
      union all select repo, id, check_id, category, agent, sub_agent, severity, confidence, file, line, snippet, rule, rule_id, description, remediation from logic
      union all select repo, id, check_id, category, agent, sub_agent, severity, confidence, file, line, snippet, rule, rule_id, description, remediation from biz""",
    "usage": f"""
      select distinct repo, id, case when len(reasons) > 0 then 'expected' else 'unexpected' end behavior, file, line,
             case when len(reasons) > 0 then array_to_string(reasons, '; ') else {q(verdicts.REASON_NONE)} end rationale
      from (select *, list_filter([
          case when len(list_intersect(string_split(lower(file), '/'), {list(verdicts.NOISE_SEGMENTS)})) > 0 then {q(verdicts.REASON_SEGMENT)} || file end,
          case when {BASE} in {in_list(verdicts.NOISE_NAMES)} then {q(verdicts.REASON_NAME)} || {BASE} end,
          case when {' or '.join(f'suffix(lower(file), {q(s)})' for s in verdicts.NOISE_SUFFIXES)} then {q(verdicts.REASON_SUFFIX)} || file end,
          case when starts_with({BASE}, '.env') and check_id in ('01', '30') and ({' or '.join(f'contains({BASE}, {q(s)})' for s in verdicts.ENV_TEMPLATE_MARKS)}) then {q(verdicts.REASON_ENV)} end,
          case when {BASE} = 'robots.txt' then {q(verdicts.REASON_ROBOTS)} end], lambda r: r is not null) reasons from found)""",
    "verdict": f"""
      select repo, id, check_id, file, line, case
          when starts_with(file, 'src/broken_') then 'unsupported'
          when {SUFFIX} = '.py' then case when exists (select 1 from fn where fn.path = file and line between start_line and end_line) then 'not-assessed' else 'static-confirmed' end
          when check_id in {in_list(verdicts.CONFIRMED_CHECKS)} then 'static-confirmed' else 'static-only' end verdict
      from (select distinct repo, id, check_id, file, line from found)""",
    "ordered": """
      select *, row_number() over (order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3
        when 'info' then 4 else 5 end, repo, file, line, check_id, id, description) position from found""",
    "merged": """
      select f.*, u.behavior, u.rationale behavior_rationale, v.verdict verification_verdict
      from found f left join usage u using (repo, id) left join verdict v using (repo, id)""",
    "arrivals": "select d.*, e.ts arrived from files d join events_table e on e.event_id = d.doc_id",
    "events_table": "select event_id, ts from main.events",
}


KEYWORDS = {
    "on", "where", "group", "left", "right", "join", "anti", "using", "order", "union", "qualify", "cross", "inner",
    "semi", "having", "limit",
}


def _tables(sql: str) -> str:
    """Refer to parts as ``<name>_t`` so that they never hide a table or a column."""

    def rename(match: re.Match) -> str:
        verb, name, alias = match.group(1), match.group(2), match.group(3)
        if name not in PARTS:
            return match.group()
        return f"{verb} {name}_t" + (f" {name}" if alias is None or alias in KEYWORDS else "")

    return re.sub(r"\b(from|join)\s+(\w+)\b(?=(?:\s+([a-z_]\w*))?)", rename, sql)


def assemble(final: str) -> str:
    """A complete statement: the parts the final select uses, in dependency order."""
    order: list[str] = []
    texts = {name: _tables(sql) for name, sql in PARTS.items()}

    def need(sql: str, path: tuple[str, ...]) -> None:
        for name in PARTS:
            if name not in path and name not in order and re.search(rf"\b(from|join) {name}_t\b", sql):
                need(texts[name], (*path, name))
                order.append(name)

    final = _tables(final)
    need(final, ())
    ctes = ",\n".join(f"{n}_t as {'' if n == 'reach' else 'materialized '}({texts[n]})" for n in order)
    return f"with recursive {ctes}\n{final}" if order else final
