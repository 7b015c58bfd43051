"""Facts of files, imported names, function summaries and their composition."""

from dataclasses import replace

from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS, Rule
from sentrel.functions.labels import DEFAULT_LABELS
from sentrel.functions.parsing import brace_spans, python_unit
from sentrel.operators import taint
from sentrel.operators.facts import collect_facts, file_facts, module_files, normal_path, symbols
from sentrel.operators.rollups import agent_rollup, verification_summary
from sentrel.operators.scan import audit_agent, fact_event_hits
from sentrel.operators.structure import extract_functions, functions_of
from sentrel.operators.verdicts import annotated, expected_usage, merge_verification, static_verdicts, valued_findings
from sentrel.plans.audit import audit

SAVE = "def save(v):\n    cursor.execute(v)\n"


def sinks(files, **options):
    return sorted({(r.source_file, r.sink_file) for r in taint.taint_inter(files, **options).collect()})


def test_facts_come_from_one_pass_without_a_shuffle(spark, files_of):
    files = files_of({"a.py": "import os\n\ndef f(x):\n    eval(x)\n", "b.js": "app.get('/x', (req, res) => {\n  res.send(1);\n});\n", "n.md": "# none\n"})
    plan = file_facts(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rows = {r.path: r for r in collect_facts(files).collect()}
    assert rows["a.py"].parsed and [e.line for e in rows["a.py"].events] == ["    eval(x)"]
    assert [f.qualname for f in rows["a.py"].functions] == ["f"] and [s is not None for s in rows["a.py"].steps] == [False, False, True, True]
    assert len(rows["b.js"].windows) == 1 and rows["b.js"].events is None
    assert rows["n.md"].language is None and rows["n.md"].steps is None and rows["n.md"].line_count == 1
    assert collect_facts(files.filter("false")).count() == 0


def test_every_definition_of_a_name_is_told(files_of):
    text = "if x:\n    def f(a):\n        eval(a)\nelse:\n    def f(b):\n        exec(b)\n"
    assert [(f["qualname"], f["start_line"]) for f in python_unit(text)["functions"]] == [("f", 2), ("f", 5)]
    script = "function go(a) {\n  one(a);\n}\nfunction go(b) {\n  two(b);\n}\n"
    assert sorted((s["name"], s["start_line"]) for s in brace_spans(script, "javascript")) == [("go", 1), ("go", 4)]
    caller = "def start(request):\n    f(request.args['x'])\n"
    rows = taint.taint_flows(files_of({"m.py": text + caller})).collect()
    assert sorted(r.sink_line for r in rows) == [3, 6]
    assert extract_functions(files_of({"m.py": text})).count() == 2


def test_many_definitions_of_one_name_stay_quick():
    script = "".join(f"function go(a) {{\n  x{i}(a);\n}}\n" for i in range(5000))
    assert len(brace_spans(script, "javascript")) == 5000


def test_imports_bind_callees(files_of):
    caller = "from b import save as keep\ndef go(request):\n    q = request.args['q']\n    keep(q)\n"
    assert sinks(files_of({"a.py": caller, "b.py": SAVE, "zz.py": SAVE})) == [("a.py", "b.py")]
    plain = "from b import save\ndef go(request):\n    q = request.args['q']\n    save(q)\n"
    assert sinks(files_of({"a.py": plain, "b.py": SAVE, "zz.py": SAVE})) == [("a.py", "b.py")]
    # A module that does not define the name binds nothing: all functions of that name count.
    assert sinks(files_of({"a.py": plain, "b.py": "x = 1\n", "zz.py": SAVE, "y.py": SAVE})) == [("a.py", "y.py"), ("a.py", "zz.py")]
    dotted = "import lib.rows as r\ndef go(request):\n    r.save(request.args['q'])\n"
    assert sinks(files_of({"a.py": dotted, "src/lib/rows.py": SAVE, "zz.py": SAVE})) == [("a.py", "src/lib/rows.py")]
    relative = "from ..db.rows import save\ndef go(request):\n    save(request.args['q'])\n"
    files = {"app/web/a.py": relative, "app/db/rows.py": SAVE, "db/rows.py": SAVE, "zz.py": SAVE}
    assert sinks(files_of(files)) == [("app/web/a.py", "app/db/rows.py")]
    package = "from . import rows\ndef go(request):\n    rows.save(request.args['q'])\n"
    assert sinks(files_of({"app/a.py": package, "app/rows/__init__.py": SAVE, "zz.py": SAVE})) == [("app/a.py", "app/rows/__init__.py")]


def test_scripts_and_php_bind_callees(files_of):
    save = "function save(v) {\n  db.query('x' + v);\n}\n"
    body = "function go(req) {\n  const id = req.query.id;\n  %s(id);\n}\n"
    others = {"lib/rows.js": save, "lib/zz.js": save}
    for head, call in (
        ("import { save as keep } from '../lib/rows';\n", "keep"),
        ("import { save } from '../lib/rows.js';\n", "save"),
        ("const { save: keep } = require('../lib/rows');\n", "keep"),
        ("const rows = require('../lib/rows');\n", "rows.save"),
        ("import * as rows from '../lib/rows';\n", "rows.save"),
    ):
        assert sinks(files_of({"web/a.js": head + body % call, **others})) == [("web/a.js", "lib/rows.js")], head
    php = "<?php\nuse App\\Store as S;\nfunction go() {\n  $x = $_GET['a'];\n  S::save($x);\n}\n"
    store = "<?php\nfunction save($v) {\n  system($v);\n}\n"
    assert sinks(files_of({"a.php": php, "app/Store.php": store, "zz.php": store})) == [("a.php", "app/Store.php")]


def test_symbols_and_modules(spark, files_of):
    facts = collect_facts(files_of({"p/a.py": "import x.y\nfrom . import b\nfrom .c import d as e\n", "p/__init__.py": "", "p/c.py": "", "q/index.ts": "1\n"}))
    assert {(r.local, r.original, r.module, r.whole) for r in symbols(facts).collect()} == {
        ("x", None, "x/y", False), ("b", "b", "p/b", True), ("e", "d", "p/c", True)
    }
    assert {(r.module, r.module_path, r.whole) for r in module_files(facts).collect()} >= {
        ("p/c", "p/c.py", True), ("c", "p/c.py", False), ("p", "p/__init__.py", True), ("q", "q/index.ts", True)
    }
    paths = spark.createDataFrame([("a/b/../c/./d",), ("../x",), ("",)], "p string")
    assert [r[0] for r in paths.select(normal_path(F.col("p"))).collect()] == ["a/c/d", "x", ""]


def test_ways_of_resolution_are_counted(files_of):
    caller = "from b import one\ndef go(request):\n    q = request.args['q']\n    one(q)\n    two(q)\n    three(q)\n    none(q)\n    own(q)\ndef own(v):\n    pass\n"
    define = lambda *names: "".join(f"def {n}(v):\n    eval(v)\n" for n in names)
    files = files_of({"a.py": caller, "b.py": define("one", "three"), "c.py": define("one", "two"), "d.py": define("three")})
    counts = {r.way: r.calls for r in taint.resolution_counts(collect_facts(files)).collect()}
    assert counts == {"imported": 1, "by name": 1, "ambiguous": 1, "unresolved": 1, "same file": 1}
    targets = sorted((r.sink_file, r.sink_line) for r in taint.taint_inter(files).collect())
    assert targets == [("b.py", 2), ("b.py", 4), ("c.py", 4), ("d.py", 2)]


def test_depth_without_a_limit_runs_to_an_empty_delta(files_of):
    chain = "def f0(request):\n    f1(request.args['q'])\n" + "".join(f"def f{i}(v):\n    f{i + 1}(v)\n" for i in range(1, 6))
    chain += "def f6(v):\n    eval(v)\n    f1(v)\n"
    files = files_of({"m.py": chain})
    assert taint.taint_flows(files).count() == 0
    rows = taint.taint_flows(files, max_depth=None).collect()
    assert [(r.sink_function, r.depth, len(r.taint_path)) for r in rows] == [("f6", 6, 8)]


def test_each_parameter_gives_its_own_flows(files_of):
    text = "def go(request):\n    a = request.args['1']\n    b = request.form['2']\n    put(a, b, 3)\ndef put(x, y, z):\n    q = x + y\n    eval(q)\n    exec(z)\n"
    rows = taint.taint_inter(files_of({"m.py": text})).collect()
    assert sorted((r.source_line, r.sink_line, r.value) for r in rows) == [(2, 7, "q"), (3, 7, "q")]


def test_the_shortest_path_into_a_function_counts(files_of):
    text = (
        "def go(request):\n    a = request.args['1']\n    b = a\n    c = b\n    put(c)\n    put(a)\n    mid(a)\n"
        "def mid(m):\n    put(m)\ndef put(x):\n    eval(x)\n"
    )
    rows = taint.taint_inter(files_of({"m.py": text})).collect()
    assert [(r.sink_line, r.depth, [s.line for s in r.taint_path]) for r in rows] == [(11, 1, [2, 2, 6, 11])]


def test_sources_inside_sanitizers_may_count_as_sanitized(files_of):
    text = "def f(request):\n    v = int(request.args['y'])\n    eval(v)\n    g(int(request.args['z']))\ndef g(p):\n    eval(p)\n"
    state = lambda labels: {(r.sink_line, r.sanitized) for r in taint.taint_flows(files_of({"m.py": text}), labels).collect()}
    assert state(DEFAULT_LABELS) == {(3, False), (6, False)}
    assert state(replace(DEFAULT_LABELS, sanitized_sources=True)) == {(3, True), (6, True)}


def test_audit_from_facts_equals_audit_from_texts(files_of):
    files = files_of(
        {
            "a.py": "def f(x):\n    eval(x); exec(x)\n    cursor.execute('a' + x)\n    pickle.loads(x)\n",
            "b.py": "eval(\n",
            "c.js": "eval(req.body);\n",
            "d.py": "password = 'changeme'\n",
        }
    )
    facts = collect_facts(files)
    columns = ["repo", "id", "check_id", "file", "line", "rule"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    whole = audit_agent(files)
    assert key(whole) == key(audit_agent(files, facts=facts)) and whole.count() > 5
    assert {(r.line_no, r.check_id, r.rule) for r in fact_event_hits(facts, CHECKS).collect()} >= {(2, "17", "dynamic execution via exec")}
    verdicts = lambda df: sorted((r.id, r.verdict) for r in df.collect())
    assert verdicts(static_verdicts(whole, files)) == verdicts(static_verdicts(whole, files, facts))
    merged = merge_verification(whole, expected_usage(whole), static_verdicts(whole, files))
    shown = ["id", "line", "behavior", "behavior_rationale", "verification_verdict", "poc_verified"]
    assert sorted(map(str, merged.select(*shown).collect())) == sorted(map(str, annotated(whole, facts).select(*shown).collect()))


def test_status_of_agents_and_summary(files_of):
    files = files_of({"a.py": "eval(\n", "b.py": "password = 'changeme'\n"})
    done = audit(files)
    status = {r.agent: (r.status, r.failed_sub_agents) for r in done.tables["agents"].collect()}
    assert status["injection"] == ("completed_with_errors", ["injection.16", "injection.17"])
    assert status["secrets"] == ("completed", []) and status["infra"] == ("completed", [])
    report = done.tables["report"].first()
    assert report.status == "completed_with_errors" and len(report.failed_agents) == 1
    row = done.tables["verification"].first()
    assert (row.behavior_status, row.verification_status, row.verified_count, row.not_reproduced_count) == ("completed", "completed", 0, 0)
    broken = Rule("X1", "x", "infra", "regex", "x", "low", "low", "x", None, patterns=("(open", "fine"))
    rollup = agent_rollup(audit_agent(files, [broken]), files, [broken]).first()
    assert (rollup.status, rollup.failed_sub_agents) == ("completed_with_errors", ["infra.X1"])
    plain = audit(files, with_verdicts=False, with_blueprints=False, with_taint=False, with_logic=False)
    row = plain.tables["verification"].first()
    assert (row.verification_status, row.assessed_findings) == ("skipped", 0)
    empty = annotated(audit_agent(files.filter("false")), collect_facts(files.filter("false")))
    assert verification_summary(empty, valued_findings(empty)).first().assessed_findings == 0


def test_functions_of_facts_carry_no_text(files_of):
    facts = collect_facts(files_of({"a.py": SAVE}))
    assert "text" not in facts.columns and functions_of(facts).count() == 1
