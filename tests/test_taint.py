from sentrel.functions.labels import DEFAULT_LABELS
from sentrel.operators import taint
from sentrel.operators.taint import taint_findings, taint_flows, taint_inter, trace_dataflow


def flows(files, labels=DEFAULT_LABELS):
    rows = taint_flows(files, labels).collect()
    return {(r.source_line, r.sink_file, r.sink_line, r.value, r.sanitized) for r in rows}


def test_within_one_function(files_of):
    text = (
        "def f(request):\n"
        "    a = request.args['x']\n"
        "    b = a + 1\n"
        "    a = 'clean'\n"
        "    cursor.execute(a)\n"
        "    cursor.execute(b)\n"
        "    c = int(b)\n"
        "    cursor.execute(c)\n"
        "    cursor.execute(escape(b))\n"
        "    v = int(request.args['y'])\n"
        "    eval(v)\n"
    )
    assert flows(files_of({"m.py": text})) == {
        (2, "m.py", 6, "b", False),
        (2, "m.py", 8, "c", True),
        (2, "m.py", 9, "b", True),
        (10, "m.py", 11, "v", False),  # a source wins over a sanitizer in one expression
    }


def test_first_definition_gives_the_path(files_of):
    text = "z = request.args['1']\ny = request.form['2']\nx = y + z\neval(x)\n"
    rows = taint_flows(files_of({"m.py": text})).collect()
    assert [(r.source_line, r.value) for r in rows] == [(1, "x")]


def test_same_file_callee_wins_else_two_others(files_of):
    caller = "def go(request):\n    q = request.args['q']\n    save(q)\n"
    callee = "def save(v):\n    cursor.execute(v)\n"
    local = flows(files_of({"a.py": caller + callee, "b.py": callee}))
    assert {f[1] for f in local} == {"a.py"}
    files = files_of({"a.py": caller, "b.py": callee, "c.py": callee, "d.py": callee})
    assert {f[1] for f in flows(files)} == {"b.py", "c.py", "d.py"}
    two = taint_flows(files, max_candidates=2)
    assert {r.sink_file for r in two.collect()} == {"b.py", "c.py"}
    elsewhere = flows(files_of({("r1", "a.py"): caller, ("r2", "b.py"): callee}))
    assert elsewhere == set()


def test_every_candidate_is_followed_in_parts(files_of, monkeypatch):
    monkeypatch.setattr(taint, "HOT_NAME", 2)
    caller = "def go(request):\n    q = request.args['q']\n    save(q)\n"
    callee = "def save(v):\n    cursor.execute(v)\n"
    files = files_of({f"a{i}.py": caller for i in range(3)} | {f"b{i}.py": callee for i in range(5)})
    rows = [(r.source_file, r.sink_file) for r in taint_inter(files).collect()]
    assert sorted(rows) == [(f"a{i}.py", f"b{j}.py") for i in range(3) for j in range(5)]


def test_depth_and_recursion_are_bounded(files_of):
    text = (
        "def a(request):\n    x = request.args['q']\n    b(x)\n"
        "def b(p):\n    c(p)\n"
        "def c(p):\n    eval(p)\n    d(p)\n    c(p)\n"
        "def d(p):\n    eval(p)\n"
    )
    assert {f[2] for f in flows(files_of({"m.py": text}))} == {7}


def test_sanitizer_names_default_and_bounded(files_of):
    text = "def f(request):\n    x = request.args['q']\n    print(x)\n    y = print(x)\n    eval(y)\n"
    assert {f[4] for f in flows(files_of({"m.py": text}))} == {True}
    assert {f[4] for f in flows(files_of({"m.py": text}), DEFAULT_LABELS.bounded())} == {False}


def test_findings_are_one_per_line_and_skip_sanitized(files_of):
    text = "def f(request):\n    a = request.args['x']\n    b = request.form['y']\n    cursor.execute(a, b)\n    eval(int(a))\n"
    found = taint_findings(taint_flows(files_of({"m.py": text}))).collect()
    assert [(f.line, f.severity, f.confidence) for f in found] == [(4, "high", "high")]
    assert [s.operation for s in found[0].taint_path] == ["source", "propagate", "sink"]
    assert found[0].flow_evidence.sink.function == "f"


def test_trace_keeps_flows_of_the_named_function(files_of):
    text = "def a(request):\n    x = request.args['q']\n    b(x)\n    eval(x)\ndef b(p):\n    cursor.execute(p)\n"
    rows = trace_dataflow(files_of({"m.py": text}), "m.py", "b").collect()
    assert [r.sink_line for r in rows] == [6]
    assert trace_dataflow(files_of({"m.py": text}), "other.py", "b").count() == 0


def test_javascript_and_php(files_of):
    files = files_of(
        {
            "s.js": "function load(req) {\n  const id = req.query.id;\n  run(id);\n}\nfunction run(v) {\n  db.query('x' + v);\n}\n",
            "p.php": "<?php\n$x = $_GET['a'];\nsystem($x);\n",
        }
    )
    assert flows(files) == {(2, "s.js", 6, "v", False), (2, "p.php", 3, "x", False)}
