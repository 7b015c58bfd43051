import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrel.functions.calls import split_arguments, split_calls
from sentrel.functions.parsing import block_end, brace_spans, events_of, handler_lines, python_unit

SOURCE = '''import os.path as p, sys
from a.b import c as d, e

class Box:
    @wrap
    def put(self, x, y=1):
        self.store(x)
        return super().put(os.path.join(x))

    async def get(self):
        def inner(q): return q()
        return inner

def put(z):
    eval(z); exec(z)
'''


def test_python_unit():
    unit = python_unit(SOURCE)
    functions = {f["qualname"]: f for f in unit["functions"]}
    assert list(functions) == ["Box.put", "Box.get", "Box.get.inner", "put"]
    put = functions["Box.put"]
    assert (put["kind"], put["start_line"], put["end_line"], put["params"]) == ("method", 6, 8, ["self", "x", "y"])
    assert put["calls"] == ["os.path.join", "put", "store", "super"]
    assert put["decorators"] == ["@wrap"]
    assert functions["Box.get.inner"]["kind"] == "method" and functions["put"]["kind"] == "function"
    assert [(i["line_no"], i["names"]) for i in unit["imports"]] == [(1, ["p", "sys"]), (2, ["d", "e"])]


def test_unparseable_text_gives_nothing():
    assert python_unit("def broken(:")["parsed"] is False
    assert events_of("eval(") == [] and events_of(None) == []


def test_events_in_source_order():
    assert [(line, m) for line, _, m in events_of(SOURCE)] == [
        (15, "dynamic execution via eval"),
        (15, "dynamic execution via exec"),
    ]
    assert events_of("json.loads(x)\npickle.loads(y)") == [(2, 0, "unsafe pickle deserialization")]


def test_brace_spans():
    js = "function one(a) {\n  if (x) { y(); }\n}\nconst two = (b) => {\n  return b;\n};\nrun(function () {\n});\n"
    assert [(s["name"], s["start_line"], s["end_line"]) for s in brace_spans(js, "javascript")] == [
        ("one", 1, 3),
        ("two", 4, 6),
        ("run", 7, 8),
    ]
    # An open block ends on the line of the last character.
    assert brace_spans("function open() {\n x", "php") == [{"name": "open", "start_line": 1, "end_line": 2}]
    assert brace_spans(js, "python") == []


CALL_LINES = [
    ("r = this.db?.find (a, g(b))", "javascript", [("this.db.find", ["a", "g(b)"]), ("g", ["b"])]),
    ("$this->run($x", "php", [("$this.run", ["$x"])]),
    ("$$abc(1, [2, 3])", "php", [("$abc", ["1", "[2, 3]"])]),
    ("A::b($c, 'x,y')", "php", [("A.b", ["$c", "'x,y'"])]),
    ("$('p', x$(1))", "typescript", [("$", ["'p'", "x$(1)"]), ("x$", ["1"])]),
    ("a.b c . d(e)) f()", "python", [("c.d", ["e"]), ("f", [])]),
    ("9x(\"open, (q\", 'z)", "python", [("x", ["\"open, (q\"", "'z)"])]),
    ("é𝒳 = f(𝒳, {1, 2}, `a,b`)", None, [("f", ["𝒳", "{1, 2}", "`a,b`"])]),
    ("no call", "python", []),
    ("", "php", []),
    (None, "python", None),
]


def test_calls_of_lines(spark):
    rows = spark.createDataFrame([(i, line, lang) for i, (line, lang, _) in enumerate(CALL_LINES)], "i int, line string, lang string")
    got = {r["i"]: r["c"] for r in rows.select("i", split_calls("line", "lang").alias("c")).collect()}
    for i, (line, _, want) in enumerate(CALL_LINES):
        assert (None if got[i] is None else [(c["name"], c["args"]) for c in got[i]]) == want, line


@pytest.mark.parametrize(
    ("text", "parts"),
    [("a, f(b, c), 'x,y', [1, 2],", ["a", "f(b, c)", "'x,y'", "[1, 2]"]), ("a), b", ["a), b"]), (" , ", []), ("", []), ("'a, b", ["'a, b"])],
)
def test_arguments(spark, text, parts):
    assert spark.range(1).select(split_arguments(F.lit(text)).alias("p")).first()["p"] == parts


def test_block_end():
    text = 'app.get("/x", (req) => {\n  const s = "}";\n  if (s) { t(); }\n});\nnext();'
    assert block_end(text, 1) == 4
    assert block_end("plain();\nmore();", 1) is None
    assert block_end("a => {\n x\n y", 1) == 3


def naive_block_end(text, start_line):
    """Reads on from each route by itself, character by character."""
    begin = sum(len(line) + 1 for line in text.split("\n")[: start_line - 1])
    arrow = text.find("=>", begin)
    opening = text.find("{", arrow) if arrow >= 0 else -1
    if opening < 0:
        found = re.compile(r"\bfunction\s*\([^)]*\)\s*\{").search(text, begin)
        if not found:
            return None
        opening = found.end() - 1
    depth, quote = 0, None
    for at in range(opening, len(text)):
        char = text[at]
        if quote:
            quote = None if char == quote else quote
        elif char in "\"'`":
            quote = char
        elif char in "{}":
            depth += 1 if char == "{" else -1
            if not depth:
                break
    return start_line + text[begin:at].count("\n")


@given(st.lists(st.sampled_from(["{", "}", "\n", "=>", "'", '"', "`", "x ", "function (", ")", "function(a) {", "(", " "]), max_size=40))
def test_block_ends_equal_a_walk_per_route(parts):
    text = "".join(parts)
    for line in range(1, text.count("\n") + 2):
        assert block_end(text, line) == naive_block_end(text, line)


def test_many_routes_of_a_file():
    n = 5000
    text = "".join(f"app.get('/a{i}', (req, res) => {{\n  if (x) {{ y('q{{') }}\n}});\n" for i in range(n))
    assert handler_lines(text, range(1, 3 * n, 3), [None] * n) == list(range(3, 3 * n + 1, 3))
    # A block that nothing closes goes to the end; with one per route, a walk per route would read n * n / 2 braces.
    open_ended = "app.get('/', (req) => {\n" * n
    assert handler_lines(open_ended, range(1, n + 1), [None] * n) == [n] * n


def test_named_controllers():
    text = "function Show ($x) {\n}\npublic function store(){}\nfunction show() {}"
    assert handler_lines(text, [1, 1, 1, 1], ["SHOW", "Store", "none", ""]) == [1, 3, None, None]
