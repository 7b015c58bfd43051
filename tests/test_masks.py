"""Lines are gated once, by Arrow, with the same results as the patterns of the engine on every line."""

import pyarrow as pa
from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS, Rule
from sentrel.fixtures import files_from_documents
from sentrel.functions.labels import DEFAULT_LABELS
from sentrel.functions.masks import literal_regex, masks_of
from sentrel.functions.text import LINE_BREAK, split_lines
from sentrel.operators.corpus import explode_lines
from sentrel.operators.facts import file_facts, line_steps
from sentrel.operators.scan import file_scan, pattern_scan

LINES = [
    "password = 'changeme'", "  const id = req.query.id;", "", "only words here", "PASSWORD: \"Admin123\" ", "cursor.execute(\"SELECT \" + q)",
    "el.innerHTML = x", "api_Key = 'abcdefghijkl'", "réq.body", "run (a)", "router.post('/orders', (req) => {", "x == y", "value=input()",
    "db.query(1) # naïve", "eval", "app.delete('/admin/x', f)", "total = req.body.amount",
]
TEXTS = ["\n".join(LINES), "\r\n".join(LINES[::-1]), "\x0b".join(LINES) + " ", "", "\n", None, "a\r\rb\x1cpassword = 'x'\x85c\n\n"]


def _files(spark):
    rows = [("r", f"src/f_{i}.{end}", text) for i, text in enumerate(TEXTS) for end in ("py", "js", "md")]
    return spark.createDataFrame(rows, "repo string, path string, text string")


def test_masks_of_nulls_and_slices():
    batch = pa.array([["skip"], ["ab", None, "B(", "none"], None, [], ["A=b"]])[1:]
    assert masks_of(batch, ["(?i)b", r"=|\w\("]).to_pylist() == [[1, 0, 3, 0], [], [], [3]]
    assert masks_of(batch, ["(?i)a", "="], "(?i)a").to_pylist() == [[1, 0, 0, 0], [], [], [3]]


def test_literal_regex_needs_literals_of_every_pattern():
    assert literal_regex(["(?i)eval", r"\.raw\("]) == r"(?i)\.raw\(|eval"
    assert literal_regex(["eval", r"\w+"]) is None
    assert literal_regex(["été"]) is None


def test_file_scan_makes_no_row_of_a_line_that_cannot_match(spark):
    files = _files(spark)
    found, every = file_scan(files), pattern_scan(explode_lines(files))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, every.collect()), key=str)
    assert found.count() > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_file_scan_of_patterns_without_literals_or_many(spark):
    files = _files(spark)
    for patterns in ((r"\w{4}",), tuple(f"(?i)pass{'w' * (i % 2)}.{{0,{i}}}d" for i in range(70))):
        rules = [Rule(**{**CHECKS[0].__dict__, "patterns": patterns, "exclude_patterns": ("Admin",)})]
        found, every = file_scan(files, rules), pattern_scan(explode_lines(files), rules)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, every.collect()), key=str)


def test_steps_of_masked_lines_are_those_of_all_lines(spark):
    facts = file_facts(_files(spark), with_logic=True).select("path", "steps")
    lines = _files(spark).select("path", split_lines(F.col("text")).alias("lines"))
    plain = lines.select("path", line_steps(F.col("lines"), DEFAULT_LABELS).alias("every"))
    rows = facts.filter("language is not null" if "language" in facts.columns else "path not like '%.md'").join(plain, "path").collect()
    assert rows and all(row.steps == row.every for row in rows)
    assert any(step is not None for row in rows for step in row.steps or [])


def test_lines_by_any_break(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    parts = F.split("text", LINE_BREAK, -1)
    by_pattern = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    assert all(a == b for a, b in rows.select(split_lines(F.col("text")), by_pattern).collect())


def test_fixture_texts(spark):
    rows = [(12, None, "s"), (32, "a\n\nb\n\n", "s"), (52, "", None), (9, 'q"\n', "s")]
    texts = {r.path: r.text for r in files_from_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    head = 'router.delete("/billing/:bid", (req, res) => {\n  res.send("ok");\n});'
    assert texts["src/billing_12.js"] == head
    assert texts["src/billing_32.js"] == head + "\n// a\n// \n// b"
    assert texts["src/billing_52.js"] == head + "\n// "
    assert texts["web/bundle_9.js.map"].endswith('["q\\"\\n"]}')
