"""Each text is parsed and scanned once, directories are listed in bounded batches, gates find what the plain patterns find."""

import re

import pandas as pd
from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS
from sentrel.functions import prefilter
from sentrel.functions.labels import SINKS, patterns_of
from sentrel.plans.queries import QUERIES
from sentrel.sources import tree


def _documents(spark, folder):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("A line.\nAnother one.").alias("text"), F.lit("s").alias("source"))
    rows.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_directory_is_listed_in_batches(tmp_path, monkeypatch):
    for i in range(25):
        (tmp_path / f"f{i}").write_text("x" * i)
    (tmp_path / "inner").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "f1")
    monkeypatch.setattr(tree, "BATCH_NAMES", 10, raising=False)
    found = list(tree._list_directories(iter([pd.DataFrame({"path": [str(tmp_path)]})])))
    assert max(map(len, found)) <= 10
    rows = pd.concat(found).set_index("name")
    assert len(rows) == 26 and rows.loc["inner", "is_dir"] and rows.loc["f24", "size"] == 24


def test_the_call_tree_parses_each_text_once(spark, tmp_path):
    assert "python_units" not in _plan(QUERIES["build_call_tree"](spark, _documents(spark, tmp_path)))


def test_verdicts_read_the_stored_facts(spark, tmp_path):
    assert "python_units" not in _plan(QUERIES["static_verdicts"](spark, _documents(spark, tmp_path)))


def test_points_are_scanned_once(spark, tmp_path):
    assert "RLIKE" not in _plan(QUERIES["enclosing_function"](spark, _documents(spark, tmp_path))).upper()


def test_anchored_literals_are_found_wherever_they_stand():
    literals = sorted({x for rule in CHECKS if rule.kind != "filename" for p in rule.patterns for x in prefilter.required_literals(p)})
    anchored = re.compile(prefilter.anchored_regex(literals))
    assert all(anchored.search(before + x + after) for x in literals for before in ("", "q ") for after in ("", " q"))
    assert not anchored.search("nothing of the kind stands on this line")
    assert re.search(prefilter.anchored_regex(["a]b", "^c", "-"]), "x^c") and not re.search(prefilter.anchored_regex(["a]b", "^c"]), "a b c")


def test_call_gate_lets_every_sink_through(spark):
    lines = ["db.query(x)", "EVAL (x)", "el.innerHTML = y", "a.Document.Write", "require('m')", "no sink = here", "plain text"]
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    gate = prefilter.call_gate(F.lower("line"), patterns_of(SINKS))
    assert [r[0] for r in rows.select(gate).collect()] == [True] * 5 + [False] * 2
