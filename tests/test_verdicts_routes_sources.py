import os

import pytest
from pyspark.sql import functions as F

from sentrel.operators.blueprints import attach_blueprints, blueprints
from sentrel.operators.routes import handler_windows, logic_findings, routes
from sentrel.operators.scan import audit_agent
from sentrel.operators.verdicts import (
    expected_usage,
    merge_verification,
    static_verdicts,
    valued_findings,
    verify_candidates,
)
from sentrel.plans.audit import audit
from sentrel.sources.report import write_report
from sentrel.sources.tree import scan_corpus, scan_patches

PY = '@app.get("/items/{item_id}")\ndef read(item_id, user=Depends(get_current_user)):\n    return db.query(item_id)\n\nx = 1\n'
OWNED = 'router.get("/o/:oid", requireAuth, (req, res) => {\n  const o = db.find(oid);\n  if (o.user_id == req.user.id) res.json(o);\n});\n'
OPEN = 'router.get("/o/:oid", function (req, res) {\n  const o = db.find(oid);\n});\n'


def test_routes_and_windows(files_of):
    files = files_of({"a.py": PY, "b.js": OWNED, "c.js": OPEN})
    assert {(r.path, r.framework, r.method, tuple(r.params)) for r in routes(files).collect()} == {
        ("a.py", "fastapi", "GET", ("item_id",)),
        ("b.js", "express", "GET", ("oid",)),
        ("c.js", "express", "GET", ("oid",)),
    }
    windows = {r.path: (r.body_start, r.window_start, r.window_end) for r in handler_windows(files).collect()}
    assert windows == {"a.py": (3, 1, 4), "b.js": (1, 1, 4), "c.js": (1, 1, 3)}
    assert {(r.file, r.rule, r.line) for r in logic_findings(files).collect()} == {
        ("a.py", "idor-bola", 3),
        ("c.js", "missing-authorization", 2),
    }


def test_blueprints_are_attached_by_id(files_of):
    found = logic_findings(files_of({"c.js": OPEN}))
    text = attach_blueprints(found, blueprints(found)).first().poc_payload
    assert "curl -i -X GET 'http://127.0.0.1:8000/o/TEST_MARKER_123'" in text and "{" not in text


def test_verdicts(files_of):
    files = files_of(
        {
            "bad.py": 'password = "admin"\ndef broken(:\n',
            "ok.py": 'password = "admin"\ndef f():\n    password = "root"\n',
            "k.js": 'password = "admin"\ninnerHTML = x\n',
            ".env.example": 'password = "admin"\n',
        }
    )
    found = audit_agent(files)
    got = {(r.file, r.line, r.check_id): r.verdict for r in static_verdicts(found, files).collect()}
    assert got["bad.py", 1, "30"] == "unsupported"
    assert got["ok.py", 1, "30"] == "static-confirmed" and got["ok.py", 3, "30"] == "not-assessed"
    assert got["k.js", 1, "30"] == "static-confirmed" and got["k.js", 2, "19"] == "static-only"
    gone = static_verdicts(found, files.filter(F.col("path") != "k.js")).filter(F.col("file") == "k.js")
    assert {r.verdict for r in gone.collect()} == {"unsupported"}
    usage = {(r.file, r.behavior) for r in expected_usage(found).collect()}
    assert (".env.example", "expected") in usage and ("ok.py", "unexpected") in usage
    merged = merge_verification(found, expected_usage(found), static_verdicts(found, files))
    strict, lenient = valued_findings(merged).count(), valued_findings(merged, "lenient").count()
    assert 0 < strict < lenient
    plain = merge_verification(found, None, None).select("behavior", "verification_verdict").distinct().collect()
    assert [tuple(r) for r in plain] == [("unexpected", None)]


def test_candidates_are_the_most_severe(files_of):
    found = audit_agent(files_of({"a.py": 'password = "admin"\nDEBUG = True\n'}))
    assert {r.severity for r in verify_candidates(found, 1).collect()} == {"critical"}


@pytest.fixture
def source_tree(tmp_path):
    def put(name, data):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    put("src/a.py", b"x = 1\n")
    put("src/__init__.py", b"")
    put(".env", b"DB_PASSWORD=1")
    put("src/deep/.hidden/b.js", b"ok \xff\n")
    put("node_modules/m/c.js", b"skip")
    put("src/build/d.js", b"skip")
    put("src/big.txt", b"x" * 100)
    os.symlink(tmp_path / "src" / "a.py", tmp_path / "src" / "link.py")
    os.symlink(tmp_path / "src", tmp_path / "loop")
    return tmp_path


def test_scan_corpus(spark, source_tree):
    rows = {r.path: r.text for r in scan_corpus(spark, str(source_tree), max_bytes=50).collect()}
    assert rows == {"src/a.py": "x = 1\n", "src/__init__.py": "", ".env": "DB_PASSWORD=1", "src/deep/.hidden/b.js": "ok �\n"}
    capped = scan_corpus(spark, str(source_tree), max_bytes=50, max_files=2)
    assert sorted(r.path for r in capped.collect()) == [".env", "src/__init__.py"]
    repos = scan_corpus(spark, str(source_tree), max_bytes=50, repos=True)
    assert ("src", "a.py") in {(r.repo, r.path) for r in repos.collect()}
    with pytest.raises(ValueError):
        scan_corpus(spark, str(source_tree / "loop"))
    with pytest.raises(FileNotFoundError):
        scan_corpus(spark, str(source_tree / "missing"))


def test_patches_count_added_and_removed_lines(spark, tmp_path):
    (tmp_path / "one.patch").write_text('+password = "admin"\n-password = "root"\n password = "x"\n')
    (tmp_path / "notes.txt").write_text('password = "admin"')
    files = scan_patches(spark, str(tmp_path), "*.patch")
    found = audit_agent(files, ids=["30"]).collect()
    assert sorted((r.file, r.line) for r in found) == [("one.patch", 1), ("one.patch", 2)]


def test_full_audit_and_report(spark, files_of, tmp_path):
    files = files_of({"a.py": PY, "c.js": OPEN, "requirements.txt": "x@master\n"})
    done = audit(files)
    folders = write_report(done.tables, str(tmp_path / "out"))
    row = spark.read.json(folders["report"]).first()
    assert row.total_findings == spark.read.parquet(folders["findings"]).count() > 0
    assert row.status == "completed" and row.verification.truncated is False
    keys = spark.read.text(folders["report"]).first()[0]
    assert keys.index('"agents"') < keys.index('"audit_id"') < keys.index('"total_findings"')


def test_late_files_are_dropped_from_windows(spark, tmp_path):
    from sentrel.streaming.scan import drain, stream_dedupe, stream_scan, stream_severity

    def arrive(n, hour, path):
        rows = [("r", path, 'password = "admin"', f"2024-01-01 {hour:02d}:00:00")]
        df = spark.createDataFrame(rows, "repo string, path string, text string, at string")
        df = df.select("repo", "path", "text", F.to_timestamp("at").alias("arrived"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))

    arrive(1, 1, "a.py"), arrive(2, 2, "a.py"), arrive(3, 10, "b.py")
    arrive(4, 11, "d.py"), arrive(5, 3, "late.py"), arrive(6, 20, "c.py")
    schema = "repo string, path string, text string, arrived timestamp"
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(str(tmp_path / "in"))
    )
    found = stream_scan(stream, delay="3 hours")
    drain(stream_severity(found), str(tmp_path / "w"))
    hours = sorted(r.window_start.hour for r in spark.read.parquet(str(tmp_path / "w/rows")).collect())
    # A batch drops by the watermark of the batch before it, so the file of hour 3 comes two batches after hour 10.
    assert hours == [1, 2, 10, 11]
    drain(stream_dedupe(found).select("id", "file", "check_id"), str(tmp_path / "d"))
    kept = spark.read.parquet(str(tmp_path / "d/rows"))
    assert kept.filter("file = 'a.py' and check_id = '30'").count() == 1


def test_every_finding_has_a_verdict_by_default(files_of):
    from sentrel.plans.audit import audit

    text = "\n".join(f"eval(x{i})" for i in range(150))
    done = audit(files_of({"a.py": text, "b.py": "def broken(:\n"}), with_taint=False, with_logic=False, with_blueprints=False)
    found = done.findings.collect()
    assert len(found) >= 150 and all(r["verification_verdict"] for r in found)
    assert {r["agent"] for r in done.tables["agents"].collect() if r["status"] == "completed_with_errors"} == {"injection"}


def test_long_and_broken_parameter_lists_are_whole(files_of):
    from sentrel.operators.structure import extract_functions

    names = [f"a_rather_long_parameter_name_{i}" for i in range(20)]
    one, two = f"function wide({', '.join(names)}) {{\n  return 1;\n}}\n", "function tall(a,\n  b,\n  c) {\n  return 1;\n}\n"
    rows = extract_functions(files_of({"a.js": one + two})).collect()
    assert {r["name"]: list(r["params"]) for r in rows} == {"wide": names, "tall": ["a", "b", "c"]}


def test_patterns_the_engine_rejects_are_told(spark):
    from sentrel.sources.rules import rejected_patterns, usable_patterns

    given = [r"function \w+ {", "a{,3}b", "eval", "(", "x+"]
    usable = usable_patterns(spark, given)
    assert "eval" in usable and "x+" in usable and "(" not in usable
    assert {r["pattern"] for r in rejected_patterns(spark, given).collect()} == set(given) - set(usable)
    assert spark.range(1).select(*[F.lit("eval").rlike(p) for p in usable]).count() == 1


def test_names_with_a_dollar_are_one_word(spark):
    from sentrel.functions.labels import words

    assert spark.range(1).select(words(F.lit("'x' + user$id + b")).alias("w")).first()["w"] == ["x", "user$id", "b"]


def test_read_tasks_follow_bytes(spark):
    from sentrel.sources.tree import read_parts

    listed = spark.range(4000).select(F.col("id").cast("string").alias("location"), (F.col("id") % 40 * 1000).alias("size"))
    parts = read_parts(listed, target=1_000_000)
    sizes = [r[0] for r in parts.groupBy(F.spark_partition_id()).agg(F.sum("size")).collect()]
    assert len(sizes) == 156 and max(sizes) <= 2_000_000
    assert read_parts(listed, target=1 << 40).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert read_parts(listed.filter("false")).count() == 0
