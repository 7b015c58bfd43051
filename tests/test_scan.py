from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS, Rule
from sentrel.operators.corpus import explode_lines
from sentrel.operators.scan import PLAN_PATTERNS, audit_agent, audit_lines, filename_scan, pattern_scan
from sentrel.operators.supply import audit_supply_chain
from sentrel.sources.rules import load_rules, select_checks, usable_patterns

CODE = {
    "src/a.py": 'api_key = "abcdefghijkl"\nx = 1\npassword = "test"\n',
    "src/b.js": 'app.get("/admin/x", h);\ndocument.write(req.body)\n',
    "src/run.py": "eval(req.body); exec(y)\nos.system(z)\n",
    "src/bad.py": "def broken(:\n eval(q)\n",
    "prod.env": "A=1",
    ".env.example": "A=1",
    "clean.py": "def add(a, b):\n    return a + b\n",
}


def ids(df):
    return sorted((r.id, r.check_id, r.file, r.line, r.rule) for r in df.collect())


def test_event_outranks_pattern_and_last_event_wins(files_of):
    rows = {(r.check_id, r.file, r.line): r.rule for r in audit_agent(files_of(CODE), agent="injection").collect()}
    assert rows["16", "src/run.py", 1] == "dynamic execution via exec"
    assert rows["17", "src/run.py", 2] == "shell execution via system"
    assert ("16", "src/run.py", 2) not in rows
    assert not any(file == "src/bad.py" for _, file, _ in rows)


def test_clean_file_and_selections(files_of):
    files = files_of(CODE)
    assert all(r.file != "clean.py" for r in audit_agent(files).collect())
    assert {r.check_id for r in audit_agent(files, ids=["03", "nope"]).collect()} == {"03"}
    assert ids(audit_agent(files, agent="secrets", ids=[])) == ids(audit_agent(files, agent="secrets"))
    assert audit_agent(files, agent="infra", ids=["03"]).count() == 0
    assert audit_agent(files, ids=["nope"]).count() == 0


def test_ids_do_not_depend_on_partitions(files_of):
    files = files_of(CODE)
    assert ids(audit_agent(files.repartition(7))) == ids(audit_agent(files.coalesce(1)))


def test_row_local_scans_add_up(files_of):
    items = list(CODE.items())
    halves = ids(audit_agent(files_of(dict(items[:3])))) + ids(audit_agent(files_of(dict(items[3:]))))
    assert sorted(halves) == ids(audit_agent(files_of(CODE)))


def test_snippets_hold_no_secret(files_of):
    assert not audit_agent(files_of(CODE)).filter(F.contains("snippet", F.lit("abcdefghijkl"))).count()


def test_filename_rules(files_of):
    assert {(r.path, r.check_id) for r in filename_scan(files_of(CODE)).collect()} == {("prod.env", "02")}


def test_malformed_and_excluding_patterns(spark, files_of):
    rule = Rule("X", "n", "secrets", "regex", "r", None, None, "d", None, patterns=("(", "a(?P<n>b)", "pass"), exclude_patterns=("test",))
    hits = pattern_scan(explode_lines(files_of({"a": "pass\npass test\nother"})), [rule]).collect()
    assert [(h.line_no, h.rule) for h in hits] == [(1, "pass")]
    assert usable_patterns(spark, ["(", "a++b", "(?P<n>x)", "ok"]) in (["a++b", "ok"], ["ok"])


def test_defaults_fill_missing_rule_values(files_of):
    rule = Rule("X", "n", "secrets", "regex", "r", None, None, "d", None, patterns=("pass",))
    row = audit_agent(files_of({"a": "pass"}), [rule]).first()
    assert (row.severity, row.confidence, row.sub_agent) == ("medium", "medium", "secrets.X")
    assert row.remediation.startswith("Review this code path")


def test_rules_as_table_and_json(spark, tmp_path, files_of):
    chosen = select_checks(load_rules(spark), "secrets", ["01", "09", "zz"])
    assert [r.check_id for r in chosen.collect()] == ["01"]
    assert select_checks(load_rules(spark), "infra", []).count() == 11
    (tmp_path / "rules.json").write_text(
        '{"checks": [{"id": "A", "name": "n", "agent": "infra", "default_rule": {"kind": "regex", "patterns": ["needle"]}}]}'
    )
    loaded = load_rules(spark, str(tmp_path / "rules.json"))
    found = audit_agent(files_of({"f": "a needle"}), loaded).collect()
    assert [(r.check_id, r.rule_id, r.line) for r in found] == [("A", "configured-rule", 1)]
    assert len(CHECKS) == load_rules(spark).count() == 36


def test_manifests_with_bad_json(files_of):
    files = files_of(
        {
            "a/package.json": '{"scripts": ["curl x | sh"]}',
            "b/package.json": "{not json curl | sh",
            "c/package.json": '{"scripts": {"pre": "wget u && bash x", "ok": "node ."}}',
            "d/other.json": '{"scripts": {"pre": "curl u | sh"}}',
        }
    )
    rows = [(r.file, r.rule) for r in audit_supply_chain(files).collect()]
    assert rows == [("c/package.json", "package-script-download-execute")]


def matches(df):
    return sorted((r.path, r.line_no, r.check_id, r.line, r.rule) for r in df.collect())


def test_joined_patterns_equal_plan_patterns(files_of):
    odd = {"long.js": "x" * 100_000 + "eval(req.body)", "empty": "", "wide.py": "pässwörd = 'ä' # PASSWORD = 'geheimgeheim'\n\n"}
    files = files_of({**CODE, **odd})
    for lines in (explode_lines(files), audit_lines(files)):
        assert matches(pattern_scan(lines, joined=True)) == matches(pattern_scan(lines, joined=False)) != []
    rules = [
        # No literal, a literal shorter than a gram, the order of patterns, exclusions, no pattern at all.
        Rule("A", "n", "a", "regex", "r", None, None, "d", None, patterns=(r"\d\s*$", "y\\)"), exclude_patterns=("admin", "=1")),
        Rule("B", "n", "a", "regex", "r", None, None, "d", None, patterns=("(?i)API", "api_key", "(", "zz")),
        Rule("C", "n", "a", "ast_or_regex", "r", None, None, "d", None, patterns=("exec",)),
        Rule("D", "n", "a", "ast_or_regex", "r", None, None, "d", None, code_events=("dynamic execution via eval", "shell execution via system")),
    ]
    for lines in (explode_lines(files), audit_lines(files)):
        assert matches(pattern_scan(lines, rules, joined=True)) == matches(pattern_scan(lines, rules, joined=False)) != []
    assert matches(pattern_scan(explode_lines(files), [], joined=True)) == []


def test_thousands_of_rules_in_a_plan_of_fixed_size(files_of):
    def rules(n):
        return [
            Rule(f"R{i:04}", "n", "a", "regex", "r", None, None, "d", None, patterns=(rf"needle_{i}\b", rf"(?i)pin{i}\s*=")) for i in range(n)
        ]

    numbers = [(i % 3000, (11 * i + 1) % 4000) for i in range(0, 6000, 7)]
    lines = explode_lines(files_of({"a.py": "\n".join(f"x = needle_{a}; PIN{b}  = 1" for a, b in numbers)}))
    found = pattern_scan(lines, rules(2000))
    want = [(at, f"R{a:04}", rf"needle_{a}\b") for at, (a, _) in enumerate(numbers, 1) if a < 2000]
    want += [(at, f"R{b:04}", rf"(?i)pin{b}\s*=") for at, (a, b) in enumerate(numbers, 1) if b < 2000 and a != b]
    assert sorted((r.line_no, r.check_id, r.rule) for r in found.collect()) == sorted(want)

    def size(df):
        return len(df._jdf.queryExecution().optimizedPlan().numberedTreeString())

    small = pattern_scan(lines, rules(PLAN_PATTERNS))
    assert size(found) < 1.1 * size(small)
