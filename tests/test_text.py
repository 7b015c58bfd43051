import re

from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS
from sentrel.fixtures import SKELETONS
from sentrel.functions.prefilter import any_of_regex, required_literals
from sentrel.functions.text import decode_utf8, detect_language, redact, split_lines, strip_code, suffix


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_split_lines_like_python(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb", "a\rb\x0bc\x0cd", "x\x1cy\x85z w ", "\n\na"]
    got = values(spark, [(t,) for t in texts], "text string", split_lines(F.col("text")))
    assert got == [t.splitlines() for t in texts]


def test_suffix_and_language(spark):
    paths = ["a/b.py", ".env", "x/.env.local", "a.b.TSX", "dir.d/plain", "web/x.js.map", "end."]
    assert values(spark, [(p,) for p in paths], "p string", suffix(F.col("p"))) == [".py", "", ".local", ".tsx", "", ".map", ""]
    got = values(spark, [(p,) for p in paths], "p string", detect_language(F.col("p")))
    assert got == ["python", None, None, "typescript", None, None, None]


def test_redact_masks_values_and_cuts(spark):
    lines = ['  api_key = "abc123secret"  ', "token: xyz;", "ghp_ABCDEFGHIJKLMNOP in text", "x" * 700, "plain"]
    got = values(spark, [(line,) for line in lines], "line string", redact(F.col("line")))
    assert got == ['api_key = "[REDACTED]"', "token: [REDACTED];", "[REDACTED] in text", "x" * 500, "plain"]


def test_malformed_bytes_are_replaced(spark):
    assert values(spark, [(bytearray(b"ok \xff end"),)], "b binary", decode_utf8(F.col("b"))) == ["ok � end"]


def test_strip_code_keeps_line_numbers(spark):
    text = 'a /* one\ntwo */ b // tail\nconst s = "x\\"y" + `multi\nline`;\n# not a comment here'
    got = values(spark, [(text, "javascript")], "t string, l string", strip_code(F.col("t"), F.col("l")))[0]
    assert got.count("\n") == text.count("\n")
    assert "one" not in got and "tail" not in got and "multi" not in got and "# not" in got
    php = values(spark, [("a # gone\nb", "php")], "t string, l string", strip_code(F.col("t"), F.col("l")))[0]
    assert php == "a  \nb"


def test_strip_code_long_and_open_literals(spark):
    long_text = "'" + "a" * 200_000 + "' {"
    open_text = "it\\'s 'open \\' end {"
    got = values(spark, [(long_text, "javascript"), (open_text, "javascript")], "t string, l string", strip_code(F.col("t"), F.col("l")))
    assert got[0] == "  {"
    assert got[1] == re.sub(r"'(?:\\.|[^'])*'", " ", open_text)


def test_required_literals_never_hide_a_match():
    lines = [line.replace("{n}", "7") for _, _, code in SKELETONS for line in code]
    lines += ["GRANT   ALL", "DB-Password=1", "if x auth: return TRUE", "POST login app.post", "Redisql://u:p@h", "CORS origin: '*'"]
    hits = 0
    for rule in CHECKS:
        for pattern in rule.patterns:
            needed = required_literals(pattern)
            assert needed, pattern
            gate = re.compile(any_of_regex(list(needed)))
            for line in lines:
                if re.search(pattern, line):
                    hits += 1
                    assert any(n in line.lower() for n in needed), (pattern, line)
                    assert gate.search(line.lower()), (pattern, line)
    assert hits > 50


def test_required_literals_of_odd_patterns():
    assert required_literals(r"a*b?") == ()
    assert required_literals(r"[0-9]+") == ()
    assert required_literals(r"(?i)foo(bar|baz)?") == ("foo",)
    assert required_literals(r"x(alpha|b)") == ("xalpha", "xb")
