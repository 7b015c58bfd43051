"""Expected-usage noise filtering, static verdicts and valued findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.catalogue import SEVERITY_RANK, UNKNOWN_RANK
from sentrel.functions.text import base_name, detect_language, segments, suffix
from sentrel.operators.structure import parsed_rows

# --- Fixed values ------------------------------------------------------------
NOISE_SEGMENTS = (
    "test", "tests", "spec", "specs", "__tests__", "fixtures", "fixture", "examples", "example", "samples", "sample",
    "docs", "doc", "documentation", "stubs", "mock", "mocks", ".github", ".gitlab", ".vscode", ".idea", "templates",
)
NOISE_NAMES = (
    "robots.txt", "readme", "readme.md", "license", "changelog", "contributing", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "poetry.lock", "composer.lock", "go.sum", "gemfile.lock", "cargo.lock", "flake.lock",
    "pipfile.lock", "pubspec.lock", "deno.lock",
)
NOISE_SUFFIXES = (
    ".md", ".markdown", ".rst", ".txt", ".po", ".pot", ".min.js", ".map", ".svg", ".png", ".jpg", ".jpeg", ".gif",
    ".ico", ".woff", ".woff2", ".pdf",
)
ENV_CHECKS = ("01", "30")
ENV_TEMPLATE_MARKS = (".example", ".sample", ".template", "example")
CONFIRMED_CHECKS = ("01", "30", "supply-chain")
CONFIRMED_RULES = (
    "hardcoded-credential",
    "default-credentials",
    "unpinned-dependency",
    "install-script-network-execution",
    "package-script-download-execute",
)
REASON_SEGMENT = "path is inside a test/fixture/example/docs segment: "
REASON_NAME = "filename is a documentation, template, or lockfile artifact: "
REASON_SUFFIX = "non-source documentation or generated asset: "
REASON_ENV = "secret-shaped value appears in an env template where placeholders are expected"
REASON_ROBOTS = "robots.txt directives are intentional crawl policy"
REASON_NONE = "no expected-usage signal found"
VERDICTS = ("verified", "static-confirmed", "not-reproduced", "static-only", "unsupported", "not-assessed")
VALUED = {"strict": ("verified", "static-confirmed"), "lenient": ("verified", "static-confirmed", "static-only")}
MAX_VERIFY = 100
# --- end of fixed values -----------------------------------------------------


def severity_rank(severity: Column) -> Column:
    chain = None
    for name, rank in SEVERITY_RANK.items():
        chain = F.when(severity == name, rank) if chain is None else chain.when(severity == name, rank)
    return chain.otherwise(UNKNOWN_RANK)


def report_order() -> list[Column]:
    """A total order for top-k lists: severity, then place, then identity."""
    return [severity_rank(F.col("severity")), *[F.col(c) for c in ("repo", "file", "line", "check_id", "id", "description")]]


def usage_columns() -> tuple[Column, Column]:
    """``behavior`` and ``rationale`` of a finding, from its path and check only."""
    path = F.col("file")
    lower, base = F.lower(path), F.lower(base_name(path))
    ends = F.lit(False)
    for ending in NOISE_SUFFIXES:
        ends = ends | F.endswith(lower, F.lit(ending))
    template = F.lit(False)
    for mark in ENV_TEMPLATE_MARKS:
        template = template | F.contains(base, F.lit(mark))
    in_segment = F.arrays_overlap(segments(lower), F.array(*[F.lit(s) for s in NOISE_SEGMENTS]))
    reasons = F.array_compact(
        F.array(
            F.when(in_segment, F.concat(F.lit(REASON_SEGMENT), path)),
            F.when(base.isin(*NOISE_NAMES), F.concat(F.lit(REASON_NAME), base)),
            F.when(ends, F.concat(F.lit(REASON_SUFFIX), path)),
            F.when(F.startswith(base, F.lit(".env")) & F.col("check_id").isin(*ENV_CHECKS) & template, F.lit(REASON_ENV)),
            F.when(base == "robots.txt", F.lit(REASON_ROBOTS)),
        )
    )
    behavior = F.when(F.size(reasons) > 0, "expected").otherwise("unexpected")
    rationale = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(REASON_NONE)
    return behavior, rationale


def expected_usage(findings: DataFrame) -> DataFrame:
    """``(repo, id, behavior, file, line, rationale)``, one row per id."""
    behavior, rationale = usage_columns()
    rows = findings.select("repo", "id", behavior.alias("behavior"), "file", "line", rationale.alias("rationale"))
    return rows.dropDuplicates(["repo", "id"])


def behaviour_counts(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.count("*").alias("assessed_findings"),
        F.count_if(F.col("behavior") == "expected").alias("expected_count"),
        F.count_if(F.col("behavior") == "unexpected").alias("unexpected_count"),
    )


def file_ranges(parsed: DataFrame) -> DataFrame:
    """``(repo, file, known, parsed, ranges)`` of facts or parsed files: the line ranges of Python functions, no text."""
    python = suffix(F.col("path")) == ".py"
    ranges = F.transform("functions", lambda f: F.struct(f["start_line"].alias("s"), f["end_line"].alias("e")))
    return parsed.select(
        "repo", F.col("path").alias("file"), F.lit(True).alias("known"),
        F.when(python, F.col("parsed")).alias("parsed"), F.when(python, ranges).alias("ranges"),
    )


def verdict_columns() -> tuple[Column, Column]:
    """``verdict`` and ``reason`` of a finding that stands beside the ranges of its file.

    Only the part of a verdict that needs no execution: findings inside a Python function stay ``not-assessed``.
    """
    ext = suffix(F.col("file"))
    inside = F.exists("ranges", lambda r: F.col("line").between(r["s"], r["e"]))
    confirmed = F.col("check_id").isin(*CONFIRMED_CHECKS) | F.col("rule").isin(*CONFIRMED_RULES)
    cases = [
        (F.col("known").isNull(), "unsupported", F.lit("file not found")),
        ((ext == ".py") & ~F.col("parsed"), "unsupported", F.lit("parse failed: SyntaxError")),
        ((ext == ".py") & inside, "not-assessed", F.lit("inside a function; the target is never executed")),
        (
            ext == ".py",
            "static-confirmed",
            F.lit("module-level constant (no callable harness); artifact confirmed at reported line"),
        ),
        (confirmed, "static-confirmed", F.lit("static-truth finding; the evidence artifact is present at the reported location")),
    ]
    verdict = reason = None
    for test, name, why in cases:
        verdict = F.when(test, name) if verdict is None else verdict.when(test, name)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    shown = F.when(ext == "", "unknown").otherwise(ext)
    only = F.concat(
        F.lit("no runtime harness for '"), shown, F.lit("' in the sandbox; exercise the proof blueprint in an isolated fixture")
    )
    return verdict.otherwise("static-only"), reason.otherwise(only)


def static_verdicts(findings: DataFrame, files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``(repo, id, check_id, file, line, verdict, reason)``, one row per id.

    With ``facts`` nothing is parsed; else each Python file is, where it is, and only the ranges of its functions move.
    """
    asked = findings.select("repo", "id", "check_id", "file", "line", "rule").dropDuplicates(["repo", "id"])
    if facts is None:
        rows = files.withColumn("language", detect_language(F.col("path")))
        facts = parsed_rows(rows.withColumn("text", F.when(suffix(F.col("path")) == ".py", F.col("text"))))
    verdict, reason = verdict_columns()
    return asked.join(file_ranges(facts), ["repo", "file"], "left").select(
        "repo", "id", "check_id", "file", "line", verdict.alias("verdict"), reason.alias("reason")
    )


def annotated(findings: DataFrame, facts: DataFrame | None, usage: bool = True) -> DataFrame:
    """Findings with behaviour and verdict as columns, as ``merge_verification`` gives them for verdicts of all findings.

    Behaviour follows from the row itself, and the verdict from the ranges of its file, so nothing is grouped by id.
    Without ``facts`` verdicts are null, without ``usage`` behaviour counts as unexpected.
    """
    none = F.lit(None).cast("string")
    if facts is not None:
        findings = findings.join(file_ranges(facts), ["repo", "file"], "left")
    behavior, rationale = usage_columns() if usage else (F.lit("unexpected"), F.lit(""))
    verdict = verdict_columns()[0] if facts is not None else none
    rows = findings.withColumns({"behavior": behavior, "behavior_rationale": rationale, "verification_verdict": verdict})
    return rows.withColumn("poc_verified", F.col("verification_verdict") == "verified").drop("known", "parsed", "ranges")


def verify_candidates(findings: DataFrame, limit: int | None = MAX_VERIFY) -> DataFrame:
    """The most severe findings that go to verification; ``None`` takes all of them."""
    return findings if limit is None else findings.orderBy(*report_order()).limit(limit)


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """One row with a fixed column per verdict."""
    return verdicts.agg(
        F.count("*").alias("assessed_findings"),
        *[F.count_if(F.col("verdict") == v).alias(v.replace("-", "_") + "_count") for v in VERDICTS],
    )


def merge_verification(findings: DataFrame, usage: DataFrame | None, verdicts: DataFrame | None) -> DataFrame:
    """Left join both annotations: none means ``unexpected`` and a null verdict."""
    out = findings
    if usage is not None:
        notes = usage.select("repo", "id", "behavior", F.col("rationale").alias("behavior_rationale"))
        out = out.join(notes, ["repo", "id"], "left")
    else:
        out = out.withColumns({"behavior": F.lit(None).cast("string"), "behavior_rationale": F.lit(None).cast("string")})
    if verdicts is not None:
        out = out.join(verdicts.select("repo", "id", F.col("verdict").alias("verification_verdict")), ["repo", "id"], "left")
    else:
        out = out.withColumn("verification_verdict", F.lit(None).cast("string"))
    return out.withColumns(
        {
            "behavior": F.coalesce("behavior", F.lit("unexpected")),
            "behavior_rationale": F.coalesce("behavior_rationale", F.lit("")),
            "poc_verified": F.col("verification_verdict") == "verified",
        }
    )


def valued_findings(merged: DataFrame, policy: str = "strict") -> DataFrame:
    """Findings that are not expected usage and whose verdict the policy accepts."""
    return merged.filter((F.col("behavior") != "expected") & F.col("verification_verdict").isin(*VALUED[policy]))
