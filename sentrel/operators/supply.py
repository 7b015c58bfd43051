"""Dependency-manifest audit."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS, Rule
from sentrel.functions.rows import explode_once
from sentrel.functions.text import base_name, finding_id, redact
from sentrel.operators.corpus import dependency_inventory, explode_lines, is_manifest
from sentrel.operators.scan import as_findings
from sentrel.sources.rules import to_rules

# --- Fixed values ------------------------------------------------------------
UNPINNED = (r'(?i)"?\*"?\s*[:=]', r"(?i)(latest|master|main)\b")
INSTALL_HOOK = r"(?i)(preinstall|postinstall|install).*(curl|wget|bash|sh)"
DOWNLOAD_TO_SHELL = r"(?i)(curl|wget).*(\||&&).*(sh|bash)"
SUPPLY_RULES = {
    "unpinned-dependency": (
        "medium",
        "Dependency versions appear unpinned or follow a moving tag.",
        "Pin dependencies to reviewed versions and use lockfiles with integrity checks.",
    ),
    "install-script-network-execution": (
        "high",
        "A dependency installation hook executes a network or shell command.",
        "Remove the hook where possible, pin the source, and review it in an isolated build.",
    ),
    "package-script-download-execute": (
        "high",
        "A package script downloads and executes a shell payload.",
        "Replace download-and-execute behavior with a verified package or checked-in build step.",
    ),
}
# --- end of fixed values -----------------------------------------------------


def _any(line: Column, patterns: Iterable[str]) -> Column:
    test = F.lit(False)
    for pattern in patterns:
        test = test | line.rlike(pattern)
    return test


def _manifest_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(is_manifest(F.col("path")))


def dep_unpinned(lines: DataFrame, patterns: Iterable[str] = UNPINNED) -> DataFrame:
    """Manifest lines with a wildcard or a moving tag."""
    rows = _manifest_lines(lines).filter(_any(F.col("line"), patterns))
    return rows.select("repo", "path", "line_no", "line", F.lit("unpinned-dependency").alias("rule"))


def dep_install_hook(lines: DataFrame) -> DataFrame:
    """Manifest lines where an install hook downloads or starts a shell."""
    rows = _manifest_lines(lines).filter(F.col("line").rlike(INSTALL_HOOK))
    return rows.select("repo", "path", "line_no", "line", F.lit("install-script-network-execution").alias("rule"))


def dep_scripts(files: DataFrame) -> DataFrame:
    """``package.json`` scripts that download and pipe or chain into a shell.

    Reported at line 1. Invalid JSON, and a ``scripts`` that is not an object, give no rows.
    """
    scripts = F.from_json(
        "text", "scripts map<string,string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    )["scripts"]
    packages = files.filter(base_name(F.col("path")) == "package.json")
    return (
        packages.select("repo", "path", F.explode(scripts).alias("name", "script"))
        .filter(F.col("script").rlike(DOWNLOAD_TO_SHELL))
        .select(
            "repo",
            "path",
            F.lit(1).alias("line_no"),
            F.concat("name", F.lit(": "), "script").alias("line"),
            F.lit("package-script-download-execute").alias("rule"),
        )
    )


def dep_requested_by(files: DataFrame, rules: Iterable[Rule] = CHECKS) -> DataFrame:
    """Per tree with a manifest, the sorted agents whose report lists one.

    Every agent that runs, that is every agent of the rules, lists every manifest.
    """
    ran = sorted({rule.agent for rule in to_rules(rules)})
    agents = F.array(*[F.lit(a) for a in ran]).cast("array<string>")
    return dependency_inventory(files).select("repo").distinct().select("repo", agents.alias("requested_by"))


def audit_supply_chain(files: DataFrame) -> DataFrame:
    """Findings of the three manifest rules; one line may give two of them."""
    manifests = files.filter(is_manifest(F.col("path")))
    lines = explode_lines(manifests)
    line = F.col("line")
    # Both line rules in one pass over the manifest lines.
    hits = F.array_compact(
        F.array(
            F.when(_any(line, UNPINNED), F.lit("unpinned-dependency")),
            F.when(line.rlike(INSTALL_HOOK), F.lit("install-script-network-execution")),
        )
    )
    rows = explode_once(lines, "repo", "path", "line_no", "line", rule=hits).unionByName(
        dep_scripts(manifests)
    )

    def text(position: int) -> Column:
        chain = None
        for rule, values in SUPPLY_RULES.items():
            test = F.col("rule") == rule
            chain = F.when(test, values[position]) if chain is None else chain.when(test, values[position])
        return chain

    return as_findings(
        rows.select(
            finding_id("SAST-SC-", F.col("path"), F.col("line_no"), line, F.col("rule")).alias("id"),
            F.lit("supply-chain").alias("check_id"),
            F.lit("Supply Chain").alias("category"),
            F.lit("supply_chain").alias("agent"),
            F.lit("supply_chain.dependency-audit").alias("sub_agent"),
            text(0).alias("severity"),
            F.lit("medium").alias("confidence"),
            "repo",
            F.col("path").alias("file"),
            F.col("line_no").alias("line"),
            redact(line).alias("snippet"),
            "rule",
            F.col("rule").alias("rule_id"),
            text(1).alias("description"),
            text(2).alias("remediation"),
        )
    )
