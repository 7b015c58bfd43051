"""Unions, counts and digests over findings, and the rule and evidence lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrel.catalogue import AGENTS, CHECKS, Rule
from sentrel.operators.corpus import dependency_inventory
from sentrel.operators.verdicts import report_order
from sentrel.sources.rules import rules_frame, to_rules, usable_patterns

# --- Fixed values ------------------------------------------------------------
DIGEST_ROWS, DIGEST_SNIPPET = 40, 100
EVIDENCE_ROWS, EVIDENCE_CHARS = 5, 2000
FALLBACK_AGENT = "Business Logic & Authorization Engine (fallback for unknown check)"
NOT_ROUTED = "No matching check routed to this agent"
# --- end of fixed values -----------------------------------------------------


def all_findings(*parts: DataFrame) -> DataFrame:
    """Bag union of the findings of every analysis."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def severity_counts(findings: DataFrame) -> DataFrame:
    severity = F.coalesce("severity", F.lit("unknown")).alias("severity")
    return findings.select(severity).groupBy("severity").agg(F.count("*").alias("findings"))


def check_counts(findings: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS) -> DataFrame:
    """Findings per check, including checks without any."""
    known = rules_frame(findings.sparkSession, to_rules(rules)).select("check_id", "name", "agent")
    counted = findings.groupBy("check_id").agg(F.count("*").alias("n"))
    return known.join(counted, "check_id", "left").select(
        "check_id",
        "name",
        "agent",
        F.concat_ws(".", "agent", "check_id").alias("sub_agent"),
        F.coalesce("n", F.lit(0)).cast("long").alias("finding_count"),
        F.lit("completed").alias("status"),
    )


def agent_rollup(findings: DataFrame, files: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS, unparsed: DataFrame | None = None) -> DataFrame:
    """Per agent: findings, manifests seen, sub-agents, those that failed, and status.

    ``unparsed`` is a table of files that failed to parse: a check that looks at code events has not seen them, and
    neither has a check all of a pattern that does not compile. Such checks are failed sub-agents, and their agent
    ``completed_with_errors``. The manifest paths themselves stay a table (``dependency_inventory``), so no row grows
    with the corpus.
    """
    spark = findings.sparkSession
    given = to_rules(rules)
    every = dict.fromkeys(p for rule in given for p in (*rule.patterns, *rule.exclude_patterns))
    usable = set(usable_patterns(spark, every))
    checks = [
        (rule.agent, f"{rule.agent}.{rule.check_id}", rule.kind == "ast_or_regex", not usable.issuperset((*rule.patterns, *rule.exclude_patterns)))
        for rule in given
    ]
    known = spark.createDataFrame(checks, "agent string, sub_agent string, parses boolean, rejected boolean")
    failed = (spark.range(0).select("id") if unparsed is None else unparsed).agg(F.count("*").alias("failed_files"))
    # The other sides of the cross joins are single rows.
    lost = F.when(F.col("rejected") | (F.col("parses") & (F.col("failed_files") > 0)), F.col("sub_agent"))
    known = known.crossJoin(F.broadcast(failed)).groupBy("agent").agg(
        F.array_sort(F.collect_set("sub_agent")).alias("sub_agents"), F.array_sort(F.collect_set(lost)).alias("failed_sub_agents")
    )
    counted = findings.groupBy("agent").agg(F.count("*").alias("n"))
    manifests = dependency_inventory(files).agg(F.count("*").alias("dependency_files"))
    names = F.create_map(*[F.lit(x) for pair in AGENTS.items() for x in pair])
    return (
        known.join(counted, "agent", "left")
        .crossJoin(F.broadcast(manifests))
        .select(
            "agent",
            F.coalesce(F.try_element_at(names, F.col("agent")), F.col("agent")).alias("display_name"),
            F.coalesce("n", F.lit(0)).cast("long").alias("finding_count"),
            "dependency_files",
            "sub_agents",
            "failed_sub_agents",
            F.when(F.size("failed_sub_agents") > 0, "completed_with_errors").otherwise("completed").alias("status"),
        )
    )


def verification_summary(merged: DataFrame, valued: DataFrame, policy: str = "strict", truncated: bool = False) -> DataFrame:
    """One row of verification counts; findings are counted by distinct id.

    A part that was not asked for, so that no finding has its annotation, is ``skipped``; else it is ``completed``.
    """
    per_id = merged.groupBy("repo", "id").agg(
        F.first("behavior").alias("behavior"), F.first("verification_verdict").alias("verdict"), F.count("*").alias("n"),
        F.max(F.col("behavior_rationale") != "").alias("told"),
    )
    ran = lambda told: F.when(F.coalesce(F.max(told), F.lit(True)), "completed").otherwise("skipped")
    counts = per_id.agg(
        ran(F.col("told")).alias("behavior_status"),
        F.count_if(F.col("behavior") == "expected").alias("expected_count"),
        F.count_if(F.col("behavior") == "unexpected").alias("unexpected_count"),
        ran(F.col("verdict").isNotNull()).alias("verification_status"),
        F.count("verdict").alias("assessed_findings"),
        *[
            F.count_if(F.col("verdict") == v).alias(v.replace("-", "_") + "_count")
            for v in ("verified", "static-confirmed", "not-reproduced", "static-only", "unsupported", "not-assessed")
        ],
        F.coalesce(F.sum(F.when(F.col("behavior") == "expected", F.col("n"))), F.lit(0)).alias("noise_filtered_count"),
    )
    kept = valued.agg(F.count("*").alias("valued_findings_count"))
    return counts.crossJoin(F.broadcast(kept)).withColumns(
        {"verification_policy": F.lit(policy), "truncated": F.lit(truncated)}
    )


def findings_digest(findings: DataFrame, n: int = DIGEST_ROWS) -> DataFrame:
    """``(position, text)``: the ``n`` most severe findings, and a tail line with the rest.

    The sort is a top-k; only its ``n`` rows are numbered.
    """
    top = findings.orderBy(*report_order()).limit(n)
    place = F.row_number().over(Window.orderBy(*report_order()))
    text = F.format_string(
        "- [%s] check %s %s:%d %s :: %s", "severity", "check_id", "file", "line", "rule", F.substring("snippet", 1, DIGEST_SNIPPET)
    )
    lines = top.select(place.alias("position"), text.alias("text"))
    more = F.count("*") - n
    tail = (
        findings.agg(more.alias("more"))
        .filter(F.col("more") > 0)
        .select(F.lit(n + 1).alias("position"), F.format_string("- ... and %d more findings", "more").alias("text"))
    )
    return lines.unionByName(tail)


def rule_lookup(requests: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS) -> DataFrame:
    """Methodology of each requested check.

    ``requests`` holds ``check_id`` and ``agent``; a null agent means the one that owns the
    check. A check that is not routed to the agent gets the agent's sorted ids instead,
    and an unknown check without agent goes to the fallback.
    """
    known = rules_frame(requests.sparkSession, to_rules(rules))
    owner = F.broadcast(
        known.select("check_id", F.col("agent").alias("owner"), "name", "description", "patterns", "severity", "confidence", "remediation")
    )
    available = F.broadcast(known.groupBy("agent").agg(F.array_sort(F.collect_set("check_id")).alias("ids")))
    found = (
        requests.select("check_id", F.col("agent").alias("asked"))
        .join(owner, "check_id", "left")
        .withColumn("agent", F.coalesce("asked", "owner"))
        .join(available, "agent", "left")
    )
    routed = F.col("owner").isNotNull() & (F.col("owner") == F.col("agent"))
    shown = ["name", "description", "patterns", "severity", "confidence", "remediation"]
    return found.select(
        "check_id",
        F.coalesce("agent", F.lit(FALLBACK_AGENT)).alias("agent"),
        *[F.when(routed, F.col(c)).alias(c) for c in shown],
        F.when(~F.coalesce(routed, F.lit(False)), NOT_ROUTED).alias("note"),
        F.when(~F.coalesce(routed, F.lit(False)), F.col("ids")).alias("available_check_ids"),
    )


def evidence_digest(evidence: DataFrame, topic: str, n: int = EVIDENCE_ROWS, chars: int | None = EVIDENCE_CHARS) -> DataFrame:
    """The first ``n`` pages by input order, each cut at ``chars`` (None: whole), joined under a topic."""
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    part = F.concat(F.lit("URL: "), "url", F.lit("\n"), text)
    first = evidence.orderBy("page_id").limit(n).select("page_id", part.alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "part"))), lambda p: p["part"])
    return first.agg(F.array_join(parts, "\n\n").alias("digest")).select(F.lit(topic).alias("topic"), "digest")
