"""The full audit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.catalogue import AGENTS, CHECKS, Rule
from sentrel.functions.labels import DEFAULT_LABELS, LabelTables
from sentrel.functions.parsing import python_units
from sentrel.operators.blueprints import attach_blueprints, blueprints
from sentrel.operators.corpus import dependency_inventory
from sentrel.operators.facts import collect_facts
from sentrel.operators.rollups import (
    agent_rollup,
    all_findings,
    check_counts,
    findings_digest,
    severity_counts,
    verification_summary,
)
from sentrel.operators.routes import business_logic, logic_findings, windows_of
from sentrel.operators.scan import audit_agent
from sentrel.operators.supply import audit_supply_chain, dep_requested_by
from sentrel.operators.taint import flow_counts, taint_findings, taint_flows
from sentrel.operators.verdicts import (
    annotated,
    expected_usage,
    merge_verification,
    static_verdicts,
    valued_findings,
    verify_candidates,
)
from sentrel.session import stored

SCHEMA_VERSION = "1.0"


@dataclass
class Audit:
    """The tables of one audit; ``report`` is a single row built from aggregates."""

    findings: DataFrame
    tables: dict[str, DataFrame]


def collect_findings(
    files: DataFrame,
    rules: DataFrame | Iterable[Rule] = CHECKS,
    with_taint: bool = True,
    with_logic: bool = True,
    labels: LabelTables = DEFAULT_LABELS,
    facts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The bag union of every analysis, and the flows behind the taint findings.

    Texts are read twice, by the facts and by the line scan; manifests once more.
    """
    facts = collect_facts(files, labels) if facts is None else facts
    parts = [audit_agent(files, rules, facts=facts), audit_supply_chain(files)]
    flows = None
    if with_taint:
        flows = stored(taint_flows(files, labels, facts=facts), "flows")
        parts.append(taint_findings(flows))
    if with_logic:
        parts += [logic_findings(files, windows_of(facts)), business_logic(files, facts)]
    return all_findings(*parts), flows


def audit(
    files: DataFrame,
    rules: DataFrame | Iterable[Rule] = CHECKS,
    with_taint: bool = True,
    with_logic: bool = True,
    with_blueprints: bool = True,
    with_behaviour: bool = True,
    with_verdicts: bool = True,
    policy: str = "strict",
    verify_limit: int | None = None,
    labels: LabelTables = DEFAULT_LABELS,
) -> Audit:
    """Run the analyses, annotate their findings and roll them up.

    All findings get a verdict unless ``verify_limit`` asks for the first ones only. Blueprints need the taint and route
    findings, so asking for them runs both. The facts of the files and the findings are stored once; every annotation
    and roll-up reads these tables.
    """
    if with_blueprints:
        with_taint = with_logic = True
    facts = collect_facts(files, labels)
    findings, flows = collect_findings(files, rules, with_taint, with_logic, labels, facts)
    findings = stored(findings, "findings")
    if with_blueprints:
        plans = blueprints(findings)
        findings = attach_blueprints(findings, plans)
    tables: dict[str, DataFrame] = {}
    if verify_limit is None or not with_verdicts:
        merged = annotated(findings, facts if with_verdicts else None, with_behaviour)
    else:
        verdicts = static_verdicts(verify_candidates(findings, verify_limit), files, facts)
        merged = merge_verification(findings, expected_usage(findings) if with_behaviour else None, verdicts)
    if with_behaviour or with_verdicts:
        merged = stored(merged, "merged")
        valued = valued_findings(merged, policy)
        tables["valued_findings"] = valued
        truncated = verify_limit is not None and with_verdicts and findings.count() > verify_limit
        tables["verification"] = verification_summary(merged, valued, policy, truncated)
    unparsed = facts.filter("language = 'python' and not parsed").select("repo", "path")
    tables.update(
        findings=merged,
        severity_counts=severity_counts(findings),
        check_counts=check_counts(findings, rules),
        agents=agent_rollup(findings, files, rules, unparsed),
        supply_chain=dep_requested_by(files, rules),
        dependency_files=dependency_inventory(files),
        digest=findings_digest(findings),
    )
    if with_blueprints:
        tables["blueprints"] = plans
    if flows is not None:
        tables["flow_counts"] = flow_counts(flows)
    if with_logic:
        counted = F.coalesce(F.sum(F.size("windows")), F.lit(0)).cast("long")
        tables["routes"] = facts.filter("windows is not null").agg(counted.alias("checked_routes"))
    tables["report"] = report_row(tables)
    return Audit(merged, tables)


def unparsed_files(files: DataFrame) -> DataFrame:
    """``repo, path`` of the Python files that do not parse."""
    python = files.filter(F.col("language") == "python")
    told = python.select("repo", "path", python_units(F.col("text"))["parsed"].alias("parsed"))
    return told.filter("not parsed").select("repo", "path")


def report_row(tables: dict[str, DataFrame]) -> DataFrame:
    """The summary document: one row over the bounded roll-ups, not over the findings."""
    now = dt.datetime.now(dt.UTC)
    counts = tables["severity_counts"].agg(
        F.coalesce(F.sum("findings"), F.lit(0)).alias("total_findings"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "findings")))).alias("severity_counts"),
    )
    agents = tables["agents"].agg(
        F.array_sort(
            F.collect_list(F.struct("agent", "display_name", "finding_count", "dependency_files", "sub_agents", "failed_sub_agents", "status"))
        ).alias("agents"),
        F.min(F.col("status") == "completed").alias("all_completed"),
        F.array_sort(F.array_compact(F.collect_list(F.when(F.col("status") != "completed", F.col("display_name"))))).alias("failed_agents"),
    )
    row = counts.crossJoin(F.broadcast(agents))
    for name in ("verification", "flow_counts", "routes"):
        if name in tables:
            one = tables[name]
            row = row.crossJoin(F.broadcast(one.select(F.struct(*one.columns).alias(name))))
    return row.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(now.strftime("%Y%m%dT%H%M%SZ")).alias("audit_id"),
        F.lit(now.isoformat()).alias("generated_at"),
        F.when(F.col("all_completed"), "completed").otherwise("completed_with_errors").alias("status"),
        *[c for c in row.columns if c != "all_completed"],
    )


__all__ = ["AGENTS", "Audit", "audit", "collect_findings", "report_row"]
