"""Rule catalogues: built-in, from JSON, from rows, and selections of them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import astuple, fields

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS, Rule

RULE_SCHEMA = (
    "check_id string, name string, agent string, kind string, rule_id string, severity string, confidence string,"
    " description string, remediation string, patterns array<string>, exclude_patterns array<string>,"
    " filenames array<string>, code_events array<string>"
)
# A rule set is held by the driver and broadcast, so its size has a bound.
MAX_RULES = 5000


def rules_frame(spark: SparkSession, rules: Iterable[Rule] = CHECKS) -> DataFrame:
    return spark.createDataFrame([astuple(rule) for rule in rules], RULE_SCHEMA)


def load_rules(spark: SparkSession, source: str | Iterable[Rule] | None = None) -> DataFrame:
    """Rules as rows keyed by a string id: the built-in set, given rows, or a JSON file.

    The JSON form is ``{"checks": [{id, name, agent, description, default_rule: {...}}]}``.
    A later row with the same id replaces an earlier one.
    """
    if source is None:
        return rules_frame(spark)
    if not isinstance(source, str):
        return rules_frame(spark, {rule.check_id: rule for rule in source}.values())
    schema = (
        "checks array<struct<id string, name string, agent string, description string, default_rule struct<"
        "rule_id string, kind string, severity string, confidence string, remediation string,"
        "patterns array<string>, exclude_patterns array<string>, filenames array<string>, ast_events array<string>>>>"
    )
    check = spark.read.schema(schema).json(source, multiLine=True).select(F.posexplode("checks").alias("at", "c"))
    rule = F.col("c.default_rule")

    def listed(name: str) -> F.Column:
        return F.coalesce(rule[name], F.array().cast("array<string>")).alias(
            "code_events" if name == "ast_events" else name
        )

    rows = check.select(
        "at",
        F.col("c.id").alias("check_id"),
        F.col("c.name").alias("name"),
        F.col("c.agent").alias("agent"),
        rule["kind"].alias("kind"),
        F.coalesce(rule["rule_id"], F.lit("configured-rule")).alias("rule_id"),
        rule["severity"].alias("severity"),
        rule["confidence"].alias("confidence"),
        F.coalesce("c.description", F.lit("")).alias("description"),
        rule["remediation"].alias("remediation"),
        *[listed(n) for n in ("patterns", "exclude_patterns", "filenames", "ast_events")],
    )
    columns = [c for c in rows.columns if c != "at"]
    last = rows.groupBy("check_id").agg(F.max_by(F.struct(*columns), "at").alias("r"))
    return last.select("r.*")


def select_checks(rules: DataFrame, agent: str | None = None, ids: Sequence[str] | None = None) -> DataFrame:
    """Checks of an agent, or the ids given.

    An empty id list means all checks of the agent. Unknown ids are ignored. When both
    are given a check has to belong to the agent.
    """
    if ids:
        rules = rules.filter(F.col("check_id").isin(*ids))
    if agent is not None:
        rules = rules.filter(F.col("agent") == agent)
    return rules


def to_rules(rules: DataFrame | Iterable[Rule]) -> list[Rule]:
    """Rules on the driver, in id order."""
    if not isinstance(rules, DataFrame):
        return sorted(rules, key=lambda r: r.check_id)
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule set may hold at most {MAX_RULES} checks")
    names = [f.name for f in fields(Rule)]
    lists = {"patterns", "exclude_patterns", "filenames", "code_events"}
    made = [Rule(**{n: tuple(row[n] or ()) if n in lists else row[n] for n in names}) for row in rows]
    return sorted(made, key=lambda r: r.check_id)


def usable_patterns(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """Patterns that compile; a malformed one is skipped rather than failing the audit.

    All are tried in Spark too, whose dialect differs, in one select on a constant; only if that fails are halves tried.
    """
    good = []
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error:
            continue
        good.append(pattern)
    return _compiling(spark, good)


def rejected_patterns(spark: SparkSession, patterns: Iterable[str]) -> DataFrame:
    """The patterns that ``usable_patterns`` leaves out, a row each."""
    given = list(patterns)
    usable = set(usable_patterns(spark, given))
    return spark.createDataFrame([(p,) for p in given if p not in usable], "pattern string")


def _compiling(spark: SparkSession, patterns: list[str]) -> list[str]:
    if not patterns:
        return []
    try:
        spark.range(1).select(*(F.lit("").rlike(p).alias(str(i)) for i, p in enumerate(patterns))).collect()
        return patterns
    except PySparkException:
        half = len(patterns) // 2
        return _compiling(spark, patterns[:half]) + _compiling(spark, patterns[half:]) if half else []
