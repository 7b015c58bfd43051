"""The rule scan: every line against every check, plus file names and code events."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS, DEFAULT_CONFIDENCE, DEFAULT_REMEDIATION, DEFAULT_SEVERITY, Rule
from sentrel.functions.labels import let
from sentrel.functions.masks import has_bit, line_masks, literal_regex
from sentrel.functions.parsing import code_events
from sentrel.functions.prefilter import line_gate, may_match
from sentrel.functions.rows import explode_once, inline_once, settle
from sentrel.functions.text import SNIPPET_CHARS, base_name, finding_id, redact, split_lines
from sentrel.operators.corpus import explode_lines
from sentrel.operators.dictionary import pattern_join
from sentrel.session import stored
from sentrel.sources.rules import rules_frame, to_rules, usable_patterns

TAINT_STEP = "struct<file:string,line:int,variable:string,operation:string>"
FLOW_EVIDENCE = (
    "struct<source:struct<file:string,line:int,kind:string>,"
    "sink:struct<file:string,line:int,kind:string,function:string>,sanitized:boolean,sanitizer:string>"
)
SNIPPET = SNIPPET_CHARS
PLAN_PATTERNS = 200  # more are joined as a table
ROUTE_EVIDENCE = (
    "struct<check:string,route:string,method:string,framework:string,parameter:string,query_line:int,"
    "auth_signals:array<string>>"
)
FINDING_COLUMNS = (
    "id", "check_id", "category", "agent", "sub_agent", "severity", "confidence", "repo", "file", "line",
    "snippet", "rule", "rule_id", "description", "remediation", "taint_path", "poc_payload", "flow_evidence",
    "route_evidence",
)


def as_findings(df: DataFrame) -> DataFrame:
    """Put columns in finding order; the optional ones become null (the path: empty)."""
    optional = {
        "taint_path": F.array().cast(f"array<{TAINT_STEP}>"),
        "poc_payload": F.lit(None).cast("string"),
        "flow_evidence": F.lit(None).cast(FLOW_EVIDENCE),
        "route_evidence": F.lit(None).cast(ROUTE_EVIDENCE),
    }
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else optional[c].alias(c) for c in FINDING_COLUMNS])


def _first_match(line: Column, may: Callable[[str], Column], rule: Rule) -> Column | None:
    """The first pattern of the rule found in the line, else null; ``may`` is a cheap test of a pattern."""
    chain: Column | None = None
    for pattern in rule.patterns:
        found = may(pattern) & line.rlike(pattern)
        chain = F.when(found, F.lit(pattern)) if chain is None else chain.when(found, F.lit(pattern))
    if chain is not None and rule.exclude_patterns:
        excluded = line.rlike(rule.exclude_patterns[0])
        for pattern in rule.exclude_patterns[1:]:
            excluded = excluded | line.rlike(pattern)
        chain = F.when(chain.isNotNull() & ~excluded, chain)
    return chain


def checked_rules(df: DataFrame, rules: DataFrame | Iterable[Rule]) -> list[Rule]:
    """Line rules with the patterns that compile; those of all rules are tried in one job."""
    line_rules = [rule for rule in to_rules(rules) if rule.kind != "filename"]
    every = dict.fromkeys(p for rule in line_rules for p in (*rule.patterns, *rule.exclude_patterns))
    usable = set(usable_patterns(df.sparkSession, every))
    kept = lambda patterns: tuple(p for p in patterns if p in usable)
    return [
        Rule(**{**rule.__dict__, "patterns": kept(rule.patterns), "exclude_patterns": kept(rule.exclude_patterns)})
        for rule in line_rules
    ]


def pattern_scan(lines: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS, joined: bool | None = None) -> DataFrame:
    """``(repo, path, line_no, line, check_id, rule)``: one row per line and matching check.

    ``rule`` is the first matching pattern in list order. The patterns are literals of one
    projection, so each is compiled once and the scan needs no join and no shuffle. When
    the lines carry an ``events`` array (see ``audit_lines``) the last wanted code event of
    the line outranks the pattern, for checks that look at code events.

    With more than ``PLAN_PATTERNS`` patterns, or as ``joined`` says, lines meet the patterns through a table of literals
    (see ``pattern_join``) and the plan does not grow with the rules; the rows are the same.
    """
    rule_list = checked_rules(lines, rules)
    if joined is None:
        joined = _too_many(rule_list)
    if joined:
        return pattern_join(lines, rule_list)
    gate = line_gate(F.col("lowered"), [pattern for rule in rule_list for pattern in rule.patterns])
    watched = "events" in lines.columns
    if watched:
        gate = gate | (F.size("events") > 0)
    lowered = lines.withColumn("lowered", F.lower("line"))
    row = F.struct("line", "lowered", *(["events", "line_no"] if watched else []))
    hits = let(row, lambda r: _hits(r, lambda pattern: may_match(r["lowered"], pattern), rule_list, watched))
    return inline_once(lowered, "repo", "path", "line_no", "line", structs=F.when(gate, hits))


def file_scan(files: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS) -> DataFrame:
    """``pattern_scan`` of all lines of the files. A line that no pattern can match never becomes a row."""
    rule_list = checked_rules(files, rules)
    patterns = list(dict.fromkeys(pattern for rule in rule_list for pattern in rule.patterns))
    first, each = literal_regex(patterns), [literal_regex([pattern]) for pattern in patterns]
    if first is None or _too_many(rule_list):
        return pattern_scan(explode_lines(files), rule_list)
    split = settle(files, "repo", "path", lines=split_lines(F.col("text")))
    masked = split.withColumn("masks", line_masks(F.col("lines"), each, first))
    line = lambda text, i: F.when(
        F.get("masks", i) != 0, F.struct((i + 1).alias("line_no"), text.alias("line"), F.get("masks", i).alias("mask"))
    )
    lines = inline_once(masked, "repo", "path", structs=F.array_compact(F.transform("lines", line)))
    may = lambda mask: lambda pattern: has_bit(mask, patterns.index(pattern))
    hits = let(F.struct("line", "mask"), lambda r: _hits(r, may(r["mask"]), rule_list, False))
    return inline_once(lines, "repo", "path", "line_no", "line", structs=hits)


def _too_many(rules: Sequence[Rule]) -> bool:
    return sum(len(rule.patterns) for rule in rules) > PLAN_PATTERNS


def _hits(row: Column, may: Callable[[str], Column], rules: Iterable[Rule], watched: bool) -> Column:
    """``check_id`` and ``rule`` of each check that a line matches; ``row`` has ``line``, and if watched ``events`` and ``line_no``.

    Inside a lambda: as plain code of the projection, so many patterns make a method too long for the JVM to compile.
    """
    hits = []
    for rule in rules:
        found = _first_match(row["line"], may, rule)
        if rule.kind == "ast_or_regex" and watched:
            here = _wanted(F.filter(row["events"], lambda e: e["line_no"] == row["line_no"]), rule)
            event = F.try_element_at(here, F.lit(-1))["message"]
            found = event if found is None else F.coalesce(event, found)
        if found is not None:
            hits.append(F.struct(F.lit(rule.check_id).alias("check_id"), found.alias("rule")))
    if not hits:
        hits = [F.struct(F.lit("").alias("check_id"), F.lit(None).cast("string").alias("rule"))]
    return F.filter(F.array(*hits), lambda h: h["rule"].isNotNull())


def _wanted(events: Column, rule: Rule) -> Column:
    """Events a rule asks for; a rule without a list takes all."""
    if not rule.code_events:
        return events
    return F.filter(events, lambda e: e["message"].isin(*rule.code_events))


def audit_lines(files: DataFrame) -> DataFrame:
    """Lines that carry the code events of their file (an empty array for most files).

    Keeping the events on the row lets the rule scan prefer them without a join.
    """
    events = code_events("text", where=F.endswith("path", F.lit(".py"))).alias("events")
    # A projection of its own: in one select with the explode it would run once per line.
    parsed = files.select("repo", "path", "text", events)
    return parsed.select("repo", "path", "events", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select(
        "repo", "path", "events", (F.col("pos") + 1).alias("line_no"), "line"
    )


def filename_scan(files: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS) -> DataFrame:
    """One row at line 1 when the base name equals, or the path ends with, a listed name.

    The text of the finding is the path itself.
    """
    path = F.lower("path")
    hits = []
    for rule in to_rules(rules):
        if rule.kind != "filename" or not rule.filenames:
            continue
        test = F.lit(False)
        for name in rule.filenames:
            test = test | (base_name(path) == name.lower()) | F.endswith(path, F.lit(name.lower()))
        hits.append(F.when(test, F.struct(F.lit(rule.check_id).alias("check_id"), F.lit(rule.rule_id).alias("rule"))))
    if not hits:
        hits = [F.lit(None).cast("struct<check_id:string,rule:string>")]
    return explode_once(files, "repo", "path", hit=F.array(*hits)).select(
        "repo", "path", F.lit(1).alias("line_no"), F.col("path").alias("line"), "hit.check_id", "hit.rule"
    )


def _event_hits(rule: Rule, line: Callable[[Column], Column]) -> Column:
    """The wanted events of one rule with the text of their line."""
    return F.transform(
        _wanted(F.col("events"), rule),
        lambda e: F.struct(
            F.lit(rule.check_id).alias("check_id"),
            e["line_no"].alias("line_no"),
            line(e).alias("line"),
            e["seq"].alias("seq"),
            e["message"].alias("rule"),
        ),
    )


def code_event_scan(files: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS) -> DataFrame:
    """Dangerous calls in Python files, for rules of kind ``ast_or_regex``.

    A rule with an event list keeps those events, without one it keeps all. The last
    wanted event of a line wins. Files that do not parse give no events.
    """
    python = files.filter(F.endswith("path", F.lit(".py"))).select("repo", "path", "text", code_events("text").alias("events"))
    found = settle(python, "repo", "path", "events", text_lines=split_lines(F.col("text")))
    hits = [F.array().cast("array<struct<check_id:string,line_no:int,line:string,seq:int,rule:string>>")]
    text_of = lambda e: F.try_element_at("text_lines", e["line_no"])
    hits += [_event_hits(rule, text_of) for rule in to_rules(rules) if rule.kind == "ast_or_regex"]
    rows = inline_once(found, "repo", "path", structs=F.concat(*hits))
    return (
        rows.groupBy("repo", "path", "line_no", "line", "check_id")
        .agg(F.max_by("rule", "seq").alias("rule"))
        .select("repo", "path", "line_no", "line", "check_id", "rule")
    )


def dedupe_findings(matches: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """At most one row per check, file and line; a code event outranks a pattern."""
    ranked = matches.withColumn("rank", F.lit(0))
    if events is not None:
        ranked = ranked.unionByName(events.withColumn("rank", F.lit(1)))
    return (
        ranked.groupBy("repo", "path", "line_no", "check_id")
        .agg(F.max(F.struct("rank", "line", "rule")).alias("best"))
        .select("repo", "path", "line_no", "best.line", "check_id", "best.rule")
    )


def project_finding(matches: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS) -> DataFrame:
    """Fill finding rows from the rule: defaults, ids, redacted snippet."""
    spark = matches.sparkSession
    small = F.broadcast(rules_frame(spark, to_rules(rules)).drop("patterns", "exclude_patterns", "filenames", "code_events"))
    joined = matches.join(small, "check_id")
    return as_findings(
        joined.select(
            finding_id(
                F.concat(F.lit("SAST-"), F.col("check_id"), F.lit("-")),
                F.col("check_id"), F.col("path"), F.col("line_no"), F.col("line"),
            ).alias("id"),
            "check_id",
            F.col("name").alias("category"),
            "agent",
            F.concat_ws(".", "agent", "check_id").alias("sub_agent"),
            F.coalesce("severity", F.lit(DEFAULT_SEVERITY)).alias("severity"),
            F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
            "repo",
            F.col("path").alias("file"),
            F.col("line_no").alias("line"),
            redact(F.col("line")).alias("snippet"),
            "rule",
            "rule_id",
            F.coalesce("description", F.lit("")).alias("description"),
            F.coalesce("remediation", F.lit(DEFAULT_REMEDIATION)).alias("remediation"),
        )
    )


def fact_event_hits(facts: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The wanted code events of stored facts as matches, the last one of each line and check."""
    hits = [F.array().cast("array<struct<check_id:string,line_no:int,line:string,seq:int,rule:string>>")]
    hits += [_event_hits(rule, lambda e: e["line"]) for rule in rules if rule.kind == "ast_or_regex"]
    rows = inline_once(facts.filter(F.size("events") > 0), "repo", "path", structs=F.concat(*hits))
    last = rows.groupBy("repo", "path", "line_no", "line", "check_id").agg(F.max_by("rule", "seq").alias("rule"))
    return last.select("repo", "path", "line_no", "line", "check_id", "rule")


def audit_agent(
    files: DataFrame,
    rules: DataFrame | Iterable[Rule] = CHECKS,
    agent: str | None = None,
    ids: Sequence[str] | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Findings of all checks, of one agent, or of the ids given (see ``select_checks``).

    With ``facts`` no text is parsed: their code events replace matches of the same check and line.
    """
    chosen = [
        rule
        for rule in to_rules(rules)
        if (not ids or rule.check_id in ids) and (agent is None or rule.agent == agent)
    ]
    watched = [rule.check_id for rule in chosen if rule.kind == "ast_or_regex"]
    if not watched:
        matches = file_scan(files, chosen)
    elif facts is None:
        matches = pattern_scan(audit_lines(files), chosen)
    else:
        hits = stored(file_scan(files, chosen), "hits")
        events = stored(fact_event_hits(facts, chosen), "event-hits")
        key = ["repo", "path", "line_no", "check_id"]
        both = hits.filter(F.col("check_id").isin(*watched)).join(events.select(*key), key, "left_anti")
        matches = hits.filter(~F.col("check_id").isin(*watched)).unionByName(both).unionByName(events)
    return project_finding(matches.unionByName(filename_scan(files, chosen)), chosen)
