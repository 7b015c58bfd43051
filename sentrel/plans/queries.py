"""One query per operator, each over whole tables of a data folder.

Nested columns are shown as joined text so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS, Rule
from sentrel.fixtures import SKELETONS, files_from_documents, fixture_files
from sentrel.functions.labels import LabelTables
from sentrel.functions.text import base_name, finding_id, redact, split_lines, strip_code
from sentrel.operators import blueprints as bp
from sentrel.operators import corpus, rollups, routes, scan, structure, supply, taint, verdicts
from sentrel.operators.facts import collect_facts
from sentrel.plans.audit import audit, collect_findings, unparsed_files
from sentrel.session import cut_lineage, shared_folder, stored
from sentrel.sources import evidence, report, rules, tables, tree
from sentrel.streaming import changes
from sentrel.streaming import scan as streaming

Query = Callable[[SparkSession, str], DataFrame]
FINDING = [
    "repo", "id", "check_id", "category", "agent", "sub_agent", "severity", "confidence", "file", "line", "snippet",
    "rule", "rule_id", "description", "remediation",
]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def over_files(name: str, body: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: body(fixture_files(spark, sf))


def over_lines(name: str, body: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: body(corpus.explode_lines(fixture_files(spark, sf)))


def joined(column: str | Column, mark: str = "|") -> Column:
    return F.array_join(column, mark)


# --- Scans and sources ---------------------------------------------------------


@query
def scan_table(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = tables.corpus_from_table(documents, path, "text", F.coalesce("source", F.lit("unknown")))
    return files.select("repo", "path", "size", F.size(split_lines(F.col("text"))).alias("n_lines"))


def _write_tree(files: DataFrame, root: str) -> None:
    """Write the corpus as real files, by the tasks that hold it (tests and demos only)."""

    opener = tree.open_filesystem

    def write(rows):
        for row in rows:
            system, target = opener(f"{root}/{row.path}")
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target) as handle:
                handle.write(row.text.encode())

    files.select("path", "text").foreachPartition(write)


@query
def scan_corpus(spark, sf):
    root = shared_folder(spark, "tree")
    _write_tree(fixture_files(spark, sf), root)
    return tree.scan_corpus(spark, root).select("path", "size", F.size(split_lines(F.col("text"))).alias("n_lines"))


@query
def scan_patches(spark, sf):
    """Every file as a patch with removed and added lines, beside originals that the glob leaves out."""
    root = shared_folder(spark, "patches")
    files = fixture_files(spark, sf).withColumn("number", F.regexp_extract("path", r"_(\d+)", 1))
    marked = F.transform(split_lines(F.col("text")), lambda line, i: F.concat(F.when(i % 2 == 0, "-").otherwise("+"), line))
    head = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1 +1 @@\n"))
    patch = F.struct(F.concat(F.lit("patch_"), "number", F.lit(".patch")).alias("path"), F.concat(head, F.array_join(marked, "\n")).alias("text"))
    original = F.struct(F.concat(F.lit("patch_"), "number", F.lit(".orig")).alias("path"), F.col("text"))
    _write_tree(files.select(F.inline(F.array(patch, original))), root)
    found = tree.scan_patches(spark, root, "*.patch")
    hits = scan.pattern_scan(corpus.explode_lines(found)).groupBy("path").agg(F.count("*").alias("hits"))
    return found.join(hits, "path", "left").select("path", "size", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


@query
def load_rules(spark, sf):
    hits = scan.pattern_scan(corpus.explode_lines(fixture_files(spark, sf))).groupBy("check_id").agg(F.count("*").alias("n"))
    shown = ["check_id", "name", "agent", "kind", "rule_id", "severity", "confidence", "description", "remediation"]
    loaded = rules.load_rules(spark).select(*shown)
    return loaded.join(hits, "check_id", "left").select(*shown, F.coalesce("n", F.lit(0)).cast("long").alias("hits"))


@query
def evidence_scan(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    other = F.concat(F.lit("ftp"), F.regexp_replace("url", "^[^:]*", ""))
    mixed = pages.withColumn("url", F.when(F.col("page_id") % 10 == 0, other).otherwise(F.col("url")))
    whole = evidence.evidence_scan(mixed).select("page_id", F.md5(F.col("text").cast("binary")).alias("whole_md5"))
    cut = evidence.evidence_scan(mixed, max_bytes=4096)
    shown = cut.select("page_id", "url", "scheme", "error", "truncated", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return shown.join(whole, "page_id")


@query
def write_report(spark, sf):
    """The findings as Parquet by agent and their counts as JSON documents with sorted keys, both read back."""
    out = shared_folder(spark, "report")
    findings = scan.audit_agent(fixture_files(spark, sf))
    counts = lambda df: df.groupBy("agent").agg(F.count("*").alias("findings"), F.count_distinct("file").alias("files"))
    written = report.write_report({"findings": findings}, out)
    read = counts(spark.read.parquet(written["findings"]))
    written = report.write_report({"agent_counts": read}, out)
    documents = spark.read.text(written["agent_counts"]).withColumnRenamed("value", "document")
    return read.join(documents.withColumn("agent", F.get_json_object("document", "$.agent")), "agent")


# --- Projections and filters ---------------------------------------------------


over_files("dependency_inventory", corpus.dependency_inventory)
over_files("explode_lines", corpus.explode_lines)
over_files(
    "path_features",
    lambda f: corpus.path_features(f).select("repo", "path", "base_name", "suffix", joined("segments").alias("segments")),
)
over_files("detect_language", lambda f: corpus.with_language(f).select("repo", "path", "language"))


@query
def filter_paths(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    files = files_from_documents(documents)
    number = F.regexp_extract("path", r"_(\d+)", 1).cast("long") % 5
    path = F.when(number == 0, F.concat(F.lit("node_modules/"), "path")).when(number == 1, F.concat(F.lit("lib/.git/"), "path"))
    return corpus.filter_paths(files.withColumn("path", F.coalesce(path, "path"))).select("repo", "path")


over_lines("redact", lambda d: d.select("repo", "path", "line_no", redact(F.col("line")).alias("snippet")))
over_lines(
    "finding_ids",
    lambda d: d.select("path", "line_no", finding_id("LINE-", F.col("path"), F.col("line_no"), F.col("line")).alias("id")),
)
over_files("project_finding", lambda f: scan.audit_agent(f).select(*FINDING))


@query
def select_checks(spark, sf):
    chosen = rules.select_checks(rules.load_rules(spark), "secrets", ["01", "09", "99"])
    return scan.audit_agent(fixture_files(spark, sf), chosen).select(*FINDING)


over_files(
    "strip_code",
    lambda f: f.filter(F.col("language").isin("javascript", "typescript", "php")).select(
        "repo", "path", strip_code(F.col("text"), F.col("language")).alias("code")
    ),
)

# --- Rule scans ----------------------------------------------------------------

MATCH = ["repo", "path", "line_no", "check_id", "rule"]
over_lines("pattern_scan", lambda d: scan.pattern_scan(d).select(*MATCH))
over_lines("pattern_join", lambda d: scan.pattern_scan(d, joined=True).select(*MATCH))


@query
def pattern_scan_exclude(spark, sf):
    rule = Rule(
        "X1", "Passwords", "secrets", "regex", "password-word", "low", "low", "A password word.", None,
        patterns=("(unclosed", "(?i)password"), exclude_patterns=("(?i)changeme", "(?i)admin"),
    )
    return scan.pattern_scan(corpus.explode_lines(fixture_files(spark, sf)), [rule]).select(*MATCH)


over_files("filename_scan", lambda f: scan.filename_scan(f).select(*MATCH))
over_files("code_event_scan", lambda f: scan.code_event_scan(f).select(*MATCH))
over_files(
    "dedupe_findings",
    lambda f: scan.dedupe_findings(scan.pattern_scan(corpus.explode_lines(f)), scan.code_event_scan(f)).select(*MATCH),
)
over_files("audit_agent", lambda f: scan.audit_agent(f, agent="injection").select(*FINDING))

# --- Manifests -----------------------------------------------------------------

over_lines("dep_unpinned", lambda d: supply.dep_unpinned(d).drop("rule"))
over_lines("dep_install_hook", lambda d: supply.dep_install_hook(d).drop("rule"))
over_files("dep_scripts", lambda f: supply.dep_scripts(f).drop("rule"))
over_files("dep_requested_by", lambda f: supply.dep_requested_by(f).select("repo", joined("requested_by", ",").alias("requested_by")))
over_files("audit_supply_chain", lambda f: supply.audit_supply_chain(f).select(*FINDING))

# --- Structure -----------------------------------------------------------------


def _functions(files: DataFrame) -> DataFrame:
    lists = [joined(c).alias(c) for c in ("params", "calls", "decorators")]
    return structure.extract_functions(files).select(
        "repo", "path", "qualname", "kind", "start_line", "end_line", "signature", *lists
    )


over_files("functions_py", lambda f: _functions(f.filter(F.col("language") == "python")))
over_files("functions_structural", lambda f: _functions(f.filter(F.col("language") != "python")))
over_files(
    "imports",
    lambda f: structure.extract_imports(f).select("repo", "path", "line_no", "text", joined("names").alias("names"), "side_effect"),
)
over_files("call_edges", lambda f: structure.call_edges(structure.extract_functions(f)).drop("callee_path"))
over_files(
    "callers",
    lambda f: structure.callers(structure.extract_functions(f)).select("repo", "path", "qualname", joined("callers").alias("callers")),
)


def _points(files: DataFrame) -> DataFrame:
    return scan.pattern_scan(corpus.explode_lines(files)).select("repo", "path", "line_no").distinct()


@query
def enclosing_function(spark, sf):
    files = fixture_files(spark, sf)
    # Both searches read the points, so the lines are scanned once.
    functions, points = cut_lineage(structure.extract_functions(files)), cut_lineage(_points(files))
    key = ["repo", "path", "line_no"]
    near = structure.enclosing_function(points, functions).select(*key, F.col("qualname").alias("narrowest"))
    late = structure.enclosing_function(points, functions, "latest").select(*key, F.col("qualname").alias("latest"))
    return near.join(late, key)


@query
def call_neighbourhood(spark, sf):
    functions = cut_lineage(structure.extract_functions(fixture_files(spark, sf)))
    return structure.call_neighbourhood(functions, structure.call_edges(functions))


@query
def keep_imports(spark, sf):
    parsed = structure.parse_files(fixture_files(spark, sf))
    body = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    slices = parsed.select("repo", "path", "lines", F.inline("functions")).select(
        "repo", "path", F.col("qualname").alias("slice_id"), body.alias("source")
    )
    return structure.keep_imports(slices, structure.imports_of(parsed))


@query
def code_slice(spark, sf):
    files = fixture_files(spark, sf)
    lists = ["callers", "callees", "functions_included", "functions_depth", "imports_kept"]
    return structure.code_slices(_points(files), files).select(
        "repo", "path", "line_no", "language", "target_function", "target_signature", "slice", "focus_start", "focus_end",
        *[joined(F.col(c).cast("array<string>")).alias(c) for c in lists],
    )


@query
def build_call_tree(spark, sf):
    # Sizes, callers and callees read the functions, so the texts are parsed once.
    parsed = stored(structure.parse_files(fixture_files(spark, sf)).select("repo", "path", "language", "functions", "imports"), "parsed")
    sizes = parsed.select(
        "repo", "path", "language", F.size("functions").cast("long").alias("functions"), F.size("imports").cast("long").alias("imports")
    )
    edges = (
        structure.call_edges(structure.functions_of(parsed))
        .groupBy("repo", F.col("caller_path").alias("path"))
        .agg(
            F.count_distinct("caller", "call_name").alias("calls"),
            F.count_distinct("caller", F.col("callee")).alias("edges"),
        )
    )
    zero = F.lit(0).cast("long")
    return sizes.join(edges, ["repo", "path"], "left").withColumns(
        {"calls": F.coalesce("calls", zero), "edges": F.coalesce("edges", zero)}
    )


# --- Taint ---------------------------------------------------------------------

over_lines("label_sources", taint.label_sources)
over_lines("label_sinks", taint.label_sinks)
over_lines("label_sanitizers", taint.label_sanitizers)
over_lines("assignments", taint.assignments)


@query
def call_sites(spark, sf):
    lines = corpus.with_language(corpus.explode_lines(fixture_files(spark, sf)))
    return taint.call_sites(lines.filter(F.col("language").isNotNull())).withColumn("args", joined("args"))


FLOW = [
    "source_file", "source_line", "source_kind", "sink_file", "sink_line", "sink_kind", "value", "sanitized", "sanitizer",
    "sink_function",
]


def _path_text(path: str = "taint_path") -> Column:
    steps = F.transform(path, lambda s: F.concat_ws(" ", s["operation"], s["variable"], s["line"].cast("string")))
    return joined(steps, " > ").alias("taint_path")


over_files("taint_intra", lambda f: taint.taint_intra(f).filter(F.col("depth") == 0).select(*FLOW, _path_text()))
over_files("taint_inter", lambda f: taint.taint_inter(f).select(*FLOW, _path_text()))
over_files("taint_flows", lambda f: taint.taint_flows(f).select(*FLOW, _path_text()))
over_files("taint_findings", lambda f: taint.taint_findings(taint.taint_flows(f)).select(*FINDING, _path_text()))
over_files("taint_counts", lambda f: taint.flow_counts(taint.taint_flows(f)))
over_files(
    "trace_dataflow",
    lambda f: taint.trace_dataflow(f, "src/flow_23.py", "run_23").select(
        "source_file", "source_line", "sink_file", "sink_line", "sink_function", _path_text()
    ),
)
over_lines(
    "custom_labels",
    lambda d: taint.label_sources(d, LabelTables(sources=((r"(?i)jwt\.encode", "token maker"),))).select("path", "line_no", "matched"),
)

# --- Routes --------------------------------------------------------------------

over_files("routes", lambda f: routes.routes(f).withColumn("params", joined("params")))
over_files(
    "handler_windows",
    lambda f: routes.handler_windows(f).select("repo", "path", "line_no", "framework", "body_start", "window_start", "window_end"),
)
over_files(
    "auth_signals",
    lambda f: routes.auth_signals(routes.handler_windows(f)).select("repo", "path", "line_no", joined("signals").alias("signals"), "protected"),
)
over_files(
    "ownership_signal",
    lambda f: routes.ownership_signal(routes.handler_windows(f)).select("repo", "path", "line_no", "ownership"),
)
over_files(
    "param_queries",
    lambda f: routes.param_queries(routes.handler_windows(f)).select(
        "repo", "path", "line_no", "parameter", "query_line", "query_text",
        joined(F.transform("taint_path", lambda s: F.concat_ws(" ", s["operation"], s["line"].cast("string")))).alias("steps"),
    ),
)


def _with_route(findings: DataFrame) -> DataFrame:
    e = "route_evidence."
    return findings.select(
        *FINDING, e + "route", e + "method", e + "framework", e + "parameter", e + "query_line", joined(e + "auth_signals").alias("auth_signals")
    )


over_files("missing_authorization", lambda f: _with_route(routes.missing_authorization(f)))
over_files("idor", lambda f: _with_route(routes.idor(f)))
over_files("checked_routes", routes.checked_routes)
over_files("sensitive_route", lambda f: routes.sensitive_route(f).select(*FINDING))
over_files("client_value", lambda f: routes.client_value(f).select(*FINDING))
over_files("business_logic_report", routes.business_logic_report)

# --- Blueprints, verdicts ------------------------------------------------------


def _research(files: DataFrame) -> DataFrame:
    return taint.taint_findings(taint.taint_flows(files)).unionByName(routes.logic_findings(files))


def _all(files: DataFrame, facts: DataFrame) -> DataFrame:
    return stored(collect_findings(files, facts=facts)[0], "findings")


over_files("blueprint_text", lambda f: bp.blueprint_text(_research(f)).select("repo", "id", "file", "line", "poc_payload"))
over_files(
    "blueprints",
    lambda f: bp.blueprints(_research(f)).select(
        "repo", "id", "source_finding_id", "check_id", "title", "file", "line", F.md5("poc_payload").alias("poc_md5"),
        F.col("request_template.method").alias("template_method"), F.col("request_template.path").alias("template_path"),
    ),
)


def over_findings(name: str, body: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    """``body`` takes the findings, the files and the facts that the findings come from."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        files = fixture_files(spark, sf)
        facts = collect_facts(files)
        return body(_all(files, facts), files, facts)

    QUERIES[name] = run


MERGED = ["repo", "id", "check_id", "severity", "file", "line", "rule", "behavior", "behavior_rationale", "verification_verdict"]


def _merged(findings: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    return verdicts.merge_verification(findings, verdicts.expected_usage(findings), verdicts.static_verdicts(findings, files, facts))


def _valued(findings: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    merged = cut_lineage(_merged(findings, files, facts))
    both = [verdicts.valued_findings(merged, p).select(*MERGED, F.lit(p).alias("policy")) for p in ("strict", "lenient")]
    return both[0].unionByName(both[1])


def _summary(findings: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    merged = cut_lineage(_merged(findings, files, facts))
    return rollups.verification_summary(merged, verdicts.valued_findings(merged))


over_findings(
    "attach_blueprints",
    lambda d, f, facts: bp.attach_blueprints(d, bp.blueprints(d)).select("repo", "id", "rule", "file", "line", "poc_payload"),
)
over_findings("expected_usage", lambda d, f, facts: verdicts.expected_usage(d))
over_findings("behaviour_counts", lambda d, f, facts: verdicts.behaviour_counts(verdicts.expected_usage(d)))
over_findings("static_verdicts", lambda d, f, facts: verdicts.static_verdicts(d, f, facts).drop("reason"))
over_findings(
    "verify_candidates",
    lambda d, f, facts: verdicts.verify_candidates(d).select("repo", "id", "check_id", "severity", "file", "line"),
)
over_findings("verdict_counts", lambda d, f, facts: verdicts.verdict_counts(verdicts.static_verdicts(d, f, facts)))
over_findings("merge_verification", lambda d, f, facts: _merged(d, f, facts).select(*MERGED))
over_findings("valued_findings", _valued)

# --- Roll-ups and reports ------------------------------------------------------

over_findings("all_findings", lambda d, f, facts: d.select(*FINDING))
over_findings("severity_counts", lambda d, f, facts: rollups.severity_counts(d))
over_files("check_counts", lambda f: rollups.check_counts(scan.audit_agent(f)))
over_files(
    "agent_rollup",
    lambda f: rollups.agent_rollup(scan.audit_agent(f), f, unparsed=unparsed_files(f)).withColumns(
        {c: joined(c) for c in ("sub_agents", "failed_sub_agents")}
    ),
)
over_findings("verification_summary", _summary)
over_findings("findings_digest", lambda d, f, facts: rollups.findings_digest(d))


@query
def rule_lookup(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    found = scan.audit_agent(fixture_files(spark, sf)).select("check_id", F.explode(F.array(F.lit(None).cast("string"), F.lit("infra"))).alias("agent"))
    unknown = documents.select(F.concat(F.lit("unknown-"), (F.col("doc_id") % len(SKELETONS)).cast("string")).alias("check_id"), F.lit(None).cast("string").alias("agent"))
    answers = rollups.rule_lookup(found.unionByName(unknown).distinct())
    return answers.select(
        "check_id", "agent", "name", "severity", "confidence", "remediation", joined("patterns", "\n").alias("patterns"), "note",
        joined("available_check_ids").alias("available"),
    )


@query
def evidence_digest(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return rollups.evidence_digest(evidence.evidence(pages), "web methodology")


@query
def audit_report(spark, sf):
    files = fixture_files(spark, sf)
    done = audit(files, verify_limit=None)
    merged = done.tables["findings"]
    counted = [
        done.tables["severity_counts"].select(F.concat(F.lit("severity "), "severity").alias("item"), F.col("findings").alias("n")),
        done.tables["check_counts"].select(F.concat(F.lit("check "), "check_id"), "finding_count"),
        merged.dropDuplicates(["repo", "id"]).groupBy(F.concat(F.lit("verdict "), "verification_verdict")).count(),
        merged.dropDuplicates(["repo", "id"]).groupBy(F.concat(F.lit("behavior "), "behavior")).count(),
        done.tables["valued_findings"].agg(F.lit("valued"), F.count("*")),
        done.tables["blueprints"].agg(F.lit("blueprints"), F.count("*")),
        done.tables["flow_counts"].select(F.lit("flows"), "flow_count"),
        done.tables["routes"].select(F.lit("routes"), "checked_routes"),
        done.tables["report"].select(F.lit("total"), "total_findings"),
    ]
    out = counted[0]
    for part in counted[1:]:
        out = out.union(part)
    return out


# --- Custom rules, streaming ---------------------------------------------------


@query
def custom_rules(spark, sf):
    chats = spark.read.parquet(f"{sf}/conversations.parquet")
    path = F.concat(F.lit("conversation/"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.lit(".txt"))
    files = tables.corpus_from_table(chats, path, "text", "conversations")
    own = Rule("C1", "Articles", "secrets", "regex", "article-word", "info", "low", "A common word.", None, patterns=(r"(?i)\b(tion|the|de)\b",))
    merged = rules.load_rules(spark, [*CHECKS, own])
    found = scan.pattern_scan(corpus.explode_lines(files), merged)
    return found.filter(F.col("check_id") == "C1").select("repo", "path", "line_no", "check_id")


def _arriving(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream of files; the event of the same number gives the arrival."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    documents = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    times = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("arrived"))
    # A stream does not tell how many splits a batch has; one large file should use all cores.
    files = files_from_documents(documents.repartition(spark.sparkContext.defaultParallelism))
    number = F.coalesce(F.regexp_extract("path", r"_(\d+)", 1), F.lit("0")).cast("long")
    return files.withColumn("doc_id", number).join(times, "doc_id").drop("doc_id")


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out = shared_folder(spark, name)
    streaming.drain(stream, out)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query
def stream_scan(spark, sf):
    found = streaming.stream_scan(_arriving(spark, sf))
    kept = found.select("repo", "id", "check_id", "severity", "file", "line", "snippet", "rule")
    return _drained(spark, kept, "stream-scan")


@query
def stream_dedupe(spark, sf):
    # Every file arrives twice, the second time ten minutes later.
    again = F.explode(F.array(F.col("arrived"), F.col("arrived") + F.expr("interval 10 minutes")))
    files = _arriving(spark, sf)
    twice = files.select(*[c for c in files.columns if c != "arrived"], again.alias("arrived"))
    found = streaming.stream_dedupe(streaming.stream_scan(twice))
    return _drained(spark, found.select("repo", "id", "check_id", "file", "line"), "stream-dedupe")


@query
def stream_changes(spark, sf):
    """Every file arrives twice; lines that name a password are blank in its second version."""
    files = _arriving(spark, sf)
    blank = F.regexp_replace("text", "(?m)^.*password.*$", "")
    later = F.col("arrived") + F.expr("interval 10 minutes")
    versions = F.array(F.struct("arrived", "text"), F.struct(later.alias("arrived"), blank.alias("text")))
    twice = files.select(*[c for c in files.columns if c not in ("arrived", "text")], F.inline(versions))
    return _drained(spark, changes.stream_changes(twice).drop("arrived"), "stream-changes")


@query
def stream_severity(spark, sf):
    counts = _drained(spark, streaming.stream_severity(streaming.stream_scan(_arriving(spark, sf))), "stream-severity")
    return counts.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
