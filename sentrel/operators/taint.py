"""Variable-level taint within functions and across calls.

Facts hold the *steps* of each file: the lines with a sink, an assignment or a call, with the labels and words they need.
From them every function gets a *summary* where its file is, by ordered folds over its own steps (``F.aggregate``): what
its sources reach, and for each parameter which sinks and which arguments of further calls it reaches, with the path
in between. A summary does not depend on a caller, so a function is folded once for each of its parameters, however
many calls lead to it.

Flows across calls are then composed from these relations, level by level: what entered a parameter at one level (the
*delta*) meets the summary of that parameter, which gives flows and further calls, and the calls meet their callees.
An entry that was reached before by a path that is no longer is dropped, so the composition also ends without a
limit of depth. No text and no step takes part in a join; the summaries lie in buckets of ``(repo, path)``, so only
the delta is shuffled to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions.calls import split_calls
from sentrel.functions.labels import (
    DEFAULT_LABELS,
    LabelTables,
    any_label,
    assignment_of,
    first_label,
    first_match,
    let,
    sink_of,
    words,
)
from sentrel.functions.rows import explode_once, inline_once, settle
from sentrel.functions.text import SNIPPET_CHARS, finding_id, strip
from sentrel.operators.facts import collect_facts, module_files, symbols
from sentrel.operators.scan import FLOW_EVIDENCE, TAINT_STEP, as_findings
from sentrel.operators.structure import called_names, functions_of
from sentrel.session import bucketed, stored

# --- Fixed values ------------------------------------------------------------
MAX_DEPTH = 2
#: Calls or definitions of one name that are joined in one part.
HOT_NAME = 1000
MODULE = "<module>"
# --- end of fixed values -----------------------------------------------------

TAINT = (
    f"struct<path:array<{TAINT_STEP}>,kind:string,file:string,line:int,sanitized:boolean,sanitizer:string,"
    "def_line:int,inherited:boolean>"
)
FLOW = f"struct<line:int,text:string,kind:string,value:string,taint:{TAINT},arg_sanitizer:string>"
CALL = f"struct<line:int,text:string,vars:map<string,{TAINT}>>"
#: The root of what a function's own sources reach; roots from 0 are its parameters.
SOURCES = -1


# --- Labels of single lines ----------------------------------------------------


def label_sources(lines: DataFrame, labels: LabelTables = DEFAULT_LABELS) -> DataFrame:
    """Lines with a taint source: label and matched text of the first pattern."""
    return (
        lines.select("repo", "path", "line_no", "line", first_match(F.col("line"), labels.sources).alias("s"))
        .filter(F.col("s").isNotNull())
        .select("repo", "path", "line_no", F.col("s.label").alias("source"), "s.matched")
    )


def label_sinks(lines: DataFrame, labels: LabelTables = DEFAULT_LABELS) -> DataFrame:
    """Lines with a sink: label of the first pattern and its argument text."""
    return (
        lines.filter(any_label(F.col("line"), labels.sinks))
        .select("repo", "path", "line_no", sink_of(F.col("line"), labels.sinks).alias("s"))
        .select("repo", "path", "line_no", F.col("s.label").alias("sink"), "s.args")
    )


def label_sanitizers(lines: DataFrame, labels: LabelTables = DEFAULT_LABELS) -> DataFrame:
    label = first_label(F.col("line"), labels.sanitizers)
    return lines.select("repo", "path", "line_no", label.alias("sanitizer")).filter(F.col("sanitizer").isNotNull())


def assignments(lines: DataFrame) -> DataFrame:
    """At most one ``name = right side`` per line."""
    return (
        lines.select("repo", "path", "line_no", assignment_of(F.col("line")).alias("a"))
        .filter(F.col("a").isNotNull())
        .select("repo", "path", "line_no", "a.var", "a.rhs")
    )


def call_sites(lines: DataFrame) -> DataFrame:
    """Calls of each line with dotted name and argument list (``lines`` has ``language``)."""
    return (
        lines.filter(F.col("line").contains("("))
        .select("repo", "path", "line_no", F.posexplode(split_calls("line", "language")).alias("at", "call"))
        .select("repo", "path", "line_no", (F.col("at") + 1).alias("position"), F.col("call.name").alias("name"), F.col("call.args").alias("args"))
    )


# --- Units and summaries ---------------------------------------------------------


def parameter_name(param: Column) -> Column:
    """The bare name of a parameter text: no sigil, type or default."""
    plain = F.split(param, "[=:]")[0]
    return F.regexp_extract(plain, r"([A-Za-z_]\w*)\W*$", 1)


def _units(functions: Column, steps: Column) -> Column:
    """Every function, and the module part before the first one, each with its own steps."""
    first = F.array_min(F.transform(functions, lambda f: f["start_line"]))

    def unit(qualname: Column, name: Column, start: Column, end: Column, params: Column) -> Column:
        # An element of ``steps`` is a line, so a function's steps are a slice.
        own = F.filter(F.slice(steps, start, F.greatest(F.lit(0), end - start + 1)), lambda s: s.isNotNull())
        return F.struct(
            qualname.alias("qualname"), name.alias("name"), start.alias("start_line"), params.alias("params"), own.alias("steps")
        )

    module = unit(
        F.lit(MODULE), F.lit(MODULE), F.lit(1), F.greatest(F.lit(1), F.coalesce(first - 1, F.size(steps))),
        F.array().cast("array<string>"),
    )
    rest = F.transform(
        functions,
        lambda f: unit(f["qualname"], f["name"], f["start_line"], f["end_line"], F.transform(f["params"], parameter_name)),
    )
    return F.concat(F.array(module), rest)


def rooted_units(facts: DataFrame) -> DataFrame:
    """A row per unit and root that can reach anything: its sources, or a parameter that its lines name.

    ``vars`` holds the tainted variables at the start: none, or the parameter.
    """
    known = facts.filter("language is not null and steps is not null")
    units = inline_once(known, "repo", "path", "language", structs=_units(F.col("functions"), F.col("steps")))
    useful = F.exists("steps", lambda s: s["sink_kind"].isNotNull() | s["has_call"])
    named = F.array_distinct(F.flatten(F.transform("steps", lambda s: s["words"])))
    units = settle(units.filter(useful), *units.columns, named=named, sourced=F.exists("steps", lambda s: s["has_source"]))
    roots = F.filter(
        F.transform("params", lambda p, i: F.struct(i.alias("root"), p.alias("param"))),
        lambda r: (r["param"] != "") & F.array_contains("named", r["param"]),
    )
    own = F.array(F.struct(F.lit(SOURCES).alias("root"), F.lit(None).cast("string").alias("param")))
    rows = inline_once(
        units, "repo", "path", "language", "qualname", "name", "start_line", "steps",
        structs=F.when(F.col("sourced"), F.concat(own, roots)).otherwise(roots),
    )
    start = F.struct(
        F.array().cast(f"array<{TAINT_STEP}>").alias("path"),
        F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.lit(False).alias("sanitized"),
        F.lit(None).cast("string").alias("sanitizer"),
        (F.col("start_line") - 1).alias("def_line"),
        F.lit(True).alias("inherited"),
    ).cast(TAINT)
    return rows.withColumn("vars", F.when(F.col("root") == SOURCES, _no_vars()).otherwise(F.create_map("param", start)))


# --- The fold ------------------------------------------------------------------


def _mark(file: Column, line: Column, variable: Column, operation: Column) -> Column:
    return F.struct(file.alias("file"), line.alias("line"), variable.alias("variable"), operation.alias("operation"))


def _fresh(file: Column, line: Column, source: Column, *more: Column, sanitizer: Column | None = None) -> Column:
    """Taint that starts here; ``more`` are further steps of its path."""
    sanitizer = F.lit(None).cast("string") if sanitizer is None else sanitizer
    start = _mark(file, line, source["matched"], F.lit("source"))
    return F.struct(
        F.array(start, *more).alias("path"),
        source["label"].alias("kind"),
        file.alias("file"),
        line.alias("line"),
        sanitizer.isNotNull().alias("sanitized"),
        sanitizer.alias("sanitizer"),
        line.alias("def_line"),
        F.lit(False).alias("inherited"),
    ).cast(TAINT)


def _carry(taint: Column, line: Column, sanitizer: Column, *steps: Column) -> Column:
    return F.struct(
        F.concat(taint["path"], F.array(*steps)).alias("path"),
        taint["kind"].alias("kind"),
        taint["file"].alias("file"),
        taint["line"].alias("line"),
        (taint["sanitized"] | sanitizer.isNotNull()).alias("sanitized"),
        F.coalesce(taint["sanitizer"], sanitizer).alias("sanitizer"),
        line.alias("def_line"),
        taint["inherited"].alias("inherited"),
    ).cast(TAINT)


def earliest(vars_: Column, in_words: Column) -> Column:
    """``struct<def_line, name, taint>`` of the tainted variable used, else null.

    When an expression names several, the earliest definition gives the path, then the name.
    """
    used = F.filter(F.map_entries(vars_), lambda kv: F.array_contains(in_words, kv["key"]))
    return F.array_min(
        F.transform(used, lambda kv: F.struct(kv["value"]["def_line"].alias("def_line"), kv["key"].alias("name"), kv["value"].alias("taint")))
    )


def _fold(units: DataFrame, follow_calls: bool = True) -> DataFrame:
    """Run the steps of each unit in order, starting from its ``vars`` column.

    On each line sinks come first, then the assignment, then calls.
    """
    file = F.col("path")
    empty_flows, empty_calls = F.array().cast(f"array<{FLOW}>"), F.array().cast(f"array<{CALL}>")

    def sinks(vars_: Column, s: Column) -> Column:
        def flow(value: Column, taint: Column) -> Column:
            return F.struct(
                s["line"].alias("line"), s["text"].alias("text"), s["sink_kind"].alias("kind"),
                value.alias("value"), taint.alias("taint"), s["sink_sanitizer"].alias("arg_sanitizer"),
            ).cast(FLOW)

        direct = F.when(
            s["sink_source"].isNotNull(),
            F.array(flow(s["sink_source"]["matched"], _fresh(file, s["line"], s["sink_source"]))),
        ).otherwise(empty_flows)
        used = F.filter(F.map_entries(vars_), lambda kv: F.array_contains(s["sink_words"], kv["key"]))
        return F.concat(direct, F.transform(used, lambda kv: flow(kv["key"], kv["value"])))

    def assign(vars_: Column, s: Column) -> Column:
        target = _mark(file, s["line"], s["var"], F.lit("propagate"))
        operation = F.when(s["rhs_sanitizer"].isNotNull(), "sanitize").otherwise("propagate")
        taint = F.when(s["rhs_source"].isNotNull(), _fresh(file, s["line"], s["rhs_source"], target, sanitizer=s["source_sanitizer"])).otherwise(
            let(
                earliest(vars_, s["rhs_words"]),
                lambda used: F.when(
                    used.isNotNull(),
                    _carry(used["taint"], s["line"], s["rhs_sanitizer"], _mark(file, s["line"], used["name"], operation), target),
                ),
            )
        )
        others = F.map_filter(vars_, lambda k, _: k != s["var"])
        return let(taint, lambda t: F.when(t.isNull(), others).otherwise(F.map_concat(others, F.create_map(s["var"], t))))

    def run(acc: Column, s: Column) -> Column:
        flows = F.when(s["sink_kind"].isNotNull(), F.concat(acc["flows"], sinks(acc["vars"], s))).otherwise(acc["flows"])
        return let(
            F.when(s["var"].isNotNull(), assign(acc["vars"], s)).otherwise(acc["vars"]),
            lambda vars_: F.struct(
                vars_.alias("vars"),
                flows.alias("flows"),
                (calls(acc["calls"], vars_, s) if follow_calls else acc["calls"]).alias("calls"),
            ),
        )

    def calls(so_far: Column, vars_: Column, s: Column) -> Column:
        used = F.map_filter(vars_, lambda k, _: F.array_contains(s["words"], k))
        call = F.struct(s["line"].alias("line"), s["text"].alias("text"), used.alias("vars")).cast(CALL)
        tainted = s["has_call"] & ((F.size(used) > 0) | s["has_source"])
        return F.when(tainted, F.concat(so_far, F.array(call))).otherwise(so_far)

    start = F.struct(F.col("vars").alias("vars"), empty_flows.alias("flows"), empty_calls.alias("calls"))
    # As a generator, the fold is evaluated once and no later filter is pushed into it.
    out = F.inline(F.array(F.aggregate("steps", start, run)))
    return units.select(*[c for c in units.columns if c not in ("steps", "vars", "param")], out).drop("vars")


def _no_vars() -> Column:
    return F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{TAINT}>>"))


# --- Summaries ---------------------------------------------------------------------


def _told(taint: Column) -> Column:
    """Taint that belongs to the root: that of the sources starts in the function, that of a parameter came in."""
    return F.when(F.col("root") == SOURCES, ~taint["inherited"]).otherwise(taint["inherited"])


def summaries(facts: DataFrame, labels: LabelTables = DEFAULT_LABELS) -> tuple[DataFrame, DataFrame]:
    """What each root of a function reaches: sinks, and arguments of further calls.

    Both have ``repo, path, qualname, start_line, root``; sinks have ``name, line, text, kind, value, taint,
    arg_sanitizer``, calls have ``line, call, position, taint``. The path of a taint begins at the root.
    """
    folded = _fold(rooted_units(facts)).filter((F.size("flows") > 0) | (F.size("calls") > 0))
    folded = stored(folded, "summaries")
    key = ["repo", "path", "qualname", "start_line", "root"]
    sinks = folded.select(*key, "name", F.inline("flows")).filter(_told(F.col("taint")))
    calls = _tainted_arguments(folded, [*key, "name"], labels)
    # The line of a definition names the function itself.
    own = (F.col("line") == F.col("start_line")) & (F.substring_index("call", ".", -1) == F.substring_index("name", ".", -1))
    return bucketed(sinks, ["repo", "path"], "sinks"), bucketed(calls.filter(~own).drop("name"), ["repo", "path"], "calls")


def _tainted_arguments(folded: DataFrame, key: list[str], labels: LabelTables) -> DataFrame:
    """Tainted arguments of calls, a row each; sinks and sanitizers are not followed."""
    rows = folded.select(*key, "language", F.inline("calls"))
    rows = rows.withColumn("split", split_calls("text", "language"))
    rows = explode_once(rows, *[c for c in rows.columns if c != "split"], call=F.col("split"))
    name = F.col("call.name")
    followed = ~any_label(F.concat(name, F.lit("()")), labels.sinks) & ~any_label(
        F.concat(name, F.lit("(")), labels.sanitizers
    )

    def argument(text: Column, index: Column) -> Column:
        cleaned = first_label(text, labels.sanitizers) if labels.sanitized_sources else None
        taint = let(
            first_match(text, labels.sources),
            lambda source: F.when(text.isin("this", "self"), F.lit(None).cast(TAINT))
            .when(source.isNotNull(), _fresh(F.col("path"), F.col("line"), source, sanitizer=cleaned))
            .otherwise(earliest(F.col("vars"), words(text))["taint"]),
        )
        return F.struct(index.alias("position"), taint.alias("taint"))

    rows = settle(rows.filter(followed), *key, "line", name.alias("call"), arguments=F.transform("call.args", argument))
    # Several calls of a line may bind the same argument; one row of each tells it.
    return rows.select(*key, "line", "call", F.inline("arguments")).filter(F.col("taint").isNotNull()).filter(_told(F.col("taint")))


# --- Callees -------------------------------------------------------------------------


def call_targets(
    sites: DataFrame, functions: DataFrame, imported: DataFrame, modules: DataFrame, max_candidates: int | None = None
) -> DataFrame:
    """The callees of each ``(repo, path, call)``: ``callee_path, callee, start_line, params`` and ``way``.

    A call means a function of the same file by its last segment, else (``imported``) one of the module that its first
    segment was imported from, by the name it has there, else (``by name``) any function of the tree with that last segment,
    ``max_candidates`` of them if given. A call without a callee has no row.
    """
    plain = F.rtrim("call", F.lit("$"))
    sites = sites.select(
        "repo", "path", "call", F.substring_index(plain, ".", -1).alias("segment"), F.substring_index(plain, ".", 1).alias("head"),
        F.contains(plain, F.lit(".")).alias("dotted"),
    ).distinct()
    callee = functions.select(
        "repo", F.col("path").alias("callee_path"), F.col("qualname").alias("callee"), F.col("name").alias("segment"),
        "start_line", F.transform("params", parameter_name).alias("params"),
    )
    site = ["repo", "path", "call"]

    def found(rows: DataFrame, way: str) -> DataFrame:
        if max_candidates is not None:
            rank = F.row_number().over(Window.partitionBy(*site).orderBy("callee_path", "start_line", "callee"))
            rows = rows.withColumn("rank", rank).filter(F.col("rank") <= max_candidates)
        return rows.select(*site, "callee_path", "callee", "start_line", "params", F.lit(way).alias("way"))

    local = found(sites.join(callee.withColumn("path", F.col("callee_path")), ["repo", "path", "segment"]), "same file")
    defined = callee.select("repo", F.col("callee_path").alias("path"), "segment").distinct()
    rest = sites.join(defined, ["repo", "path", "segment"], "left_anti")
    # A plain call uses the name it was imported by; a dotted one a name inside what was imported.
    bound = rest.join(imported.withColumnRenamed("local", "head"), ["repo", "path", "head"])
    bound = bound.withColumn("segment", F.when(F.col("dotted"), F.col("segment")).otherwise(F.coalesce("original", "segment")))
    bound = bound.join(modules.withColumnRenamed("whole", "at_root"), ["repo", "module"]).filter(F.col("at_root") | ~F.col("whole"))
    bound = bound.filter(F.col("module_path") != F.col("path"))
    bound = bound.select(*site, "segment", F.col("module_path").alias("callee_path")).distinct()
    linked = found(bound.join(callee, ["repo", "callee_path", "segment"]), "imported")
    rest = rest.join(linked.select(*site).distinct(), site, "left_anti")
    named = _join_by_name(rest, callee.join(rest.select("repo", "segment").distinct(), ["repo", "segment"], "left_semi"), max_candidates)
    return local.unionByName(linked).unionByName(named.select(*linked.columns[:-1], F.lit("by name").alias("way")))


def _join_by_name(calls: DataFrame, callee: DataFrame, max_candidates: int | None) -> DataFrame:
    """All pairs of call and callee of one name; those of a hot name are dealt over parts of ``HOT_NAME`` a side.

    With a limit, the first callees of a name are chosen before the join. Only names with more calls or definitions
    than ``HOT_NAME`` are broadcast, so at most one per so many rows.
    """
    key = ["repo", "segment"]
    if max_candidates is not None:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("callee_path", "start_line", "callee"))
        return calls.join(callee.withColumn("rank", rank).filter(F.col("rank") <= max_candidates), key)
    n = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / HOT_NAME).alias(name))
    hot = n(calls, "call_parts").join(n(callee, "defined_parts"), key).filter("call_parts > 1 or defined_parts > 1")
    hot = F.broadcast(hot)

    def dealt(df: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        parts = lambda name: F.coalesce(f"{name}_parts", F.lit(1))
        df = df.join(hot, key, "left").withColumn(f"{own}_part", F.pmod(F.xxhash64(*by), parts(own)))
        df = df.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), parts(other) - 1)))
        return df.drop("call_parts", "defined_parts")

    left = dealt(calls, "call", "defined", "path", "call")
    right = dealt(callee, "defined", "call", "callee_path", "callee", "start_line")
    return left.join(right, [*key, "call_part", "defined_part"]).drop("call_part", "defined_part")


def resolution_counts(facts: DataFrame, labels: LabelTables = DEFAULT_LABELS) -> DataFrame:
    """Per repo and way, the calls with a tainted argument: ``same file``, ``imported``, ``by name`` with one candidate,
    ``ambiguous`` with more, ``unresolved`` with none."""
    _, calls = summaries(facts, labels)
    sites = calls.select("repo", "path", "call").distinct()
    found = call_targets(sites, functions_of(facts), symbols(facts), module_files(facts))
    per_site = found.groupBy("repo", "path", "call").agg(F.first("way").alias("way"), F.count("*").alias("n"))
    several = (F.col("way") == "by name") & (F.col("n") > 1)
    way = F.when(F.col("way").isNull(), "unresolved").when(several, "ambiguous").otherwise(F.col("way"))
    return sites.join(per_site, ["repo", "path", "call"], "left").groupBy("repo", way.alias("way")).agg(F.count("*").alias("calls"))


# --- Composition ---------------------------------------------------------------------

ENTRY = ["repo", "path", "qualname", "start_line", "root"]
#: Where the taint of an entry began, and whether it was sanitized on the way.
ORIGIN = ["file", "line", "kind", "sanitized"]


def _joined(prefix: Column, taint: Column) -> Column:
    """Taint that came in with ``prefix`` and went on as ``taint``, whose path begins at the parameter."""
    return F.struct(
        F.concat(prefix["path"], taint["path"]).alias("path"),
        prefix["kind"].alias("kind"),
        prefix["file"].alias("file"),
        prefix["line"].alias("line"),
        (prefix["sanitized"] | taint["sanitized"]).alias("sanitized"),
        F.coalesce(prefix["sanitizer"], taint["sanitizer"]).alias("sanitizer"),
        taint["def_line"].alias("def_line"),
        F.lit(True).alias("inherited"),
    ).cast(TAINT)


def _best(entries: DataFrame) -> DataFrame:
    """One entry per function, root and origin: the one with the shortest path, then the first."""
    rows = entries.select(*ENTRY, *[F.col(f"prefix.{c}").alias(f"origin_{c}") for c in ORIGIN], "prefix", "depth")
    keys = [c for c in rows.columns if c not in ("prefix", "depth")]
    best = F.min_by(F.struct("prefix", "depth"), F.struct(F.size("prefix.path"), "prefix.path"))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def _better(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """The entries that are new, or come by a shorter path than before."""
    keys = [c for c in entries.columns if c not in ("prefix", "depth")]
    old = seen.select(*[F.col(k).alias(f"old_{k}") for k in keys], F.col("prefix.path").alias("old_steps"))
    same = F.struct(F.size("old_steps"), "old_steps") <= F.struct(F.size("prefix.path"), "prefix.path")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"old_{k}"))
    return entries.join(old, same, "left_anti")


def _entries(calls: DataFrame, targets: DataFrame, deeper: bool) -> DataFrame:
    """What calls put into parameters of their callees; a function that called itself is not entered again."""
    into = targets.withColumnRenamed("start_line", "callee_start")
    rows = calls.join(into, ["repo", "path", "call"])
    if deeper:
        again = (F.col("callee_path") == F.col("path")) & (F.col("callee") == F.col("qualname")) & (F.col("callee_start") == F.col("start_line"))
        rows = rows.filter(~again)
    param = F.get("params", F.col("position"))
    step = _mark(F.col("path"), F.col("line"), param, F.lit("propagate"))
    prefix = F.col("taint").withField("path", F.concat("taint.path", F.array(step))).cast(TAINT)
    return rows.filter(param.isNotNull() & (param != "")).select(
        "repo", F.col("callee_path").alias("path"), F.col("callee").alias("qualname"), F.col("callee_start").alias("start_line"),
        F.col("position").alias("root"), prefix.alias("prefix"), (F.col("depth") + 1).alias("depth"),
    )


def _flows_of(sinks: DataFrame) -> DataFrame:
    """Flow rows of sinks with their whole ``taint`` and ``depth``."""
    last = _mark(F.col("path"), F.col("sink_line"), F.substring_index("name", ".", -1), F.lit("sink"))
    taint = F.col("taint")
    sanitized = taint["sanitized"] | F.col("arg_sanitizer").isNotNull()
    return sinks.withColumnRenamed("line", "sink_line").select(
        "repo",
        taint["file"].alias("source_file"),
        taint["line"].alias("source_line"),
        taint["kind"].alias("source_kind"),
        F.col("path").alias("sink_file"),
        "sink_line",
        F.col("kind").alias("sink_kind"),
        F.col("name").alias("sink_function"),
        "value",
        sanitized.alias("sanitized"),
        F.coalesce(taint["sanitizer"], "arg_sanitizer").alias("sanitizer"),
        F.concat(taint["path"], F.array(last)).cast(f"array<{TAINT_STEP}>").alias("taint_path"),
        F.when(sanitized, "medium").otherwise("high").alias("confidence"),
        strip(F.col("text")).alias("sink_text"),
        "depth",
    )


def composed_flows(
    facts: DataFrame,
    labels: LabelTables = DEFAULT_LABELS,
    max_depth: int | None = MAX_DEPTH,
    max_candidates: int | None = None,
    source_file: str | None = None,
) -> DataFrame:
    """Every flow, by its shortest path into each function; ``max_depth`` None goes on until nothing new is entered.

    With ``source_file``, only its sources start, and only files that taint enters are folded.
    """
    wanted = facts if source_file is None else facts.filter(F.col("path") == source_file)
    sinks, calls = summaries(wanted, labels)
    start = lambda rows: rows.filter(F.col("root") == SOURCES).withColumn("depth", F.lit(0))
    flows = _flows_of(start(sinks))
    if max_depth == 0:
        return flows
    functions = functions_of(facts).select("repo", "path", "qualname", "name", "start_line", "params")
    imported, modules = symbols(facts), module_files(facts)
    delta, seen, depth = start(calls), None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        targets = call_targets(delta, functions, imported, modules, max_candidates)
        entries = _best(_entries(delta, targets, deeper=depth > 1))
        entries = stored(entries if seen is None else _better(entries, seen), "entries")
        if entries.isEmpty():
            break
        seen = entries if seen is None else seen.unionByName(entries)
        if source_file is not None:
            files = entries.select("repo", "path").distinct()
            sinks, calls = summaries(facts.join(files, ["repo", "path"], "left_semi"), labels)
        inside = entries.select(*ENTRY, "prefix", "depth")
        met = inside.join(sinks, ENTRY).withColumn("taint", _joined(F.col("prefix"), F.col("taint")))
        flows = flows.unionByName(_flows_of(met.drop("prefix")))
        if depth != max_depth:
            delta = stored(inside.join(calls, ENTRY).withColumn("taint", _joined(F.col("prefix"), F.col("taint"))).drop("prefix"), "delta")
    return flows


def unique_flows(flows: DataFrame) -> DataFrame:
    """One row per source, sink, value and sanitized state: the shortest path, then the first."""
    key = ["repo", "source_file", "source_line", "source_kind", "sink_file", "sink_line", "sink_kind", "value", "sanitized"]
    rest = [c for c in flows.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(F.size("taint_path"), "taint_path", "sink_function", "depth"))
    return flows.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def all_flows(
    files: DataFrame,
    labels: LabelTables = DEFAULT_LABELS,
    max_depth: int | None = MAX_DEPTH,
    max_candidates: int | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Every flow of ``files``, or of their facts where those are stored already."""
    return composed_flows(collect_facts(files, labels, with_logic=False) if facts is None else facts, labels, max_depth, max_candidates)


def taint_intra(files: DataFrame, labels: LabelTables = DEFAULT_LABELS, facts: DataFrame | None = None) -> DataFrame:
    """Flows that stay inside one function or module part."""
    return unique_flows(all_flows(files, labels, max_depth=0, facts=facts))


def taint_flows(
    files: DataFrame,
    labels: LabelTables = DEFAULT_LABELS,
    max_candidates: int | None = None,
    max_depth: int | None = MAX_DEPTH,
    facts: DataFrame | None = None,
) -> DataFrame:
    return unique_flows(all_flows(files, labels, max_depth, max_candidates, facts))


def taint_inter(
    files: DataFrame, labels: LabelTables = DEFAULT_LABELS, max_candidates: int | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """Flows that cross at least one call."""
    return unique_flows(all_flows(files, labels, max_candidates=max_candidates, facts=facts)).filter(F.col("depth") > 0)


def flow_counts(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count("*").alias("flow_count"), F.count_if("sanitized").alias("sanitized_flow_count"))


def taint_findings(flows: DataFrame) -> DataFrame:
    """Unsanitized flows as findings, one row per id (the shortest path, then the first)."""
    open_flows = flows.filter(~F.col("sanitized"))
    evidence = F.struct(
        F.struct(F.col("source_file").alias("file"), F.col("source_line").alias("line"), F.col("source_kind").alias("kind")).alias("source"),
        F.struct(
            F.col("sink_file").alias("file"), F.col("sink_line").alias("line"), F.col("sink_kind").alias("kind"),
            F.col("sink_function").alias("function"),
        ).alias("sink"),
        "sanitized",
        "sanitizer",
    ).cast(FLOW_EVIDENCE)
    rows = open_flows.select(
        finding_id("RESEARCH-TAINT-", F.lit("TAINT"), F.col("sink_file"), F.col("sink_line"), F.col("sink_text")).alias("id"),
        F.lit("research-taint").alias("check_id"),
        F.lit("Semantic Taint Flow").alias("category"),
        F.lit("research_taint").alias("agent"),
        F.lit("research_taint.source-to-sink-flow").alias("sub_agent"),
        F.lit("high").alias("severity"),
        "confidence",
        "repo",
        F.col("sink_file").alias("file"),
        F.col("sink_line").alias("line"),
        F.substring("sink_text", 1, SNIPPET_CHARS).alias("snippet"),
        F.lit("source-to-sink-flow").alias("rule"),
        F.lit("source-to-sink-flow").alias("rule_id"),
        F.concat(
            F.lit("Untrusted data from "), "source_kind", F.lit(" reaches a "), "sink_kind",
            F.lit(" sink without a recognized sanitizer."),
        ).alias("description"),
        F.lit("Validate and constrain the value at the trust boundary, then use a context-safe API at the sink.").alias("remediation"),
        "taint_path",
        evidence.alias("flow_evidence"),
    )
    rest = [c for c in rows.columns if c not in ("repo", "id")]
    best = F.min_by(F.struct(*rest), F.struct(F.size("taint_path"), "taint_path", "description"))
    return as_findings(rows.groupBy("repo", "id").agg(best.alias("b")).select("repo", "id", "b.*"))


def trace_dataflow(
    files: DataFrame,
    source_file: str,
    sink_function: str,
    labels: LabelTables = DEFAULT_LABELS,
    max_candidates: int | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Flows from one file whose sink lies in the named function or within two calls of it.

    Only the sources of that file start, and only files that their taint enters are folded.
    """
    facts = collect_facts(files, labels, with_logic=False) if facts is None else facts
    flows = unique_flows(composed_flows(facts, labels, max_candidates=max_candidates, source_file=source_file))
    allowed = reachable_names(functions_of(facts), sink_function.rsplit(".", 1)[-1])
    names = allowed.withColumnRenamed("name", "sink_function")
    return flows.join(names, ["repo", "sink_function"], "left_semi")


def reachable_names(functions: DataFrame, start: str, depth: int = MAX_DEPTH) -> DataFrame:
    """``(repo, name)``: a function name and the names called within ``depth`` levels of it."""
    calls = called_names(functions).select("repo", F.substring_index("caller", ".", -1).alias("name"), "call_segment").distinct()
    level = functions.filter(F.col("name") == start).select("repo", "name").distinct()
    reached = level
    for _ in range(depth):
        level = level.join(calls, ["repo", "name"]).select("repo", F.col("call_segment").alias("name")).distinct()
        reached = reached.unionByName(level)
    return reached.distinct()
