"""The facts of each file, from one pass over its text.

A facts row holds what all later analyses need as compact arrays: functions, imports, imported symbols, dangerous
calls, routes with their handler windows, business-logic hits, and the taint steps of the lines that matter. A Python
text is parsed once and visits a worker once. The rows are written to the shared folder where the file is, without a
shuffle; everything that follows reads columns of that table, so no join or exchange carries a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.labels import (
    DEFAULT_LABELS,
    LabelTables,
    any_label,
    assignment_of,
    first_label,
    first_match,
    let,
    patterns_of,
    sink_of,
    words,
)
from sentrel.functions.masks import has_bit, line_masks, literal_regex
from sentrel.functions.prefilter import call_gate
from sentrel.functions.rows import settle
from sentrel.functions.text import detect_language, strip
from sentrel.operators.routes import BUSINESS, ROUTES, with_business, with_routes, with_windows
from sentrel.operators.structure import SCRIPTED, parsed_rows
from sentrel.session import stored

CALL_GATE = r"\w\s*\("
#: A line without any of these holds no sink with arguments, no assignment and no call.
STEP_GATE = r"=|\w\s*\("
#: The same for Arrow's matcher, which may let more through.
STEP_MASK = r"=|\w[\s\x0b]*\("
STEP_BIT, SINK_BIT, SOURCE_BIT, ROUTE_BIT, BUSINESS_BIT = range(5)
#: Lines outside Python that may bind an imported name.
IMPORT_LINE = r"^\s*(?:import\b|export\b.*\bfrom\b|use\s|(?:const|let|var)\b.*\brequire\s*\()"
MODULE_QUOTED = r"(?:from\s+|require\s*\(\s*|import\s+)['\"]([^'\"]+)['\"]"
JS_BRACED = r"\{([^}]*)\}"
JS_NAMESPACE = r"\*\s*as\s+([A-Za-z_$][\w$]*)"
JS_DEFAULT = r"^\s*(?:import|const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?:,|=|from\b)"
PHP_USE = r"^\s*use\s+(function\s+)?([\w\\]+?)(?:\s+as\s+(\w+))?\s*;"


def collect_facts(files: DataFrame, labels: LabelTables = DEFAULT_LABELS, with_logic: bool = True) -> DataFrame:
    """One stored row per file: ``repo, path, language, line_count, parsed, functions, imports, symbols, import_lines,
    events, steps, windows, business``.

    ``steps`` has an element for each line, null where the line does not matter for taint. Files of unknown languages
    have routes and business hits only; without ``with_logic`` these are left out.
    """
    return stored(file_facts(files, labels, with_logic), "facts")


def file_facts(files: DataFrame, labels: LabelTables = DEFAULT_LABELS, with_logic: bool = True) -> DataFrame:
    rows = parsed_rows(files.withColumn("language", detect_language(F.col("path"))))
    rows = with_masks(rows, labels, with_logic)
    rows = settle(rows, *rows.columns, steps=F.when(F.col("language").isNotNull(), line_steps(F.col("lines"), labels, F.col("masks"))))
    if with_logic:
        route, business = (lambda at, bit=bit: maybe(at, bit) for bit in (ROUTE_BIT, BUSINESS_BIT))
        rows = with_business(with_windows(with_routes(rows, route)), business)
    other = F.col("language").isNotNull() & (F.col("language") != "python")
    import_lines = F.when(other, F.filter("lines", lambda line: line.rlike(IMPORT_LINE)))
    return rows.select(
        "repo", "path", "language", F.size("lines").alias("line_count"), "parsed", "functions", "imports", "symbols",
        import_lines.alias("import_lines"), "events", "steps", *(["windows", "business"] if with_logic else []),
    )


def with_masks(rows: DataFrame, labels: LabelTables, with_logic: bool) -> DataFrame:
    """``rows``, which hold ``lines``, with ``masks``: per line what it may hold, by the bits below, null where labels give no gate.

    Lines that pass no gate, which is most, are looked at by no pattern of the engine.
    """
    gates = [STEP_MASK, literal_regex(patterns_of(labels.sinks)), literal_regex(patterns_of(labels.sources))]
    if with_logic:
        gates += [literal_regex(ROUTES.values()), literal_regex(BUSINESS)]
    if None in gates:
        return rows.withColumn("masks", F.lit(None).cast("array<bigint>"))
    return rows.withColumn("masks", line_masks(F.col("lines"), gates))


def maybe(index: Column, bit: int) -> Column:
    """Whether the line at ``index`` may hold what the bit stands for."""
    return F.coalesce(has_bit(F.get("masks", index), bit), F.lit(True))


def line_steps(lines: Column, labels: LabelTables, masks: Column | None = None) -> Column:
    """What taint needs of each line that holds a sink, an assignment or a call; null for the others.

    ``masks`` tell per line what it may hold (see ``with_masks``); null means anything.
    """
    anything = F.lit((1 << SOURCE_BIT + 1) - 1)

    def step(line: Column, index: Column) -> Column:
        given = anything if masks is None else F.coalesce(F.get(masks, index), anything)
        return let(given, lambda mask: F.when(mask != 0, looked_at(line, index, mask)))

    def looked_at(line: Column, index: Column, mask: Column) -> Column:
        sink = has_bit(mask, SINK_BIT) & any_label(line, labels.sinks)
        found = F.struct(
            F.when(sink, sink_of(line, labels.sinks)).alias("sink"),
            assignment_of(line).alias("assigned"),
            (has_bit(mask, SOURCE_BIT) & any_label(line, labels.sources)).alias("has_source"),
            line.rlike(CALL_GATE).alias("has_call"),
        )
        # The sinks are a long pattern; most lines that hold no call fail a short one.
        may = has_bit(mask, SINK_BIT) & call_gate(F.lower(line), patterns_of(labels.sinks)) & any_label(line, labels.sinks)
        matters = (has_bit(mask, STEP_BIT) & line.rlike(STEP_GATE)) | may
        return F.when(matters, let(found, lambda s: F.when(s["sink"].isNotNull() | s["assigned"].isNotNull() | s["has_call"], whole(line, index, s))))

    def whole(line: Column, index: Column, s: Column) -> Column:
        by_rhs = first_label(s["assigned"]["rhs"], labels.sanitizers)
        return F.struct(
            (index + 1).alias("line"),
            line.alias("text"),
            words(line).alias("words"),
            s["has_source"].alias("has_source"),
            s["sink"]["label"].alias("sink_kind"),
            words(s["sink"]["args"]).alias("sink_words"),
            F.when(s["has_source"], first_match(s["sink"]["args"], labels.sources)).alias("sink_source"),
            first_label(s["sink"]["args"], labels.sanitizers).alias("sink_sanitizer"),
            s["assigned"]["var"].alias("var"),
            words(s["assigned"]["rhs"]).alias("rhs_words"),
            F.when(s["has_source"], first_match(s["assigned"]["rhs"], labels.sources)).alias("rhs_source"),
            by_rhs.alias("rhs_sanitizer"),
            (by_rhs if labels.sanitized_sources else F.lit(None).cast("string")).alias("source_sanitizer"),
            s["has_call"].alias("has_call"),
        )

    return F.transform(lines, step)


# --- Imported names --------------------------------------------------------------


def symbols(facts: DataFrame) -> DataFrame:
    """``(repo, path, local, original, module, whole)``: names that a file imports, and the module they come from.

    ``module`` is a path without its ending, as ``module_files`` has them; ``whole`` says that it starts at the root of the
    tree, as for relative imports. ``original`` is null where the name stands for a module, a class or a default export.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    python = facts.filter(F.size("symbols") > 0).select("repo", "path", folder.alias("folder"), F.inline("symbols"))
    up = F.expr("repeat('../', greatest(level - 1, 0))")
    dotted = F.replace("module", F.lit("."), F.lit("/"))
    # ``from . import name`` may mean the module of that name.
    inner = F.when((F.col("module") == "") & F.col("original").isNotNull(), F.col("original")).otherwise(dotted)
    relative = F.col("level") > 0
    target = F.when(relative, normal_path(F.concat("folder", up, inner))).otherwise(dotted)
    python = python.select("repo", "path", "local", "original", target.alias("module"), relative.alias("whole"))
    return python.unionByName(_script_symbols(facts)).unionByName(_php_symbols(facts)).filter("module != ''").distinct()


def normal_path(path: Column) -> Column:
    """A path without ``.`` and empty parts, and with ``..`` taken up; parts above the root are dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
    return F.array_join(F.aggregate(parts, none, lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.array_append(acc, p))), "/")


def _import_lines(facts: DataFrame, *languages: str) -> DataFrame:
    return facts.filter(F.col("language").isin(*languages) & (F.size("import_lines") > 0)).select(
        "repo", "path", F.regexp_replace("path", "[^/]*$", "").alias("folder"), F.explode("import_lines").alias("line")
    )


def _script_symbols(facts: DataFrame) -> DataFrame:
    lines = _import_lines(facts, *SCRIPTED).withColumn("target", F.regexp_extract("line", MODULE_QUOTED, 1)).filter("target != ''")
    braced = F.filter(F.transform(F.split(F.regexp_extract("line", JS_BRACED, 1), ","), strip), lambda p: p != "")
    pairs = F.transform(
        braced,
        lambda p: F.struct(
            F.regexp_extract(p, r"([A-Za-z_$][\w$]*)\s*$", 1).alias("local"),
            F.regexp_extract(p, r"^(?:type\s+)?([A-Za-z_$][\w$]*)", 1).alias("original"),
        ),
    )
    bare = lambda pattern: F.array(F.struct(F.regexp_extract("line", pattern, 1).alias("local"), F.lit(None).cast("string").alias("original")))
    rows = lines.select("repo", "path", "folder", "target", F.inline(F.concat(pairs, bare(JS_NAMESPACE), bare(JS_DEFAULT)))).filter("local != ''")
    relative = F.col("target").startswith(".")
    module = F.when(relative, normal_path(F.concat("folder", "target"))).otherwise(normal_path(F.col("target")))
    return rows.select("repo", "path", "local", "original", stem(module).alias("module"), relative.alias("whole"))


def _php_symbols(facts: DataFrame) -> DataFrame:
    lines = _import_lines(facts, "php").filter(F.col("line").rlike(PHP_USE))
    part = lambda n: F.regexp_extract("line", PHP_USE, n)
    name = F.substring_index(part(2), "\\", -1)
    of_function = part(1) != ""
    space = F.replace(F.regexp_replace(part(2), r"\\[^\\]*$", ""), F.lit("\\"), F.lit("/"))
    return lines.select(
        "repo",
        "path",
        F.coalesce(F.nullif(part(3), F.lit("")), name).alias("local"),
        F.when(of_function, name).alias("original"),
        # A class lies in the file of its name; a namespace need not follow the folders, so its last part stands for it.
        F.when(of_function, F.substring_index(space, "/", -1)).otherwise(name).alias("module"),
        F.lit(False).alias("whole"),
    )


def stem(path: Column) -> Column:
    """A path without its ending and without the file name that stands for its folder."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<=[^/])\.[A-Za-z]+$", ""), r"(?:^|/)(?:__init__|index)$", "")


def module_files(facts: DataFrame) -> DataFrame:
    """``(repo, module, module_path, whole)``: each file by its stem and by all ends of the stem that begin at a folder."""
    parts = F.split(stem(F.col("path")), "/")
    rows = facts.filter("language is not null").select("repo", F.col("path").alias("module_path"), parts.alias("parts"))
    rows = rows.select("repo", "module_path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("at"))
    tail = F.array_join(F.slice("parts", F.col("at"), F.size("parts")), "/")
    return rows.select("repo", tail.alias("module"), "module_path", (F.col("at") == 1).alias("whole"))
