"""Functions, imports, call graph and context slices.

Parsing adds arrays to the file row (no shuffle); everything after it is joins that carry
``(repo, path)``, so one large file or one frequent name never becomes a single task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.parsing import CONTROL_WORDS, SIGNATURE_CHARS, function_spans, python_units
from sentrel.functions.rows import inline_once, settle
from sentrel.functions.spans import TARGET, places_of, targets_of
from sentrel.functions.text import detect_language, split_lines, strip, strip_code

# --- Fixed values ------------------------------------------------------------
CALL_DEPTH = 2
WINDOW_OUTSIDE = 15
WINDOW_INSIDE = 7
PLAIN_CALL = r"\b([A-Za-z_$][\w$]*)\s*\("
MEMBER_CALL = {
    "javascript": r"(?:\.|\?\.|::)\s*([A-Za-z_$][\w$]*)\s*\(",
    "php": r"(?:\$?->|::)\s*([A-Za-z_][\w]*)\s*\(",
}
JS_IMPORT = r"^\s*import\s+([^;]+?)\s+from\s+['\"]"
JS_SIDE_EFFECT = r"^\s*import\s+['\"][^'\"]+['\"]\s*;?"
JS_NAMED = r"([A-Za-z_$][\w$]*)\s*(?:as\s+([A-Za-z_$][\w$]*))?"
PHP_USE = r"^\s*use\s+([^;]+);"
PHP_INCLUDE = r"^\s*(?:include|require)(?:_once)?\s+['\"]"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
# --- end of fixed values -----------------------------------------------------

SCRIPTED = ("javascript", "typescript")
IMPORT_TYPE = "array<struct<line_no:int,text:string,names:array<string>,side_effect:boolean>>"


def _all_matches(lines: Column, pattern: str) -> Column:
    """First groups of every match in an array of lines."""
    return F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(pattern), F.lit(1))))


def _structural_functions(spans: Column, lines: Column, language: Column) -> Column:
    """Function records of JS/TS/PHP from their line ranges."""

    def record(span: Column) -> Column:
        body = F.slice(lines, span["start_line"], span["end_line"] - span["start_line"] + 1)
        first = strip(F.get(lines, span["start_line"] - 1))
        signature = F.substring(first, 1, SIGNATURE_CHARS)
        # The whole parameter list counts, also one that goes on over the next lines; only the shown signature is cut.
        whole = F.when(first.rlike(r"\([^)]*$"), F.array_join(body, " ")).otherwise(first)
        inside = F.regexp_extract(whole, r"\(([^)]*)\)", 1)
        params = F.filter(F.transform(F.split(inside, ","), strip), lambda p: p != "")
        # Both families drop control words from plain calls; only exact names count.
        plain = F.filter(
            _all_matches(body, PLAIN_CALL), lambda c: (c != span["name"]) & ~c.isin(*CONTROL_WORDS)
        )
        member = F.when(language == "php", _all_matches(body, MEMBER_CALL["php"])).otherwise(
            _all_matches(body, MEMBER_CALL["javascript"])
        )
        return F.struct(
            span["name"].alias("qualname"),
            span["name"].alias("name"),
            F.lit("function").alias("kind"),
            span["start_line"].alias("start_line"),
            span["end_line"].alias("end_line"),
            params.alias("params"),
            signature.alias("signature"),
            F.array_sort(F.array_distinct(F.concat(plain, member))).alias("calls"),
            F.array().cast("array<string>").alias("decorators"),
        )

    return F.transform(spans, record)


def _line_imports(lines: Column, language: Column) -> Column:
    """Imports of JS/TS/PHP by line, matched on the original text (quotes intact)."""

    def js(line: Column) -> Column:
        clause = F.regexp_extract(line, JS_IMPORT, 1)
        pairs = F.regexp_extract_all(clause, F.lit(JS_NAMED), F.lit(0))
        braced = F.transform(pairs, lambda p: F.regexp_extract(p, r"([A-Za-z_$][\w$]*)\s*$", 1))
        plain = F.array(strip(F.element_at(F.split(strip(clause), " as "), -1)))
        names = F.when(F.contains(clause, F.lit("{")), braced).otherwise(plain)
        return F.filter(names, lambda n: (n != "") & ~n.isin("default", "import"))

    def php(line: Column) -> Column:
        clause = strip(F.regexp_extract(line, PHP_USE, 1))
        last = F.element_at(F.split(clause, r"\\"), -1)
        return F.array(strip(F.element_at(F.split(last, " as "), -1)))

    def found(line: Column, index: Column) -> Column:
        scripted = language.isin(*SCRIPTED)
        none = F.array().cast("array<string>")
        names = (
            F.when(scripted & line.rlike(JS_IMPORT), js(line))
            .when(scripted & line.rlike(JS_SIDE_EFFECT), none)
            .when((language == "php") & line.rlike(PHP_USE), php(line))
            .when((language == "php") & line.rlike(PHP_INCLUDE), none)
        )
        return F.when(
            names.isNotNull(),
            F.struct(
                (index + 1).alias("line_no"),
                strip(line).alias("text"),
                names.alias("names"),
                (line.rlike(JS_SIDE_EFFECT) | line.rlike(PHP_INCLUDE)).alias("side_effect"),
            ),
        )

    return F.array_compact(F.transform(lines, found)).cast(IMPORT_TYPE)


def known_files(files: DataFrame) -> DataFrame:
    """Files of a supported language."""
    return files.withColumn("language", detect_language(F.col("path"))).filter(F.col("language").isNotNull())


def parse_files(files: DataFrame, keep_text: bool = False, *carried: str) -> DataFrame:
    """Adds ``lines``, ``parsed``, ``functions`` and ``imports`` to files of a known language; ``carried`` columns stay.

    Python is parsed with its own grammar; the other languages by brace structure over
    text without comments and literals. Each text visits a Python worker once.
    """
    kept = ["repo", "path", "language", *(["text"] if keep_text else []), "lines", "parsed", "functions", "imports"]
    return parsed_rows(known_files(files), *carried).select(*kept, *carried)


def parsed_rows(files: DataFrame, *carried: str) -> DataFrame:
    """``files`` with ``lines``, ``parsed``, ``functions``, ``imports``, ``symbols`` and ``events``.

    A file of an unknown language has its lines, and nulls. ``symbols`` are those of Python's own grammar; ``events`` are
    its dangerous calls with the text of their line.
    """
    text, language = F.col("text"), F.col("language")
    python = F.coalesce(language == "python", F.lit(False))
    scripted = language.isNotNull() & ~python
    stripped = settle(files, "repo", "path", "language", "text", *carried, code=F.when(scripted, strip_code(text, language)))
    shaped = stripped.select(
        "repo",
        "path",
        "language",
        "text",
        *carried,
        python_units(F.when(python, text)).alias("py"),
        function_spans(F.col("code"), language).alias("spans"),
    )
    split = settle(shaped, "repo", "path", "language", "text", *carried, "py", "spans", lines=split_lines(text))
    return settle(
        split,
        "repo",
        "path",
        "language",
        "text",
        *carried,
        "lines",
        parsed=F.when(python, F.col("py.parsed")).otherwise(F.when(scripted, F.lit(True))),
        functions=F.when(python, F.col("py.functions")).otherwise(
            F.when(scripted, _structural_functions(F.col("spans"), F.col("lines"), language))
        ),
        imports=F.when(python, F.col("py.imports")).otherwise(F.when(scripted, _line_imports(F.col("lines"), language))),
        symbols=F.when(python, F.col("py.symbols")),
        events=F.transform(
            F.when(python, F.col("py.events")),
            lambda e: e.withField("line", F.try_element_at("lines", e["line_no"])),
        ),
    )


def functions_of(parsed: DataFrame) -> DataFrame:
    return inline_once(parsed, "repo", "path", "language", structs=F.col("functions"))


def imports_of(parsed: DataFrame) -> DataFrame:
    return inline_once(parsed, "repo", "path", "language", structs=F.col("imports"))


def extract_functions(files: DataFrame) -> DataFrame:
    return functions_of(parse_files(files))


def extract_imports(files: DataFrame) -> DataFrame:
    return imports_of(parse_files(files))


def called_names(functions: DataFrame) -> DataFrame:
    """One row per function and distinct called name, with the name's last segment."""
    return (
        functions.select("repo", "path", F.col("qualname").alias("caller"), F.explode("calls").alias("call_name"))
        .distinct()
        .withColumn("call_segment", F.substring_index("call_name", ".", -1))
        .filter(~F.col("call_name").isin("self", "cls", "super"))
    )


def call_edges(functions: DataFrame) -> DataFrame:
    """Calls resolved inside their file: by qualified name or by last segment.

    A qualified name ends in the function's own name, so one equi join on
    ``(repo, path, segment)`` covers both. Unresolved calls keep a null callee.
    """
    # Definitions that share a qualified name are one callee.
    target = functions.select(
        "repo", "path", F.col("name").alias("call_segment"), F.col("qualname").alias("callee")
    ).distinct().withColumn("callee_path", F.col("path"))
    return (
        called_names(functions)
        .join(target, ["repo", "path", "call_segment"], "left")
        .select("repo", F.col("path").alias("caller_path"), "caller", "call_name", "call_segment", "callee_path", "callee")
    )


def callers(functions: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Reverse edges: the sorted callers of each called function of the file.

    A function counts as its own caller only when it calls its exact qualified name.
    """
    edges = call_edges(functions) if edges is None else edges
    own = (F.col("caller") != F.col("callee")) | (F.col("call_segment") == F.col("callee"))
    return (
        edges.filter(F.col("callee").isNotNull() & own)
        .groupBy("repo", F.col("callee_path").alias("path"), F.col("callee").alias("qualname"))
        .agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    )


def enclosing_function(points: DataFrame, functions: DataFrame, prefer: str = "narrowest") -> DataFrame:
    """The function whose range holds each point's line, null when there is none.

    ``narrowest`` takes the shortest range, ``latest`` the range that starts last. ``points`` needs ``repo, path,
    line_no``. The functions of a file and its points meet as two arrays of one row, in one sweep, so a file with
    many of both is no product of them.
    """
    record = F.struct("qualname", "start_line", "end_line", "signature", "calls")
    per_file = functions.groupBy("repo", "path").agg(F.collect_list(record).alias("functions"))
    asked = points.groupBy("repo", "path").agg(F.array_sort(F.collect_set("line_no")).alias("points"))
    rows = asked.join(per_file, ["repo", "path"], "left")
    spans = F.transform("functions", lambda f: F.struct(f["start_line"], f["end_line"], f["qualname"]))
    rows = rows.withColumn("places", places_of(prefer == "latest")(spans, F.col("points")))
    pairs = F.zip_with("points", "places", lambda p, i: F.struct(p.alias("line_no"), F.get("functions", i).alias("target")))
    return inline_once(rows, "repo", "path", structs=pairs).select("repo", "path", "line_no", "target.*")


def call_neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int = CALL_DEPTH) -> DataFrame:
    """``(repo, path, seed, qualname, depth)``: functions within ``depth`` call edges.

    ``seeds`` holds ``repo, path, qualname``. Callers and callees both count. The depth is
    small and fixed, so the joins are unrolled; each level is reduced to distinct rows.
    """
    linked = edges.filter(F.col("callee").isNotNull()).select("repo", F.col("caller_path").alias("path"), "caller", "callee")
    both = linked.select("repo", "path", F.col("caller").alias("a"), F.col("callee").alias("b")).unionByName(
        linked.select("repo", "path", F.col("callee").alias("a"), F.col("caller").alias("b"))
    ).distinct()
    level = seeds.select("repo", "path", F.col("qualname").alias("seed"), "qualname", F.lit(0).alias("depth")).distinct()
    reached = level
    for step in range(1, depth + 1):
        level = (
            level.withColumnRenamed("qualname", "a")
            .join(both, ["repo", "path", "a"])
            .select("repo", "path", "seed", F.col("b").alias("qualname"), F.lit(step).alias("depth"))
            .distinct()
        )
        reached = reached.unionByName(level)
    return reached.groupBy("repo", "path", "seed", "qualname").agg(F.min("depth").alias("depth"))


def keep_imports(slices: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports a slice needs: side effects always, others when a name occurs in its source.

    ``slices`` needs ``repo, path, slice_id, source``. Adds ``kept`` to every import.
    """
    tokens = F.array_distinct(F.regexp_extract_all("source", F.lit(f"({IDENTIFIER})"), F.lit(1)))
    return (
        slices.select("repo", "path", "slice_id", tokens.alias("tokens"))
        .join(imports.select("repo", "path", F.col("line_no").alias("import_line"), "text", "names", "side_effect"), ["repo", "path"])
        .select(
            "repo", "path", "slice_id", "import_line", "text",
            (F.col("side_effect") | F.arrays_overlap("names", "tokens")).alias("kept"),
        )
    )


def code_slices(points: DataFrame, files: DataFrame) -> DataFrame:
    """A focused slice per ``(repo, path, line_no)``.

    Inside a function: the kept imports up to its start, the functions within two call
    edges by start line, and a window of 7 lines around the point. Outside: a window of
    15 lines. A file of an unsupported language gives an empty slice.
    """
    # Points and text of a file meet once; functions, calls and lines are then read in its row.
    asked = points.groupBy("repo", "path").agg(F.array_sort(F.collect_set("line_no")).alias("points"))
    rows = asked.join(files.select("repo", "path", "text"), ["repo", "path"], "left")
    parsed = parse_files(rows, False, "points")
    found = targets_of(CALL_DEPTH)(F.col("functions"), F.col("points"))
    rows = settle(parsed.withColumn("found", found), "repo", "path", "language", "lines", "imports", targets=F.col("found"))
    unknown = asked.withColumn("language", detect_language(F.col("path"))).filter("language is null")
    none = lambda name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "points" else F.col("points") for f in TARGET])
    rows = rows.unionByName(unknown.select("repo", "path", "language", none("lines"), none("imports"), F.array(empty).alias("targets")))
    # Field by field, so that each lambda stays shallow and nothing is computed twice.
    for name, value in (("bodies", _bodies), ("tokens", _tokens), ("kept", _kept), ("whole", _whole)):
        added = F.transform("targets", _adding(name, value))
        rows = settle(rows, "repo", "path", "language", "lines", "imports", targets=added)
    per_point = F.transform("targets", lambda t: F.transform(t["points"], lambda at: _slice_row(t, at)))
    return inline_once(rows, "repo", "path", "language", structs=F.flatten(per_point))


def _adding(name: str, value: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda target: target.withField(name, value(target))


def _bodies(target: Column) -> Column:
    """Source of the kept functions, by start line; null outside a function."""
    return F.transform(
        target["members"],
        lambda m: F.array_join(F.slice("lines", m["start_line"], m["end_line"] - m["start_line"] + 1), "\n"),
    )


def _tokens(target: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.array_join(target["bodies"], "\n"), F.lit(f"({IDENTIFIER})"), F.lit(1))
    )


def _kept(target: Column) -> Column:
    used = F.filter("imports", lambda i: i["side_effect"] | F.arrays_overlap(i["names"], target["tokens"]))
    return F.when(target["qualname"].isNotNull(), used)


def _whole(target: Column) -> Column:
    """Kept imports up to the target's start, then the kept functions."""
    head = F.filter(target["kept"], lambda i: i["line_no"] <= target["start_line"])
    return F.array_join(F.concat(F.transform(head, lambda i: i["text"]), target["bodies"]), "\n")


def _slice_row(target: Column, at: Column) -> Column:
    known, inside = F.col("language").isNotNull(), target["qualname"].isNotNull()
    texts, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    reach = F.when(inside, F.lit(WINDOW_INSIDE)).otherwise(F.lit(WINDOW_OUTSIDE))
    first, last = F.greatest(F.lit(1), at - reach), F.least(F.size("lines"), at + reach)
    window = F.slice("lines", first, F.greatest(F.lit(0), last - first + 1))
    return F.struct(
        at.alias("line_no"),
        target["qualname"].alias("target_function"),
        target["signature"].alias("target_signature"),
        F.coalesce(target["callers"], texts).alias("callers"),
        F.coalesce(target["calls"], texts).alias("callees"),
        F.coalesce(F.transform(target["members"], lambda m: m["qualname"]), texts).alias("functions_included"),
        F.coalesce(F.transform(target["members"], lambda m: m["depth"]), numbers).alias("functions_depth"),
        F.coalesce(F.transform(target["kept"], lambda i: i["text"]), texts).alias("imports_kept"),
        (F.size("imports") - F.coalesce(F.size(target["kept"]), F.lit(0))).alias("imports_stripped"),
        F.when(~known, F.lit("")).when(inside, target["whole"]).otherwise(F.array_join(window, "\n")).alias("slice"),
        F.when(known, first).alias("focus_start"),
        F.when(known, last).alias("focus_end"),
        F.coalesce(F.when(inside, window), texts).alias("focus_lines"),
    )
