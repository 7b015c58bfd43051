"""Route tables, handler windows and authorization findings.

Everything here is local to one file row: a file's routes, their windows and the lines in
them are arrays of that row, so the whole analysis runs without a shuffle and a single
explode per route. Only files that register a route are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.labels import let
from sentrel.functions.parsing import lines_of_handlers
from sentrel.functions.rows import explode_once, inline_once, settle
from sentrel.functions.text import finding_id, split_lines, strip
from sentrel.operators.scan import ROUTE_EVIDENCE, SNIPPET, TAINT_STEP, as_findings

# --- Fixed values ------------------------------------------------------------
# In the order they are tried; group 1 is the method, group 2 the path.
ROUTES = {
    "fastapi": r"""(?i)@(?:app|router)\.(get|post|put|patch|delete|all)\s*\(\s*["'`]([^"'`]+)["'`]""",
    "express": r"""(?i)\b(?:app|router)\.(get|post|put|patch|delete|all)\s*\(\s*["'`]([^"'`]+)["'`]""",
    "laravel": r"""(?i)\bRoute::(get|post|put|patch|delete|any)\s*\(\s*["'`]([^"'`]+)["'`]""",
}
REGISTRATION = (
    r"(?i)\b(?:app|router)\.(?:get|post|put|patch|delete|all)\s*\("
    r"|@(?:app|router)\.(?:get|post|put|patch|delete|all)\s*\("
    r"|\bRoute::(?:get|post|put|patch|delete|any)\s*\("
)
ROUTE_PARAMETER = r"(:[A-Za-z_]\w*|\{[A-Za-z_]\w*\})"
DEFINITION = r"(?i)\b(?:async\s+)?def\s+\w+\s*\("
CONTROLLER = r"""(?i)\b([A-Za-z_]\w*)(?:Controller)?@(\w+)|\[[^\]]*::class\s*,\s*['"](\w+)['"]\]"""
DEFINITION_REACH, BODY_REACH, EXPRESS_REACH = 40, 60, 40
LOOKUP = (
    r"(?i)\b(?:query|execute|executemany|findById|findOne|find|where|first|get|all|select)\s*\("
    r"|::\s*(?:query|find|first|all|where)\s*\("
)
AUTH_NAME = (
    r"(?i)\b(auth|authenticate|requireauth|isauthenticated|verifytoken|authorize|protect|ensureloggedin|jwt|session)\w*\b"
)
AUTH_WORD = (
    r"(?i)(auth|authenticate|requireauth|isauthenticated|verifytoken|authorize|protect|jwt|session|login|guard|policy)"
)
OWNERSHIP = (
    r"(?i)(owner_?id|user_?id|\.id|_id|account_?id|tenant_?id)\s*[!=]={0,2}\s*"
    r"(req(?:uest)?\.|request\.|session\.|auth|current_user|currentUser|ctx|context|userId|user_id)"
    r"|(Auth::user|request\.user|req\.user|current_user)\s*(->|\.|\[)[a-zA-Z_]*\s*[!=]={0,2}\s*"
    r"(row|user|obj|doc|record|item|order|account|result)(\.|->|\[)"
)
GLOBAL_MIDDLEWARE = r"(?i)\b(?:app|router)\.use\s*\([^)]*(auth|jwt|session|token)"
REQUEST_PRINCIPAL = r"(?i)(req|request)\.(user|auth|session)"
DEPENDENCY = r"(?i)Depends\s*\(\s*(\w+)"
PRINCIPAL_NAME = r"(?i)(current_user|currentUser|get_current|require_auth|verify_token)"
ROUTE_MIDDLEWARE = r"(?i)->middleware\s*\([^)]*(auth)"
CONTROLLER_MIDDLEWARE = r"(?i)\$this->middleware\s*\([^)]*(auth)"
LARAVEL_PRINCIPAL = r"(?i)(Auth::user|auth\(\)->user)"
SENSITIVE_REGISTRATION = r"""(?i)(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*["'`]([^"'`]+)"""
SENSITIVE_WORD = r"(?i)(admin|manage|billing|payment|refund|role|permission|delete|export|invite|reset)"
CONTROL_WORD = (
    r"(?i)(authorize|authorization|authenticated|current_user|currentUser|permission|requireAuth|session)"
)
SENSITIVE_REACH = 15
CLIENT_VALUE = (
    r"(?i)(req(?:uest)?\.(?:body|query|params)|request\.(?:json|form|args)).{0,80}"
    r"(amount|price|discount|role|permission|status|owner|user_id|tenant)"
)
BUSINESS = (SENSITIVE_REGISTRATION, CLIENT_VALUE)
SIGNALS = {
    "global": "global auth middleware",
    "chain": "auth middleware in route chain",
    "request": "request principal accessed",
    "dependency": "auth dependency",
    "principal": "auth dependency or principal",
    "route": "route middleware('auth')",
    "controller": "controller middleware('auth')",
    "laravel": "authenticated principal",
}
LOGIC_CATEGORY = "Business Logic & Authorization"
CONTEXT_CATEGORY = "Context-Aware Business Logic"
# --- end of fixed values -----------------------------------------------------

ROUTE_GATE = r"(?i)(?:app|router)\.|Route::"


def _route(line: Column, index: Column) -> Column:
    chosen = None
    for framework, pattern in ROUTES.items():
        row = F.struct(
            (index + 1).alias("line_no"),
            F.upper(F.regexp_extract(line, pattern, 1)).alias("method"),
            F.regexp_extract(line, pattern, 2).alias("route"),
            F.lit(framework).alias("framework"),
            strip(line).alias("text"),
        )
        test = line.rlike(pattern)
        chosen = F.when(test, row) if chosen is None else chosen.when(test, row)
    return chosen


def _parameters(route: Column) -> Column:
    return F.transform(F.regexp_extract_all(route, F.lit(ROUTE_PARAMETER), F.lit(1)), lambda p: F.regexp_replace(p, "[:{}]", ""))


def file_routes(files: DataFrame) -> DataFrame:
    """``(repo, path, text, lines, routes)``, one row per file that registers a route.

    Decorators are tried first, since they also contain the plain call form.
    """
    gated = files.filter(F.col("text").rlike(ROUTE_GATE))
    split = settle(gated, "repo", "path", "text", lines=split_lines(F.col("text")))
    return with_routes(split).filter(F.size("routes") > 0)


def anywhere(index: Column) -> Column:
    return F.lit(True)


def with_routes(rows: DataFrame, may: Callable[[Column], Column] = anywhere) -> DataFrame:
    """``rows``, which hold ``text`` and ``lines``, with the ``routes`` of each file; ``may`` leaves out lines by their index."""
    # Every route is a call.
    found = F.array_compact(F.transform("lines", lambda line, i: F.when(may(i) & F.contains(line, F.lit("(")), _route(line, i))))
    return settle(rows, *rows.columns, routes=F.when(F.col("text").rlike(ROUTE_GATE), found))


def routes(files: DataFrame) -> DataFrame:
    """``(repo, path, line_no, method, route, params, framework, text)``."""
    return (
        file_routes(files)
        .select("repo", "path", F.inline("routes"))
        .select("repo", "path", "line_no", "method", "route", _parameters(F.col("route")).alias("params"), "framework", "text")
    )


def _first_index(array: Column, test) -> Column:
    """1-based position of the first element that passes, null when none does."""
    positions = F.filter(F.transform(array, lambda x, i: F.when(test(x), i + 1)), lambda p: p.isNotNull())
    return F.get(positions, F.lit(0))


def _controller(route: Column) -> Column:
    """The controller function that a Laravel route names (empty: none), null for other routes."""
    found = [F.regexp_extract(route["text"], CONTROLLER, group) for group in (2, 3)]
    return F.when(route["framework"] == "laravel", F.when(found[0] != "", found[0]).otherwise(found[1]))


def _window(route: Column, handler: Column, lines: Column) -> Column:
    """``struct<body_start, window_start, window_end>`` of one route.

    ``handler`` is what ``handler_lines`` gives for it.

    The window of a decorator route and of a Laravel controller is searched for
    authorization together with its registration line; ``body_start`` is where database
    lookups are searched from.
    """
    at, size = route["line_no"], F.size(lines)

    def span(body: Column, start: Column, end: Column) -> Column:
        return F.struct(body.alias("body_start"), start.alias("window_start"), F.least(size, end).alias("window_end"))

    # Decorator: the next definition within reach, then up to the next unindented line.
    ahead = F.slice(lines, at + 1, F.lit(DEFINITION_REACH - 1))
    body = at + _first_index(ahead, lambda line: line.rlike(DEFINITION)) + 1
    inner = F.slice(lines, F.coalesce(body, F.lit(1)), F.lit(BODY_REACH))
    outdent = _first_index(inner, lambda line: (strip(line) != "") & ~line.rlike(r"^[ \t]"))
    decorated = span(body, at, F.coalesce(body + outdent - 2, body + BODY_REACH))

    # Laravel: the named controller function of this file, else 60 lines from here.
    start = F.coalesce(handler, at)
    laravel = span(start, start, start + BODY_REACH)

    express = span(at, at, F.coalesce(handler, at + EXPRESS_REACH))
    return (
        F.when((route["framework"] == "fastapi") & body.isNotNull(), decorated)
        .when(route["framework"] == "laravel", laravel)
        .otherwise(express)
    )


def handler_windows(files: DataFrame) -> DataFrame:
    """Routes with the line range of their handler and the lines in it.

    Columns of ``routes`` plus ``body_start, window_start, window_end, window_lines`` and
    the two facts of the whole file that authorization needs.
    """
    return windows_of(with_windows(file_routes(files)))


def with_windows(rows: DataFrame) -> DataFrame:
    """``rows``, which hold ``text``, ``lines`` and ``routes``, with the ``windows`` of the routes."""
    has_routes = F.coalesce(F.size("routes") > 0, F.lit(False))
    of_routes = lambda read: F.when(has_routes, F.transform("routes", read))
    normal = F.when(has_routes, F.array_join("lines", "\n"))
    found = rows.withColumn("handlers", lines_of_handlers(normal, of_routes(lambda r: r["line_no"]), of_routes(_controller)))
    matches = lambda pattern: F.when(has_routes, F.col("text").rlike(pattern))
    # Whole texts are searched here, once, and not in the lambda below, once per route.
    whole = settle(
        found, *rows.columns, "handlers",
        global_middleware=matches(GLOBAL_MIDDLEWARE), controller_middleware=matches(CONTROLLER_MIDDLEWARE),
    )

    def windowed(route: Column, index: Column) -> Column:
        return let(
            _window(route, F.get("handlers", index), F.col("lines")),
            lambda w: F.struct(
                route.alias("r"),
                w.alias("w"),
                F.slice("lines", w["window_start"], F.greatest(F.lit(0), w["window_end"] - w["window_start"] + 1)).alias("window_lines"),
                "global_middleware",
                "controller_middleware",
            ),
        )

    return settle(whole, *rows.columns, windows=F.when(has_routes, F.transform("routes", windowed)))


def windows_of(rows: DataFrame) -> DataFrame:
    """A row per window of the ``windows`` array."""
    return explode_once(rows, "repo", "path", x=F.col("windows")).select(
        "repo",
        "path",
        "x.r.line_no",
        "x.r.method",
        "x.r.route",
        _parameters(F.col("x.r.route")).alias("params"),
        "x.r.framework",
        "x.r.text",
        "x.w.body_start",
        "x.w.window_start",
        "x.w.window_end",
        "x.window_lines",
        "x.global_middleware",
        "x.controller_middleware",
    )


def auth_signals(windows: DataFrame) -> DataFrame:
    """Adds ``signals`` (labelled authorization evidence) and ``protected``."""
    window = F.array_join("window_lines", "\n")
    # The registration line belongs to the evidence even when the handler is elsewhere.
    text = F.concat_ws("\n", "text", window)
    express, fastapi, laravel = (F.col("framework") == f for f in ("express", "fastapi", "laravel"))
    tests = {
        "global": express & F.col("global_middleware"),
        "chain": express & window.rlike(AUTH_NAME),
        "request": express & window.rlike(REQUEST_PRINCIPAL),
        "dependency": fastapi & text.rlike(DEPENDENCY) & text.rlike(AUTH_WORD),
        "principal": fastapi & text.rlike(PRINCIPAL_NAME),
        "route": laravel & text.rlike(ROUTE_MIDDLEWARE),
        "controller": laravel & F.col("controller_middleware"),
        "laravel": laravel & text.rlike(LARAVEL_PRINCIPAL),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(SIGNALS[key])) for key, test in tests.items()]))
    return settle(windows, *windows.columns, signals=found).withColumn("protected", F.size("signals") > 0)


def ownership_signal(windows: DataFrame) -> DataFrame:
    """Adds ``ownership``: the window compares an owner field with the session principal."""
    return windows.withColumn("ownership", F.array_join("window_lines", "\n").rlike(OWNERSHIP))


def param_queries(windows: DataFrame) -> DataFrame:
    """One row per lookup line in a window and route parameter it names.

    Adds ``parameter, query_line, query_text`` and the three-step path.
    """

    def lookup(line: Column, index: Column) -> Column:
        at = F.col("window_start") + index
        usable = (at >= F.col("body_start")) & ~line.rlike(REGISTRATION) & line.rlike(LOOKUP)
        words = F.regexp_extract_all(line, F.lit(r"(\w+)"), F.lit(1))
        used = F.filter("params", lambda p: F.array_contains(words, p))
        return F.when(
            usable,
            F.transform(used, lambda p: F.struct(p.alias("parameter"), at.alias("query_line"), strip(line).alias("query_text"))),
        )

    hits = F.flatten(F.array_compact(F.transform("window_lines", lookup)))
    steps = [("line_no", "source"), ("query_line", "propagate"), ("query_line", "sink")]
    path = F.array(
        *[
            F.struct(F.col("path").alias("file"), F.col(at).alias("line"), F.col("parameter").alias("variable"), F.lit(o).alias("operation"))
            for at, o in steps
        ]
    ).cast(f"array<{TAINT_STEP}>")
    has_params = windows.filter(F.size("params") > 0)
    return inline_once(has_params, *has_params.columns, structs=hits).withColumn("taint_path", path)


def _research_finding(df: DataFrame, prefix: str, category: str, rule: Column, description: Column, remediation: Column, **extra: Column) -> DataFrame:
    """Findings of the route and business-logic analyses; ``file``, ``line``, ``found`` are given."""
    name = prefix.lower()
    made = df.select(
        finding_id(f"RESEARCH-{prefix}-", F.lit(prefix), F.col("file"), F.col("line"), F.col("found")).alias("id"),
        F.lit(f"research-{name}").alias("check_id"),
        F.lit(category).alias("category"),
        F.lit(f"research_{name}").alias("agent"),
        F.concat(F.lit(f"research_{name}."), rule).alias("sub_agent"),
        F.lit("high").alias("severity"),
        F.lit("medium").alias("confidence"),
        "repo",
        "file",
        "line",
        F.substring("found", 1, SNIPPET).alias("snippet"),
        rule.alias("rule"),
        rule.alias("rule_id"),
        description.alias("description"),
        remediation.alias("remediation"),
        *[column.alias(key) for key, column in extra.items()],
    )
    return as_findings(made)


def logic_findings(files: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Missing authorization (check 05) and object-level authorization (checks 33 and 06).

    A lookup on a route parameter in an unprotected handler is missing authorization; in
    a protected one without an ownership comparison it is an object-level flaw.
    """
    windows = handler_windows(files) if windows is None else windows
    rows = param_queries(ownership_signal(auth_signals(windows))).filter(~F.col("protected") | ~F.col("ownership"))
    missing = ~F.col("protected")
    rows = rows.withColumns({"file": F.col("path"), "line": F.col("query_line"), "found": F.col("query_text")})
    head = F.concat_ws(" ", "method", "route")
    evidence = F.struct(
        F.when(missing, "05").otherwise("33").alias("check"),
        "route",
        "method",
        "framework",
        "parameter",
        "query_line",
        F.col("signals").alias("auth_signals"),
    ).cast(ROUTE_EVIDENCE)
    return _research_finding(
        rows.drop("line_no"),
        "LOGIC",
        LOGIC_CATEGORY,
        F.when(missing, "missing-authorization").otherwise("idor-bola"),
        F.when(
            missing,
            F.concat(
                head,
                F.lit(" executes a database query on route parameter '"),
                "parameter",
                F.lit("' but no authorization guard is present in its handler chain."),
            ),
        ).otherwise(
            F.concat(
                head,
                F.lit(" looks up a resource by route parameter '"),
                "parameter",
                F.lit("' without comparing resource ownership against the session principal."),
            )
        ),
        F.when(
            missing,
            "Require an explicit server-side authentication and authorization decision before the object access.",
        ).otherwise("Bind the object access to the authenticated principal and tenant; return 404 for non-owned resources."),
        taint_path=F.col("taint_path"),
        route_evidence=evidence,
    )


def missing_authorization(files: DataFrame) -> DataFrame:
    return logic_findings(files).filter(F.col("rule") == "missing-authorization")


def idor(files: DataFrame) -> DataFrame:
    return logic_findings(files).filter(F.col("rule") == "idor-bola")


def checked_routes(files: DataFrame) -> DataFrame:
    """Number of routes over the whole corpus, counted per file before they are summed."""
    counted = file_routes(files).select(F.size("routes").cast("long").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("checked_routes"))


#: What a text with a business-logic hit has somewhere.
BUSINESS_GATE = r"(?i)(?:app|router)\.|req(?:uest)?\.(?:body|query|params|json|form|args)"


def with_business(rows: DataFrame, may: Callable[[Column], Column] = anywhere) -> DataFrame:
    """``rows``, which hold ``text`` and ``lines``, with ``business``: line, text and rule of each hit.

    ``may`` leaves out lines by their index.
    """

    def facts(line: Column, index: Column) -> Column:
        near = F.array_join(F.slice("lines", index + 1, F.lit(SENSITIVE_REACH)), "\n")
        sensitive = (
            line.rlike(SENSITIVE_REGISTRATION)
            & F.regexp_extract(line, SENSITIVE_REGISTRATION, 2).rlike(SENSITIVE_WORD)
            & ~near.rlike(CONTROL_WORD)
        )
        rules = F.array_compact(
            F.array(
                F.when(sensitive, F.lit("sensitive-route-without-authorization-signal")),
                F.when(line.rlike(CLIENT_VALUE), F.lit("client-controlled-business-value")),
            )
        )
        return F.transform(
            rules, lambda r: F.struct((index + 1).alias("line"), strip(line).alias("found"), r.alias("rule"))
        )

    gate = F.col("text").rlike(BUSINESS_GATE)
    return settle(rows, *rows.columns, business=F.when(gate, F.flatten(F.array_compact(F.transform("lines", lambda line, i: F.when(may(i), facts(line, i)))))))


def business_logic(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Sensitive routes without an authorization word near them, and trusted client values.

    ``rows`` may hold the ``business`` arrays of the files already.
    """
    if rows is None:
        gated = files.filter(F.col("text").rlike(BUSINESS_GATE))
        rows = with_business(settle(gated, "repo", "path", "text", lines=split_lines(F.col("text"))))
    rows = inline_once(rows.withColumn("file", F.col("path")), "repo", "file", structs=F.col("business"))
    sensitive = F.col("rule") == "sensitive-route-without-authorization-signal"
    return _research_finding(
        rows,
        "LOGIC",
        CONTEXT_CATEGORY,
        F.col("rule"),
        F.when(sensitive, "A sensitive route has no recognizable authorization control in its local handler context.").otherwise(
            "A business-critical value appears to be accepted from a request without evidence of server-side recomputation."
        ),
        F.when(
            sensitive,
            "Require an explicit server-side policy decision for the operation and bind it to the authenticated principal and tenant.",
        ).otherwise("Derive prices, roles, ownership, status transitions, and tenant identity from trusted server state."),
    )


def sensitive_route(files: DataFrame) -> DataFrame:
    return business_logic(files).filter(F.col("rule") == "sensitive-route-without-authorization-signal")


def client_value(files: DataFrame) -> DataFrame:
    return business_logic(files).filter(F.col("rule") == "client-controlled-business-value")


def business_logic_report(files: DataFrame) -> DataFrame:
    """Findings per rule of the business-logic analysis."""
    return business_logic(files).groupBy("rule").agg(F.count("*").alias("finding_count"))
