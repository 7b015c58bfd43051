"""Source, sink and sanitizer tables: ordered (pattern, label) lists, and their columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Labels = Sequence[tuple[str, str]]

# --- Fixed values ------------------------------------------------------------
SOURCES: Labels = (
    (r"(?i)\b(?:req(?:uest)?|request|ctx)\.(?:params|query|body|cookies|headers|args|form|json|path)\b", "HTTP request data"),
    (r"(?i)\brequest\.(?:query_params|get_json|json)\b", "HTTP request data"),
    (r"(?i)\$_?(?:GET|POST|REQUEST|COOKIE|FILES|SERVER)\b", "PHP superglobal"),
    (r"(?i)\b(?:os\.)?environ\b", "process environment"),
    (r"(?i)\b(?:sys\.)?argv\b", "process arguments"),
    (r"(?i)\b(?:input|URLSearchParams|FormData)\b", "user input API"),
    (r"(?i)\b(?:request|ctx|context)\.(?:state|session|user)\b", "session-derived input"),
)
SINKS: Labels = (
    (r"(?i)\b(?:db|knex|pool|client|conn|connection|sequelize|mongoose)\.(?:query|execute|executemany|raw|findById|findOne|find|where)\s*\(", "database query"),
    (r"(?i)\b(?:cursor|stmt|statement|pdo)\.(?:execute|executemany)\s*\(", "database query"),
    (r"(?i)\b\w+\.(?:execute|executemany)\s*\(", "database query"),
    (r"(?i)\b(?:execute|executemany|raw)\s*\([^)]*(?:SELECT|INSERT|UPDATE|DELETE)", "database query"),
    (r"(?i)\b(?:eval|exec|compile)\s*\(", "dynamic code execution"),
    (r"(?i)\b(?:system|popen|shell_exec|passthru|proc_open)\s*\(", "process execution"),
    (r"(?i)\b(?:innerHTML|outerHTML|insertAdjacentHTML|document\.write)\b", "HTML sink"),
    (r"(?i)\b(?:fetch|axios\.(?:get|post|put|delete)|requests\.(?:get|post)|urllib\.request|curl_init|file_get_contents)\s*\(", "server-side network request"),
    (r"(?i)\b(?:open|readFile|writeFile|sendFile|unlink|file_put_contents|include|require|import_module)\s*\(", "filesystem or include operation"),
)
SANITIZERS: Labels = (
    (r"(?i)(?:escape|htmlspecialchars|htmlentities|strip_tags|encodeURIComponent|encodeURI|json\.dumps|json\.stringify|parameterized)\s*\(", "contextual escaping"),
    (r"(?i)(?:int|intval|float|bool|strval|parseInt|parseFloat|Number)\s*\(", "numeric cast"),
    (r"(?i)(?:prepare|bindParam|bindValue|bind)\s*\(", "parameterized statement"),
    (r"(?i)(?:validate|isInt|isEmail|check|whitelist|sanitize|clean)\s*\(", "input validation"),
    (r"(?i)(?:hashlib|bcrypt|hash|md5|sha1|sha256|crypt)\s*\(", "cryptographic hash"),
    (r"(?:%s|:[a-zA-Z_][a-zA-Z0-9_]*|\?['\"])", "parameter binding"),
)
# --- end of fixed values -----------------------------------------------------


@dataclass(frozen=True)
class LabelTables:
    """The three tables an analysis uses; replace any of them to change what it knows.

    The default sanitizer names have no word boundary (``print(`` counts as the cast
    ``int(``) and the parameter-binding pattern takes any ``:name``; ``bounded`` gives the
    variant with a boundary before each name. A source whose expression also names a sanitizer starts unsanitized
    taint, unless ``sanitized_sources`` is set.
    """

    sources: Labels = SOURCES
    sinks: Labels = SINKS
    sanitizers: Labels = SANITIZERS
    sanitized_sources: bool = False

    def bounded(self) -> LabelTables:
        named = [(p.replace("(?i)(?:", r"(?i)\b(?:", 1), label) for p, label in self.sanitizers]
        return LabelTables(self.sources, self.sinks, tuple(named), self.sanitized_sources)


DEFAULT_LABELS = LabelTables()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it by name in ``body``.

    A column used twice in an expression is planned and evaluated twice; inside a lambda it
    is a variable. Keeps nested expressions linear in size.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_label(text: Column, table: Labels) -> Column:
    """Label of the first pattern in list order that occurs in the text, else null."""
    chain: Column | None = None
    for pattern, label in table:
        test = text.rlike(pattern)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain


def first_match(text: Column, table: Labels) -> Column:
    """``struct<label, matched>`` of the first pattern that occurs in the text, else null."""
    chain: Column | None = None
    for pattern, label in table:
        row = F.struct(F.lit(label).alias("label"), F.regexp_extract(text, f"({pattern})", 1).alias("matched"))
        test = text.rlike(pattern)
        chain = F.when(test, row) if chain is None else chain.when(test, row)
    return chain


def any_label(text: Column, table: Labels) -> Column:
    return text.rlike("|".join(f"(?:{pattern})" for pattern in patterns_of(table)))


def patterns_of(table: Labels) -> Iterable[str]:
    return [pattern for pattern, _ in table]


def call_arguments(text: Column, begin: Column) -> Column:
    """Text between the first ``(`` at or after ``begin`` (1-based) and its match.

    Without a match the rest of the line counts, and without a ``(`` the text from ``begin``.
    """

    def closed_part(tail: Column) -> Column:
        # Pieces that end in a parenthesis; fold them until the depth is back to zero.
        pieces = F.regexp_extract_all(tail, F.lit(r"([^()]*[()])"), F.lit(1))
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("length"))

        def fold(acc: Column, piece: Column) -> Column:
            step = F.when(F.endswith(piece, F.lit("(")), F.lit(1)).otherwise(F.lit(-1))
            return F.when(acc["depth"] == 0, acc).otherwise(
                F.struct((acc["depth"] + step).alias("depth"), (acc["length"] + F.length(piece)).alias("length"))
            )

        return let(
            F.aggregate(pieces, start, fold),
            lambda end: F.when(end["depth"] == 0, F.substring(tail, F.lit(1), end["length"] - 1)).otherwise(tail),
        )

    def after(rest: Column) -> Column:
        # ``rest`` starts at ``begin``; drop everything up to the first parenthesis.
        inside = F.substring(rest, F.locate("(", rest) + 1, F.length(rest))
        return F.when(F.contains(rest, F.lit("(")), let(inside, closed_part)).otherwise(rest)

    return let(F.substring(text, begin, F.length(text)), after)


def sink_of(text: Column, table: Labels) -> Column:
    """``struct<label, args>`` of the first sink pattern in list order, else null."""
    chain: Column | None = None
    for pattern, label in table:
        row = F.struct(F.lit(label).alias("label"), F.regexp_instr(text, F.lit(pattern)).alias("start"))
        test = text.rlike(pattern)
        chain = F.when(test, row) if chain is None else chain.when(test, row)
    return let(
        chain,
        lambda hit: F.when(
            hit.isNotNull(), F.struct(hit["label"].alias("label"), call_arguments(text, hit["start"]).alias("args"))
        ),
    )


# Fixed value: an assignment, with declaration words and the PHP sigil left out.
ASSIGNMENT = r"(?:\b(?:let|const|var)\s+)?\$?([A-Za-z_][\w$]*)\s*=\s*(.+)$"


def assignment_of(line: Column) -> Column:
    """``struct<var, rhs>`` of the first assignment, null for none and for comparisons.

    The right side runs to the end of the line without trailing semicolons.
    """
    rhs = F.btrim(F.rtrim(F.regexp_extract(line, ASSIGNMENT, 2), F.lit(";")))
    row = F.struct(F.regexp_extract(line, ASSIGNMENT, 1).alias("var"), rhs.alias("rhs"))
    return F.when(line.rlike(ASSIGNMENT), let(row, lambda a: F.when(~a["rhs"].rlike("^[=><!]"), a)))


def words(text: Column) -> Column:
    """Distinct identifier-like tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_0-9][\w$]*)"), F.lit(1)))
