"""The few text parsers that column expressions cannot express, as Arrow-batched UDFs.

Each reads one file (or line) and returns small arrays; everything that follows, such as
call edges, ranges and taint, is joins and expressions on those arrays. Code is only
parsed, never imported or run.
"""

from __future__ import annotations

import ast
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

# Ship these helpers with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- Fixed values ------------------------------------------------------------
DYNAMIC_CALLS = ("eval", "exec", "compile")
SHELL_CALLS = ("system", "popen")
RECEIVERS = ("self", "cls", "super")
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "with", "return", "typeof", "new", "delete")
SIGNATURE_CHARS = 200
# Function shapes; the first group, when there is one, is the name.
JS_FUNCTIONS = (
    r"\bfunction\s*([A-Za-z_$][\w$]*)\s*\(",
    r"\b([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?function\s*\(",
    r"\b([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>\s*\{",
    r"\b([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?[A-Za-z_$][\w$]*\s*=>\s*\{",
    r"\b(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{",
    r"\bfunction\s*\([^)]*\)\s*\{",
    r"\((?:[^)]*)\)\s*=>\s*\{",
    r"[A-Za-z_$][\w$]*\s*=>\s*\{",
)
NAMED_FUNCTION = r"(?i)\bfunction\s+(\w+)\s*\("
PHP_FUNCTIONS = (
    r"\bfunction\s*(?:&\s*)?([A-Za-z_][\w]*)\s*\(",
    r"\b([A-Za-z_$][\w$]*)\s*=\s*function\s*\(",
)
# --- end of fixed values -----------------------------------------------------


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_INT, _TEXT, _FLAG, _TEXTS = IntegerType(), StringType(), BooleanType(), ArrayType(StringType())
EVENT = _struct(line_no=_INT, seq=_INT, message=_TEXT)
FUNCTION = _struct(
    qualname=_TEXT, name=_TEXT, kind=_TEXT, start_line=_INT, end_line=_INT,
    params=_TEXTS, signature=_TEXT, calls=_TEXTS, decorators=_TEXTS,
)
IMPORT = _struct(line_no=_INT, text=_TEXT, names=_TEXTS, side_effect=_FLAG)
SYMBOL = _struct(local=_TEXT, original=_TEXT, module=_TEXT, level=_INT)
PYTHON_UNIT = _struct(
    parsed=_FLAG, functions=ArrayType(FUNCTION), imports=ArrayType(IMPORT), symbols=ArrayType(SYMBOL), events=ArrayType(EVENT)
)
SPAN = _struct(name=_TEXT, start_line=_INT, end_line=_INT)


def parse_or_none(text: str | None) -> ast.Module | None:
    if text is None:
        return None
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def dotted_name(node: ast.expr) -> str:
    """``a.b.c`` of a call target; a self-like receiver or a computed base is left out."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    if isinstance(node, ast.Name) and not (parts and node.id in RECEIVERS):
        parts.insert(0, node.id)
    return ".".join(parts)


def preorder(node: ast.AST) -> Iterator[ast.AST]:
    """All descendants in source order, without recursion."""
    stack = list(ast.iter_child_nodes(node))[::-1]
    while stack:
        current = stack.pop()
        yield current
        stack.extend(list(ast.iter_child_nodes(current))[::-1])


def events_of(text: str | None) -> list[tuple[int, int, str]]:
    tree = parse_or_none(text)
    return _events(preorder(tree)) if tree else []


def _events(nodes: Iterator[ast.AST]) -> list[tuple[int, int, str]]:
    """Line, number and message of each dangerous call, in source order."""
    found: list[tuple[int, int, str]] = []
    for node in nodes:
        if not isinstance(node, ast.Call):
            continue
        target = node.func
        name = getattr(target, "id", None) if isinstance(target, ast.Name) else getattr(target, "attr", None)
        message = None
        if name in DYNAMIC_CALLS:
            message = f"dynamic execution via {name}"
        elif name in SHELL_CALLS:
            message = f"shell execution via {name}"
        elif name == "loads" and isinstance(target, ast.Attribute) and getattr(target.value, "id", None) == "pickle":
            message = "unsafe pickle deserialization"
        if message:
            found.append((node.lineno, len(found), message))
    return found


EVENT_KEYS = tuple(EVENT.names)


@F.pandas_udf(ArrayType(EVENT))
def _code_events(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(EVENT_KEYS, e, strict=True)) for e in events_of(t)])


EVENT_WORDS = "|".join((*DYNAMIC_CALLS, *SHELL_CALLS, "loads"))


def code_events(text: Column | str, where: Column | None = None) -> Column:
    """Dangerous calls of a Python text as ``array<struct<line_no, seq, message>>``.

    Only texts that contain one of the watched names are sent to Python.
    """
    text = F.col(text) if isinstance(text, str) else text
    test = text.rlike(EVENT_WORDS)
    return _code_events(F.when(test if where is None else where & test, text))


def python_unit(text: str | None) -> dict:
    """All functions, imports, imported symbols and dangerous calls of a text, from one parse.

    Definitions that share a qualified name differ by their start line.
    """
    tree = parse_or_none(text)
    if tree is None:
        return {"parsed": False, "functions": [], "imports": [], "symbols": [], "events": []}
    lines = text.splitlines()

    def source(node: ast.AST) -> str:
        return "\n".join(lines[node.lineno - 1 : node.end_lineno])

    functions, imports, symbols = [], [], []
    stack: list[tuple[ast.AST, tuple[str, ...], bool]] = [(tree, (), False)]
    while stack:
        node, scope, in_class = stack.pop()
        if isinstance(node, ast.Import | ast.ImportFrom):
            whole = isinstance(node, ast.ImportFrom)
            names = [a.asname or (a.name if whole else a.name.partition(".")[0]) for a in node.names]
            for a, local in zip(node.names, names, strict=True):
                module, original, level = (node.module, a.name, node.level) if whole else (a.name, None, 0)
                symbols.append({"local": local, "original": original, "module": module or "", "level": level})
            imports.append(
                {"line_no": node.lineno, "text": source(node).strip(), "names": names, "side_effect": False}
            )
        elif isinstance(node, ast.ClassDef):
            scope, in_class = (*scope, node.name), True
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            scope = (*scope, node.name)
            called = {dotted_name(n.func) for n in preorder(node) if isinstance(n, ast.Call)}
            functions.append(
                {
                    "qualname": ".".join(scope),
                    "name": node.name,
                    "kind": "method" if in_class else "function",
                    "start_line": node.lineno,
                    "end_line": node.end_lineno,
                    "params": [a.arg for a in node.args.args],
                    "signature": lines[node.lineno - 1].strip()[:SIGNATURE_CHARS],
                    "calls": sorted(called - {""}),
                    "decorators": [source(d).strip() for d in node.decorator_list],
                }
            )
        stack.extend((child, scope, in_class) for child in list(ast.iter_child_nodes(node))[::-1])
    events = [dict(zip(EVENT_KEYS, e, strict=True)) for e in _events(preorder(tree))]
    return {"parsed": True, "functions": functions, "imports": imports, "symbols": symbols, "events": events}


@F.pandas_udf(PYTHON_UNIT)
def python_units(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([python_unit(t) for t in texts], columns=PYTHON_UNIT.names)


def brace_spans(stripped: str | None, language: str | None) -> list[dict]:
    """Named line ranges of JS/TS/PHP functions in text without comments and literals.

    A candidate that starts at or before an earlier hit and ends inside it is skipped, and so is one inside an earlier
    hit of its own name. Other definitions that share a name are all told.
    """
    if not stripped or language not in ("javascript", "typescript", "php"):
        return []
    breaks = [m.start() for m in re.finditer("\n", stripped)]
    closing: dict[int, int] = {}
    opened: list[int] = []
    for brace in re.finditer(r"[{}]", stripped):
        if brace.group() == "{":
            opened.append(brace.start())
        elif opened:
            closing[opened.pop()] = brace.start()

    scripted = language != "php"
    furthest = np.zeros(len(breaks) + 3, dtype=np.int64)  # start line -> largest end line so far
    spans: list[tuple[str, int, int]] = []
    before: dict[str, tuple[list[int], list[int]]] = {}  # per name: starts of earlier patterns' hits, largest end up to each
    for pattern in JS_FUNCTIONS if scripted else PHP_FUNCTIONS:
        here: dict[str, int] = {}  # per name: largest end of this pattern's hits, which come by start
        for match in re.finditer(pattern, stripped):
            name = match.group(1) if match.re.groups else None
            opening = stripped.find("{", match.start())
            if opening < 0 or (scripted and name in CONTROL_WORDS):
                continue
            end_at = closing.get(opening, len(stripped) - 1)
            if end_at <= opening:
                continue
            start = bisect_right(breaks, match.start() - 1) + 1
            end = bisect_right(breaks, end_at - 1) + 1
            if furthest[start : end + 1].max() >= end:
                continue
            furthest[start] = max(furthest[start], end)
            name = name or f"callback_{start}"
            starts, ends = before.get(name, ([], []))
            at = bisect_right(starts, start)
            if here.get(name, 0) >= end or at and ends[at - 1] >= end:
                continue
            here[name] = max(here.get(name, 0), end)
            spans.append((name, start, end))
        before = _furthest_ends(spans)
    return [{"name": n, "start_line": s, "end_line": e} for n, s, e in spans]


def _furthest_ends(spans: list[tuple[str, int, int]]) -> dict[str, tuple[list[int], list[int]]]:
    """Per name the starts in order, and the largest end of the spans up to each."""
    out: dict[str, tuple[list[int], list[int]]] = {}
    for name, start, end in sorted(spans):
        starts, ends = out.setdefault(name, ([], []))
        starts.append(start)
        ends.append(max(end, ends[-1]) if ends else end)
    return out


@F.pandas_udf(ArrayType(SPAN))
def function_spans(stripped: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([brace_spans(t, lang) for t, lang in zip(stripped, language, strict=True)], dtype=object)


class Blocks:
    """Ends of brace blocks of one text, found for every opening brace in one walk from the end.

    A block is read with no quote open at its opening brace, wherever earlier quotes leave off; a quote mark opens a
    literal up to the next mark of its kind. A walk that starts outside literals and one that starts inside a kind of
    them change places at each mark of that kind. So for each of the four states one pointer to the next brace read in
    it is enough: a mark swaps two pointers, a brace is a node of the outside state.
    """

    def __init__(self, text: str):
        self.size = len(text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.arrows = [m.start() for m in re.finditer("=>", text)]
        self.opens: list[int] = []
        self.ends: dict[int, int] = {}  # opening brace -> its closing brace, the last character when none closes it
        self._match_braces(text)
        bodies = {m.start(): m.end() - 1 for m in re.finditer(r"\)\s*\{", text)}
        parens = [m.start() for m in re.finditer(r"\)", text)]
        self.functions: list[int] = []
        self.bodies: list[int] = []  # per unnamed function with a body: its opening brace
        for m in re.finditer(r"\bfunction\s*\(", text):
            at = bisect_left(parens, m.end())
            if at < len(parens) and parens[at] in bodies:
                self.functions.append(m.start())
                self.bodies.append(bodies[parens[at]])

    def _match_braces(self, text: str) -> None:
        following: dict[str, int] = dict.fromkeys(("", '"', "'", "`"), -1)  # state -> next brace read in it
        closer: dict[int, int] = {-1: -1}  # brace -> first closing brace from there on that has no opening one
        after: dict[int, int] = {}  # closing brace -> the brace read next
        for token in reversed(list(re.finditer(r"[\"'`{}]", text))):
            char, at = token.group(), token.start()
            if char == "}":
                closer[at], after[at], following[""] = at, following[""], at
            elif char == "{":
                end = closer[following[""]]
                self.opens.append(at)
                self.ends[at] = end if end >= 0 else self.size - 1
                closer[at] = closer[after[end]] if end >= 0 else -1
                following[""] = at
            else:
                following[""], following[char] = following[char], following[""]
        self.opens.reverse()

    def end_line(self, start_line: int) -> int | None:
        """Last line of the handler block that opens at or after a line, null when none opens.

        The block is the first brace after ``=>``, else that of the first unnamed ``function (...) {``.
        """
        begin = self.breaks[start_line - 2] + 1 if start_line > 1 else 0
        opening = self._from(self.opens, self.opens, self._from(self.arrows, self.arrows, begin))
        if opening is None:
            opening = self._from(self.functions, self.bodies, begin)
        if opening is None:
            return None
        return start_line + bisect_left(self.breaks, self.ends[opening]) - bisect_left(self.breaks, begin)

    @staticmethod
    def _from(places: list[int], values: list[int], begin: int | None) -> int | None:
        at = len(places) if begin is None else bisect_left(places, begin)
        return values[at] if at < len(places) else None


def block_end(text: str, start_line: int) -> int | None:
    return Blocks(text).end_line(start_line)


def handler_lines(text: str, starts: Sequence[int], names: Sequence[str | None]) -> list[int | None]:
    """Per route the first line of the function it names, else the last line of the block that opens after it.

    A name stands for the function of that name in any case, and gives null where the text has none.
    """
    first: dict[str, int] = {}
    if any(name is not None for name in names):
        for number, line in enumerate(text.split("\n"), 1):
            for found in re.finditer(NAMED_FUNCTION, line, re.ASCII):
                first.setdefault(found.group(1).lower(), number)
    blocks = Blocks(text) if any(name is None for name in names) else None
    return [blocks.end_line(s) if n is None else first.get(n.lower()) for s, n in zip(starts, names, strict=True)]


@F.pandas_udf(ArrayType(IntegerType()))
def lines_of_handlers(texts: pd.Series, starts: pd.Series, names: pd.Series) -> pd.Series:
    """``handler_lines`` for the routes of each text; null for a null text."""
    return pd.Series(
        [None if t is None else handler_lines(t, [int(s) for s in lines], n) for t, lines, n in zip(texts, starts, names, strict=True)],
        dtype=object,
    )
