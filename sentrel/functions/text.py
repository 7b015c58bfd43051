"""Text columns: decoding, lines, paths, redaction and ids.

All of these are plain column expressions, so they stay in the JVM and fuse into
whatever projection uses them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrel.functions.labels import let

# --- Fixed values ------------------------------------------------------------
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
OTHER_BREAKS = ("\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
NOT_A_BREAK = "[^\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SNIPPET_CHARS = 500
SECRET_VALUE = (
    r"(?i)(secret|token|password|passwd|api[_-]?key|authorization)"
    r"(\s*[:=]\s*)([\"']?)([^\"'\s,;]+)"
)
VENDOR_TOKEN = r"(?i)\b(ghp_|github_pat_|sk_live_|AKIA[0-9A-Z]{12,})[A-Za-z0-9_-]+"
REDACTED = "[REDACTED]"
LANGUAGE_SUFFIXES = {
    "python": (".py", ".pyw"),
    "javascript": (".js", ".mjs", ".cjs", ".jsx"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "php": (".php", ".php5", ".php7", ".phtml"),
}
# --- end of fixed values -----------------------------------------------------


def decode_utf8(content: Column) -> Column:
    """Bytes to text; malformed sequences become U+FFFD instead of failing the job."""
    return F.make_valid_utf8(content.cast("string"))


def split_lines(text: Column) -> Column:
    """Lines of a text as an array; a final line break does not open another line."""
    # Only a text with other breaks than line feeds needs the pattern; looking for these is cheaper than the pattern.
    others = F.lit(False)
    for mark in OTHER_BREAKS:
        others = others | F.contains(text, F.lit(mark))
    pieces = F.when(others, F.split(text, LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1))
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def strip(col: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def redact(line: Column) -> Column:
    """Mask secret values, then trim and cut to the snippet length."""
    masked = F.regexp_replace(line, SECRET_VALUE, "$1$2$3" + REDACTED)
    masked = F.regexp_replace(masked, VENDOR_TOKEN, REDACTED)
    return F.substring(strip(masked), 1, SNIPPET_CHARS)


def finding_id(prefix: str | Column, *parts: Column) -> Column:
    """``prefix`` plus the first 16 hex digits of SHA-256 over the ``:``-joined parts."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    key = F.concat_ws(":", *[part.cast("string") for part in parts])
    return F.concat(head, F.substring(F.sha2(key, 256), 1, 16))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; dot files and names ending in a dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]+)$", 1))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda part: part != "")


def detect_language(path: Column) -> Column:
    """Language of a path by suffix, null when unsupported."""
    ext = suffix(path)
    chain = None
    for language, suffixes in LANGUAGE_SUFFIXES.items():
        test = ext.isin(*suffixes)
        chain = F.when(test, language) if chain is None else chain.when(test, language)
    return chain


def strip_code(text: Column, language: Column) -> Column:
    """Blank out comments and string literals, keeping every line break.

    The passes run in this order: block comments, line comments, ``#`` comments
    (PHP only), then back-quoted, single-quoted and double-quoted literals. A blanked
    span leaves one blank plus its own line breaks, so later line numbers do not move.
    """

    def blank_spans(col: Column, mark: str, whole: str) -> Column:
        def blanked(out: Column, gone: Column) -> Column:
            return F.array_join(
                F.zip_with(
                    F.split(out, whole, -1),
                    F.transform(gone, lambda span: F.concat(F.lit(" "), F.regexp_replace(span, NOT_A_BREAK, ""))),
                    lambda kept, filler: F.concat(kept, F.coalesce(filler, F.lit(""))),
                ),
                "",
            )

        def spans(out: Column) -> Column:
            found = F.regexp_extract_all(out, F.lit(f"({whole})"), F.lit(1))
            return let(found, lambda gone: F.when(F.size(gone) == 0, out).otherwise(blanked(out, gone)))

        # Each pass reads the one before it several times; as a variable that is evaluated once, not once per reading and pass.
        return let(col, lambda out: F.when(F.contains(out, F.lit(mark)), spans(out)).otherwise(out))

    out = blank_spans(text, "/*", "/\\*(?s:.*?)\\*/")
    out = F.regexp_replace(out, "(?m)//.*$", " ")
    out = F.when(language == "php", F.regexp_replace(out, "(?m)#.*$", " ")).otherwise(out)
    for quote in ("`", "'", '"'):
        # The literal ends at its first unescaped quote; when there is none, at the last
        # quote of the text. Possessive loops keep the matcher's stack flat on long literals.
        closed = f"{quote}(?:[^{quote}\\\\]++|\\\\.|\\\\(?=[\\n\\r]))*+{quote}"
        out = blank_spans(out, quote, f"{closed}|{quote}(?s:.*){quote}")
    return out
