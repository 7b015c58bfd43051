"""Personal data by offset-preserving deobfuscation.

Base identifiers are matched in the text as it is. Then transducers rewrite a copy: look-alike characters become ASCII
and invisible ones go, spelled digits become digits, ``plus``, at and dot disguises become signs. Each rewrites the
output of the one before and carries, for every character, the source characters it stands for. Identifiers found in
the rewritten text that hold a rewritten character are added, as spans of the source, unless a base identifier of the
same kind covers them wholly: a base identifier may be no more than the undisguised rest of a longer one.

A disguise by plain words (``name at host dot org``) counts only with both words, and spelled digits only in runs of
three or more, so that prose stays as it is.

Offsets are in code points, ends exclusive. Defined cases: a null text is empty; overlapping kinds are all told;
repeated rows get equal spans; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentrel.llm.batches import slices, text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- Base identifiers ----------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits does, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
#: What holds every address and card number; long texts without digits are passed over quickly.
CHAIN = re.compile(r"[0-9][0-9. -]{6,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def identifiers(text: str) -> list[Span]:
    """Base identifiers, leftmost and without overlaps within a kind; a match that fails its test is dropped."""
    out = emails(text)
    for chain in CHAIN.finditer(text):
        for m in IP.finditer(text, *chain.span()):
            parts = [part.lstrip("0") for part in m.group().split(".")]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text, *chain.span()):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- Transducers ---------------------------------------------------------------

#: Cyrillic and Greek letters that look like Latin ones, and marks that look like ASCII marks.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαορνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "‐‑‒–—−﹣。｡․﹒﹫﹢",
        "aeopcyxijsdhqwABEKMHOPCTYXIJSaopvABEZHIKMNOPTYX" "-------....@+",
    )
)
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: The digits' names in English, German, French and Spanish.
SPELLED = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
DIGIT = {name: str(i) for names in SPELLED for i, name in enumerate(names)}
NAMES = "|".join(sorted(DIGIT, key=len, reverse=True))
GLUE = r"[ ,\-]{1,3}"
#: A word for a digit or a single digit, three or more with one word at least.
RUN = re.compile(rf"(?<![^\W_])(?:(?:plus|\+)[ ]?)?(?:(?:{NAMES}|[0-9])(?:{GLUE}|(?: dot | point |\.))){{2,}}(?:{NAMES}|[0-9])(?![^\W_])", re.I)
#: The sign of a number as a word, and words for digits that go on after a number's own digits.
PLUS = re.compile(r"(?<![^\W_])plus[ ]?(?=[0-9])", re.I)
TOUCHING = re.compile(rf"(?<=[0-9])(?:{GLUE}(?:{NAMES})){{2,}}(?![^\W_])", re.I)
PIECE = re.compile(rf"plus[ ]?|{NAMES}| dot | point |{GLUE}", re.I)
AT = r"[ ]{0,3}[(\[{<][ ]{0,3}(?:at|@)[ ]{0,3}[)\]}>][ ]{0,3}"
DOT = r"[ ]{0,3}[(\[{<][ ]{0,3}(?:dot|point|punkt|\.)[ ]{0,3}[)\]}>][ ]{0,3}"
BRACKETED = re.compile(rf"(?P<at>{AT})|(?P<dot>{DOT})", re.I)
LABEL = r"[A-Za-z0-9-]{1,63}"
WORDED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?P<at>[ ]{{1,3}}at[ ]{{1,3}}){LABEL}(?:(?:[ ]{{1,3}}dot[ ]{{1,3}}|\.){LABEL}){{0,8}}?[ ]{{1,3}}dot[ ]{{1,3}}{LABEL}(?:(?:[ ]{{1,3}}dot[ ]{{1,3}}|\.){LABEL}){{0,8}}", re.I)
SPACED_DOT = re.compile(r"[ ]{1,3}dot[ ]{1,3}", re.I)
BRACKET = re.compile(r"[(\[{<][ ]{0,3}(?:at|@|dot|point|punkt|\.)[ ]{0,3}[)\]}>]")
COUNTED = frozenset(DIGIT) | frozenset("0123456789")
BREAKS = str.maketrans(",-.", "   ")


def disguised(text: str) -> bool:
    """Whether the text may hold a disguise: a bracketed sign, a dot or plus as a word, or two digits in words side by side."""
    low = text.lower()
    if " dot " in low or " point " in low or BRACKET.search(low) or "plus" in low and PLUS.search(low):
        return True
    return b"\x01\x01" in bytes(map(COUNTED.__contains__, low.translate(BREAKS).split()))


def _folded(c: str) -> str | None:
    """The ASCII form of a look-alike, nothing for an invisible character, None for others."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and "!" <= plain <= "~":
        return plain
    digit = unicodedata.digit(c, None)
    return str(digit) if digit is not None and unicodedata.category(c) == "Nd" else None


class Folds(dict):
    """Look-alike forms of characters, found on first use."""

    def __missing__(self, c: str) -> str | None:
        self[c] = _folded(c)
        return self[c]


class Rewritten:
    """A text with, for each character, the source characters it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1
        self.changed = np.zeros(len(text), bool)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, apart); every character of a replacement stands for its whole span."""
        if not edits:
            return
        parts, columns, at = [], [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            columns.append((self.starts[at:start], self.ends[at:start], self.changed[at:start].copy()))
            if not new and end > start and len(columns[-1][2]):
                columns[-1][2][-1] = True  # what is left out counts for its neighbour
            n = len(new)
            columns.append((np.full(n, self.starts[start]), np.full(n, self.ends[end - 1]), np.ones(n, bool)))
            at = end
        parts.append(self.text[at:])
        columns.append((self.starts[at:], self.ends[at:], self.changed[at:]))
        self.text = "".join(parts)
        self.starts, self.ends, self.changed = (np.concatenate(c) for c in zip(*columns))


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in RUN.finditer(text):
        if not any(c.isalpha() for c in m.group()):
            continue
        for p in PIECE.finditer(text, *m.span()):
            word = p.group().strip().lower()
            new = "+" if word == "plus" else "." if word in ("dot", "point") else DIGIT.get(word, "")
            out.append((*p.span(), new))
    return out


def _plus_edits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "+") for m in PLUS.finditer(text)]


def _touching_edits(text: str) -> list[tuple[int, int, str]]:
    pieces = [p for m in TOUCHING.finditer(text) for p in PIECE.finditer(text, *m.span())]
    return [(*p.span(), DIGIT.get(p.group().lower(), "")) for p in pieces]


def _sign_edits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@" if m["at"] else ".") for m in BRACKETED.finditer(text)]


def _word_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in WORDED.finditer(text):
        out.append((*m.span("at"), "@"))
        out += [(*d.span(), ".") for d in SPACED_DOT.finditer(text, m.end("at") - 1, m.end())]
    return out


def rewritten(text: str, folds: Folds) -> Rewritten | None:
    """The text after all transducers; None if nothing in it is disguised."""
    odd = set() if text.isascii() else {c for c in set(text) if c > "\x7f" and folds[c] is not None}
    if not odd and not disguised(text):
        return None
    out = Rewritten(text)
    out.apply([(i, i + 1, folds[c]) for i, c in enumerate(text) if c in odd] if odd else [])
    for edits in (_plus_edits, _digit_edits, _touching_edits, _sign_edits, _word_edits):
        out.apply(edits(out.text))
    return out if len(out.text) != len(text) or out.changed.any() else None


def spans(text: str, folds: Folds) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that only the rewritten text shows."""
    base = identifiers(text)
    if (other := rewritten(text, folds)) is None:
        return base, []
    # Those of one kind do not overlap, so the last that begins in time is the one that may cover.
    taken = {kind: sorted((s, e) for k, s, e in base if k == kind) for kind in KINDS}
    added = []
    for kind, start, end in identifiers(other.text):
        s, e = int(other.starts[start:end].min()), int(other.ends[start:end].max())
        before = bisect_right(taken[kind], s, key=lambda x: x[0])
        if other.changed[start:end].any() and not (before and taken[kind][before - 1][1] >= e):
            added.append((kind, s, e))
    return base, added


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find(documents: DataFrame) -> DataFrame:
    """Per row: base counts by kind, the digest of the base spans, all spans, and how many were added."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        folds = Folds()
        for batch in slices(batches, "text"):
            columns = [[] for _ in names[1:]]
            for text in batch.column("text").to_pylist():
                base, added = spans(text, folds)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                row = (*counts, sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added))
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def masked(text: str, found: list[Span]) -> str:
    """The text with each span as ``[kind]``; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(documents: DataFrame) -> DataFrame:
    """``documents`` with all identifiers masked in ``text``; a null text stays null, other columns as they were."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def run(batches):
        folds = Folds()
        for batch in batches:
            texts = [t if t is None else masked(t, sum(spans(t, folds), [])) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return documents.mapInArrow(run, schema)
