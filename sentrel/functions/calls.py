"""Calls of a line, by column expressions: a line is cut into tokens and folded, all in the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrel.functions.labels import call_arguments, let
from sentrel.functions.text import strip

# --- Fixed values ------------------------------------------------------------
# A call: a dotted name up to its opening parenthesis.
CALLS = {
    "php": r"\$?[A-Za-z_][\w$]*(?:\s*(?:->|::)\s*\$?[A-Za-z_][\w$]*)*\s*\(",
    "javascript": r"[A-Za-z_$][\w$]*(?:\s*(?:\.|\?\.)\s*[A-Za-z_$][\w$]*)*\s*\(",
    "python": r"[A-Za-z_][\w$]*(?:\s*\.\s*[A-Za-z_][\w$]*)*\s*\(",
}
# --- end of fixed values -----------------------------------------------------

FAMILIES = {"php": "php", "javascript": "javascript", "typescript": "javascript"}
#: What is no call: a run of other characters, a name, or a sigil.
BETWEEN = r"[^A-Za-z_$]+|[A-Za-z_][\w$]*|\$"
NAME_JOINT = r"\s*(?:->|::|\?\.|\.)\s*"
#: A quoted part (to the end of the text if it stays open), a run of plain characters, or a mark.
ARGUMENT_TOKEN = r"""'[^']*'?|"[^"]*"?|`[^`]*`?|[^'"`()\[\]{},]+|[()\[\]{},]"""
CALL = "struct<name:string,args:array<string>>"


def _tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def split_arguments(text: Column) -> Column:
    """Split on commas outside quotes and brackets; empty parts are dropped."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def fold(acc: Column, token: Column) -> Column:
        cut = (token == ",") & (acc["depth"] == 0)
        change = F.when(token.isin("(", "[", "{"), 1).when(token.isin(")", "]", "}"), -1).otherwise(0)
        return F.struct(
            (acc["depth"] + change).alias("depth"),
            F.when(cut, "").otherwise(F.concat(acc["part"], token)).alias("part"),
            F.when(cut, F.array_append(acc["parts"], acc["part"])).otherwise(acc["parts"]).alias("parts"),
        )

    parts = F.aggregate(_tokens(text, ARGUMENT_TOKEN), start, fold, lambda acc: F.array_append(acc["parts"], acc["part"]))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_calls(line: Column | str, language: Column | str) -> Column:
    """``array<struct<name, args>>``: the calls of a line in order, with dotted name and argument texts.

    An argument list that does not close on the line runs to the end of the line; a null line gives null.
    """
    line, language = (F.col(c) if isinstance(c, str) else c for c in (line, language))
    tokens = _tokens(line, f"{CALLS['python']}|{BETWEEN}")
    for name, family in FAMILIES.items():
        tokens = F.when(language == name, _tokens(line, f"{CALLS[family]}|{BETWEEN}")).otherwise(tokens)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,at:int>>").alias("calls"))

    def fold(acc: Column, token: Column) -> Column:
        # ``at`` is the position of the token's last character, for a call its parenthesis.
        at = acc["at"] + F.length(token)
        call = F.struct(token.alias("token"), at.alias("at"))
        is_call = F.endswith(token, F.lit("(")) & token.rlike(r"^[A-Za-z_$]")
        return F.struct(at.alias("at"), F.when(is_call, F.array_append(acc["calls"], call)).otherwise(acc["calls"]).alias("calls"))

    def described(call: Column) -> Column:
        name = strip(F.substring(call["token"], F.lit(1), F.length(call["token"]) - 1))
        return F.struct(
            F.regexp_replace(name, NAME_JOINT, ".").alias("name"),
            let(call_arguments(line, call["at"]), split_arguments).alias("args"),
        ).cast(CALL)

    return F.transform(F.aggregate(tokens, start, fold, lambda acc: acc["calls"]), described)
