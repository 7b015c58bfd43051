"""The rule scan for large rule sets: a table of literals that lines meet by an equi join.

``pattern_scan`` writes all patterns into one expression, which is fastest for some dozens and too large for thousands.
Here the rules are tables. A pattern needs one of its literals (``prefilter.required_literals``), a literal needs one of its
grams of three characters; a line is joined with the literals on its grams, then tested for the whole literal, then for the
pattern. The plan is the same for any number of rules, and only hits are shuffled.

The tables have a row per gram, literal and pattern, per pattern and per rule; they come from a rule set of
``MAX_RULES`` checks at most, which the driver holds anyway, and are broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.catalogue import Rule
from sentrel.functions.prefilter import required_literals

GRAM = 3
EVENT_ORDER = -1  # a code event outranks every pattern


def literal_rows(patterns: Sequence[str]) -> list[tuple[str, str, int]]:
    """``(gram, literal, number of the pattern)``.

    Of a literal's grams the one that fewest literals have is taken. A literal shorter than a gram is its own gram; a
    pattern that needs no literal has an empty one, which every line holds.
    """
    needed = [required_literals(p) or ("",) for p in patterns]
    grams = {text: [text[i : i + GRAM] for i in range(max(1, len(text) - GRAM + 1))] for texts in needed for text in texts}
    shared = Counter(gram for own in grams.values() for gram in set(own))
    chosen = {text: min(own, key=lambda gram: shared[gram]) for text, own in grams.items()}
    return [(chosen[text], text, at) for at, texts in enumerate(needed) for text in texts]


def line_grams(lowered: Column, sizes: Sequence[int]) -> Column:
    """All grams of the given sizes that a line holds, each once."""
    parts = [F.array(F.lit("")) if k == 0 else F.regexp_extract_all(lowered, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in sizes]
    return F.array_distinct(F.concat(*parts))


def _small(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def pattern_join(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows of ``pattern_scan``, for rules whose patterns compile.

    Lines equal in tree, path, number and text are told once; a null line has no hit.
    """
    spark = lines.sparkSession
    patterns = list(dict.fromkeys(p for rule in rules for p in rule.patterns))
    number = {pattern: at for at, pattern in enumerate(patterns)}
    entries = literal_rows(patterns)
    literals = _small(spark, entries, "gram string, literal string, pattern_id int")
    table = _small(spark, list(enumerate(patterns)), "pattern_id int, pattern string")
    uses = [
        (number[p], rule.check_id, order, list(rule.exclude_patterns)) for rule in rules for order, p in enumerate(rule.patterns)
    ]
    uses = _small(spark, uses, "pattern_id int, check_id string, place int, excluding array<string>")
    sizes = sorted({len(gram) for gram, _, _ in entries}) or [GRAM]

    lowered = lines.select("repo", "path", "line_no", "line", F.lower("line").alias("lowered"))
    met = lowered.withColumn("gram", F.explode(line_grams(F.col("lowered"), sizes))).join(literals, "gram")
    met = met.filter(F.contains("lowered", F.col("literal"))).join(table, "pattern_id").filter(F.regexp("line", F.col("pattern")))
    excluded = F.exists("excluding", lambda p: F.regexp(F.col("line"), p))
    key = ["repo", "path", "line_no", "line", "check_id"]
    hits = met.join(uses, "pattern_id").filter(~excluded).select(*key, "place", F.lit(0).alias("seq"), F.col("pattern").alias("rule"))
    if "events" in lines.columns:
        hits = hits.unionByName(_event_hits(lines, rules, key))
    # The first pattern in list order, or the last wanted event of the line.
    best = hits.groupBy(*key).agg(F.min_by("rule", F.struct("place", -F.col("seq"))).alias("rule"))
    return best.select(*key, "rule")


def _event_hits(lines: DataFrame, rules: Sequence[Rule], key: list[str]) -> DataFrame:
    """Code events of lines for the rules that ask for them; a rule without a list, written as an empty message, takes all."""
    watched = [(message, rule.check_id) for rule in rules if rule.kind == "ast_or_regex" for message in rule.code_events or ("",)]
    wanted = _small(lines.sparkSession, watched, "asked string, check_id string")
    rows = lines.select("repo", "path", "line_no", "line", F.posexplode("events").alias("seq", "event"))
    rows = rows.filter(F.col("event.line_no") == F.col("line_no"))
    asked = rows.withColumn("asked", F.explode(F.array_distinct(F.array(F.lit(""), F.col("event.message")))))
    return asked.join(wanted, "asked").select(*key, F.lit(EVENT_ORDER).alias("place"), "seq", F.col("event.message").alias("rule"))
