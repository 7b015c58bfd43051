"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens place each turn in a window: the budget, less the system turn and the history, is
the step of a grid, shortened by the longest turn that still leaves half of it, and a turn belongs to the window in
which it ends. So no window goes over the budget unless a single turn is longer than half of the room, which
``over_budget`` tells. Each window starts with the system turn (turn 0 of role ``system``) and with whole turns before
its span, as many as fit the history; these repeats are masked, so that every assistant text is a target once.

A turn is ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts get a backslash after their
first character, in front of any backslashes there, and lose it on reading: formatting is reversible for all texts.

Tokens are words and single marks, counted in the engine. A window is a row: ``conv_id``, ``window``, ``text``,
``n_tokens``, ``n_repeated`` (leading turns that are repeats), ``targets`` (start and end of each target in code points,
end exclusive) and ``over_budget``.

Defined cases: null text or role is empty; turns of equal number are ordered by role and text, a null turn is first;
a null ``conv_id`` is a conversation; a conversation without assistant turns has no targets; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.llm.batches import stored

BUDGET, HISTORY = 512, 128
#: Windows of a conversation to which one row carries the system turn.
BLOCK = 1024
#: Characters of a conversation's windows that are put together in one value; a character takes up to four bytes of 2 GB.
ONE_VALUE = 1 << 28
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The template's own marks and control strings of common vocabularies and templates.
CONTROL = (
    r"\|turn\|>", r"\|text\|>", r"\|end\|>", r"\|endoftext\|>", r"\|startoftext\|>", r"\|im_start\|>", r"\|im_end\|>",
    r"s>", r"/s>", r"unk>", r"pad>", r"<SYS>>", r"</SYS>>", r"INST\]", r"/INST\]",
)
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={'|'.join(CONTROL)})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={'|'.join(CONTROL)})", "$1$2")


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """The turns with ``pos``, which numbers them in their order, stored.

    They are dealt by ranges of their sort keys, so a conversation may lie in many parts; of a text only its beginning
    takes part, as the bounds of the ranges go through the driver.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    rows = rows.repartitionByRange(*keys, F.substring("text", 1, 32).asc()).sortWithinPartitions(*keys, F.col("text").asc())
    tokens = n_tokens(F.col("text")) + 4  # three marks and the role
    return stored(rows.select("conv_id", F.monotonically_increasing_id().alias("pos"), "role", "text", tokens.alias("tokens")), "turns")


def placed_turns(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn, without its text, with its window: running sums in chunks of a conversation, then the chunks' offsets.

    ``span`` numbers the windows of a conversation from 1 to ``last``; ``opens`` marks the first turn of each.
    """
    own = Window.partitionBy("conv_id")
    before = own.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "chunk").orderBy("pos")
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunk = F.shiftright("pos", 33).alias("chunk")  # the part of the stored turns
    rows = turns.select("conv_id", "pos", chunk, (F.col("role") == "system").alias("system"), "tokens")
    rows = rows.withColumns({"n": F.row_number().over(inside).cast("long"), "done": F.sum("tokens").over(up_to)})
    head = F.col("n") == 1
    chunks = rows.groupBy("conv_id", "chunk").agg(
        F.count("*").alias("rows"),
        F.sum("tokens").alias("total"),
        F.max("tokens").alias("longest"),
        F.max(F.when(head, 0).otherwise(F.col("tokens"))).alias("rest"),
        F.max(F.when(head & F.col("system"), F.col("tokens")).otherwise(0)).alias("system_head"),
    )
    chunks = chunks.withColumns(
        {"n_before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "done_before": F.coalesce(F.sum("total").over(before), F.lit(0))}
    )
    led = (F.col("n_before") == 0) & (F.col("system_head") > 0)
    chunks = chunks.select(
        "conv_id", "chunk", "n_before", "done_before",
        F.max(F.when(led, F.col("system_head")).otherwise(0)).over(own).alias("system_tokens"),
        F.max(F.when(led, F.col("rest")).otherwise(F.col("longest"))).over(own).alias("longest"),
    )
    room = F.greatest(F.lit(budget) - history - F.col("system_tokens"), F.lit(2))
    step = F.greatest(room - F.col("longest") + 1, F.floor((room + 1) / 2))
    rows = _same(rows, chunks.withColumn("step", step), "conv_id", "chunk")
    rows = rows.withColumns(
        {"n": F.col("n") + F.col("n_before"), "done": F.col("done") + F.col("done_before") - F.col("system_tokens")}
    ).withColumn("system", F.col("system") & (F.col("n") == 1))
    # Sums grow from turn to turn, so the place of the turn before follows from this turn's start.
    place = lambda done: F.greatest(F.floor((done - 1) / F.col("step")), F.lit(0))
    opens = (F.col("n") == 1) | (place(F.col("done")) != place(F.col("done") - F.col("tokens")))
    rows = rows.select("conv_id", "pos", "chunk", "n", "system", "tokens", "done", opens.alias("opens"))
    rows = rows.withColumn("span", F.sum(F.col("opens").cast("long")).over(up_to))
    counts = rows.groupBy("conv_id", "chunk").agg(F.max("span").alias("spans"))
    counts = counts.select(
        "conv_id", "chunk", F.coalesce(F.sum("spans").over(before), F.lit(0)).alias("span_before"), F.sum("spans").over(own).alias("last")
    )
    rows = _same(rows, counts, "conv_id", "chunk").withColumn("span", F.col("span") + F.col("span_before"))
    return rows.select("conv_id", "pos", "n", "system", "tokens", "done", "opens", "span", "last")


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of all conversations."""
    turns = ordered_turns(conversations)
    placed = stored(placed_turns(turns, budget, history), "places")
    texts = turns.select("pos", "role", "text")
    shown = ["conv_id", "pos", "n", "tokens"]
    new = placed.select(*shown, "span", F.lit(False).alias("repeated"))
    # A turn is repeated in later windows as long as the tokens from its start to the window's first turn fit the history.
    # Spans are few per turn, as each later span is at least one turn of four tokens.
    later = placed.filter(~F.col("system")).withColumn("left", F.lit(history) - F.col("tokens")).filter("left >= 0")
    reach = F.least(F.col("span") + 1 + F.floor(F.col("left") / 4), F.col("last"))
    later = later.withColumn("last", reach).filter(F.col("last") > F.col("span"))
    later = later.withColumn("target_span", F.explode(F.sequence(F.col("span") + 1, F.col("last")))).drop("span")
    first = (F.col("done") - F.col("tokens")).alias("first")
    later = _same(later, placed.filter("opens").select("conv_id", F.col("span").alias("target_span"), first), "conv_id", "target_span")
    later = later.filter(F.col("first") - (F.col("done") - F.col("tokens")) <= history)
    later = later.select(*shown, F.col("target_span").alias("span"), F.lit(True).alias("repeated"))
    every = new.unionByName(later).join(texts, "pos")
    # The system turn is in every window; blocks of windows deal out those of one conversation.
    system = placed.filter("system and last > 1").select(*shown, "last").join(texts, "pos")
    system = system.withColumn("block", F.explode(F.sequence(F.lit(2).cast("long"), F.col("last"), F.lit(BLOCK).cast("long"))))
    system = system.repartition("conv_id", "block")
    span = F.explode(F.sequence(F.col("block"), F.least(F.col("block") + BLOCK - 1, F.col("last"))))
    system = system.withColumn("span", span).withColumn("repeated", F.lit(True))
    return _rendered(every.unionByName(system.select(*every.columns)), budget)


def _same(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """An inner join in which a null key equals a null key."""
    renamed = right.withColumnRenamed(key, "__key").withColumnRenamed(other, "__other")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col(other) == F.col("__other"))
    return left.join(renamed, same).drop("__key", "__other")


def _rendered(turns: DataFrame, budget: int) -> DataFrame:
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    turns = turns.withColumns({"head": head, "body": escape(F.col("text"))})
    part = F.struct("n", "head", "body", "tokens", "repeated", ((F.col("role") == "assistant") & ~F.col("repeated")).alias("target"))
    windows = turns.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    # Running offsets: the start of each part is the sum of the lengths before it.
    length = lambda p: F.length(p.head) + F.length(p.body) + len(END)
    starts = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, p: F.struct(
            (acc.at + length(p)).alias("at"),
            F.when(
                p.target,
                F.concat(
                    acc.out,
                    F.array(F.struct((acc.at + F.length(p.head)).alias("start"), (acc.at + F.length(p.head) + F.length(p.body)).alias("end"))),
                ),
            )
            .otherwise(acc.out)
            .alias("out"),
        ),
        lambda acc: acc.out,
    )
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p.tokens)
    return windows.select(
        "conv_id",
        (F.col("span") - 1).cast("long").alias("window"),
        F.concat_ws("", F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(END)))).alias("text"),
        total.alias("n_tokens"),
        F.size(F.filter("parts", lambda p: p.repeated)).alias("n_repeated"),
        starts.alias("targets"),
        (total > budget).alias("over_budget"),
    )


def _parts() -> Column:
    return F.slice(F.split("text", r"\Q" + TURN + r"\E"), 2, F.lit(2**30))


def _role_of(part: Column) -> Column:
    return unescape(F.substring_index(part, TEXT, 1))


def _text_of(part: Column) -> Column:
    body = F.substring_index(part, TEXT, -1)
    return unescape(body.substr(F.lit(1), F.length(body) - len(END)))


def parse_windows(windows: DataFrame) -> DataFrame:
    """The turns of windows, read from their text: ``conv_id``, ``window``, ``n``, ``role``, ``text``, ``repeated``."""
    rows = windows.select("conv_id", "window", "n_repeated", F.posexplode(_parts()).alias("n", "part"))
    return rows.select(
        "conv_id", "window", "n", _role_of(F.col("part")).alias("role"), _text_of(F.col("part")).alias("text"),
        (F.col("n") < F.col("n_repeated")).alias("repeated"),
    )


def window_digests(windows: DataFrame, limit: int = ONE_VALUE) -> DataFrame:
    """Per conversation, read back from its windows: turns, their digest, the text under the loss mask and its digest.

    A digest takes its texts in order. The pieces of a conversation, one for each window, are put together in the engine. A
    conversation of more than ``limit`` characters of windows could exceed what one value holds: its pieces stream
    through a task, sorted, row by row, through a running digest, which engines have not, in Python. Without such a
    conversation that part is not in the plan.
    """
    windows = stored(windows, "windows")
    sizes = windows.groupBy("conv_id").agg(F.sum(F.length("text").cast("long")).alias("chars"))
    large = stored(sizes.filter(F.col("chars") > limit).select("conv_id"), "large")
    if large.isEmpty():
        return _joined_digests(windows)
    same = windows["conv_id"].eqNullSafe(large["conv_id"])
    small = windows.join(large, same, "left_anti")
    return _joined_digests(small).unionByName(streamed_digests(windows.join(large, same, "left_semi")))


def _own_lines() -> Column:
    """The turns of a window that are no repeats, as lines."""
    own = F.slice(_parts(), F.col("n_repeated") + 1, F.lit(2**30))
    return F.transform(own, lambda p: F.concat(_role_of(p), F.lit("\n"), _text_of(p), F.lit("\n")))


def _under_mask() -> Column:
    return F.concat_ws("", F.transform("targets", lambda t: unescape(F.col("text").substr(t.start + 1, t.end - t.start))))


def _joined_digests(windows: DataFrame) -> DataFrame:
    rows = windows.select("conv_id", "window", F.length("text").cast("long").alias("chars"), _own_lines().alias("lines"), _under_mask().alias("under"))
    rows = rows.select("conv_id", "chars", F.size("lines").cast("long").alias("n"), F.struct("window", F.array_join("lines", "").alias("lines"), "under").alias("piece"))
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    turns, loss = F.array_join("pieces.lines", ""), F.array_join("pieces.under", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def streamed_digests(windows: DataFrame) -> DataFrame:
    """The same for conversations of any length; no row holds more than one turn or one window's targets."""
    entry = lambda n, line: F.struct(n.cast("int").alias("n"), line.alias("line"))
    lines = F.transform(_own_lines(), lambda line, i: entry(i, line))
    rows = windows.select(
        "conv_id", "window", F.length("text").cast("long").alias("chars"),
        F.explode(F.concat(F.array(entry(F.lit(-1), _under_mask())), lines)).alias("e"),
    )
    line = F.col("e.line")
    rows = rows.select("conv_id", "window", "e.n", "chars", F.length(line).cast("long").alias("size"), line.cast("binary").alias("line"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window", "n")
    kind = windows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(_digests, schema)


def _digests(batches):
    """Digests of rows that are sorted by ``conv_id``, ``window`` and ``n``; the row -1 of a window holds its targets."""
    at = None

    def told(done: list[list], kind: pa.DataType) -> pa.RecordBatch:
        ids, n, turns, chars, loss, formatted = zip(*done)
        numbers = [pa.array(x, pa.int64()) for x in (n, chars, formatted)]
        texts = [pa.array([d.hexdigest() for d in x], pa.string()) for x in (turns, loss)]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), numbers[0], texts[0], numbers[1], texts[1], numbers[2]], names=names)

    kind = None
    for batch in batches:
        kind, done = batch.column("conv_id").type, []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "n", "chars", "size", "line"))
        for conv_id, n, chars, size, line in zip(*columns):
            if at is None or at[0] != conv_id:
                if at is not None:
                    done.append(at)
                at = [conv_id, 0, sha256(), 0, sha256(), 0]
            if n < 0:
                at[3] += size
                at[4].update(line)
                at[5] += chars
            else:
                at[1] += 1
                at[2].update(line)
        if done:
            yield told(done, kind)
    if at is not None:
        yield told([at], kind)
