"""Conversation structure repair by a shortest path over big-integer weights.

The roles of a repaired conversation have the initials ``(s?(ua)+)?``. Each row is kept, gets another role or is
deleted, and empty turns may be inserted anywhere. The path through the states of that pattern is an ordinary
minimum over integers: the high digits of a weight carry the cost, its low digits, one of fixed width for each place,
the letters of the edits in order, with zeros after the last. So one comparison of integers decides cost and, at equal
cost, the audit string that is least in ASCII.

A conversation may lie in many chunks of at most ``CHUNK`` rows. A chunk's least costs from state to state are a small
matrix; a fold over the matrices of a conversation from its end gives the costs behind each chunk, from which the chunk
finds its own letters. That is exact: between two states, the letters of a chunk hold one edit for each row and end with
a row's edit, so neither of two candidates is the beginning of the other and later letters never decide. The fold holds
16 numbers for each chunk, that is 250,000 of them for a conversation of 10^9 rows. Texts are read twice: when rows are put in order,
and when they stream, sorted, through the digest of the repaired conversation, a row at a time.

Faults of a row, the first of them counts: blank (nothing but ASCII white space), duplicate (role and text stood earlier
in the conversation), truncated (the last other character is not one of ``.!?``).

Defined cases: null role or text is one space, so such a text is blank and such a role fits nowhere; null turns come
first; rows of equal turn are ordered by role, then by the first 64 characters of the text, then by its hash; repeated
rows are duplicates; a null ``conv_id`` is a conversation; an empty table has no conversations; other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.llm.batches import stored

CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS
WHITE = r"[\x20\x09-\x0D]"
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTING = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of edits; an undeleted truncated row costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Letters in the order of ASCII; zero is the padding behind the last one.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {digit: letter for letter, digit in DIGITS.items()}
WIDTH = 3
#: A pair of inserted turns leaves the state as it was, so no more than two stand together on a shortest path.
INSERTED = 2
#: What no path reaches; sums of it stay below 2^63.
FAR = 1 << 50


def edits(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of each edit of a row."""
    yield "D", DELETE, state
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if initial in MOVES[state]:
            yield "K", more, MOVES[state][initial]
        for role in ROLES:
            if role in MOVES[state]:
                yield "R", REROLE + more, MOVES[state][role]


def inserts(state: int) -> Iterator[int]:
    """The next state of each insertion."""
    return (MOVES[state][role] for role in ROLES if role in MOVES[state])


def final_costs() -> list[int]:
    """The cost of ending a conversation in each state: what has to be inserted, if anything."""
    costs = [0 if s in ACCEPTING else FAR for s in STATES]
    for _ in range(INSERTED):
        costs = [min([costs[s], *(INSERT + costs[t] for t in inserts(s))]) for s in STATES]
    return costs


class Weights:
    """Integers of a cost and of the letters at ``places`` places."""

    def __init__(self, places: int):
        self.low = WIDTH * places
        self.mask = (1 << self.low) - 1
        self.first = self.low - WIDTH

    def of_cost(self, cost: int) -> int:
        return cost << self.low

    def cost(self, weight: int) -> int:
        return weight >> self.low

    def led(self, letter: str, cost: int, weight: int) -> int:
        """The weight with one more edit in front: its letter takes the first place, the others move on by one."""
        return (self.cost(weight) + cost << self.low) | (DIGITS[letter] << self.first) | ((weight & self.mask) >> WIDTH)

    def letters(self, weight: int) -> str:
        out, at = [], self.first
        while at >= 0 and (digit := weight >> at & ((1 << WIDTH) - 1)):
            out.append(LETTERS[digit])
            at -= WIDTH
        return "".join(out)


def best_paths(rows: list[tuple[str, str]], behind: list[int]) -> list[tuple[int, str]]:
    """Per state before ``rows`` (initial and fault of each): the least cost, and the least letters of that cost.

    ``behind`` has the cost of what follows the rows, per state; the letters are those of the rows, with the
    insertions in front of each.
    """
    weights = Weights(max(1, len(rows) * (1 + INSERTED)))
    best = [weights.of_cost(c) for c in behind]
    for initial, fault in reversed(rows):
        after = best
        best = [min(weights.led(letter, cost, after[t]) for letter, cost, t in edits(initial, fault, s)) for s in STATES]
        direct = best
        for _ in range(INSERTED):
            best = [min([direct[s], *(weights.led("I", INSERT, best[t]) for t in inserts(s))]) for s in STATES]
    return [(weights.cost(w), weights.letters(w)) for w in best]


def matrix(rows: list[tuple[str, str]]) -> list[int]:
    """The least cost between each state before and each state behind ``rows``, row by row; costs alone, no letters."""
    columns = []
    for end in STATES:
        best = [0 if s == end else FAR for s in STATES]
        for initial, fault in reversed(rows):
            best = [min(cost + best[t] for _, cost, t in edits(initial, fault, s)) for s in STATES]
            direct = best
            for _ in range(INSERTED):
                best = [min([direct[s], *(INSERT + best[t] for t in inserts(s))]) for s in STATES]
        columns.append([min(c, FAR) for c in best])
    return [columns[t][s] for s in STATES for t in STATES]


def costs_behind(matrices: list[list[int]]) -> list[list[int]]:
    """Per chunk, the costs of all that follows it, by a fold from the end."""
    out = [final_costs()]
    for m in reversed(matrices[1:]):
        out.append([min(FAR, *(m[4 * s + t] + out[-1][t] for t in STATES)) for s in STATES])
    return out[::-1]


def walked(rows: list[tuple[str, str]], letters: str, state: int) -> int:
    """The state behind ``rows`` on the path of ``letters``."""
    at = 0
    for letter in letters:
        if letter == "I":
            state = next(inserts(state))
        else:
            if letter == "K":
                state = MOVES[state][rows[at][0]]
            elif letter == "R":
                state = next(MOVES[state][r] for r in ROLES if r in MOVES[state])
            at += 1
    return state


def closing(state: int) -> str:
    """The letters of the insertions at the end of a conversation."""
    out = ""
    while state not in ACCEPTING:
        state, out = next(inserts(state)), out + "I"
    return out


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """The rows with ``conv`` (a text, never null), and ``pos``, which numbers them in their order, stored.

    They are dealt by ranges of their sort keys, so a conversation may lie in many parts; the last key spreads rows
    that are equal in all others. Of a text only its beginning takes part, as the bounds of the ranges go through the driver.
    """
    space = F.lit(" ")
    rows = conversations.select(
        conv_key().alias("conv"),
        F.col("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    rows = rows.withColumns({"head": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id() % 64})
    keys = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), *(F.col(c).asc() for c in ("role", "head", "hash", "salt"))]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(rows.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "repair-rows")


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv``, ``pos``, ``turn``, ``initial`` and ``fault`` of each row, without texts.

    The first row of each role and text is found by a minimum, which combines before its shuffle, and joined back by
    ``pos``, which no two rows share.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{WHITE}*\z")
    # The digest stands for role and text: lengths first, so that no other split of the same characters is equal.
    own = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    small = rows.select("conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), own.alias("own"))
    first = small.groupBy("conv", "own").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    small = small.drop("own").join(first, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return small.select("conv", "pos", "turn", "initial", fault.alias("fault"))


def chunk_facts(rows: DataFrame) -> DataFrame:
    """``conv``, ``chunk`` and the ``rows`` of each chunk in order, at most ``CHUNK`` of them."""
    row = F.struct("pos", "initial", "fault")
    chunk = F.shiftright("pos", CHUNK_BITS).alias("chunk")
    return rows.groupBy("conv", chunk).agg(F.array_sort(F.collect_list(row)).alias("rows"))


#: What the functions over chunks give.
CHUNK_SUMMARY = "struct<matrix:array<bigint>,illegal:bigint,head:string,tail:string>"
CHUNK_FOLD = "struct<illegal:bigint,behind:array<struct<chunk:bigint,costs:array<bigint>>>>"
CHUNK_PATHS = "array<struct<cost:bigint,letters:string,exit:int>>"
CHOSEN_PATH = "struct<cost:bigint,audit:string,parts:array<struct<pos:bigint,letters:string>>>"


def _pairs(rows: list) -> list[tuple[str, str]]:
    return [(r["initial"], r["fault"]) for r in rows]


def chunk_summary(rows):
    """The matrix of a chunk, the neighbours inside it that may not stand together, and its outer initials."""
    initials = [r["initial"] for r in rows]
    return matrix(_pairs(rows)), illegal_pairs(initials), initials[0], initials[-1]


def chunk_fold(chunks):
    """Over the chunks of a conversation, in order: all pairs that may not stand together, and the costs behind each chunk."""
    between = sum(illegal_pairs([a["summary"]["tail"], b["summary"]["head"]]) for a, b in zip(chunks, chunks[1:]))
    costs = costs_behind([c["summary"]["matrix"] for c in chunks])
    return sum(c["summary"]["illegal"] for c in chunks) + between, [(c["chunk"], x) for c, x in zip(chunks, costs)]


def chunk_paths(rows, behind):
    """For each state in front of a chunk: the cost from there on, the letters of the chunk, and the state behind it."""
    pairs = _pairs(rows)
    return [(cost, letters, walked(pairs, letters, s)) for s, (cost, letters) in zip(STATES, best_paths(pairs, behind))]


def chosen_path(chunks):
    """The path from the first state through the chunks of a conversation, in order."""
    state, parts = START, []
    for c in chunks:
        path = c["paths"][state]
        parts.append((c["chunk"] << CHUNK_BITS, path["letters"]))
        state = path["exit"]
    parts.append(((1 << 63) - 1, closing(state)))
    return chunks[0]["paths"][START]["cost"], "".join(letters for _, letters in parts), parts


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def plan(faults: DataFrame) -> DataFrame:
    """Per ``conv``: ``illegal``, ``cost``, ``audit``, and ``parts``, the letters of each chunk and of the end."""
    chunks = stored(chunk_facts(faults), "repair-chunks")
    own = chunks.select("conv", F.struct("chunk", F.udf(chunk_summary, CHUNK_SUMMARY)("rows").alias("summary")).alias("part"))
    folds = own.groupBy("conv").agg(F.array_sort(F.collect_list("part")).alias("chunks")).select("conv", F.udf(chunk_fold, CHUNK_FOLD)("chunks").alias("fold"))
    folds = stored(folds, "repair-folds")
    behind = folds.select("conv", F.explode("fold.behind").alias("b")).select("conv", "b.*")
    paths = chunks.join(behind, ["conv", "chunk"]).select("conv", F.struct("chunk", F.udf(chunk_paths, CHUNK_PATHS)("rows", "costs").alias("paths")).alias("part"))
    paths = paths.groupBy("conv").agg(F.array_sort(F.collect_list("part")).alias("chunks")).select("conv", F.udf(chosen_path, CHOSEN_PATH)("chunks").alias("path"))
    return stored(paths.join(folds.select("conv", "fold.illegal"), "conv").select("conv", "illegal", "path.*"), "repair-plan")


def repaired_turns(records: Iterator[dict]) -> Iterator[tuple[str, str | None, str | None]]:
    """``conv``, role and text of each turn of the repaired conversations; role None behind the last turn of each.

    Records come sorted by ``conv`` and place; those with ``letters`` stand in front of the rows that they are for.
    """
    conv, state, letters = None, START, deque()
    for r in records:
        if r["conv"] != conv:
            if conv is not None:
                yield conv, None, None
            conv, state, letters = r["conv"], START, deque()
        letters.extend(r["letters"] or "")
        while letters and letters[0] == "I":
            letters.popleft()
            role = next(x for x in ROLES if x in MOVES[state])
            state = MOVES[state][role]
            yield conv, ROLES[role], ""
        if r["letters"] is None and (letter := letters.popleft()) != "D":
            initial = r["role"][:1] if letter == "K" else next(x for x in ROLES if x in MOVES[state])
            state = MOVES[state][initial]
            yield conv, r["role"] if letter == "K" else ROLES[initial], r["text"]
    if conv is not None:
        yield conv, None, None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _streamed(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows and letters, sorted; the rows of a conversation lie in one task, which reads them one after the other."""
    letters = planned.select("conv", F.explode("parts").alias("p")).select("conv", "p.*")
    none = F.lit(None).cast("string")
    both = letters.select("conv", "pos", F.lit(0).alias("kind"), "letters", none.alias("role"), none.alias("text"))
    both = both.union(rows.select("conv", "pos", F.lit(1), none, "role", "text"))
    return both.repartition("conv").sortWithinPartitions("conv", "pos", "kind").drop("kind", "pos")


def repair(conversations: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``conv_id`` as a text (null stays null), ``n`` from 0, ``role``, ``text``."""
    rows = ordered_rows(conversations)

    def run(batches):
        out, conv, n = [], None, 0
        for name, role, text in repaired_turns(_records(batches)):
            n = n + 1 if name == conv else 0
            conv = name if role is not None else None
            if role is not None:
                out.append((name[1:] if name else None, n, role, text))
            if len(out) == 256:
                yield _batch(out, REPAIRED)
                out = []
        if out:
            yield _batch(out, REPAIRED)

    return _streamed(rows, plan(with_faults(rows))).mapInArrow(run, "conv_id string, n bigint, role string, text string")


REPAIRED = pa.schema([("conv_id", pa.string()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string())])
DIGESTS = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation (``conv``, its id as a text behind ``=``, empty for null): ``gaps``, the number of rows of each
    fault, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``, the digest of ``role:text`` lines of the repaired turns."""
    rows = ordered_rows(conversations)
    faults = stored(with_faults(rows), "repair-faults")
    planned = plan(faults)

    def run(batches):
        out, digest = [], None
        for conv, role, text in repaired_turns(_records(batches)):
            if role is None:
                out.append((conv, (digest or sha256()).hexdigest()))
                digest = None
                continue
            line = f"{role}:{text}".encode()
            if digest is None:
                digest = sha256(line)
            else:
                digest.update(b"\n" + line)
        if out:
            yield _batch(out, DIGESTS)

    digests = _streamed(rows, planned).mapInArrow(run, "conv string, repaired_sha256 string")
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = faults.groupBy("conv").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    return counts.join(planned.drop("parts"), "conv").join(digests, "conv")


def conv_key(column: str = "conv_id") -> Column:
    """An id as a text that tells null from all values."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))
