"""Which lines of a text are worth a closer look, asked of all lines of a batch at once.

The engine's regexes backtrack, character by character, and cost more than anything else in a scan although few lines match.
Arrow's matcher walks a text once for any number of alternatives. It only leaves out lines that cannot match, so its dialect
does not matter: the patterns of the engine still decide every hit.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sentrel.functions.prefilter import required_literals

# Ship these helpers with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: More literals than this are left to the engine.
MAX_CHARS = 20_000


def literal_regex(patterns: Iterable[str]) -> str | None:
    """A regex for Arrow that finds every line one of the patterns may match, null when some pattern gives no literals."""
    needed: set[str] = set()
    for pattern in patterns:
        try:
            literals = required_literals(pattern)
        except re.error:  # a pattern of the engine's dialect only
            literals = ()
        if not literals:
            return None
        needed.update(literals)
    plain = all(literal.isascii() for literal in needed) and sum(map(len, needed)) <= MAX_CHARS
    return "(?i)" + "|".join(map(re.escape, sorted(needed))) if needed and plain else None


#: Bits of a mask; regexes beyond share them.
BITS = 62


def line_masks(lines: Column, regexes: Sequence[str], first: str | None = None) -> Column:
    """Per line a number whose bit ``k % BITS`` tells whether the k-th regex (of Arrow's dialect) occurs; empty for null lines.

    With many regexes, ``first`` finds the lines that any of them can occur in.
    """

    @F.arrow_udf(ArrayType(LongType()))
    def masks(batch: pa.Array) -> pa.Array:
        return masks_of(batch, regexes, first)

    return masks(lines)


def masks_of(batch: pa.Array, regexes: Sequence[str], first: str | None = None) -> pa.Array:
    every = batch.flatten()
    found = np.zeros(len(every), dtype=np.int64)
    tell = lambda texts, regex: pc.fill_null(pc.match_substring_regex(texts, regex), False).to_numpy(zero_copy_only=False)
    at = np.arange(len(every)) if first is None else np.flatnonzero(tell(every, first))
    texts = every if first is None else every.take(pa.array(at))
    for k, regex in enumerate(regexes):
        found[at] |= tell(texts, regex).astype(np.int64) << (k % BITS)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))


def has_bit(mask: Column, k: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << (k % BITS))) != 0
