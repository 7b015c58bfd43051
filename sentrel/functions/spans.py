"""Functions of one file as an interval index and as adjacency lists, for Arrow-batched UDFs.

A file's functions and the lines asked for meet inside its row: the enclosing function of all lines comes from one sweep
over both in order, and the calls around a function from lists by called name, so neither lines nor callers are ever
paired with all functions.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from heapq import heappop, heappush

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Ship these helpers with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A receiver alone is no called name.
RECEIVERS = ("self", "cls", "super")
_INT, _TEXT, _TEXTS = IntegerType(), StringType(), ArrayType(StringType())
MEMBER = StructType([StructField("start_line", _INT), StructField("qualname", _TEXT), StructField("end_line", _INT), StructField("depth", _INT)])
TARGET = StructType(
    [
        StructField("qualname", _TEXT), StructField("start_line", _INT), StructField("signature", _TEXT), StructField("calls", _TEXTS),
        StructField("members", ArrayType(MEMBER)), StructField("callers", _TEXTS), StructField("points", ArrayType(_INT)),
    ]
)


def enclosing(spans: list[tuple[int, int, str]], points: list[int], latest: bool = False) -> list[int | None]:
    """For each of the sorted ``points`` the place in ``spans`` (start, end, name) of the function around it.

    The narrowest one, or with ``latest`` the one that starts last; then the shortest or earliest, then by name. Spans
    that were passed leave the heap when they come to its top, so the sweep takes (spans + points) log(spans) steps.
    """
    order = sorted(range(len(spans)), key=lambda i: spans[i][0])
    heap: list[tuple] = []
    out, at = [], 0
    for point in points:
        while at < len(order) and spans[order[at]][0] <= point:
            start, end, name = spans[order[at]]
            key = (-start, end - start, name) if latest else (end - start, start, name)
            heappush(heap, (*key, order[at]))
            at += 1
        while heap and spans[heap[0][-1]][1] < point:
            heappop(heap)
        out.append(heap[0][-1] if heap else None)
    return out


class Calls:
    """Who calls whom in one file, by qualified name: a call means every function whose own name is its last segment."""

    def __init__(self, functions: list):
        self.called: dict[str, set[str]] = defaultdict(set)
        self.named: dict[str, set[str]] = defaultdict(set)
        self.callers_of: dict[str, set[str]] = defaultdict(set)
        self.own: dict[str, set[str]] = defaultdict(set)
        for f in functions:
            self.named[f["name"]].add(f["qualname"])
            self.own[f["qualname"]].add(f["name"])
            for call in f["calls"]:
                if call not in RECEIVERS:
                    segment = call.rpartition(".")[2]
                    self.called[f["qualname"]].add(segment)
                    self.callers_of[segment].add(f["qualname"])

    def around(self, qualnames: set[str]) -> set[str]:
        """All callers and callees of some functions; each name is looked up once."""
        calls = set().union(*(self.called.get(q, ()) for q in qualnames))
        names = set().union(*(self.own.get(q, ()) for q in qualnames))
        callees = set().union(*(self.named.get(n, ()) for n in calls))
        return callees.union(*(self.callers_of.get(n, ()) for n in names))

    def near(self, seed: str, depth: int) -> dict[str, int]:
        """The functions within ``depth`` call edges of ``seed``, with their least number of edges."""
        reached, level = {seed: 0}, {seed}
        for step in range(1, depth + 1):
            level = self.around(level) - reached.keys()
            reached.update(dict.fromkeys(level, step))
        return reached

    def callers(self, qualname: str) -> list[str]:
        """A function counts as its own caller only when it calls its exact qualified name."""
        found = set().union(*(self.callers_of.get(n, ()) for n in self.own[qualname]))
        if qualname in found and qualname not in self.called[qualname]:
            found.remove(qualname)
        return sorted(found)


def slice_targets(functions: list, points: list[int], depth: int) -> list[dict]:
    """The functions around the points of a file with their neighbourhood, and the points of each; without a function
    around them, a target without a name."""
    places = enclosing([(f["start_line"], f["end_line"], f["qualname"]) for f in functions], points)
    by_target: dict[int | None, list[int]] = defaultdict(list)
    for point, place in zip(points, places, strict=True):
        by_target[place].append(point)
    definitions = defaultdict(list)
    for f in functions:
        definitions[f["qualname"]].append(f)
    calls, out, known = Calls(functions), [], {}
    for place, own in by_target.items():
        if place is None:
            out.append(dict.fromkeys(TARGET.names) | {"points": own})
            continue
        f = functions[place]
        name = f["qualname"]
        if name not in known:
            members = [
                {"start_line": d["start_line"], "qualname": q, "end_line": d["end_line"], "depth": step}
                for q, step in calls.near(name, depth).items()
                for d in definitions[q]
            ]
            known[name] = sorted(members, key=lambda m: tuple(m.values())), calls.callers(name)
        members, callers = known[name]
        kept = {c: f[c] for c in ("qualname", "start_line", "signature", "calls")}
        out.append(kept | {"members": members, "callers": callers or None, "points": own})
    return out


def _lists(functions, points) -> tuple[list, list[int]]:
    return list(functions) if functions is not None else [], [int(p) for p in points]


def targets_of(depth: int):
    """A column function of a file's functions and sorted points: its ``TARGET`` rows."""

    @F.pandas_udf(ArrayType(TARGET))
    def targets(functions: pd.Series, points: pd.Series) -> pd.Series:
        rows = [slice_targets(*_lists(f, p), depth) for f, p in zip(functions, points, strict=True)]
        return pd.Series(rows, dtype=object)

    return targets


def places_of(latest: bool):
    """A column function of a file's functions and sorted points: the place of the function around each, or null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(functions: pd.Series, points: pd.Series) -> pd.Series:
        rows = []
        for f, p in zip(functions, points, strict=True):
            own, lines = _lists(f, p)
            rows.append(enclosing([(x["start_line"], x["end_line"], x["qualname"]) for x in own], lines, latest))
        return pd.Series(rows, dtype=object)

    return places

