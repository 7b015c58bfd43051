"""What a new version of a file changes in its findings.

A keyed processor holds the findings of the last version of each file, if asked with a time to live. When a file arrives again,
findings that its new version adds have ``appeared``, and those that it no longer has have ``vanished``. The processor
reads one file's findings at a time, so its memory follows the largest file, and its state lies in the state store,
which is part of the query's checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sentrel.catalogue import CHECKS, Rule
from sentrel.streaming.scan import ARRIVED, stream_scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "repo string, file string, arrived timestamp, change string, id string, check_id string, severity string, line int"
HELD = "check_id string, severity string, line int"


class FileVersions(StatefulProcessor):
    """Per file: the arrival of its last version, and the findings of that version by id."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "arrived timestamp", ttlDurationMs=self.keep_ms)
        self.held = handle.getMapState("held", "id string", HELD, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        given = pd.concat(list(rows))
        before = self.last.get()[0] if self.last.exists() else None
        held = {k[0]: tuple(v) for k, v in self.held.iterator()} if before is not None else {}
        out: list[tuple] = []
        for arrived, version in given.groupby("arrived", sort=True):
            if before is not None and arrived <= before:
                continue  # an older version than the one that is held, or the same again
            found = version[version["id"].notna()]
            now = {r.id: (r.check_id, r.severity, int(r.line)) for r in found.itertuples(index=False)}
            out += [(*key, arrived, "appeared", i, *now[i]) for i in now if i not in held]
            out += [(*key, arrived, "vanished", i, *held[i]) for i in held if i not in now]
            held, before = now, arrived
        if out or before is not None:
            self.last.update((before,))
            self.held.clear()
            for i, value in held.items():
                self.held.updateValue((i,), value)
        names = [x.split()[0] for x in CHANGES.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"line": "int32"})

    def close(self) -> None:
        pass


def stream_changes(
    files: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS, delay: str = "1 hour", keep_ms: int | None = None
) -> DataFrame:
    """``repo, file, arrived, change, id, check_id, severity, line``: findings that appear and vanish as files arrive.

    ``files`` may hold several versions of a file, told apart by ``arrived``; a version older than the last one seen
    changes nothing. A file without findings counts as a version too, so all of its earlier findings vanish.

    With ``keep_ms`` the findings of a file are forgotten so long after it last arrived. Such a query looks at its clock
    in batch after batch and never counts as drained, so it needs a trigger other than ``availableNow``.
    """
    spark = files.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)  # the only store that keeps maps
    columns = ["repo", "file", ARRIVED, "id", "check_id", "severity", "line"]
    none = F.lit(None).cast("string")
    seen = files.select("repo", F.col("path").alias("file"), ARRIVED, none.alias("id"), none.alias("check_id"), none.alias("severity"), F.lit(None).cast("int").alias("line"))
    rows = stream_scan(files, rules, delay).select(*columns).unionByName(seen.withWatermark(ARRIVED, delay))
    return rows.groupBy("repo", "file").transformWithStateInPandas(
        statefulProcessor=FileVersions(keep_ms),
        outputStructType=CHANGES,
        outputMode="Append",
        timeMode="None" if keep_ms is None else "ProcessingTime",
    )
