"""Inputs of a stream: set and remove with no-op suppression, has and get from the state that the stream has checkpointed.

Operations are rows key, seq (a long that grows), op ("set" or "remove") and value (text, nullable). The state of a key is whether it is
there, its value and the seq of its last operation; it is kept by Structured Streaming with the checkpoint, so a
restarted stream goes on from it, and `held` reads it as a table without the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "present boolean, value string, seq long"
OUT = "key string, seq long, op string, value string, outcome string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Inputs(StatefulProcessor):
    """Emits what each operation did: changed, same (a no-op), removed, absent (nothing to remove) or late (older than the key's last one)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        present, value, last = self.held.get() if self.held.exists() else (False, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            new = None if pd.isna(r.value) else r.value
            if last is not None and r.seq <= last:
                out.append((key[0], r.seq, r.op, new, "late"))
                continue
            if r.op == "set":
                outcome = "same" if present and new == value else "changed"
                present, value = True, new
            else:
                outcome, new = "removed" if present else "absent", None
                present, value = False, None
            last = int(r.seq)
            out.append((key[0], r.seq, r.op, new, outcome))
        self.held.update((present, value, last))
        yield pd.DataFrame(out, columns=["key", "seq", "op", "value", "outcome"])

    def close(self) -> None:
        pass


def applied(operations: DataFrame) -> DataFrame:
    """key, seq, op, value, outcome of a stream of operations; the session's state store has to be PROVIDER."""
    return operations.groupBy("key").transformWithStateInPandas(statefulProcessor=Inputs(), outputStructType=OUT, outputMode="Append", timeMode="None")


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, value of the inputs that are there as of the last batch; get is a lookup in it, has that there is a row."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return state.where("value.present").selectExpr("key.key AS key", "value.value AS value")
