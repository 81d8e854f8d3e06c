"""Keyed state of a change-log stream: the last table map, what waits for the next statement, invalidation.

Each key (a table's number) has its last map, until a schema change takes it away, and the values that context
events announced for its next statement. State lives in the store of the stream's checkpoint, so batches
may cut the log anywhere and a restart goes on where it was. A batch's rows of a key are put in order of
their coordinate in one task; the files of a trigger bound them.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What an event does to a key's state.
MAP, SCHEMA_CHANGE, INT_VALUE, USER_VALUE, STATEMENT = "table_map", "schema_change", "intvar", "uservar", "query"
_OUT = "key long, id long, file long, pos long, event_type string, map string, context string, error string"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LogState(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._map = handle.getValueState("map", "value string")
        self._waiting = handle.getMapState("waiting", "place string", "value string")

    def handleInputRows(self, key, rows, timerValues):
        df = pd.concat(list(rows), ignore_index=True).sort_values(["file", "pos"], kind="stable").reset_index(drop=True)
        before = self._map.get()[0] if self._map.exists() else None
        # An empty string stands for "taken away", so that carrying values forward carries that too.
        said = df["value"].where(df["event_type"] == MAP).mask(df["event_type"] == SCHEMA_CHANGE, "").ffill()
        maps = said.where(said.notna(), before).astype(object)
        if len(maps) and isinstance(maps.iloc[-1], str) and maps.iloc[-1] != (before or ""):
            self._map.update((maps.iloc[-1],))
        elif len(maps) and maps.iloc[-1] == "" and before:
            self._map.clear()
        df["map"] = maps.where(maps.notna() & (maps != ""), None)
        df["context"], df["error"] = None, None
        if df["event_type"].isin((INT_VALUE, USER_VALUE, STATEMENT)).any():
            self._statements(df)
        df["key"] = key[0]
        out = df[~df["event_type"].isin((MAP, INT_VALUE, USER_VALUE))]
        yield out[["key", "id", "file", "pos", "event_type", "map", "context", "error"]]

    def _statements(self, df: pd.DataFrame) -> None:
        """Statements take the values that wait; a user variable makes them an error."""
        waiting = dict(sorted((k[0], v[0]) for k, v in self._waiting.iterator()))
        for i, kind, name, value, file, pos in zip(df.index, df["event_type"], df["name"], df["value"], df["file"], df["pos"]):
            if kind in (INT_VALUE, USER_VALUE):
                waiting[f"{int(file):020d}.{int(pos):020d}"] = json.dumps([kind, name, value])
            elif kind == STATEMENT:
                values = [json.loads(waiting[k]) for k in sorted(waiting)]
                users = [n for k, n, _ in values if k == USER_VALUE]
                if users:
                    df.at[i, "error"] = f"user variables: {', '.join(users)}"
                elif values:
                    df.at[i, "context"] = json.dumps([[n, v] for _, n, v in values])
                waiting = {}
        self._waiting.clear()
        for k, v in waiting.items():
            self._waiting.updateValue((k,), (v,))

    def close(self) -> None:
        pass


def with_state(log: DataFrame) -> DataFrame:
    """A stream of events (key, id, file, pos, event_type, name, value) with what is known at each: map, context, error.

    event_type: table_map (value: the map), schema_change (takes the key's map away), intvar and uservar (name and value
    for the next query of the key), query, and anything else, such as rows. table_map, intvar and uservar change
    state and aren't in the result. map is null before the first table_map and behind a schema change;
    context is a JSON array of the pairs that waited for a query, error says that user variables did.
    """
    spark = log.sparkSession
    spark.conf.set(*_PROVIDER)
    return log.groupBy("key").transformWithStateInPandas(LogState(), _OUT, "append", "none")


def can_write_target(event_type: Column, error: Column, map_: Column, changes_data: Column) -> Column:
    """Whether an event opens a transaction on the target: rows of a known table, statements that don't change data by themselves."""
    rows = event_type.isin("rows", "insert", "update", "delete") & map_.isNotNull()
    return F.coalesce(rows | ((event_type == STATEMENT) & error.isNull() & ~changes_data), F.lit(False))


def run_available(log: DataFrame, path: str, checkpoint: str) -> None:
    """Append the result of with_state for all of the log that is there to Parquet files, exactly once."""
    with_state(log).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
