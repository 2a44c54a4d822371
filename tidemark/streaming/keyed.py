"""Keyed state in streams: numbers that never fall, streaks with a limit, checks of changed content.

Each is a processor with value state per key, kept by RocksDB in the checkpoint: a restarted query goes on
where it stopped, and a repeated batch gives the same rows. A batch's rows of one key are taken in the
order of their order column; a trigger bounds how many these are (maxFilesPerTrigger of the source).
State can end with a time to live, so that keys that are no longer met do not stay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows without news that saturate a run.
SATURATION = 50


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need this state store; call it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ordered(rows: Iterator, order: str):
    import pandas as pd

    frames = [f for f in rows if len(f)]
    return pd.concat(frames, ignore_index=True).sort_values(order, kind="stable", ignore_index=True) if frames else None


class Numbering(StatefulProcessor):
    """Gives each row of a key the next number."""

    def __init__(self, order: str, ttl_ms: int | None = None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        df = _ordered(rows, self.order)
        if df is None:
            return
        last = self.last.get()[0] if self.last.exists() else 0
        df["seq"] = range(last + 1, last + 1 + len(df))
        self.last.update((last + len(df),))
        yield df

    def close(self) -> None:
        pass


class Saturation(StatefulProcessor):
    """Counts rows since the last news of a key, and says once that the limit is reached."""

    def __init__(self, key: str, order: str, news: str, limit: int, ttl_ms: int | None = None):
        self.key, self.order, self.news, self.limit, self.ttl_ms = key, order, news, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "streak long, told boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        df = _ordered(rows, self.order)
        if df is None:
            return
        streak, told = self.run.get() if self.run.exists() else (0, False)
        for at, new in zip(df[self.order], df[self.news]):
            streak = 0 if new else streak + 1
            if not told and self.limit > 0 and streak >= self.limit:
                told = True
                yield pd.DataFrame({self.key: [key[0]], "at": [at], "streak": [streak]})
        self.run.update((streak, told))

    def close(self) -> None:
        pass


class Changes(StatefulProcessor):
    """Tells for each version of a key's content whether it is new, the same, or changed since the last one."""

    def __init__(self, key: str, order: str, mark: str, ttl_ms: int | None = None):
        self.key, self.order, self.mark, self.ttl_ms = key, order, mark, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "mark string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        df = _ordered(rows, self.order)
        if df is None:
            return
        last, out = (self.seen.get()[0], []) if self.seen.exists() else (None, [])
        for mark in df[self.mark]:
            out.append("unreachable" if pd.isna(mark) else "new" if last is None else "same" if mark == last else "changed")
            last = last if pd.isna(mark) else mark
        if last is not None:
            self.seen.update((last,))
        yield pd.DataFrame({self.key: [key[0]] * len(df), self.order: df[self.order], "state": out})

    def close(self) -> None:
        pass


def _stream(df: DataFrame, key: str, processor: StatefulProcessor, schema: str | StructType) -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if processor.ttl_ms else "None")


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def numbered(events: DataFrame, key: str, order: str, ttl_ms: int | None = None) -> DataFrame:
    """events with seq, from 1 within each key, going on from batch to batch in order of arrival."""
    return _stream(events, key, Numbering(order, ttl_ms), StructType.fromDDL(f"{', '.join(f'{c} {_kind(events, c)}' for c in events.columns)}, seq long"))


def saturated(events: DataFrame, key: str, order: str, news: str, limit: int = SATURATION, ttl_ms: int | None = None) -> DataFrame:
    """(key, at, streak), once per key: the row at which limit rows have brought no news. news: a boolean column."""
    return _stream(events, key, Saturation(key, order, news, limit, ttl_ms), f"{key} {_kind(events, key)}, at {_kind(events, order)}, streak long")


def changes(versions: DataFrame, key: str, order: str, mark: str, ttl_ms: int | None = None) -> DataFrame:
    """(key, order, state): new, same, changed, or unreachable where mark (a digest of the content) is null."""
    return _stream(versions, key, Changes(key, order, mark, ttl_ms), f"{key} {_kind(versions, key)}, {order} {_kind(versions, order)}, state string")
