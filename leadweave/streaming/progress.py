"""Progress messages of running tasks, as streams and as batch twins with the same result.

Input rows: ``channel`` (the task a message was published for), ``event_seq`` (increasing),
``value`` (JSON text).
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadweave import schemas
from leadweave.session import salted_join

# Message types that end a task.
TERMINAL_TYPES = ("task_completed", "task_failed")
_RANGE = 65536


def parse_progress(messages: DataFrame) -> DataFrame:
    """One wide row per readable message; works on a stream and on a table."""
    parsed = messages.filter(F.try_parse_json("value").isNotNull()) \
        .withColumn("_m", F.from_json("value", schemas.PROGRESS_EVENT))
    return parsed.filter(F.col("_m").isNotNull()).select("channel", "event_seq", "_m.*")


def latest_progress(events: DataFrame) -> DataFrame:
    """Last message per task."""
    payload = [c for c in events.columns if c != "channel"]
    return events.groupBy("channel").agg(F.max_by(F.struct(*payload), "event_seq").alias("_last")) \
        .select("channel", "_last.*")


def until_terminal_batch(events: DataFrame) -> DataFrame:
    """Messages up to and with the first terminal one of their task. An aggregate finds the
    end of each task, so no task's messages are gathered or sorted."""
    ends = events.filter(F.col("type").isin(*TERMINAL_TYPES)) \
        .groupBy("channel").agg(F.min("event_seq").alias("_end"))
    return salted_join(events, ends, "channel").filter(
        F.col("_end").isNull() | (F.col("event_seq") <= F.col("_end"))).drop("_end")


def stage_changes_batch(events: DataFrame) -> DataFrame:
    """Messages whose stage differs from the one before in the same task. Neighbours are
    found inside ranges of sequence numbers; only the last stage of each range travels to the
    next one, so a very busy task is spread over its ranges."""
    ranged = events.withColumn("_range", F.floor(F.col("event_seq") / _RANGE))
    inner = Window.partitionBy("channel", "_range").orderBy("event_seq")
    outer = Window.partitionBy("channel").orderBy("_range")
    marked = F.struct("stage")  # a struct, so that a NULL stage is still a previous stage
    ends = ranged.groupBy("channel", "_range").agg(F.max_by(marked, "event_seq").alias("_last")) \
        .withColumn("_carried", F.lag("_last").over(outer)).drop("_last")
    before = F.coalesce(F.lag(marked).over(inner), F.col("_carried"))
    return ranged.join(ends, ["channel", "_range"]).withColumn("_before", before).filter(
        F.col("_before").isNull() | ~F.col("_before.stage").eqNullSafe(F.col("stage"))
    ).select(events.columns)


class _UntilTerminal(StatefulProcessor):
    """State: where a task ended. Messages of one trigger may come in any order."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getValueState("ended", "event_seq bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        known = self.ended.get()[0] if self.ended.exists() else None
        ends = [f.loc[f["type"].isin(TERMINAL_TYPES), "event_seq"].min() for f in frames]
        first = min([int(e) for e in ends if not pd.isna(e)], default=None)
        if known is None and first is not None:
            known = first
            self.ended.update((first,))
        for frame in frames:
            yield frame if known is None else frame[frame["event_seq"] <= known]


class _StageChanges(StatefulProcessor):
    """State: the stage of a task's last message."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "stage string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        table = pd.concat(rows).sort_values("event_seq")
        seen = self.last.exists()
        stage, before = table["stage"], table["stage"].shift()
        if seen:
            before.iloc[0] = self.last.get()[0]
        changed = ~((stage == before) | (stage.isna() & before.isna()))
        changed.iloc[0] = changed.iloc[0] or not seen
        now = stage.iloc[-1]
        self.last.update((None if pd.isna(now) else now,))
        yield table[changed]


class _Latest(StatefulProcessor):
    """State: the number of a task's last message. Only what is later is handed on."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event_seq bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            top = frame.loc[[frame["event_seq"].idxmax()]].iloc[:1]
            if best is None or top["event_seq"].iloc[0] > best["event_seq"].iloc[0]:
                best = top
        number = int(best["event_seq"].iloc[0])
        if not self.last.exists() or number > self.last.get()[0]:
            self.last.update((number,))
            yield best


#: How long a task that sends nothing is remembered: a day.
FORGET_MS = 24 * 3600 * 1000


def _with_state(events: DataFrame, processor: type, mode: str, ttl_ms: int) -> DataFrame:
    return events.groupBy("channel").transformWithStateInPandas(processor(ttl_ms), events.schema, mode, "processingTime")


def until_terminal(events: DataFrame, ttl_ms: int = FORGET_MS) -> DataFrame:
    """Streaming form of ``until_terminal_batch``. State is one number for each ended task, and
    none ``ttl_ms`` after its end: a message that comes later still begins the task anew."""
    return _with_state(events, _UntilTerminal, "append", ttl_ms)


def stage_changes(events: DataFrame, ttl_ms: int = FORGET_MS) -> DataFrame:
    """Streaming form of ``stage_changes_batch``. State is the last stage of each task, and none
    once a task has sent nothing for ``ttl_ms``."""
    return _with_state(events, _StageChanges, "append", ttl_ms)


def latest_changes(events: DataFrame, ttl_ms: int = FORGET_MS) -> DataFrame:
    """Streaming form of ``latest_progress``: the last message of each task of a trigger that is
    later than all before; a reader keeps the last per task. State is a number per task, and
    none once it has sent nothing for ``ttl_ms``."""
    return _with_state(events, _Latest, "append", ttl_ms)


def read_messages(spark, path: str) -> DataFrame:
    """File stream of message tables."""
    return spark.readStream.schema("event_seq bigint, channel bigint, value string") \
        .option("maxFilesPerTrigger", 16).parquet(path)
