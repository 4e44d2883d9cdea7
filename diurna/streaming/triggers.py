"""Streaming bedtime triggers with a per-child cooldown.

A cooldown depends on the order of events, and a stream has them in no order. So a
candidate waits in its child's state until the watermark has passed it: then no
earlier one can come, and the waiting ones are decided in time order. Everything
else about an event is decided by native expressions first, and only candidates
(device on, inside the window) reach the state. A child keeps the candidates of one
lateness and its last firing, which is forgotten once its cooldown is over.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from diurna.plans import interventions
from diurna.schemas import BEDTIME_COOLDOWN_MINUTES, BEDTIME_WINDOW_MINUTES
from diurna.session import ship_by_value

ship_by_value(__name__)

LATENESS = "1 day"
OUTPUT = "child_id long, event_id long, event_time timestamp, reason string"


class Cooldown(StatefulProcessor):
    """Fires a candidate when the child's last firing is a cooldown ago.

    Times are microseconds since 1970. An event-time timer expires when the watermark
    is beyond its millisecond.
    """

    def __init__(self, cooldown_minutes: int) -> None:
        self.cooldown = cooldown_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", "at long, event_id long")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if not len(batch):
                continue
            self.waiting.appendList(list(zip(batch["at"].tolist(), batch["event_id"].tolist())))
            least = int(batch["at"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted(row for row in held if row[0] < passed)
        later = [row for row in held if row[0] >= passed]
        last = self.last.get()[0] if self.last.exists() else None
        before, reasons = last, []
        for at, _ in due:
            fires = last is None or at - last >= self.cooldown
            last = at if fires else last
            reasons.append("bedtime_transition" if fires else "bedtime_cooldown_active")
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer((last + self.cooldown) // 1000 + 1)
        elif last is not None and last + self.cooldown < passed:
            self.last.clear()
        if due and later:
            self.waiting.put(later)
            self.handle.registerTimer(min(later)[0] // 1000)
        elif due:
            self.waiting.clear()
        if due:
            yield pd.DataFrame(
                {
                    "child_id": key[0],
                    "event_id": [event for _, event in due],
                    "event_time": pd.to_datetime([at for at, _ in due], unit="us"),
                    "reason": reasons,
                }
            )

    def close(self) -> None:
        pass


def candidates(
    bedtime_events: DataFrame, window: int = BEDTIME_WINDOW_MINUTES
) -> DataFrame:
    """Event rows that pass every rule but the cooldown."""
    open_ = bedtime_events.withColumn(
        "last_bedtime_intervention", F.lit(None).cast("timestamp_ntz")
    ).where(interventions.bedtime_reason(window) == "bedtime_transition")
    return open_.select(
        "child_id", "event_id", F.col("current_time").cast("timestamp").alias("event_time")
    )


def bedtime_triggers(
    bedtime_events: DataFrame,
    window: int = BEDTIME_WINDOW_MINUTES,
    cooldown: int = BEDTIME_COOLDOWN_MINUTES,
    lateness: str = LATENESS,
) -> DataFrame:
    """Stream of decisions on candidates; needs the RocksDB state store.

    Candidates may come in any order within ``lateness`` and are decided as in the
    batch replay; later ones are left out and counted. A decision comes out once the
    watermark has passed its candidate.
    """
    return (
        candidates(bedtime_events, window)
        .withWatermark("event_time", lateness)
        .withColumn("at", F.unix_micros("event_time"))
        .groupBy("child_id")
        .transformWithStateInPandas(
            Cooldown(cooldown), OUTPUT, outputMode="append", timeMode="EventTime"
        )
    )
