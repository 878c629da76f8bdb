"""Live change feeds: apply a stream of changes by key, with the old image, and let items expire.

The state of a key is its last sequence number and image, held in the state store; a change that is not newer than it is
late or repeated and has no effect. State is per item, so a hot partition key is spread over its items.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "table_name string, pk string, sk string, seq bigint, event string, old_image string, new_image string"
_STATE = "seq bigint, alive boolean, image string, expires bigint"


class ApplyChanges(StatefulProcessor):
    """Emits the effective changes of every key: INSERT, MODIFY or REMOVE with both images."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["seq", "id"])
        seq, alive, image = -(1 << 63), False, None
        if self.last.exists():
            seq, alive, image, _ = self.last.get()
        out = []
        for r in batch.itertuples():
            if r.seq <= seq:
                continue
            removes = r.event == "REMOVE"
            new = None if removes else (r.new_image if isinstance(r.new_image, str) else None)
            if alive or not removes:
                event = "REMOVE" if removes else "MODIFY" if alive else "INSERT"
                out.append((*key, int(r.seq), event, image if alive else None, new))
            seq, alive, image = int(r.seq), not removes, new
        self.last.update((seq, alive, image, 0))
        yield pd.DataFrame(out, columns=["table_name", "pk", "sk", "seq", "event", "old_image", "new_image"])

    def close(self) -> None:
        pass


def apply_live(changes: DataFrame) -> DataFrame:
    """Effective changes of a stream of ``id, table_name, pk, sk, event, seq, new_image`` (see ``changefeed.read_changes``)."""
    usable = changes.where("event is not null and seq is not null and pk is not null").select("id", "table_name", "pk", "sk", "event", "seq", "new_image")
    return usable.groupBy("table_name", "pk", "sk").transformWithStateInPandas(ApplyChanges(), outputStructType=OUT, outputMode="append", timeMode="none")


class Expire(StatefulProcessor):
    """Holds one item per key until its time has come; emits its removal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "image string, expires bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows), ignore_index=True).iloc[-1]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        out = []
        expires = last["expires"]
        if pd.notna(expires) and expires >= 0:
            now = timerValues.getCurrentWatermarkInMs()
            if int(expires) * 1000 < now:
                out.append((*key, str(last["image"])))
                self.item.clear()
            else:
                self.item.update((str(last["image"]), int(expires)))
                self.handle.registerTimer(int(expires) * 1000 + 1)
        else:
            self.item.clear()
        yield pd.DataFrame(out, columns=["table_name", "pk", "sk", "image"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.item.exists():
            image, _ = self.item.get()
            self.item.clear()
            yield pd.DataFrame([(*key, image)], columns=["table_name", "pk", "sk", "image"])

    def close(self) -> None:
        pass


def expire_live(items: DataFrame, at: str = "at", delay: str = "0 seconds") -> DataFrame:
    """Removals of a stream of items (``table_name, pk, sk, image, expires`` in epoch seconds, event time ``at``) as the stream's time passes them.

    The clock is the stream's own watermark, so a replay gives the same removals. Items without a usable time never expire.
    """
    timed = items.withWatermark(at, delay).select("table_name", "pk", "sk", "image", "expires", at)
    return timed.groupBy("table_name", "pk", "sk").transformWithStateInPandas(Expire(), outputStructType="table_name string, pk string, sk string, image string", outputMode="append", timeMode="eventTime")


def windowed_counts(changes: DataFrame, at: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Changes per table, event and tumbling window of event time; changes later than ``late`` are too late to count."""
    return changes.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), "table_name", "event").agg(F.count(F.lit(1)).alias("n_changes"))
