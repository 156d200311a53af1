"""Leading-edge debounce of change events by file: the first is accepted, and then every event at least the pause after the last accepted one.
Rejected events don't move the clock; deletions always pass and don't either."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EXCLUDES, EXTENSIONS
from ..functions import paths

OUT = "event_type string, file_path string, ts timestamp"


def expanded(events: DataFrame) -> DataFrame:
    """Moves as a deletion of the source and a creation of the destination; folders left out."""
    rows = events.filter(~F.coalesce("is_directory", F.lit(False)))
    moved = F.array(F.struct(F.lit("deleted").alias("event_type"), F.col("file_path")), F.struct(F.lit("created").alias("event_type"), F.col("dest_path").alias("file_path")))
    one = F.array(F.struct("event_type", "file_path"))
    return rows.select("ts", F.explode(F.when(F.col("event_type") == "moved", moved).otherwise(one)).alias("e"), (F.col("event_type") == "moved").alias("moved"), "dest_path").select("e.event_type", "e.file_path", "ts", "moved", "dest_path")


def passing(events: DataFrame, extensions: Iterable[str] = EXTENSIONS, excludes: Iterable[str] = EXCLUDES, root: str = "") -> DataFrame:
    """Events to act on: supported suffixes; exclusions hold for all but deletions. A move to an unsupported suffix is no event at all."""
    path: Column = F.col("file_path")
    rows = expanded(events)
    keep = paths.supported(path, extensions) & ((F.col("event_type") == "deleted") | ~paths.is_excluded(path, excludes, root))
    return rows.filter(keep & (~F.col("moved") | paths.supported(F.col("dest_path"), extensions))).select("event_type", "file_path", "ts")


def accepted(times: Iterable[pd.Timestamp], kinds: Iterable[str], pause: pd.Timedelta, last: pd.Timestamp | None = None) -> tuple[list[bool], pd.Timestamp | None]:
    """Which events of a file, by time, are accepted, and the time of the last accepted change."""
    out = []
    for at, kind in zip(times, kinds, strict=True):
        ok = kind == "deleted" or last is None or at - last >= pause
        if ok and kind != "deleted":
            last = at
        out.append(ok)
    return out, last


def debounce(events: DataFrame, pause_ms: int = 3000) -> DataFrame:
    """The rule over a table of events. Rows stream through in (file, time) order: a file of any number of events is never gathered."""
    pause = pd.Timedelta(milliseconds=pause_ms)
    ordered = events.select("event_type", "file_path", "ts").repartition("file_path").sortWithinPartitions("file_path", "ts", "event_type")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, last = None, None
        for x in batches:
            keep = []
            for kind, own, at in x.itertuples(index=False, name=None):
                if own != path:
                    path, last = own, None
                (ok,), last = accepted([at], [kind], pause, last)
                keep.append(ok)
            yield x[keep]

    return ordered.mapInPandas(run, OUT)


def debounce_stream(events: DataFrame, pause_ms: int = 3000, lateness: str = "10 minutes") -> DataFrame:
    """The rule over a stream; the state of a file is the time of its last accepted change. It goes when the watermark is past the pause: what comes after that is accepted with it or without.
    ``lateness`` is how far events may be behind the newest one."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    pause = pd.Timedelta(milliseconds=pause_ms)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_type"], kind="stable")
        keep, last = accepted(rows["ts"], rows["event_type"], pause, last)
        if last is not None:
            state.update((int(last.value // 1000),))
            # One that ends before the watermark ends with the next.
            state.setTimeoutTimestamp(max(int((last + pause).value // 1_000_000), state.getCurrentWatermarkMs()) + 1)
        yield rows[keep][["event_type", "file_path", "ts"]]

    timed = events.select("event_type", "file_path", "ts").withWatermark("ts", lateness)
    return timed.groupBy("file_path").applyInPandasWithState(run, OUT, "last_us long", "append", GroupStateTimeout.EventTimeTimeout)
