"""The frame tracker over a stream, with state and timers for each video."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import Tracker

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINK = "video long, id long, track_no long"


class Tracks(StatefulProcessor):
    """State of a video: the samples of its living tracks, three of each at most, and the next number. A timer drops the samples once `keep` frames have passed without a detection, and the
    number after `forget` frames."""

    def __init__(self, tracker: Tracker, fps: float, forget: int):
        self.tracker, self.fps, self.forget = tracker, fps, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getListState("tracks", "no long, frame long, x double, y double")
        self.number = handle.getValueState("number", "next long, last long")

    def ms(self, frame: int) -> int:
        """When a frame has passed, in milliseconds."""
        return int(-(-1000 * (frame + 1) // self.fps))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        active: dict[int, list] = {}
        for no, frame, x, y in self.tracks.get() if self.tracks.exists() else ():
            active.setdefault(no, []).append((frame, x, y))
        now = [{"id": no, "s": s} for no, s in active.items()]
        next_id = self.number.get()[0] if self.number.exists() else 0
        found = sorted((int(f), int(i), float(x), float(y)) for p in rows for f, i, x, y in zip(p.frame, p.id, p.px, p.py))
        links, k = [], 0
        while k < len(found):
            e = k
            while e < len(found) and found[e][0] == found[k][0]:
                e += 1
            now, new, next_id = self.tracker.step(now, found[k][0], [r[1:] for r in found[k:e]], next_id)
            links += new
            k = e
        last = found[-1][0]
        self.tracks.put([(t["id"], f, x, y) for t in now for f, x, y in t["s"]])
        self.number.update((next_id, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(self.ms(last + self.tracker.keep))
        yield pd.DataFrame({"video": [key[0]] * len(links), "id": [x[0] for x in links], "track_no": [x[1] for x in links]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        last = self.number.get()[1] if self.number.exists() else 0
        self.tracks.clear()
        gone = self.ms(last + self.forget)
        if expiredTimerInfo.getExpiryTimeInMs() >= gone:
            self.number.clear()
        else:
            self.handle.registerTimer(gone)
        yield pd.DataFrame({"video": [], "id": [], "track_no": []})

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, tracker: Tracker = Tracker(), fps: float = 30.0, late: str = "0 seconds", forget: int = 1 << 20) -> DataFrame:
    """video, id, track_no for a stream of detections (video, frame, id, px, py); the same as `track_rows` gives for the table, as long as a batch has no frame before the
    last one of earlier batches, nor the rest of it. Frames are the time of the stream: videos are taken to advance together, and one that is more than `late` behind the batches before loses its rows. No track
    outlives `keep` frames without a detection, so its samples may go then; a video that comes back within `forget` frames goes on with its numbers.

    Needs the RocksDB state store, which is set in the session."""
    spark = detections.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = detections.withColumn("at_", F.timestamp_seconds((F.col("frame") + 1) / fps)).withWatermark("at_", late)
    return timed.groupBy("video").transformWithStateInPandas(Tracks(tracker, fps, forget), LINK, "Append", "EventTime")
