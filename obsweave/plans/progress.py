"""Progress of batch phases and streams as a table: what has passed each phase, counted on the way."""
from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run string, phase string, batch long, rows long, metrics map<string,double>"
PREFIX = "phase:"


def passing(df: DataFrame, phase: str, **metrics) -> DataFrame:
    """df, whose rows (and further aggregates) a listener reads off while a stream goes through."""
    return df.observe(PREFIX + phase, F.count(F.lit(1)).alias("rows"), *(c.cast("double").alias(n) for n, c in metrics.items()))


class Phases(StreamingQueryListener):
    """Rows per phase. Of streams, by what `passing` observes (add the object to spark.streams); of batch phases, by `counted`. Rows are held until `save` appends them."""

    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run = spark, run
        self._lock, self._rows, self._open = threading.Lock(), [], []

    def _add(self, phase: str, batch: int, values: dict) -> None:
        more = {k: float(v) for k, v in values.items() if k != "rows" and v is not None}
        with self._lock:
            self._rows.append((self.run, phase, batch, int(values["rows"]), more))

    # batch

    def counted(self, df: DataFrame, phase: str, **metrics) -> DataFrame:
        """df, whose rows count for the phase when it is next run."""
        seen = Observation()
        self._open.append((phase, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.cast("double").alias(n) for n, c in metrics.items()))

    def settle(self) -> None:
        """Takes over the counts of batch phases that have run; waits for those that are running."""
        for phase, seen in self._open:
            self._add(phase, 0, seen.get)
        self._open = []

    # streams

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name.startswith(PREFIX):
                self._add(name[len(PREFIX) :], event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    # the table

    def table(self) -> DataFrame:
        """run, phase, batch, rows, metrics of what isn't saved yet."""
        with self._lock:
            return self.spark.createDataFrame(list(self._rows), SCHEMA)

    def save(self, path: str) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def by_phase(progress: DataFrame) -> DataFrame:
    """run, phase, rows, batches: a batch that was run again counts once, as it was run last."""
    once = progress.groupBy("run", "phase", "batch").agg(F.max("rows").alias("rows"))
    return once.groupBy("run", "phase").agg(F.sum("rows").alias("rows"), F.count("*").alias("batches"))
