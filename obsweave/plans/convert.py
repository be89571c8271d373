"""From detections to a script: the stages of a conversion and of its second pass, on a resumable run.

A run has one video's tables, or those of many with the same parameters. Every stage is a table of the run, written once; a run that is started again takes up complete stages, and one with other options repeats only what
depends on them."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.events import pinned
from ..operators.holds import sprite_duplicates
from ..operators.tracking import Tracker, track_rows
from ..sources.script import chart, write_script
from ..sources.shared import apart
from . import joint_fit, reconciliation
from .counters import anchors
from .runs import Run


def tracked(detections: DataFrame, fps: float = 30.0, gate: float = 30.0, keep: int = 6) -> DataFrame:
    """video, event, t, x, y, kind: the samples of every track. detections: video, frame, id, px, py, kind."""
    found = track_rows(detections.select("video", "frame", "id", "px", "py"), Tracker(gate=gate, keep=keep))
    d = detections.join(apart(found), ["video", "id"])
    return d.select("video", F.col("track_no").alias("event"), (F.col("frame") / fps).alias("t"), F.col("px").alias("x"), F.col("py").alias("y"), "kind")


def noted(points: DataFrame, least: int = 4, level: float = 300.0) -> DataFrame:
    """video, event, time, duration, kind, fake, frames, x, y, ring: an event for each track. Its contact is its last sample above `level`, or its last one; a track of holds lasts from there to its end. Tracks of fewer than `least` samples
    are not believed."""
    at = F.struct("t", "x", "y")
    e = points.groupBy("video", "event").agg(F.count("*").alias("frames"), F.max(F.when(F.col("y") <= level, at)).alias("hit"), F.max(at).alias("end"), F.max_by("kind", "t").alias("kind"))
    hit = F.coalesce("hit", "end")
    lasting = F.when(F.col("kind") == "hold", F.round(F.col("end.t") - hit["t"], 5)).otherwise(0.0)
    return e.select("video", "event", F.round(hit["t"], 5).alias("time"), lasting.alias("duration"), "kind", (F.col("frames") < least).alias("fake"), "frames", hit["x"].alias("x"), hit["y"].alias("y"), F.least(F.lit(1.0), F.col("frames") / 20).alias("ring"))


def without_doubles(notes: DataFrame, points: DataFrame) -> DataFrame:
    """Events whose sprites are not another's."""
    e = notes.select("video", "event", "fake", F.lit(None).cast("int").alias("type"), F.col("frames").cast("int").alias("frames"), F.lit("medium").alias("confidence"))
    return notes.join(apart(sprite_duplicates(e, points)), ["video", "event"], "left_anti")


def counted(readings: DataFrame) -> DataFrame:
    """video, interval, start, end, expected: what a counter rises by between its anchors, from 0 at the video's begin. readings: video, t, count, error, margin."""
    w = Window.partitionBy("video").orderBy("t", "count")
    step = anchors(readings, "video").where("t > 0").select("video", F.coalesce(F.lag("t").over(w), F.lit(0.0)).alias("start"), F.col("t").alias("end"), (F.col("count") - F.coalesce(F.lag("count").over(w), F.lit(0))).cast("long").alias("expected"), "t", "count")
    return step.select("video", (F.row_number().over(w).cast("long") - 1).alias("interval"), "start", "end", "expected")


def fitted(notes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events with time, duration and fake as the joint fit has them; what it doesn't choose is a fake. A pin, where there is one, holds an event's head."""
    pin = F.col("pin") if "pin" in notes.columns else F.lit(None).cast("double")
    e = notes.withColumn("pin", pin)
    asked = e.select(F.col("video").alias("track"), "event", "time", "duration", (0.4 * F.log1p("frames") + 6 * F.col("ring")).alias("quality"), "pin", F.lit(None).cast("double").alias("contact"), F.lit(False).alias("held"))
    grid = intervals.select(F.col("video").alias("track"), "interval", "end", "expected")
    chosen, _ = joint_fit.fit(joint_fit.fit_options(asked, grid), grid)
    moved = apart(chosen.select(F.col("track").alias("video"), "event", "moved_head", "moved_tail"))
    j = e.join(moved, ["video", "event"], "left")
    time = F.round(F.greatest(F.lit(0.0), F.col("time") + F.coalesce("moved_head", F.lit(0.0))), 5)
    stop = F.col("time") + F.col("duration") + F.coalesce("moved_tail", F.lit(0.0))
    lasting = F.when(F.col("duration") > 0, F.round(stop - time, 5)).otherwise(0.0)
    return j.select("video", "event", time.alias("time"), lasting.alias("duration"), "kind", F.col("moved_head").isNull().alias("fake"), "frames", "x", "y", "ring", F.col("time").alias("seen"))


def reconciled(fit: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events after local reconciliation with the counter."""
    no, none, zero = F.lit(False), F.lit(None).cast("double"), F.lit(0.0)
    raw = fit.select(F.col("video").alias("track"), "event", "time", "duration", "fake", no.alias("visual"), "ring", zero.alias("head"), zero.alias("hit"), F.col("frames").cast("double").alias("frames"), F.col("frames").cast("int").alias("path_size"), no.alias("target"), none.cast("long").alias("path"), "x", no.alias("weak_kind"), no.alias("never"), no.alias("wide_kind"), no.alias("capsule"), no.alias("ended"), no.alias("required"), none.alias("pin"), F.col("seen").alias("contact"), none.alias("low_edge"), none.alias("high_edge"), none.alias("tail_at"))
    done, _ = reconciliation.reconcile(reconciliation.measured(raw), intervals.select(F.col("video").alias("track"), "interval", "start", "end", "expected"))
    new = apart(done.select(F.col("track").alias("video"), "event", "time", "duration", "fake"))
    return fit.drop("time", "duration", "fake").join(new, ["video", "event"])


def repinned(notes: DataFrame, done: DataFrame) -> DataFrame:
    """The first pass's events with a pin where a well measured contact was moved too far, for a second fit."""
    was = apart(done.select("video", "event", F.col("time").alias("now"), F.col("fake").alias("gone")))
    j = notes.join(was, ["video", "event"])
    pin = F.when(pinned(F.col("now"), F.col("time"), F.col("ring"), F.col("ring"), F.col("gone"), F.lit(False)), F.col("time"))
    return j.withColumn("pin", pin).drop("now", "gone")


def scripted(events: DataFrame, points: DataFrame, video: int = 0, title: str = "") -> DataFrame:
    """The lines of one video's script."""
    notes = events.select("video", F.col("event").alias("id"), "time", "duration", "kind", "fake")
    effects = events.limit(0).select("video", F.col("event").alias("id"), "kind", F.col("time").alias("start"), F.col("time").alias("end"), F.lit(1.0).alias("alpha"))
    return chart(video, title, notes, points.select("video", F.col("event").alias("id"), "t", "x", "y"), effects)


def first_pass(run: Run, readings: DataFrame, key: str, fps: float = 30.0) -> DataFrame:
    """Events of the run's detections (its source), fitted to the counter. key: what tells these readings from others."""
    run.add("readings", readings, key)
    run.stage("points", tracked, "source", fps=fps)
    run.stage("notes", noted, "points")
    run.stage("single", without_doubles, "notes", "points")
    run.stage("intervals", counted, "readings")
    run.stage("fit", fitted, "single", "intervals")
    return run.stage("events", reconciled, "fit", "intervals")


def second_pass(run: Run) -> DataFrame:
    """Events of a run that has had its first pass, fitted again with pins; the first pass's tables are taken as they are."""
    run.stage("pins", repinned, "single", "events")
    run.stage("fit-2", fitted, "pins", "intervals")
    return run.stage("events-2", reconciled, "fit-2", "intervals")


def export(run: Run, events: str, video: int, title: str, path: str) -> None:
    """One video's script, in parts, from the events of either pass."""
    run.stage(f"script-{video}", scripted, events, "points", video=video, title=title)
    write_script(run.tables[f"script-{video}"], path)
