"""Scalar expressions over columns."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def frame_key(t: Column, width: float = 1.0) -> Column:
    """Nearest frame, halves to even."""
    return F.rint(t / width).cast("long")


def wrap(d: Column, turn: float = 360.0) -> Column:
    """Into [-turn/2, turn/2)."""
    return F.pmod(d + turn / 2, F.lit(turn)) - turn / 2


def axis_gap(a: Column, b: Column) -> Column:
    """Gap of unoriented angles in radians."""
    return F.abs(F.pmod(a - b + math.pi / 2, F.lit(math.pi)) - math.pi / 2)


def direction_gap(a: Column, b: Column) -> Column:
    """Gap of directions in degrees."""
    return F.abs(wrap(a - b))


def axis_mean(angle: Column, weight: Column) -> Column:
    """Aggregate: mean of unoriented angles by doubling, in [0, pi)."""
    m = 0.5 * F.atan2(F.sum(weight * F.sin(2 * angle)), F.sum(weight * F.cos(2 * angle)))
    return F.when(m < 0, m + math.pi).otherwise(m)


def slug(text: Column) -> Column:
    """Runs of characters other than letters, digits and CJK ideographs become one '-'; 'video' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(text, "[^0-9A-Za-z一-鿿]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "video").otherwise(s)


def zigzag(d: Column) -> Column:
    return F.when(d >= 0, 2 * d).otherwise(-2 * d - 1)


def byte_range(size: Column, start: Column, end: Column) -> Column:
    """Struct (status, first, last) of a byte-range request: 206, or 416 where nothing can be served. Without a start the last `end` bytes are meant; without an
    end, all that follows."""
    first = F.coalesce(start, F.greatest(F.lit(0), size - F.coalesce(end, F.lit(0))))
    last = F.when(start.isNull() | end.isNull(), size - 1).otherwise(F.least(end, size - 1))
    ok = (first >= 0) & (first <= last)
    return F.struct(F.when(ok, 206).otherwise(416).alias("status"), F.when(ok, first).otherwise(0).alias("first"), F.when(ok, last).otherwise(size - 1).alias("last"))


def supported(ring: Column, head: Column, hit: Column, target: Column, contact: Column, least_ring: float = 0.55, least_head: float = 0.45, least_hit: float = 0.30) -> Column:
    """Whether an event is supported by itself: by a ring, its head, a burst, or a target with a contact."""
    return (ring >= least_ring) | (head >= least_head) | (hit >= least_hit) | (target & contact)


def solver_quality(frames: Column, target: Column, ring: Column, head: Column, hit: Column, approach: Column, fake: Column, required: Column) -> Column:
    """What an allocation gains by an event: capped supports, its length and target, less for what it lacks."""
    one = lambda c: c.cast("int")
    up = 0.4 * F.log1p(frames) + 1.5 * one(target) + F.least(F.lit(6.0), 6 * ring) + F.least(F.lit(5.0), 6 * head) + F.least(F.lit(7.0), 10 * hit) + 0.8 * one(approach)
    return up - 3.5 * one(ring == 0) - 4 * one(frames == 0) + 0.25 * one(~fake) + 80 * one(required)


def finite(df, *columns: str):
    """df; a row with a number in `columns` that is null, infinite or no number stops the query."""
    for c in columns:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        df = df.withColumn(c, F.when(bad, F.raise_error(F.concat(F.lit(f"{c} is not a finite number: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("double")).otherwise(F.col(c)))
    return df


def chart_point(x: Column, y: Column, width: float = 1280.0, height: float = 720.0) -> tuple[Column, Column]:
    """Pixels to a chart of 1920 x 1080 around its middle."""
    return (x - width / 2) / width * 1920, (y - height / 2) / height * 1080


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A point in axes that are turned by `angle`."""
    return x * F.cos(angle) + y * F.sin(angle), y * F.cos(angle) - x * F.sin(angle)


def line_ends(theta: Column, rho: Column, width: float, height: float) -> Column:
    """Where the line x cos(theta) + y sin(theta) = rho meets the sides of a rectangle: an array of up to four points."""
    c, s = F.cos(theta), F.sin(theta)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ends = F.array(at(F.lit(0.0), rho / s), at(F.lit(width), (rho - width * c) / s), at(rho / c, F.lit(0.0)), at((rho - height * s) / c, F.lit(height)))
    return F.filter(ends, lambda p: (p["x"] >= 0) & (p["x"] <= width) & (p["y"] >= 0) & (p["y"] <= height))


def fallback_lead(inferred: Column, fake: Column, short: float = 0.02, usual: float = 0.6) -> Column:
    """How long before its hit an event shows: briefly if it was only inferred."""
    return F.when(inferred & ~fake, short).otherwise(usual)


def evidence_score(ring: Column, head: Column, hit: Column, target: Column, frames: Column, path_len: Column, weak: Column) -> Column:
    """How well an event is supported: 5 ring + 3 head + 4 hit + 1.3 target + min(2, .34 ln(1 + frames)) + .8 if its path is long - 1.8 if weak."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return 5 * ring + 3 * head + 4 * hit + 1.3 * one(target) + F.least(F.lit(2.0), 0.34 * F.log1p(frames)) + 0.8 * one(path_len >= 5) - 1.8 * one(weak)


def reliable(error: Column, margin: Column) -> Column:
    """Whether a reading can be trusted: a small error with a clear margin to the second best, or a very small one with a lesser margin."""
    return ((error < 0.085) & (margin > 0.025)) | ((error < 0.045) & (margin > 0.020))


def xorshift32(state: Column) -> Column:
    """The next state of a 32-bit xorshift generator (13, 17, 5); states are 1 to 2**32 - 1."""
    full = F.lit(4294967295)
    for n in (13, -17, 5):
        state = state.bitwiseXOR(F.shiftleft(state, n).bitwiseAND(full) if n > 0 else F.shiftright(state, -n))
    return state


def blocked(ring: float = 0.05) -> Column:
    """Whether an event is kept out of a fit: the rules in their order, later ones on top of earlier ones. Columns: faint, wide (kinds that are often decoration), never, supported, twin (a well supported event on its track close by), copy (a
    supported double of its approach), deferred (waits until the counter asks for it), required (the counter asks for it), visual (shown, never judged), and the measurements ring, head,
    frames, duration."""
    weak = F.expr("(faint AND ring < 0.025) OR (wide AND head < 0.01 AND ring < 0.04)")
    seen = F.when(F.col("frames") >= 30, False).otherwise(weak)  # long tracks are notes, whatever their ring
    doubled = F.expr("(ring < 0.02 AND twin) OR (ring < 0.06 AND copy)")
    still = (F.col("duration") > 1728000) & (F.col("frames") < 8) & (F.col("ring") < ring)
    waiting = F.when(F.col("deferred"), True).otherwise(seen | doubled | still)
    rules = waiting | (F.col("never") & ~F.col("supported"))
    return F.when(F.col("visual") & ~F.col("required"), True).when(F.col("required"), False).otherwise(rules)
