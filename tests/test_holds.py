"""Rotations, anchors and sprites as tables of points."""
import math
import random

import numpy as np

from obsweave.operators import holds

T = [0.90, 0.933333, 0.966667, 1.0, 1.033333]


def rotations(spark, cases):
    """cases: {hold: (head y, tail y, given)}; a given angle, or one a time."""
    caps = [(k, t, 400.0, float(h + 20 * i), 400.0, float(tail + 20 * i)) for k, (h, tail, _) in cases.items() for i, t in enumerate(T)]
    told = [(k, t, float(d)) for k, (*_, g) in cases.items() for t, d in (zip(T, g) if isinstance(g, list) else ((T[0], g), (T[-1], g)))]
    rows = holds.repaired_rotations(spark.createDataFrame(caps, "hold long, t double, hx double, hy double, tx double, ty double"), spark.createDataFrame(told, "hold long, t double, degrees double")).collect()
    return {k: sorted((r.t, r.degrees, r.repaired) for r in rows if r.hold == k) for k in cases}


def test_repaired_rotations(spark):
    got = rotations(spark, {1: (400, 200, 76), 2: (40, -90, 76), 3: (200, 0, 104), 4: (400, 200, [90, 76, 90, 90, 90]), 5: (40, -90, [90, 76, 76, 76, 90]), 6: (900, 700, 76)})
    for k in (1, 2, 3, 5):
        assert [t for t, _, _ in got[k]] == T and all(abs(d - 90) < 0.02 and r for _, d, r in got[k])
    assert [d for _, d, _ in got[4]] == [90, 76, 90, 90, 90] and not any(r for *_, r in got[4] + got[6])  # one stray sample; too far below the picture


def test_axis_angles_keep_a_tilt(spark):
    rows = [(k, float(i), g) for k, g in ((1, 91.5), (2, 90.2)) for i in range(3)]
    from obsweave.operators.paths import axis_angles

    got = axis_angles(spark.createDataFrame(rows, "track long, t double, deg double"), ["track"], ["t"], "deg", 0.4).collect()
    assert {r.angle for r in got if r.track == 1} == {91.5} and {r.angle for r in got if r.track == 2} == {90.0}


BODY = [[0.966667, 510, 545], [1.033333, 490, 590], [1.066667, 460, 605], [1.1, 430, 610]]
STILL = [[1.0, 500, 576], [1.2, 500, 576]]
NEAR = [[1.0, 500, 576], [1.033333, 491, 590], [1.066667, 461, 605], [1.1, 431, 610], [1.2, 431, 610]]
SMOOTH = [[1.033333, 490, 590], [1.066667, 460.5, 600], [1.1, 431, 610]]
STRAY = [NEAR[0], NEAR[1], [1.066667, 520, 650], *NEAR[3:]]


def test_moving_anchors(spark):
    cases = {1: (0.2, False, BODY, STILL), 2: (0.2, True, BODY[1:], STILL), 3: (0.2, True, BODY, NEAR), 4: (0.2, True, SMOOTH, STRAY), 5: (0.0, False, BODY, STILL), 6: (0.2, False, BODY[:2], STILL), 7: (0.2, False, [*BODY, [1.21, 400, 640], [1.23, 390, 650]], STILL), 8: (0.2, False, BODY, [])}
    rows = spark.createDataFrame([(k, 1.0, d, 500.0, 576.0, p) for k, (d, p, _, _) in cases.items()], "hold long, time double, duration double, x double, y double, precise boolean")
    table = lambda n: spark.createDataFrame([(k, *map(float, q)) for k, c in cases.items() for q in c[n]], "hold long, t double, x double, y double")
    out = holds.moving_anchors(rows, table(2), table(3)).collect()
    got = {k: sorted([r.t, r.x, r.y] for r in out if r.hold == k) for k in cases}
    source = {k: {r.source for r in out if r.hold == k} for k in cases}
    assert got[1] == got[2] == got[8] == [[1.0, 500.0, 576.0], *BODY[1:], [1.2, 430.0, 610.0]] and source[1] == source[2] == {"measured"}
    assert got[3] == NEAR and source[3] == {"given"}
    assert got[4] == [*NEAR[:2], [1.066667, 460.5, 600.0], *NEAR[3:]] and source[4] == {"mended"}
    assert got[5] == got[6] == STILL and source[5] == source[6] == {"given"}
    assert got[7][-1] == [1.2, 390.0, 650.0] and source[7] == {"measured"}  # seen after the end: once, as seen last


EVENT = "video long, event long, fake boolean, type int, frames int, confidence string"
POINT = "video long, event long, t double, x double, y double"


def sprite(k, fake=True, y=100, count=12, kind=0, video=1, x=500.0, start=0.0):
    return (video, k, fake, kind, count, "medium"), [(video, k, start + i / 30, x - i * 20, float(y + i * 20)) for i in range(count)]


def left(spark, *sprites):
    e, p = spark.createDataFrame([s[0] for s in sprites], EVENT), spark.createDataFrame([q for s in sprites for q in s[1]], POINT)
    gone = {r.event for r in holds.sprite_duplicates(e, p).collect()}
    return {s[0][1] for s in sprites} - gone


def test_sprite_duplicates(spark):
    assert left(spark, sprite(1, count=8), sprite(2, count=15)) == {2}
    assert left(spark, sprite(1, y=100), sprite(2, y=138), sprite(5, fake=False, x=5000.0), sprite(6, fake=False, x=5000.0)) == {1, 2, 5, 6}
    assert left(spark, sprite(1), sprite(2, kind=1), sprite(3)) == {1, 2}


def test_sprites_equal_the_loop(spark):
    """All pairs, one after the other."""
    rng = random.Random(2)
    sprites = [sprite(k, rng.random() < 0.7, 100 + rng.randrange(4) * 9, rng.randrange(3, 14), rng.randrange(2), 1, 500.0 + rng.randrange(3) * 40, rng.choice([0.0, 0.05, 0.2])) for k in range(40)]
    gone = set()
    path = {s[0][1]: np.array([q[2:] for q in s[1]]) for s in sprites}
    rank = {s[0][1]: (not s[0][2], len(s[1]), s[0][4], 2) for s in sprites}
    for i, (a, _) in enumerate(sprites):
        if a[1] in gone or len(path[a[1]]) < 4:
            continue
        for b, _ in sprites[i + 1 :]:
            p, q = path[a[1]], path[b[1]]
            if len(q) < 4 or b[1] in gone or not (a[2] or b[2]) or a[3] != b[3]:
                continue
            lo, hi = max(p[0, 0], q[0, 0]), min(p[-1, 0], q[-1, 0])
            if hi - lo < 0.08:
                continue
            t = np.unique(np.concatenate([*(v[(v[:, 0] >= lo) & (v[:, 0] <= hi), 0] for v in (p, q)), np.linspace(lo, hi, max(5, int((hi - lo) * 30) + 1))]))
            d = [math.dist(*([np.interp(x, v[:, 0], v[:, 1]), np.interp(x, v[:, 0], v[:, 2])] for v in (p, q))) for x in t]
            if np.median(d) <= 10 and np.mean(np.array(d) < 16) >= 0.75:
                gone.add(b[1] if rank[a[1]] >= rank[b[1]] else a[1])
    assert left(spark, *sprites) == {s[0][1] for s in sprites} - gone and 5 < len(gone) < 38


def hollow(spark, *notes):
    """notes: (sprite, time, target, ring); the events that are left."""
    e = spark.createDataFrame([(1, s[0][1], t, target, ring, 0.0) for s, t, target, ring in notes], "video long, event long, time double, target long, ring double, head double")
    p = spark.createDataFrame([q for s, *_ in notes for q in s[1]], POINT)
    return {s[0][1] for s, *_ in notes} - {r.event for r in holds.hollow_duplicates(e, p).collect()}


def test_hollow_duplicates(spark):
    end = lambda n: (n - 1) / 30
    a, b, far = sprite(1, count=12), sprite(2, count=8), sprite(3, y=300, count=8)
    assert hollow(spark, (a, end(12), 1, 0.0), (b, end(8), 2, 0.0), (far, end(8), 3, 0.0)) == {1, 3}  # along one path: the shorter goes
    assert hollow(spark, (a, end(12), None, 0.0), (b, end(8), 2, 0.9), (far, end(8), 3, 0.0)) == {2, 3}  # a target weighs more
    close, off = sprite(4, y=140, count=12), sprite(5, y=160, count=12)
    assert hollow(spark, (a, end(12), 7, 0.0), (close, end(12), 7, 0.1)) == {4}  # 40 pixels apart, one target
    assert hollow(spark, (a, end(12), 7, 0.0), (close, end(12), 8, 0.1)) == {1, 4} and hollow(spark, (a, end(12), 7, 0.0), (off, end(12), 7, 0.1)) == {1, 5}
    touch = sprite(6, y=130, count=12)
    assert hollow(spark, (a, end(12), None, 0.0), (touch, end(12) + 0.04, None, 0.0)) == {1}  # contacts near in time and place: the later of equals goes


def test_extended_by(spark):
    schema = "video long, event long, t double, x double, y double"
    e = spark.createDataFrame([(1, k, t, 100.0 + 200 * (k - 1), 10 * t) for k in (1, 2) for t in (1.0, 2.0, 3.0, 4.0)], schema)
    tracks = [(1, 7, t, 104.0, 10 * t) for t in (0.0, 1.0, 2.0, 3.0, 5.0)] + [(1, 8, t, 400.0, 10 * t) for t in (1.0, 2.0, 3.0)] + [(1, 9, t, 296.0, 10 * t) for t in (1.5, 2.5, 4.0, 4.5, 5.5)]
    got = sorted(tuple(r) for r in holds.extended_by(e, spark.createDataFrame(tracks, schema)).collect())
    assert got == [(1, 1, 0.0, 104.0, 0.0, 7), (1, 1, 5.0, 104.0, 50.0, 7), (1, 2, 4.5, 296.0, 45.0, 9), (1, 2, 5.5, 296.0, 55.0, 9)]
