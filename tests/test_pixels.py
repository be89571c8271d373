"""Detectors on drawn frames, and the byte codec."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from obsweave.operators import curves, parts, pixels


def blank(h=360, w=640):
    return np.zeros((h, w, 3), np.uint8)


def ring(im, x, y, radius, width=1.2, colour=(230, 230, 230)):
    d = np.hypot(*np.mgrid[: im.shape[0], : im.shape[1]] - np.array([y, x])[:, None, None])
    im[np.abs(d - radius) < width] = colour


def flood(m):
    """Boxes and areas of the parts of a mask: (top, bottom, left, right, area)."""
    left, out = set(zip(*(v.tolist() for v in np.nonzero(m)))), []
    while left:
        todo = [left.pop()]
        mine = list(todo)
        while todo:
            y, x = todo.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
                    mine.append(q)
        ys, xs = zip(*mine)
        out.append((min(ys), max(ys), min(xs), max(xs), len(mine)))
    return out


def test_parts_against_flood_fill(spark):
    rng = np.random.default_rng(1)
    masks = [rng.random((14, 150)) < p for p in (0.3, 0.5, 0.6, 0.7, 1.0)]
    snake = np.zeros((60, 30), bool)  # one part that is as long as it can be
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks.append(snake)
    pixels_ = [(k, int(x), int(y)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    rows = parts.runs_of_points(spark.createDataFrame(pixels_, "frame long, x long, y long"), ["frame"], "x", "y")
    got = sorted((r.frame, r.top, r.bottom, r.left, r.right, r.area) for r in parts.parts(rows, ["frame"]).collect())
    assert got == sorted((k, *b) for k, m in enumerate(masks) for b in flood(m)) and got[-1][-1] == snake.sum()


def test_detectors(spark):
    im = blank()
    ring(im, 200, 150, 10.5)
    im[100:120, 300:320] = (240, 220, 240)  # a tap
    im[180:260, 400:418] = (240, 220, 240)  # a hold
    ring(im, 100, 200, 10.3)
    df = spark.createDataFrame([(1, 5, 360, 640, bytearray(im.tobytes())), (1, 6, 360, 640, None), (1, 7, 2, 2, bytearray(b"x"))], "video long, frame long, height int, width int, pixels binary")
    got = parts.white_outlines(df).unionByName(parts.notes(df)).collect()
    by = lambda kind: sorted((r.x, r.y) for r in got if r.kind == kind)
    assert {r.frame for r in got} == {5} and len(got) == 4
    assert by("target") == [(100.0, 200.0), (200.0, 150.0)] and by("tap") == [(309.5, 109.5)] and by("hold") == [(408.5, 250.0)]
    assert parts.notes(df.limit(0)).collect() == []


def test_ring_votes(spark):
    im = blank(120, 160)
    ring(im, 40, 50, 10.3)
    ring(im, 110, 60, 10.3)
    im[90:100, 20:90] = 240  # no ring
    points = [(1, int(x), int(y)) for y, x in zip(*np.nonzero(im.min(2) > 175))]
    got = sorted((r.x, r.y) for r in parts.ring_votes(spark.createDataFrame(points, "frame long, px long, py long"), ["frame"], 10.3, 0.9).collect())
    assert all(any(np.hypot(x - a, y - b) <= 1.5 for x, y in got) for a, b in ((40, 50), (110, 60)))


def test_energy_and_differences():
    im = blank(120, 160)
    im[40:61, 70:91] = (150, 60, 220)
    (c,) = pixels.energy_centres(im)
    assert (c["x"], c["y"]) == (80.0, 50.0)
    a, b = np.zeros((40, 40), bool), np.zeros((40, 40), bool)
    a[10, 5:30], b[13, 5:30], b[30, 5:15] = True, True, True
    assert pixels.line_difference(a, b) == (10, 0) and pixels.line_difference(a, a) == (0, 0)
    d = pixels.frame_difference(blank(4, 4), np.full((4, 4, 3), 40, np.uint8))
    assert d == {"mean": 40.0, "upper": 40.0, "lower": 40.0, "changed": 1.0}
    assert pixels.opened(a).sum() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"abcd", b"x", b"yy", b"abcabcabc", bytes(300)]), max_size=60))
def test_squeeze_round_trip(parts):
    data = b"".join(parts)
    assert curves.expand(curves.squeeze(data)) == data


def test_squeeze_makes_repeats_short():
    data = b"0123456789" * 1000
    assert len(curves.squeeze(data)) < 200 and curves.expand(curves.squeeze(data)) == data
    assert curves.squeeze(b"") == b"" and curves.squeeze(b"abc") == b"\0abc"
