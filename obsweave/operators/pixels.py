"""Detectors on frames: one row a frame (video, frame, height, width, pixels as RGB bytes) to one row a detection. Kernels are numpy; a frame is the unit of work."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame


def eroded(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels whose window of h x w, from the pixel to the lower right, is all set."""
    wide = np.pad(mask, ((0, h - 1), (0, w - 1)))
    return sliding_window_view(wide, (h, w)).all(axis=(2, 3))


def opened(mask: np.ndarray, size: int = 2) -> np.ndarray:
    """Without what no square of size x size fits into."""
    core = eroded(mask, size, size)
    wide = np.pad(core, ((size - 1, 0), (size - 1, 0)))
    return sliding_window_view(wide, (size, size)).any(axis=(2, 3))


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    wide = np.pad(mask, size // 2)
    rows = sliding_window_view(wide, size, axis=0).any(axis=2)
    return sliding_window_view(rows, size, axis=1).any(axis=2)


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean, mirrored at the edges, over 4 sigma."""
    reach = int(4 * sigma + 0.5)
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        wide = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = (sliding_window_view(wide, len(k), axis=axis) * k).sum(axis=2)
    return x


def local_maxima(x: np.ndarray, size: int, least: float) -> list[tuple[int, int]]:
    """(y, x) of pixels above `least` that none in the size x size window around exceeds."""
    wide = np.pad(x, size // 2, mode="symmetric")
    top = sliding_window_view(sliding_window_view(wide, size, axis=0).max(axis=2), size, axis=1).max(axis=2)
    return list(zip(*(v.tolist() for v in np.nonzero((x == top) & (x > least)))))


def energy_centres(im: np.ndarray, sigma: float = 5.0, size: int = 21, least: float = 0.075) -> list[dict]:
    """Centres of violet energy: local maxima of the blurred colour mask; `value` is the blurred share."""
    r, g, b = (im[:, :, k].astype(int) for k in range(3))
    x = blurred(((b - g > 28) & (r > 85) & (b > 150)).astype(float), sigma)
    return [{"kind": "energy", "x": float(px), "y": float(py), "width": 0, "height": 0, "value": float(x[py, px])} for py, px in local_maxima(x, size, least)]


def line_difference(ours: np.ndarray, theirs: np.ndarray, reach: int = 4) -> tuple[int, int]:
    """Pixels of their mask that ours lacks, and of ours that theirs lacks, where no pixel within `reach` in both axes makes up for it."""
    size = 2 * reach + 1
    return int((theirs & ~dilated(ours, size)).sum()), int((ours & ~dilated(theirs, size)).sum())


def frame_difference(ours: np.ndarray, theirs: np.ndarray) -> dict[str, float]:
    """Mean absolute difference of all channels, of the upper and of the lower half, and the share of pixels that differ by more than 30."""
    d = np.abs(ours.astype(int) - theirs.astype(int)).mean(axis=2)
    half = len(d) // 2
    return {"mean": float(d.mean()), "upper": float(d[:half].mean()), "lower": float(d[half:].mean()), "changed": float((d > 30).mean())}


SCHEMA = "video long, frame long, kind string, x double, y double, width int, height int, value double"


def detect(frames: DataFrame, *detectors: Callable[[np.ndarray], list[dict]]) -> DataFrame:
    """Rows (video, frame, kind, x, y, width, height, value) of all detectors. frames: video, frame, height, width, pixels; a frame without pixels, or of a wrong size, has no detections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for video, frame, h, w, data in zip(*(b.column(k).to_pylist() for k in range(5))):
                if data is not None and h and w and len(data) == 3 * h * w:
                    im = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                    rows += [{"video": video, "frame": frame, **d} for f in detectors for d in f(im)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("video", pa.int64()), ("frame", pa.int64()), ("kind", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("value", pa.float64())]))

    return frames.select("video", "frame", "height", "width", "pixels").mapInArrow(run, SCHEMA)
