"""Raster operators on grey frames (numpy in Arrow batches): masks, components, detections, masks' agreement, hashes.

Without OpenCV, contour, Hough and watershed kernels are replaced by connected
components and their moments; results meet the truth of synthetic frames within
a pixel or two, not the reference's pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from granulate.session import cut

DARK, BRIGHT = 80, 185
DETECTION = "image_id long, seq int, cx double, cy double, major_px double, minor_px double, area_px double, perimeter_px double, x int, y int, w int, h int"


def grey(frame: np.ndarray) -> np.ndarray:
    """Grey levels of a BGR or grey frame."""
    return frame if frame.ndim == 2 else np.rint(frame[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def mask(g: np.ndarray, strategy: str = "dark_particles", low: int = 0, high: int = 255) -> np.ndarray:
    """Particles of a frame: dark, bright, or within a range of levels."""
    if strategy == "dark_particles":
        return g < DARK
    return g > BRIGHT if strategy == "bright_particles" else (g >= low) & (g <= high)


def runs(m: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Row, start, end and component of the runs of True in the rows of a mask; components are 8-connected, from 1, joined by union-find."""
    p = np.zeros((m.shape[0], m.shape[1] + 2), bool)
    p[:, 1:-1] = m
    flat = p.ravel()
    ys, xs = np.divmod(np.flatnonzero(flat[1:] != flat[:-1]), p.shape[1])
    ys, starts, ends = ys[::2].tolist(), xs[::2].tolist(), xs[1::2].tolist()
    parent, names = [0], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    row, first, k, stop = -2, 0, 0, 0
    for n, (y, a, b) in enumerate(zip(ys, starts, ends, strict=True)):
        if y != row:
            k, stop = first if y == row + 1 else n, n  # the runs of the row above
            row, first = y, n
        name = 0
        while k < stop and ends[k] < a:
            k += 1
        j = k
        while j < stop and starts[j] <= b:
            other = find(names[j])
            if not name:
                name = other
            elif other != name:
                parent[max(other, name)] = name = min(other, name)
            j += 1
        if not name:
            name = len(parent)
            parent.append(name)
        names.append(name)
    dense, count = [0], 0
    for i in range(1, len(parent)):
        root = parent[i] == i
        count += root
        dense.append(count if root else dense[parent[i]])  # a parent comes before its children
    return ys, starts, ends, [dense[n] for n in names]


def components(m: np.ndarray) -> np.ndarray:
    """Labels of 8-connected components, from 1."""
    _, starts, ends, names = runs(m)
    labels = np.zeros(m.shape, np.int32)
    labels[m] = np.repeat(np.array(names, np.int32), np.subtract(ends, starts).astype(int))
    return labels


def boxes(m: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes x, y, w, h of the 8-connected components of a mask, in the order of their labels."""
    out: dict[int, list[int]] = {}
    for y, a, b, n in zip(*runs(m), strict=True):
        if (o := out.get(n)) is None:
            out[n] = [a, y, b, y]
        else:
            o[0], o[2], o[3] = min(o[0], a), max(o[2], b), y
    return [(x, y, end - x, last - y + 1) for _, (x, y, end, last) in sorted(out.items())]


def measure(labels: np.ndarray) -> list[tuple]:
    """Centre, axes (of the ellipse with the same moments), area, perimeter and box of each component."""
    out = []
    ys, xs = np.nonzero(labels)
    names = labels[ys, xs]
    inner = np.zeros(labels.shape, bool)
    same = labels[1:-1, 1:-1]
    inner[1:-1, 1:-1] = (labels[:-2, 1:-1] == same) & (labels[2:, 1:-1] == same) & (labels[1:-1, :-2] == same) & (labels[1:-1, 2:] == same)
    for n in range(1, labels.max(initial=0) + 1):
        at = names == n
        x, y = xs[at].astype(float), ys[at].astype(float)
        cov = np.cov(np.vstack([x, y]), bias=True) if len(x) > 1 else np.zeros((2, 2))
        small, large = np.sqrt(np.maximum(np.linalg.eigvalsh(cov) + 1 / 12, 0)) * 4
        border = int((~inner[ys[at], xs[at]]).sum())
        out.append((x.mean(), y.mean(), large, small, float(at.sum()), border * 1.05, int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    return out


def detect(images: DataFrame, strategy: str = "dark_particles", least: float = 4.0) -> DataFrame:
    """Detections of frames(image_id, width, height, data: grey bytes); components below `least` pixels are noise. Broken frames give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DETECTION.split(", ")]
        for pdf in batches:
            rows = []
            for i, w, h, data in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["data"], strict=True):
                if data is None or not w or not h or len(data) != int(w) * int(h):
                    continue
                g = np.frombuffer(bytes(data), np.uint8).reshape(int(h), int(w))
                kept = [d for d in measure(components(mask(g, strategy))) if d[4] >= least]
                rows += [(i, s + 1, *d) for s, d in enumerate(kept)]
            yield pd.DataFrame(rows, columns=names)

    return images.select("image_id", "width", "height", "data").mapInPandas(run, DETECTION)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """IoU and Dice of two masks; two empty masks agree."""
    both, any_ = int((a & b).sum()), int((a | b).sum())
    total = int(a.sum()) + int(b.sum())
    return (both / any_, 2 * both / total) if any_ else (1.0, 1.0)


def fill(polygon: list[float], width: int, height: int) -> np.ndarray:
    """Mask of a polygon by even-odd crossings at pixel centres."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), bool)
    p = np.array(polygon, float).reshape(-1, 2)
    for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, axis=0), strict=True):
        if y1 != y2:
            hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside ^= hit
    return inside


def projection(g: np.ndarray, axis: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of every column (x) or row (y), as the gutter search needs them."""
    k = 0 if axis == "x" else 1
    return g.mean(axis=k), g.std(axis=k)


def small_hash(g: np.ndarray, size: int = 8) -> str:
    """Average hash of a frame by block means."""
    h, w = g.shape
    ys, xs = np.arange(size + 1) * h // size, np.arange(size + 1) * w // size
    v = np.array([[g[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)].mean() for j in range(size)] for i in range(size)])
    return "".join("1" if x >= v.mean() else "0" for x in v.ravel())


def disc_frame(width: int, height: int, discs: list[tuple[float, float, float]], ground: int = 235, level: int = 30) -> np.ndarray:
    """Synthetic frame of dark discs (cx, cy, r), for fixtures."""
    y, x = np.mgrid[:height, :width]
    g = np.full((height, width), ground, np.uint8)
    for cx, cy, r in discs:
        g[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = level
    return g


def blur(g: np.ndarray, size: int) -> np.ndarray:
    """Separable Gaussian mean over size x size pixels, the frame's border reflected; the spread follows from the size."""
    sigma, half = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    k = np.exp(-((np.arange(size) - half) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = np.asarray(g, float)
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(out, pad, mode="symmetric" if out.shape[axis] <= half else "reflect")
        out = sum(k[i] * np.take(p, np.arange(i, i + out.shape[axis]), axis) for i in range(size))
    return out


def _spread(m: np.ndarray, half: int, largest: bool) -> np.ndarray:
    """Largest or smallest value within `half` pixels along both axes; outside the frame nothing counts."""
    out = m
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(out, pad, constant_values=not largest)
        parts = [np.take(p, np.arange(i, i + out.shape[axis]), axis) for i in range(2 * half + 1)]
        out = np.logical_or.reduce(parts) if largest else np.logical_and.reduce(parts)
    return out


def close(m: np.ndarray, size: int, times: int = 1) -> np.ndarray:
    """Mask with gaps narrower than `size` closed."""
    half = size // 2 * times
    return _spread(_spread(m, half, True), half, False)


def local_mask(g: np.ndarray, window: int = 35, below: float = 3.0, holes: bool = False) -> np.ndarray:
    """Carriers of low contrast: darker than the mean of their surroundings by more than `below`, gaps closed; with `holes` only small ones."""
    smooth = np.rint(blur(g, 7))
    return close(smooth <= np.rint(blur(smooth, window)) - below, 3 if holes else 9, 2)


def bright_bars(g: np.ndarray, level: int = 245) -> list[tuple[int, int, int, int]]:
    """Boxes x, y, w, h of bright, thin, long marks off the lower edge: where a scale bar may be."""
    h, w = g.shape
    least = max(20, int(w * 0.08))
    return [(x, y, bw, bh) for x, y, bw, bh in boxes(g > level) if bw * bh <= h * w * 0.25 and y < h - 10 and bw >= least and 1 <= bh <= 35 and bw / bh > 6]


def scale_bars(images: DataFrame) -> DataFrame:
    """image_id, seq, x, y, w, h, confidence of the bright bars of frames; to be ranked by pairing.scale_candidates.

    The boxes are checkpointed: ranking reads them several times, the frames are read once.
    """
    from pyspark.sql import functions as F

    from granulate.functions.geometry import scale_bar_confidence

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, w, h, data in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["data"], strict=True):
                if data is not None and w and h and len(data) == int(w) * int(h):
                    rows += [(i, n + 1, *b, w, h) for n, b in enumerate(bright_bars(np.frombuffer(bytes(data), np.uint8).reshape(int(h), int(w))))]
            yield pd.DataFrame(rows, columns=["image_id", "seq", "x", "y", "w", "h", "width", "height"])

    r = images.select("image_id", "width", "height", "data").mapInPandas(run, "image_id long, seq int, x int, y int, w int, h int, width int, height int")
    c = scale_bar_confidence(*[F.col(k) for k in ("x", "y", "w", "h", "width", "height")])
    return cut(r.select("image_id", "seq", "x", "y", "w", "h", c.alias("confidence")))


def outline_of(m: np.ndarray) -> list[tuple[int, int]]:
    """Pixels of the outer border of the first component of a mask, clockwise from its first pixel; a neighbour is looked for from the direction of the last step on."""
    ys, xs = np.nonzero(m)
    if not len(xs):
        return []
    ring = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    h, w = m.shape
    at = start = (int(xs[0]), int(ys[0]))
    heading, first, out = 0, None, [start]
    while True:
        for turn in range(8):
            d = (heading + 6 + turn) % 8
            x, y = at[0] + ring[d][0], at[1] + ring[d][1]
            if 0 <= x < w and 0 <= y < h and m[y, x]:
                break
        else:
            return out  # a single pixel
        if at == start and d == first:
            return out[:-1]
        first = d if first is None else first
        at, heading = (x, y), d
        out.append(at)


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Corners of a closed outline: between two kept ones every point lies within `tolerance` of their line."""
    if len(points) < 4:
        return points
    p = np.array(points, float)
    far = int(((p - p[0]) ** 2).sum(1).argmax())
    keep, todo = {0, far}, [(0, far), (far, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        end = p[b % len(p)] - p[a]
        inner = p[a + 1 : b] - p[a]
        length = math.hypot(*end)
        d = np.abs(end[0] * inner[:, 1] - end[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(d.argmax())
        if d[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[i] for i in sorted(keep)]


def mask_polygons(images: DataFrame, tolerance: float = 1.0, least: int = 3) -> DataFrame:
    """image_id, label, polygon [x1, y1, ...] of every component of every non-zero label of instance masks.

    images: image_id, width, height, data (one byte a pixel, its label). Outlines of fewer than `least` corners are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, w, h, data in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["data"], strict=True):
                if data is None or not w or not h or len(data) != int(w) * int(h):
                    continue
                g = np.frombuffer(bytes(data), np.uint8).reshape(int(h), int(w))
                for label in np.unique(g[g > 0]):
                    parts = components(g == label)
                    for n in range(1, parts.max(initial=0) + 1):
                        corners = simplify(outline_of(parts == n), tolerance)
                        if len(corners) >= least:
                            rows.append((i, int(label), [float(v) for c in corners for v in c]))
            yield pd.DataFrame(rows, columns=["image_id", "label", "polygon"])

    return images.select("image_id", "width", "height", "data").mapInPandas(run, "image_id long, label int, polygon array<double>")
