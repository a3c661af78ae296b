"""Geometry, calibration and metrology of detections as Columns (lengths in pixels or nm)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from granulate.functions.normalise import let

# Fixed values that define the measurements.
PI = 3.141592653589793
ROUND_CIRCULARITY, LONG_CIRCULARITY, LONG_ASPECT = 0.55, 0.25, 1.8
RATIO_MIN, RATIO_MAX = 0.25, 0.85
MIN_AREA_TOLERANCE, MAX_AREA_TOLERANCE = 0.65, 3.0
MANUAL_PADDING = 8


def finite(c: Column) -> Column:
    """c where it is a number; NaN and infinities are NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def nm_per_pixel(scale_nm: Column, scale_px: Column, strict: bool = False) -> Column:
    """Calibration; NULL for values that are missing, not finite or not positive, an error if strict."""
    a, b = finite(scale_nm.cast("double")), finite(scale_px.cast("double"))
    bad = F.raise_error(F.lit("scale lengths must be positive and finite")).cast("double") if strict else F.lit(None).cast("double")
    return F.when((a > 0) & (b > 0), a / F.nullif(b, F.lit(0.0))).otherwise(bad)


def scale_line(text: Column) -> Column:
    """`x1,y1,x2,y2` as struct(x1, y1, x2, y2, length); NULL unless four numbers and two points."""

    def build(p: Column) -> Column:
        x = [F.try_element_at(p, F.lit(i + 1)) for i in range(4)]
        length = F.hypot(x[2] - x[0], x[3] - x[1])
        named = [x[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
        return F.when((F.size(p) == 4) & (length > 0), F.struct(*named, length.alias("length")))

    return let(F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("double")), build)


def scale_bar_confidence(x, y, w, h, width, height) -> Column:
    """Score in [0, 1] that a bright bar is the scale bar: long, low, right, thin, off the lower edge."""
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    score = (
        0.45 * F.least(F.lit(1.0), w / F.greatest(width * 0.18, F.lit(1.0)))
        + 0.25 * unit(y / F.greatest(height * 0.85, F.lit(1.0)))
        + 0.2 * unit(x / F.greatest(width * 0.65, F.lit(1.0)))
        + 0.1 * F.least(F.lit(1.0), (w / F.greatest(h, F.lit(1.0))) / 12)
        - F.when(y >= height - 10, 0.45).otherwise(0.0)
    )
    return F.bround(F.greatest(F.lit(0.0), score), 4)


def overlap_ratio(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Share of box a = (x, y, w, h) that box b covers."""
    side = lambda i: F.greatest(F.lit(0), F.least(a[i] + a[i + 2], b[i] + b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1) / F.greatest(F.lit(1), a[2] * a[3])


def touches_edge(x, y, w, h, width, height, margin: int = 2) -> Column:
    """Whether a box reaches into the margin of the frame."""
    return (x <= margin) | (y <= margin) | (x + w >= width - margin) | (y + h >= height - margin)


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P^2, 0 for degenerate outlines."""
    return F.when((area > 0) & (perimeter > 0), 4 * PI * area / F.nullif(perimeter * perimeter, F.lit(0.0))).otherwise(0.0)


def aspect_ratio(major: Column, minor: Column) -> Column:
    return major / F.greatest(minor, F.lit(1e-6))


def equivalent_diameter(area: Column) -> Column:
    """Diameter of the disc of this area, 0 for no area."""
    return F.when(area > 0, F.sqrt(4 * F.greatest(area, F.lit(0.0)) / PI)).otherwise(0.0)


def physical_diameter(area_px: Column, nm_per_px: Column) -> Column:
    """Disc diameter in nm of an area in pixels, 0 without area or calibration."""
    ok = (area_px > 0) & (nm_per_px > 0)
    return F.when(ok, 2 * F.sqrt(F.greatest(area_px, F.lit(0.0)) * nm_per_px * nm_per_px / PI)).otherwise(0.0)


def shape_class(circ: Column, aspect: Column) -> Column:
    """round, elongated or NULL (accepted as neither)."""
    return F.when((circ >= ROUND_CIRCULARITY) & (aspect < LONG_ASPECT), "round").when(
        (circ >= LONG_CIRCULARITY) & (aspect >= LONG_ASPECT), "elongated"
    )


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def shell_thickness(outer: Column, core: Column) -> Column:
    """Half the difference of the diameters; 0 if one is missing or they are inverted."""
    return F.when(outer >= core, (outer - core) / 2).otherwise(0.0)


def core_outer_ratio(core: Column, outer: Column) -> Column:
    """core / outer, 0 if the outer diameter is 0 or missing."""
    return F.when(outer.isNotNull() & (outer != 0), core / F.nullif(outer, F.lit(0.0))).otherwise(0.0)


def ratio_outlier(ratio: Column) -> Column:
    return (ratio < RATIO_MIN) | (ratio > RATIO_MAX)


def decoration_density(count: Column, major: Column, minor: Column) -> Column:
    """Decorations per 1000 nm^2 of the projected ellipse."""
    half = lambda v: F.greatest(v / 2, F.lit(1e-6))
    return count / (PI * half(major) * half(minor)) * 1000


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def polygon_area(p: Column) -> Column:
    """Shoelace area of [x1, y1, x2, y2, ...]; 0 for fewer than three points."""
    n = (F.size(p) / 2).cast("int")
    at = lambda i: F.get(p, i)

    def term(i: Column) -> Column:
        j = F.pmod(i + 1, n)
        return at(2 * i) * at(2 * j + 1) - at(2 * j) * at(2 * i + 1)

    terms = F.transform(F.sequence(F.lit(0), n - 1), term)
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2).otherwise(0.0)


def _axis(p: Column, odd: int) -> Column:
    pairs = F.slice(p, 1, 2 * (F.size(p) / 2).cast("int"))
    return F.filter(pairs, lambda v, i: i % 2 == odd)


def polygon_centroid(p: Column) -> Column:
    """Mean of the vertices (not of the area) as struct(x, y); 0, 0 without vertices."""
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))).otherwise(0.0)
    return F.struct(mean(_axis(p, 0)).alias("x"), mean(_axis(p, 1)).alias("y"))


def polygon_bbox(p: Column) -> Column:
    """struct(x, y, w, h) around the vertices."""
    x, y = _axis(p, 0), _axis(p, 1)
    return F.struct(
        F.array_min(x).alias("x"), F.array_min(y).alias("y"),
        (F.array_max(x) - F.array_min(x)).alias("w"), (F.array_max(y) - F.array_min(y)).alias("h"),
    )


def polygon_normalise(p: Column, width: Column, height: Column, strict: bool = True) -> Column:
    """Vertices as shares of the frame, clipped to [0, 1].

    strict: NULL for fewer than three points, an odd list or an empty frame;
    else an empty frame counts as 1.
    """
    side = lambda c: c.cast("double") if strict else F.when(c.cast("double") != 0, c.cast("double")).otherwise(1.0)
    w, h = F.nullif(side(width), F.lit(0.0)), F.nullif(side(height), F.lit(0.0))
    out = F.transform(p, lambda v, i: clamp01(v.cast("double") / F.when(i % 2 == 0, w).otherwise(h)))
    return F.when((F.size(p) >= 6) & (F.size(p) % 2 == 0) & w.isNotNull() & h.isNotNull(), out) if strict else out


def first_polygon(segmentation: Column) -> Column:
    """First polygon of a segmentation; NULL for an empty one (run lengths are not lists of lists)."""
    return F.try_element_at(segmentation, F.lit(1))


def ellipse_polygon(cx, cy, rx, ry, angle: Column, n: int = 48) -> Column:
    """n vertices of a turned ellipse as [x1, y1, ...]."""

    def vertex(i: Column) -> Column:
        t = i * (2 * PI / n)
        x, y = rx * F.cos(t), ry * F.sin(t)
        return F.array(cx + x * F.cos(angle) - y * F.sin(angle), cy + x * F.sin(angle) + y * F.cos(angle))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), vertex))


def boxes_at(width, height, xs: Column, ys: Column) -> Column:
    """Panel boxes between gutter positions: along x if there are at least as many, else along y."""
    box = lambda *v: F.struct(*[c.cast("int").alias(n) for c, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])
    zero = F.lit(0)

    def cut(edges: Column, across: bool) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(edges) - 2),
            lambda i: box(F.get(edges, i), zero, F.get(edges, i + 1), height) if across else box(zero, F.get(edges, i), width, F.get(edges, i + 1)),
        )

    e = lambda p, end: F.concat(F.array(zero), F.array_sort(p), F.array(end.cast("int")))
    along_x = (F.size(xs) > 0) & ((F.size(ys) == 0) | (F.size(xs) >= F.size(ys)))
    return F.when(along_x, cut(e(xs, width), True)).when(F.size(ys) > 0, cut(e(ys, height), False))


def aspect_panels(width: Column, height: Column) -> Column:
    """Two to four strips of a very wide or very high figure, else NULL."""
    ratio = width / F.greatest(height, F.lit(1))
    count = lambda r: F.least(F.lit(4), F.greatest(F.lit(2), F.bround(r, 0).cast("int")))
    edge = lambda i, n, end: F.bround(i * (end / n), 0).cast("int")
    zero = F.lit(0)

    def strips(n: Column, across: bool) -> Column:
        def one(i: Column) -> Column:
            v = (edge(i, n, width), zero, edge(i + 1, n, width), height) if across else (zero, edge(i, n, height), width, edge(i + 1, n, height))
            return F.struct(*[c.cast("int").alias(k) for c, k in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])

        return F.transform(F.sequence(zero, n - 1), one)

    return F.when(ratio > 2.25, strips(count(ratio), True)).when(ratio < 0.44, strips(count(1 / F.greatest(ratio, F.lit(1e-9))), False))


def halves(width: Column, height: Column) -> Column:
    """Left and right half."""
    m = F.floor(width / 2)
    return _boxes([(F.lit(0), F.lit(0), m, height), (m, F.lit(0), width, height)])


def quarters(width: Column, height: Column) -> Column:
    """2 x 2 grid, row by row."""
    m, n, o = F.floor(width / 2), F.floor(height / 2), F.lit(0)
    return _boxes([(o, o, m, n), (m, o, width, n), (o, n, m, height), (m, n, width, height)])


def _boxes(rows) -> Column:
    return F.array(*[F.struct(*[c.cast("int").alias(k) for c, k in zip(r, ("x1", "y1", "x2", "y2"), strict=True)]) for r in rows])


def panel_layout(width: Column, height: Column, stem: Column) -> Column:
    """Name of the layout rule a figure of this size follows."""
    ratio = width / F.greatest(height, F.lit(1))
    tall = height / F.greatest(width, F.lit(1))
    return (
        F.when((width > 1400) & (tall >= 0.42) & (tall <= 0.60), "left_right_large_figure")
        .when((width < 520) & (height > width * 1.8), "vertical_panel_stack")
        .when((ratio >= 0.82) & (ratio <= 1.15) & (F.least(width, height) > 900), F.when(F.lower(stem) == "separar", "two_top_one_bottom").otherwise("two_by_two_grid"))
        .otherwise("fallback_original")
    )


def tile_starts(length: Column, tile: int = 1024, overlap: float = 0.20) -> Column:
    """Starts of tiles along one side; the last one is snapped to the edge."""
    step = max(128, int(tile * (1 - overlap)))
    last = F.greatest(F.lit(0), length - tile).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def tile_grid(width: Column, height: Column, tile: int = 1024, overlap: float = 0.20, least: int = 420) -> Column:
    """struct(y, x, h, w) of all tiles of at least `least` pixels a side; none if the figure is not larger than a tile."""
    ys, xs = tile_starts(height, tile, overlap), tile_starts(width, tile, overlap)
    grid = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(
        y.alias("y"), x.alias("x"),
        F.least(F.lit(tile), height - y).cast("int").alias("h"), F.least(F.lit(tile), width - x).cast("int").alias("w"),
    ))))
    large = (width >= tile * 1.15) | (height >= tile * 1.15)
    return F.when(large, F.filter(grid, lambda t: (t["h"] >= least) & (t["w"] >= least)))


def watershed_on(value: Column, preset: Column) -> Column:
    """`auto` splits everywhere but in pellets; otherwise the flag itself."""
    return F.when(F.lower(F.trim(value)) == "auto", preset != "pellets").otherwise(truthy(value))


def truthy(value: Column) -> Column:
    """Permissive flag: everything but 0, false, no and off is true."""
    return ~F.lower(F.trim(value.cast("string"))).isin("0", "false", "no", "off")


def clamped_range(low: Column, high: Column, least: float, most: float | None = None) -> Column:
    """struct(low, high) clamped, in order; a mistyped range is turned round."""
    clamp = lambda c: F.greatest(F.lit(least), c if most is None else F.least(F.lit(most), c))
    a, b = clamp(low), clamp(high)
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
