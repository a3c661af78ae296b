"""Greedy pairing and de-duplication of detections, spread over many tasks.

The outcomes are those of walking each image's detections in order. An edge
table comes from a grid-cell equi-join. The edges of an image stream through one
task in order, which keeps no more than who is taken; images with more than
CROWDED edges are settled in rounds instead, so no image is bound to one task:
in each round every detection whose choice no earlier undecided one can touch is
settled. Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from granulate.functions import geometry as g
from granulate.session import cut

CROWDED = 2_000_000  # edges of one image from which it is settled in rounds
FEW = 64  # right rows of a group up to which it is joined without cells
KEPT = 2  # rounds whose plans are joined before the lineage is cut


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], reach: Column, cell: int = 64) -> DataFrame:
    """by, a, b, d: pairs of detections (seq a and b) no further apart than `reach`, a column of `left`.

    Both sides have by, seq, cx, cy. Groups of up to FEW right rows are joined as they are: that is no more
    than FEW pairs a left row. In larger ones cells come in sizes of `cell` times a power of four; a left
    row uses the smallest one that is not below its reach, so its circle touches at most nine
    cells, and a right row lies in one cell of each size that its group uses. So the join is an equi-join.
    """
    d = g.distance(F.col("cx"), F.col("cy"), F.col("bx"), F.col("by_"))
    near = lambda pairs: pairs.withColumn("d", d).where("d <= reach").withColumnRenamed("seq", "a").drop("size", "gx", "gy", "cx", "cy", "bx", "by_", "reach")
    more = [F.col(c).alias("b_" + c) for c in right.columns if c not in [*by, "seq", "cx", "cy"]]
    plain = right.select(*by, F.col("seq").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by_"), *more)
    large = cut(right.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(*by))
    if large.isEmpty():
        return near(left.withColumn("reach", reach).join(plain, by))
    few = near(left.join(large, by, "left_anti").withColumn("reach", reach).join(plain, by))
    left, right = left.join(large, by, "left_semi"), right.join(large, by, "left_semi")
    a = left.withColumn("reach", reach).withColumn("size", cell * F.pow(4, F.greatest(F.lit(0), F.ceil(F.log(F.col("reach") / cell) / math.log(4) - 1e-9))))
    a = a.withColumn("size", F.when(F.col("reach") > F.col("size"), F.col("size") * 4).otherwise(F.coalesce("size", F.lit(float(cell)))))
    sizes = a.select(*by, "size").distinct()
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("reach")) / F.col("size")), F.floor((F.col(c) + F.col("reach")) / F.col("size"))))
    a = a.where("reach >= 0").withColumn("gx", span("cx")).withColumn("gy", span("cy"))
    b = right.join(sizes, by).select(
        *by, "size", F.col("seq").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by_"), F.floor(F.col("cx") / F.col("size")).alias("gx"), F.floor(F.col("cy") / F.col("size")).alias("gy"), *more,
    )
    return few.unionByName(near(a.join(b, [*by, "size", "gx", "gy"])))


def _crowded(edges: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of ordinary images and, if there are any, those of images with more than `most`."""
    many = cut(edges.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*by))
    if many.isEmpty():
        return edges, None
    return edges.join(many, by, "left_anti"), edges.join(many, by, "left_semi")


def _walk(edges: DataFrame, by: list[str], order: list[str], step) -> DataFrame:
    """Rows that `step` picks when the edges of each group pass in order; it gets a state (a set per group) and the row's a and b."""
    key, types = [f"{k}" for k in by], {f.name: f.dataType for f in edges.schema.fields}
    schema = StructType([StructField(c, types[c]) for c in edges.columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, {}
        for pdf in batches:
            groups, keep = list(zip(*[pdf[k] for k in key], strict=True)), []
            for grp, a, b in zip(groups, pdf["a"], pdf["b"], strict=True):
                if grp != last:
                    last, state = grp, {}
                keep.append(step(state, a, b))
            yield pdf[np.array(keep, bool)]

    return edges.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def _choose(state: dict, a, b) -> bool:
    """The edge is taken: a has no partner yet and b is free (edges of a come nearest first)."""
    if state.get("a") == a and state.get("done") or b in state.setdefault("taken", set()):
        return False
    state["a"], state["done"] = a, True
    state["taken"].add(b)
    return True


def _drop(state: dict, a, b) -> bool:
    """b is dropped now: it conflicts with a, which is kept (edges come by b)."""
    gone = state.setdefault("gone", set())
    if a in gone or b in gone:
        return False
    gone.add(b)
    return True


def serial_choice(edges: DataFrame, by: list[str], crowded: int = CROWDED) -> DataFrame:
    """by, a, b, d: each a in order takes its nearest b (then the lowest) that no earlier a took."""
    edges = cut(edges.select(*by, "a", "b", "d"))
    few, many = _crowded(edges, by, crowded)
    out = _walk(few, by, ["a", "d", "b"], _choose)
    return out if many is None else out.unionByName(_choice_rounds(many, by))


def _choice_rounds(edges: DataFrame, by: list[str]) -> DataFrame:
    """Rounds: a settles for its best b left if it is the first undecided one that
    reaches that b; then a and b leave. The first undecided a of every group always settles, so the rounds end."""
    left, got, held = cut(edges), None, []
    while not left.isEmpty():
        won = None
        for _ in range(KEPT):
            best = left.groupBy(*by, "a").agg(F.min(F.struct("d", "b")).alias("m")).select(*by, "a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
            first = left.groupBy(*by, "b").agg(F.min("a").alias("a"))
            now = best.join(first, [*by, "a", "b"])
            left = left.join(now.select(*by, "a"), [*by, "a"], "left_anti").join(now.select(*by, "b"), [*by, "b"], "left_anti")
            won = now if won is None else won.unionByName(now)
            if KEPT > 1:
                left = left.persist(StorageLevel.DISK_ONLY)  # of these rounds only; a lost part is worked out again
                held.append(left)
        won, left = cut(won), cut(left)
        while held:
            held.pop().unpersist()
        got = won if got is None else got.unionByName(won)
    return got if got is not None else edges.limit(0)


def first_come(nodes: DataFrame, conflicts: DataFrame, by: list[str], crowded: int = CROWDED) -> DataFrame:
    """Nodes kept when walked in order of seq, one being dropped if it conflicts with a kept earlier one.

    `conflicts` has by, a, b with a < b.
    """
    edges = cut(conflicts.select(*by, "a", "b").distinct())
    few, many = _crowded(edges, by, crowded)
    gone = _walk(few, by, ["b", "a"], _drop).select(*by, F.col("b").alias("seq"))
    if many is not None:
        gone = gone.unionByName(_drop_rounds(many, by))
    return nodes.join(gone, [*by, "seq"], "left_anti")


def _drop_rounds(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, seq of the dropped nodes. Rounds: a node that no undecided earlier one conflicts with is kept, and drops its later ones; the first undecided node always settles."""
    edges, gone, held = cut(edges), None, []
    while not edges.isEmpty():
        now = None
        for _ in range(KEPT):
            blocked = edges.select(*by, F.col("b").alias("a")).distinct()
            free = edges.select(*by, "a").distinct().join(blocked, [*by, "a"], "left_anti")
            out = edges.join(free, [*by, "a"], "left_semi").select(*by, F.col("b").alias("seq")).distinct()
            settled = free.withColumnRenamed("a", "seq").unionByName(out)
            e = edges.join(settled.withColumnRenamed("seq", "a"), [*by, "a"], "left_anti")
            edges = e.join(out.withColumnRenamed("seq", "b"), [*by, "b"], "left_anti")
            now = out if now is None else now.unionByName(out)
            if KEPT > 1:
                edges = edges.persist(StorageLevel.DISK_ONLY)
                held.append(edges)
        now, edges = cut(now), cut(edges)
        while held:
            held.pop().unpersist()
        gone = now if gone is None else gone.unionByName(now)
    return gone


def pair_outer(outer: DataFrame, inner: DataFrame, by: list[str]) -> DataFrame:
    """Spheres: each outer in order takes the nearest free inner within max(0.8 r, 8)."""
    return serial_choice(near_pairs(outer, inner, by, F.greatest(F.col("radius_px") * 0.8, F.lit(8.0))), by)


def pair_inner(inner: DataFrame, outer: DataFrame, by: list[str]) -> DataFrame:
    """Pellets: each inner in order takes the nearest free outer within max(1.4 r, 12)."""
    return serial_choice(near_pairs(inner, outer, by, F.greatest(F.col("radius_px") * 1.4, F.lit(12.0))), by)


def pair_any(outer: DataFrame, core: DataFrame, by: list[str], ring: float = 64.0) -> DataFrame:
    """Outlines: each outer in order takes the nearest free core at any distance.

    Images of up to CROWDED possible pairs are walked over all of them. In larger
    ones no table of all pairs is made: rings grow around the outers (by a factor
    of four), and within a ring the outers whose choice is sure settle; see `_rings`. That takes
    many rounds where outers compete, but no task ever holds an image.
    """
    n = outer.groupBy(*by).agg(F.count("*").alias("n")).join(core.groupBy(*by).agg(F.count("*").alias("m")), by)
    large = cut(n.where(F.col("n") * F.col("m") > CROWDED).select(*by))
    b = core.select(*by, F.col("seq").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by_"))
    small = outer if large.isEmpty() else outer.join(large, by, "left_anti")
    e = small.select(*by, F.col("seq").alias("a"), "cx", "cy").join(b, by)
    out = _walk(e.select(*by, "a", "b", g.distance(F.col("cx"), F.col("cy"), F.col("bx"), F.col("by_")).alias("d")), by, ["a", "d", "b"], _choose)
    return out if large.isEmpty() else out.unionByName(_rings(outer.join(large, by, "left_semi"), core.join(large, by, "left_semi"), by, ring))


def _rings(outer: DataFrame, core: DataFrame, by: list[str], ring: float) -> DataFrame:
    """Rounds over rings: outers settle in order up to the first one that sees no free core yet or wants one that an earlier one wants."""
    outer, core, got = cut(outer.select(*by, "seq", "cx", "cy")), cut(core.select(*by, "seq", "cx", "cy")), None
    while not (outer.isEmpty() or core.isEmpty()):
        near = cut(near_pairs(outer, core, by, F.lit(ring)).select(*by, "a", "b", "d"))
        best = near.groupBy(*by, "a").agg(F.min(F.struct("d", "b")).alias("m")).select(*by, "a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
        first = near.groupBy(*by, "b").agg(F.min("a").alias("a"))
        sure = cut(best.join(first, [*by, "a", "b"]))
        # Whoever fails may still take any core, also one beyond the ring, so only those before the first failure are sure.
        failed = outer.select(*by, F.col("seq").alias("a")).join(sure.select(*by, "a"), [*by, "a"], "left_anti").groupBy(*by).agg(F.min("a").alias("failed"))
        won = cut(sure.join(failed, by, "left").where("failed is null or a < failed").drop("failed"))
        if won.isEmpty():
            ring *= 4
            continue
        got = won if got is None else got.unionByName(won)
        outer = cut(outer.join(won.select(*by, F.col("a").alias("seq")), [*by, "seq"], "left_anti"))
        core = core.join(won.select(*by, F.col("b").alias("seq")), [*by, "seq"], "left_anti")
        alive = core.select(*by).distinct()
        core, outer = cut(core), cut(outer.join(alive, by, "left_semi"))
    return got if got is not None else outer.select(*by, F.col("seq").alias("a"), F.col("seq").alias("b"), F.col("cx").alias("d")).limit(0)


def match_truth(truth: DataFrame, found: DataFrame, by: list[str], diameter: str) -> DataFrame:
    """Truth rows in order take the nearest free detection within max(8, 0.75 d / 2)."""
    return serial_choice(near_pairs(truth, found, by, F.greatest(F.lit(8.0), F.col(diameter) / 2 * 0.75)), by)


def nearest(probe: DataFrame, rows: DataFrame, by: list[str], reach: Column) -> DataFrame:
    """by, a, b, d: the nearest row of each probe within reach, the lowest of equally near ones; rows may serve many probes."""
    return (
        near_pairs(probe, rows, by, reach).groupBy(*by, "a").agg(F.min(F.struct("d", "b")).alias("m"))
        .select(*by, "a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
    )


def contained(carriers: DataFrame, decorations: DataFrame, by: list[str], factor: float = 1.05) -> DataFrame:
    """by, a, b, d: decorations inside carriers; one may count for several."""
    return near_pairs(carriers, decorations, by, F.greatest(F.col("radius_px"), F.lit(1.0)) * factor)


def duplicates(rows: DataFrame, by: list[str], factor: float = 0.65) -> DataFrame:
    """Conflicts by, a < b: centres closer than factor times the larger radius (at least 1)."""
    most = F.greatest(F.col("radius_px"), F.lit(1.0)) * factor
    # A pair is found from its larger circle, whichever of the two that is.
    p = near_pairs(rows, rows, by, most)
    p = p.where((F.col("a") != F.col("b")) & (F.col("d") < F.greatest("radius_px", "b_radius_px", F.lit(1.0)) * factor))
    return p.select(*by, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).select(*by, F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()


def deduplicate(rows: DataFrame, by: list[str], factor: float = 0.65) -> DataFrame:
    """Detections kept in order, unless inside one kept before."""
    return first_come(rows, duplicates(rows, by, factor), by)


def scale_candidates(rows: DataFrame, by: list[str], most: float = 0.5) -> DataFrame:
    """Scale-bar candidates by falling confidence (then detector order), without those mostly covered by a better one.

    rows: by, seq, x, y, w, h, confidence. Adds rank, its place in the order.
    """
    from pyspark.sql import Window

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("confidence"), "seq")))
    box = lambda p: [F.col(f"{p}.x"), F.col(f"{p}.y"), F.floor(F.col(f"{p}.w")), F.greatest(F.lit(1), F.floor(F.col(f"{p}.h")))]
    a, b = ranked.alias("p"), ranked.alias("q")
    on = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in by]
    covered = a.join(b, [*on, F.col("p.rank") < F.col("q.rank")]).where(g.overlap_ratio(box("q"), box("p")) > most)
    conflicts = covered.select(*[F.col(f"p.{k}").alias(k) for k in by], F.col("p.rank").alias("a"), F.col("q.rank").alias("b"))
    kept = first_come(ranked.drop("seq").withColumnRenamed("rank", "seq"), conflicts, by)
    return kept.withColumnRenamed("seq", "rank")


def outside(rows: DataFrame, regions: DataFrame, by: list[str], most: float = 0.2) -> DataFrame:
    """Rows whose box (x, y, w, h) no ignored region covers by more than `most`."""
    r = regions.select(*by, *[F.col(c).alias("r" + c) for c in "xywh"])
    box, reg = [F.col(c) for c in "xywh"], [F.col("r" + c) for c in "xywh"]
    bad = rows.join(r, by).where(g.overlap_ratio(box, reg) > most).select(*by, "seq").distinct()
    return rows.join(bad, [*by, "seq"], "left_anti")


def assemble(objects: DataFrame, by: list[str], preset: str) -> DataFrame:
    """Reviewable objects from rows with by, place (their order), inner and outer (structs or NULL) and flags.

    inner, outer: struct(cx, cy, major, minor, equivalent, flags). Nothing is
    dropped: an object with one half is partial and flagged.
    """
    from pyspark.sql import Window

    i, o = F.col("inner"), F.col("outer")
    paired = i.isNotNull() & o.isNotNull()
    major = lambda s: F.coalesce(s["major"], F.lit(0.0))
    ratio = F.when(paired, g.core_outer_ratio(major(i), major(o))).otherwise(0.0)
    none = F.array().cast("array<string>")
    flags = F.concat(
        F.coalesce("flags", none), F.coalesce(i["flags"], none), F.coalesce(o["flags"], none),
        F.when(i.isNull(), F.array(F.lit("unpaired_inner"))).otherwise(none), F.when(o.isNull(), F.array(F.lit("unpaired_outer"))).otherwise(none),
        F.when(paired & g.ratio_outlier(ratio), F.array(F.lit("ratio_outlier"))).otherwise(none),
    )
    t = objects.withColumn("found", flags).withColumn("confidence_score", confidence(F.col("found")))
    t = t.withColumn("found", F.when((F.col("confidence_score") < 0.7) & ~F.array_contains("found", "low_confidence"), F.array_append("found", F.lit("low_confidence"))).otherwise(F.col("found")))
    either = lambda f: F.coalesce(o[f], i[f], F.lit(0.0))
    return t.select(
        *by,
        F.format_string("obj_%04d", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).alias("object_id"),
        F.lit(preset).alias("preset"), either("cx").alias("center_x"), either("cy").alias("center_y"),
        major(i).alias("inner_major_axis"), F.coalesce(i["minor"], F.lit(0.0)).alias("inner_minor_axis"),
        major(o).alias("outer_major_axis"), F.coalesce(o["minor"], F.lit(0.0)).alias("outer_minor_axis"),
        either("equivalent").alias("equivalent_diameter"),
        F.when(paired, g.shell_thickness(major(o), major(i))).otherwise(0.0).alias("shell_thickness"), ratio.alias("inner_outer_ratio"),
        F.when(paired, "paired").otherwise("partial").alias("pair_status"),
        review_status(F.col("confidence_score"), F.col("found")).alias("review_status"), "confidence_score",
        F.when(F.array_contains("found", "watershed_split"), "watershed").otherwise("contour/hough").alias("separation_method"),
        F.array_sort(F.array_distinct("found")).alias("flags"),
    )


def confidence(flags: Column) -> Column:
    """1 less the penalties of the flag groups present, not below 0."""
    off = lambda names, p: F.when(F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names])), p).otherwise(0.0)
    score = 1.0 - off(["unpaired_inner", "unpaired_outer"], 0.3) - off(["edge"], 0.2) - off(["ratio_outlier"], 0.2) - off(["low_split_confidence"], 0.2)
    return F.greatest(F.lit(0.0), F.bround(score, 3))


def review_status(score: Column, flags: Column) -> Column:
    """ready if confident and no flag but the way it was separated is left."""
    return F.when((score >= 0.7) & (F.size(F.array_except(flags, F.array(F.lit("watershed_split")))) == 0), "ready").otherwise("needs_review")
