"""Outlines of objects, cut in segments with a water level each."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inundata.functions import density
from inundata.operators import knn
from inundata.operators.grid import Grid
from inundata.operators.objects import level_of, position_in
from inundata.storage import Scratch, shuffled

#: The eight steps around a pixel, counter-clockwise as seen on a map with rows downward, from the west.
_RING = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def trace(inside: set[tuple[int, int]], start: tuple[int, int], came: int) -> list[tuple[int, int]]:
    """Pixels along one border in order: from the start, turning as far as it goes around each pixel.

    ``came`` is the direction in which a pixel outside lies. The walk ends when
    it is to leave the start the way it did first.
    """
    out, at, back, first = [start], start, came, None
    while True:
        for turn in range(1, 9):
            k = (back + turn) % 8
            to = (at[0] + _RING[k][0], at[1] + _RING[k][1])
            if to in inside:
                break
        else:
            return out  # a single pixel
        if first is None:
            first = (at, to)
        elif (at, to) == first:
            return out[:-1]
        out.append(to)
        at, back = to, (k + 4) % 8


def outlines(pixels: np.ndarray, holes: bool = False) -> list[tuple[bool, list[tuple[int, int]]]]:
    """(is_hole, ordered pixels): the outer border of each eight-connected part, then the borders of its holes."""
    inside = set(map(tuple, pixels.tolist()))
    out, seen = [], set()
    for p in sorted(inside):
        if (p[0], p[1] - 1) not in inside and p not in seen:
            part, stack = set(), [p]
            while stack:
                q = stack.pop()
                if q in part:
                    continue
                part.add(q)
                stack += [n for i, j in _RING if (n := (q[0] + i, q[1] + j)) in inside and n not in part]
            seen |= part
            out.append((False, trace(part, min(part), 0)))
            if holes:
                out += [(True, t) for t in _hole_borders(part)]
    return out


def _hole_borders(part: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    rows, cols = [p[0] for p in part], [p[1] for p in part]
    r0, r1, c0, c1 = min(rows) - 1, max(rows) + 1, min(cols) - 1, max(cols) + 1
    outside, stack = set(), [(r0, c0)]
    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    while stack:
        q = stack.pop()
        if q in outside or q in part or not (r0 <= q[0] <= r1 and c0 <= q[1] <= c1):
            continue
        outside.add(q)
        stack += [(q[0] + i, q[1] + j) for i, j in four]
    borders, done = [], set()
    for r in range(r0 + 1, r1):
        for c in range(c0 + 1, c1):
            if (r, c) not in part and (r, c) not in outside and (r, c) not in done:
                stack = [(r, c)]
                while stack:
                    q = stack.pop()
                    if q in done or q in part:
                        continue
                    done.add(q)
                    stack += [(q[0] + i, q[1] + j) for i, j in four]
                borders.append(trace(part, (r, c - 1), 4))
    return borders


def boundary_segments(labels: DataFrame, least: int = 100, points: int = 200, holes: bool = False, least_contour: int = 0) -> DataFrame:
    """(object_id, contour_id, is_hole, seq, col, row, segment_id): ordered outlines of the larger objects, in runs of points.

    Objects under ``least`` pixels are left out, and contours under
    ``least_contour``. Segments count along all contours of an object; with a
    least contour length, along each contour. Only pixels at a border travel to
    the task that traces an object, unless holes are wanted.
    """
    big = labels.groupBy("object_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("object_id")
    cells = labels.join(big, "object_id", "left_semi").select("object_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    if not holes:
        around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))))
        votes = cells.select("object_id", "r", "c", F.explode(around).alias("o")).select("object_id", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).cast("int").alias("me"))
        cells = votes.groupBy("object_id", "r", "c").agg(F.sum("me").alias("me"), F.count("*").alias("n")).where("me > 0 and n < 5").select("object_id", "r", "c")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, k, crossed = [], 0, {}
        for hole, way in outlines(pdf[["r", "c"]].to_numpy(), holes):
            if not holes:
                if _inside(way[0], crossed):
                    continue  # the border of a hole, or what lies in one
                _cross(np.array(way), crossed)
            if len(way) >= least_contour:
                rows += [(k, hole, s, c, r) for s, (r, c) in enumerate(way)]
                k += 1
        out = pd.DataFrame(rows, columns=["contour_id", "is_hole", "seq", "col", "row"])
        out.insert(0, "object_id", pdf["object_id"].iloc[0])
        return out

    spark = labels.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # small in bytes, long to trace: else adaptive execution joins them in a few tasks
    ways = cells.repartition(parts, "object_id").groupBy("object_id").applyInPandas(walk, "object_id long, contour_id int, is_hole boolean, seq int, col int, row int")
    keys = ["object_id", "contour_id"] if least_contour else ["object_id"]
    return position_in(ways, keys, ["contour_id", "seq"], points)


def _cross(ring: np.ndarray, crossed: dict[int, list[int]]) -> None:
    """Adds the columns at which a closed outline goes from a row to the next, sorted by row. Its pixels are neighbours."""
    (r0, c0), (r1, c1) = ring.T, np.roll(ring, -1, axis=0).T
    spans, upper = r0 != r1, r0 < r1
    r, c = np.where(upper, r0, r1)[spans], np.where(upper, c0, c1)[spans]
    order = np.lexsort((c, r))
    for row, columns in zip(*_runs(r[order], c[order])):
        crossed[row] = sorted(crossed.get(row, []) + columns.tolist())


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct values of sorted keys, and the values of each."""
    found, starts = np.unique(keys, return_index=True)
    return found.tolist(), np.split(values, starts[1:])


def _inside(point: tuple[int, int], crossed: dict[int, list[int]]) -> bool:
    """Whether a pixel that isn't on one of the closed outlines lies within it: a ray to the left crosses them an odd number of times.

    None of the outlines lies within another.
    """
    return bool(bisect_left(crossed.get(point[0], []), point[1]) % 2)


def sample_elevation(points: DataFrame, dem: DataFrame, grid: Grid) -> DataFrame:
    """Boundary points with x, y (pixel corners) and Elev of their own cell."""
    placed = points.withColumns({"x": grid.x(F.col("row"), F.col("col")), "y": grid.y(F.col("row"), F.col("col"))})
    ground = dem.select(F.col("r").alias("row"), F.col("c").alias("col"), F.col("v").alias("Elev"))
    return placed.join(shuffled(ground), ["row", "col"], "left")


def reference_segments(points: DataFrame, method: str = "kde") -> DataFrame:
    """One row per (object_id, segment_id) of sampled points: size, place, elevations and level."""
    e = F.col("Elev")
    keys = ["object_id", "segment_id"]
    stats = points.groupBy(*keys).agg(
        F.count("*").alias("num_points"), F.avg("col").alias("col"), F.avg("row").alias("row"), F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.avg(e).alias("elev_mean"), F.stddev_pop(e).alias("elev_std"), F.min(e).alias("elev_min"), F.max(e).alias("elev_max"), (F.max(e) - F.min(e)).alias("elev_range"),
    )
    levels = points.groupBy(*keys).agg(level_of(method)(e).alias("LWSE"))
    return stats.join(levels, keys, "left")


def reference_delta(segments: DataFrame, k: int = 5, id_: str = "segment_id") -> DataFrame:
    """Adds LWSE_local, the mean level of the k nearest other segments by (col, row), and delta_LWSE.

    With a level missing among the neighbours, or without neighbours, both are null.
    """
    spots = segments.select(F.col(id_).alias("id"), F.col("col").alias("x"), F.col("row").alias("y"))
    near = knn.nearest(spots, spots.withColumnRenamed("id", "nid"), k, own=True).join(segments.select(F.col(id_).alias("nid"), F.col("LWSE").alias("l")), "nid")
    local = near.groupBy("id").agg(F.when(F.count("l") == F.count("*"), F.avg("l")).alias("LWSE_local")).withColumnRenamed("id", id_)
    return segments.join(local, id_, "left").withColumn("delta_LWSE", F.col("LWSE") - F.col("LWSE_local"))


@F.pandas_udf(DoubleType())
def upper_level(v: pd.Series) -> float:
    """Level of a segment for reconstruction: see ``density.upper_level``."""
    found = density.upper_level(v.to_numpy(dtype=float))
    return None if found != found else found


def level_points(points: DataFrame) -> DataFrame:
    """(object_id, contour_id, segment_id, x, y, col, row, LWSE) for the segments that have a level."""
    keys = ["object_id", "contour_id", "segment_id"]
    place = points.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("x", "y", "col", "row")))
    return place.join(points.groupBy(*keys).agg(upper_level("Elev").alias("LWSE")), keys).where("LWSE is not null")


def replace_outliers(points: DataFrame, k: int = 8, id_: str = "id") -> DataFrame:
    """Adds LWSE_new: levels far from those of the k nearest others become their inverse-distance mean.

    Far is under the mean by two, or over it by three population deviations.
    With k under 1 all levels stay; with no other point the new level is null.
    """
    if k < 1:
        return points.withColumn("LWSE_new", F.col("LWSE"))
    spots = points.select(F.col(id_).alias("id"), "x", "y")
    near = knn.nearest(spots, spots.withColumnRenamed("id", "nid"), k, own=True).join(points.select(F.col(id_).alias("nid"), F.col("LWSE").alias("l")), "nid")
    w = 1 / F.greatest(F.sqrt("d2"), F.lit(1e-10))
    around = near.groupBy("id").agg(F.avg("l").alias("_m"), F.stddev_pop("l").alias("_s"), (F.sum(F.col("l") * w) / F.sum(w)).alias("_i")).withColumnRenamed("id", id_)
    level = F.col("LWSE")
    far = (level < F.col("_m") - 2 * F.col("_s")) | (level > F.col("_m") + 3 * F.col("_s"))
    return points.join(around, id_, "left").withColumn("LWSE_new", F.when(F.col("_m").isNotNull(), F.when(far, F.col("_i")).otherwise(level))).drop("_m", "_s", "_i")


def reference_layer(labels: DataFrame, dem: DataFrame, grid: Grid, least: int = 100, points: int = 200, k: int = 5, method: str = "kde", holes: bool = False) -> DataFrame:
    """Segments of the large objects' outlines with levels, and how these differ from those nearby."""
    way = sample_elevation(boundary_segments(labels, least, points, holes), dem, grid)
    made = reference_segments(way, method).withColumn("_id", F.xxhash64("object_id", "segment_id"))
    return reference_delta(made, k, "_id").drop("_id")


def level_layer(labels: DataFrame, dem: DataFrame, grid: Grid, least: int = 100, points: int = 200, k: int = 8) -> DataFrame:
    """Level points of all outlines, outliers replaced: the input of the water surface."""
    with Scratch(labels.sparkSession) as scratch:  # outlines are traced once, for places and levels and the searches among them
        way = scratch.save(sample_elevation(boundary_segments(labels, least, points, least_contour=least), dem, grid), "way")
        made = scratch.keep(level_points(way).withColumn("id", F.xxhash64("object_id", "contour_id", "segment_id")), "points")
    return replace_outliers(made, k)
