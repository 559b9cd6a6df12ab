"""Inverse-distance surfaces from points, and the depth maps made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.operators import knn
from inundata.operators.components import grow
from inundata.operators.grid import Grid, same_shape
from inundata.storage import shuffled

#: Points that one pass over the cells takes in; more take more passes.
POINTS = 20_000
#: Distances that are worked on at once, so that they stay in a core's cache.
BLOCK = 32_768


def _pass(x: np.ndarray, y: np.ndarray, z: np.ndarray, power: float, smoothing: float):
    sums = np.column_stack([z, np.ones(len(z))])
    meets = smoothing**2 <= 1e-20  # else no point counts as on a centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // len(x))
        for b in batches:
            cx, cy = b.column("x").to_numpy(), b.column("y").to_numpy()
            top, bottom, hit = (b.column(k).to_numpy(zero_copy_only=False).copy() for k in ("top", "bottom", "hit"))
            for i in range(0, len(b), step):
                d, e = cx[i : i + step, None] - x, cy[i : i + step, None] - y
                d *= d
                e *= e
                d += e
                d += smoothing**2
                with np.errstate(divide="ignore"):
                    w = np.divide(1, d, out=e) if power == 2 else np.power(d, -power / 2, out=e)
                if meets:
                    on = d <= 1e-20
                    w[on] = 0
                    which = on.any(axis=1) & np.isnan(hit[i : i + step])
                    hit[i : i + step][which] = z[on.argmax(axis=1)][which]
                got = w @ sums
                top[i : i + step] += got[:, 0]
                bottom[i : i + step] += got[:, 1]
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("c"), b.column("x"), b.column("y"), pa.array(top), pa.array(bottom), pa.array(hit)], ["r", "c", "x", "y", "top", "bottom", "hit"])

    return run


def _nearest_pass(x: np.ndarray, y: np.ndarray, z: np.ndarray, k: int, power: float, smoothing: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.full(len(b), np.nan)
            null = np.ones(len(b), bool)
            for rows, at, d in knn.among(b.column("x").to_numpy(), b.column("y").to_numpy(), x, y, k):
                d = d + smoothing**2
                on = d <= 1e-20
                with np.errstate(divide="ignore", invalid="ignore"):
                    w = np.where(on, 0, d ** (-power / 2))
                    bottom = w.sum(axis=1)
                    first = np.where(on, at, len(x)).min(axis=1, initial=len(x))  # points are in the order of their ids
                    v[rows] = np.where(first < len(x), z[np.minimum(first, len(x) - 1)], (w * z[at]).sum(axis=1) / bottom)
                null[rows] = (first == len(x)) & (bottom == 0)
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("c"), pa.array(v, mask=null)], ["r", "c", "v"])

    return run


def idw(cells: DataFrame, points: DataFrame, grid: Grid, power: float = 2.0, smoothing: float = 1.0, max_points: int | None = None, id_: str = "id") -> DataFrame:
    """Surface (r, c, v) at the centres of the cells: points (id, x, y, z) weighed by distance to a power.

    All points count, or the ``max_points`` nearest, which up to ``knn.SMALL``
    points a task finds and sums up itself. A point on the centre gives its own
    value. All points pass over the cells as arrays of at most POINTS,
    in a chain of maps without shuffle, while sums add up in the rows. Without
    points the surface is null.
    """
    at = cells.select("r", "c", grid.x(F.col("r"), F.col("c"), 0.5).alias("x"), grid.y(F.col("r"), F.col("c"), 0.5).alias("y"))
    known = points.where("z is not null and x is not null and y is not null")
    if max_points is not None:
        if known.count() <= knn.SMALL:
            p = known.select(F.col(id_).cast("long").alias("id"), F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double")).orderBy("id").toPandas()
            return at.mapInArrow(_nearest_pass(p["x"].to_numpy(), p["y"].to_numpy(), p["z"].to_numpy(), max_points, power, smoothing), "r int, c int, v double")
        keyed = at.withColumn("id", F.col("r").cast("long") * grid.width + F.col("c"))
        near = knn.nearest(keyed.select("id", "x", "y"), known.select(F.col(id_).alias("nid"), "x", "y"), max_points)
        d2 = F.col("d2") + smoothing**2
        w = F.when(d2 > 1e-20, F.pow(d2, -power / 2))
        sums = near.join(known.select(F.col(id_).alias("nid"), "z"), "nid").groupBy("id").agg(F.min_by("z", F.when(d2 <= 1e-20, F.col("nid"))).alias("hit"), (F.sum(w * F.col("z")) / F.sum(w)).alias("mean"))
        return keyed.join(shuffled(sums), "id", "left").select("r", "c", F.coalesce("hit", "mean").alias("v"))
    rows = known.select(F.col(id_).alias("id"), F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double")).orderBy("id")
    n = known.count()
    out = at.withColumns({"top": F.lit(0.0), "bottom": F.lit(0.0), "hit": F.lit(float("nan"))})
    schema = "r int, c int, x double, y double, top double, bottom double, hit double"
    for i in range(0, n, POINTS):
        p = (rows if n <= POINTS else rows.offset(i).limit(POINTS)).toPandas()
        out = out.mapInArrow(_pass(p["x"].to_numpy(), p["y"].to_numpy(), p["z"].to_numpy(), power, smoothing), schema)
    return out.select("r", "c", F.coalesce(F.nanvl("hit", F.lit(None).cast("double")), F.when(F.col("bottom") > 0, F.col("top") / F.col("bottom"))).alias("v"))


def depth_class(surface: DataFrame, dem: DataFrame, seeds: DataFrame, grid: Grid, of: Grid | None = None, flood_class: int = 1) -> DataFrame:
    """(r, c, depth, class): class 1 on seeds, 2 where water grows from them over lower ground, else 0 without depth.

    Seeds (v = flood_class) grow by eight neighbours over cells whose ground is
    under the surface; ground without data never floods by growth.
    """
    grid.require_north_up()
    if of is not None:
        same_shape(of, grid)
    both = dem.select("r", "c", F.col("v").alias("z")).join(shuffled(surface.select("r", "c", F.col("v").alias("w"))), ["r", "c"], "left")
    both = both.join(shuffled(seeds.where(F.col("v") == flood_class).select("r", "c", F.lit(True).alias("seed"))), ["r", "c"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    wet = both.where("seed or z < w").select("r", "c")
    grown = grow(wet, seeds.where(F.col("v") == flood_class), grid).select("r", "c", F.lit(True).alias("in"))
    out = both.join(shuffled(grown), ["r", "c"], "left")
    d = F.col("w") - F.col("z")
    return out.select("r", "c", F.when(F.col("seed"), F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))).when(F.col("in"), d).alias("depth"), F.when(F.col("seed"), 1).when(F.col("in"), 2).otherwise(0).alias("class"))
