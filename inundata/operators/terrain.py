"""Filled depressions of a terrain, and what they say about flood objects."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.operators.components import TILE, label
from inundata.operators.focal import gaussian, local_max
from inundata.operators.grid import Grid, same_shape
from inundata.storage import Scratch

_NEAR = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def spill_tile(elev: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Lowest spill levels of one tile: no cell lies under its ground nor under the lowest way to a cell of known level.

    ``level`` is finite where a level is known from outside or from before.
    NaN ground is no cell.
    """
    out = np.where(np.isnan(elev), np.inf, level)
    heap = [(v, i) for i, v in enumerate(out.ravel()) if np.isfinite(v)]
    heapq.heapify(heap)
    h, w = elev.shape
    ground, flat = elev.ravel(), out.ravel()
    while heap:
        v, at = heapq.heappop(heap)
        if v > flat[at]:
            continue
        r, c = divmod(at, w)
        for i, j in _NEAR:
            if 0 <= r + i < h and 0 <= c + j < w:
                to = at + i * w + j
                g = ground[to]
                if g == g:
                    s = g if g > v else v
                    if s < flat[to]:
                        flat[to] = s
                        heapq.heappush(heap, (s, to))
    return flat.reshape(h, w)


def fill_depressions(dem: DataFrame, grid: Grid, sigma: float = 1.5, tile: int = TILE, rounds: int | None = None) -> DataFrame:
    """(r, c, elev, spill, depth) over smoothed ground: spill is the level at which water leaves over the grid's edge.

    Each tile takes the levels of the cells around it and lowers its own as far
    as they allow; rounds go on until no level at a border changes. The result
    is the only one where each level is the higher of the ground and the lowest
    neighbouring level, as one priority queue over all cells would find. Cells
    without data are no way for water; cells that nothing reaches keep their
    ground. Levels only fall, so the rounds end; with ``rounds`` given, it is an
    error if they don't by then.
    """
    spark = dem.sparkSession
    smooth = gaussian(dem, grid, sigma).select("r", "c", F.col("v").alias("elev"))
    if sigma:
        smooth = smooth.join(dem.where("v is not null").select("r", "c"), ["r", "c"], "left_semi").unionByName(dem.where("v is null").select("r", "c", F.col("v").alias("elev")))
    single = grid.height <= tile and grid.width <= tile
    edge = f"r = 0 or c = 0 or r = {grid.height - 1} or c = {grid.width - 1}"
    with Scratch(spark) as scratch:
        now = scratch.save(smooth.withColumn("spill", F.when(F.expr(edge), F.col("elev"))), "levels", keep=True)

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            r0, c0 = pdf["r"].min(), pdf["c"].min()
            r, c = (pdf["r"] - r0).to_numpy(), (pdf["c"] - c0).to_numpy()
            elev = np.full((r.max() + 1, c.max() + 1), np.nan)
            level = np.full(elev.shape, np.inf)
            elev[r, c] = pdf["elev"]
            level[r, c] = pdf["spill"].fillna(np.inf)
            new = spill_tile(elev, level)[r, c]
            own = pdf["own"].to_numpy()
            return pd.DataFrame({"r": pdf["r"], "c": pdf["c"], "elev": pdf["elev"], "spill": np.where(np.isfinite(new), new, np.nan)})[own]

        ti, tj = F.expr(f"r div {tile}"), F.expr(f"c div {tile}")
        for _ in itertools.count() if rounds is None else range(rounds):
            shifts = F.array(*(F.struct(F.expr(f"(r + {i}) div {tile}").alias("i"), F.expr(f"(c + {j}) div {tile}").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
            spread = now.select("r", "c", "elev", "spill", F.explode(F.array_distinct(shifts)).alias("t")).select("r", "c", "elev", "spill", F.col("t.i").alias("_i"), F.col("t.j").alias("_j"))
            spread = spread.withColumn("own", (F.col("_i") == ti) & (F.col("_j") == tj))
            nxt = spread.groupBy("_i", "_j").applyInPandas(step, "r int, c int, elev double, spill double").select("r", "c", F.nanvl("elev", F.lit(None).cast("double")).alias("elev"), F.nanvl("spill", F.lit(None).cast("double")).alias("spill"))
            nxt = scratch.save(nxt, "levels", keep=True)
            if single:
                scratch.drop(now)
                now = nxt
                break
            border = f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})"
            total = lambda df: df.where(border).agg(F.count("spill"), F.sum(F.xxhash64("r", "c", "spill").cast("decimal(38,0)"))).first()
            same = total(nxt) == total(now)
            scratch.drop(now)
            now = nxt
            if same:
                break
        else:
            raise RuntimeError("levels did not settle")
        spill = F.when(F.col("elev").isNotNull(), F.coalesce("spill", "elev"))
        return now.select("r", "c", "elev", spill.alias("spill"), F.greatest(spill - F.col("elev"), F.lit(0.0)).alias("depth"))


def depression_metrics(labels: DataFrame, fill: DataFrame, pixel_area: float, min_depth: float = 0.1) -> DataFrame:
    """Per object of (r, c, object_id) what the fill depths (r, c, depth) are: depre_mn, _max, _sd, _pct, _vol."""
    d = F.col("depth")
    got = labels.join(fill.select("r", "c", "depth"), ["r", "c"], "left").groupBy("object_id")
    n = F.count(d)
    return got.agg(
        F.avg(d).alias("depre_mn"), F.max(d).alias("depre_max"), F.stddev_pop(d).alias("depre_sd"),
        F.coalesce(F.sum((d > min_depth).cast("int")) / F.when(n > 0, n), F.lit(0.0)).alias("depre_pct"),
        (F.coalesce(F.sum(d), F.lit(0.0)) * pixel_area).alias("depre_vol"),
    )


def pit_presence(labels: DataFrame, fill: DataFrame, grid: Grid, least: int = 50) -> DataFrame:
    """(object_id, has_pit): whether an object has the bottom of a depression of ``least`` cells or more."""
    deep = label(fill.where("depth > 0").select("r", "c", F.col("depth").alias("v")), grid, diagonal=False)
    big = deep.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("label")
    tops = local_max(fill.select("r", "c", F.col("depth").alias("v")), grid).where("v = 1").select("r", "c")
    pits = deep.join(big, "label", "left_semi").select("r", "c").join(tops, ["r", "c"], "left_semi").withColumn("pit", F.lit(1))
    return labels.join(pits, ["r", "c"], "left").groupBy("object_id").agg(F.coalesce(F.max("pit"), F.lit(0)).alias("has_pit"))


def depth_metrics(labels: DataFrame, dem: DataFrame, objects: DataFrame, pixel_area: float, level: str = "LWSE") -> DataFrame:
    """Per object the depth of its level over the ground: mean, median, least, greatest, spread, share under ground, volume."""
    d = F.col("d")
    ground = labels.join(dem.select("r", "c", F.col("v").alias("z")), ["r", "c"], "left")
    depths = ground.join(objects.select(F.col("ID").alias("object_id"), F.col(level).alias("level")), "object_id", "left").withColumn("d", F.col("level") - F.col("z"))
    n = F.count(d)
    out = depths.groupBy("object_id").agg(
        F.avg(d).alias("depth_mn"), F.expr("percentile(d, 0.5)").alias("depth_md"), F.min(d).alias("depth_min"), F.max(d).alias("depth_max"), F.stddev_pop(d).alias("depth_sd"),
        F.when(n > 0, F.sum((d < 0).cast("int")) / n).alias("frac_neg"), F.when(n > 0, F.sum(F.greatest(d, F.lit(0.0))) * pixel_area).alias("depth_vol"),
    )
    return out


def add_depression_attributes(objects: DataFrame, labels: DataFrame, dem: DataFrame, grid: Grid, of: Grid | None = None, sigma: float = 1.5, min_depth: float = 0.1, least_pit: int = 50) -> DataFrame:
    """Objects with depression, pit and, if they have a level, depth columns joined by ID."""
    if of is not None:
        same_shape(of, grid)
    area = abs(grid.a * grid.e)
    fill = fill_depressions(dem, grid, sigma)
    parts = [depression_metrics(labels, fill, area, min_depth), pit_presence(labels, fill, grid, least_pit)]
    if "LWSE" in objects.columns:
        parts.append(depth_metrics(labels, dem, objects, area))
    for part in parts:
        objects = objects.join(part.withColumnRenamed("object_id", "ID"), "ID", "left")
    return objects
