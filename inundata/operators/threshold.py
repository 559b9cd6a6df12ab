"""Local thresholds between water and land: tiles, mixtures of gamma densities, outliers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inundata.functions.special import inverse_digamma, logsumexp
from inundata.operators.grid import Grid
from inundata.storage import Scratch

#: Start of the fit: shapes and rates of the two components for each image type.
START = {"SAR": ((18.0, 31.0), (1.0, 2.0)), "optical": ((12.0, 10.0), (1.8, 0.33))}
#: Steps of the fit, bins of the threshold, scale of optical values, failed thresholds on disk.
STEPS, BINS, OPTICAL_SCALE, FAILED = 100, 1000, 100.0, -9999.0


_TILE = ["r0", "c0", "h", "w"]


def _tile_levels(cells: DataFrame, grid: Grid, threshold: float, tile_size: float, levels: int, scratch: Scratch | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """For each level the open cells with their tile, and the tiles that it accepts.

    Each level reads the one before twice. With ``scratch`` levels are saved,
    else the plan doubles level by level.
    """
    base = int(tile_size / grid.resolution)
    if base < 1:
        raise ValueError("tiles are smaller than a pixel")
    now = cells.select("r", "c", "v", F.expr(f"cast(r div {base} as int) * {base}").alias("r0"), F.expr(f"cast(c div {base} as int) * {base}").alias("c0"))
    now = now.withColumns({"h": F.least(F.lit(base), grid.height - F.col("r0")), "w": F.least(F.lit(base), grid.width - F.col("c0"))})
    out = []
    for level in range(1, levels + 1):
        if scratch:
            now = scratch.save(now, "open")
        tiles = now.groupBy(*_TILE).agg(F.avg("v").alias("mean"))
        if scratch:
            tiles = scratch.save(tiles, "means")
        good = (F.col("mean") > threshold) & (F.col("mean") < 1 - threshold)
        out.append((now, tiles.where(good).withColumn("level", F.lit(level))))
        if level < levels:
            rest = now.join(tiles.where(~F.coalesce(good, F.lit(False))).select(*_TILE), _TILE, "left_semi")
            h, w = F.expr("h div 2").cast("int"), F.expr("w div 2").cast("int")
            rest = rest.withColumns({"_h": h, "_w": w}).where("_h > 0 and _w > 0")
            rest = rest.withColumns({"_i": F.expr("cast((r - r0) div _h as int)"), "_j": F.expr("cast((c - c0) div _w as int)")}).where("_i < 2 and _j < 2")
            now = rest.select("r", "c", "v", (F.col("r0") + F.col("_i") * F.col("_h")).alias("r0"), (F.col("c0") + F.col("_j") * F.col("_w")).alias("c0"), F.col("_h").alias("h"), F.col("_w").alias("w"))
    return out


def _tile_id(grid: Grid) -> Column:
    return (F.col("r0").cast("long") * grid.width + F.col("c0")) * 100 + F.col("level")


def quadtree(cells: DataFrame, grid: Grid, threshold: float = 0.3, tile_size: float = 5000, levels: int = 4) -> DataFrame:
    """Tiles (tile_id, r0, c0, h, w, mean, level, min_x, min_y, max_x, max_y) whose mean lies between threshold and 1 - threshold.

    A tile that doesn't qualify falls into four of half its size, rounded down,
    until the levels are used up. Each level is one aggregation of the cells
    that no accepted tile holds; a cell's tile is arithmetic on its position.
    """
    return _placed([tiles for _, tiles in _tile_levels(cells, grid, threshold, tile_size, levels)], grid)


def _placed(parts: list[DataFrame], grid: Grid) -> DataFrame:
    found = parts[0]
    for t in parts[1:]:
        found = found.unionByName(t)
    r, c = F.col("r0"), F.col("c0")
    return found.withColumns({"tile_id": _tile_id(grid), "min_x": grid.x(r, c), "max_x": grid.x(r + F.col("h"), c + F.col("w")), "min_y": grid.y(r + F.col("h"), c + F.col("w")), "max_y": grid.y(r, c)})


def cells_in_tiles(cells: DataFrame, grid: Grid, threshold: float = 0.3, tile_size: float = 5000, levels: int = 4) -> DataFrame:
    """(tile_id, mean, v): the cells of each tile of the same quadtree, by its key and without a range join."""
    return _held(_tile_levels(cells, grid, threshold, tile_size, levels), grid)


def _held(parts: list[tuple[DataFrame, DataFrame]], grid: Grid) -> DataFrame:
    found = None
    for now, tiles in parts:
        held = now.join(tiles, _TILE).select(_tile_id(grid).alias("tile_id"), "mean", "v")
        found = held if found is None else found.unionByName(held)
    return found


def tiles_and_cells(cells: DataFrame, grid: Grid, threshold: float = 0.3, tile_size: float = 5000, levels: int = 4) -> tuple[DataFrame, DataFrame]:
    """``quadtree`` and ``cells_in_tiles`` in one go, as saved tables: for stages that read them more than once."""
    with Scratch(cells.sparkSession) as scratch:
        parts = _tile_levels(cells, grid, threshold, tile_size, levels, scratch)
        return scratch.keep(_placed([tiles for _, tiles in parts], grid), "tiles"), scratch.keep(_held(parts, grid), "cells")


def bimodality(v: str = "v") -> Column:
    """Aggregate: bimodality coefficient of a group, null for fewer than four values or without spread."""
    n = F.count(v)
    skew, excess = F.skewness(v), F.kurtosis(v)
    return F.when(n > 3, (skew * skew + 1) / (excess + 3 * (n - 1) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3))))


def fit_gammas(x: np.ndarray, alpha: tuple[float, float], rate: tuple[float, float], weights: tuple[float, float], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and rates of two gamma densities with fixed weights, by expectation and maximisation."""
    a, b, w = np.array(alpha, float), np.array(rate, float), np.log(np.maximum(weights, 1e-300))
    logs = np.log(x)
    for _ in range(steps):
        lg = np.array([math.lgamma(v) for v in a])
        joint = w[:, None] + (a * np.log(b) - lg)[:, None] + (a - 1)[:, None] * logs - b[:, None] * x
        p = np.exp(joint - logsumexp(joint, 0))
        mass = p.sum(axis=1)
        target = (p @ logs + np.log(b) * mass) / mass
        b = a * mass / (p @ x)
        a = np.array([max(inverse_digamma(t), 1e-8) if math.isfinite(t) else float("nan") for t in target])
    return a, b


def pick_threshold(low: float, high: float, alpha: np.ndarray, rate: np.ndarray, weights: tuple[float, float]) -> float | None:
    """Bin between the two modes where the weighted densities are nearest; the first bin without range, none without bins."""
    if not low < high:
        return low
    bins = np.linspace(low, high, BINS)
    modes = [(a - 1) / b * BINS / (high - low) for a, b in zip(alpha, rate)]
    if not all(map(math.isfinite, modes)):
        return None
    start, end = max(1, min(map(int, modes))), min(BINS - 1, max(map(int, modes)))
    if start >= end:
        return None
    at = bins[start:end]
    with np.errstate(all="ignore"):
        f = [w * np.exp(a * math.log(b) - math.lgamma(a) + (a - 1) * np.log(at) - b * at) for a, b, w in zip(alpha, rate, weights)]
    return float(at[np.abs(f[0] - f[1]).argmin()])


def tile_threshold(x: np.ndarray, mean: float, kind: str = "SAR", start: tuple | None = None) -> float | None:
    """Threshold of one tile's values; the tile's mean weighs the first component."""
    x = x[np.isfinite(x)] * (OPTICAL_SCALE if kind == "optical" else 1.0)
    if not len(x):
        return None
    shift = x.min() - 2
    weights = (mean, 1 - mean)
    try:
        alpha, rate = fit_gammas(x - shift, *(start or START[kind]), weights)
        found = pick_threshold(2.0, float(x.max() - shift), alpha, rate, weights)
    except (ValueError, FloatingPointError, ZeroDivisionError, OverflowError):
        return None
    return None if found is None or found < 0 else (found + shift) / (OPTICAL_SCALE if kind == "optical" else 1.0)


def mixture_thresholds(values: DataFrame, tiles: DataFrame, kind: str = "SAR", start: tuple | None = None) -> DataFrame:
    """(tile_id, threshold, BC) of values (tile_id, v) with tiles (tile_id, mean): one fit per tile, none depends on another."""
    if kind not in START:
        raise ValueError(f"unknown image type {kind!r}")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = tile_threshold(pdf["v"].to_numpy(float), float(pdf["mean"].iloc[0]), kind, start)
        return pd.DataFrame({"tile_id": [pdf["tile_id"].iloc[0]], "threshold": [found]}).astype({"threshold": float})

    joined = values.where("v is not null").join(tiles.select("tile_id", "mean"), "tile_id")
    fits = joined.groupBy("tile_id").applyInPandas(fit, "tile_id long, threshold double")
    scores = values.groupBy("tile_id").agg(bimodality().alias("BC"))
    return fits.select("tile_id", F.nanvl("threshold", F.lit(None).cast("double")).alias("threshold")).join(scores, "tile_id")


def threshold_points(tiles: DataFrame, fits: DataFrame) -> DataFrame:
    """Points at the tile centres with thresholds as they go to disk: id, x, y, threshold (-9999 if failed), BC."""
    at = tiles.join(fits, "tile_id")
    return at.select(F.col("tile_id").alias("id"), ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y"), F.coalesce("threshold", F.lit(FAILED)).alias("threshold"), "BC")


def drop_outliers(points: DataFrame, cutoff: float = 0.555, sentinel: bool = True) -> DataFrame:
    """Threshold points near the mean: within 2 deviations if bimodal, within 1.5 if not; a coefficient at the cutoff drops out.

    With ``sentinel`` the -9999 of failed fits counts as a value, as on disk.
    Nothing left to judge is an error when the result is read.
    """
    t = F.col("threshold")
    known = points.where(t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf")))
    if not sentinel:
        known = known.where(t != FAILED)
    m = known.agg(F.avg("threshold").alias("_m"), F.stddev_pop("threshold").alias("_s"), F.count("*").alias("_n"))
    m = m.select("_s", F.when(F.col("_n") > 0, F.col("_m")).otherwise(F.raise_error(F.lit("no tile has a valid threshold")).cast("double")).alias("_m"))
    d = F.abs(t - F.col("_m"))
    keep = ((F.col("BC") > cutoff) & (d < 2 * F.col("_s"))) | ((F.col("BC") < cutoff) & (d < 1.5 * F.col("_s")))
    return known.crossJoin(F.broadcast(m)).where(keep).drop("_m", "_s")  # one row
