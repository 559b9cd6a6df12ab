"""Moving windows over dense cell tables, as separable passes along rows and columns.

Windows are ranges of coordinates, so each pass is one shuffle by row or by
column, streams through its partition, and needs no join.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inundata.operators.grid import Grid, from_db, restore_nodata, to_db


def _mirrored(cells: DataFrame, axis: str, size: int, reach: int) -> DataFrame:
    """Cells with those near both ends repeated beyond them, the edge pixel included."""
    k = F.col(axis)
    copies = [k, F.when(k < reach, -1 - k), F.when(k >= size - reach, 2 * size - 1 - k)]
    spots = F.array_compact(F.array(*(x.cast("int") for x in copies)))
    return cells.withColumn(axis, F.explode(spots))


def _along(cells: DataFrame, axis: str, size: int, reach: int, by: list[str], terms: dict[str, Callable[[Column], Column]], reflect: bool = True) -> DataFrame:
    other = "r" if axis == "c" else "c"
    if reach > size:
        raise ValueError(f"a window that reaches {reach} pixels needs as many, the grid has {size}")
    wide = _mirrored(cells, axis, size, reach) if reflect else cells
    w = Window.partitionBy(*by, other).orderBy(axis).rangeBetween(-reach, reach)
    done = wide.withColumns({k: f(F.col(k)).over(w) for k, f in terms.items()})
    return done.where((F.col(axis) >= 0) & (F.col(axis) < size)) if reflect else done


def _both(cells: DataFrame, grid: Grid, reach: int, by: list[str], terms: dict[str, Callable[[Column], Column]], reflect: bool = True) -> DataFrame:
    return _along(_along(cells, "c", grid.width, reach, by, terms, reflect), "r", grid.height, reach, by, terms, reflect)


def box_stats(cells: DataFrame, grid: Grid, size: int = 7, by: list[str] | None = None) -> DataFrame:
    """Mean and variance of the valid pixels in a size x size box, mirrored at the edges: adds mean and var."""
    v = F.col("v")
    start = cells.withColumns({"_n": F.when(v.isNotNull(), 1.0).otherwise(0.0), "_s": F.coalesce(v, F.lit(0.0)), "_q": F.coalesce(v * v, F.lit(0.0))})
    sums = _both(start.withColumn("_v", v), grid, size // 2, by or [], {"_n": F.sum, "_s": F.sum, "_q": F.sum})
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    var = F.when(F.col("_n") > 0, F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    return sums.select(*(by or []), "r", "c", "v", mean.alias("mean"), var.alias("var"))


def _lee_value(enl: float) -> Column:
    noise = F.col("mean") * F.col("mean") / enl
    k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("var") / (F.col("var") + noise + 1e-15)))
    return F.col("mean") + k * (F.col("v") - F.col("mean"))


def lee(cells: DataFrame, grid: Grid, size: int = 7, enl: float = 4.9, by: list[str] | None = None) -> DataFrame:
    """Lee speckle filter of linear values; cells without data stay so."""
    stats = box_stats(cells, grid, size, by)
    return stats.select(*(by or []), "r", "c", _lee_value(enl).alias("v"))


def enhanced_lee(cells: DataFrame, grid: Grid, size: int = 7, enl: float = 4.9, cu: float = 0.523, cmax: float = 1.73, by: list[str] | None = None) -> DataFrame:
    """Lee filter that keeps strong points and takes the plain mean where little varies."""
    stats = box_stats(cells, grid, size, by)
    ci = F.sqrt("var") / (F.col("mean") + 1e-15)
    v = F.when(F.col("v").isNull(), None).when(ci <= cu, F.col("mean")).when(ci >= cmax, F.col("v")).otherwise(_lee_value(enl))
    return stats.select(*(by or []), "r", "c", v.alias("v"))


def speckle_filter(cells: DataFrame, grid: Grid, size: int = 7, enl: float = 4.9, enhanced: bool = False, db: bool = True) -> DataFrame:
    """Lee filter of each band (column band, if there), in decibels unless ``db`` is false; nodata as the grid says."""
    if size % 2 == 0 or enl <= 0:
        raise ValueError("the window size must be odd and the number of looks positive")
    by = [c for c in ("band",) if c in cells.columns]
    work = cells if grid.nodata is None else cells.withColumn("v", F.when(F.col("v") != grid.nodata, F.col("v")))
    if db:
        work = work.withColumn("v", from_db(F.col("v")))
    out = (enhanced_lee if enhanced else lee)(work, grid, size, enl, by=by)
    if db:
        out = out.withColumn("v", to_db(F.col("v")))
    return restore_nodata(out, grid.nodata)


def check_unit(cells: DataFrame, db: bool = True) -> bool:
    """Warns, and returns true, if values that should be decibels look like linear power."""
    low, high = cells.agg(F.min("v"), F.max("v")).first()
    odd = bool(db and low is not None and low > 0 and high < 2)
    if odd:
        warnings.warn("all values lie between 0 and 2: are they linear power rather than decibels?", stacklevel=2)
    return odd


def gaussian(cells: DataFrame, grid: Grid, sigma: float = 1.5) -> DataFrame:
    """Gaussian smoothing, cut at four sigma and mirrored at the edges; sigma 0 changes nothing."""
    if not sigma:
        return cells
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    total = sum(weights)

    def smooth(df: DataFrame, axis: str, size: int) -> DataFrame:
        other = "r" if axis == "c" else "c"
        wide = _mirrored(df, axis, size, reach)
        w = Window.partitionBy(other).orderBy(axis)
        taps = [F.lag("v", -i).over(w) * (weights[i + reach] / total) for i in range(-reach, reach + 1)]
        done = wide.withColumn("v", sum(taps[1:], taps[0]))
        return done.where((F.col(axis) >= 0) & (F.col(axis) < size))

    return smooth(smooth(cells, "c", grid.width), "r", grid.height)


def erode(mask: DataFrame, grid: Grid, shape: list[tuple[int, int]] | None = None) -> DataFrame:
    """Cells of a dense 0/1 table whose whole 3 x 3 square, or ``shape`` of offsets, is set; beyond the edge nothing is."""
    if shape is not None:
        return _by_offsets(mask, grid, shape, all_of=True)
    inner = (F.col("r") > 0) & (F.col("r") < grid.height - 1) & (F.col("c") > 0) & (F.col("c") < grid.width - 1)
    least = _both(mask, grid, 1, [], {"v": F.min}, reflect=False)
    return least.withColumn("v", F.when(inner, F.col("v")).otherwise(0))


def dilate(mask: DataFrame, grid: Grid, shape: list[tuple[int, int]] | None = None) -> DataFrame:
    """Cells with any set cell in their 3 x 3 square, or in ``shape``."""
    if shape is not None:
        return _by_offsets(mask, grid, [(-i, -j) for i, j in shape], all_of=False)
    return _both(mask, grid, 1, [], {"v": F.max}, reflect=False)


def _by_offsets(mask: DataFrame, grid: Grid, shape: list[tuple[int, int]], all_of: bool) -> DataFrame:
    offsets = F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j")) for i, j in shape))
    hit = mask.where("v = 1").select("r", "c", F.explode(offsets).alias("o")).select((F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    n = hit.groupBy("r", "c").agg(F.count("*").alias("n"))
    return mask.select("r", "c").join(n, ["r", "c"], "left").select("r", "c", (F.coalesce("n", F.lit(0)) >= (len(shape) if all_of else 1)).cast("int").alias("v"))


def smooth_mask(mask: DataFrame, grid: Grid, steps: str = "eded", shape: list[tuple[int, int]] | None = None) -> DataFrame:
    """Erosions (e) and dilations (d) one after another."""
    for s in steps.lower():
        if s not in "ed":
            raise ValueError(f"{s!r} is neither e nor d")
        mask = (erode if s == "e" else dilate)(mask, grid, shape)
    return mask


def local_max(cells: DataFrame, grid: Grid) -> DataFrame:
    """v 1 where no neighbour among the eight is higher; plateaus count throughout."""
    top = _both(cells.withColumn("_v", F.col("v")), grid, 1, [], {"v": F.max}, reflect=False)
    return top.select("r", "c", (F.col("_v") >= F.col("v")).cast("int").alias("v"))
