"""Connected regions of cells: labels, sizes, holes and growth from seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inundata.graph import components
from inundata.operators.grid import Grid
from inundata.storage import Scratch, shuffled

#: Rows and columns of the tiles that are labelled each for itself.
TILE = 512


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the edges a-b."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        before = low.copy()
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != low[low]).any():
            low = low[low]
        if (low == before).all():
            return low


def label_tile(r: np.ndarray, c: np.ndarray, v: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each cell of one tile the position, in row order, of the first cell of its region of equal v."""
    order = np.lexsort((c, r))
    r, c, v = r[order], c[order], v[order]
    r0, c0 = r.min(), c.min()
    at = np.full((r.max() - r0 + 3, c.max() - c0 + 3), -1, np.int64)
    at[r - r0 + 1, c - c0 + 1] = np.arange(len(r))
    a, b = [], []
    for i, j in ((0, 1), (1, 0), (1, 1), (1, -1)) if diagonal else ((0, 1), (1, 0)):
        near = at[r - r0 + 1 + i, c - c0 + 1 + j]
        ok = (near >= 0) & (v[near] == v)
        a.append(np.flatnonzero(ok))
        b.append(near[ok])
    low = roots(len(r), np.concatenate(a), np.concatenate(b))
    out = np.empty(len(r), np.int64)
    out[order] = order[low]
    return out


def label(cells: DataFrame, grid: Grid, diagonal: bool = True, by_value: bool = False, tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """(r, c, v, label): the cells given, with the least row * width + col of their connected region.

    With ``by_value`` regions hold equal v only. Tiles are labelled on their
    own; where regions touch over a tile's border their labels become an edge,
    and components of those edges join them. A border has few cells against its
    tile, and no region is ever gathered in one place.
    """
    own = scratch or Scratch(cells.sparkSession)
    w = grid.width

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        v = pdf["v"].to_numpy() if by_value else np.zeros(len(pdf), np.int64)
        first = label_tile(r, c, v, diagonal)
        return pdf.assign(local=r[first].astype(np.int64) * w + c[first])

    keyed = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    tiled = keyed.groupBy(F.expr(f"r div {tile}").alias("_i"), F.expr(f"c div {tile}").alias("_j"))
    locals_ = own.save(tiled.applyInPandas(one, "r int, c int, v double, local long"), "tiles", keep=True)
    edge = locals_.where(f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})")
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if diagonal else [(0, 1), (1, 0)]
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))
    reach = edge.select("r", "c", "v", F.col("local").alias("a"), F.explode(offsets).alias("o")).select((F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), F.col("v").alias("v0"), "a")
    touching = reach.join(shuffled(edge.select("r", "c", "v", F.col("local").alias("b"))), ["r", "c"]).where("a <> b" + (" and v0 = v" if by_value else ""))
    joined = components(touching.select("a", "b").distinct(), own)
    return locals_.join(joined.select(F.col("node").alias("local"), "component"), "local", "left").select("r", "c", "v", F.coalesce("component", "local").alias("label"))


def numbered(labels: DataFrame, scratch: Scratch | None = None, parts: int = 64) -> DataFrame:
    """Labels replaced by 1 to n in their order, as object_id.

    Sorted in ranges; the sizes of the ranges, ``parts`` numbers, give each its
    first number. The cells stand on the left of a left join, so that they are
    never the side that is broadcast; each has its label on the right.
    """
    own = scratch or Scratch(labels.sparkSession)
    distinct = labels.select("label").distinct().repartitionByRange(parts, "label").withColumn("part", F.spark_partition_id())
    distinct = own.save(distinct, "labels", keep=True)
    sizes = sorted((r["part"], r["count"]) for r in distinct.groupBy("part").count().collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    first = labels.sparkSession.createDataFrame(starts or [(0, 0)], "part int, before long")
    ids = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("label"))).join(F.broadcast(first), "part")
    return labels.join(ids.select("label", (F.col("before") + F.col("nth")).alias("object_id")), "label", "left").select("r", "c", "object_id")


def sized(labels: DataFrame, least: int) -> DataFrame:
    """Labelled cells of regions with ``least`` cells or more; counts are aggregated before they meet the cells."""
    big = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("label")
    return labels.join(big, "label", "left_semi").select("r", "c", "v", "label")


def remove_small(mask: DataFrame, grid: Grid, least: int, diagonal: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Set cells (r, c) of a 0/1 table in regions of ``least`` cells or more."""
    return sized(label(mask.where("v = 1"), grid, diagonal, scratch=scratch), least).select("r", "c")


def fill_holes(mask: DataFrame, grid: Grid, least: int, diagonal: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """A 0/1 table with the regions of unset cells under ``least`` cells set, those at the edge too."""
    kept = sized(label(mask.where("v = 0"), grid, diagonal, scratch=scratch), least).select("r", "c", F.lit(0).alias("k"))
    return mask.select("r", "c").join(kept, ["r", "c"], "left").select("r", "c", F.when(F.col("k").isNull(), 1).otherwise(0).alias("v"))


def as_mask(spark_cells: DataFrame, grid: Grid) -> DataFrame:
    """Dense 0/1 table of the given (r, c)."""
    hit = spark_cells.select("r", "c", F.lit(1).alias("k"))
    return grid.cells(spark_cells.sparkSession).join(hit, ["r", "c"], "left").select("r", "c", F.coalesce("k", F.lit(0)).alias("v"))


def grow(candidates: DataFrame, seeds: DataFrame, grid: Grid, diagonal: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Candidate cells (r, c) whose connected region has a seed; seeds that are no candidates give nothing."""
    labels = label(candidates.withColumn("v", F.lit(1)), grid, diagonal, scratch=scratch)
    hit = labels.join(shuffled(seeds.select("r", "c").distinct()), ["r", "c"], "left_semi").select("label").distinct()
    return labels.join(hit, "label", "left_semi").select("r", "c")


def region_grow(cells: DataFrame, seeds: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """Cells under the threshold that connect, by eight neighbours, to a seed (v over 0): dense 0/1 table.

    Without a nodata value zeros are no data.
    """
    ok = F.col("v").isNotNull() & ((F.col("v") != grid.nodata) if grid.nodata is not None else (F.col("v") != 0))
    grown = grow(cells.where(ok & (F.col("v") < threshold)).select("r", "c"), seeds.where("v > 0"), grid)
    return as_mask(grown, grid)


def post_process(mask: DataFrame, grid: Grid, least_object: int = 100, least_hole: int = 10_000) -> DataFrame:
    """Closing, opening, small regions removed, holes filled: dense 0/1 table. Null counts as unset."""
    from inundata.operators.focal import smooth_mask

    start = mask.select("r", "c", F.when(F.col("v") != 0, 1).otherwise(0).alias("v"))
    with Scratch(mask.sparkSession) as scratch:
        smooth = scratch.save(smooth_mask(start, grid, "deed"), "smooth")
        kept = scratch.save(as_mask(remove_small(smooth, grid, least_object, scratch=scratch), grid), "kept")
        return scratch.keep(fill_holes(kept, grid, least_hole, scratch=scratch))


def flood_objects(cells: DataFrame, grid: Grid, least_front: int = 0, least_back: int = 100, steps: str = "eded", diagonal: bool = True) -> DataFrame:
    """Numbered flood objects (r, c, object_id) of a table with v 1 for flood and null without data."""
    from inundata.operators.focal import smooth_mask

    with Scratch(cells.sparkSession) as scratch:
        valid = cells.where("v is not null").select("r", "c")
        start = cells.select("r", "c", F.when(F.col("v") == 1, 1).otherwise(0).alias("v"))
        smooth = smooth_mask(start, grid, steps) if steps else start
        smooth = scratch.save(smooth.where("v = 1").join(valid, ["r", "c"], "left_semi"), "smooth")
        kept = scratch.save(as_mask(remove_small(smooth, grid, least_front, diagonal, scratch), grid), "kept")
        full = fill_holes(kept, grid, least_back, diagonal, scratch).where("v = 1").join(valid, ["r", "c"], "left_semi")
        labels = scratch.keep(label(scratch.save(full, "full"), grid, diagonal, scratch=scratch), "labels")
        return numbered(labels, scratch)


def polygon_regions(cells: DataFrame, grid: Grid) -> DataFrame:
    """Regions of equal value by four neighbours: region_id, value, area_px and bounding box in rows and columns."""
    labels = label(cells.where("v is not null"), grid, diagonal=False, by_value=True)
    return labels.groupBy(F.col("label").alias("region_id"), F.col("v").alias("value")).agg(F.count("*").alias("area_px"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
