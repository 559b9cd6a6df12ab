"""The stages of a flood map, each made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.operators import components, focal, grid as g, interp, objects, segments, terrain, threshold
from inundata.operators.grid import Grid
from inundata.operators.rules import ObjectRules
from inundata.storage import Scratch


def prepare(scenes: list[DataFrame], occurrence: DataFrame, of: Grid, occurrence_grid: Grid, water: float = 20, kind: str = "SAR", nir: int = 1) -> tuple[DataFrame, DataFrame, Grid]:
    """Mosaic, band, crop to the data and water seed on the same grid."""
    layers = [g.band(s, kind, nir) if "band" in s.columns else s for s in scenes]
    whole = g.mosaic(layers)
    b = g.valid_bounds(whole, of.nodata).first()
    crop = Grid(b.c1 - b.c0, b.r1 - b.r0, of.a, of.b, of.c0 + b.c0 * of.a + b.r0 * of.b, of.d, of.e, of.f0 + b.c0 * of.d + b.r0 * of.e, of.epsg, of.nodata)
    return g.window(whole, b.r0, b.r1, b.c0, b.c1), g.seed(g.nearest(occurrence, occurrence_grid, crop), water), crop


def detect(band: DataFrame, seed: DataFrame, grid: Grid, cut: float, least_object: int = 100, least_hole: int = 10_000, db: bool = True) -> DataFrame:
    """Flood mask: speckle filter, growth from seeds under a threshold, clean-up."""
    smooth = focal.speckle_filter(band, grid, db=db)
    return components.post_process(components.region_grow(smooth, seed, grid, cut), grid, least_object, least_hole)


def threshold_surface(band: DataFrame, grid: Grid, tile_size: float = 5000, kind: str = "SAR", cutoff: float = 0.555) -> tuple[DataFrame, DataFrame]:
    """Threshold surface of the tiles with two kinds of values, and the band classified by it."""
    scratch = Scratch(band.sparkSession)
    tiles, values = threshold.tiles_and_cells(band, grid, tile_size=tile_size)
    fits = threshold.mixture_thresholds(values.select("tile_id", "v"), tiles, kind)
    points = scratch.keep(threshold.threshold_points(tiles, fits), "points")  # outliers are judged by all, the surface counts and reads what is left
    good = scratch.keep(threshold.drop_outliers(points, cutoff), "good")
    surface = interp.idw(band.select("r", "c"), good.withColumnRenamed("threshold", "z"), grid)
    return surface, g.classify(band, surface)


def assess(mask: DataFrame, dem: DataFrame, grid: Grid, least_back: int = 100, threshold_px: int = 50, least_reference: int = 100, k: int = 5) -> tuple[DataFrame, ObjectRules]:
    """Flood objects, and the rules' verdict on each."""
    scratch = Scratch(mask.sparkSession)
    labels = scratch.keep(components.flood_objects(mask, grid, least_back=least_back), "labels")
    table = terrain.add_depression_attributes(objects.object_attributes(labels, grid, dem), labels, dem, grid)
    table = scratch.keep(table, "objects")
    first = ObjectRules.start(table).small(threshold_px).large()
    large = objects.keep_objects(labels, first.results())
    reference = segments.reference_layer(large, dem, grid, least_reference, k=k).withColumn("segment_id", F.xxhash64("object_id", "segment_id"))
    return labels, ObjectRules.start(table).run(scratch.keep(reference, "reference"), threshold_px, k)


def reconstruct(mask: DataFrame, dem: DataFrame, grid: Grid, least: int = 100, points: int = 200, k: int = 8, max_points: int = 12, power: float = 3.0) -> DataFrame:
    """Depth and class of the water that the mask (v 1) and the levels at its outlines imply."""
    with Scratch(mask.sparkSession) as scratch:
        big = scratch.save(components.sized(components.label(mask.where("v > 0").select("r", "c", F.lit(1).alias("v")), grid, scratch=scratch), least), "large")
        labels = scratch.save(components.numbered(big, scratch), "labels", keep=True)
        levels = scratch.save(segments.level_layer(labels, dem, grid, least, points, k), "levels", keep=True)
        surface = interp.idw(dem.select("r", "c"), levels.withColumnRenamed("LWSE_new", "z"), grid, power, 0.0, max_points)
        return interp.depth_class(surface, dem, mask, grid)
