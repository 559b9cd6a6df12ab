"""Flood objects: attributes, transferred labels, predictions in grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from inundata.functions import density
from inundata.operators.grid import Grid

#: Codes of ``predict``; there is no code 3.
CODES = {0: "too small", 1: "large", 2: "depression water", 4: "level too high", 5: "level low, kept", 6: "far from flood", 7: "near flood"}
#: Codes that count as flood in the filtered mask, and in validation.
MASK_CODES, FLOOD_CODES = (1, 2, 5, 7), (1, 5, 7)


@F.pandas_udf(DoubleType())
def density_peak(v: pd.Series) -> float:
    """Most frequent value of a group by kernel density."""
    found = density.peak(v.to_numpy(dtype=float))
    return None if found != found else found


def level_of(method: str):
    """Aggregate of column v that stands for a group's water level."""
    methods = {"kde": lambda v: density_peak(v), "mean": F.avg, "median": lambda v: F.percentile(v, F.lit(0.5)), "max": F.max}
    if method not in methods:
        raise ValueError(f"unknown level method {method!r}")
    return methods[method]


def object_attributes(labels: DataFrame, grid: Grid, dem: DataFrame | None = None, method: str = "kde", pixel_area_km2: float | None = None) -> DataFrame:
    """One row per object_id of (r, c, object_id): ID, area, centroid and, with a terrain, elevations and level."""
    area = grid.pixel_area_km2 if pixel_area_km2 is None else pixel_area_km2
    sizes = [F.count("*").alias("area_px"), F.avg("r").alias("cent_row"), F.avg("c").alias("cent_col")]
    if dem is None:
        out = labels.groupBy("object_id").agg(*sizes)
    else:
        v = F.col("v")
        ground = labels.join(dem.select("r", "c", "v"), ["r", "c"], "left")
        stats = ground.groupBy("object_id").agg(*sizes, F.avg(v).alias("elev_mean"), F.stddev_pop(v).alias("elev_std"), F.min(v).alias("elev_min"), F.max(v).alias("elev_max"))
        levels = ground.groupBy("object_id").agg(level_of(method)(v).alias("LWSE"))  # a Python aggregate can't share a plan with built-in ones
        out = stats.join(levels, "object_id", "left")
    at = (F.col("cent_row"), F.col("cent_col"))
    place = {"area_km2": F.col("area_px") * area, "x": grid.x(*at), "y": grid.y(*at)}
    return out.withColumns(place).withColumnRenamed("object_id", "ID")


def transfer_labels(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """(new_id, old_id, overlap, label): each new object takes the label of the old one it shares most cells with.

    ``known`` has object_id and label; label 3 counts as 0, others than 0 and 1 too.
    """
    both = new.select("r", "c", F.col("object_id").alias("new_id")).join(old.select("r", "c", F.col("object_id").alias("old_id")), ["r", "c"])
    n = both.groupBy("new_id", "old_id").agg(F.count("*").alias("overlap"))
    best = n.groupBy("new_id").agg(F.max(F.struct("overlap", (-F.col("old_id")).alias("o"))).alias("m")).select("new_id", (-F.col("m.o")).alias("old_id"), "m.overlap")
    label = F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(0).cast("int")
    return best.join(known.select(F.col("object_id").alias("old_id"), label.alias("label")), "old_id").select("new_id", "old_id", "overlap", "label")


def keep_objects(labels: DataFrame, objects: DataFrame, codes: tuple[int, ...] = (1,)) -> DataFrame:
    """Cells of the objects with one of the codes; the others are background."""
    good = objects.where(F.col("predict").isin(*codes)).select(F.col("ID").alias("object_id")).distinct()
    return labels.join(good, "object_id", "left_semi").select("r", "c", "object_id")


def flood_mask(labels: DataFrame, objects: DataFrame, codes: tuple[int, ...] = MASK_CODES) -> DataFrame:
    """Cells (r, c) of the objects that pass the filter."""
    return keep_objects(labels, objects, codes).select("r", "c")


def predictions(labels: DataFrame, objects: DataFrame) -> DataFrame:
    """(r, c, predict) of all object cells, -1 for objects without a code."""
    codes = objects.select(F.col("ID").alias("object_id"), "predict")
    return labels.join(codes, "object_id", "left").select("r", "c", F.coalesce("predict", F.lit(-1)).alias("predict"))


def summary(objects: DataFrame) -> DataFrame:
    """Number of objects of each code, those without one too."""
    return objects.groupBy("predict").agg(F.count("*").alias("n")).orderBy(F.col("predict").asc_nulls_last())


def validate(objects: DataFrame, label: str = "label") -> DataFrame | None:
    """One row of counts and scores of the codes against a label of 0, 1 (3 counts as 0); none without the column."""
    if label not in objects.columns:
        return None
    truth = F.when(F.col(label) == 3, 0).otherwise(F.col(label))
    flood = F.coalesce(F.col("predict").isin(*FLOOD_CODES).cast("int"), F.lit(0))
    hit = lambda a, b: F.coalesce(F.sum(((truth == a) & (flood == b)).cast("long")), F.lit(0))
    n = objects.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n = n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    p, r = F.col("precision"), F.col("recall")
    return n.withColumn("f1", ratio(2 * p * r, p + r))


def position_in(df: DataFrame, keys: list[str], order: list[str], size: int, name: str = "segment_id") -> DataFrame:
    """Numbers the rows of each group in runs of ``size``."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(name, F.floor(at / size).cast("int"))
