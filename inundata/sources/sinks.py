"""What leaves the engine: rasters, points, object tables and their short names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Short names of the volumes that are written in millions.
SCALED_NAMES = {"depre_vol": "depre_vMm3", "depth_vol": "depth_vMm3"}
#: Longest column name of a point layer, and the size from which values are written in millions.
NAME, LARGE = 10, 1e9
#: Pairs of columns that can be a point's place; the first present counts.
PLACES = (("x", "y"), ("cent_x", "cent_y"), ("X", "Y"))


def scaled_names(columns: list[str], large: set[str]) -> dict[str, str]:
    """New names of the columns that are divided by a million; one that is taken already ends in a number instead."""
    out: dict[str, str] = {}
    taken = set(columns) - large
    for c in (c for c in columns if c in large):
        name, n = SCALED_NAMES.get(c, c[:8] + "_M"), 1
        base = name
        while name in taken:
            name, n = f"{base[:9]}{n}", n + 1
        taken.add(name)
        out[c] = name
    return out


def short_names(columns: list[str]) -> dict[str, str]:
    """Names of ten letters at most; the second of two equal ones ends in a number."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for c in columns:
        name, n = c[:NAME], 1
        while name in taken:
            tail = str(n)
            name, n = c[: NAME - len(tail)] + tail, n + 1
        taken.add(name)
        out[c] = name
    return out


def point_layer(objects: DataFrame) -> DataFrame | None:
    """Objects as points: large numbers in millions, short names, rows with a place only; none without place columns.

    One aggregation finds the greatest magnitudes of all numeric columns.
    """
    place = next((p for p in PLACES if all(c in objects.columns for c in p)), None)
    if place is None:
        return None
    numeric = [f.name for f in objects.schema.fields if isinstance(f.dataType, NumericType) and not any(f.name in p for p in PLACES)]
    top = objects.agg(*(F.max(F.abs(F.col(c))).alias(c) for c in numeric)).first().asDict() if numeric else {}
    large = {c for c, v in top.items() if v is not None and v == v and v > LARGE}
    new = scaled_names(objects.columns, large)
    scaled = objects.select(*((F.col(c) / 1e6).alias(new[c]) if c in new else F.col(c) for c in objects.columns))
    scaled = scaled.where(F.col(place[0]).isNotNull() & F.col(place[1]).isNotNull())
    names = short_names(scaled.columns)
    return scaled.select(*(F.col(c).alias(names[c]) for c in scaled.columns))


def save_results(objects: DataFrame, folder: str, prefix: str = "object_predict") -> tuple[str, str]:
    """Writes all columns as CSV and the point layer as Parquet; returns both paths, the second empty without places."""
    table, points = f"{folder}/{prefix}.csv", f"{folder}/{prefix}.points"
    objects.write.mode("overwrite").option("header", True).csv(table)
    layer = point_layer(objects)
    if layer is None:
        return table, ""
    layer.write.mode("overwrite").parquet(points)
    return table, points


def as_bytes(cells: DataFrame) -> DataFrame:
    """Values cut to whole numbers of 0 to 255, as a one-byte raster holds them."""
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.col("v").cast("int")))
    return cells.select("r", "c", F.when(F.col("v").isNotNull(), v).cast("short").alias("v"))


def save_raster(cells: DataFrame, path: str, dtype: str = "float", nodata: float | None = None, tile: int = 512) -> None:
    """Cells as Parquet, sorted within tiles so that windows are pruned by row group."""
    v = F.col("v") if nodata is None else F.coalesce("v", F.lit(float(nodata)))
    out = cells.select("r", "c", v.cast(dtype).alias("v")).repartition(F.expr(f"r div {tile}"), F.expr(f"c div {tile}")).sortWithinPartitions("r", "c")
    out.write.mode("overwrite").parquet(path)


def tile_polygons(tiles: DataFrame) -> DataFrame:
    """Tiles with their outline as well-known text."""
    p = lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    ring = F.concat_ws(", ", p("min_x", "min_y"), p("max_x", "min_y"), p("max_x", "max_y"), p("min_x", "max_y"), p("min_x", "min_y"))
    return tiles.withColumn("wkt", F.concat(F.lit("POLYGON (("), ring, F.lit("))")))
