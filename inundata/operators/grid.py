"""Grids as cell tables: one row (r, c, v) for each pixel, a null v where there is no data."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Two grids are the same if pixel sizes and origins differ by less.
SAME_PIXEL, SAME_ORIGIN = 1e-6, 1e-3


@dataclass(frozen=True)
class Grid:
    """Size and placement of a raster: x = c0 + col * a + row * b, y = f0 + col * d + row * e."""

    width: int
    height: int
    a: float = 1.0
    b: float = 0.0
    c0: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f0: float = 0.0
    epsg: int | None = None
    nodata: float | None = None

    def require_north_up(self) -> Grid:
        if self.b or self.d:
            raise ValueError("the grid is rotated or sheared; rows and columns must follow the axes")
        return self

    def with_crs(self, epsg: int) -> Grid:
        return replace(self, epsg=epsg)

    @property
    def resolution(self) -> float:
        return (self.a + abs(self.e)) / 2

    @property
    def pixel_area_km2(self) -> float:
        return abs(self.a * self.e - self.b * self.d) / 1e6

    def x(self, r: Column, c: Column, shift: float = 0.0) -> Column:
        return F.lit(self.c0) + (c + shift) * self.a + (r + shift) * self.b

    def y(self, r: Column, c: Column, shift: float = 0.0) -> Column:
        return F.lit(self.f0) + (c + shift) * self.d + (r + shift) * self.e

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional (row, column) of a point."""
        det = self.a * self.e - self.b * self.d
        dx, dy = x - self.c0, y - self.f0
        return (dy * self.a - dx * self.d) / det, (dx * self.e - dy * self.b) / det

    def same_as(self, other: Grid) -> bool:
        near = lambda p, q, tol: all(abs(x - y) <= tol for x, y in zip(p, q))
        return (self.epsg, self.width, self.height) == (other.epsg, other.width, other.height) and near((self.a, self.b, self.d, self.e), (other.a, other.b, other.d, other.e), SAME_PIXEL) and near((self.c0, self.f0), (other.c0, other.f0), SAME_ORIGIN)

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every (r, c), made where it is needed."""
        n = spark.range(self.width * self.height)
        return n.select(F.expr(f"cast(id div {self.width} as int)").alias("r"), F.expr(f"cast(id % {self.width} as int)").alias("c"))


def clean(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    """NaN, infinite and nodata values become null."""
    v = F.col("v").cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    if nodata is not None:
        bad = bad | (v == nodata)
    return cells.withColumn("v", F.when(~bad, v))


def restore_nodata(cells: DataFrame, nodata: float | None) -> DataFrame:
    return cells if nodata is None else cells.withColumn("v", F.coalesce("v", F.lit(float(nodata))))


def is_valid(v: Column, nodata: float | None) -> Column:
    """Data: other than nodata, or without one finite and not zero."""
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return ok & (v != nodata) if nodata is not None else ok & (v != 0)


def window(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Cells of rows r0 to r1 - 1 and columns c0 to c1 - 1, counted from the corner; the bounds reach the scan."""
    inside = cells.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    return inside.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


def mosaic(layers: list[DataFrame]) -> DataFrame:
    """The first layer with data wins each cell."""
    rows = [df.select("r", "c", "v", F.lit(i).alias("i")) for i, df in enumerate(layers)]
    every = rows[0]
    for df in rows[1:]:
        every = every.unionByName(df)
    first = F.min(F.when(F.col("v").isNotNull(), F.struct("i", "v")))
    return every.groupBy("r", "c").agg(first.getField("v").alias("v"))


def valid_bounds(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    """One row (r0, r1, c0, c1), ends exclusive; an error when it is read if there is no data."""
    b = cells.where(is_valid(F.col("v"), nodata)).agg(F.min("r").alias("r0"), (F.max("r") + 1).alias("r1"), F.min("c").alias("c0"), (F.max("c") + 1).alias("c1"))
    return b.withColumn("r0", F.coalesce("r0", F.raise_error(F.lit("the raster has no valid pixel")).cast("int")))


def band(cells: DataFrame, kind: str = "SAR", nir: int = 1) -> DataFrame:
    """The band that detection works on: the only one of radar scenes, the near infrared of optical ones."""
    if kind not in ("SAR", "optical"):
        raise ValueError(f"unknown image type {kind!r}")
    if nir < 1:
        raise ValueError("bands count from 1")
    return cells.where(F.col("band") == (1 if kind == "SAR" else nir)).drop("band")


def seed(occurrence: DataFrame, threshold: float = 20) -> DataFrame:
    """Cells of water that was there before: (r, c, v) with v 1 where occurrence is over the threshold, else 0."""
    return occurrence.select("r", "c", F.when(F.col("v") > threshold, 1).otherwise(0).alias("v"))


def _source(target: DataFrame, to: Grid, of: Grid) -> DataFrame:
    """Target cells with the fractional source position of their centres."""
    x, y = to.x(F.col("r"), F.col("c"), 0.5), to.y(F.col("r"), F.col("c"), 0.5)
    r, c = of.pixel(x, y)
    return target.select("r", "c", r.alias("sr"), c.alias("sc"))


def nearest(cells: DataFrame, of: Grid, to: Grid) -> DataFrame:
    """Value of the source pixel that holds each target centre; null outside."""
    at = _source(to.cells(cells.sparkSession), to, of).select("r", "c", F.floor("sr").cast("int").alias("i"), F.floor("sc").cast("int").alias("j"))
    return at.join(cells.select(F.col("r").alias("i"), F.col("c").alias("j"), "v"), ["i", "j"], "left").select("r", "c", "v")


def _kernel(name: str):
    if name == "bilinear":
        return 1, lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t))
    if name == "cubic":
        near = lambda t: 1.5 * F.pow(t, 3) - 2.5 * F.pow(t, 2) + 1
        far = lambda t: -0.5 * F.pow(t, 3) + 2.5 * F.pow(t, 2) - 4 * t + 2
        return 2, lambda t: F.when(F.abs(t) <= 1, near(F.abs(t))).when(F.abs(t) < 2, far(F.abs(t))).otherwise(0.0)
    sinc = lambda t: F.when(t == 0, 1.0).otherwise(F.sin(math.pi * t) / (math.pi * t))
    return 3, lambda t: F.when(F.abs(t) < 3, sinc(t) * sinc(t / 3)).otherwise(0.0)


def weighted(cells: DataFrame, of: Grid, to: Grid, kernel: str = "bilinear") -> DataFrame:
    """Mean of the source pixels around each target centre by a separable kernel, over those with data."""
    reach, weight = _kernel(kernel)
    at = _source(to.cells(cells.sparkSession), to, of).withColumns({"fr": F.col("sr") - 0.5, "fc": F.col("sc") - 0.5})
    taps = F.sequence(F.lit(1 - reach), F.lit(reach))
    near = at.select("r", "c", "fr", "fc", F.explode(taps).alias("p")).select("*", F.explode(taps).alias("q"))
    near = near.withColumns({"i": (F.floor("fr") + F.col("p")).cast("int"), "j": (F.floor("fc") + F.col("q")).cast("int")})
    near = near.withColumn("w", weight(F.col("fr") - F.col("i")) * weight(F.col("fc") - F.col("j"))).where("w <> 0")
    got = near.join(cells.select(F.col("r").alias("i"), F.col("c").alias("j"), "v"), ["i", "j"], "left")
    total = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return got.groupBy("r", "c").agg(F.when(F.abs(total) > 1e-12, F.sum(F.col("w") * F.col("v")) / total).alias("v"))


def average(cells: DataFrame, of: Grid, to: Grid) -> DataFrame:
    """Mean of the source pixels whose centres lie in each target pixel."""
    x, y = of.x(F.col("r"), F.col("c"), 0.5), of.y(F.col("r"), F.col("c"), 0.5)
    r, c = to.pixel(x, y)
    means = cells.select(F.floor(r).cast("int").alias("r"), F.floor(c).cast("int").alias("c"), "v").groupBy("r", "c").agg(F.avg("v").alias("v"))
    return to.cells(cells.sparkSession).join(means, ["r", "c"], "left")


def align(cells: DataFrame, of: Grid, to: Grid, method: str = "bilinear") -> DataFrame:
    """Cells on another grid; nothing to do if both are the same. Unknown methods are bilinear."""
    if of.same_as(to):
        return cells
    if method == "nearest":
        return nearest(cells, of, to)
    if method == "average":
        return average(cells, of, to)
    return weighted(cells, of, to, method if method in ("cubic", "lanczos") else "bilinear")


def same_shape(one: Grid, other: Grid) -> None:
    if (one.width, one.height) != (other.width, other.height):
        raise ValueError(f"grids differ: {one.height} x {one.width} and {other.height} x {other.width} pixels")


def sample(points: DataFrame, dem: DataFrame, grid: Grid, name: str = "elev") -> DataFrame:
    """Points (x, y) with the value of their pixel; fractions are cut towards 0, outside is null."""
    r, c = grid.pixel(F.col("x"), F.col("y"))
    keyed = points.withColumns({"_r": r.cast("int"), "_c": c.cast("int")})
    values = dem.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("v").alias(name))
    return keyed.join(values, ["_r", "_c"], "left").drop("_r", "_c")


def to_db(v: Column) -> Column:
    return F.when(v.isNotNull(), 10 * F.log10(F.greatest(v, F.lit(1e-15))))


def from_db(v: Column) -> Column:
    return F.pow(F.lit(10.0), v / 10)


def classify(cells: DataFrame, surface: DataFrame) -> DataFrame:
    """1 where a value is under the threshold surface, else 0, 255 without data."""
    both = cells.join(surface.select("r", "c", F.col("v").alias("t")), ["r", "c"], "left")
    return both.select("r", "c", F.when(F.col("v").isNull(), 255).when(F.col("v") < F.col("t"), 1).otherwise(0).cast("int").alias("v"))


def depth(surface: DataFrame, dem: DataFrame) -> DataFrame:
    """Water over the ground, null where the surface is under it."""
    both = dem.select("r", "c", F.col("v").alias("z")).join(surface, ["r", "c"], "left")
    return both.select("r", "c", F.when(F.col("v") >= F.col("z"), F.col("v") - F.col("z")).alias("v"))
