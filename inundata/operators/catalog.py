"""Scene catalogs: search, selection, names, and the plan of a download."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inundata.functions.geo import Box, area_of_interest, utm_code
from inundata.storage import Scratch

#: Terrain models that can be asked for by name.
DEM_SETS = {
    "SRTM 30m": ("USGS/SRTMGL1_003", "image", "elevation", 30),
    "NASADEM 30m": ("NASA/NASADEM_HGT/001", "image", "elevation", 30),
    "ALOS AW3D30 30m": ("JAXA/ALOS/AW3D30/V3_2", "collection", "DSM", 30),
    "Copernicus GLO-30": ("COPERNICUS/DEM/GLO30", "collection", "DEM", 30),
    "USGS 3DEP 10m": ("USGS/3DEP/10m", "image", "elevation", 10),
    "USGS 3DEP 1m": ("USGS/3DEP/1m", "collection", "elevation", 1),
}
#: Columns that every search result has, in their order.
SCENE = ("sensor", "image_id", "date", "ts")


@dataclass(frozen=True)
class DownloadPlan:
    """What a download is cut into."""

    target_scale: float = 10
    tile_size: int = 1000
    block_threshold: int = 10_000
    threads: int = 10
    snap: int = 60


def _when(df: DataFrame, start: str | date, end: str | date) -> DataFrame:
    ms = lambda d: int(datetime.fromisoformat(str(d)).replace(tzinfo=timezone.utc).timestamp() * 1000)
    return df.where((F.col("ts") >= ms(start)) & (F.col("ts") < ms(end)))


def _where(df: DataFrame, box: Box) -> DataFrame:
    return df.where((F.col("xmin") <= box.xmax) & (F.col("xmax") >= box.xmin) & (F.col("ymin") <= box.ymax) & (F.col("ymax") >= box.ymin))


def _finish(df: DataFrame) -> DataFrame:
    return df.orderBy("ts", "image_id")


def search_radar(scenes: DataFrame, box: Box, start: str | date, end: str | date) -> DataFrame:
    """Radar scenes (sensor S1) in wide-swath mode with both polarisations that touch the box; the end day is out."""
    s1 = scenes.where((F.col("sensor") == "S1") & (F.col("mode") == "IW") & F.array_contains("pol", "VV") & F.array_contains("pol", "VH"))
    return _finish(_where(_when(s1, start, end), box))


def search_sentinel2(scenes: DataFrame, box: Box, start: str | date, end: str | date, max_cloud: float = 30) -> DataFrame:
    return _finish(_where(_when(scenes.where((F.col("sensor") == "S2") & (F.col("cloud") <= max_cloud)), start, end), box))


def search_landsat(scenes: DataFrame, box: Box, start: str | date, end: str | date, max_cloud: float = 30) -> DataFrame:
    parts = [_where(_when(scenes.where((F.col("sensor") == s) & (F.col("cloud") <= max_cloud)), start, end), box) for s in ("L8", "L9")]
    return _finish(parts[0].unionByName(parts[1]))


def search(scenes: DataFrame, where: object, start: str | date, end: str | date, max_cloud: float = 30) -> tuple[dict[str, DataFrame], Box]:
    """All three searches by name, and the box."""
    box = area_of_interest(where)
    return {"s1": search_radar(scenes, box, start, end), "s2": search_sentinel2(scenes, box, start, end, max_cloud), "landsat": search_landsat(scenes, box, start, end, max_cloud)}, box


def day(ts: Column) -> Column:
    """Date text of epoch milliseconds in UTC, whatever the session's time zone; null is the first day of 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.coalesce(ts, F.lit(0)) / 86_400_000).cast("int")).cast("string")


def as_table(results: dict[str, DataFrame], parts: int = 64) -> DataFrame:
    """One table of all results by time, missing columns null, numbered from 0 as idx, with a date and without ts.

    Sorted and numbered in ranges, ``parts`` of them.
    """
    every = None
    for df in results.values():
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    dated = every.withColumn("date", day(F.col("ts"))).withColumn("ts", F.coalesce("ts", F.lit(0)))
    spark = dated.sparkSession
    ranged = Scratch(spark).keep(dated.repartitionByRange(parts, "ts", "image_id").withColumn("_part", F.spark_partition_id()), "results")
    starts, before = [], 0
    for r in sorted(ranged.groupBy("_part").count().collect()):  # a row for each range
        starts.append((r["_part"], before))
        before += r["count"]
    first = spark.createDataFrame(starts or [(0, 0)], "_part int, _before long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("ts", "image_id"))
    numbered = ranged.withColumn("_nth", nth).join(F.broadcast(first), "_part")
    return numbered.withColumn("idx", (F.col("_before") + F.col("_nth") - 1).cast("int")).drop("ts", "_part", "_nth", "_before")


def pick(scenes: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """The records with one of the ids."""
    if isinstance(ids, list):
        return scenes.where(F.col("image_id").isin(ids))
    return scenes.join(ids.select("image_id").distinct(), "image_id", "left_semi")


def occurrence(collection: DataFrame) -> DataFrame:
    """The band of past water occurrence of a water-history table."""
    return collection.select("r", "c", F.col("occurrence").alias("v"))


def terrain(name: str, tables: dict[str, DataFrame], box: Box | None = None) -> DataFrame:
    """Cells of a named terrain model: an image's band, or the mosaic of a collection's tiles that touch the box."""
    from inundata.operators.grid import mosaic

    ident, kind, column, _ = DEM_SETS[name]
    df = tables[ident]
    if kind == "image":
        return df.select("r", "c", F.col(column).alias("v"))
    near = df if box is None else _where(df, box)
    return mosaic([near.groupBy("r", "c").agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col("tile"))).alias("v"))])


def tail(image_id: Column) -> Column:
    return F.element_at(F.split(image_id, "/"), -1)


def labels(scenes: DataFrame) -> DataFrame:
    """Adds label, what a person picks a scene by. Reads orbit, rel_orbit, tile, cloud, spacecraft, path and row."""
    known = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    line = lambda *parts: F.concat_ws("  |  ", F.col("date"), *parts)
    cloud = F.coalesce(F.format_string("cloud %.1f%%", F.col("cloud").cast("double")), F.lit("cloud N/A"))
    cloud = F.when(F.col("cloud").isNull(), "cloud N/A").otherwise(cloud)
    radar = line(F.substring(known("orbit", "N/A"), 1, 3), F.concat(F.lit("rel-orbit "), known("rel_orbit", "–")), tail(F.col("image_id")))
    optical = line(cloud, F.concat(F.lit("tile "), known("tile", "N/A")))
    landsat = line(F.regexp_replace(known("spacecraft", "?"), "LANDSAT_", "L"), cloud, F.concat(F.lit("path/row "), known("path", "–"), F.lit("/"), known("row", "–")))
    return scenes.withColumn("label", F.when(F.col("sensor") == "S1", radar).when(F.col("sensor") == "S2", optical).otherwise(landsat))


def output_name(sensor: Column, day_: Column, image_id: Column) -> Column:
    """sensor_yyyymmdd_ and the start of the last part of the id."""
    return F.concat_ws("_", sensor, F.regexp_replace(day_, "-", ""), F.substring(tail(image_id), 1, 18))


def scaled(sensor: Column, v: Column) -> Column:
    """Reflectance in 0 to 1 of stored optical values; radar as it is. Unknown sensors are an error."""
    clamp = lambda x: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.when(sensor == "S1", v.cast("double")).when(sensor == "S2", clamp(v * 1e-4)).when(sensor.isin("L8", "L9"), clamp(v * 2.75e-5 - 0.2)).otherwise(F.raise_error(F.concat(F.lit("unknown sensor "), sensor)).cast("double"))


def with_scale(records: DataFrame, scales: dict[str, float] | None = None, default: float = 10) -> DataFrame:
    """Records with the pixel size of their sensor, or the default."""
    known = records.sparkSession.createDataFrame(list((scales or {"": default}).items()), "sensor string, scale double")
    return records.join(F.broadcast(known), "sensor", "left").withColumn("scale", F.coalesce("scale", F.lit(float(default))))


def tile_plan(extents: DataFrame, plan: DownloadPlan = DownloadPlan(), digits: int | None = None) -> DataFrame:
    """(id, block, tile, x0, y0, x1, y1, width, height): the requests for extents (id, xmin, ymin, xmax, ymax) in metres.

    Bounds are snapped down to ``snap`` metres, extents over ``block_threshold``
    pixels are split in equal blocks, and these in tiles of ``tile_size`` pixels.
    Bounds are rounded to ``digits``, if given. Few extents make many tiles, and
    large ones most of them: extents, then blocks are dealt out to all tasks.
    Bounds are worked out once for the rows and columns of a block.
    """
    spark = extents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    extents = extents.repartition(parts, "id")
    down = {k: F.col(k) - F.pmod(F.col(k), F.lit(plan.snap)) for k in ("xmin", "ymin", "xmax", "ymax")}
    ext = extents.withColumns(down).withColumns({"w": F.ceil((F.col("xmax") - F.col("xmin")) / plan.target_scale).cast("int"), "h": F.ceil((F.col("ymax") - F.col("ymin")) / plan.target_scale).cast("int")})
    large = F.greatest("w", "h") > plan.block_threshold
    ext = ext.withColumns({"nx": F.when(large, F.ceil(F.col("w") / plan.block_threshold)).otherwise(1), "ny": F.when(large, F.ceil(F.col("h") / plan.block_threshold)).otherwise(1)})
    blocks = ext.withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("ny").cast("int") - 1))).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("nx").cast("int") - 1)))
    sx, sy = (F.col("xmax") - F.col("xmin")) / F.col("nx"), (F.col("ymax") - F.col("ymin")) / F.col("ny")
    blocks = blocks.withColumns({"x0": F.col("xmin") + F.col("bi") * sx, "y0": F.col("ymin") + F.col("bj") * sy, "sx": sx, "sy": sy})
    blocks = blocks.withColumns({"bw": F.ceil(F.col("sx") / plan.target_scale).cast("int"), "bh": F.ceil(F.col("sy") / plan.target_scale).cast("int"), "block": (F.col("bj") * F.col("nx") + F.col("bi")).cast("int")})
    last = lambda n: F.greatest(F.ceil(F.col(n) / plan.tile_size).cast("int"), F.lit(1)) - 1
    step, cut = plan.tile_size * plan.target_scale, lambda v: v if digits is None else F.round(v, digits) + F.lit(0.0)
    left, top = lambda i: F.col("x0") + i * step, lambda j: F.col("y0") + F.col("sy") - j * step
    pixels = lambda n, i: F.least(F.lit(plan.tile_size), F.col(n) - i * plan.tile_size)
    across = F.transform(F.sequence(F.lit(0), last("bw")), lambda i: F.struct(i.alias("i"), cut(left(i)).alias("x0"), cut(F.least(left(i) + step, F.col("x0") + F.col("sx"))).alias("x1"), pixels("bw", i).alias("width")))
    along = F.transform(F.sequence(F.lit(0), last("bh")), lambda j: F.struct((j * (last("bw") + 1)).alias("n"), cut(F.greatest(top(j) - step, F.col("y0"))).alias("y0"), cut(top(j)).alias("y1"), pixels("bh", j).alias("height")))
    tiles = blocks.repartition(parts, "id", "block").select("id", "block", across.alias("across"), along.alias("along"))
    tiles = tiles.select("id", "block", "across", F.explode("along").alias("t")).select("id", "block", "t", F.explode("across").alias("s"))
    return tiles.select("id", "block", (F.col("t.n") + F.col("s.i")).cast("int").alias("tile"), "s.x0", "t.y0", "s.x1", "t.y1", "s.width", "t.height")


def split_blocks(extents: DataFrame, block: int) -> DataFrame:
    """(id, part, x1, y1, x2, y2): extents (id, x1, y1, x2, y2, w, h) in equal boxes of ``block`` pixels at most."""
    n = extents.withColumns({"nx": F.ceil(F.col("w") / block).cast("int"), "ny": F.ceil(F.col("h") / block).cast("int")})
    cells = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    dx, dy = (F.col("x2") - F.col("x1")) / F.col("nx"), (F.col("y2") - F.col("y1")) / F.col("ny")
    return cells.select("id", (F.col("i") * F.col("ny") + F.col("j")).alias("part"), (F.col("x1") + F.col("i") * dx).alias("x1"), (F.col("y1") + F.col("j") * dy).alias("y1"), (F.col("x1") + (F.col("i") + 1) * dx).alias("x2"), (F.col("y1") + (F.col("j") + 1) * dy).alias("y2"))


def download_extent(box: Box, id_: str) -> tuple[str, str]:
    """Name of an area's mosaic and the UTM zone at the area's centre."""
    return f"Case{id_}", utm_code((box.ymin + box.ymax) / 2, (box.xmin + box.xmax) / 2)
