"""The driver's tables seen as rasters, objects, segments and scenes, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.operators.grid import Grid

WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Rasters:
    """Bands of the grid that the table ``embeddings`` stands for: a vector is a row, its numbers are columns."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        src = table(spark, sf_dir, "embeddings")
        self.spark, self.sf_dir = spark, sf_dir
        self.grid = Grid(WIDTH, src.agg(F.max("vec_id")).first()[0] + 1)
        self.cell = src.select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "v"), "label").select("r", "c", F.col("v").cast("double").alias("v"), "label")

    def made(self, v: str) -> DataFrame:
        return self.cell.select("r", "c", F.expr(v).alias("v"))

    @property
    def db(self) -> DataFrame:
        return self.made(f"case when (r * {WIDTH} + c) % 97 = 0 then null else -15e0 + 20e0 * v end")

    @property
    def nir(self) -> DataFrame:
        return self.made("0.5e0 + v")

    @property
    def w01(self) -> DataFrame:
        return self.made("case (r div 24 + c div 24) % 3 when 0 then 0.05e0 + 0.01e0 * v when 1 then 0.95e0 + 0.01e0 * v else 0.5e0 + v end")

    @property
    def dem(self) -> DataFrame:
        return self.made("100e0 + 0.02e0 * r + 0.05e0 * abs(c - 32) + v")

    @property
    def occurrence(self) -> DataFrame:
        return self.made("case when label = 3 then 50e0 else 0e0 end")

    @property
    def mask(self) -> DataFrame:
        return self.db.select("r", "c", F.when(F.col("v") < -16, 1).otherwise(0).alias("v"))

    @property
    def objects(self) -> DataFrame:
        """Labelled cells: what is dark, in blocks of 20 rows and 8 columns."""
        return self.mask.where("v = 1").select("r", "c", F.expr("(r div 20) * 8 + c div 8 + 1").cast("long").alias("object_id"))

    @property
    def points(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("(s_suppkey % 10) * 6.4e0").alias("x"), F.expr("-((s_suppkey div 10) * 50e0)").alias("y"), F.expr("100e0 + s_acctbal / 2000").alias("z"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    sizes = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("n"))
    c = table(spark, sf_dir, "customer").join(sizes, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    return c.select(
        k.alias("ID"), F.coalesce("n", F.lit(0)).alias("area_px"), (F.coalesce("n", F.lit(0)) * F.lit(1e-4)).alias("area_km2"), ((k % 40) * F.lit(10.0)).alias("cent_col"), (F.floor(k / 40) * F.lit(10.0)).alias("cent_row"),
        (F.col("c_acctbal") / 1000).alias("LWSE"), (k % 3 == 0).cast("int").alias("has_pit"), ((k % 7) * F.lit(10.0)).alias("depth_vol"), ((k % 11) * F.lit(10.0)).alias("depre_vol"), (k % 4).alias("label"),
    )


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("segment_id"), ((k % 10) * F.lit(40.0)).alias("col"), (F.floor(k / 10) * F.lit(40.0)).alias("row"), (F.col("s_acctbal") / 1000).alias("LWSE"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    sensor = F.expr("case event_type when 'view' then 'S1' when 'click' then 'S2' when 'purchase' then 'L8' when 'error' then 'L9' end")
    u = F.col("user_id")
    made = e.select(F.concat(F.lit("SET/"), sensor, F.lit("/"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("image_id"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ts"), F.least("value", F.lit(100.0)).alias("cloud"), sensor.alias("sensor"), ((u % 36) * F.lit(10.0) - 180).alias("xmin"), ((u % 16) * F.lit(10.0) - 80).alias("ymin"), (u % 3).alias("_m"), "event_id")
    s1 = F.col("sensor") == "S1"
    return made.select("*", (F.col("xmin") + 5).alias("xmax"), (F.col("ymin") + 5).alias("ymax"), F.when(s1, F.when(F.col("_m") == 0, "EW").otherwise("IW")).alias("mode"), F.when(s1, F.when(F.col("event_id") % 2 == 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("VV")))).alias("pol")).drop("_m", "event_id")


#: The same in DuckDB. A query names the parts that it needs; each may use those before it.
SQL = {
    "cell": "SELECT vec_id::INT AS r, (i - 1)::INT AS c, embedding[i]::DOUBLE AS v, label FROM embeddings, range(1, 65) t(i)",
    "size": "SELECT max(vec_id)::INT + 1 AS h, 64 AS w FROM embeddings",
    "db": "SELECT r, c, CASE WHEN (r * 64 + c) % 97 = 0 THEN NULL ELSE -15e0 + 20e0 * v END AS v FROM cell",
    "nir": "SELECT r, c, 0.5e0 + v AS v FROM cell",
    "w01": "SELECT r, c, CASE (r // 24 + c // 24) % 3 WHEN 0 THEN 0.05e0 + 0.01e0 * v WHEN 1 THEN 0.95e0 + 0.01e0 * v ELSE 0.5e0 + v END AS v FROM cell",
    "dem": "SELECT r, c, 100e0 + 0.02e0 * r + 0.05e0 * abs(c - 32) + v AS v FROM cell",
    "occ": "SELECT r, c, CASE WHEN label = 3 THEN 50e0 ELSE 0e0 END AS v FROM cell",
    "mask": "SELECT r, c, CASE WHEN v < -16 THEN 1 ELSE 0 END AS v FROM db",
    "obj": "SELECT r, c, ((r // 20) * 8 + c // 8 + 1)::BIGINT AS object_id FROM mask WHERE v = 1",
    "pts": "SELECT s_suppkey AS id, (s_suppkey % 10) * 6.4e0 AS x, -((s_suppkey // 10) * 50e0) AS y, 100e0 + s_acctbal / 2000 AS z FROM supplier",
    "objects": """
        SELECT c_custkey AS "ID", count(l_orderkey) AS area_px, count(l_orderkey) * 1e-4 AS area_km2, (c_custkey % 40) * 10e0 AS cent_col, (c_custkey // 40) * 10e0 AS cent_row,
               c_acctbal / 1000 AS "LWSE", CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS has_pit, (c_custkey % 7) * 10e0 AS depth_vol, (c_custkey % 11) * 10e0 AS depre_vol, c_custkey % 4 AS label
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey, c_acctbal
    """,
    "ref": 'SELECT s_suppkey AS segment_id, (s_suppkey % 10) * 40e0 AS col, (s_suppkey // 10) * 40e0 AS "row", s_acctbal / 1000 AS "LWSE" FROM supplier',
    "scenes": """
        SELECT 'SET/' || sensor || '/' || lpad(event_id::VARCHAR, 12, '0') AS image_id, epoch_ns(ts) // 1000000 AS ts, least(value, 100e0) AS cloud, sensor, (user_id % 36) * 10e0 - 180 AS xmin, (user_id % 16) * 10e0 - 80 AS ymin,
               (user_id % 36) * 10e0 - 175 AS xmax, (user_id % 16) * 10e0 - 75 AS ymax, CASE WHEN sensor = 'S1' THEN CASE WHEN user_id % 3 = 0 THEN 'EW' ELSE 'IW' END END AS mode, event_id % 2 = 0 AS both_pol
        FROM (SELECT *, CASE event_type WHEN 'view' THEN 'S1' WHEN 'click' THEN 'S2' WHEN 'purchase' THEN 'L8' WHEN 'error' THEN 'L9' END AS sensor FROM events WHERE event_type <> 'signup')
    """,
}


def sql(parts: str, body: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """A statement over the named parts, then those of ``more``, then the body."""
    kind = lambda name: "AS" if "(" in name else "AS MATERIALIZED"
    ctes = [f"{p} AS MATERIALIZED ({SQL[p].strip()})" for p in parts.split()]
    ctes += [f"{name} {kind(name)} ({text.strip()})" for name, text in (more or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body.strip()
