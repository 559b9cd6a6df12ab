"""Rules that judge flood objects one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inundata.operators import knn, objects as obj
from inundata.storage import Scratch

#: Pairs of columns that can hold a centroid, the first present counts.
CENTROIDS = (("cent_col", "cent_row"), ("cent_x", "cent_y"), ("x", "y"))


#: Columns of reference segments that can hold a place, the first pair present counts.
PLACES = (("col", "row"), ("x", "y"))


def centroid(df: DataFrame) -> tuple[str, str]:
    for pair in CENTROIDS:
        if all(c in df.columns for c in pair):
            return pair
    raise ValueError("the objects have no centroid columns")


class ObjectRules:
    """Objects with a code for how reliable they are; every rule returns a new one.

    ``skipped`` says which rules lacked columns. Rule 0 overwrites codes, the
    others judge only objects that have none.
    """

    def __init__(self, objects: DataFrame, skipped: tuple[str, ...] = ()) -> None:
        self.df, self.skipped = objects, skipped

    @classmethod
    def start(cls, objects: DataFrame) -> ObjectRules:
        """All codes unset; a column predict that is there is dropped."""
        return cls(objects.drop("predict").withColumn("predict", F.lit(None).cast("int")))

    def _next(self, df: DataFrame, skipped: str | None = None) -> ObjectRules:
        return ObjectRules(df, self.skipped + ((skipped,) if skipped else ()))

    def _code(self, condition: Column, code: int, df: DataFrame | None = None) -> DataFrame:
        open_ = F.col("predict").isNull() & condition
        return (df if df is not None else self.df).withColumn("predict", F.when(open_, code).otherwise(F.col("predict")))

    def small(self, threshold_px: int = 50) -> ObjectRules:
        """Rule 0: code 0 for objects under a size."""
        return self._next(self.df.withColumn("predict", F.when(F.col("area_px") < threshold_px, 0).otherwise(F.col("predict"))))

    def large(self, clusters: int = 2) -> ObjectRules:
        """Rule 1: code 1 for the upper cluster of log areas among open objects; nothing with fewer objects than clusters."""
        y = F.log1p(F.col("area_km2"))
        open_ = self.df.where("predict is null and area_km2 is not null").select(y.alias("y"))
        if clusters == 2:
            cut = knn.two_means(open_).select(F.when(F.col("n") >= 2, F.col("cut")).alias("cut"), (F.col("low") == F.col("high")).alias("same"))
            joined = self.df.crossJoin(F.broadcast(_one_row(cut)))  # one row
            return self._next(self._code(F.col("cut").isNotNull() & ((y > F.col("cut")) | F.col("same")), 1, joined).drop("cut", "same"))
        if open_.count() < clusters:
            return self
        low = _cluster_floor(open_, clusters)
        return self._next(self._code(y >= low, 1))

    def depressions(self) -> ObjectRules:
        """Rule 2: code 2 for objects with a pit whose water would not fill their depression."""
        need = ("has_pit", "depth_vol", "depre_vol")
        if missing := [c for c in need if c not in self.df.columns]:
            return self._next(self.df, f"depressions: no {', '.join(missing)}")
        return self._next(self._code((F.col("has_pit") == 1) & (F.col("depth_vol") < F.col("depre_vol")), 2))

    def levels(self, reference: DataFrame, high: float | None = None, low: float | None = None, k: int = 5, least: float = 5.0) -> ObjectRules:
        """Rule 3: codes 4 and 5 for open objects over or under the level of their nearest reference segments.

        ``reference`` has segment_id, LWSE, delta_LWSE and col, row (or x, y).
        Bounds are the mean of delta_LWSE and two sample deviations, the upper
        one ``least`` or more. With one segment there is no deviation and no
        object is flagged. Adds LWSE_local and delta_LWSE. Skipped if objects or
        segments lack a column.
        """
        if "LWSE" not in self.df.columns:
            return self._next(self.df, "levels: no LWSE")
        place = next((x for x in PLACES if set(x) <= set(reference.columns)), None)
        if place is None or not {"LWSE", "delta_LWSE"} <= set(reference.columns):
            return self._next(self.df, "levels: the reference lacks columns")
        if not any(set(x) <= set(self.df.columns) for x in CENTROIDS):
            return self._next(self.df, "levels: no centroid")
        ref = reference.where("LWSE is not null")
        (cx, cy), (ox, oy) = place, centroid(self.df)
        open_ = self.df.where("predict is null").select(F.col("ID").alias("id"), F.col(ox).alias("x"), F.col(oy).alias("y"))
        spots = ref.select(F.col("segment_id").alias("nid"), F.col(cx).alias("x"), F.col(cy).alias("y"), "LWSE")
        near = knn.nearest(open_, spots.drop("LWSE"), k).join(spots.select("nid", F.col("LWSE").alias("l")), "nid")
        local = near.groupBy("id").agg(F.avg("l").alias("LWSE_local")).withColumnRenamed("id", "ID")
        dev = F.stddev_samp("delta_LWSE")
        bounds = ref.agg(
            (F.lit(float(high)) if high is not None else F.when(dev.isNotNull(), F.greatest(F.avg("delta_LWSE") + 2 * dev, F.lit(least)))).alias("_hi"),
            (F.lit(float(low)) if low is not None else F.avg("delta_LWSE") - 2 * dev).alias("_lo"),
        )
        df = self.df.drop("LWSE_local", "delta_LWSE").join(local, "ID", "left").withColumn("delta_LWSE", F.col("LWSE") - F.col("LWSE_local"))
        df = df.crossJoin(F.broadcast(bounds))  # one row
        open_now = F.col("predict").isNull()
        code = F.when(open_now & (F.col("delta_LWSE") < F.col("_lo")), 5).when(open_now & (F.col("delta_LWSE") > F.col("_hi")), 4).otherwise(F.col("predict"))
        return self._next(df.withColumn("predict", code).drop("_hi", "_lo"))

    def distances(self, threshold: float | str = "auto", reference: DataFrame | None = None) -> ObjectRules:
        """Rule 4: code 6 for open objects further from flood than a threshold, 7 for the others.

        Distances, if there is no column ``distance``, run to the reference
        segments or else to the objects of code 1. The automatic threshold lies
        between the clusters of finite log distances; with fewer than two open
        objects all are near. An infinite distance (there is no flood) is beyond
        every threshold.
        """
        df = self.df if "distance" in self.df.columns else distance_to_flood(self.df, reference)
        if threshold == "auto":
            df = Scratch(df.sparkSession).keep(df, "distances")
        y = F.log1p(F.col("distance"))
        open_ = F.col("predict").isNull() & F.col("distance").isNotNull()
        if threshold != "auto":
            t = F.lit(float(threshold))
            return self._next(df.withColumn("predict", F.when(open_ & (F.col("distance") > t), 6).when(open_, 7).otherwise(F.col("predict"))))
        infinite = F.col("distance") == float("inf")
        cut = knn.two_means(df.where(open_ & ~infinite).select(y.alias("y")))
        cut = _one_row(cut.select(F.expr("expm1((low + high) / 2)").alias("t")))
        cut = cut.crossJoin(df.where(open_).agg(F.count("*").alias("_n")))  # one row each
        judged = df.crossJoin(F.broadcast(cut))  # one row
        few = F.col("_n") < 2
        code = F.when(F.col("predict").isNull() & few, 7).when(open_ & (infinite | (F.col("distance") > F.col("t"))), 6).when(open_, 7).otherwise(F.col("predict"))
        return self._next(judged.withColumn("predict", code).drop("t", "_n"))

    def run(self, reference: DataFrame, threshold_px: int = 50, k: int = 5) -> ObjectRules:
        """All rules in their order, with distances to the objects of code 1. Objects are saved where a rule reads them more than once."""
        scratch = Scratch(self.df.sparkSession)
        saved = lambda rules: ObjectRules(scratch.keep(rules.df, "objects"), rules.skipped)
        judged = saved(saved(self).small(threshold_px).large().depressions())
        return saved(judged.levels(reference, k=k)).distances()

    def results(self) -> DataFrame:
        return self.df

    def summary(self) -> DataFrame:
        return obj.summary(self.df)

    def validate(self, label: str = "label") -> DataFrame | None:
        return obj.validate(self.df, label)


def _one_row(df: DataFrame) -> DataFrame:
    """An aggregate of a table of at most one row: always one row, of nulls if there is none."""
    return df.agg(*(F.first(c).alias(c) for c in df.columns))


def distance_to_flood(objects: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Adds distance: from each centroid to the nearest reference segment or, without one, to the nearest object of code 1.

    Without those too, and for objects without centroid columns, it is infinite.
    """
    if not any(set(x) <= set(objects.columns) for x in CENTROIDS):
        return objects.withColumn("distance", F.lit(float("inf")))
    ox, oy = centroid(objects)
    me = objects.select(F.col("ID").alias("id"), F.col(ox).alias("x"), F.col(oy).alias("y"))
    place = next((x for x in PLACES if reference is not None and set(x) <= set(reference.columns)), None)
    if place is not None and reference.take(1):
        spots = reference.select(F.col("segment_id").alias("nid"), F.col(place[0]).alias("x"), F.col(place[1]).alias("y"))
    else:
        flood = objects.where("predict = 1") if "predict" in objects.columns else objects.where("false")
        spots = flood.select(F.col("ID").alias("nid"), F.col(ox).alias("x"), F.col(oy).alias("y"))
    near = knn.nearest(me, spots, 1).select(F.col("id").alias("ID"), F.sqrt("d2").alias("distance"))
    lone = F.when(F.col(ox).isNotNull() & F.col(oy).isNotNull(), float("inf"))  # an object with a place has a nearest spot unless there is none
    return objects.drop("distance").join(near, "ID", "left").withColumn("distance", F.coalesce("distance", lone))


def _cluster_floor(values: DataFrame, clusters: int) -> float:
    """Least value of the topmost of several clusters, by Spark's k-means on one feature."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["y"], outputCol="features").transform(values)
    centres = sorted(float(c[0]) for c in KMeans(k=clusters, seed=0, maxIter=100).fit(data).clusterCenters())
    return (centres[-1] + centres[-2]) / 2 if len(centres) > 1 else centres[-1]
