"""Nearest neighbours and one-dimensional clusters, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inundata.storage import Scratch

#: Points that are sent whole to every task; more are searched by buckets.
SMALL = 50_000
#: Distances that are sorted at once rather than halving a group of points further.
SORTED = 20_000
#: Cells on a side of the grid whose extents bound the way to far points.
CELLS = 48


def nearest(left: DataFrame, right: DataFrame, k: int, own: bool = False, small: int = SMALL) -> DataFrame:
    """(id, nid, d2, rank): for each left point (id, x, y) its k nearest right points (nid, x, y), ties by nid.

    With ``own`` a left point is not its own neighbour (nid = id). Up to
    ``small`` right points, counted first, go to the tasks as arrays, where groups
    of left points share the search. More are
    put into square buckets of a few points, and left points look at the
    buckets around their own; those whose k-th neighbour may lie further off go
    on with buckets twice as wide. Every round shuffles only what is open. Left
    points that lie far from all right ones are left over: for each of them
    counts and extents of CELLS x CELLS cells tell which cells can hold a
    neighbour. No more than these counts goes to the driver then.
    """
    n = right.count()
    if n <= small:
        return _small(left, right, k, own)
    return _bucketed(left, right, k, own, n)


def _small(left: DataFrame, right: DataFrame, k: int, own: bool) -> DataFrame:
    rows = right.select(F.col("nid").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null").orderBy("nid").toPandas()
    ids, xs, ys = rows["nid"].to_numpy(), rows["x"].to_numpy(), rows["y"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            me, px, py = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "x", "y"))
            for rows, at, d in among(px, py, xs, ys, k, (me, ids) if own else None):
                ok = np.isfinite(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(me[rows], d.shape[1])[ok.ravel()]), pa.array(ids[at][ok]), pa.array(d[ok]), pa.array(np.tile(np.arange(1, d.shape[1] + 1, dtype=np.int32), len(rows))[ok.ravel()])], ["id", "nid", "d2", "rank"])

    points = left.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    return points.mapInArrow(run, "id long, nid long, d2 double, rank int")


def among(px: np.ndarray, py: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, at, d2) for groups of the points p: positions of the k nearest of x, y in their order, ties by position.

    With ``own``, the ids of both sides, equal ids are no neighbours: their d2
    is infinite. A group is halved until few candidates are left to sort: if
    the k-th nearest of its middle lies D away and its points at most R, no
    neighbour of these lies further than D + 2 R from the middle. Points that
    aren't finite neither have neighbours nor are any.
    """
    real = np.flatnonzero(np.isfinite(xs) & np.isfinite(ys))
    xs, ys, need = xs[real], ys[real], k + (own is not None)
    todo = [np.flatnonzero(np.isfinite(px) & np.isfinite(py))] if len(real) and k > 0 else []
    while todo:
        rows = todo.pop()
        if not len(rows):
            continue
        x, y, near = px[rows], py[rows], slice(None)
        wide, high, n = np.ptp(x), np.ptp(y), len(xs)
        if n > need:
            mx, my = x.min() + wide / 2, y.min() + high / 2
            d = (xs - mx) ** 2 + (ys - my) ** 2
            bound = (np.sqrt(np.partition(d, need - 1)[need - 1]) + 2 * np.hypot(x - mx, y - my).max()) * (1 + 1e-9)
            near = np.flatnonzero(d <= bound * bound)
            n = len(near)
            if len(rows) * n > max(2 * len(xs), SORTED) and max(wide, high) > 0:
                parts = np.argpartition(x if wide >= high else y, len(rows) // 2)
                todo += [rows[parts[: len(rows) // 2]], rows[parts[len(rows) // 2 :]]]
                continue
        step = max(1, 2_000_000 // n)
        for i in range(0, len(rows), step):
            d = (x[i : i + step, None] - xs[near]) ** 2 + (y[i : i + step, None] - ys[near]) ** 2
            if own:
                d[own[0][rows[i : i + step], None] == own[1][real[near]]] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            yield rows[i : i + step], real[near][order], np.take_along_axis(d, order, axis=1)


def _bucketed(left: DataFrame, right: DataFrame, k: int, own: bool, n: int) -> DataFrame:
    scratch = Scratch(left.sparkSession)
    x0, x1, y0, y1 = right.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max((((x1 - x0) or 1.0) * ((y1 - y0) or 1.0) * (k + 1) / n) ** 0.5, 1e-9)
    widest = max(x1 - x0, y1 - y0, 1e-9)
    todo, done = scratch.save(left.select("id", "x", "y").where("x is not null and y is not null"), "open", keep=True), []
    while True:
        last = side > widest
        bucket = lambda c, low: F.floor((F.col(c) - low) / side)  # noqa: E731, B023
        around = F.sequence(F.lit(-1), F.lit(1))
        wide = todo if last else todo.select("id", "x", "y", (bucket("x", x0)).alias("i"), (bucket("y", y0)).alias("j")).withColumn("i", F.explode(F.transform(around, lambda s: F.col("i") + s))).withColumn("j", F.explode(F.transform(around, lambda s: F.col("j") + s)))
        spots = right.select("nid", F.col("x").alias("nx"), F.col("y").alias("ny"), bucket("x", x0).alias("i"), bucket("y", y0).alias("j"))
        if last:
            done.append(scratch.save(_far(todo, right, k, own, (x0, x1, y0, y1)), "far", keep=True))
            break
        near = wide.join(spots, ["i", "j"]).where("nid <> id" if own else "true").withColumn("d2", F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "nid"))).where(F.col("rank") <= k).select("id", "nid", "d2", "rank")
        ranked = scratch.save(ranked, "ranked", keep=True)
        sure = ranked.groupBy("id").agg(F.max("d2").alias("far"), F.count("*").alias("n")).where((F.col("n") == k) & (F.col("far") <= side * side)).select("id")
        done.append(ranked.join(sure, "id", "left_semi"))
        todo = scratch.save(todo.join(sure, "id", "left_anti"), "open", keep=True)
        if not todo.take(1):
            break
        side *= 2
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("id", "nid", "d2", F.col("rank").cast("int").alias("rank"))


def _far(left: DataFrame, right: DataFrame, k: int, own: bool, box: tuple[float, float, float, float]) -> DataFrame:
    """The same for left points anywhere, by a grid of cells over the right ones.

    The cells nearest by their far corners that together have k points give a
    bound; a cell whose nearest corner lies beyond it has no neighbour.
    """
    x0, x1, y0, y1 = box
    cell = lambda c, low, high: F.least(F.lit(CELLS - 1), F.floor((F.col(c) - low) / ((high - low) or 1.0) * CELLS)).cast("int")
    spots = right.where("x is not null and y is not null").select("nid", F.col("x").alias("nx"), F.col("y").alias("ny"), cell("x", x0, x1).alias("i"), cell("y", y0, y1).alias("j"))
    rows = spots.groupBy("i", "j").agg(F.count("*"), F.min("nx"), F.max("nx"), F.min("ny"), F.max("ny")).collect()  # CELLS * CELLS rows at most
    i, j, n, ax, bx, ay, by = (np.array(c) for c in zip(*rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                x, y = (part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("x", "y"))
                least = np.maximum(0, np.maximum(ax - x, x - bx)) ** 2 + np.maximum(0, np.maximum(ay - y, y - by)) ** 2
                most = np.maximum(np.abs(x - ax), np.abs(x - bx)) ** 2 + np.maximum(np.abs(y - ay), np.abs(y - by)) ** 2
                order = np.argsort(most, axis=1)
                enough = np.cumsum(n[order], axis=1) >= k + own
                bound = np.where(enough.any(axis=1), np.take_along_axis(most, order, axis=1)[np.arange(len(part)), enough.argmax(axis=1)], np.inf)
                who, where = np.nonzero(least <= bound[:, None] * (1 + 1e-9))
                took = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*(took.column(c) for c in ("id", "x", "y")), pa.array(i[where].astype(np.int32)), pa.array(j[where].astype(np.int32))], ["id", "x", "y", "i", "j"])

    points = left.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = points.mapInArrow(run, "id long, x double, y double, i int, j int").join(spots, ["i", "j"]).where("nid <> id" if own else "true")
    near = near.withColumn("d2", F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "nid"))).where(F.col("rank") <= k).select("id", "nid", "d2", "rank")


def two_means(values: DataFrame, parts: int = 64) -> DataFrame:
    """One row (low, high, cut, n): the centres of the best split of column y in two, and the greatest y of the lower part.

    Exact: sorted values, running sums, and the split with the most variance
    between the parts, the first on ties. Sums run within ranges of the values
    and start from the sums of the ranges before (``parts`` rows). Equal values
    have no split: both centres and the cut are that value. Nulls don't count.
    """
    spark = values.sparkSession
    scratch = Scratch(spark)
    counts = values.where("y is not null").groupBy("y").agg(F.count("*").alias("k"))  # equal values can't be split
    ranged = scratch.save(counts.repartitionByRange(parts, "y").withColumn("part", F.spark_partition_id()), "ranged", keep=True)
    sums = sorted((r["part"], r["n"], r["s"]) for r in ranged.groupBy("part").agg(F.sum("k").alias("n"), F.sum(F.col("y") * F.col("k")).alias("s")).collect())
    starts, n, s = [], 0, 0.0
    for part, a, b in sums:
        starts.append((part, n, s))
        n, s = n + a, s + b
    if not n:
        return spark.createDataFrame([], "low double, high double, cut double, n long")
    run = Window.partitionBy("part").orderBy("y")
    split = ranged.join(F.broadcast(spark.createDataFrame(starts, "part int, n0 long, s0 double")), "part")
    split = split.select("y", (F.col("n0") + F.sum("k").over(run)).alias("a"), (F.col("s0") + F.sum(F.col("y") * F.col("k")).over(run)).alias("b")).where(F.col("a") < n)
    gain = F.col("b") * F.col("b") / F.col("a") + (F.lit(s) - F.col("b")) * (F.lit(s) - F.col("b")) / (F.lit(n) - F.col("a"))
    best = split.agg(F.max(F.struct(gain.alias("g"), (-F.col("a")).alias("na"), "y", "a", "b")).alias("m")).select("m.*")
    found = best.where("a is not null").select((F.col("b") / F.col("a")).alias("low"), ((F.lit(s) - F.col("b")) / (F.lit(n) - F.col("a"))).alias("high"), F.col("y").alias("cut"), F.lit(n).cast("long").alias("n"))
    same = best.where("a is null").select(F.lit(s / n).alias("low"), F.lit(s / n).alias("high"), F.lit(s / n).alias("cut"), F.lit(n).cast("long").alias("n"))
    return found.union(same)
