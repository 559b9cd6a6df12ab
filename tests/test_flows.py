import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inundata.operators import interp, knn, segments, threshold
from inundata.operators.grid import Grid
from inundata.plans import flows
from inundata.storage import Scratch


def band(spark, n=48):
    rng = np.random.default_rng(8)
    v = rng.normal(0.5, 0.1, (n, n))
    v[:16, 16:32] = 0.95  # an accepted tile lies in it only after it is halved, or not at all
    v[:8, 16:24] = 0.4 + 0.1 * rng.random((8, 8))
    return spark.createDataFrame([(i, j, float(v[i, j])) for i in range(n) for j in range(n)], "r int, c int, v double")


def test_saved_tiles_are_those_of_the_quadtree(spark):
    df, grid = band(spark), Grid(48, 48)
    tiles, cells = threshold.tiles_and_cells(df, grid, tile_size=16)
    rows = lambda x: sorted(map(tuple, x.collect()))
    want = threshold.quadtree(df, grid, tile_size=16)
    assert tiles.columns == want.columns and rows(tiles) == rows(want) and {x.level for x in tiles.collect()} == {1, 2}
    assert rows(cells) == rows(threshold.cells_in_tiles(df, grid, tile_size=16))


def test_surface_fits_each_tile_once(spark, tmp_path, monkeypatch):
    plain, log = threshold.tile_threshold, str(tmp_path / "fits")

    def counted(x, mean, kind="SAR", start=None):
        with open(log, "a") as f:
            f.write(f"{len(x)}\n")
        return plain(x, mean, kind, start)

    monkeypatch.setattr(threshold, "tile_threshold", counted)
    df, grid = band(spark), Grid(48, 48)
    surface, mask = flows.threshold_surface(df, grid, tile_size=16, kind="optical", cutoff=0.1)
    assert mask.count() == 48 * 48 and surface.where("v is null").count() == 0
    assert sorted(open(log).read().split()) == sorted(["256"] * 8 + ["64"])


@pytest.mark.parametrize("limit", [1, 40, 20_000])
def test_shared_search_matches_brute_force(limit, monkeypatch):
    monkeypatch.setattr(knn, "SORTED", limit)
    rng = np.random.default_rng(9)
    for n, m, k in ((0, 5, 2), (1, 5, 3), (7, 0, 2), (90, 200, 4), (300, 500, 12)):
        for draw in (lambda s: rng.random(s) * 900 + 5e6, lambda s: rng.integers(0, 6, s).astype(float)):  # the latter with many ties
            xs, ys, px, py = draw(n), draw(n), draw(m), draw(m)
            if n > 50:
                xs[3], py[5] = np.nan, np.inf
            d = (px[:, None] - xs) ** 2 + (py[:, None] - ys) ** 2
            d[~np.isfinite(d)] = np.inf
            d[np.arange(m)[:, None] == np.arange(n)] = np.inf
            want = np.argsort(d, axis=1, kind="stable")[:, :k]
            got = {}
            for rows, at, d2 in knn.among(px, py, xs, ys, k, (np.arange(m), np.arange(n))):
                got |= {int(r): [(int(i), float(x)) for i, x in zip(a, b) if np.isfinite(x)] for r, a, b in zip(rows, at, d2)}
            for r in range(m):
                assert got.get(r, []) == [(int(i), float(d[r, i])) for i in want[r] if np.isfinite(d[r, i])]


def test_search_looks_at_few_points(monkeypatch):
    seen, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **y: seen.append(a.size) or plain(a, *x, **y))
    rng = np.random.default_rng(10)
    xs, ys, r = rng.random(20_000) * 64, rng.random(20_000) * 50_000, np.arange(6400)
    assert sum(d.size for _, _, d in knn.among(r % 64 + 0.5, r // 64 + 0.5, xs, ys, 12)) == 6400 * 12
    assert sum(seen) < 0.02 * 6400 * 20_000  # all of them before


def test_nearest_surface_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    grid, n = Grid(9, 40), 70
    x, y, z = rng.random(n) * 9, -rng.random(n) * 40, rng.random(n)
    x[4], y[4], x[2], y[2] = 3.5, -7.5, 3.5, -7.5  # on a centre, twice: the first id counts
    pts = spark.createDataFrame([(i, float(x[i]), float(y[i]), float(z[i])) for i in range(n)] + [(99, None, 1.0, 1.0), (100, 4.5, -4.5, None)], "id long, x double, y double, z double")
    for small in (interp.knn.SMALL, 10):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(knn, "SMALL", small)
            m.setattr(knn.nearest, "__defaults__", (False, small))
            got = interp.idw(grid.cells(spark), pts, grid, 3.0, 0.0, 5).toPandas().sort_values(["r", "c"])
        d2 = (got.c.to_numpy()[:, None] + 0.5 - x) ** 2 + (-got.r.to_numpy()[:, None] - 0.5 - y) ** 2
        near = np.argsort(d2, axis=1, kind="stable")[:, :5]
        d = np.take_along_axis(d2, near, axis=1)
        w = np.maximum(d, 1e-30) ** -1.5
        want = np.where(d[:, 0] <= 1e-20, z[2], (w * z[near]).sum(axis=1) / w.sum(axis=1))
        assert np.allclose(got.v.to_numpy(), want, rtol=1e-12)
    assert interp.idw(grid.cells(spark), pts.where("id > 98"), grid, 3.0, 0.0, 5).where("v is not null").count() == 0


def test_outlines_are_traced_once(spark, tmp_path, monkeypatch):
    plain, log = segments.outlines, str(tmp_path / "walks")

    def counted(pixels, holes=False):
        with open(log, "a") as f:
            f.write("x\n")
        return plain(pixels, holes)

    monkeypatch.setattr(segments, "outlines", counted)
    grid = Grid(30, 30)
    dem = grid.cells(spark).withColumn("v", F.col("r") * 0.1 + F.col("c") * 0.01)
    mask = grid.cells(spark).withColumn("v", F.when((F.col("r") % 10 < 7) & (F.col("c") % 10 < 7), 1).when(F.col("r") + F.col("c") == 57, 1).otherwise(0))
    got = flows.reconstruct(mask, dem, grid, 20, 8).toPandas()
    assert len(got) == 900 and len(open(log).read().split()) == 9  # nine squares; the single pixels are too small
    assert (got["class"] == 1).sum() == (mask.where("v = 1").count()) and (got[got["class"] == 1].depth >= 0).all()


def test_cells_are_never_broadcast(spark, monkeypatch):
    plain, plans = Scratch.save, []
    plan_of = lambda df: df._jdf.queryExecution().sparkPlan().toString()

    def noted(self, df, *a, **k):
        plans.append(plan_of(df))
        return plain(self, df, *a, **k)

    grid, scratch = Grid(64, 200), Scratch(spark)
    dem = scratch.keep(grid.cells(spark).withColumn("v", F.col("r") * 0.01 + F.col("c") % 7))  # small files, as millions of cells can have
    mask = scratch.keep(grid.cells(spark).withColumn("v", F.when(F.col("c") < 40, 1).otherwise(0)))
    monkeypatch.setattr(Scratch, "save", noted)
    got = flows.reconstruct(mask, dem, grid, 20, 8)
    joins = [x for p in [*plans, plan_of(got)] for x in p.splitlines() if "BroadcastHashJoin" in x]
    assert joins and not [x for x in joins if re.search(r"Join \[(r|row)#", x) or re.search(r"Join \[label#.*BuildLeft", x)]
    got = got.toPandas()
    assert len(got) == 64 * 200 and (got["class"] == 1).sum() == 40 * 200 and (got[got["class"] == 1].depth >= 0).all()


def test_parts_within_an_outline():
    def plain(point, ring):
        ends = zip(ring, ring[1:] + ring[:1])
        return sum((a[0] > point[0]) != (b[0] > point[0]) and min(a, b)[1] < point[1] for a, b in ends) % 2

    rng, within = np.random.default_rng(13), 0
    for _ in range(60):
        m = np.pad(np.kron(rng.random((6, 6)) < 0.8, np.ones((4, 4), bool)), 2)
        edge = m[1:-1, 1:-1] & ~(m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:])
        rings, crossed = [], {}
        for _, way in segments.outlines(np.argwhere(edge)):
            inside = any(plain(way[0], x) for x in rings)
            assert segments._inside(way[0], crossed) == inside
            within += inside
            if not inside:
                rings.append(way)
                segments._cross(np.array(way), crossed)
    assert within > 30
