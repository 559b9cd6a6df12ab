import numpy as np
import pytest
from pyspark.sql import functions as F

from inundata.operators import components, focal, grid as g, terrain
from inundata.operators.grid import Grid
from inundata.sources import geotiff


def cells(spark, a):
    a = np.asarray(a, float)
    rows = [(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "r int, c int, v double"), Grid(a.shape[1], a.shape[0])


def array(df, grid, name="v"):
    out = np.full((grid.height, grid.width), np.nan)
    for x in df.select("r", "c", name).collect():
        out[x[0], x[1]] = np.nan if x[2] is None else x[2]
    return out


def padded_stats(a, h):
    valid = ~np.isnan(a)
    x, w = np.pad(np.where(valid, a, 0), h, "symmetric"), np.pad(valid.astype(float), h, "symmetric")
    win = lambda z: np.lib.stride_tricks.sliding_window_view(z, (2 * h + 1, 2 * h + 1)).sum(axis=(2, 3))
    n, s, q = win(w), win(x), win(x * x)
    mean = s / n
    return mean, np.maximum(q / n - mean**2, 0)


def test_box_stats_match_numpy(spark):
    a = np.random.default_rng(1).normal(size=(9, 12))
    a[3, 4] = np.nan
    df, grid = cells(spark, a)
    got = focal.box_stats(df, grid, 5)
    mean, var = padded_stats(a, 2)
    assert np.allclose(array(got, grid, "mean"), mean) and np.allclose(array(got, grid, "var"), var)


def test_lee_keeps_a_constant_and_missing_cells(spark):
    a = np.full((3, 3), 5.0)
    a[1, 2] = np.nan
    df, grid = cells(spark, a)
    got = array(focal.lee(df, grid, 3), grid)
    assert np.isnan(got[1, 2]) and np.allclose(got[~np.isnan(a)], 5)


def test_filter_rejects_bad_parameters(spark):
    df, grid = cells(spark, np.ones((8, 8)))
    for bad in ({"size": 4}, {"enl": 0}):
        with pytest.raises(ValueError):
            focal.speckle_filter(df, grid, **bad)


def test_erosion_and_dilation(spark):
    one = np.zeros((5, 5))
    one[2, 2] = 1
    df, grid = cells(spark, one)
    assert array(focal.erode(df, grid), grid).sum() == 0
    assert array(focal.dilate(df, grid), grid).sum() == 9
    full, _ = cells(spark, np.ones((5, 5)))
    assert array(focal.erode(full, grid), grid).sum() == 9
    square = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert (array(focal.erode(full, grid, square), grid) == array(focal.erode(full, grid), grid)).all()
    with pytest.raises(ValueError):
        focal.smooth_mask(df, grid, "ex")


def flood(mask, diagonal):
    h, w = mask.shape
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    out = np.full(mask.shape, -1)
    for r in range(h):
        for c in range(w):
            if mask[r, c] and out[r, c] < 0:
                stack = [(r, c)]
                out[r, c] = r * w + c
                while stack:
                    y, x = stack.pop()
                    for i, j in near:
                        if 0 <= y + i < h and 0 <= x + j < w and mask[y + i, x + j] and out[y + i, x + j] < 0:
                            out[y + i, x + j] = r * w + c
                            stack.append((y + i, x + j))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("tile", [4, 512])
def test_labels_match_flood_fill(spark, diagonal, tile):
    a = (np.random.default_rng(2).random((14, 11)) < 0.5).astype(float)
    df, grid = cells(spark, a)
    got = array(components.label(df.where("v = 1"), grid, diagonal, tile=tile), grid, "label")
    want = flood(a == 1, diagonal)
    assert (np.where(np.isnan(got), -1, got) == want).all()


def test_diagonal_neighbours_are_one_object_or_two(spark):
    df, grid = cells(spark, np.eye(2))
    count = lambda d: components.label(df.where("v = 1"), grid, d).select("label").distinct().count()
    assert (count(True), count(False)) == (1, 2)


def test_numbers_are_dense_and_ordered(spark):
    a = np.array([[0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 0, 1]])
    df, grid = cells(spark, a)
    got = components.numbered(components.label(df.where("v = 1"), grid)).orderBy("r", "c").collect()
    assert [x.object_id for x in got] == [1, 2, 3, 4]


def test_growth_stops_at_a_gap(spark):
    df, grid = cells(spark, [[-20.0, -20, -5, -20, -20]])
    seeds, _ = cells(spark, [[1.0, 0, 0, 0, 0]])
    assert array(components.region_grow(df, seeds, grid, -10), grid).tolist() == [[1, 1, 0, 0, 0]]


def test_small_regions_and_holes_are_strict(spark):
    a = np.array([[1, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]])
    df, grid = cells(spark, a)
    assert components.remove_small(df, grid, 2).count() == 2
    ring = np.ones((3, 3))
    ring[1, 1] = 0
    df, grid = cells(spark, ring)
    assert array(components.fill_holes(df, grid, 1), grid)[1, 1] == 0 and array(components.fill_holes(df, grid, 2), grid)[1, 1] == 1


def relaxed(e):
    s = np.full(e.shape, np.inf)
    s[0], s[-1], s[:, 0], s[:, -1] = e[0], e[-1], e[:, 0], e[:, -1]
    s[np.isnan(e)] = np.inf
    while True:
        p = np.pad(s, 1, constant_values=np.inf)
        low = np.min([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(np.isnan(e), np.inf, np.minimum(s, np.maximum(e, low)))
        if (new == s).all():
            return np.where(np.isnan(e), np.nan, np.where(np.isfinite(s), s, e))
        s = new


@pytest.mark.parametrize("tile", [4, 512])
def test_spill_matches_relaxation_over_tiles(spark, tile):
    e = np.random.default_rng(3).integers(0, 9, (11, 13)).astype(float)
    e[4, 4:7] = np.nan
    df, grid = cells(spark, e)
    got = array(terrain.fill_depressions(df, grid, 0, tile=tile), grid, "spill")
    assert np.array_equal(got, relaxed(e), equal_nan=True)


def test_spill_that_has_not_settled_is_an_error(spark):
    e = np.full((12, 12), 9.0)  # a channel over many tile borders
    e[1, :11], e[2:11, 10], e[10, 1:11] = 1, 1, 1
    df, grid = cells(spark, e)
    with pytest.raises(RuntimeError, match="settle"):
        terrain.fill_depressions(df, grid, 0, tile=4, rounds=2)
    got = array(terrain.fill_depressions(df, grid, 0, tile=4), grid, "spill")
    assert np.array_equal(got, relaxed(e))


def test_bowl_and_outlet(spark):
    bowl = np.full((5, 5), 10.0)
    bowl[1:4, 1:4] = 5
    bowl[2, 2] = 1
    df, grid = cells(spark, bowl)
    d = array(terrain.fill_depressions(df, grid, 0), grid, "depth")
    assert d[2, 2] == 9 and d[1, 1] == 5 and d[0, 0] == 0
    bowl[0, 2] = 7
    df, _ = cells(spark, bowl)
    d = array(terrain.fill_depressions(df, grid, 0), grid, "depth")
    assert d[2, 2] == 6 and d[1, 1] == 2


def test_pits_of_large_depressions(spark):
    bowl = np.full((5, 5), 10.0)
    bowl[1:4, 1:4] = 5
    bowl[2, 2] = 1
    df, grid = cells(spark, bowl)
    fill = terrain.fill_depressions(df, grid, 0)
    labels = df.select("r", "c", (F.col("c") + 1).cast("long").alias("object_id"))
    pits = lambda least: {x.object_id: x.has_pit for x in terrain.pit_presence(labels, fill, grid, least).collect()}
    assert pits(9) == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0} and set(pits(10).values()) == {0}


def test_alignment(spark):
    df, grid = cells(spark, np.arange(12.0).reshape(3, 4))
    assert g.align(df, grid, grid) is df
    small = Grid(2, 1, 2.0, e=-2.0)
    assert array(g.align(df, grid, small, "nearest"), small).tolist() == [[5, 7]]
    assert array(g.align(df, grid, small, "average"), small).tolist() == [[2.5, 4.5]]
    shifted = Grid(3, 2, c0=0.5, f0=-0.5)
    want = [[2.5, 3.5, 4.5], [6.5, 7.5, 8.5]]
    assert np.allclose(array(g.align(df, grid, shifted), shifted), want)
    assert np.allclose(array(g.align(df, grid, Grid(4, 3, epsg=1), "lanczos"), grid), np.arange(12.0).reshape(3, 4))
    assert np.allclose(array(g.align(df, grid, Grid(4, 3, epsg=1), "cubic"), grid), np.arange(12.0).reshape(3, 4))


def test_mosaic_bounds_and_guards(spark):
    a, grid = cells(spark, [[1, np.nan], [np.nan, 0]])
    b, _ = cells(spark, [[9, 8], [np.nan, 7]])
    assert np.array_equal(array(g.mosaic([a, b]), grid), [[1, 8], [np.nan, 0]], equal_nan=True)
    assert g.valid_bounds(a).first().asDict() == {"r0": 0, "r1": 1, "c0": 0, "c1": 1}
    empty, _ = cells(spark, [[np.nan]])
    with pytest.raises(Exception, match="no valid pixel"):
        g.valid_bounds(empty).collect()
    with pytest.raises(ValueError):
        Grid(1, 1, b=0.5).require_north_up()
    with pytest.raises(ValueError):
        g.same_shape(grid, Grid(3, 3))


def test_gaussian_of_a_constant_and_decibels(spark):
    df, grid = cells(spark, np.full((8, 9), 4.0))
    assert np.allclose(array(focal.gaussian(df, grid), grid), 4)
    back = df.withColumn("v", g.to_db(g.from_db(F.col("v"))))
    assert np.allclose(array(back, grid), 4)


@pytest.mark.parametrize("big", [False, True])
def test_large_files_are_read_like_others(tmp_path, big):
    bands = np.arange(2 * 30 * 7, dtype=np.int16).reshape(2, 30, 7)
    geotiff.write(f"{tmp_path}/x.tif", bands, Grid(7, 30, epsg=4326, nodata=-1.0), 8, big)
    with geotiff.opened(f"{tmp_path}/x.tif") as f:
        lay = geotiff.read_layout(f)
        got = np.concatenate([geotiff.read_block(f, lay, k)[:, :, 0] for k in range(len(lay.offsets))])
    assert (got.reshape(2, 30, 7) == bands).all() and lay.grid.epsg == 4326 and lay.grid.nodata == -1


def test_cells_become_a_file_and_windows_read_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geotiff, "STRIP_BYTES", 10 * 9 * 4)
    grid = Grid(9, 47, 2.0, e=-2.0, c0=5.0, f0=7.0, epsg=32633, nodata=-5.0)
    rows = [(r, c, None if (r + c) % 7 == 0 else r * 100.0 + c) for r in range(47) if not 20 <= r < 33 for c in range(9) if c != 4]
    path = f"file://{tmp_path}/cells.tif"
    cells = spark.createDataFrame(rows, "r int, c int, v double").repartition(3)
    assert geotiff.save_cells(cells, grid, path) == (tmp_path / "cells.tif").stat().st_size
    want = {(r, c): v for r, c, v in rows}
    df, got = geotiff.load(spark, path)
    assert got == grid
    assert {(x.r, x.c): x.v for x in df.collect()} == {(r, c): want.get((r, c)) for r in range(47) for c in range(9)}
    part, _ = geotiff.load(spark, path, window=(12, 18, 2, 6))
    assert {(x.r, x.c): x.v for x in part.collect()} == {(r, c): want.get((r, c)) for r in range(12, 18) for c in range(2, 6)}
    assert part.rdd.getNumPartitions() == 1
    assert geotiff.load(spark, path, window=(90, 95, 0, 3))[0].count() == 0
    geotiff.save_cells(cells.where("false"), grid, path)
    assert geotiff.load(spark, path)[0].where("v is not null").count() == 0
    with pytest.raises(ValueError):
        geotiff.save_cells(spark.createDataFrame([(50, 1, 1.0)], cells.schema), grid, path)
