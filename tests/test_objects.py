import numpy as np
import pytest
from pyspark.sql import functions as F

from inundata.functions import density, geo, special
from inundata.operators import catalog, interp, knn, objects as obj, segments, threshold
from inundata.operators.grid import Grid
from inundata.operators.rules import ObjectRules
from inundata.sources import geotiff, sinks


def test_two_means_of_a_clear_split(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (10.0,), (10.0,), (None,)], "y double")
    assert knn.two_means(df).first()[:] == (1.0, 10.0, 1.0, 5)
    same = spark.createDataFrame([(2.0,), (2.0,)], "y double")
    assert knn.two_means(same).first()[:] == (2.0, 2.0, 2.0, 2)
    assert knn.two_means(df.where("y > 99")).count() == 0


def test_two_means_match_brute_force(spark):
    y = np.sort(np.random.default_rng(5).normal(size=60))
    best = min(range(1, 60), key=lambda i: y[:i].var() * i + y[i:].var() * (60 - i))
    got = knn.two_means(spark.createDataFrame([(float(v),) for v in y], "y double"), parts=7).first()
    assert np.allclose(got[:2], (y[:best].mean(), y[best:].mean()))


@pytest.mark.parametrize("small", [0, 1000])
def test_neighbours_match_brute_force(spark, small):
    rng = np.random.default_rng(6)
    p = rng.integers(0, 30, (80, 2)).astype(float)
    pts = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double")
    got = knn.nearest(pts, pts.withColumnRenamed("id", "nid"), 4, own=True, small=small).toPandas().sort_values(["id", "rank"])
    for i in range(80):
        d = ((p - p[i]) ** 2).sum(axis=1)
        want = sorted((j for j in range(80) if j != i), key=lambda j: (d[j], j))[:4]
        assert got[got.id == i].nid.tolist() == want


def test_inverse_distance(spark):
    grid = Grid(1, 1)
    cell = spark.createDataFrame([(0, 0)], "r int, c int")
    pts = spark.createDataFrame([(1, 0.0, -0.5, 0.0), (2, 1.0, -0.5, 10.0)], "id long, x double, y double, z double")
    for power in (1.0, 2.0, 3.0):
        assert interp.idw(cell, pts, grid, power).first().v == pytest.approx(5)
    hit = spark.createDataFrame([(1, 0.5, -0.5, 7.0), (2, 1.0, -0.5, 10.0)], "id long, x double, y double, z double")
    assert interp.idw(cell, hit, grid, 3.0, 0.0).first().v == 7
    assert interp.idw(cell, hit, grid, 3.0, 0.0, 12).first().v == 7
    assert interp.idw(cell, hit.where("id > 9"), grid).first().v is None


def test_idw_passes_add_up(spark, monkeypatch):
    grid = Grid(4, 3)
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(i, float(rng.random() * 4), float(-rng.random() * 3), float(rng.random())) for i in range(25)], "id long, x double, y double, z double")
    whole = interp.idw(grid.cells(spark), pts, grid).toPandas().sort_values(["r", "c"]).v.to_numpy()
    monkeypatch.setattr(interp, "POINTS", 7)
    parts = interp.idw(grid.cells(spark), pts, grid).toPandas().sort_values(["r", "c"]).v.to_numpy()
    assert np.allclose(whole, parts)


def test_depth_grows_from_dry_seeds(spark):
    grid = Grid(3, 1)
    make = lambda v: spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "r int, c int, v double")
    got = interp.depth_class(make([5.0] * 3), make([6.0, 4.0, None]), make([1.0, 0.0, 0.0]), grid).orderBy("c").collect()
    assert [(x["depth"], x["class"]) for x in got] == [(0.0, 1), (1.0, 2), (None, 0)]


def objects(spark, rows):
    return spark.createDataFrame(rows, "ID long, area_px long, area_km2 double, cent_col double, cent_row double, LWSE double, has_pit int, depth_vol double, depre_vol double, label int")


def test_rules_in_their_order(spark):
    rows = [(1, 10, 0.1, 0, 0, 5, 0, 1, 1, 0), (2, 900, 9.0, 5, 0, 5, 0, 1, 1, 1), (3, 60, 0.2, 6, 0, 5, 1, 1, 2, 0), (4, 60, 0.2, 900, 0, 5, 0, 1, 1, 3), (5, 60, 0.2, 8, 0, 5, 0, 1, 1, 1)]
    o = objects(spark, [tuple(float(v) if i in (2, 3, 4, 5, 7, 8) else v for i, v in enumerate(r)) for r in rows])
    one = spark.createDataFrame([(1, 0.0, 0.0, 1.0, None)], "segment_id long, col double, row double, LWSE double, delta_LWSE double")
    done = ObjectRules.start(o).run(one)
    assert {x.ID: x.predict for x in done.results().collect()} == {1: 0, 2: 1, 3: 2, 4: 6, 5: 7}
    assert {x.predict: x.n for x in done.summary().collect()} == {0: 1, 1: 1, 2: 1, 6: 1, 7: 1}
    v = done.validate().first()
    assert (v.tp, v.fp, v.fn, v.tn) == (2, 0, 0, 3) and v.f1 == 1
    assert obj.validate(o.drop("label").withColumn("predict", F.lit(1))) is None
    skipped = ObjectRules.start(o.drop("has_pit")).depressions()
    assert skipped.skipped and skipped.results().where("predict is not null").count() == 0
    assert ObjectRules.start(o).small(50).small(1).results().where("predict = 0").count() == 1


def test_levels_flag_high_and_low(spark):
    ref = spark.createDataFrame([(i, float(i), 0.0, 10.0, d) for i, d in enumerate([-1.0, 0.0, 1.0, 0.0, 0.0, 0.0])], "segment_id long, col double, row double, LWSE double, delta_LWSE double")
    o = objects(spark, [(1, 99, 1.0, 0.0, 0.0, 99.0, 0, 1.0, 1.0, 0), (2, 99, 1.0, 1.0, 0.0, 1.0, 0, 1.0, 1.0, 0), (3, 99, 1.0, 2.0, 0.0, 10.0, 0, 1.0, 1.0, 0)])
    got = {x.ID: (x.predict, x.delta_LWSE) for x in ObjectRules.start(o).levels(ref).results().collect()}
    assert got == {1: (4, 89.0), 2: (5, -9.0), 3: (None, 0.0)}


def test_outline_of_a_square_with_a_hole(spark):
    pixels = [(r, c) for r in range(5) for c in range(6) if (r, c) not in {(2, 2), (2, 3)}]
    ways = segments.outlines(np.array(pixels), holes=True)
    assert [h for h, _ in ways] == [False, True]
    assert len(ways[0][1]) == len(set(ways[0][1])) == 18 and ways[0][1][0] == (0, 0)
    assert set(ways[1][1]) <= {(1, 2), (1, 3), (2, 1), (2, 4), (3, 2), (3, 3), (1, 1), (1, 4), (3, 1), (3, 4)}
    step = lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1]))
    for _, way in ways:
        assert all(step(a, b) == 1 for a, b in zip(way, way[1:] + way[:1]))
    labels = spark.createDataFrame([(7, *p) for p in pixels] + [(8, 20, 20)], "object_id long, r int, c int")
    got = segments.boundary_segments(labels, 5, 10).toPandas()
    assert set(got.object_id) == {7} and len(got) == 18 and got.segment_id.tolist().count(0) == 10
    both = segments.boundary_segments(labels, 5, 10, holes=True).toPandas()
    assert both.is_hole.any() and segments.boundary_segments(labels, 5, 10, least_contour=50).count() == 0


def test_single_pixels_and_lines_are_outlines():
    assert segments.outlines(np.array([(3, 3)])) == [(False, [(3, 3)])]
    assert segments.outlines(np.array([(0, 0), (0, 1), (0, 2)]))[0][1] == [(0, 0), (0, 1), (0, 2), (0, 1)]


def test_densities():
    assert density.peak(np.array([1.0, 2.0])) == 1.5 and density.peak(np.full(9, 4.0)) == 4
    x = np.r_[np.random.default_rng(0).normal(0, 1, 400), np.random.default_rng(1).normal(9, 0.5, 90)]
    assert abs(density.peak(x)) < 0.5 and density.upper_level(x) > 8.5
    assert np.isnan(density.upper_level(np.array([np.nan])))


def test_special_functions():
    assert special.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert special.trigamma(1) == pytest.approx(np.pi**2 / 6, abs=1e-10)
    for y in (-3.0, -1.0, 0.5, 4.0):
        assert special.digamma(special.inverse_digamma(y)) == pytest.approx(y, abs=1e-8)


def test_mixture_threshold_lies_between_the_modes():
    rng = np.random.default_rng(4)
    x = np.r_[rng.gamma(18, 1, 2000), rng.gamma(60, 0.6, 3000)]
    t = threshold.tile_threshold(x, 0.4)
    assert 15 < t < 36
    assert threshold.tile_threshold(np.full(9, 3.0), 0.5) == 3.0
    assert threshold.tile_threshold(np.array([np.nan]), 0.5) is None


def test_quadtree_halves_and_drops_odd_rests(spark):
    rows = [(r, c, 0.5 if r < 2 and c < 2 else 0.0) for r in range(5) for c in range(5)]
    df = spark.createDataFrame(rows, "r int, c int, v double")
    got = threshold.quadtree(df, Grid(5, 5), tile_size=5, levels=3).collect()
    assert [(x.r0, x.c0, x.h, x.w, x.level, x["mean"]) for x in got] == [(0, 0, 2, 2, 2, 0.5)]
    cells = threshold.cells_in_tiles(df, Grid(5, 5), tile_size=5, levels=3)
    assert cells.count() == 4


def test_outliers_drop_the_cutoff_itself(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.7), (2, 0.1, 0.5), (3, 0.0, 0.555), (4, 50.0, 0.9), (5, 0.0, 0.9), (6, 0.1, 0.9), (7, 0.0, 0.9)], "id int, threshold double, BC double")
    assert {x.id for x in threshold.drop_outliers(pts).collect()} == {1, 2, 5, 6, 7}
    with pytest.raises(Exception, match="no tile has a valid threshold"):
        threshold.drop_outliers(pts.where("id > 99")).collect()


def test_zones_and_projections(spark):
    assert geo.utm_code(30, -91) == "EPSG:32615" and geo.utm_code(-30, 151) == "EPSG:32756"
    with pytest.raises(ValueError):
        geo.utm_code(85, 0)
    one = spark.createDataFrame([(-93.0, 45.0), (-90.2, -20.0)], "x double, y double")
    there = geo.reproject(one, 4326, 32615).collect()
    assert there[0].x == pytest.approx(500_000, abs=1e-6) and there[0].y == pytest.approx(4_982_950.400, abs=0.01)
    back = geo.reproject(geo.reproject(one, 4326, 32615), 32615, 4326).collect()
    assert np.allclose([tuple(x) for x in back], [(-93, 45), (-90.2, -20)], atol=1e-9)
    assert geo.area_of_interest({"type": "Point", "coordinates": [1, 2]}) == (1, 2, 1, 2)
    assert geo.area_of_interest("1,2,3,4") == geo.area_of_interest([1, 2, 3, 4]) == (1, 2, 3, 4)
    with pytest.raises(TypeError):
        geo.area_of_interest(5)


def test_points_in_their_own_zones(spark):
    from inundata.plans import catalog_queries, fixtures

    rows = [(-180.0, 10.0, 32601), (-93.0, 45.0, 32615), (-90.2, -20.0, 32715), (151.0, -33.5, 32756), (179.0, 83.0, 32660)]
    pts = spark.createDataFrame(rows, "x double, y double, code int")
    there = geo.reproject(pts, 4326, F.col("code"))
    for x, y, code in rows:
        one = geo.reproject(pts.where(F.col("code") == code), 4326, code).first()
        got = there.where(F.col("code") == code).first()
        assert (got.x, got.y) == pytest.approx((one.x, one.y), abs=1e-6)
    back = {p.code: (p.x, p.y) for p in geo.reproject(there, F.col("code"), 4326).collect()}
    assert all(back[code] == pytest.approx((x, y), abs=1e-8) for x, y, code in rows)
    with pytest.raises(Exception, match="EPSG:4000 is not a UTM zone"):
        geo.reproject(pts, 4326, F.col("code") * 0 + 4000).collect()
    d = "/root/testdata/sf0.001"
    want = {s.image_id: (s.xmin, s.ymin) for s in fixtures.scenes(spark, d).collect()}
    every = catalog_queries.QUERIES["utm_round_trip"](spark, d).collect()
    assert len(every) == fixtures.scenes(spark, d).count() and all((s.x, s.y) == pytest.approx(want[s.image_id], abs=1e-6) for s in every)


def test_unknown_sensors_fail(spark):
    df = spark.createDataFrame([("S9", 1.0)], "s string, v double")
    with pytest.raises(Exception, match="unknown sensor"):
        df.select(catalog.scaled(F.col("s"), F.col("v"))).collect()


def test_short_names(spark, tmp_path):
    assert sinks.scaled_names(["a", "depth_vol", "a_long_column", "a_long_c_M"], {"depth_vol", "a_long_column"}) == {"depth_vol": "depth_vMm3", "a_long_column": "a_long_c_1"}
    names = sinks.short_names(["abcdefghijkl", "abcdefghijxx", "b"])
    assert names["abcdefghijkl"] == "abcdefghij" and len(set(names.values())) == 3 and max(map(len, names.values())) <= 10
    df = spark.createDataFrame([(1, 2e9, 1.0, 2.0), (2, 1.0, None, 2.0)], "ID long, depth_vol double, x double, y double")
    table, points = sinks.save_results(df, str(tmp_path))
    assert spark.read.parquet(points).collect()[0].depth_vMm3 == 2000 and spark.read.option("header", True).csv(table).count() == 2
    assert sinks.save_results(df.drop("x"), str(tmp_path), "other")[1] == ""


def test_rasters_round_trip(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 200, (2, 37, 21)).astype("uint8")
    grid = Grid(21, 37, 30.0, 0, 5e5, 0, -30.0, 4e6, 32615, 7.0)
    geotiff.write(str(tmp_path / "a.tif"), a, grid, rows=10)
    lay = geotiff.layout(str(tmp_path / "a.tif"))
    assert lay.grid == grid
    for band in (1, 2):
        df, _ = geotiff.load(spark, str(tmp_path / "a.tif"), band)
        got = df.toPandas().sort_values(["r", "c"]).v.to_numpy()
        want = a[band - 1].astype(float).ravel()
        assert np.array_equal(got, np.where(want == 7, np.nan, want), equal_nan=True)


def test_lzw_blocks():
    data = b"TOBEORNOTTOBEORTOBEORNOT" * 50

    def pack(data):
        table, codes, w = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
        n, width = 258, 9
        for i in data:
            x = w + bytes([i])
            if x in table:
                w = x
                continue
            codes.append((table[w], width))
            table[x] = n
            n += 1
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
            w = bytes([i])
        codes += [(table[w], width), (257, width)]
        bits = "".join(f"{c:0{k}b}" for c, k in codes)
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")

    assert geotiff.unpack_lzw(pack(data)) == data


def test_scene_stream(spark, tmp_path):
    from inundata.streaming import scenes

    rows = [("S2", "a/b", 1704499200000, 10.0, 0.0, 0.0, 1.0, 1.0), ("S2", "a/c", 1704499200000, 90.0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sensor string, image_id string, ts long, cloud double, xmin double, ymin double, xmax double, ymax double").withColumns({"mode": F.lit(None).cast("string"), "pol": F.array(F.lit("VV"))})
    df.write.parquet(str(tmp_path / "in"))
    seen: list = []
    q = scenes.watch(scenes.arrivals(spark, str(tmp_path / "in"), df.schema), [0, 0, 2, 2], "2024-01-01", "2024-02-01", lambda t: seen.extend(x.image_id for x in t.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert seen == ["a/b"]


def test_transfer_and_attributes(spark):
    old = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 2)], "r int, c int, object_id long")
    new = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (0, 2, 5)], "r int, c int, object_id long")
    known = spark.createDataFrame([(1, 1), (2, 3)], "object_id long, label int")
    assert obj.transfer_labels(old, new, known).first()[:] == (5, 1, 2, 1)
    dem = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (0, 2, None)], "r int, c int, v double")
    got = {x.ID: x for x in obj.object_attributes(old, Grid(3, 1, 1000.0, e=-1000.0), dem, "mean").collect()}
    assert got[1].LWSE == 2 and got[1].area_km2 == 2 and got[2].elev_mean is None
    with pytest.raises(ValueError):
        obj.object_attributes(old, Grid(3, 1), dem, "mode")


def test_rules_without_their_inputs(spark):
    rows = [(1, 5.0, 0.0, 0.0), (2, 6.0, 3.0, 4.0), (3, 7.0, None, None)]
    objects = ObjectRules.start(spark.createDataFrame(rows, "ID long, LWSE double, cent_col double, cent_row double"))
    reference = spark.createDataFrame([(1, 5.0, 1.0, 1.0)], "segment_id long, LWSE double, col double, row double")
    skipped = objects.levels(reference)
    assert skipped.skipped and {x.predict for x in skipped.results().collect()} == {None}
    for threshold in (60, "auto"):
        got = {x.ID: (x.distance, x.predict) for x in objects.distances(threshold, reference.where("false")).results().collect()}
        assert got == {1: (float("inf"), 6), 2: (float("inf"), 6), 3: (None, None)}
    flood = ObjectRules(objects.df.withColumn("predict", F.when(F.col("ID") == 1, 1)))
    got = {x.ID: (x.distance, x.predict) for x in flood.distances(4, reference.where("false")).results().collect()}
    assert got[2] == (5.0, 6) and got[1] == (0.0, 1)


def test_island_in_a_bay_is_an_outline_and_a_hole_is_none(spark):
    bay = {(r, c) for r in range(12) for c in range(12) if r in (0, 1, 2, 9, 10, 11) or c in (0, 1, 2)}
    island = {(r, c) for r in (5, 6) for c in (5, 6, 7)}
    ring = {(r, c) for r in range(20, 34) for c in range(14) if not (24 <= r < 29 and 4 <= c < 9)}
    within = {(26, 6)}
    rows = [(r, c, 1) for r, c in bay | island] + [(r, c, 2) for r, c in ring | within]
    labels = spark.createDataFrame(rows, "r int, c int, object_id long")
    got = segments.boundary_segments(labels, least=1)
    found = {(x.object_id, x.contour_id) for x in got.collect()}
    assert found == {(1, 0), (1, 1), (2, 0)}


def test_far_points_never_bring_all_others_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    right = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((400, 2)) * 100)]
    left = [(1000, -5000.0, 40.0), (1001, 50.0, 50.0), (1002, 9000.0, 9000.0), (1003, 50.0, -300.0)]
    monkeypatch.setattr(knn, "_small", lambda *_: pytest.fail("all points were asked for"))
    a = spark.createDataFrame(left, "id long, x double, y double")
    b = spark.createDataFrame(right, "nid long, x double, y double")
    got = knn.nearest(a, b, 3, small=50).collect()
    for i, x, y in left:
        want = sorted(((x - u) ** 2 + (y - v) ** 2, n) for n, u, v in right)[:3]
        assert [(r.nid) for r in sorted((r for r in got if r.id == i), key=lambda r: r.rank)] == [n for _, n in want]
