import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastack import schemas
from terrastack.functions import landcover, masks, projection, spectral
from terrastack.operators import composite, density, grid, mosaic, quality_flags, retrieval, zonal
from terrastack.params import CompositeParams, DensityParams, ForestParams, MosaicParams
from terrastack.sources import catalog, tiles
from terrastack.streaming import monthly


def values(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_clear_sky_for_all_bit_combinations(spark):
    rows = values(spark.range(256).select("id", masks.clear_sky(F.col("id").cast("int")).alias("c")), "id", "c")
    assert all(c == (i & (8 | 16 | 128) == 0) for i, c in rows)


def test_flags_and_validity(spark):
    cases = [(lai, hull, biome) for lai in (-0.1, 0.0, 8.0, 8.01, None) for hull in (0, 1) for biome in (0, 3)]
    frame = spark.createDataFrame(cases, "lai double, hull int, biome int").withColumn("qa", quality_flags.quality_flags(F.col("lai"), F.col("hull"), F.col("biome")))
    for r in frame.withColumn("ok", masks.qa_valid(F.col("qa"))).collect():
        if r.lai is None:
            assert r.qa is None
            continue
        assert r.qa == (r.hull == 0) + 2 * (not 0 <= r.lai <= 8) + 4 * (r.biome == 0)
        assert r.ok == (r.qa & 3 == 0)


def test_encoding_round_trip(spark):
    frame = spark.createDataFrame([(0.0,), (7.999,), (8.0,), (-1.0,), (700.0,), (None,)], "lai double")
    code = quality_flags.encode(F.col("lai"))
    assert values(frame.select(code.alias("c")), "c") == [(0,), (800,), (800,), (0,), (65535,), (None,)]
    assert frame.select(F.round(quality_flags.decode(code), 6).alias("d")).collect()[1].d == 8.0
    assert frame.select(F.round(quality_flags.decode(code, 0.001), 6).alias("d")).collect()[1].d == 0.8


def test_hull_bins_at_the_edges(spark):
    rows = [(0.0, 0.0, 0.0, 0.0), (5099.999, 5099.999, 7099.999, 7099.999), (5100.0, 1.0, 1.0, 1.0), (-1.0, 1.0, 1.0, 1.0), (510.0, 1020.0, 710.0, 1420.0)]
    frame = spark.createDataFrame(rows, "red double, green double, nir double, swir1 double")
    assert values(frame.select(quality_flags.hull_index().alias("i")), "i") == [(0,), (9999,), (None,), (None,), (1212,)]
    hull = spark.createDataFrame([(0, 1), (9999, 0)], "hull_index int, in_hull int")
    assert sorted(values(quality_flags.with_hull(frame, hull), "in_hull")) == [(0,), (0,), (0,), (0,), (1,)]


def test_epochs_of_all_years(spark):
    rows = dict(values(spark.range(1983, 2026).select(F.col("id").cast("int").alias("y")).select("y", landcover.epoch_of_year(F.col("y")).alias("e")), "y", "e"))
    epochs = [2001, 2004, 2006, 2008, 2011, 2013, 2016, 2019, 2021]
    assert rows[1983] is None and rows[2025] is None
    for year in range(1984, 2025):
        assert rows[year] == min(epochs, key=lambda e: (abs(e - year), e))
    assert dict(values(schemas.epoch_by_year(spark), "year", "epoch")) == {y: rows[y] for y in range(1984, 2025)}
    with pytest.raises(Exception, match="no land-cover epoch"):
        spark.range(1983, 1984).select(landcover.epoch_of_year(F.col("id").cast("int"), strict=True)).collect()


def test_classes(spark):
    known = {r.landcover: (r.biome, r.is_veg) for r in schemas.class_map(spark).collect()}
    got = values(spark.range(100).select("id", landcover.biome_of_class(F.col("id")).alias("b"), landcover.is_vegetated(F.col("id")).alias("v")), "id", "b", "v")
    assert all((b, v) == known.get(c, (None, None)) for c, b, v in got)


def test_solar_fallbacks_and_missing_columns(spark):
    schema = "scene_id int, sun_elevation double, solar_zenith_angle double, sun_azimuth double"
    rows = [(1, 30.0, 10.0, 5.0), (2, None, 10.0, None), (3, None, None, None)]
    got = values(spectral.solar_geometry(spark.createDataFrame(rows, schema)).orderBy("scene_id"), "sun_zenith", "sun_azimuth")
    assert got == [(60.0, 5.0), (10.0, 180.0), (45.0, 180.0)]


def test_indices_mask_zero_sums(spark):
    frame = spectral.add_indices(spark.createDataFrame([(1.0, 3.0, 1.0), (-1.0, 1.0, 2.0), (None, 1.0, -1.0)], "red double, nir double, swir1 double"))
    assert values(frame, "NDVI", "NDWI") == [(0.5, 0.5), (None, -1 / 3), (None, None)]


def test_band_names_by_sensor(spark):
    rows = [(s, *range(1, 8)) for s in ("LANDSAT_5", "LANDSAT_7", "LANDSAT_8", "LANDSAT_9")]
    frame = spark.createDataFrame(rows, "spacecraft_id string, " + ", ".join(f"sr_b{i} int" for i in range(1, 8)))
    got = {r[0]: r[1:] for r in values(spectral.rename_bands(frame), "spacecraft_id", "blue", "green", "red", "nir", "swir1", "swir2")}
    assert got["LANDSAT_5"] == got["LANDSAT_7"] == (1, 2, 3, 4, 5, 7)
    assert got["LANDSAT_8"] == got["LANDSAT_9"] == (2, 3, 4, 5, 6, 7)


def test_catalog_filters(spark):
    rows = [(1, "LANDSAT_5", datetime(2000, 1, 1), 49.9), (2, "LANDSAT_8", datetime(2000, 2, 1), 10.0), (3, "LANDSAT_9", datetime(2000, 1, 31, 23, 59), 50.0), (4, "SPUTNIK_1", datetime(2000, 1, 5), 1.0)]
    scenes = spark.createDataFrame(rows, "scene_id long, spacecraft_id string, time_start timestamp_ntz, cloud_cover double")
    assert values(catalog.catalog(scenes, "2000-01-01", "2000-02-01"), "scene_id", "sensor") == [(1, "LT05"), (4, None)]
    with pytest.raises(Exception, match="unknown spacecraft"):
        catalog.check_spacecraft(scenes).collect()


def test_projection_values_and_round_trip(spark):
    assert (projection.CONE, projection.CONSTANT) == pytest.approx((0.6029027690657601, 1.3491820315609704), abs=1e-14)
    assert projection.RADIUS_0 == pytest.approx(9928937.004248781, abs=1e-6)
    frame = spark.createDataFrame([(-89.4, 43.07), (-124.0, 25.0), (-70.0, 49.0)], "lon double, lat double")
    x, y = projection.to_albers(F.col("lon"), F.col("lat"))
    frame = frame.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = projection.to_lonlat(F.col("x"), F.col("y"))
    rows = frame.select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert (rows[0].x, rows[0].y) == pytest.approx((534220.7390, 2249079.8448), abs=1e-3)
    assert all((r.lon, r.lat) == pytest.approx((r.lon2, r.lat2), abs=1e-9) for r in rows)


RETRIEVALS = "pixel_id long, time_start timestamp_ntz, lai int, qa int, biome int"


def test_composites(spark):
    jan, feb = datetime(2001, 1, 5), datetime(2001, 2, 5)
    rows = [(1, jan, 10, 0, 1), (1, jan, 13, 4, 1), (1, jan, 90, 1, 1), (1, jan, 91, 2, 1), (2, jan, 7, 0, 0), (1, feb, 5, 0, 1), (1, feb, 9, 0, 1), (1, feb, 30, 0, 1)]
    frame = spark.createDataFrame(rows, RETRIEVALS)
    assert sorted(values(composite.monthly(frame), "pixel_id", "month", "lai", "obs_count")) == [(1, 1, 11, 2), (1, 2, 9, 3)]
    assert sorted(values(composite.monthly(frame, CompositeParams(reducer="mean", nonveg=True)), "pixel_id", "month", "lai", "obs_count")) == [(1, 1, 11, 2), (1, 2, 14, 3), (2, 1, 7, 1)]
    pixels = spark.createDataFrame([(1,), (3,)], "pixel_id long")
    dense = composite.monthly_dense(frame, pixels, [(2001, 1), (2005, 1)])
    assert sorted(values(dense, "pixel_id", "year", "obs_count")) == [(1, 2001, 2), (1, 2005, 0), (3, 2001, 0), (3, 2005, 0)]
    assert composite.monthly(spark.createDataFrame([], RETRIEVALS)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_density_properties(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(1, 6), 2000 + rng.randrange(3), rng.randrange(1, 13)) for _ in range(300)]
    clear = spark.createDataFrame(rows, "pixel_id long, year int, month int")
    pixels = spark.createDataFrame([(i, "A" if i < 4 else "B") for i in range(1, 8)], "pixel_id long, state string")
    params = DensityParams(2000, 2002)
    want = {(p, m): sum(r[0] == p and r[2] == m for r in rows) / 3 for p in range(1, 8) for m in range(1, 13)}
    means = density.mean_obs_count(clear, pixels, params)
    assert {(r.pixel_id, r.month): r.obs_count for r in means.collect()} == pytest.approx(want)
    counts = density.clear_obs_count(clear, pixels, params)
    assert counts.count() == 7 * 36 and counts.agg(F.sum("obs_count")).first()[0] == 300
    stats = density.monthly_obs_stats(means).collect()
    for r in stats:
        assert r.obs_count_p10 <= r.obs_count_p25 <= r.obs_count_median <= r.obs_count_p75 <= r.obs_count_p90
        assert r.obs_count_mean == pytest.approx(np.mean([want[p, r.month_num] for p in range(1, 8)]))
    gaps = density.gap_fraction(means).collect()
    assert len(gaps) == 12 and all(g.gap <= g.gap_lt2 for g in gaps)
    regions = schemas.region_states(spark, {"ALL": None, "A": ["A"]}, ["A", "B"])
    regional = density.regional_obs_stats(means, regions)
    whole = {r.month_num: r.obs_count_mean for r in regional.where("region = 'ALL'").collect()}
    assert whole == pytest.approx({r.month_num: r.obs_count_mean for r in stats})
    sparse = density.mean_obs_count(clear, pixels, DensityParams(2000, 2002, zero_fill=False))
    assert all(r.obs_count >= 1 for r in sparse.collect())


@pytest.mark.parametrize("prefer", ["src", "dest"])
@pytest.mark.parametrize("scale", [None, 1, 0.001, 0.01])
def test_mosaic_equals_sequential_replay(spark, prefer, scale):
    rng = random.Random(4)
    pool = [0.0, -9999.0, float("nan"), float("inf"), 5.0, 7.0, 800.0, None]
    rows = [(t, r, c, rng.choice(pool)) for t in range(6) for r in range(4) for c in range(4) if rng.random() < 0.7]
    board = {}
    for _, r, c, raw in sorted(rows, key=lambda x: x[0]):
        valid = raw is not None and math.isfinite(raw) and raw != -9999
        if valid and (prefer == "src" or (r, c) not in board):
            board[r, c] = raw if scale in (None, 1) else raw * scale
    frame = spark.createDataFrame(rows, "tile_ordinal int, grid_row int, grid_col int, raw double")
    got = {(r.grid_row, r.grid_col): r.value for r in mosaic.merge(frame, MosaicParams(prefer=prefer, scale=scale)).collect()}
    assert got == pytest.approx(board)


def test_bad_parameters():
    for make in (lambda: MosaicParams(prefer="last"), lambda: MosaicParams(resampling="cubic"), lambda: CompositeParams(reducer="max"), lambda: DensityParams(2001, 2000), lambda: grid.GridSpec(0, 0, 0, 1, 1, 1)):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(ValueError):
        grid.GridSpec(0, 0, 1, 1, 10**8, 10**8).check()


def test_merge_order_of_files(spark):
    paths = spark.createDataFrame([(p,) for p in ("x/b.tif", "x/a.tiff", "x/a/z.tif", "x/a.tif", "x/c.txt")], "path string")
    got = [r.path for r in tiles.in_merge_order(paths).orderBy("tile_ordinal").collect()]
    assert got == ["x/a/z.tif", "x/a.tif", "x/b.tif", "x/a.tiff"]


def test_zones(spark):
    states = spark.createDataFrame([(s,) for s in ("WA", "AK", "IA", "PR", "IA")], "state string")
    kept = zonal.keep_zones(states)
    assert [zonal.pick_zone(kept, i).first().state for i in (-1, 0, 1, 9)] == ["IA", "IA", "WA", "WA"]
    assert zonal.pick_zone(kept, 0, "TX").first().state == "TX"
    pixels = spark.createDataFrame([(1, "WA"), (1, "IA"), (2, "IA")], "pixel_id long, state string")
    regions = schemas.region_states(spark, {"R": ["WA", "IA"]}, [])
    assert sorted(values(zonal.dissolve(pixels, regions), "pixel_id")) == [(1,), (2,)]


def test_warp_and_overview(spark):
    source = grid.GridSpec(0, 4, 1, 1, 4, 4)
    raster = grid.cells(spark, source).withColumn("value", (F.col("grid_row") * 10 + F.col("grid_col")).cast("double"))
    target = grid.GridSpec(-0.4, 4, 2, 2, 3, 2)
    got = {(r.grid_row, r.grid_col): r.value for r in grid.warp_nearest(raster, source, grid.cells(spark, target), target).collect()}
    assert got == {(r, c): (1 + 2 * r) * 10 + math.floor(0.6 + 2 * c) for r in range(2) for c in range(2)}
    means = {(r.grid_row, r.grid_col): r.value for r in grid.overview(raster, 2).collect()}
    assert means == {(0, 0): 5.5, (0, 1): 7.5, (1, 0): 25.5, (1, 1): 27.5}
    assert grid.overview_pyramid(raster, [2, 4]).count() == 5
    whole = spark.createDataFrame([(r, c, (r * 37 + c * 11) % 800 if (r + c) % 5 else None) for r in range(33) for c in range(47)], "grid_row int, grid_col int, value long")
    for parts in (1, 4, 8):
        got = {(r.level, r.grid_row, r.grid_col): r.value for r in grid.overview_pyramid(whole.repartition(parts), [2, 4, 6, 8, 32], scale=0.01).collect()}
        want = {}
        for f in (2, 4, 6, 8, 32):
            squares = {}
            for r, c, v in whole.collect():
                squares.setdefault((f, r // f, c // f), []).extend([] if v is None else [v])
            want |= {k: sum(v) / len(v) * 0.01 if v else None for k, v in squares.items()}
        assert got == want
    with pytest.raises(ValueError):
        grid.overview_pyramid(whole, [1, 2])
    clipped = grid.block_grid(spark, 1000, 600).where("block_row = 1 and block_col = 1").first()
    assert (clipped.rows, clipped.cols) == (88, 488)


def test_forest(spark):
    rng = random.Random(0)
    rows = []
    for _ in range(600):
        f = [rng.random() for _ in schemas.FEATURES]
        biome = rng.randrange(3)
        rows.append(("LC08", biome, biome, *f, 3 * f[6] + biome))
    names = ["sensor", "biome", "biome2", *schemas.FEATURES, schemas.LABEL]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("sensor", T.StringType()), T.StructField("biome", T.IntegerType()), T.StructField("biome2", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names[3:]]]))
    params = ForestParams(trees=10, min_leaf=5)
    models = {("LC08", b): retrieval.train(frame, ("LC08", b), params) for b in (0, 1, 2)}
    found = retrieval.retrieve(frame, models).toPandas()
    assert set(found.biome) == {1, 2}
    error, spread = (found.lai_real - found.MCD_LAI).abs().mean(), (found.MCD_LAI - found.MCD_LAI.mean()).abs().mean()
    assert error < 0.6 * spread
    assert found.lai_real.between(found.MCD_LAI.min(), found.MCD_LAI.max()).all()
    again = retrieval.predict(retrieval.train(frame, ("LC08", 1), params), frame.where("biome = 1"), "b").toPandas()
    assert np.allclose(sorted(again.b), sorted(found[found.biome == 1].lai_real))
    assert set(retrieval.retrieve(frame, models, nonveg=True).toPandas().biome) == {0, 1, 2}
    holes = frame.limit(1).withColumn("red", F.lit(None).cast("double"))
    assert retrieval.predict(models["LC08", 1], holes).first().lai_real is None


def test_streaming_days_make_months(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(3), datetime(2001, 1 + rng.randrange(3), 1 + rng.randrange(28), 12), float(rng.randrange(9))) for _ in range(200)]
    frame = spark.createDataFrame(rows, "k int, ts timestamp, v double")
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    run = monthly.monthly_running(stream, "k", "ts", "v").writeStream.outputMode("complete").format("memory").queryName("days_of_months").start()
    run.processAllAvailable()
    run.stop()
    got = {(r.k, r.month): (r.n, round(r["mean"], 9)) for r in monthly.months_of_days(spark.table("days_of_months"), "k").collect()}
    want = {(r.k, r.month): (r.n, round(r["mean"], 9)) for r in monthly.monthly_running(frame, "k", "ts", "v").collect()}
    assert got == want
