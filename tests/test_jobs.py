import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastack import schemas
from terrastack.operators import composite, density, retrieval
from terrastack.operators.grid import GridSpec
from terrastack.params import DensityParams, ForestParams, MosaicParams
from terrastack.plans import jobs
from terrastack.sources import catalog, geotiff


@pytest.fixture(scope="module")
def world(spark):
    """Two months of scenes over 30 pixels, half of them without vegetation."""
    rng = random.Random(3)
    scenes = [(s, f"LANDSAT_{5 + 3 * (s % 2)}", datetime(2001, 1 + s % 2, 1 + s % 28), rng.choice([5.0, 20.0, 90.0]), 40.0) for s in range(40)]
    obs = [(s, p, *[rng.randrange(8000, 18000) for _ in range(7)], rng.choice([64, 64, 64, 72, 192])) for s in range(40) for p in range(30)]
    pixels = [(p, -96.0 + p / 10, 40.0 + p / 20, "IA" if p < 10 else "WA", 71 if p % 2 else 11) for p in range(30)]
    cover = [(p, 2001, r, (71 if p % 2 else 11) if r == 0 else 99) for p in range(30) for r in (0, 1)]
    hull = [(s, i, int(i % 5 > 0)) for s in ("LT05", "LC08") for i in range(10_000)]
    return {
        "scenes": spark.createDataFrame(scenes, "scene_id long, spacecraft_id string, time_start timestamp_ntz, cloud_cover double, sun_elevation double"),
        "obs": spark.createDataFrame(obs, schemas.OBSERVATIONS),
        "pixels": spark.createDataFrame(pixels, "pixel_id long, lon double, lat double, state string, landcover int"),
        "cover": spark.createDataFrame(cover, schemas.LAND_COVER),
        "hull": spark.createDataFrame(hull, schemas.HULL),
    }


def test_monthly_composites_from_raw_bands(spark, world):
    rng = random.Random(1)
    samples = [(s, 5, *[rng.random() * 5000 for _ in schemas.FEATURES], rng.random() * 8) for s in ("LT05", "LC08") for _ in range(200)]
    train = spark.createDataFrame(samples, "sensor string, biome2 int, " + ", ".join(f"{f} double" for f in [*schemas.FEATURES, schemas.LABEL]))
    models = {(s, 5): retrieval.train(train, (s, 5), ForestParams(trees=3, min_leaf=5)) for s in ("LT05", "LC08")}
    pixels = world["pixels"].select("pixel_id", "lon", "lat", "state")
    found = jobs.retrievals(world["scenes"], world["obs"], pixels, world["cover"], world["hull"], models, "2001-01-01", "2001-03-01").cache()
    rows = found.collect()
    assert rows and all(r.biome == 5 and r.pixel_id % 2 == 1 and 0 <= r.lai <= 800 and r.qa & 6 == 0 for r in rows)
    months = jobs.monthly_composites(found, pixels, [(2001, 1), (2001, 2), (2001, 3)], "IA").collect()
    assert len(months) == 90
    for r in months:
        own = [x.lai for x in rows if x.pixel_id == r.pixel_id and x.time_start.month == r.month and x.qa & 3 == 0]
        assert r.obs_count == len(own) and r.lai == (int(np.floor(np.median(own))) if own else None)
        assert r["name"] == f"LAI_IA_2001_{r.month:02d}" and r.system_index == f"2001{r.month:02d}"
    assert months[0].end - months[0].start in (31 * 86_400_000, 28 * 86_400_000)


def test_partitioned_sink_and_catalog_union(spark, world, tmp_path):
    found = spark.createDataFrame([("IA", 2001, m, p, 5) for m in (1, 2) for p in range(3)], "state string, year int, month int, pixel_id long, lai int")
    composite.write_partitioned(found, f"{tmp_path}/c")
    assert (tmp_path / "c/state=IA/year=2001/month=1").is_dir()
    assert spark.read.parquet(f"{tmp_path}/c").where("month = 2").count() == 3
    for i in (0, 1):
        world["scenes"].where(f"scene_id % 2 = {i}").write.parquet(f"{tmp_path}/s{i}")
    assert catalog.read_scenes(spark, f"{tmp_path}/s0", f"{tmp_path}/s1", f"{tmp_path}/s1").count() == 60


def test_density_tables_and_csv(spark, world, tmp_path):
    membership = schemas.region_states(spark, {"ALL": None, "PNW": ["WA", "OR"]}, ["IA", "WA"])
    tables = jobs.density_tables(world["scenes"], world["obs"], world["pixels"], membership, DensityParams(2001, 2001), "sr_b1")
    good = {r.scene_id: r.time_start.month for r in world["scenes"].collect() if r.cloud_cover < 50}
    clear = [(r.pixel_id, good[r.scene_id]) for r in world["obs"].collect() if r.scene_id in good and r.qa_pixel & 152 == 0]
    stats = {r.month_num: r for r in tables["monthly_obs_stats"].collect()}
    assert stats[1].obs_count_mean == pytest.approx(sum(m == 1 for _, m in clear) / 30) and stats[5].obs_count_mean == 0
    gaps = {r.month_num: r for r in tables["gap_fraction"].collect()}
    assert gaps[5].gap == 1 and gaps[1].gap <= gaps[1].gap_lt2
    assert tables["regional_obs_stats"].count() == 24
    names = ["month_num", "month_label", "gap", "gap_lt2"]
    density.write_csv(tables["gap_fraction"].orderBy("month_num"), f"{tmp_path}/gap", names)
    lines = next((tmp_path / "gap").glob("*.csv")).read_text().splitlines()
    assert lines[0] == ",".join(names) and len(lines) == 13
    tables["mean"].unpersist()


@pytest.mark.parametrize("prefer", ["src", "dest"])
def test_mosaic_of_files_equals_replay(spark, tmp_path, prefer):
    rng = np.random.default_rng(7)
    target = GridSpec(0.0, 40.0, 1.0, 1.0, 50, 40, -9999.0)
    board = np.full((40, 50), np.nan)
    names = ["b.tif", "a.tiff", "a.tif", "z/c.tif"]
    made = {}
    for name in names:
        top, left = int(rng.integers(0, 25)), int(rng.integers(0, 30))
        values = rng.integers(0, 60, (18, 22)).astype(float)
        values[values < 10] = -9999.0
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(geotiff.encode_raster(values, GridSpec(left, 40.0 - top, 1.0, 1.0, 22, 18, -9999.0), geotiff.TiffOptions(block=16, tile=16)))
        made[name] = (top, left, values)
    for name in ["a.tif", "b.tif", "z/c.tif", "a.tiff"]:  # all .tif by path, then all .tiff
        top, left, values = made[name]
        part = board[top : top + 18, left : left + 22]
        values = values[: part.shape[0], : part.shape[1]]
        use = values != -9999.0 if prefer == "src" else (values != -9999.0) & np.isnan(part)
        part[use] = values[use] * 0.01
    out = jobs.mosaic_files(spark, str(tmp_path / "in"), target, str(tmp_path / "out"), MosaicParams(prefer=prefer), geotiff.TiffOptions(block=16, tile=32, overviews=(2,)))
    got = np.full((40, 50), np.nan)
    for r in out.collect():
        got[r.grid_row, r.grid_col] = r.value
    assert np.allclose(got, board, equal_nan=True)
    back = geotiff.read_cells(spark, str(tmp_path / "out"), grid=target).where(F.col("value").isNotNull()).count()
    assert back == np.isfinite(board).sum()
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        jobs.mosaic_files(spark, str(tmp_path / "none"), target, str(tmp_path / "x"))
