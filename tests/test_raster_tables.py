"""Scene search, tables in folders, block tables, growing mosaics, ordering, sinks, sketches."""

import math
import os
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastack.operators import footprints, grid, increments, mosaic, raster_blocks, sketches, zonal
from terrastack.params import MosaicParams
from terrastack.schemas import FEATURES, LABEL
from terrastack.sources import partitioned, sinks

BOXES = "id long, xmin double, ymin double, xmax double, ymax double"
TILES = "grid_row int, grid_col int, raw double, tile_ordinal int"
SCENES = "scene_id long, spacecraft_id string, time_start timestamp_ntz"


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def boxes(many, seed, sizes):
    rng = random.Random(seed)
    found = []
    for i in range(many):
        x, y, size = rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice(sizes)
        found.append((i, x, y, x + rng.uniform(0, size), y + rng.uniform(0, size)))
    return found


@pytest.mark.parametrize("base", [1.0, 13.0, 5000.0])
def test_overlaps_equal_comparing_all(spark, base):
    """Boxes of very different sizes, some that touch at a corner or lie on squares' edges, some equal."""
    a = boxes(150, 1, [1, 5, 30, 900]) + [(900, 0.0, 0.0, 13.0, 13.0), (901, 26.0, 26.0, 26.0, 26.0), (902, -1e6, -1e6, 1e6, 1e6)]
    b = boxes(150, 2, [2, 40, 300]) + [(900, 13.0, 13.0, 26.0, 26.0), (900, 13.0, 13.0, 26.0, 26.0), (901, -13.0, -13.0, 0.0, 0.0)]
    found = footprints.overlapping(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), base).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)


def test_overlaps_of_odd_boxes(spark):
    inf, nan = math.inf, math.nan
    odd = [(1, None, 0.0, 1.0, 1.0), (2, nan, 0.0, 1.0, 1.0), (3, 0.0, 0.0, inf, 1.0), (4, 5.0, 0.0, 1.0, 1.0), (5, 0.5, 0.5, 0.5, 0.5), (None, 0.0, 0.0, 1.0, 1.0)]
    frame = spark.createDataFrame(odd, BOXES)
    found = footprints.overlapping(frame, frame, 1.0).select("a.id", F.col("b.id").alias("other"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([(5, 5), (5, None), (None, 5), (None, None)], key=str)
    assert footprints.overlapping(frame.where("false"), frame, 1.0).collect() == []


def test_small_boxes_do_not_meet_because_of_a_large_one(spark):
    """One box over everything: pairs tried are few more than pairs found."""
    small = spark.createDataFrame([(i, float(i * 3), 0.0, i * 3 + 1.0, 1.0) for i in range(1000)], BOXES)
    large = small.unionByName(spark.createDataFrame([(-1, -1e5, -1e5, 1e5, 1e5)], BOXES))
    left, right = footprints._squares(large, 1.0, "a"), footprints._squares(small, 1.0, "b")
    tried = left.where("own = level").drop("own").join(right.drop("own"), ["level", "sx", "sy"]).count() + left.where("own < level").drop("own").join(right.where("own = level").drop("own"), ["level", "sx", "sy"]).count()
    assert footprints.overlapping(large, small, 1.0).count() == 2000
    assert tried < 10_000


def test_catalog_folders_are_pruned_by_the_wanted_table(spark, tmp_path):
    rows = [(i, f"LANDSAT_{(5, 7, 8, 9)[i % 4]}", datetime(1995 + i % 6, 1 + i % 12, 3)) for i in range(600)] + [(1000, "SPOT", datetime(1995, 1, 1)), (1001, "LANDSAT_5", None)]
    path = str(tmp_path / "catalog")
    partitioned.write_catalog(spark.createDataFrame(rows, SCENES), path)
    whole = spark.read.parquet(path)
    assert whole.count() == 602 and sum(len(f) for _, _, f in os.walk(path)) < 2 * 100
    wanted = spark.createDataFrame([("LC08", 1997, 3), ("LE07", 1996, 2), ("LE07", 1996, 2), ("LT05", 1997, 3), (None, 1996, 1), ("LE07", 2050, 1)], "sensor string, year int, month int")
    wanted.write.parquet(str(tmp_path / "wanted"))
    asked = spark.read.parquet(str(tmp_path / "wanted")).where(F.col("month") > 0)
    found = partitioned.scenes_of(whole, asked)
    plan = plan_of(found)
    assert "dynamicpruning" in plan.lower()
    want = {i for i, _, day in rows if day and (day.year, day.month) in ((1997, 3), (1996, 2))}
    assert {r.scene_id for r in found.collect()} == want and want
    # files read by the scan of the catalog: those of two folders
    read, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        elif node.getClass().getSimpleName() == "FileSourceScanExec" and "scene_id" in node.toString():
            read.append(node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert read and max(read) <= 4


def test_training_samples_by_key(spark, tmp_path):
    row = lambda sensor, biome, v: (sensor, biome, *[float(v)] * len(FEATURES), v)
    schema = "sensor string, biome2 long, " + ", ".join(f"{f} float" for f in FEATURES) + f", {LABEL} int"
    samples = spark.createDataFrame([row("LC08", 1, 1), row("LC08", 2, 2), row("LT05", 1, 3), row("LT05", 1, 3)], schema).withColumn("other", F.lit("x"))
    path = str(tmp_path / "samples")
    partitioned.write_samples(samples, path)
    found = partitioned.read_samples(spark, path)
    assert found.columns == [f.name for f in partitioned.SAMPLES] and found.count() == 4
    one = found.where((F.col("sensor") == "LT05") & (F.col("biome2") == 1))
    assert [r[LABEL] for r in one.collect()] == [3.0, 3.0]
    assert "PartitionFilters: [isnotnull(sensor" in plan_of(one)
    with pytest.raises(ValueError, match="NDVI.*sun_zenith as double, double"):
        partitioned.checked_samples(samples.drop("NDVI").withColumn("sun_zenith", F.lit("high")))


def block_tables(spark, tmp_path, layers, spec, size, buckets=4):
    found = []
    for i, cells in enumerate(layers):
        name = f"test_blocks_{i}_{random.getrandbits(40):x}"
        blocks = raster_blocks.to_blocks(spark.createDataFrame(cells, "grid_row int, grid_col int, value double"), spec, size=size)
        found.append(raster_blocks.save(blocks, str(tmp_path / name), name, buckets))
        raster_blocks.forget(spark, name)
        assert not spark.catalog.tableExists(name)
    return found


def test_block_tables_meet_without_a_shuffle(spark, tmp_path):
    spec = grid.GridSpec(0, 0, 1, 1, 37, 23)
    rng = random.Random(3)
    layers = [{(r, c): float(rng.randint(0, 99)) for r in range(23) for c in range(lo, hi) if rng.random() < 0.7} for lo, hi in ((0, 25), (18, 37))]
    below, above = block_tables(spark, tmp_path, [[(*k, v) for k, v in layer.items()] for layer in layers], spec, 8)
    merged = raster_blocks.merge(below, above)
    for frame in (merged, raster_blocks.overview(merged, 4, 8), raster_blocks.statistics(merged), raster_blocks.to_cells(merged, 8)):
        assert "Exchange" not in plan_of(frame)
    want = layers[0] | layers[1]
    assert {(r.grid_row, r.grid_col): r.value for r in raster_blocks.to_cells(merged, 8).collect()} == want
    assert {(r.grid_row, r.grid_col): r.value for r in raster_blocks.to_cells(raster_blocks.merge(above, below), 8).collect()} == layers[1] | layers[0]
    shapes = {(r.block_row, r.block_col): (r.rows, r.cols, len(r.cells)) for r in merged.collect()}
    assert shapes == {(i, j): (min(8, 23 - 8 * i), min(8, 37 - 8 * j), min(8, 23 - 8 * i) * min(8, 37 - 8 * j)) for i in range(3) for j in range(5)}
    squares = {}
    for (r, c), v in want.items():
        squares.setdefault((r // 4, c // 4), []).append(v)
    assert {(r.grid_row, r.grid_col): round(r.value, 9) for r in raster_blocks.overview(merged, 4, 8).collect()} == {k: round(sum(v) / len(v), 9) for k, v in squares.items()}
    facts = {(r.block_row, r.block_col): (r["count"], r.total, r.least, r.largest) for r in raster_blocks.statistics(merged).collect()}
    own = [v for (r, c), v in want.items() if r < 8 and c < 8]
    assert facts[0, 0] == (len(own), sum(own), min(own), max(own))


def test_blocks_of_odd_cells(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 5.0), (0, 1, None), (0, 2, math.nan), (-1, 0, 1.0), (9, 9, 1.0), (2, 2, 7.0)], "grid_row int, grid_col int, value double")
    spec = grid.GridSpec(0, 0, 1, 1, 3, 3)
    found = raster_blocks.to_blocks(cells, spec, size=2).collect()
    assert {(r.block_row, r.block_col): r.cells for r in found} == {(0, 0): [5.0, None, None, None], (1, 1): [7.0]}
    assert raster_blocks.to_blocks(cells.where("false"), spec).collect() == []
    with pytest.raises(ValueError, match="divide"):
        raster_blocks.overview(cells, 3, 8)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("prefer", ["src", "dest"])
def test_batches_in_any_order_equal_one_merge(spark, tmp_path, prefer):
    rng = np.random.default_rng(4)
    rows = [(int(r), int(c), float(rng.integers(-1, 50)), t) for t in range(6) for r, c in rng.integers(0, 32, (150, 2))]
    rows = list({(r, c, t): (r, c, v, t) for r, c, v, t in rows}.values())
    params = MosaicParams(prefer=prefer, nodata=-1)
    want = sorted(tuple(r) for r in mosaic.merge(spark.createDataFrame(rows, TILES), params).collect())
    for number, order in enumerate(([0, 1], [1, 0], [1, 0, 1])):
        path = str(tmp_path / f"m{number}")
        for batch in order:
            increments.add_tiles(spark.createDataFrame([r for r in rows if (r[3] in (1, 4, 5)) == bool(batch)], TILES), path, params, 8)
        assert sorted(tuple(r) for r in increments.current(spark, path, params).collect()) == want


def test_blocks_that_are_not_touched_keep_their_files(spark, tmp_path):
    path, params = str(tmp_path / "m"), MosaicParams(nodata=0)
    increments.add_tiles(spark.createDataFrame([(r, c, 5.0, 0) for r in range(16) for c in range(16)], TILES), path, params, 8)
    before = files(path)
    increments.add_tiles(spark.createDataFrame([(3, 12, 9.0, 1), (0, 0, 0.0, 1)], TILES), path, params, 8)
    after = files(path)
    assert {f for f in before if "block_row=0/block_col=1" not in f} == {f for f in after if "block_row=0/block_col=1" not in f}
    assert all(after[f] == t for f, t in before.items() if f in after) and not {f for f in before if "block_row=0/block_col=1" in f} & after.keys()
    found = {(r.grid_row, r.grid_col): r.value for r in increments.current(spark, path, params).collect()}
    assert len(found) == 256 and round(found[3, 12], 9) == 0.09 and round(found[0, 0], 9) == 0.05
    increments.add_tiles(spark.createDataFrame([(3, 12, 0.0, 7)], TILES), path, params, 8)
    assert files(path) == after  # nothing valid: nothing written


def test_ordinals_without_one_task(spark):
    names = [f"tile_{n:05d}.tif" for n in range(5000)]
    shuffled = random.Random(5).sample(names, len(names))
    frame = spark.createDataFrame([(n, len(n)) for n in shuffled], "path string, size int").repartition(7)
    ranked = zonal.ranked(frame, [F.desc("path")])
    assert ranked.columns == ["path", "size", "ordinal"]
    assert [r.path for r in sorted(ranked.collect(), key=lambda r: r.ordinal)] == names[::-1]
    assert sorted(r.ordinal for r in ranked.collect()) == list(range(5000))
    assert zonal.ranked(frame.where("false"), [F.col("path")]).collect() == []
    ties = zonal.ranked(spark.createDataFrame([(1,), (1,), (None,)], "path int"), [F.col("path")]).collect()
    assert sorted(r.ordinal for r in ties) == [0, 1, 2] and next(r.ordinal for r in ties if r.path is None) == 0
    assert "SinglePartition" not in plan_of(ranked) and "Window" not in plan_of(ranked)


def test_one_plan_to_several_sinks(spark, tmp_path):
    worked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    spec = grid.GridSpec(0, 0, 1, 1, 4, 3)
    result = grid.cells(spark, spec).withColumns({"value": F.col("grid_row") * 10.0 + F.col("grid_col"), "state": F.lit("IA"), "year": F.lit(2000), "month": F.col("grid_row") + 1})
    result = result.mapInArrow(count, result.schema)
    root = str(tmp_path / "all")
    places = sinks.export(result, sinks.ExportParams(root, ("table", "cells", "blocks", "report"), selectors=("month", "value")), spec)
    assert worked.value == 12  # worked out once
    assert spark.read.parquet(places["table"]).where("month = 2 AND state = 'IA'").count() == 4 and os.path.isdir(f"{root}/table/state=IA/year=2000/month=3")
    want = {(r, c): r * 10.0 + c for r in range(3) for c in range(4)}
    assert {(r.grid_row, r.grid_col): r.value for r in spark.read.parquet(places["cells"]).collect()} == want
    assert {(r.grid_row, r.grid_col): r.value for r in raster_blocks.to_cells(spark.read.parquet(places["blocks"])).collect()} == want
    assert spark.read.csv(places["report"], header=True).columns == ["month", "value"]
    assert set(sinks.export(result, sinks.ExportParams(f"{root}2", ("table", "cells", "blocks"), maps=False))) == {"table"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.export(result, sinks.ExportParams(f"{root}2", ("table",)))
    sinks.export(result, sinks.ExportParams(f"{root}2", ("table",), mode="overwrite"))
    for bad in (lambda: sinks.ExportParams(root, ("drive",)), lambda: sinks.ExportParams(root, ()), lambda: sinks.ExportParams(root, ("report",)), lambda: sinks.ExportParams(root, mode="append")):
        with pytest.raises(ValueError, match="must be|needs"):
            bad()
    with pytest.raises(ValueError, match="grid"):
        sinks.export(result, sinks.ExportParams(root, ("blocks",)))
    with pytest.raises(ValueError, match="lacks state"):
        sinks.export(result.drop("state"), sinks.ExportParams(root))


def test_sketches_merge_within_the_stated_rank_error(spark):
    """300,000 skewed values in 40 blocks, merged in two steps: ranks within 0.5 %; ends and counts are exact."""
    values = spark.range(300_000).select((F.col("id") % 40).alias("block"), F.floor(F.pow(F.rand(7), 3) * 1e6).cast("double").alias("v")).persist()
    blocks = sketches.sketch(values, "v", ["block"])
    halves = sketches.merge(blocks.withColumn("half", F.col("block") % 2), ["half"])
    percentiles = [0, 1, 10, 25, 50, 75, 90, 99, 100]
    found = sketches.quantiles(sketches.merge(halves, []), "v", percentiles).first()
    own = np.sort([r.v for r in values.select("v").collect()])
    assert found.v_count == len(own)
    for p in percentiles:
        q = found[f"v_p{p}"]
        low, high = np.searchsorted(own, q, "left") / len(own), np.searchsorted(own, q, "right") / len(own)
        assert low - 0.005 <= p / 100 <= high + 0.005
    assert (found.v_p0, found.v_p100) == (own[0], own[-1])
    values.unpersist()
    odd = spark.createDataFrame([(1, None), (2, 3.0)], "block long, v double")
    assert [(r.block, r.v_p50) for r in sketches.quantiles(sketches.sketch(odd, "v", ["block"]), "v", [50]).collect()] == [(2, 3.0)]
