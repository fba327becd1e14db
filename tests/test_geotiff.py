import random

import numpy as np
import pytest

from terrastack.operators.grid import GridSpec
from terrastack.sources import geotiff


@pytest.mark.parametrize("size", [0, 1, 5, 300, 5000, 40000])
def test_lzw_round_trip(size):
    rng = random.Random(size)
    for letters in (b"ab", bytes(range(256))):
        data = bytes(rng.choice(letters) for _ in range(size))
        assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compress", ["none", "deflate", "lzw"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("dtype", ["float32", "uint16"])
def test_raster_round_trip(compress, predictor, dtype):
    values = np.random.default_rng(1).integers(0, 800, (37, 50)).astype(float)
    spec = GridSpec(100.0, 900.0, 30.0, 30.0, 50, 37, nodata=0.0)
    data = geotiff.encode_raster(values, spec, geotiff.TiffOptions(block=16, tile=64, compress=compress, predictor=predictor, dtype=dtype, overviews=(2, 4)), "<GDALMetadata/>")
    tags = geotiff.read_directories(data)
    assert len(tags) == 3 and geotiff.read_grid(tags[0]) == spec
    back = np.full(values.shape, np.nan)
    for row, col, block in geotiff.read_blocks_of(data):
        back[row : row + block.shape[0], col : col + block.shape[1]] = block
    assert (back == values).all()
    small = np.concatenate([b.ravel() for _, _, b in geotiff.read_blocks_of(data, 2)])
    assert small.size == 10 * 13 and small.max() <= 800


def test_files_round_trip_with_holes(spark, tmp_path):
    rng = random.Random(2)
    spec = GridSpec(0.0, 3000.0, 30.0, 30.0, 90, 70)
    rows = [(r, c, None if rng.random() < 0.2 else float(rng.randrange(500))) for r in range(70) for c in range(90) if rng.random() < 0.9]
    cells = spark.createDataFrame(rows, "grid_row int, grid_col int, value double")
    files = geotiff.encode(cells, spec, geotiff.TiffOptions(block=16, tile=32, compress="lzw", predictor=2))
    geotiff.write(files, str(tmp_path / "out"))
    meta = geotiff.read_meta(spark, str(tmp_path / "out")).collect()
    assert len(meta) == 9 and {m.crs for m in meta} == {"EPSG:5070"}
    got = {(r.grid_row, r.grid_col): r.value for r in geotiff.read_cells(spark, str(tmp_path / "out")).collect() if r.value is not None}
    assert got == {(r, c): v for r, c, v in rows if v is not None}
    assert geotiff.read_blocks(spark, str(tmp_path / "out")).count() == 6 * 5


def test_bad_files_and_options():
    with pytest.raises(ValueError, match="mounted"):
        geotiff._FileWriter("s3a://bucket/folder")
    assert geotiff._FileWriter("file:///tmp/x").path == "/tmp/x"
    with pytest.raises(ValueError):
        geotiff.read_directories(b"PNG?")
    for bad in ({"block": 20}, {"tile": 100}, {"compress": "jpeg"}, {"predictor": 3}):
        with pytest.raises(ValueError):
            geotiff.TiffOptions(**bad)


def striped(values, order, rows, dtype, compression=1):
    """A plain one-band TIFF in strips, as most programs write it."""
    import struct
    import zlib

    height, width = values.shape
    kind = np.dtype(order + dtype)
    strips = [values[r : r + rows].astype(kind).tobytes() for r in range(0, height, rows)]
    strips = [zlib.compress(s) if compression == 8 else s for s in strips]
    sample = {"u": 1, "i": 2, "f": 3}[dtype[0]]
    many, body = 13, b"".join(strips)
    at = 8 + len(body) + len(body) % 2
    extra = at + 2 + 12 * many + 4
    offsets = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    blobs, entries = b"", []
    for tag, code, items in sorted([(256, "I", [width]), (257, "I", [height]), (258, "H", [8 * kind.itemsize]), (259, "H", [compression]), (262, "H", [1]), (273, "I", offsets), (277, "H", [1]), (278, "H", [rows]), (279, "I", [len(s) for s in strips]), (339, "H", [sample]), (33550, "d", [30.0, 30.0, 0.0]), (33922, "d", [0, 0, 0, 60.0, 900.0, 0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 5070])]):
        raw = struct.pack(f"{order}{len(items)}{code}", *items)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", extra + len(blobs))
        if len(raw) > 4:
            blobs += raw
        entries.append(struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4, "d": 12}[code], len(items)) + place)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", at)
    return head + body + bytes(len(body) % 2) + struct.pack(f"{order}H", many) + b"".join(entries) + bytes(4) + blobs


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("dtype", ["u1", "i2", "u2", "i4", "f4", "f8"])
@pytest.mark.parametrize("compression", [1, 8])
def test_strips_of_either_byte_order_are_read(order, dtype, compression):
    values = np.random.default_rng(2).integers(0 if dtype[0] == "u" else -100, 100, (37, 21))
    data = striped(values, order, 8, dtype, compression)
    assert geotiff.read_grid(geotiff.read_directories(data)[0]) == GridSpec(60.0, 900.0, 30.0, 30.0, 21, 37, None)
    parts = list(geotiff.read_blocks_of(data))
    assert [p[:2] for p in parts] == [(r, 0) for r in range(0, 37, 8)]
    assert (np.concatenate([p[2] for p in parts]) == values).all()


def test_other_coordinates_are_refused(spark, tmp_path):
    from terrastack.plans import jobs

    values = np.ones((16, 16))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tif").write_bytes(geotiff.encode_raster(values, GridSpec(0.0, 16.0, 1.0, 1.0, 16, 16, -9999.0, "EPSG:4326"), geotiff.TiffOptions(block=16, tile=16)))
    with pytest.raises(Exception, match="EPSG:4326"):
        jobs.mosaic_files(spark, str(tmp_path / "in"), GridSpec(0.0, 16.0, 1.0, 1.0, 16, 16, -9999.0), str(tmp_path / "out"), options=geotiff.TiffOptions(block=16, tile=16)).collect()
