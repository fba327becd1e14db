"""GeoTIFF files in and out: a codec for tiled one-band rasters, and Spark jobs around it.

Writing: cells are dealt to square tiles of the grid, each of which one task turns into a file of bounded size; the files are written by
the data source "geotiff". Reading: Spark's binaryFile reader fetches files from any store, and tasks turn them into rows, one a block.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from terrastack.operators.grid import GridSpec

# Fixed values of the TIFF and GeoTIFF formats.
NONE, LZW, DEFLATE = 1, 5, 8
COMPRESSIONS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 262, 277, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
STRIP_OFFSETS, STRIP_ROWS, STRIP_COUNTS = 273, 278, 279
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
SHORT, LONG, DOUBLE, ASCII = 3, 4, 12, 2
KINDS = {SHORT: "H", LONG: "I", DOUBLE: "d"}
#: Says how overviews were made.
AVERAGED = '<GDALMetadata><Item name="OVERVIEW_RESAMPLING">AVERAGE</Item></GDALMetadata>'


@dataclass(frozen=True)
class TiffOptions:
    """Block and file sizes in cells, compression, predictor (1 none, 2 horizontal), overview factors, sample type."""

    block: int = 512
    tile: int = 2048
    compress: str = "deflate"
    predictor: int = 1
    overviews: tuple[int, ...] = field(default=())
    dtype: str = "float32"

    def __post_init__(self) -> None:
        if self.block < 16 or self.block % 16:
            raise ValueError("block must be a multiple of 16")
        if self.tile % self.block:
            raise ValueError("tile must be a multiple of block")
        if self.compress not in COMPRESSIONS:
            raise ValueError(f"compress must be one of {sorted(COMPRESSIONS)}")
        if self.predictor not in (1, 2) or self.dtype not in ("float32", "uint16"):
            raise ValueError("predictor must be 1 or 2, dtype float32 or uint16")


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, widened one code early."""
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> (bits - 8) & 255)
            bits -= 8
        held &= (1 << bits) - 1

    width, following = 9, 258
    put(256, width)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0], width)
        table[longer] = following
        following += 1
        if following == 4094:
            put(256, width)
            table, width, following = {}, 9, 258
        elif following + 1 > 1 << width:
            width += 1
        word = longer[-1:]
    if word:
        put(table[word] if len(word) > 1 else word[0], width)
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table = [], [bytes([i]) for i in range(256)] + [b"", b""]
    held = bits = at = 0
    width, previous = 9, b""
    while True:
        while bits < width:
            if at == len(data):
                return b"".join(out)
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        code = held >> (bits - width)
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            del table[258:]
            width, previous = 9, b""
            continue
        if previous:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        else:
            entry = table[code]
        out.append(entry)
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def _pack(block: np.ndarray, options: TiffOptions) -> bytes:
    words = block.view(f"<u{block.itemsize}")
    if options.predictor == 2:
        words = np.concatenate([words[:, :1], np.diff(words, axis=1)], axis=1)
    raw = words.tobytes()
    return zlib.compress(raw, 6) if options.compress == "deflate" else lzw_encode(raw) if options.compress == "lzw" else raw


def _unpack(raw: bytes, compression: int, predictor: int, shape: tuple[int, int], dtype: np.dtype) -> np.ndarray:
    """The values of a block; the last strip of an image may have fewer rows than the others."""
    if compression not in (NONE, LZW, DEFLATE, 32946):
        raise ValueError(f"compression {compression} is not read")
    plain = raw if compression == NONE else lzw_decode(raw) if compression == LZW else zlib.decompress(raw)
    kind = np.dtype(f"u{dtype.itemsize}").newbyteorder(dtype.byteorder)
    rows = min(shape[0], len(plain) // (shape[1] * kind.itemsize))
    words = np.frombuffer(plain, kind, rows * shape[1]).reshape(rows, shape[1])
    if predictor == 2:
        words = np.cumsum(words, axis=1, dtype=words.dtype)
    return words.view(dtype)


def _means(values: np.ndarray, factor: int, nodata: float) -> np.ndarray:
    """Means of squares, empty cells left out."""
    rows, cols = (-(-n // factor) for n in values.shape)
    padded = np.full((rows * factor, cols * factor), nodata, np.float64)
    padded[: values.shape[0], : values.shape[1]] = values
    squares = padded.reshape(rows, factor, cols, factor)
    some = squares != nodata
    count = some.sum((1, 3))
    total = np.where(some, squares, 0).sum((1, 3))
    return np.where(count > 0, total / np.maximum(count, 1), nodata)


def encode_raster(values: np.ndarray, grid: GridSpec, options: TiffOptions, metadata: str = "") -> bytes:
    """A GeoTIFF of one band on `grid`, whose nodata fills what blocks at the edges lack. Overviews follow as images of their own."""
    nodata = -9999.0 if grid.nodata is None else grid.nodata
    dtype = np.dtype(f"<{'f4' if options.dtype == 'float32' else 'u2'}")
    levels = [(1, values)] + [(f, _means(values, f, nodata)) for f in options.overviews]
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    code = int(grid.crs.rsplit(":", 1)[-1])
    link = 4
    for factor, image in levels:
        height, width = image.shape
        down, across = -(-height // options.block), -(-width // options.block)
        offsets, counts = [], []
        for r in range(down):
            for c in range(across):
                block = np.full((options.block, options.block), nodata if dtype.kind == "f" else 0, dtype)
                part = image[r * options.block : (r + 1) * options.block, c * options.block : (c + 1) * options.block]
                block[: part.shape[0], : part.shape[1]] = part
                packed = _pack(block, options)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        out += bytes(len(out) % 2)
        tags: dict[int, tuple[int, list]] = {
            SUBFILE: (LONG, [0 if factor == 1 else 1]), WIDTH: (LONG, [width]), HEIGHT: (LONG, [height]), BITS: (SHORT, [8 * dtype.itemsize]), COMPRESSION: (SHORT, [COMPRESSIONS[options.compress]]),
            PHOTOMETRIC: (SHORT, [1]), SAMPLES: (SHORT, [1]), PLANAR: (SHORT, [1]), PREDICTOR: (SHORT, [options.predictor]), TILE_WIDTH: (SHORT, [options.block]), TILE_HEIGHT: (SHORT, [options.block]),
            TILE_OFFSETS: (LONG, offsets), TILE_COUNTS: (LONG, counts), SAMPLE_FORMAT: (SHORT, [3 if dtype.kind == "f" else 1]), NODATA: (ASCII, [f"{nodata:g}"]),
        }
        if factor == 1:
            tags |= {PIXEL_SCALE: (DOUBLE, [grid.dx, grid.dy, 0.0]), TIE_POINT: (DOUBLE, [0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0]), GEO_KEYS: (SHORT, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, code])}
            if metadata:
                tags[METADATA] = (ASCII, [metadata])
        struct.pack_into("<I", out, link, len(out))
        link = _append_directory(out, tags)
    return bytes(out)


def _append_directory(out: bytearray, tags: dict[int, tuple[int, list]]) -> int:
    """Appends an image directory and the values that do not fit in it; gives the place of the link to the next one."""
    start = len(out)
    out += bytes(2 + 12 * len(tags) + 4)
    struct.pack_into("<H", out, start, len(tags))
    for i, (tag, (kind, values)) in enumerate(sorted(tags.items())):
        raw = values[0].encode("ascii") + b"\0" if kind == ASCII else struct.pack(f"<{len(values)}{KINDS[kind]}", *values)
        count = len(raw) if kind == ASCII else len(values)
        place = start + 2 + 12 * i
        struct.pack_into("<HHI", out, place, tag, kind, count)
        if len(raw) <= 4:
            out[place + 8 : place + 8 + len(raw)] = raw
        else:
            struct.pack_into("<I", out, place + 8, len(out))
            out += raw + bytes(len(raw) % 2)
    return start + 2 + 12 * len(tags)


def byte_order(data: bytes) -> str:
    """'<' or '>': how the numbers of a classic TIFF are stored."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a classic TIFF")
    return "<" if data[:2] == b"II" else ">"


def read_directories(data: bytes) -> list[dict[int, list]]:
    """The tags of every image in a classic TIFF, of either byte order."""
    order = byte_order(data)
    found, at = [], struct.unpack_from(f"{order}I", data, 4)[0]
    while at:
        many = struct.unpack_from(f"{order}H", data, at)[0]
        tags = {}
        for i in range(many):
            place = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, place)
            if kind not in KINDS and kind != ASCII:
                continue
            size = count * (1 if kind == ASCII else struct.calcsize(KINDS[kind]))
            start = place + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, place + 8)[0]
            tags[tag] = [data[start : start + count].rstrip(b"\0").decode("ascii")] if kind == ASCII else list(struct.unpack_from(f"{order}{count}{KINDS[kind]}", data, start))
        found.append(tags)
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * many)[0]
    return found


def read_grid(tags: dict[int, list]) -> GridSpec:
    """The grid of a file's first image."""
    scale, tie = tags[PIXEL_SCALE], tags[TIE_POINT]
    keys = tags.get(GEO_KEYS, [])
    code = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == 3072), 0)
    nodata = float(tags[NODATA][0]) if NODATA in tags else None
    return GridSpec(tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], tags[WIDTH][0], tags[HEIGHT][0], nodata, f"EPSG:{code}")


def read_blocks_of(data: bytes, image: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, values) of each block (tile or strip) of a one-band image, clipped to the image."""
    tags = read_directories(data)[image]
    kinds = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
    dtype = np.dtype(byte_order(data) + kinds[tags.get(SAMPLE_FORMAT, [1])[0], tags[BITS][0]])
    if tags.get(SAMPLES, [1])[0] != 1:
        raise ValueError("only images of one band are read")
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    if TILE_OFFSETS in tags:
        tw, th, offsets, counts = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        tw, th, offsets, counts = width, min(height, tags.get(STRIP_ROWS, [height])[0]), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    across = -(-width // tw)
    for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        row, col = i // across * th, i % across * tw
        block = _unpack(data[offset : offset + count], tags[COMPRESSION][0], tags.get(PREDICTOR, [1])[0], (th, tw), dtype)
        yield row, col, block[: height - row, : width - col]


def encode(cells: DataFrame, grid: GridSpec, options: TiffOptions = TiffOptions(), prefix: str = "tile") -> DataFrame:
    """(name, content): one GeoTIFF for each square of options.tile cells that holds any row of `cells` (grid_row, grid_col, value).

    NULL and missing cells are nodata. A task holds one square at a time.
    """
    grid.check()
    placed = cells.select(F.col("grid_row").cast("int"), F.col("grid_col").cast("int"), F.col("value").cast("double"))
    placed = placed.where(F.col("grid_row").between(0, grid.height - 1) & F.col("grid_col").between(0, grid.width - 1))
    dealt = placed.withColumns({"tile_row": F.floor(F.col("grid_row") / options.tile).cast("int"), "tile_col": F.floor(F.col("grid_col") / options.tile).cast("int")})
    nodata = -9999.0 if grid.nodata is None else grid.nodata

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        r, c = (k.as_py() for k in key)
        top, left = r * options.tile, c * options.tile
        height, width = min(options.tile, grid.height - top), min(options.tile, grid.width - left)
        values = np.full((height, width), nodata)
        filled = rows.column("value").combine_chunks().fill_null(nodata).to_numpy()
        values[rows.column("grid_row").to_numpy() - top, rows.column("grid_col").to_numpy() - left] = filled
        own = GridSpec(grid.x0 + left * grid.dx, grid.y0 - top * grid.dy, grid.dx, grid.dy, width, height, nodata, grid.crs)
        return pa.table({"name": [f"{prefix}_{r:05d}_{c:05d}.tif"], "content": pa.array([encode_raster(values, own, options, AVERAGED if options.overviews else "")], pa.binary())})

    return dealt.groupBy("tile_row", "tile_col").applyInArrow(build, "name string, content binary")


class GeoTiffSource(DataSource):
    """`df.write.format("geotiff").save(folder)`: each row's content as a file of its name, under a path that all nodes share."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    """Files get their names by a rename when they are whole, so that a task that runs twice leaves one file."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")
        if "://" in self.path:
            raise ValueError(f"files are written to a path that all nodes have mounted, not to {path}")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            part = os.path.join(self.path, f".{row['name']}.{os.getpid()}")
            with open(part, "wb") as file:
                file.write(row["content"])
            os.replace(part, os.path.join(self.path, row["name"]))
        return WriterCommitMessage()


def write(files: DataFrame, path: str) -> None:
    """Writes (name, content) rows as files."""
    files.sparkSession.dataSource.register(GeoTiffSource)
    files.write.format("geotiff").mode("append").option("path", path).save()


def read_meta(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, crs, x0, y0, dx, dy, width, height, nodata, images of each file."""
    files = _files(spark, path, recursive)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tags = read_directories(content)
                g = read_grid(tags[0])
                yield pa.RecordBatch.from_pylist([{"path": name, "crs": g.crs, "x0": g.x0, "y0": g.y0, "dx": g.dx, "dy": g.dy, "width": g.width, "height": g.height, "nodata": g.nodata, "images": len(tags)}], _META)

    return files.mapInArrow(work, "path string, crs string, x0 double, y0 double, dx double, dy double, width int, height int, nodata double, images int")


_META = pa.schema([("path", pa.string()), ("crs", pa.string()), *[(n, pa.float64()) for n in ("x0", "y0", "dx", "dy")], ("width", pa.int32()), ("height", pa.int32()), ("nodata", pa.float64()), ("images", pa.int32())])
_BLOCKS = pa.schema([("path", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("dx", pa.float64()), ("dy", pa.float64()), ("row_off", pa.int32()), ("col_off", pa.int32()), ("rows", pa.int32()), ("cols", pa.int32()), ("crs", pa.string()), ("cells", pa.list_(pa.float32()))])


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.tif*").load(path)
    return found.select("path", "content")


def read_blocks(spark: SparkSession, path: str, nodata: float | None = None, recursive: bool = True) -> DataFrame:
    """One row a block: path, x and y of its corner, cell sizes, offsets, sizes, coordinate system, and its cells row by row, nodata as NULL.

    `nodata` overrides what the files declare. Band 1 alone is read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = read_grid(read_directories(content)[0])
                empty = g.nodata if nodata is None else nodata
                for row, col, block in read_blocks_of(content):
                    values = block.astype(np.float32).ravel()
                    hole = ~np.isfinite(values) if empty is None else ~np.isfinite(values) | (values == np.float32(empty))
                    cells = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, mask=hole))
                    rest = [[name], [g.x0 + col * g.dx], [g.y0 - row * g.dy], [g.dx], [g.dy], [row], [col], [block.shape[0]], [block.shape[1]], [g.crs]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(rest, _BLOCKS, strict=False)), cells], schema=_BLOCKS)

    schema = "path string, x double, y double, dx double, dy double, row_off int, col_off int, rows int, cols int, crs string, cells array<float>"
    return _files(spark, path, recursive).mapInArrow(work, schema)


def read_cells(spark: SparkSession, path: str, nodata: float | None = None, grid: GridSpec | None = None) -> DataFrame:
    """path, grid_row, grid_col, value of every cell: on `grid`, or on the grid of all files together (that of the upper-left corner)."""
    blocks = read_blocks(spark, path, nodata)
    if grid is None:
        corner = read_meta(spark, path).agg(F.min("x0").alias("x0"), F.max("y0").alias("y0"), F.min("dx").alias("dx"), F.min("dy").alias("dy")).first()
        grid = GridSpec(corner["x0"], corner["y0"], corner["dx"], corner["dy"], 1, 1)
    spread = blocks.select("path", "x", "y", "dx", "dy", "cols", F.posexplode("cells").alias("place", "value"))
    x = F.col("x") + (F.col("place") % F.col("cols") + 0.5) * F.col("dx")
    y = F.col("y") - (F.floor(F.col("place") / F.col("cols")) + 0.5) * F.col("dy")
    row, col = grid.cell(x, y)
    return spread.select("path", row.alias("grid_row"), col.alias("grid_col"), "value")
