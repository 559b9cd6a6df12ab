"""GeoTIFF files as cell tables: a reader and a writer in numpy, and a Spark data source.

Covers single files, of more than 4 GB too, of whole or floating numbers in
strips or tiles, without compression, with deflate or with LZW, with the
horizontal predictor.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inundata.operators.grid import Grid
from inundata.storage import Scratch

#: Bytes of a strip of cells before compression.
STRIP_BYTES = 4_000_000

#: Fixed values of the format: sizes of field types, and the tags that are read.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048


@dataclass
class Layout:
    """Where the blocks of one image lie, and what its numbers are."""

    grid: Grid
    dtype: np.dtype
    samples: int
    block_h: int
    block_w: int
    across: int
    compression: int
    predictor: int
    planar: bool
    offsets: list[int]
    counts: list[int]


def read_layout(f) -> Layout:
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43  # offsets and counts of 8 bytes
    place, number, entry, room = ("Q", "Q", "HHQ8s", 8) if big else ("I", "H", "HHI4s", 4)
    f.seek(struct.unpack(order + place, head[8:16] if big else head[4:8])[0])
    n = struct.unpack(order + number, f.read(struct.calcsize(order + number)))[0]
    size_of = struct.calcsize(order + entry)
    entries = [struct.unpack(order + entry, f.read(size_of)) for _ in range(n)]
    tags: dict[int, tuple] = {}
    for tag, kind, count, raw in entries:
        size = _SIZES.get(kind, 1) * count
        if size > room:
            f.seek(struct.unpack(order + place, raw)[0])
            raw = f.read(size)
        if kind == 2:
            tags[tag] = (raw[:size].split(b"\0")[0].decode("latin-1"),)
        elif kind in _CODES:
            tags[tag] = struct.unpack(f"{order}{count}{_CODES[kind]}", raw[:size])
    one = lambda t, d=None: tags.get(t, (d,))[0]
    width, height = one(WIDTH), one(HEIGHT)
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    a, b, c0, d, e, f0 = 1.0, 0.0, 0.0, 0.0, -1.0, 0.0
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        a, b, c0, d, e, f0 = m[0], m[1], m[3], m[4], m[5], m[7]
    elif SCALE in tags and TIEPOINT in tags:
        s, t = tags[SCALE], tags[TIEPOINT]
        a, e, c0, f0 = s[0], -s[1], t[3] - t[0] * s[0], t[4] + t[1] * s[1]
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    text = one(NODATA)
    grid = Grid(width, height, a, b, c0, d, e, f0, codes.get(PROJECTED, codes.get(GEOGRAPHIC)), float(text) if text else None)
    tiled = TILE_W in tags
    bw, bh = (one(TILE_W), one(TILE_H)) if tiled else (width, min(height, one(ROWS, height)))
    return Layout(grid, np.dtype(f"{order}{kind}{one(BITS, 8) // 8}"), one(SAMPLES, 1), bh, bw, -(-width // bw), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2, list(tags[TILE_OFFSETS if tiled else OFFSETS]), list(tags[TILE_COUNTS if tiled else COUNTS]))


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out, table, bits, have, width, last = io.BytesIO(), [], 0, 0, 9, b""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(fresh), 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.write(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return out.getvalue()


def read_block(f, lay: Layout, k: int) -> np.ndarray:
    """One block as an array of rows, columns and samples."""
    f.seek(lay.offsets[k])
    raw = f.read(lay.counts[k])
    if lay.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif lay.compression == 5:
        raw = unpack_lzw(raw)
    elif lay.compression != 1:
        raise ValueError(f"compression {lay.compression} is not supported")
    samples = 1 if lay.planar else lay.samples
    row = lay.block_w * samples * lay.dtype.itemsize
    block = np.frombuffer(raw[: len(raw) // row * row], lay.dtype).reshape(-1, lay.block_w, samples)
    if lay.predictor == 2:
        block = np.cumsum(block, axis=1, dtype=block.dtype)
    elif lay.predictor != 1:
        raise ValueError(f"predictor {lay.predictor} is not supported")
    return block


def header(grid: Grid, dtype: np.dtype, bands: int, rows: int, sizes: list[int], big: bool | None = None) -> bytes:
    """All of a file before its blocks: deflated strips of ``rows`` rows, one plane for each band, with these sizes. ``big`` is for files over 4 GB."""
    if big is None:
        big = sum(sizes) + 16 * len(sizes) + 4096 >= 1 << 32
    place, room, entry = ("Q", 8, "<HHQ8s") if big else ("I", 4, "<HHI4s")
    geographic = grid.epsg == 4326
    tags: list[tuple[int, str, tuple]] = [
        (WIDTH, "I", (grid.width,)), (HEIGHT, "I", (grid.height,)), (BITS, "H", (dtype.itemsize * 8,) * bands), (COMPRESSION, "H", (8,)), (262, "H", (1,)), (OFFSETS, place, (0,) * len(sizes)), (SAMPLES, "H", (bands,)),
        (ROWS, "I", (rows,)), (COUNTS, place, tuple(sizes)), (PLANAR, "H", (2,)), (FORMAT, "H", ({"u": 1, "i": 2, "f": 3}[dtype.kind],) * bands),
        (TRANSFORM, "d", (grid.a, grid.b, 0.0, grid.c0, grid.d, grid.e, 0.0, grid.f0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
    ]
    if grid.epsg is not None:
        tags.append((GEO_KEYS, "H", (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, grid.epsg)))
    if grid.nodata is not None:
        tags.append((NODATA, "s", (f"{grid.nodata!r}\0".encode(),)))
    types = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}
    raw = [values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values) for _, code, values in tags]
    directory = 16 if big else 8
    at = directory + (8 if big else 2) + struct.calcsize(entry) * len(tags) + room
    spots = []
    for data in raw:
        spots.append(at)
        at += len(data) + len(data) % 2 if len(data) > room else 0
    starts = np.cumsum([at, *sizes[:-1]]) if sizes else []
    raw[[t for t, _, _ in tags].index(OFFSETS)] = struct.pack(f"<{len(sizes)}{place}", *map(int, starts))
    out = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(tags)) if big else struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    extra = b""
    for (tag, code, values), data, spot in zip(tags, raw, spots):
        long = len(data) > room
        out += struct.pack(entry, tag, types[code], len(data) if code == "s" else len(values), struct.pack("<" + place, spot) if long else data.ljust(room, b"\0"))
        extra += data + b"\0" * (len(data) % 2) if long else b""
    return out + struct.pack("<" + place, 0) + extra


def created(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(name, compression=None)


def write(path: str, bands: np.ndarray, grid: Grid, rows: int = 256, big: bool | None = None) -> None:
    """An array (bands, rows, columns) as a GeoTIFF of deflated strips, one plane for each band."""
    bands = bands if bands.ndim == 3 else bands[None]
    n, h, _ = bands.shape
    dtype = bands.dtype.newbyteorder("<")
    blocks = [zlib.compress(bands[b, i : i + rows].astype(dtype).tobytes()) for b in range(n) for i in range(0, h, rows)]
    with created(path) as f:
        f.write(header(grid, dtype, n, rows, [len(b) for b in blocks], big))
        for b in blocks:
            f.write(b)


def save_cells(cells: DataFrame, grid: Grid, path: str, dtype: str = "float32") -> int:
    """Cells (r, c, v) as a GeoTIFF at ``path`` in a folder that all share; returns the file's bytes.

    Tasks fill and deflate strips of about STRIP_BYTES, which are saved; then
    one writer copies them into the file in their order, one partition at a
    time. Null and missing cells get the grid's nodata value, or else NaN or 0.
    Cells beyond the grid raise ValueError; of cells that repeat a place one is
    written. An empty table gives a file without data.
    """
    kind = np.dtype(dtype).newbyteorder("<")
    none = grid.nodata if grid.nodata is not None else (np.nan if kind.kind == "f" else 0)
    rows, width, height = max(1, min(grid.height, STRIP_BYTES // (grid.width * kind.itemsize))), grid.width, grid.height

    def strip(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        block = np.full((min(rows, height - k * rows), width), none, kind)
        block[pdf["r"].to_numpy() - k * rows, pdf["c"].to_numpy()] = pdf["v"].fillna(none).to_numpy()
        return pd.DataFrame({"strip": [k], "data": [zlib.compress(block.tobytes())]})

    if cells.where(f"r < 0 or c < 0 or r >= {height} or c >= {width}").take(1):
        raise ValueError("there are cells beyond the grid")
    with Scratch(cells.sparkSession) as scratch:
        keyed = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v"))
        made = keyed.groupBy(F.expr(f"r div {rows}").alias("strip")).applyInPandas(strip, "strip int, data binary")
        saved = scratch.save(made, "strips")
        sizes = {r["strip"]: r["n"] for r in saved.select("strip", F.octet_length("data").alias("n")).collect()}  # a number for each strip
        empty = lambda k: zlib.compress(np.full((min(rows, height - k * rows), width), none, kind).tobytes())
        n = -(-height // rows)
        lengths = [sizes[k] if k in sizes else len(empty(k)) for k in range(n)]
        at = 0
        with created(path) as f:
            head = header(grid, kind, 1, rows, lengths)
            f.write(head)
            for r in saved.orderBy("strip").toLocalIterator():
                while at < r["strip"]:
                    f.write(empty(at))
                    at += 1
                f.write(bytes(r["data"]))
                at += 1
            while at < n:
                f.write(empty(at))
                at += 1
    return len(head) + sum(lengths)


def opened(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(name)


def layout(path: str) -> Layout:
    with opened(path) as f:
        return read_layout(f)


def load(spark: SparkSession, path: str, band: int | None = 1, window: tuple[int, int, int, int] | None = None):
    """(cells, grid) of a file: (r, c, v) of one band, or (band, r, c, v) of all with band None. Nodata is null.

    With a window (r0, r1, c0, c1; ends exclusive) or a band only the blocks
    that have some of it are read; places stay those of the whole file.
    """
    grid = layout(path).grid
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("inundata_raster").option("path", path).option("band", "" if band is None else str(band))
    if window:
        reader = reader.option("window", ",".join(map(str, window)))
    df = reader.load()
    return (df.drop("band") if band is not None else df), grid


class _Block(InputPartition):
    def __init__(self, k: int) -> None:
        super().__init__(k)
        self.k = k


class _Reader(DataSourceReader):
    def __init__(self, path: str, band: int | None = None, window: tuple[int, ...] | None = None) -> None:
        self.path, self.band, self.window = path, band, window

    def place(self, lay: Layout, k: int) -> tuple[int, int, int]:
        """Plane, first row and first column of a block."""
        plane, at = divmod(k, lay.across * -(-lay.grid.height // lay.block_h)) if lay.planar else (0, k)
        return plane, at // lay.across * lay.block_h, at % lay.across * lay.block_w

    def wanted(self, lay: Layout, k: int) -> bool:
        plane, r, c = self.place(lay, k)
        if lay.planar and self.band is not None and plane != self.band - 1:
            return False
        r0, r1, c0, c1 = self.window or (0, lay.grid.height, 0, lay.grid.width)
        return r < r1 and r + lay.block_h > r0 and c < c1 and c + lay.block_w > c0

    def partitions(self) -> list[_Block]:
        lay = layout(self.path)
        return [_Block(k) for k in range(len(lay.offsets)) if self.wanted(lay, k)]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no block has any of the window
            return
        with opened(self.path) as f:
            lay = read_layout(f)
            block = read_block(f, lay, partition.k)
        plane, r0, c0 = self.place(lay, partition.k)
        h, w = min(block.shape[0], lay.grid.height - r0), min(lay.block_w, lay.grid.width - c0)
        t, b, l, r = self.window or (0, lay.grid.height, 0, lay.grid.width)
        rows, cols = slice(max(0, t - r0), max(0, min(h, b - r0))), slice(max(0, l - c0), max(0, min(w, r - c0)))
        rr, cc = (x[rows, cols] for x in np.mgrid[r0 : r0 + h, c0 : c0 + w].astype(np.int32))
        for s in range(block.shape[2]):
            if self.band is not None and plane + s + 1 != self.band:
                continue
            v = block[:h, :w, s][rows, cols].astype(float).ravel()
            bad = ~np.isfinite(v)
            if lay.grid.nodata is not None:
                bad |= v == lay.grid.nodata
            yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, plane + s + 1, np.int32)), pa.array(rr.ravel()), pa.array(cc.ravel()), pa.array(v, mask=bad)], ["band", "r", "c", "v"])


class RasterSource(DataSource):
    """``spark.read.format("inundata_raster")``: one partition for each strip or tile of a file."""

    @classmethod
    def name(cls) -> str:
        return "inundata_raster"

    def schema(self) -> str:
        return "band int, r int, c int, v double"

    def reader(self, schema) -> _Reader:
        band, window = self.options.get("band"), self.options.get("window")
        return _Reader(self.options["path"], int(band) if band else None, tuple(map(int, window.split(","))) if window else None)
