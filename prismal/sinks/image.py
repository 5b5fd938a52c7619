"""PNG, BMP, GIF, JPEG, WBMP and GeoTIFF images. Pixels are computed on the executors; one image, of a checked size, is put together on the driver."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dataset import FDataset
from ..functions import image as im

#: Pixels of an image on the driver at most.
MAX_PIXELS = 64_000_000


def _size(ds: FDataset) -> tuple[int, int]:
    """Distinct values of both coordinates, if an image of as many pixels can be held."""
    counts = ds.df.agg(*[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(ds.domain)]).first()
    if counts["n0"] * counts["n1"] > MAX_PIXELS:
        raise ValueError(f"{counts['n0']} x {counts['n1']} pixels; {MAX_PIXELS} are the most of one image, see tiles()")
    return counts["n0"], counts["n1"]


def grid(ds: FDataset, fill: float = 0.0) -> DataFrame:
    """Every (first, second) coordinate pair of the samples' distinct values, with `fill` where there is no sample or NaN.

    These are the pixels of one image, whose number is checked here.
    """
    _size(ds)
    x, y = ds.domain
    cells = ds.df.select(x).distinct().crossJoin(ds.df.select(y).distinct())
    full = cells.join(ds.df, [x, y], "left")
    return full.select(x, y, *[F.coalesce(im.clean(F.col(c).cast("double")), F.lit(fill)).alias(c) for c in ds.range])


def tiles(ds: FDataset, size: int = 1024) -> DataFrame:
    """(tile_x, tile_y) -> png of an image of any size, from integer coordinates and levels 0..255; missing pixels are black. A task makes a tile."""
    x, y = ds.domain
    keyed = ds.df.select(F.floor(F.col(x) / size).alias("tile_x"), F.floor(F.col(y) / size).alias("tile_y"), F.col(x).alias("x"), F.col(y).alias("y"), *[F.col(c).alias(n) for c, n in zip(ds.range, "rgb", strict=True)])

    def draw(key, rows):
        import pandas as pd

        data = np.zeros((size, size, 3), np.uint8)
        data[size - 1 - rows.y.to_numpy(np.int64) % size, rows.x.to_numpy(np.int64) % size] = rows[["r", "g", "b"]].to_numpy().astype(np.uint8)
        return pd.DataFrame([(*key, png(data))], columns=["tile_x", "tile_y", "png"])

    return keyed.groupBy("tile_x", "tile_y").applyInPandas(draw, "tile_x long, tile_y long, png binary")


def levels(ds: FDataset, stretch: float | None = 0.03, whole: bool = True) -> DataFrame:
    """(x, y, r, g, b) in 0..255: each channel by a percentile stretch, or by its least and largest value; then as levels of 0..1.

    Of every pixel of the image, as grid() gives them; or, unless it is to be whole, of the samples alone, of which there may be any number.
    """
    full = grid(ds) if whole else ds.df.select(*ds.domain, *[F.coalesce(im.clean(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in ds.range])
    if stretch is not None:
        full = im.with_stretch(full, ds.range, stretch)
        return full.select(*ds.domain, *[im.to_level(F.col(c), 0.0, 1.0).alias(n) for c, n in zip(ds.range, "rgb", strict=True)])
    edges = ds.df.agg(*[f(im.clean(F.col(c))).alias(f"_{c}_{n}") for c in ds.range for n, f in (("low", F.min), ("high", F.max))])
    full = full.crossJoin(F.broadcast(edges))  # one row
    return full.select(*ds.domain, *[im.to_level(F.col(c), F.col(f"_{c}_low"), F.col(f"_{c}_high")).alias(n) for c, n in zip(ds.range, "rgb", strict=True)])


def _placed(rows, domain: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct coordinates of a pandas frame's samples, and an image of these with the samples' bytes in their places; missing pixels are black."""
    (first, i), (second, j) = (np.unique(rows[c].to_numpy(), return_inverse=True) for c in domain)
    data = np.zeros((len(first), len(second), values.shape[1]), np.uint8)
    data[i, j] = values
    return first, second, data


def packed(ds: FDataset) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both coordinates' values, and first x second x 3 bytes of (a, b) -> packed colour."""
    a, b = ds.domain
    _size(ds)
    rows = ds.df.select(a, b, F.coalesce(F.col(ds.range[0]), F.lit(0)).alias("c")).dropna(subset=[a, b]).toPandas()
    c = rows.c.to_numpy(np.int64) & 0xFFFFFFFF
    return _placed(rows, [a, b], np.stack([c >> 16 & 255, c >> 8 & 255, c & 255], 1).astype(np.uint8))


def pixels(ds: FDataset) -> np.ndarray:
    """rows x columns x 3 bytes: x from left to right, y from the top down. A single range column is a packed colour, in sample order."""
    if ds.arity != 2 or len(ds.range) not in (1, 3):
        raise ValueError("an image is (a, b) -> colour or (a, b) -> (r, g, b)")
    a, b = ds.domain
    if len(ds.range) == 1:
        return packed(ds)[2]
    width, height = _size(ds)
    rows = levels(ds).toPandas().sort_values([b, a], ascending=[False, True])
    return rows[["r", "g", "b"]].to_numpy().astype(np.uint8).reshape(height, width, 3)


def png(data: np.ndarray) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = data.shape[:2]
    lines = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def bmp(data: np.ndarray) -> bytes:
    h, w = data.shape[:2]
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(row[:, ::-1].tobytes() + pad for row in data[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def gif(data: np.ndarray) -> bytes:
    """In a palette of 6 x 7 x 6 colours. Codes aren't chained: the table is cleared before it grows past nine bits."""
    h, w = data.shape[:2]
    steps = (6, 7, 6)
    r, g, b = (np.rint(data[..., i].astype(float) * (n - 1) / 255).astype(int) for i, n in enumerate(steps))
    palette = bytes(round(255 * v / (n - 1)) for i in range(6) for j in range(7) for k in range(6) for v, n in zip((i, j, k), steps, strict=True)) + bytes(3 * 4)
    pixels = ((r * 7 + g) * 6 + b).reshape(-1)
    codes = np.concatenate([np.concatenate([[256], pixels[at : at + 250]]) for at in range(0, len(pixels), 250)] + [[257]])
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :9].reshape(-1)
    packed = np.packbits(bits, bitorder="little").tobytes()
    blocks = b"".join(bytes([len(part)]) + part for part in (packed[at : at + 255] for at in range(0, len(packed), 255)))
    return b"GIF87a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + palette + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b"\0;"


def _bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lowest `lengths` bits of values, one after the other, highest first."""
    places = np.arange(31, -1, -1)
    return ((values[:, None] >> places) & 1)[places < lengths[:, None]].astype(np.uint8)


def jpeg(data: np.ndarray) -> bytes:
    """Baseline, full colour resolution. Codes of equal length, eight bits for runs and four for averages, need no tables of frequencies."""
    h, w = data.shape[:2]
    padded = np.pad(data.astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    luma = padded @ [0.299, 0.587, 0.114]
    planes = np.stack([luma - 128, (padded[..., 2] - luma) / 1.772, (padded[..., 0] - luma) / 1.402])
    blocks = planes.reshape(3, planes.shape[1] // 8, 8, planes.shape[2] // 8, 8).transpose(1, 3, 0, 2, 4).reshape(-1, 3, 8, 8)
    u = np.arange(8)
    cosine = np.cos((2 * u + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    steps = 2 + u + u[:, None]
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    found = np.rint(cosine @ blocks @ cosine.T / steps).astype(int).reshape(-1, 3, 64)[:, :, zigzag]
    symbols = [0x00, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 11)]]
    code = {symbol: i for i, symbol in enumerate(symbols)}
    values, lengths = [], []

    def put(prefix: int, width: int, v: int, size: int) -> None:
        values.append(prefix << size | (v if v > 0 else v + (1 << size) - 1) if size else prefix)
        lengths.append(width + size)

    last = [0, 0, 0]
    for block in found:
        for k, own in enumerate(block):
            first = int(own[0]) - last[k]
            last[k] = int(own[0])
            size = abs(first).bit_length()
            put(size, 4, first, size)
            at = 0
            for i in np.flatnonzero(own[1:]).tolist():
                for _ in range((i - at) // 16):
                    put(code[0xF0], 8, 0, 0)
                v = int(own[i + 1])
                put(code[(i - at) % 16 << 4 | abs(v).bit_length()], 8, v, abs(v).bit_length())
                at = i + 1
            if at < 63:
                put(code[0x00], 8, 0, 0)
    bits = _bits(np.array(values, np.int64), np.array(lengths))
    body = np.packbits(np.append(bits, np.ones(-len(bits) % 8, np.uint8))).tobytes().replace(b"\xff", b"\xff\0")

    def part(marker: int, content: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(content) + 2) + content

    table = lambda kind, width, all: bytes([kind]) + bytes(len(all) if i == width else 0 for i in range(1, 17)) + bytes(all)
    head = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + bytes(int(steps.reshape(-1)[i]) for i in zigzag))
    head += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([k, 0x11, 0]) for k in (1, 2, 3)))
    head += part(0xC4, table(0x00, 4, list(range(12)))) + part(0xC4, table(0x10, 8, symbols))
    return head + part(0xDA, b"\3" + b"".join(bytes([k, 0]) for k in (1, 2, 3)) + b"\0\x3f\0") + body + b"\xff\xd9"


def wbmp(data: np.ndarray) -> bytes:
    """Black and white, by brightness."""

    def number(n: int) -> bytes:
        out = [n & 127]
        while n := n >> 7:
            out.append(n & 127 | 128)
        return bytes(reversed(out))

    white = data.astype(int).sum(2) >= 3 * 128
    return b"\0\0" + number(data.shape[1]) + number(data.shape[0]) + np.packbits(white, axis=1).tobytes()


def encode(ds: FDataset, format: str = "png") -> bytes:
    makers = {"png": png, "bmp": bmp, "gif": gif, "jpg": jpeg, "jpeg": jpeg, "wbmp": wbmp}
    if format not in makers:
        raise ValueError(f"formats are {sorted(makers)}")
    return makers[format](pixels(ds))


def write(ds: FDataset, path: str) -> None:
    """By the suffix of the path, on the driver."""
    with open(path, "wb") as f:
        f.write(encode(ds, path.rpartition(".")[2].lower()))


def geo_extent(ds: FDataset) -> DataFrame:
    """One row: rows, cols, pixel sizes and the outer edges of (lat, lon) samples; a single row or column has the other's size."""
    lat, lon = (F.col(c) for c in ds.domain)
    found = ds.df.agg(F.count_distinct(lat).alias("rows"), F.count_distinct(lon).alias("cols"), F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))
    dy = (F.col("north") - F.col("south")) / F.nullif(F.col("rows") - 1, F.lit(0))
    dx = (F.col("east") - F.col("west")) / F.nullif(F.col("cols") - 1, F.lit(0))
    found = found.withColumn("dy", F.coalesce(dy, dx)).withColumn("dx", F.coalesce(dx, dy))
    edges = [(F.col(a) + s * F.col(d) / 2).alias(n) for a, s, d, n in (("west", -1, "dx", "min_lon"), ("south", -1, "dy", "min_lat"), ("east", 1, "dx", "max_lon"), ("north", 1, "dy", "max_lat"))]
    return found.select("rows", "cols", "dx", "dy", *edges)


def geotiff(ds: FDataset) -> bytes:
    """(lat, lon) -> (r, g, b) bytes in geographic coordinates, north up, uncompressed; missing pixels are black."""
    about = geo_extent(ds).first()
    if about["rows"] * about["cols"] < 2 or about["dx"] is None:
        raise ValueError("two samples at least")
    if about["rows"] * about["cols"] > MAX_PIXELS:
        raise ValueError(f"{MAX_PIXELS} pixels are the most")
    lat, lon = ds.domain
    rows = ds.df.select(lat, lon, *ds.range).dropna(subset=[lat, lon]).toPandas()
    data = _placed(rows, [lat, lon], (rows[ds.range].to_numpy().astype(np.int64) & 255).astype(np.uint8))[2][::-1].tobytes()
    h, w = about["rows"], about["cols"]
    keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    scale, tie = struct.pack("<3d", about["dx"], about["dy"], 0.0), struct.pack("<6d", 0, 0, 0, about["min_lon"], about["max_lat"], 0)
    tags = [(256, 4, 1, h and w), (257, 4, 1, h), (258, 3, 3, struct.pack("<3H", 8, 8, 8)), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, None), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(data)), (284, 3, 1, 1), (33550, 12, 3, scale), (33922, 12, 6, tie), (34735, 3, 16, keys)]
    at = 8 + 2 + 12 * len(tags) + 4
    extra = b""
    entries = b""
    start = at + sum(len(v) + len(v) % 2 for *_, v in tags if isinstance(v, bytes))
    for tag, kind, n, value in tags:
        if isinstance(value, bytes):
            entries += struct.pack("<HHII", tag, kind, n, at + len(extra))
            extra += value + b"\0" * (len(value) % 2)
        else:
            v = start if value is None else value
            entries += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", v, 0) if kind == 3 else struct.pack("<I", v))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra + data


def write_geotiff(ds: FDataset, path: str) -> None:
    with open(path, "wb") as f:
        f.write(geotiff(ds))
