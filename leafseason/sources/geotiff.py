"""Reading and writing of GeoTIFF files with numpy alone.

Understood: TIFF of either byte order (not BigTIFF), strips or tiles, plain or deflated, predictors 1 to 3, bands together or
apart, integers and floats of 8 to 64 bits, a north-up grid given by pixel scale and tie point, nodata, and the number of the
spatial reference. Other files are refused with the reason. Written: one deflated strip for each `ROWS` rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from leafseason.workers import ship

ship(__name__)

#: Tags of TIFF and GeoTIFF, and the keys that hold a spatial reference.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIE, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
GEOGRAPHIC, PROJECTED = 2048, 3072
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}

ROWS = 64


class Raster:
    """A raster in memory, decoded block by block."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        head = bytes(self.data[:8])
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        if not self.order or struct.unpack(self.order + "H", head[2:4])[0] != 42:
            raise ValueError("not a TIFF file, or a BigTIFF")
        self.tags = self._directory(struct.unpack(self.order + "I", head[4:8])[0])
        one = lambda tag, default=None: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, form = one(BITS, 1), one(FORMAT, 1)
        if bits not in (8, 16, 32, 64) or form not in (1, 2, 3):
            raise ValueError(f"samples of {bits} bits in format {form} aren't understood")
        self.dtype = np.dtype(f"{self.order}{' uif'[form]}{bits // 8}")
        self.compression, self.predictor, self.apart = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        if self.compression not in (1, 8, 32946) or self.predictor not in (1, 2, 3):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor} isn't understood")
        said = self.tags.get(NODATA)
        self.nodata = float(said[0].rstrip(b"\0 ").decode()) if said else None
        scale, tie = self.tags.get(SCALE, (1.0, 1.0, 0.0)), self.tags.get(TIE, (0.0,) * 6)
        self.cell = scale[0], scale[1]
        self.origin = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        keys = np.array(self.tags.get(GEO_KEYS, ()), np.int64).reshape(-1, 4)[1:]
        self.epsg = next((int(k[3]) for k in keys if k[0] in (PROJECTED, GEOGRAPHIC) and k[1] == 0), None)

    def _directory(self, at: int) -> dict[int, tuple]:
        tags = {}
        for k in range(struct.unpack_from(self.order + "H", self.data, at)[0]):
            tag, kind, n = struct.unpack_from(self.order + "HHI", self.data, at + 2 + 12 * k)
            if kind not in KINDS:
                continue
            code, size = KINDS[kind]
            place = at + 10 + 12 * k
            if n * size > 4:
                place = struct.unpack_from(self.order + "I", self.data, place)[0]
            tags[tag] = struct.unpack_from(f"{self.order}{n}{code}", self.data, place)
        return tags

    def centre(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and y of the middles of cells."""
        return self.origin[0] + (col + 0.5) * self.cell[0], self.origin[1] - (row + 0.5) * self.cell[1]

    def _decoded(self, start: int, length: int, h: int, w: int, bands: int) -> np.ndarray:
        raw = bytes(self.data[start : start + length])
        raw = raw if self.compression == 1 else zlib.decompress(raw)
        n = h * w * bands * self.dtype.itemsize
        if self.predictor == 3:  # bytes of a row apart, highest first, each the difference to the one `bands` before
            size = self.dtype.itemsize
            parts = np.cumsum(np.frombuffer(raw, np.uint8, n).reshape(h, size * w, bands), axis=1, dtype=np.uint8)
            out = np.ascontiguousarray(parts.reshape(h, size, w * bands).transpose(0, 2, 1)).view(self.dtype.newbyteorder(">"))
            return out.reshape(h, w, bands)
        out = np.frombuffer(raw[:n], self.dtype).reshape(h, w, bands)
        if self.predictor == 2:
            plain = out.astype(self.dtype.newbyteorder("=")).view(f"u{self.dtype.itemsize}")
            out = np.cumsum(plain, axis=1, dtype=plain.dtype).view(self.dtype.newbyteorder("="))
        return out

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, values by band, row and column) of each strip or tile, cut to the raster."""
        tiled = TILES in self.tags
        h = self.tags[TILE_HEIGHT][0] if tiled else min(self.tags.get(STRIP_ROWS, (self.height,))[0], self.height)
        w = self.tags[TILE_WIDTH][0] if tiled else self.width
        starts, sizes = (self.tags[t] for t in ((TILES, TILE_BYTES) if tiled else (STRIPS, STRIP_BYTES)))
        across, down = -(-self.width // w), -(-self.height // h)
        for k in range(across * down):
            top, left = k // across * h, k % across * w
            rows = h if tiled else min(h, self.height - top)
            if self.apart:
                parts = [self._decoded(starts[b * across * down + k], sizes[b * across * down + k], rows, w, 1) for b in range(self.bands)]
                block = np.concatenate(parts, axis=2)
            else:
                block = self._decoded(starts[k], sizes[k], rows, w, self.bands)
            yield top, left, block[: self.height - top, : self.width - left].transpose(2, 0, 1)

    def read(self) -> np.ndarray:
        """All values by band, row and column."""
        out = np.empty((self.bands, self.height, self.width), self.dtype.newbyteorder("="))
        for top, left, block in self.blocks():
            out[:, top : top + block.shape[1], left : left + block.shape[2]] = block
        return out


def encode(values: np.ndarray, x0: float, y0: float, cell: float, nodata: float | None = None, epsg: int | None = None) -> bytes:
    """A GeoTIFF of values (band, row, column); x0 and y0 are the upper left corner."""
    bands, height, width = values.shape
    form = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    little = np.ascontiguousarray(values.transpose(1, 2, 0)).astype(values.dtype.newbyteorder("<"))
    strips = [zlib.compress(little[k : k + ROWS].tobytes(), 6) for k in range(0, height, ROWS)]
    body = b"".join(strips)
    sizes = list(map(len, strips))
    starts = (8 + np.cumsum([0, *sizes[:-1]])).tolist()
    tags: dict[int, tuple[int, list]] = {
        WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [values.dtype.itemsize * 8] * bands), COMPRESSION: (3, [8]), PHOTOMETRIC: (3, [1]), STRIPS: (4, starts), SAMPLES: (3, [bands]),
        STRIP_ROWS: (4, [ROWS]), STRIP_BYTES: (4, sizes), PLANAR: (3, [1]), FORMAT: (3, [form] * bands), SCALE: (12, [cell, cell, 0.0]), TIE: (12, [0.0, 0.0, 0.0, x0, y0, 0.0]),
    }
    if epsg is not None:
        tags[GEO_KEYS] = (3, [1, 1, 0, 2, 1024, 0, 1, 1, PROJECTED, 0, 1, epsg])
    if nodata is not None:
        tags[NODATA] = (2, [f"{nodata:.17g}".encode() + b"\0"])
    at = 8 + len(body) + len(body) % 2
    entries, extra = b"", b""
    for tag, (kind, said) in sorted(tags.items()):
        data = said[0] if kind == 2 else struct.pack(f"<{len(said)}{KINDS[kind][0]}", *said)
        n = len(data) if kind == 2 else len(said)
        if len(data) > 4:
            place = struct.pack("<I", at + 6 + 12 * len(tags) + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, n) + place
    if at + len(entries) + len(extra) >= 1 << 32:
        raise ValueError("too large for one file; write smaller squares")
    return b"II" + struct.pack("<HI", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


