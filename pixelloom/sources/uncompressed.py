"""Uncompressed pictures: packed samples in seven layouts to planes, and back.

Samples are unsigned, of 1 to 16 bits, or byte-aligned of 8 to 64 bits of any
kind, in five interleaves; or unsigned in words of some bytes, a sample a word
(component interleave with a block size) or a pixel a word (pixel interleave
with a pixel size). One numpy pass unpacks a tile; images are independent, so
decoded() and encoded() map a table of them without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.session import ship


@dataclass(frozen=True)
class Layout:
    """What a uncC box says: interleave is component, pixel, mixed, row or tile_component; sampling none, 422 or 420."""

    width: int
    height: int
    depths: tuple[int, ...]
    interleave: str = "component"
    sampling: str = "none"
    tile_cols: int = 1
    tile_rows: int = 1
    row_align: int = 0
    little_endian: bool = False
    kinds: tuple[str, ...] = ()  # u, i, f or c for each component; u if empty
    block_size: int = 0  # bytes of a word, 0 without words
    pixel_size: int = 0  # bytes of a pixel in pixel interleave
    pad_lsb: bool = False  # unused bits of a word are its lowest
    block_little_endian: bool = False
    block_reversed: bool = False  # the first component has a pixel word's lowest bits

    def __post_init__(self):
        if self.interleave not in ("component", "pixel", "mixed", "row", "tile_component"):
            raise ValueError(f"unsupported interleave {self.interleave}")
        if self.width % self.tile_cols or self.height % self.tile_rows:
            raise ValueError("tiles don't divide the image")
        if self.sampling != "none" and self.interleave not in ("component", "mixed", "tile_component"):
            raise ValueError("unsupported sampling")
        if self.word:
            bits = 8 * self.word
            if self.word > 8 or self.sampling != "none" or self.little_endian or any(d > 16 or self.kind(c) != "u" for c, d in enumerate(self.depths)):
                raise ValueError("unsupported block")
            if self.interleave == "component" and not self.pixel_size:
                if any(not bits // 2 < d <= bits for d in self.depths):
                    raise ValueError("a block holds one sample")
            elif self.interleave != "pixel" or not self.pixel_size or self.block_size not in (0, self.pixel_size) or sum(self.depths) > bits:
                raise ValueError("unsupported block")

    @property
    def word(self) -> int:
        """Bytes of a word, 0 without words."""
        return self.block_size or self.pixel_size

    def shifts(self) -> list[int]:
        """How far each component's bits lie from the lowest of its word."""
        if self.interleave == "component":
            return [8 * self.word - d if self.pad_lsb else 0 for d in self.depths]
        # From the low end, or the high one: the components in the order in which they lie there.
        order = list(range(len(self.depths)))
        if not self.block_reversed:
            order.reverse()
        out, at = [0] * len(order), 8 * self.word if self.pad_lsb else 0
        for c in order:
            if self.pad_lsb:
                at -= self.depths[c]
            out[c] = at
            if not self.pad_lsb:
                at += self.depths[c]
        return out

    def plane(self, c: int, w: int, h: int) -> tuple[int, int]:
        """Size of component c in an area of w x h: chroma follows luma rounded up."""
        sub = self.sampling != "none" and c in (1, 2)
        return (-(-w // 2) if sub else w, -(-h // 2) if sub and self.sampling == "420" else h)

    def kind(self, c: int) -> str:
        return self.kinds[c] if self.kinds else "u"

    def dtype(self, c: int) -> np.dtype:
        d, k = self.depths[c], self.kind(c)
        if k == "u" and d not in (8, 16, 32, 64):
            return np.dtype(np.uint16 if d <= 16 else np.uint32)
        return np.dtype(f"{k}{d // 8}")


class _Bits:
    """A tile's bits and a position in them."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int, depth: int) -> np.ndarray:
        """n samples of one depth, highest bit first."""
        end = self.at + n * depth
        if end > 8 * len(self.data):
            raise ValueError("end of data")
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8)[self.at // 8 : -(-end // 8)])[self.at % 8 :][: n * depth]
        self.at = end
        return bits.reshape(n, depth).astype(np.uint64) @ (np.uint64(1) << np.arange(depth, dtype=np.uint64)[::-1])

    def align(self, size: int) -> None:
        """To the next byte, or multiple of size bytes."""
        unit = 8 * max(1, size)
        self.at = -(-self.at // unit) * unit


def _aligned(layout: Layout, c: int) -> bool:
    return layout.depths[c] in (8, 16, 32, 64, 128) and (layout.kind(c) != "u" or layout.depths[c] > 16 or layout.little_endian)


def _row_bytes(layout: Layout, w: int) -> int:
    """Bytes of a row of w words."""
    unit = max(1, layout.row_align)
    return -(-w * layout.word // unit) * unit


def _word_tile(layout: Layout, data: bytes, w: int, h: int) -> tuple[list[np.ndarray], int]:
    """_tile for layouts of words."""
    alone, step = layout.interleave == "component", _row_bytes(layout, w)
    used = step * h * (len(layout.depths) if alone else 1)
    if used > len(data):
        raise ValueError("end of data")
    rows = np.frombuffer(data, np.uint8, used).reshape(-1, h, step)[:, :, : w * layout.word].reshape(-1, h, w, layout.word)
    place = np.arange(layout.word, dtype=np.uint64) * np.uint64(8)
    words = (rows.astype(np.uint64) << (place if layout.block_little_endian else place[::-1])).sum(3, dtype=np.uint64)
    planes = [((words[c if alone else 0] >> np.uint64(s)) & np.uint64((1 << d) - 1)).astype(layout.dtype(c)) for c, (d, s) in enumerate(zip(layout.depths, layout.shifts(), strict=True))]
    return planes, used


def _word_bytes(layout: Layout, parts: list[np.ndarray]) -> bytes:
    """The bytes that _word_tile reads."""
    shifted = [p.astype(np.uint64) << np.uint64(s) for p, s in zip(parts, layout.shifts(), strict=True)]
    words = np.stack(shifted) if layout.interleave == "component" else np.bitwise_or.reduce(shifted)[None]
    place = np.arange(layout.word, dtype=np.uint64) * np.uint64(8)
    rows = (words[..., None] >> (place if layout.block_little_endian else place[::-1])).astype(np.uint8).reshape(*words.shape[:2], -1)
    return np.pad(rows, ((0, 0), (0, 0), (0, _row_bytes(layout, words.shape[2]) - rows.shape[2]))).tobytes()


def _tile(layout: Layout, data: bytes, w: int, h: int) -> tuple[list[np.ndarray], int]:
    """Planes of a tile and the bytes that it takes."""
    if layout.word:
        return _word_tile(layout, data, w, h)
    n = len(layout.depths)
    sizes = [layout.plane(c, w, h) for c in range(n)]
    out = [np.zeros((sh, sw), layout.dtype(c)) for c, (sw, sh) in enumerate(sizes)]
    bits = _Bits(data)
    if layout.interleave in ("component", "tile_component"):
        for c, (sw, sh) in enumerate(sizes):
            if _aligned(layout, c):
                kind = layout.dtype(c).newbyteorder("<" if layout.little_endian else ">")
                size = sw * sh * kind.itemsize
                start = bits.at // 8
                if start + size > len(data):
                    raise ValueError("end of data")
                out[c] = np.frombuffer(data, kind, sw * sh, start).reshape(sh, sw).astype(layout.dtype(c))
                bits.at += 8 * size
                continue
            for y in range(sh):
                out[c][y] = bits.take(sw, layout.depths[c])
                bits.align(layout.row_align)
    elif layout.interleave == "pixel":
        total = sum(layout.depths)
        for y in range(h):
            row = bits.take(w * total, 1).astype(np.uint8).reshape(w, total)
            at = 0
            for c, d in enumerate(layout.depths):
                out[c][y] = row[:, at : at + d].astype(np.uint64) @ (np.uint64(1) << np.arange(d, dtype=np.uint64)[::-1])
                at += d
            bits.align(layout.row_align)
    elif layout.interleave == "row":
        for y in range(h):
            for c, d in enumerate(layout.depths):
                out[c][y] = bits.take(w, d)
                bits.align(layout.row_align)
    else:  # mixed: luma as a plane, the two chroma components sample by sample
        for c in range(n):
            if c == 2:
                continue
            sw, sh = sizes[c]
            for y in range(sh):
                if c == 1:
                    pair = bits.take(2 * sw, layout.depths[1])
                    out[1][y], out[2][y] = pair[::2], pair[1::2]
                else:
                    out[c][y] = bits.take(sw, layout.depths[c])
                bits.align(layout.row_align)
    bits.align(1)
    return out, bits.at // 8


def decode(layout: Layout, data: bytes) -> list[np.ndarray]:
    """The planes of a picture, one (h, w) array for each component."""
    w, h = layout.width // layout.tile_cols, layout.height // layout.tile_rows
    rows, at = [], 0
    for _ in range(layout.tile_rows):
        row = []
        for _ in range(layout.tile_cols):
            planes, used = _tile(layout, data[at:], w, h)
            row.append(planes)
            at += used
        rows.append([np.concatenate([t[c] for t in row], 1) for c in range(len(layout.depths))])
    return [np.concatenate([r[c] for r in rows], 0) for c in range(len(layout.depths))]


def _packed(values: np.ndarray, depth: int) -> np.ndarray:
    """Bits of samples, highest first, along a new last axis."""
    return ((values.astype(np.uint64)[..., None] >> np.arange(depth, dtype=np.uint64)[::-1]) & np.uint64(1)).astype(np.uint8)


def _row(bits: np.ndarray, align: int) -> bytes:
    data = np.packbits(bits.ravel()).tobytes()
    return data + bytes(-len(data) % max(1, align))


def encode(layout: Layout, planes: list[np.ndarray]) -> bytes:
    """The bytes that decode() reads."""
    n, out = len(layout.depths), []
    tw, th = layout.width // layout.tile_cols, layout.height // layout.tile_rows
    for ty in range(layout.tile_rows):
        for tx in range(layout.tile_cols):
            parts = []
            for c in range(n):
                sw, sh = layout.plane(c, tw, th)
                parts.append(planes[c][ty * sh : (ty + 1) * sh, tx * sw : (tx + 1) * sw])
            if layout.word:
                out.append(_word_bytes(layout, parts))
            elif layout.interleave in ("component", "tile_component"):
                for c, p in enumerate(parts):
                    if _aligned(layout, c):
                        out.append(p.astype(layout.dtype(c).newbyteorder("<" if layout.little_endian else ">")).tobytes())
                    else:
                        out += [_row(_packed(r, layout.depths[c]), layout.row_align) for r in p]
            elif layout.interleave == "pixel":
                for y in range(th):
                    out.append(_row(np.concatenate([_packed(p[y], d) for p, d in zip(parts, layout.depths, strict=True)], 1), layout.row_align))
            elif layout.interleave == "row":
                for y in range(th):
                    out += [_row(_packed(p[y], d), layout.row_align) for p, d in zip(parts, layout.depths, strict=True)]
            else:
                out += [_row(_packed(r, layout.depths[0]), layout.row_align) for r in parts[0]]
                out += [_row(_packed(np.stack([a, b], 1), layout.depths[1]), layout.row_align) for a, b in zip(parts[1], parts[2], strict=True)]
                for c in range(3, n):
                    out += [_row(_packed(r, layout.depths[c]), layout.row_align) for r in parts[c]]
    return b"".join(out)


def decoded(images: DataFrame, layout: Layout, key: str, data: str = "data") -> DataFrame:
    """(key, component, width, height, plane, error) of pictures of one layout with integer samples: a row for each component, plane array<bigint> in raster order. Null or short data are one row with an error."""
    ship(images.sparkSession)
    if any(layout.kind(c) not in "ui" for c in range(len(layout.depths))):
        raise ValueError("samples that aren't integers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            for i, x in enumerate(b.column(1)):
                try:
                    got = [(c, p.shape[1], p.shape[0], p.ravel().astype(np.int64), None) for c, p in enumerate(decode(layout, x.as_py() or b""))]
                except ValueError as e:
                    got = [(None, None, None, None, str(e))]
                take += [i] * len(got)
                rows += got
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, "component", "width", "height", "plane", "error"])

    return images.select(key, data).mapInArrow(run, f"`{key}` {images.schema[key].dataType.simpleString()}, component int, width int, height int, plane array<bigint>, error string")


def encoded(images: DataFrame, layout: Layout, key: str, planes: str = "planes", data: str = "data") -> DataFrame:
    """(key, data): the bytes of pictures whose planes, array<array<bigint>>, are the components in raster order; null where those are null, of another size or number."""
    ship(images.sparkSession)
    sizes = [layout.plane(c, layout.width, layout.height) for c in range(len(layout.depths))]

    def one(x: list | None) -> bytes | None:
        if x is None or [len(p or []) for p in x] != [w * h for w, h in sizes] or any(v is None for p in x for v in p):
            return None
        return encode(layout, [np.array(p, np.int64).reshape(h, w).astype(layout.dtype(c)) for c, (p, (w, h)) in enumerate(zip(x, sizes, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x.as_py()) for x in b.column(1)], pa.binary())], [key, data])

    return images.select(key, planes).mapInArrow(run, f"`{key}` {images.schema[key].dataType.simpleString()}, `{data}` binary")
