"""Pictures of items: from a file's tables to pixels.

An item is decoded by its type: uncompressed samples by their layout
property; a grid from its tiles, an identity from its source, an overlay on
its canvas, each from the items that it refers to as 'dimg', in their order;
other types by a decoder that the caller gives. Then the item's
transformations apply in the order of its properties. All of an item's
sources lie in its file, so a file is decoded in one place, each item once.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.operators.metadata import DERIVED, IMAGES
from pixelloom.plans.limits import LIMITS
from pixelloom.sources import isobmff
from pixelloom.sources.uncompressed import Layout, decode

Planes = list[np.ndarray]

# Interleaves, samplings, sample formats and profiles of the layout property, by number or code.
INTERLEAVES = ("component", "pixel", "mixed", "row", "tile_component")
SAMPLINGS = ("none", "422", "420")
FORMATS = "ufci"
PROFILES = {"rgb3": 3, "rgba": 4, "abgr": 4}
# Flags of the layout property.
LITTLE_ENDIAN, PAD_LSB, BLOCK_LITTLE_ENDIAN, BLOCK_REVERSED = 0x80, 0x40, 0x20, 0x10


def layout_payload(s: Layout) -> bytes:
    """The layout property ('uncC') of a layout."""
    parts = [struct.pack(">HBBB", c, d - 1, FORMATS.index(s.kind(c)), 0) for c, d in enumerate(s.depths)]
    flags = LITTLE_ENDIAN * s.little_endian | PAD_LSB * s.pad_lsb | BLOCK_LITTLE_ENDIAN * s.block_little_endian | BLOCK_REVERSED * s.block_reversed
    tail = struct.pack(">BBBBIIIII", SAMPLINGS.index(s.sampling), INTERLEAVES.index(s.interleave), s.block_size, flags, s.pixel_size, s.row_align, 0, s.tile_cols - 1, s.tile_rows - 1)
    return struct.pack(">I4sI", 0, bytes(4), len(parts)) + b"".join(parts) + tail


def layout_of(payload: bytes, width: int, height: int) -> Layout:
    """The layout that a layout property and the picture's size describe; ValueError if there is none."""
    version, code = payload[0], payload[4:8].decode("latin-1")
    if version == 1:
        if code not in PROFILES:
            raise ValueError(f"unknown profile {code!r}")
        return Layout(width, height, (8,) * PROFILES[code], "pixel")
    n = struct.unpack_from(">I", payload, 8)[0]
    if version or not 0 < n <= LIMITS.components:
        raise ValueError("unsupported layout property")
    parts = [struct.unpack_from(">HBBB", payload, 12 + 5 * k) for k in range(n)]
    sampling, interleave, block, flags, pixel, row, tile, cols, rows = struct.unpack_from(">BBBBIIIII", payload, 12 + 5 * n)
    if sampling >= len(SAMPLINGS) or interleave >= len(INTERLEAVES) or tile > 1 or any(f >= len(FORMATS) or a for _, _, f, a in parts):
        raise ValueError("unsupported layout property")
    return Layout(
        width, height, tuple(d + 1 for _, d, _, _ in parts), INTERLEAVES[interleave], SAMPLINGS[sampling], cols + 1, rows + 1, row, bool(flags & LITTLE_ENDIAN), tuple(FORMATS[f] for _, _, f, _ in parts),
        block, pixel, bool(flags & PAD_LSB), bool(flags & BLOCK_LITTLE_ENDIAN), bool(flags & BLOCK_REVERSED),
    )


def grid_payload(rows: int, cols: int, w: int, h: int) -> bytes:
    wide = max(w, h) > 0xFFFF
    return struct.pack(">BBBB" + ("II" if wide else "HH"), 0, wide, rows - 1, cols - 1, w, h)


def overlay_payload(fill: tuple[int, int, int, int], w: int, h: int, offsets: list[tuple[int, int]]) -> bytes:
    """fill: 16-bit red, green, blue and alpha of the canvas."""
    wide = max(w, h) > 0xFFFF or any(not -32768 <= v <= 32767 for o in offsets for v in o)
    return struct.pack(">BB4H" + ("II" if wide else "HH"), 0, wide, *fill, w, h) + b"".join(struct.pack(">ii" if wide else ">hh", *o) for o in offsets)


def _header(data: bytes, at: int) -> tuple[bool, int, int, int]:
    """Whether fields are wide, two of them at a position, and the position behind."""
    if len(data) < 2 or data[0]:
        raise ValueError("unsupported version")
    wide = bool(data[1] & 1)
    kind = ">II" if wide else ">HH"
    return wide, *struct.unpack_from(kind, data, at), at + struct.calcsize(kind)


def _area(w: int, h: int) -> None:
    if not w or not h or not LIMITS.allows("pixels", w * h):
        raise ValueError("size out of range")


def _turned(planes: Planes, kind: str, payload: bytes) -> Planes:
    """One transformation. ValueError where a clean aperture lies outside of the picture or cuts subsampled planes."""
    if kind == "irot":
        return [np.rot90(p, payload[0] & 3) for p in planes]
    if kind == "imir":
        return [p[:, ::-1] if payload[0] & 1 else p[::-1] for p in planes]
    v = struct.unpack(">IIIIiIiI", payload)
    if not all(v[1::2]):
        raise ValueError("clean aperture without size")
    cw, ch, dx, dy = (Fraction(n, d) for n, d in zip(v[::2], v[1::2], strict=True))
    h, w = planes[0].shape
    near = lambda f: int((f.numerator + f.denominator // 2) / Fraction(f.denominator))
    left, top = int(dx + (w - cw) / 2), near(dy + (h - ch) / 2)
    right, bottom = near(cw - 1 + left), near(ch - 1 + top)
    left, top, right, bottom = max(left, 0), max(top, 0), min(right, w - 1), min(bottom, h - 1)
    if left > right or top > bottom or any(p.shape != (h, w) for p in planes):
        raise ValueError("unsupported clean aperture")
    return [p[top : bottom + 1, left : right + 1] for p in planes]


class _File:
    """A file's items."""

    def __init__(self, data: bytes, decoders: Mapping[str, Callable[[bytes, list[tuple[str, bytes]]], Planes]]):
        boxes = isobmff.scan(data)
        self.decoders = decoders
        self.types = {i: kind for i, kind, *_ in isobmff._items(data, boxes)}
        self.data = dict(isobmff.item_values(data))
        stored = {n: (kind, payload) for n, kind, payload in isobmff._properties(data, boxes)}
        self.properties: dict[int, list[tuple[str, bytes]]] = {}
        for item, _, n, _ in isobmff._item_properties(data, boxes):
            if n in stored:
                self.properties.setdefault(item, []).append(stored[n])
        self.sources: dict[int, list[int]] = {}
        of: dict[int, int] = {}  # only an item's first list counts
        for n, item, kind, _, to in isobmff._item_refs(data, boxes):
            if kind == DERIVED and of.setdefault(item, n) == n:
                self.sources.setdefault(item, []).append(to)
        self.known: dict[int, Planes | str] = {}

    def picture(self, item: int, users: tuple[int, ...] = ()) -> Planes:
        """ValueError says why there is none."""
        if item in users:
            raise ValueError("an item is derived from itself")
        if item not in self.known:
            try:
                planes = self._decoded(item, (*users, item))
                for kind, payload in self.properties.get(item, []):
                    if kind in ("irot", "imir", "clap"):
                        planes = _turned(planes, kind, payload)
                self.known[item] = planes
            except (ValueError, struct.error, IndexError) as e:
                if users:
                    raise ValueError(str(e)) from e
                self.known[item] = str(e)
        got = self.known[item]
        if isinstance(got, str):
            raise ValueError(got)
        return got

    def _decoded(self, item: int, users: tuple[int, ...]) -> Planes:
        kind, data, sources = self.types.get(item), self.data.get(item), self.sources.get(item, [])
        if kind is None:
            raise ValueError(f"no item {item}")
        if kind == "iden":
            if len(sources) != 1:
                raise ValueError("an identity has one source")
            return self.picture(sources[0], users)
        if data is None:
            raise ValueError("no data")
        own = self.properties.get(item, [])
        if kind == "grid":
            return self._grid(data, [self.picture(s, users) for s in sources])
        if kind == "iovl":
            return self._overlay(data, [self.picture(s, users) for s in sources])
        if kind == "unci":
            first = dict(reversed(own))
            if "ispe" not in first or "uncC" not in first:
                raise ValueError("no size or layout")
            w, h = struct.unpack_from(">II", first["ispe"], 4)
            _area(w, h)
            return decode(layout_of(first["uncC"], w, h), data)
        if kind in self.decoders:
            return self.decoders[kind](data, own)
        raise ValueError(f"no decoder for {kind}")

    @staticmethod
    def _grid(data: bytes, tiles: list[Planes]) -> Planes:
        _, w, h, _ = _header(data, 4)
        rows, cols = data[2] + 1, data[3] + 1
        _area(w, h)
        if len(tiles) != rows * cols:
            raise ValueError(f"a grid of {rows} x {cols} has {len(tiles)} tiles")
        th, tw = tiles[0][0].shape
        if any([p.shape for p in t] != [p.shape for p in tiles[0]] for t in tiles) or tw * cols < w or th * rows < h or any(p.shape != (th, tw) for p in tiles[0]):
            raise ValueError("tiles don't fill the grid")
        return [np.concatenate([np.concatenate([t[c] for t in tiles[r * cols : (r + 1) * cols]], 1) for r in range(rows)], 0)[:h, :w] for c in range(len(tiles[0]))]

    @staticmethod
    def _overlay(data: bytes, images: list[Planes]) -> Planes:
        """Red, green and blue of 8 bits; pictures of one plane are grey."""
        wide, w, h, at = _header(data, 10)
        fill = struct.unpack_from(">4H", data, 2)
        _area(w, h)
        size = 8 if wide else 4
        if not images or len(data) - at != size * len(images):
            raise ValueError("an overlay has an offset for each picture")
        canvas = [np.full((h, w), v >> 8, np.uint8) for v in fill[:3]]
        for k, planes in enumerate(images):
            x, y = struct.unpack_from(">ii" if wide else ">hh", data, at + size * k)
            if len(planes) not in (1, 3) or any(p.shape != planes[0].shape or p.dtype != np.uint8 for p in planes):
                raise ValueError("an overlay takes grey or red, green and blue of 8 bits")
            ph, pw = planes[0].shape
            left, top, right, bottom = max(x, 0), max(y, 0), min(x + pw, w), min(y + ph, h)
            if left < right and top < bottom:
                for c in range(3):
                    canvas[c][top:bottom, left:right] = planes[c % len(planes)][top - y : bottom - y, left - x : right - x]
        return canvas


def pictures(contents: DataFrame, decoders: Mapping[str, Callable[[bytes, list[tuple[str, bytes]]], Planes]] | None = None) -> DataFrame:
    """(path, item_id, type, width, height, planes, error) of the items of files (path, content) that are images.

    planes is array<binary>, samples little-endian in as many bytes as their
    kind has; null, with an error, for items that can't be decoded. decoders:
    a function of an item's bytes and properties (type, payload) for each
    further item type. A file whose tables are broken is one row with an error.
    """
    isobmff._prepare(contents.sparkSession)
    own = dict(decoders or {})

    def rows(data: bytes) -> Iterator[tuple]:
        file = _File(data, own)
        for item, kind in file.types.items():
            if kind in IMAGES:
                try:
                    planes = file.picture(item)
                    yield item, kind, planes[0].shape[1], planes[0].shape[0], [np.ascontiguousarray(p, p.dtype.newbyteorder("<")).tobytes() for p in planes], None
                except ValueError as e:
                    yield item, kind, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.string()]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    got = list(rows(content.as_py() or b""))
                except (ValueError, struct.error) as e:
                    got = [(None, None, None, None, None, str(e))]
                cols = list(zip(*got, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(got), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["path", "item_id", "type", "width", "height", "planes", "error"])

    return contents.select("path", "content").mapInArrow(run, "path string, item_id long, type string, width int, height int, planes array<binary>, error string")
