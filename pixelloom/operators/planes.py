"""Pixel planes as arrays: every operator is one expression over a row's own array.

A plane is an array<int> in row-major order with its width and height. All
operators are `transform` over an index sequence, so an image is never
exploded, joined or shuffled: a table of any number of images is mapped in one
stage. Sizes are Python ints or integer columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Size = int | Column


def _c(x: Size) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it: functions of arrays evaluate outer expressions for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(f):
    """f with its first argument bound by let, so operators can be nested at the cost of their sum."""

    @functools.wraps(f)
    def bound(data: Column, *args, **kwargs) -> Column:
        return let(data, lambda d: f(d, *args, **kwargs))

    return bound


def div(a: Column, b: Size) -> Column:
    """Integer division of non-negative numbers."""
    return F.floor(a / _c(b)).cast("int")


def at(data: Column, w: Size, x: Column, y: Column) -> Column:
    return F.get(data, (y * _c(w) + x).cast("int"))


def build(w: Size, h: Size, pixel: Callable[[Column, Column], Column]) -> Column:
    """The plane of w x h whose value at (x, y) is pixel(x, y)."""
    w, h = _c(w), _c(h)
    index = F.when((w > 0) & (h > 0), F.sequence(F.lit(0), (w * h - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: pixel((i % w).cast("int"), div(i, w)))


@once
def gather(data: Column, w: Size, w2: Size, h2: Size, source: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    return build(w2, h2, lambda x, y: at(data, w, *source(x, y)))


def filled(w: Size, h: Size, value: Size) -> Column:
    return build(w, h, lambda x, y: _c(value).cast("int"))


def crop(data: Column, w: Size, left: Size, top: Size, right: Size, bottom: Size) -> Column:
    """The rectangle whose right and bottom edges are inclusive."""
    return gather(data, w, _c(right) - _c(left) + 1, _c(bottom) - _c(top) + 1, lambda x, y: (x + _c(left), y + _c(top)))


def clamped_area(data: Column, w: Size, h: Size, x0: Size, y0: Size, w2: Size, h2: Size) -> Column:
    """An area that may reach beyond the plane; there the nearest edge pixel repeats."""
    inside = lambda v, n: F.greatest(F.lit(0), F.least(v, _c(n) - 1))
    return gather(data, w, w2, h2, lambda x, y: (inside(x + _c(x0), w), inside(y + _c(y0), h)))


def rotate_ccw(data: Column, w: Size, h: Size, angle: int) -> Column:
    """Counter-clockwise by 0, 90, 180 or 270 degrees; width and height swap at 90 and 270."""
    w, h = _c(w), _c(h)
    if angle % 360 == 0:
        return data
    if angle % 360 == 180:
        return gather(data, w, w, h, lambda x, y: (w - 1 - x, h - 1 - y))
    if angle % 360 == 90:
        return gather(data, w, h, w, lambda x, y: (w - 1 - y, x))
    if angle % 360 == 270:
        return gather(data, w, h, w, lambda x, y: (y, h - 1 - x))
    raise ValueError(f"unsupported angle {angle}")


def mirror(data: Column, w: Size, h: Size, horizontal: bool) -> Column:
    w, h = _c(w), _c(h)
    return gather(data, w, w, h, (lambda x, y: (w - 1 - x, y)) if horizontal else (lambda x, y: (x, h - 1 - y)))


def scale_nearest(data: Column, w: Size, h: Size, w2: Size, h2: Size) -> Column:
    return gather(data, w, w2, h2, lambda x, y: (div(x * _c(w), w2), div(y * _c(h), h2)))


def pad_edge(data: Column, w: Size, h: Size, w2: Size, h2: Size) -> Column:
    return gather(data, w, w2, h2, lambda x, y: (F.least(x, _c(w) - 1), F.least(y, _c(h) - 1)))


@once
def pad_value(data: Column, w: Size, h: Size, w2: Size, h2: Size, value: int = 0) -> Column:
    return build(w2, h2, lambda x, y: F.when((x < _c(w)) & (y < _c(h)), at(data, w, x, y)).otherwise(F.lit(value)))


def paste(canvas: Column, w: Size, h: Size, tile: Column, tw: Size, th: Size, x0: Size, y0: Size) -> Column:
    """A tile on a canvas at (x0, y0), clipped to the canvas; the position may be negative."""
    inside = lambda x, y: (x >= _c(x0)) & (x < _c(x0) + _c(tw)) & (y >= _c(y0)) & (y < _c(y0) + _c(th))
    return let(canvas, lambda c: let(tile, lambda t: build(w, h, lambda x, y: F.when(inside(x, y), at(t, tw, x - _c(x0), y - _c(y0))).otherwise(at(c, w, x, y)))))


def overlay(canvas: Column, w: Size, h: Size, image: Column, alpha: Column | None, iw: Size, ih: Size, x0: Size, y0: Size) -> Column:
    """8-bit image over canvas, blended by (s * a + d * (255 - a)) div 255; clipped by intersection, at any offset."""

    def pixel(image: Column, alpha: Column | None, canvas: Column, x: Column, y: Column) -> Column:
        inside = (x >= _c(x0)) & (x < _c(x0) + _c(iw)) & (y >= _c(y0)) & (y < _c(y0) + _c(ih))
        s, d = at(image, iw, x - _c(x0), y - _c(y0)), at(canvas, w, x, y)
        if alpha is None:
            return F.when(inside, s).otherwise(d)
        a = at(alpha, iw, x - _c(x0), y - _c(y0))
        return F.when(inside, div(s * a + d * (255 - a), 255)).otherwise(d)

    drawn = lambda c, i, a: build(w, h, lambda x, y: pixel(i, a, c, x, y))
    return let(canvas, lambda c: let(image, lambda i: drawn(c, i, None) if alpha is None else let(alpha, lambda a: drawn(c, i, a))))


@once
def compose_grid(tiles: Column, rows: int, cols: int, tw: Size, th: Size, w: Size, h: Size, missing: int = 0) -> Column:
    """An array of tile planes in row order as one plane of w x h; null tiles are filled."""

    def pixel(x: Column, y: Column) -> Column:
        tile = F.get(tiles, div(y, th) * cols + div(x, tw))
        return F.coalesce(at(tile, tw, (x % _c(tw)).cast("int"), (y % _c(th)).cast("int")), F.lit(missing))

    return build(w, h, pixel)


def half(n: Size) -> Column:
    """The size of a subsampled plane: rounded up."""
    return div(_c(n) + 1, 2)


@once
def average_420(data: Column, w: Size, h: Size) -> Column:
    """Means of 2 x 2 blocks, rounded; blocks at odd edges hold fewer."""
    w, h = _c(w), _c(h)

    def pixel(x: Column, y: Column) -> Column:
        right, below = 2 * x + 1 < w, 2 * y + 1 < h
        n = F.when(right, 2).otherwise(1) * F.when(below, 2).otherwise(1)
        part = lambda dx, dy: at(data, w, 2 * x + dx, 2 * y + dy)
        total = part(0, 0) + F.when(right, part(1, 0)).otherwise(0) + F.when(below, part(0, 1)).otherwise(0) + F.when(right & below, part(1, 1)).otherwise(0)
        return div(total + div(n, 2), n)

    return build(half(w), half(h), pixel)


@once
def average_422(data: Column, w: Size, h: Size) -> Column:
    """Means of horizontal pairs, rounded; a last odd pixel stays."""
    w = _c(w)
    pair = lambda x, y: div(at(data, w, 2 * x, y) + at(data, w, 2 * x + 1, y) + 1, 2)
    return build(half(w), h, lambda x, y: F.when(2 * x + 1 < w, pair(x, y)).otherwise(at(data, w, 2 * x, y)))


@once
def bilinear_420(data: Column, w: Size, h: Size) -> Column:
    """A half-size chroma plane at full size w x h: weights 9 3 3 1 inside, 3 1 along borders, corners copied."""
    w, h, cw, ch = _c(w), _c(h), half(w), half(h)

    def pixel(x: Column, y: Column) -> Column:
        # The nearer chroma sample, and its neighbour on the other side of the pixel, clamped to the plane.
        nx, ny = div(x, 2), div(y, 2)
        ox = F.greatest(F.lit(0), F.least(nx + F.when(x % 2 == 1, 1).otherwise(-1), cw - 1))
        oy = F.greatest(F.lit(0), F.least(ny + F.when(y % 2 == 1, 1).otherwise(-1), ch - 1))
        a, b, c, d = at(data, cw, nx, ny), at(data, cw, ox, ny), at(data, cw, nx, oy), at(data, cw, ox, oy)
        return (
            F.when((ox == nx) & (oy == ny), a)
            .when(oy == ny, div(3 * a + b + 2, 4))
            .when(ox == nx, div(3 * a + c + 2, 4))
            .otherwise(div(9 * a + 3 * b + 3 * c + d + 8, 16))
        )

    return build(w, h, pixel)


@once
def bilinear_422(data: Column, w: Size, h: Size) -> Column:
    """A chroma plane of half width at full width: weights 3 1, borders copied."""
    w, cw = _c(w), half(w)

    def pixel(x: Column, y: Column) -> Column:
        nx = div(x, 2)
        ox = F.greatest(F.lit(0), F.least(nx + F.when(x % 2 == 1, 1).otherwise(-1), cw - 1))
        return F.when(ox == nx, at(data, cw, nx, y)).otherwise(div(3 * at(data, cw, nx, y) + at(data, cw, ox, y) + 2, 4))

    return build(w, h, pixel)


@once
def demosaic(data: Column, w: Size, h: Size, pattern: list[list[str]], channel: str) -> Column:
    """A channel of a filter-array plane: own pixels as they are, others the rounded mean of the channel's pixels in the (2pw-1) x (2ph-1) neighbourhood."""
    w, h, ph, pw = _c(w), _c(h), len(pattern), len(pattern[0])

    def cell(px: int, py: int, x: Column, y: Column) -> Column:
        if pattern[py][px] == channel:
            return at(data, w, x, y)
        total, n = F.lit(0), F.lit(0)
        for dy in range(-(ph - 1), ph):
            for dx in range(-(pw - 1), pw):
                if pattern[(py + dy) % ph][(px + dx) % pw] == channel:
                    inside = (x + dx >= 0) & (x + dx < w) & (y + dy >= 0) & (y + dy < h)
                    total = total + F.when(inside, at(data, w, x + dx, y + dy)).otherwise(0)
                    n = n + F.when(inside, 1).otherwise(0)
        return F.when(n > 0, div(total + div(n, 2), n)).otherwise(0)

    def pixel(x: Column, y: Column) -> Column:
        out = None
        for py in range(ph):
            for px in range(pw):
                here = (x % pw == px) & (y % ph == py)
                out = F.when(here, cell(px, py, x, y)) if out is None else out.when(here, cell(px, py, x, y))
        return out

    return build(w, h, pixel)


def deeper(data: Column, bits: int, to: int) -> Column:
    """Values of `bits` bits at `to` bits, by repeating the leading bits below."""
    def grow(v: Column) -> Column:
        out, have = F.shiftleft(v, to - bits), bits
        while have < to:
            shift = to - have - bits
            out = out.bitwiseOR(F.shiftleft(v, shift) if shift >= 0 else F.shiftright(v, -shift))
            have += bits
        return out

    return F.transform(data, grow)


def to_8_bits(data: Column, bits: int) -> Column:
    """More than 8 bits are cut off; fewer are spread over 0 ... 255 by a product and a shift."""
    if bits >= 8:
        return F.transform(data, lambda v: F.shiftright(v, bits - 8))
    factor, shift = _spread(bits)
    return F.transform(data, lambda v: F.shiftright(v * factor, shift))


def _spread(bits: int) -> tuple[int, int]:
    """Factor and shift that repeat a value's bits over 8 bits: the bits, as often as they fit into 8 or more, less the excess."""
    n = -(-8 // bits)
    return sum(1 << (i * bits) for i in range(n)), n * bits - 8


def interleave(planes: list[Column]) -> Column:
    """r0 g0 b0 r1 g1 b1 ... of planes of one size."""
    return F.flatten(F.transform(F.arrays_zip(*[p.alias(f"p{i}") for i, p in enumerate(planes)]), lambda z: F.array(*[z[f"p{i}"] for i in range(len(planes))])))


def channel_of(data: Column, channels: int, k: int) -> Column:
    """The k-th channel of interleaved data."""
    return F.filter(data, lambda v, i: i % channels == k)


def flatten_alpha(data: Column, alpha: Column, background: Callable[[Column], Column] | int, most: int = 255) -> Column:
    """(p * a + b * (most - a)) div most; background is a value or a function of the pixel's index."""
    back = background if callable(background) else (lambda i: F.lit(background))
    return F.zip_with(F.transform(data, lambda v, i: F.struct(v.alias("v"), back(i).alias("b"))), alpha, lambda p, a: div(p["v"] * a + p["b"] * (most - a), most))


def checkerboard(w: Size, side: int, first: int, second: int) -> Callable[[Column], Column]:
    """A background of squares, for flatten_alpha."""
    return lambda i: F.when((div(i % _c(w), side) + div(div(i, w), side)) % 2 == 0, first).otherwise(second)


def mean_squared_error(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long"))
    return F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(d)


def psnr(mse: Column, most: int = 255) -> Column:
    """In decibels; 100 for equal planes."""
    return F.when(mse == 0, F.lit(100.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 10 * F.log10(F.lit(float(most * most)) / mse))))


@once
def pack_bits(mask: Column) -> Column:
    """A mask of 0 and other values as bytes, first pixel in the highest bit, rows not padded."""
    n = div(F.size(mask) + 7, 8)
    byte = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, j: 2 * s + F.when(F.coalesce(F.get(mask, k * 8 + j), F.lit(0)) != 0, 1).otherwise(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).otherwise(F.array().cast("array<int>"))


@once
def unpack_bits(packed: Column, n: Size) -> Column:
    """The first n pixels, 0 or 255, of bits in array<int> bytes."""
    bit = lambda i: F.get(packed, div(i, 8)).bitwiseAND(F.pow(F.lit(2), 7 - i % 8).cast("int"))
    return build(n, 1, lambda i, _: F.when(bit(i) != 0, 255).otherwise(0))


def overlay_stack(canvas: Column, w: Size, h: Size, layers: Column, iw: Size, ih: Size) -> Column:
    """Layers, an ordered array<struct<x, y, v, a>> of planes of iw x ih with alpha (null: opaque), drawn one after another."""

    def draw(c: Column, layer: Column) -> Column:
        def pixel(x: Column, y: Column) -> Column:
            inside = (x >= layer["x"]) & (x < layer["x"] + _c(iw)) & (y >= layer["y"]) & (y < layer["y"] + _c(ih))
            s, d = at(layer["v"], iw, x - layer["x"], y - layer["y"]), at(c, w, x, y)
            a = F.coalesce(at(layer["a"], iw, x - layer["x"], y - layer["y"]), F.lit(255))
            return F.when(inside, div(s * a + d * (255 - a), 255)).otherwise(d)

        return build(w, h, pixel)

    return F.aggregate(layers, canvas, draw)


def stored_tile(tx: Column, ty: Column, cols: Column, rows: Column, properties: Column) -> Column:
    """struct<x, y>: the stored tile that is shown at (tx, ty) of a grid of cols x rows, as displayed, by undoing properties (imir, irot) from the last to the first."""
    start = F.struct(tx.cast("int").alias("x"), ty.cast("int").alias("y"), cols.cast("int").alias("w"), rows.cast("int").alias("h"))

    def undo(t: Column, p: Column) -> Column:
        s = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
        x, y, w, h = (t[k] for k in "xywh")
        mir, rot = p["kind"] == "imir", p["kind"] == "irot"
        return (
            F.when(mir & (p["value"] == 1), s(w - 1 - x, y, w, h))
            .when(mir, s(x, h - 1 - y, w, h))
            .when(rot & (p["value"] == 90), s(h - 1 - y, x, h, w))
            .when(rot & (p["value"] == 180), s(w - 1 - x, h - 1 - y, w, h))
            .when(rot & (p["value"] == 270), s(y, w - 1 - x, h, w))
            .otherwise(t)
        )

    return F.aggregate(F.reverse(properties), start, undo, lambda t: F.struct(t["x"], t["y"]))


def with_alpha(data: Column, w: Size, h: Size, alpha: Column, aw: Size, ah: Size) -> Column:
    """array<struct<v, a>>: a plane with its alpha plane, scaled to the plane's size by the nearest sample."""
    return F.zip_with(data, scale_nearest(alpha, aw, ah, w, h), lambda v, a: F.struct(v.alias("v"), a.alias("a")))
