"""Colour conversions as column expressions on plane arrays.

Kernels work element by element on arrays of one size (chroma is brought to
full size first by operators.planes), so a conversion is one projection.
Values are rounded by floor(x + 0.5) and clipped to the depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights of red and blue by matrix index (H.273).
KR_KB = {
    1: (0.2126, 0.0722),
    4: (0.30, 0.11),
    5: (0.299, 0.114),
    6: (0.299, 0.114),
    7: (0.212, 0.087),
    9: (0.2627, 0.0593),
    10: (0.2627, 0.0593),
}
# What limited range is widened by on decoding, as published with the format (256 / 219 and 256 / 224).
LUMA_GAIN, CHROMA_GAIN = 1.1689, 1.1429
#: Matrices that no conversion exists for.
UNSUPPORTED_MATRICES = {11, 14}

#: Matrix that stands for unspecified.
DEFAULT_MATRIX = 6


def weights(matrix: int, primaries: tuple[tuple[float, float], ...] | None = None) -> tuple[float, float]:
    """Kr and Kb; for matrices 12 and 13 from the chromaticities (red, green, blue, white)."""
    if matrix in (12, 13) and primaries:
        (rx, ry), (gx, gy), (bx, by), (wx, wy) = primaries
        rz, gz, bz, wz = (1 - x - y for x, y in primaries)
        below = wy * (rx * (gy * bz - by * gz) + gx * (by * rz - ry * bz) + bx * (ry * gz - gy * rz))
        kr = ry * (wx * (gy * bz - by * gz) + wy * (bx * gz - gx * bz) + wz * (gx * by - bx * gy)) / below
        kb = by * (wx * (ry * gz - gy * rz) + wy * (gx * rz - rx * gz) + wz * (rx * gy - gx * ry)) / below
        return kr, kb
    return KR_KB.get(matrix, KR_KB[DEFAULT_MATRIX])


def clipped(x: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor(x + 0.5))).cast("int")


def zipped(planes: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """f over structs of the planes' values at each position."""
    return F.transform(F.arrays_zip(*[p.alias(k) for k, p in planes.items()]), f)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, matrix: int = DEFAULT_MATRIX, full_range: bool = True, bits: int = 8) -> Column:
    """array<struct<R,G,B>> from planes of one size. Matrix 0 copies G, B, R; 8 is YCgCo."""
    if matrix in UNSUPPORTED_MATRICES:
        raise ValueError(f"no conversion for matrix {matrix}")
    most, mid, low = (1 << bits) - 1, 1 << (bits - 1), 16 << (bits - 8)
    kr, kb = weights(matrix)
    kg = 1 - kr - kb

    def pixel(p: Column) -> Column:
        if matrix == 0:
            if full_range:
                r, g, b = p["cr"], p["y"], p["cb"]
            else:
                r, g, b = clipped((p["cr"] - low) * CHROMA_GAIN, most), clipped((p["y"] - low) * LUMA_GAIN, most), clipped((p["cb"] - low) * CHROMA_GAIN, most)
        elif matrix == 8:
            cg, co = p["cb"] - mid, p["cr"] - mid
            r, g, b = (clipped(v, most) for v in (p["y"] - cg + co, p["y"] + cg, p["y"] - cg - co))
        else:
            v, u, w = (p["y"] * F.lit(1.0)), (p["cb"] - mid) * F.lit(1.0), (p["cr"] - mid) * F.lit(1.0)
            if not full_range:
                v, u, w = (v - low) * LUMA_GAIN, u * CHROMA_GAIN, w * CHROMA_GAIN
            r = clipped(v + 2 * (1 - kr) * w, most)
            g = clipped(v - 2 * kb * (1 - kb) / kg * u - 2 * kr * (1 - kr) / kg * w, most)
            b = clipped(v + 2 * (1 - kb) * u, most)
        return F.struct(r.cast("int").alias("R"), g.cast("int").alias("G"), b.cast("int").alias("B"))

    return zipped({"y": y, "cb": cb, "cr": cr}, pixel)


def ycbcr_to_rgb_fixed(y: Column, cb: Column, cr: Column, matrix: int = DEFAULT_MATRIX) -> Column:
    """The 8-bit full-range conversion in integers: coefficients in 256ths, offsets rounded before they are added."""
    kr, kb = weights(matrix)
    kg = 1 - kr - kb
    near = lambda v: int(v + 0.5) if v >= 0 else -int(0.5 - v)
    r_cr, g_cb, g_cr, b_cb = (near(256 * v) for v in (2 * (1 - kr), -2 * kb * (1 - kb) / kg, -2 * kr * (1 - kr) / kg, 2 * (1 - kb)))
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")

    def pixel(p: Column) -> Column:
        u, w = p["cb"] - 128, p["cr"] - 128
        return F.struct(
            clip(p["y"] + F.shiftright(w * r_cr + 128, 8)).alias("R"),
            clip(p["y"] + F.shiftright(u * g_cb + w * g_cr + 128, 8)).alias("G"),
            clip(p["y"] + F.shiftright(u * b_cb + 128, 8)).alias("B"),
        )

    return zipped({"y": y, "cb": cb, "cr": cr}, pixel)


def rgb_to_ycbcr(r: Column, g: Column, b: Column, matrix: int = DEFAULT_MATRIX, full_range: bool = True, bits: int = 8) -> Column:
    """array<struct<Y,Cb,Cr>> at full chroma size."""
    if matrix in UNSUPPORTED_MATRICES:
        raise ValueError(f"no conversion for matrix {matrix}")
    most, mid, low = (1 << bits) - 1, 1 << (bits - 1), 16 << (bits - 8)
    kr, kb = weights(matrix)
    kg = 1 - kr - kb

    def pixel(p: Column) -> Column:
        r, g, b = p["r"], p["g"], p["b"]
        if matrix == 0:
            if full_range:
                y, u, v = g, b, r
            else:
                y, u, v = clipped(g * F.lit(219.0) / 256 + low, most), clipped(b * F.lit(224.0) / 256 + low, most), clipped(r * F.lit(224.0) / 256 + low, most)
        elif matrix == 8:
            half = lambda x, n: F.when(x < 0, -F.floor(-x / n)).otherwise(F.floor(x / n))
            y = half(g, 2) + half(r + b, 4)
            u, v = clipped(half(g, 2) - half(r + b, 4) + mid, most), clipped(half(r - b, 2) + mid, most)
        else:
            y = r * F.lit(kr) + g * F.lit(kg) + b * F.lit(kb)
            u = r * F.lit(-kr / (1 - kb) / 2) + g * F.lit(-kg / (1 - kb) / 2) + b * F.lit(0.5)
            v = r * F.lit(0.5) + g * F.lit(-kg / (1 - kr) / 2) + b * F.lit(-kb / (1 - kr) / 2)
            if not full_range:
                y, u, v = y * 219 / 256 + low, u * 224 / 256, v * 224 / 256
            y, u, v = clipped(y, most), clipped(u + mid, most), clipped(v + mid, most)
        return F.struct(y.cast("int").alias("Y"), u.cast("int").alias("Cb"), v.cast("int").alias("Cr"))

    return zipped({"r": r, "g": g, "b": b}, pixel)


def mono_to_ycbcr(y: Column, bits: int = 8) -> Column:
    """array<struct<Y,Cb,Cr>> of no colour."""
    mid = F.lit(1 << (bits - 1))
    return F.transform(y, lambda v: F.struct(v.alias("Y"), mid.alias("Cb"), mid.alias("Cr")))


def to_bytes(data: Column, bits: int, big_endian: bool = True) -> Column:
    """16-bit samples as an array of bytes; values keep their depth."""
    two = lambda v: (F.shiftright(v, 8), v.bitwiseAND(255))
    return F.flatten(F.transform(data, lambda v: F.array(*(two(v) if big_endian else two(v)[::-1]))))


def from_bytes(data: Column, big_endian: bool = True) -> Column:
    pair = F.filter(F.transform(data, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p["i"] % 2 == 0)
    other = F.filter(data, lambda v, i: i % 2 == 1)
    return F.zip_with(pair, other, lambda p, q: (p["v"] * 256 + q) if big_endian else (q * 256 + p["v"]))


def swap_endianness(data: Column) -> Column:
    """Bytes of 16-bit samples in the other order."""
    return to_bytes(from_bytes(data, True), 16, False)
