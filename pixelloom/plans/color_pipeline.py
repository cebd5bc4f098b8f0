"""Running a planned colour pipeline over a table of pictures.

Each step of plans.color_planner has a kernel here, on whole numpy planes.
A picture is one row, its planes are binary (a byte a sample up to 8 bits,
else two, lowest first), so a pipeline is one Arrow pass without a shuffle
and its memory is that of the batch's pictures, not of boxed pixels.

Interleaved pictures have one plane, with the channels of a pixel one after
another; the byte order that their state names is theirs when written out
and changes no value. Kernels that resample chroma say how: the nearest
sample, the mean of a 2 x 2 block, or bilinear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.functions.color import CHROMA_GAIN, LUMA_GAIN, weights
from pixelloom.plans.color_planner import STEPS, State, Step, plan
from pixelloom.session import ship

Picture = dict[str, np.ndarray]

#: How each step that changes the resolution of chroma does so.
NEAREST_UP = {"ycbcr_to_rgb", "ycbcr420_to_rgb24", "ycbcr420_to_rgb32", "ycbcr420_to_rrggbb"}
BILINEAR_UP = {"bilinear_420_to_444", "bilinear_422_to_444"}
AVERAGE_DOWN = {"rgb24_to_ycbcr", "rgb_to_ycbcr", "average_444_to_420", "average_444_to_422"}
NEAREST_DOWN = {"rrggbb_to_ycbcr420"}


def allowed(steps: list[Step], upsampling: str | None = None, downsampling: str | None = None) -> list[Step]:
    """The steps that resample chroma only by these algorithms: nearest or bilinear, nearest or average; None allows both."""
    up = {"nearest": BILINEAR_UP, "bilinear": NEAREST_UP, None: set()}[upsampling]
    down = {"nearest": AVERAGE_DOWN, "average": NEAREST_DOWN, None: set()}[downsampling]

    def kept(step: Step) -> Step:
        def after(s: State, t: State) -> Iterator[State]:
            for a in step.after(s, t):
                grows = step.name in up and s.colorspace == "ycbcr" and s.chroma in ("420", "422")
                shrinks = step.name in down and a.chroma in ("420", "422")
                if not grows and not shrinks:
                    yield a

        return Step(step.name, step.cost, after)

    return [kept(s) for s in steps]


def channels(s: State) -> list[str]:
    """The names of a state's planes, in order."""
    if s.chroma in ("rgb24", "rgb32", "rrggbb_be", "rrggbb_le"):
        return ["packed"]
    own = {"mono": ["Y"], "ycbcr": ["Y", "Cb", "Cr"], "rgb": ["R", "G", "B"], "bayer": ["F"]}[s.colorspace]
    return [*own, "A"] if s.alpha else own


def size_of(s: State, name: str, w: int, h: int) -> tuple[int, int]:
    """Width (times channels, if interleaved) and height of a plane of a picture of w x h."""
    if name == "packed":
        return w * (4 if s.alpha else 3), h
    if name in ("Cb", "Cr"):
        return -(-w // 2) if s.chroma in ("420", "422") else w, -(-h // 2) if s.chroma == "420" else h
    return w, h


def _clip(x: np.ndarray, bits: int) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, (1 << bits) - 1).astype(np.int64)


def _pack(*planes: np.ndarray) -> np.ndarray:
    h, w = planes[0].shape
    return np.stack(planes, 2).reshape(h, w * len(planes))


def _unpacked(p: Picture, s: State) -> list[np.ndarray]:
    n = 4 if s.alpha else 3
    return [p["packed"][:, k::n] for k in range(n)]


def _full(c: np.ndarray, s: State, like: np.ndarray) -> np.ndarray:
    """Chroma at luma's size, by the nearest sample."""
    if s.chroma in ("420", "422"):
        c = c.repeat(2, 1)
    if s.chroma == "420":
        c = c.repeat(2, 0)
    return c[: like.shape[0], : like.shape[1]]


def _rgb(p: Picture, s: State) -> list[np.ndarray]:
    y, u, v = p["Y"].astype(float), *(_full(p[k], s, p["Y"]).astype(float) for k in ("Cb", "Cr"))
    mid, low = 1 << (s.bits - 1), 16 << (s.bits - 8)
    if s.matrix == 0:
        if not s.full_range:
            y, u, v = (y - low) * LUMA_GAIN, (u - low) * CHROMA_GAIN, (v - low) * CHROMA_GAIN
        return [_clip(x, s.bits) for x in (v, y, u)]
    u, v = u - mid, v - mid
    if s.matrix == 8:
        return [_clip(x, s.bits) for x in (y - u + v, y + u, y - u - v)]
    if not s.full_range:
        y, u, v = (y - low) * LUMA_GAIN, u * CHROMA_GAIN, v * CHROMA_GAIN
    kr, kb = weights(s.matrix)
    kg = 1 - kr - kb
    return [_clip(x, s.bits) for x in (y + 2 * (1 - kr) * v, y - 2 * kb * (1 - kb) / kg * u - 2 * kr * (1 - kr) / kg * v, y + 2 * (1 - kb) * u)]


def _rgb_in_integers(p: Picture, s: State) -> list[np.ndarray]:
    """8 bits at full range, with coefficients in 256ths."""
    y, u, v = p["Y"], *(_full(p[k], s, p["Y"]) - 128 for k in ("Cb", "Cr"))
    kr, kb = weights(s.matrix)
    kg = 1 - kr - kb
    near = lambda x: int(abs(x) * 256 + 0.5) * (1 if x > 0 else -1)
    adds = (near(2 * (1 - kr)) * v, near(-2 * kb * (1 - kb) / kg) * u + near(-2 * kr * (1 - kr) / kg) * v, near(2 * (1 - kb)) * u)
    return [np.clip(y + (a + 128 >> 8), 0, 255) for a in adds]


def _block(c: np.ndarray, across: int, down: int) -> list[np.ndarray]:
    """The samples of each block of across x down; at an odd edge the last sample stands for the missing one."""
    c = np.pad(c, ((0, -len(c) % down), (0, -c.shape[1] % across)), "edge")
    return [c[j::down, i::across] for j in range(down) for i in range(across)]


def _ycbcr(rgb: list[np.ndarray], s: State, centre: str) -> Picture:
    """Planes of s (its chroma, matrix, range and bits); chroma from the mean of a 4:2:0 block ("mean"), its integer part ("floor"), or the first sample."""
    across, down = (2 if s.chroma in ("420", "422") else 1), (2 if s.chroma == "420" else 1)
    mid, low = 1 << (s.bits - 1), 16 << (s.bits - 8)
    if s.matrix in (0, 8) or down == 1 or centre == "first":
        small = [_block(c, across, down)[0] for c in rgb]
    else:
        small = [sum(_block(c, across, down)) / 4 for c in rgb]
        small = [np.floor(c) for c in small] if centre == "floor" else small
    r, g, b = rgb
    x, y, z = small
    if s.matrix == 0:
        if s.full_range:
            return {"Y": g, "Cb": z, "Cr": x}
        return {"Y": _clip(g * 219 / 256 + low, s.bits), "Cb": _clip(z * 224 / 256 + low, s.bits), "Cr": _clip(x * 224 / 256 + low, s.bits)}
    if s.matrix == 8:
        towards_zero = np.sign(x - z) * (np.abs(x - z) // 2)
        return {"Y": g // 2 + (r + b) // 4, "Cb": _clip(y // 2 - (x + z) // 4 + mid, s.bits), "Cr": _clip(towards_zero + mid, s.bits)}
    kr, kb = weights(s.matrix)
    kg = 1 - kr - kb
    luma = r * kr + g * kg + b * kb
    cb = x * (-kr / (1 - kb) / 2) + y * (-kg / (1 - kb) / 2) + z * 0.5
    cr = x * 0.5 + y * (-kg / (1 - kr) / 2) + z * (-kb / (1 - kr) / 2)
    if not s.full_range:
        luma, cb, cr = luma * 219 / 256 + low, cb * 224 / 256, cr * 224 / 256
    return {"Y": _clip(luma, s.bits), "Cb": _clip(cb + mid, s.bits), "Cr": _clip(cr + mid, s.bits)}


def _deeper(c: np.ndarray, bits: int, to: int) -> np.ndarray:
    """The leading bits again below the value, as far as there is room."""
    out, have = c << (to - bits), bits
    while have < to:
        shift = to - have - bits
        out = out | (c << shift if shift >= 0 else c >> -shift)
        have += bits
    return out


def _depth(c: np.ndarray, bits: int, to: int) -> np.ndarray:
    return _deeper(c, bits, to) if to > bits else c >> (bits - to)


def _grown(c: np.ndarray, n: int, axis: int) -> list[np.ndarray]:
    """For every output position on an axis: the nearest sample and its neighbour on that side, clamped."""
    i = np.arange(n)
    near = i // 2
    other = np.clip(near + np.where(i % 2, 1, -1), 0, c.shape[axis] - 1)
    return [c.take(near, axis), c.take(other, axis), other == near]


def _bilinear(c: np.ndarray, s: State, like: np.ndarray) -> np.ndarray:
    """Weights 3:1 along each axis that grows; at a border the axis has the nearest sample alone."""
    h, w = like.shape
    a, b, ex = _grown(c, w, 1)
    if s.chroma == "422":
        return np.where(ex[None, :], a, (3 * a + b + 2) // 4)
    aa, ac, ey = _grown(a, h, 0)
    ba, bc, _ = _grown(b, h, 0)
    ex, ey = ex[None, :], ey[:, None]
    both = (9 * aa + 3 * ba + 3 * ac + bc + 8) // 16
    return np.where(ex & ey, aa, np.where(ey, (3 * aa + ba + 2) // 4, np.where(ex, (3 * aa + ac + 2) // 4, both)))


def _averaged(c: np.ndarray, s: State) -> np.ndarray:
    """Means of what a block holds of the picture, rounded."""
    across, down = 2, 2 if s.chroma == "420" else 1
    ones = np.pad(np.ones_like(c), ((0, -len(c) % down), (0, -c.shape[1] % across)))
    zero = np.pad(c, ((0, -len(c) % down), (0, -c.shape[1] % across)))
    n = sum(_block(ones, across, down))
    return (sum(_block(zero, across, down)) + n // 2) // n


def _demosaic(f: np.ndarray, pattern: str = "RGGB") -> list[np.ndarray]:
    """The pattern's own colour where a sample has it, else the rounded mean of that colour's samples around it."""
    h, w = f.shape
    of = np.array([list(pattern[:2]), list(pattern[2:])])[np.arange(h)[:, None] % 2, np.arange(w)[None, :] % 2]
    out = []
    for colour in "RGB":
        has = np.pad((of == colour).astype(np.int64), 1)
        value = np.pad(f, 1) * has
        around = [(j, i) for j in range(3) for i in range(3)]
        total, n = (sum(a[j : j + h, i : i + w] for j, i in around) for a in (value, has))
        out.append(np.where(of == colour, f, (total + n // 2) // np.maximum(n, 1)))
    return out


def _alpha(p: Picture, s: State, t: State) -> list[np.ndarray]:
    """The alpha plane for an interleaved picture, opaque if there is none."""
    if not t.alpha:
        return []
    return [p["A"] if s.alpha else np.full_like(next(iter(p.values())), (1 << t.bits) - 1)]


def _keep(p: Picture, **new: np.ndarray) -> Picture:
    return {**new, **({"A": p["A"]} if "A" in p else {})}


def _named(planes: list[np.ndarray]) -> Picture:
    return dict(zip("RGBA", planes, strict=False))


#: (picture, state before, state after) -> picture, by the planner's names.
KERNELS: dict[str, Callable[[Picture, State, State], Picture]] = {
    "rgb_to_rgb24": lambda p, s, t: {"packed": _pack(p["R"], p["G"], p["B"], *_alpha(p, s, t))},
    "rgb24_to_rgb": lambda p, s, t: _named(_unpacked(p, s)),
    "ycbcr_to_rgb": lambda p, s, t: _keep(p, **_named(_rgb(p, s))),
    "ycbcr420_to_rgb24": lambda p, s, t: {"packed": _pack(*_rgb_in_integers(p, s))},
    "ycbcr420_to_rgb32": lambda p, s, t: {"packed": _pack(*_rgb_in_integers(p, s), *_alpha(p, s, t))},
    "ycbcr420_to_rrggbb": lambda p, s, t: {"packed": _pack(*_rgb(p, s), *_alpha(p, s, t))},
    "rgb_to_rrggbb_be": lambda p, s, t: {"packed": _pack(p["R"], p["G"], p["B"], *_alpha(p, s, t))},
    "rrggbb_be_to_rgb": lambda p, s, t: _named(_unpacked(p, s)),
    "swap_endianness": lambda p, s, t: p,
    "mono_to_ycbcr420": lambda p, s, t: _keep(p, Y=p["Y"], **{c: np.full(size_of(t, c, *p["Y"].shape[::-1])[::-1], 1 << (s.bits - 1), np.int64) for c in ("Cb", "Cr")}),
    "mono_to_rgb24": lambda p, s, t: {"packed": _pack(p["Y"], p["Y"], p["Y"], *_alpha(p, s, t))},
    "bayer_to_rgb": lambda p, s, t: {"packed": _pack(*_demosaic(p["F"]), *_alpha(p, s, t))},
    "rgb24_to_ycbcr": lambda p, s, t: {**_ycbcr(_unpacked(p, s)[:3], t, "floor"), **({"A": _unpacked(p, s)[3]} if t.alpha else {})},
    "rgb24_to_gbr444": lambda p, s, t: {**_ycbcr(_unpacked(p, s)[:3], t, "first"), **({"A": _unpacked(p, s)[3]} if t.alpha else {})},
    "rgb_to_ycbcr": lambda p, s, t: _keep(p, **_ycbcr([p["R"], p["G"], p["B"]], t, "mean")),
    "rrggbb_to_ycbcr420": lambda p, s, t: {**_ycbcr(_unpacked(p, s)[:3], t, "first"), **({"A": _unpacked(p, s)[3]} if t.alpha else {})},
    "drop_alpha": lambda p, s, t: {k: v for k, v in p.items() if k != "A"},
    "alpha_depth": lambda p, s, t: {**p, "A": _depth(p["A"], s.alpha_bits, t.alpha_bits)},
    "to_more_bits": lambda p, s, t: {k: _deeper(v, s.alpha_bits if k == "A" else s.bits, t.bits) for k, v in p.items()},
    "to_8_bits": lambda p, s, t: {k: _depth(v, s.alpha_bits if k == "A" else s.bits, 8) for k, v in p.items()},
    "bilinear_420_to_444": lambda p, s, t: {**p, **{c: _bilinear(p[c], s, p["Y"]) for c in ("Cb", "Cr")}},
    "bilinear_422_to_444": lambda p, s, t: {**p, **{c: _bilinear(p[c], s, p["Y"]) for c in ("Cb", "Cr")}},
    "average_444_to_420": lambda p, s, t: {**p, **{c: _averaged(p[c], t) for c in ("Cb", "Cr")}},
    "average_444_to_422": lambda p, s, t: {**p, **{c: _averaged(p[c], t) for c in ("Cb", "Cr")}},
}


def run(picture: Picture, source: State, steps: list[tuple[str, State]]) -> Picture:
    """A picture after the steps of a plan."""
    for name, after in steps:
        picture, source = KERNELS[name](picture, source, after), after
    return picture


def _dtype(s: State, name: str) -> np.dtype:
    return np.dtype("u1" if (s.alpha_bits if name == "A" else s.bits) <= 8 else "<u2")


def read(planes: list[bytes], s: State, w: int, h: int) -> Picture:
    """ValueError if the planes aren't those of such a picture."""
    names = channels(s)
    if len(planes) != len(names):
        raise ValueError("number of planes")
    out = {}
    for name, data in zip(names, planes, strict=True):
        pw, ph = size_of(s, name, w, h)
        out[name] = np.frombuffer(data or b"", _dtype(s, name)).reshape(ph, pw).astype(np.int64)
    return out


def converted(pictures: DataFrame, source: State, target: State, key: str, steps: list[Step] | None = None) -> DataFrame:
    """(key, width, height, planes, error): pictures (key, width, height, planes: array<binary>) in the target state, by the cheapest pipeline of `steps` (all by default).

    ValueError if no pipeline leads there. A picture whose planes have other
    sizes than its state asks for, or null ones, has null planes and an error.
    """
    found = plan(source, target, STEPS if steps is None else steps)
    if found is None:
        raise ValueError(f"no conversion from {source} to {target}")
    path = found[1]
    ship(pictures.sparkSession)

    def one(w: int | None, h: int | None, planes: list[bytes] | None) -> tuple[list[bytes] | None, str | None]:
        try:
            out = run(read(planes or [], source, w or 0, h or 0), source, path)
        except ValueError as e:
            return None, f"no picture of {w} x {h} in its state: {e}"
        return [out[c].astype(_dtype(target, c)).tobytes() for c in channels(target)], None

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(*(x.as_py() for x in row)) for row in zip(b.column(1), b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([p for p, _ in got], pa.list_(pa.binary())), pa.array([e for _, e in got], pa.string())], [key, "width", "height", "planes", "error"])

    rows = pictures.selectExpr(f"`{key}`", "cast(width as int) width", "cast(height as int) height", "planes")
    return rows.mapInArrow(mapped, f"`{key}` {pictures.schema[key].dataType.simpleString()}, width int, height int, planes array<binary>, error string")
