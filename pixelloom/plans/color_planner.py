"""Choosing a pipeline of colour conversions: the cheapest path through colour states.

States are what an image is stored as, edges are conversions with a cost.
The search runs on the driver over a few dozen states before any data is
touched; plans.color_pipeline runs its result, a list of steps.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

# Relative costs.
TRIVIAL, HARDWARE, OPTIMIZED, UNOPTIMIZED, SLOW = 1, 2, 6, 11, 16


@dataclass(frozen=True, order=True)
class State:
    """colorspace: mono, ycbcr, rgb or bayer. chroma: mono, 420, 422, 444, planar, rgb24, rgb32, rrggbb_be, rrggbb_le, filter_array."""

    colorspace: str
    chroma: str
    alpha: bool = False
    bits: int = 8
    alpha_bits: int = 8
    matrix: int = 6
    full_range: bool = True


@dataclass(frozen=True)
class Step:
    name: str
    cost: int
    after: Callable[[State, State], Iterator[State]]


def _rgb(s: State, chroma: str) -> State:
    return replace(s, colorspace="rgb", chroma=chroma)


def _pack_rgb(s: State, t: State) -> Iterator[State]:
    if (s.colorspace, s.chroma, s.bits) == ("rgb", "planar", 8) and (not s.alpha or s.alpha_bits == 8):
        yield replace(s, chroma="rgb32" if s.alpha else "rgb24")


def _unpack_rgb(s: State, t: State) -> Iterator[State]:
    if s.colorspace == "rgb" and s.chroma in ("rgb24", "rgb32"):
        yield replace(s, chroma="planar")


def _to_rgb(s: State, t: State) -> Iterator[State]:
    if s.colorspace == "ycbcr" and s.matrix not in (11, 14) and 8 <= s.bits <= 14:
        yield _rgb(s, "planar")


def _420_to_rgb24(s: State, t: State) -> Iterator[State]:
    if (s.colorspace, s.chroma, s.bits, s.full_range, s.alpha) == ("ycbcr", "420", 8, True, False) and s.matrix not in (0, 8, 11, 14):
        yield _rgb(s, "rgb24")


def _420_to_rgb32(s: State, t: State) -> Iterator[State]:
    if (s.colorspace, s.chroma, s.bits, s.full_range, s.alpha, s.alpha_bits) == ("ycbcr", "420", 8, True, True, 8) and s.matrix not in (0, 8, 11, 14):
        yield _rgb(s, "rgb32")


def _420_to_rrggbb(s: State, t: State) -> Iterator[State]:
    if (s.colorspace, s.chroma, s.full_range) == ("ycbcr", "420", True) and s.bits > 8 and s.matrix not in (0, 8, 11, 14):
        for order in ("rrggbb_le", "rrggbb_be"):
            yield _rgb(s, order)


def _hdr_to_rrggbb(s: State, t: State) -> Iterator[State]:
    if (s.colorspace, s.chroma) == ("rgb", "planar") and s.bits > 8 and (not s.alpha or s.alpha_bits == s.bits):
        yield replace(s, chroma="rrggbb_be")


def _rrggbb_to_hdr(s: State, t: State) -> Iterator[State]:
    if s.chroma == "rrggbb_be":
        yield replace(s, chroma="planar")


def _swap(s: State, t: State) -> Iterator[State]:
    if s.chroma in ("rrggbb_be", "rrggbb_le"):
        yield replace(s, chroma="rrggbb_le" if s.chroma == "rrggbb_be" else "rrggbb_be")


def _mono_to_420(s: State, t: State) -> Iterator[State]:
    if s.colorspace == "mono":
        yield replace(s, colorspace="ycbcr", chroma="420")


def _mono_to_rgb(s: State, t: State) -> Iterator[State]:
    if s.colorspace == "mono" and s.bits == 8:
        yield _rgb(s, "rgb32" if s.alpha else "rgb24")


def _bayer(s: State, t: State) -> Iterator[State]:
    if s.colorspace == "bayer":
        yield _rgb(s, "rgb24" if s.bits == 8 else "rrggbb_le")


def _rgb24_to_ycbcr(s: State, t: State) -> Iterator[State]:
    if s.chroma in ("rgb24", "rgb32") and t.matrix not in (0, 8, 11, 14):
        for chroma in ("420", "422", "444"):
            yield replace(s, colorspace="ycbcr", chroma=chroma, matrix=t.matrix, full_range=t.full_range)


def _rgb24_to_gbr(s: State, t: State) -> Iterator[State]:
    if s.chroma in ("rgb24", "rgb32") and t.matrix == 0 and t.full_range:
        yield replace(s, colorspace="ycbcr", chroma="444", matrix=0, full_range=True)


def _rgb_to_ycbcr(s: State, t: State) -> Iterator[State]:
    if (s.colorspace, s.chroma) == ("rgb", "planar") and t.matrix not in (11, 14):
        for chroma in ("420", "422", "444") if t.matrix not in (0, 8) else ("444",):
            yield replace(s, colorspace="ycbcr", chroma=chroma, matrix=t.matrix, full_range=t.full_range)


def _rrggbb_to_420(s: State, t: State) -> Iterator[State]:
    if s.chroma in ("rrggbb_be", "rrggbb_le") and t.matrix not in (0, 8, 11, 14):
        yield replace(s, colorspace="ycbcr", chroma="420", matrix=t.matrix, full_range=t.full_range)


def _drop_alpha(s: State, t: State) -> Iterator[State]:
    if s.alpha and not t.alpha and s.chroma not in ("rgb32", "rrggbb_be", "rrggbb_le"):
        yield replace(s, alpha=False, alpha_bits=8)


def _alpha_depth(s: State, t: State) -> Iterator[State]:
    if s.alpha and s.alpha_bits != s.bits and s.chroma not in ("rgb32",):
        yield replace(s, alpha_bits=s.bits)


def _planes(s: State) -> bool:
    return s.chroma in ("mono", "420", "422", "444", "planar")


def _deepen(s: State, t: State) -> Iterator[State]:
    if _planes(s) and s.bits < t.bits and s.bits <= 8:
        yield replace(s, bits=t.bits, alpha_bits=t.bits if s.alpha else s.alpha_bits)


def _shallow(s: State, t: State) -> Iterator[State]:
    if _planes(s) and s.bits != 8 and t.bits == 8:
        yield replace(s, bits=8, alpha_bits=8)


def _chroma(of: str, to: str) -> Callable[[State, State], Iterator[State]]:
    def after(s: State, t: State) -> Iterator[State]:
        if s.colorspace == "ycbcr" and s.chroma == of and s.matrix != 0:
            yield replace(s, chroma=to)

    return after


#: In the order that decides between pipelines of equal cost.
STEPS = [
    Step("rgb_to_rgb24", UNOPTIMIZED, _pack_rgb),
    Step("rgb24_to_rgb", UNOPTIMIZED, _unpack_rgb),
    Step("ycbcr_to_rgb", UNOPTIMIZED, _to_rgb),
    Step("ycbcr420_to_rgb24", UNOPTIMIZED, _420_to_rgb24),
    Step("ycbcr420_to_rgb32", UNOPTIMIZED, _420_to_rgb32),
    Step("ycbcr420_to_rrggbb", UNOPTIMIZED, _420_to_rrggbb),
    Step("rgb_to_rrggbb_be", UNOPTIMIZED, _hdr_to_rrggbb),
    Step("mono_to_ycbcr420", OPTIMIZED, _mono_to_420),
    Step("mono_to_rgb24", UNOPTIMIZED, _mono_to_rgb),
    Step("bayer_to_rgb", UNOPTIMIZED, _bayer),
    Step("swap_endianness", UNOPTIMIZED, _swap),
    Step("rrggbb_be_to_rgb", UNOPTIMIZED, _rrggbb_to_hdr),
    Step("rgb24_to_ycbcr", UNOPTIMIZED, _rgb24_to_ycbcr),
    Step("rgb_to_ycbcr", UNOPTIMIZED, _rgb_to_ycbcr),
    Step("rrggbb_to_ycbcr420", UNOPTIMIZED, _rrggbb_to_420),
    Step("rgb24_to_gbr444", UNOPTIMIZED, _rgb24_to_gbr),
    Step("drop_alpha", TRIVIAL, _drop_alpha),
    Step("alpha_depth", UNOPTIMIZED, _alpha_depth),
    Step("to_more_bits", UNOPTIMIZED, _deepen),
    Step("to_8_bits", UNOPTIMIZED, _shallow),
    Step("bilinear_420_to_444", UNOPTIMIZED, _chroma("420", "444")),
    Step("bilinear_422_to_444", UNOPTIMIZED, _chroma("422", "444")),
    Step("average_444_to_420", UNOPTIMIZED, _chroma("444", "420")),
    Step("average_444_to_422", UNOPTIMIZED, _chroma("444", "422")),
]


def plan(source: State, target: State, steps: list[Step] | None = None) -> tuple[int, list[tuple[str, State]]] | None:
    """(cost, [(step, state after it)]), empty for equal states; None if nothing leads there."""
    steps = STEPS if steps is None else steps
    ties = itertools.count()
    border: list[tuple[int, int, State, tuple]] = [(0, next(ties), source, ())]
    done: set[State] = set()
    while border:
        cost, _, state, path = heapq.heappop(border)
        if state in done:
            continue
        if state == target:
            return cost, list(path)
        done.add(state)
        for step in steps:
            for after in step.after(state, target):
                if after not in done:
                    heapq.heappush(border, (cost + step.cost, next(ties), after, (*path, (step.name, after))))
    return None
