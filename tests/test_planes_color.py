import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import color
from pixelloom.operators import planes as px
from pixelloom.plans.color_planner import State, plan


def ev(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*v):
    return F.array(*[F.lit(x) for x in v])


def test_bilinear_golden(spark):
    got = ev(spark, px.bilinear_420(arr(10, 40, 100, 240), 4, 4))
    assert got == [10, 18, 33, 40, 33, 47, 76, 90, 78, 106, 162, 190, 100, 135, 205, 240]
    got = ev(spark, px.bilinear_420(arr(255, 200, 50, 0), 4, 4))
    assert got == [255, 241, 214, 200, 204, 190, 163, 150, 101, 88, 63, 50, 50, 38, 13, 0]


def test_depth_golden(spark):
    assert ev(spark, px.to_8_bits(arr(1, 2, 3, 4, 5, 6), 5)) == [8, 16, 24, 33, 41, 49]
    assert ev(spark, px.to_8_bits(arr(7, 8, 9, 10, 11, 12), 6)) == [28, 32, 36, 40, 44, 48]
    assert ev(spark, px.to_8_bits(arr(13, 14, 15, 16, 17, 18), 5)) == [107, 115, 123, 132, 140, 148]
    assert ev(spark, px.to_8_bits(arr(512, 256, 768, 800), 10)) == [128, 64, 192, 200]
    assert ev(spark, px.deeper(arr(0, 255, 128), 8, 10)) == [0, 1023, 514]


def test_rotations_and_mirrors_are_a_group(spark):
    v = arr(*range(6))  # 3 x 2
    turned = px.rotate_ccw(v, 3, 2, 90)
    assert ev(spark, turned) == [2, 5, 1, 4, 0, 3]
    assert ev(spark, px.rotate_ccw(turned, 2, 3, 270)) == list(range(6))
    assert ev(spark, px.rotate_ccw(turned, 2, 3, 90)) == ev(spark, px.rotate_ccw(v, 3, 2, 180))
    assert ev(spark, px.mirror(px.mirror(v, 3, 2, True), 3, 2, True)) == list(range(6))
    assert ev(spark, px.mirror(px.mirror(v, 3, 2, True), 3, 2, False)) == ev(spark, px.rotate_ccw(v, 3, 2, 180))


def test_crop_of_pad_is_identity(spark):
    v = arr(*range(6))
    assert ev(spark, px.crop(px.pad_edge(v, 3, 2, 5, 4), 5, 0, 0, 2, 1)) == list(range(6))
    assert ev(spark, px.pad_value(v, 3, 2, 4, 3, 9)) == [0, 1, 2, 9, 3, 4, 5, 9, 9, 9, 9, 9]
    assert ev(spark, px.scale_nearest(v, 3, 2, 3, 2)) == list(range(6))


def test_overlay_clips_at_every_offset(spark):
    canvas, tile = arr(*[0] * 9), arr(1, 2, 3, 4)
    for x0, y0 in itertools.product((-2, -1, 0, 2, 3), repeat=2):
        want = [0] * 9
        for y, x in itertools.product(range(2), repeat=2):
            if 0 <= x + x0 < 3 and 0 <= y + y0 < 3:
                want[(y + y0) * 3 + x + x0] = y * 2 + x + 1
        assert ev(spark, px.paste(canvas, 3, 3, tile, 2, 2, x0, y0)) == want
        assert ev(spark, px.overlay(canvas, 3, 3, tile, None, 2, 2, x0, y0)) == want


def test_average_of_odd_sizes(spark):
    assert ev(spark, px.average_420(arr(1, 2, 3, 4, 5, 6, 7, 8, 9), 3, 3)) == [3, 5, 8, 9]
    assert ev(spark, px.average_422(arr(1, 2, 3), 3, 1)) == [2, 3]


def test_grid_with_a_missing_tile(spark):
    tiles = F.array(arr(1, 2, 3, 4), F.lit(None).cast("array<int>"))
    assert ev(spark, px.compose_grid(tiles, 1, 2, 2, 2, 3, 2)) == [1, 2, 0, 3, 4, 0]


def test_mask_bits_round_trip(spark):
    mask = [1, 0, 0, 1, 1, 1, 0, 1, 0, 1]
    assert ev(spark, px.pack_bits(arr(*mask))) == [0b10011101, 0b01000000]
    assert ev(spark, px.unpack_bits(px.pack_bits(arr(*mask)), 10)) == [255 * m for m in mask]


def test_psnr(spark):
    assert ev(spark, px.psnr(px.mean_squared_error(arr(1, 2), arr(1, 2)))) == 100.0
    assert ev(spark, px.mean_squared_error(arr(1, 2), arr(3, 2))) == 2.0


@pytest.mark.parametrize("matrix,full,bits", [(1, True, 8), (6, True, 8), (9, True, 10), (6, False, 8), (0, True, 8)])
def test_colour_round_trip(spark, matrix, full, bits):
    most = (1 << bits) - 1
    r, g, b = ([0, most, most // 2, most // 3, most], [0, most, most // 4, 7, 0], [0, most, 11, most // 2, most // 5])
    ycc = color.rgb_to_ycbcr(arr(*r), arr(*g), arr(*b), matrix, full, bits)
    back = ev(spark, px.let(ycc, lambda p: color.ycbcr_to_rgb(F.transform(p, lambda c: c["Y"]), F.transform(p, lambda c: c["Cb"]), F.transform(p, lambda c: c["Cr"]), matrix, full, bits)))
    for got, want in zip(back, zip(r, g, b, strict=True), strict=True):
        assert all(abs(x - y) <= 3 for x, y in zip(got, want, strict=True))


def test_unsupported_matrices(spark):
    for m in (11, 14):
        with pytest.raises(ValueError):
            color.ycbcr_to_rgb(arr(1), arr(1), arr(1), m)


def test_planner_finds_cheapest_pipelines():
    assert plan(State("ycbcr", "420"), State("ycbcr", "420")) == (0, [])
    cost, path = plan(State("ycbcr", "420"), State("rgb", "rgb24"))
    assert (cost, [s for s, _ in path]) == (11, ["ycbcr420_to_rgb24"])
    cost, path = plan(State("ycbcr", "444", bits=10), State("rgb", "rgb24"))
    assert cost == 33 and path[-1][1] == State("rgb", "rgb24")
    assert plan(State("ycbcr", "444", matrix=11), State("rgb", "planar", matrix=11)) is None
    assert plan(State("rgb", "planar", alpha=True), State("rgb", "rgb32", alpha=True))[0] == 11
    assert plan(State("bayer", "filter_array"), State("ycbcr", "420")) is not None


def test_chroma_conversions_preserve_constants(spark):
    v = arr(*[77] * 12)
    assert set(ev(spark, px.average_420(v, 4, 3))) == {77}
    assert set(ev(spark, px.bilinear_422(v, 8, 3))) == {77}
    assert set(ev(spark, px.demosaic(v, 4, 3, [["R", "G"], ["G", "B"]], "G"))) == {77}


def test_overlay_stack_equals_single_overlays(spark):
    layer = lambda x, y, v, a: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), v.alias("v"), a.alias("a"))
    none = F.lit(None).cast("array<int>")
    one, two, half = arr(10, 20, 30, 40), arr(200, 210, 220, 230), arr(128, 0, 255, 64)
    stack = F.array(layer(-1, 0, one, none), layer(1, 1, two, half))
    got = ev(spark, px.overlay_stack(px.filled(3, 3, 5), 3, 3, stack, 2, 2))
    assert got == ev(spark, px.overlay(px.overlay(px.filled(3, 3, 5), 3, 3, one, None, 2, 2, -1, 0), 3, 3, two, half, 2, 2, 1, 1))


def test_stored_tile_follows_the_pixels(spark):
    for steps in ([], [("irot", 90)], [("irot", 270), ("imir", 1)], [("imir", 0), ("irot", 90), ("imir", 1)], [("irot", 180)]):
        plane, w, h = arr(*range(6)), 3, 2
        for kind, v in steps:
            plane = px.mirror(plane, w, h, v == 1) if kind == "imir" else px.rotate_ccw(plane, w, h, v)
            w, h = (h, w) if kind == "irot" and v in (90, 270) else (w, h)
        shown = ev(spark, plane)
        props = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in steps]) if steps else F.array().cast("array<struct<kind:string,value:int>>")
        for y, x in itertools.product(range(h), range(w)):
            t = ev(spark, px.stored_tile(F.lit(x), F.lit(y), F.lit(w), F.lit(h), props))
            assert shown[y * w + x] == t.y * 3 + t.x


def test_pipeline_kernels_equal_column_functions(spark):
    """Every matrix and range, on planes of full size, against the expressions that SQL has checked."""
    from pixelloom.plans import color_pipeline as cp

    rng = np.random.default_rng(3)
    p = {c: rng.integers(0, 256, (5, 7)) for c in ("Y", "Cb", "Cr")}
    cols = [F.array(*[F.lit(int(v)) for v in p[c].ravel()]) for c in ("Y", "Cb", "Cr")]
    for matrix, full in ((0, True), (0, False), (1, True), (1, False), (6, True), (8, True), (9, False)):
        s = State("ycbcr", "444", matrix=matrix, full_range=full)
        got = cp.KERNELS["ycbcr_to_rgb"](p, s, s)
        want = spark.range(1).select(color.ycbcr_to_rgb(*cols, matrix, full).alias("x")).first().x
        assert [tuple(got[c].ravel()[i] for c in "RGB") for i in range(35)] == [tuple(v) for v in want]
        rgb = dict(zip("RGB", p.values(), strict=True))
        got = cp.KERNELS["rgb_to_ycbcr"](rgb, State("rgb", "planar"), s)
        want = spark.range(1).select(color.rgb_to_ycbcr(*cols, matrix, full).alias("x")).first().x
        assert [tuple(got[c].ravel()[i] for c in ("Y", "Cb", "Cr")) for i in range(35)] == [tuple(v) for v in want]


def test_pipelines_run_from_every_state(spark):
    from pixelloom.plans import color_pipeline as cp

    rng = np.random.default_rng(4)
    states = [State("mono", "mono"), State("mono", "mono", alpha=True), *(State("ycbcr", c, alpha=a, bits=b, alpha_bits=b if a else 8) for c in ("420", "422", "444") for a in (False, True) for b in (8, 10)), State("rgb", "planar"), State("rgb", "planar", alpha=True, bits=12, alpha_bits=12), State("rgb", "rgb24"), State("rgb", "rgb32", alpha=True), State("rgb", "rrggbb_be", bits=10), State("rgb", "rrggbb_le", bits=10), State("bayer", "filter_array")]
    targets = [State("rgb", "rgb24"), State("rgb", "planar"), State("ycbcr", "420"), State("ycbcr", "444"), State("ycbcr", "422", full_range=False)]
    ran = set()
    for s in states:
        for t in targets:
            if (found := plan(s, t)) is None:
                continue
            w, h = 7, 5
            names = cp.channels(s)
            p = {n: rng.integers(0, 1 << s.bits, cp.size_of(s, n, w, h)[::-1]) for n in names}
            out = cp.run(p, s, found[1])
            assert list(out) == cp.channels(t) and all(out[n].shape == cp.size_of(t, n, w, h)[::-1] and out[n].min() >= 0 and out[n].max() < 1 << t.bits for n in out)
            ran |= {n for n, _ in found[1]}
    assert len(ran) >= 14
    for w, h in ((4, 4), (7, 5), (1, 1), (2, 3)):
        c = rng.integers(0, 256, (-(-h // 2), -(-w // 2)))
        want = ev(spark, px.bilinear_420(arr(*map(int, c.ravel())), w, h))
        assert cp._bilinear(c, State("ycbcr", "420"), np.zeros((h, w))).ravel().tolist() == want


def test_pipelines_keep_to_a_chroma_algorithm(spark):
    from pixelloom.plans import color_pipeline as cp

    s, t = State("ycbcr", "420"), State("rgb", "rgb24")
    names = lambda steps: [n for n, _ in plan(s, t, steps)[1]]
    assert names(cp.STEPS) == ["ycbcr420_to_rgb24"] == names(cp.allowed(cp.STEPS, "nearest"))
    assert names(cp.allowed(cp.STEPS, "bilinear")) == ["bilinear_420_to_444", "ycbcr_to_rgb", "rgb_to_rgb24"]
    grey = np.full((3, 5), 77)
    got = cp.run({"Y": grey, "Cb": np.full((2, 3), 128), "Cr": np.full((2, 3), 128)}, s, plan(s, t, cp.allowed(cp.STEPS, "bilinear"))[1])
    assert (got["packed"] == 77).all()
    rows = spark.createDataFrame([(1, 2, 1, [b"\x01\x02"]), (2, 3, 1, [b"\x01"]), (3, None, 1, None), (4, 0, 0, [b""])], "id long, width int, height int, planes array<binary>")
    out = {r.id: (r.planes and [bytes(x) for x in r.planes], r.error is None) for r in cp.converted(rows, State("mono", "mono"), t, "id").collect()}
    assert out == {1: ([b"\x01\x01\x01\x02\x02\x02"], True), 2: (None, False), 3: (None, False), 4: ([b""], True)}
    with pytest.raises(ValueError):
        cp.converted(rows, State("ycbcr", "444", matrix=11), t, "id")
