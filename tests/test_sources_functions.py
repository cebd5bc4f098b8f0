import itertools
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.functions import geometry as geo
from pixelloom.functions.bits import BitReader, BitWriter, nal_units, start_code_units, unescaped
from pixelloom.plans.codecs import Codec, Registry, decode
from pixelloom.plans.limits import LIMITS, n_tiles
from pixelloom.sources import isobmff, uncompressed, y4m


def ev(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_bit_reader_golden():
    r = BitReader(bytes([0x7F, 0xF1, 0x41, 0x87, 0x8F]))
    assert [r.bits(n) for n in (8, 4, 4, 3, 3, 11)] == [0x7F, 0xF, 0x1, 2, 0, 0b1100001111]


@given(st.lists(st.one_of(st.tuples(st.just("u"), st.integers(0, 100_000)), st.tuples(st.just("s"), st.integers(-50_000, 50_000)), st.tuples(st.integers(1, 40), st.integers(0, 2**40)))))
@settings(max_examples=60, deadline=None)
def test_bits_round_trip(values):
    w = BitWriter()
    for kind, v in values:
        w.unsigned(v) if kind == "u" else w.signed(v) if kind == "s" else w.bits(v, kind)
    r = BitReader(w.bytes())
    for kind, v in values:
        assert (r.unsigned() if kind == "u" else r.signed() if kind == "s" else r.bits(kind)) == (v if kind in ("u", "s") else v & ((1 << kind) - 1))
    with pytest.raises(ValueError):
        r.bits(9)


def test_units():
    assert list(nal_units(b"\0\0\0\2ab\0\0\0\1c")) == [b"ab", b"c"]
    with pytest.raises(ValueError):
        list(nal_units(b"\0\0\0\5ab"))
    assert list(start_code_units(b"\0\0\0\1ab\0\0\1c")) == [b"ab", b"c"]
    assert unescaped(b"a\0\0\3\1") == b"a\0\0\1"


def items():
    size = struct.pack(">III", 0, 64, 48)
    return [
        isobmff.Item(1, "grid", b"\0\0\0\1\0\x40\0\x30", "main", properties=[("ispe", size, False), ("irot", b"\1", True)], refs=[("dimg", [2, 3])]),
        isobmff.Item(2, "hvc1", b"first", properties=[("ispe", size, False)], hidden=True),
        isobmff.Item(3, "av01", b"", hidden=True),
        isobmff.Item(4, "Exif", b"meta" * 10, refs=[("cdsc", [1])]),
    ]


@pytest.fixture(scope="module")
def contents(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    data = isobmff.container(items())
    (d / "a.heic").write_bytes(data)
    (d / "broken.heic").write_bytes(data[:200])
    (d / "empty.heic").write_bytes(b"")
    return isobmff.files(spark, str(d))


def rows(df, name="a.heic"):
    return [tuple(r)[1:] for r in df.where(F.col("path").endswith(name)).collect()]


def test_container_tables(contents):
    assert [(r[4], r[2]) for r in rows(isobmff.table(contents, "boxes")) if r[2] <= 1] == [("ftyp", 0), ("meta", 0), ("hdlr", 1), ("pitm", 1), ("iinf", 1), ("iloc", 1), ("iprp", 1), ("iref", 1), ("mdat", 0)]
    assert rows(isobmff.table(contents, "brands")) == [("mif1", 0, 0, "mif1"), ("mif1", 0, 1, "heic")]
    assert [r[:2] + r[4:] for r in rows(isobmff.table(contents, "items"))] == [(1, "grid", False, True, True), (2, "hvc1", True, False, True), (3, "av01", True, False, True), (4, "Exif", False, False, False)]
    assert [(r[0], r[1]) for r in rows(isobmff.table(contents, "properties"))] == [(1, "ispe"), (2, "irot")]
    assert rows(isobmff.table(contents, "item_properties")) == [(1, 0, 1, False), (1, 1, 2, True), (2, 0, 1, False)]
    assert [r[1:] for r in rows(isobmff.table(contents, "item_refs"))] == [(1, "dimg", 0, 2), (1, "dimg", 1, 3), (4, "cdsc", 0, 1)]


def test_item_bytes_round_trip(contents):
    got = {r[0]: bytes(r[1]) for r in rows(isobmff.item_bytes(contents))}
    assert {k: v for k, v in got.items() if k != 3} == {1: items()[0].data, 2: b"first", 4: b"meta" * 10}


def test_broken_files_are_data(contents):
    boxes = rows(isobmff.table(contents, "boxes"), "broken.heic")
    assert any(r[-1] for r in boxes)
    assert rows(isobmff.table(contents, "boxes"), "empty.heic") == []


def test_sink_round_trip(spark):
    df = spark.createDataFrame([("x", 2, "mime", "b", b"two"), ("x", 1, "mime", "a", b"one"), ("y", 1, "mime", None, None)], "path string, item_id long, type string, name string, data binary")
    files = isobmff.containers(df).withColumn("length", F.length("content").cast("long"))
    assert sorted((r.path, r.item_id, r.name) for r in isobmff.table(files, "items").collect()) == [("x", 1, "a"), ("x", 2, "b"), ("y", 1, "")]
    assert {(r.path, r.item_id): bytes(r.data) for r in isobmff.item_bytes(files).where("path = 'x'").collect()} == {("x", 1): b"one", ("x", 2): b"two"}


def test_sequence_tables(spark):
    full, box, n = isobmff.full_box, isobmff.box, lambda *v: struct.pack(f">{len(v)}I", *v)
    stbl = box("stbl", full("stts", 0, 0, n(2, 3, 10, 1, 20)), full("ctts", 1, 0, n(1, 4, 2**32 - 5)), full("stsc", 0, 0, n(1, 1, 2, 1)), full("stsz", 0, 0, n(0, 2, 7, 8)), full("stco", 0, 0, n(2, 100, 200)), full("stss", 0, 0, n(1, 1)))
    trak = box("trak", full("tkhd", 0, 0, n(0, 0, 9), bytes(68)), box("mdia", full("mdhd", 0, 0, n(0, 0, 600, 50), bytes(4)), full("hdlr", 0, 0, n(0), b"pict", bytes(13)), box("minf", stbl)))
    df = spark.createDataFrame([("p", box("moov", trak))], "path string, content binary")
    assert rows(isobmff.table(df, "tracks"), "p") == [(9, "pict", 600, 50)]
    got = rows(isobmff.table(df, "sample_runs"), "p")
    assert got == [(9, "stts", 0, 3, 10), (9, "stts", 1, 1, 20), (9, "ctts", 0, 4, -5), (9, "stsc", 0, 1, 2), (9, "stsz", 0, 1, 7), (9, "stsz", 1, 1, 8), (9, "stco", 0, 1, 100), (9, "stco", 1, 1, 200), (9, "stss", 0, 1, 1)]


def test_inflate(spark):
    raw = zlib.compressobj(wbits=-15)
    df = spark.createDataFrame([(1, zlib.compress(b"abc"), "zlib"), (2, raw.compress(b"abc") + raw.flush(), "defl"), (3, b"x", None), (4, b"x", "zlib"), (5, None, "zlib")], "k long, data binary, how string")
    assert {r.k: r.data and bytes(r.data) for r in isobmff.inflated(df, "data", "how").collect()} == {1: b"abc", 2: b"abc", 3: b"x", 4: None, 5: None}


BLOCKS = [
    uncompressed.Layout(5, 3, (10, 12), "component", block_size=2),
    uncompressed.Layout(5, 3, (14,), "component", block_size=2, pad_lsb=True, block_little_endian=True, row_align=4),
    uncompressed.Layout(6, 4, (5, 6, 5), "pixel", "none", 3, 2, pixel_size=2),
    uncompressed.Layout(5, 3, (10, 10, 10), "pixel", pixel_size=4, block_size=4, pad_lsb=True, block_little_endian=True, block_reversed=True),
    uncompressed.Layout(5, 3, (8, 8, 8), "pixel", pixel_size=4, row_align=16, block_reversed=True),
    uncompressed.Layout(5, 3, (16, 16, 16), "pixel", pixel_size=8, pad_lsb=True),
]
LAYOUTS = [uncompressed.Layout(6, 4, d, i, s, *t) for d, (i, s), t in itertools.product([(8, 8, 8), (5, 6, 5), (7, 7, 7), (10, 10, 10), (16, 16, 16)], [("component", "none"), ("pixel", "none"), ("row", "none"), ("mixed", "420"), ("mixed", "422"), ("component", "420"), ("tile_component", "none")], [(1, 1), (3, 2)])]


@pytest.mark.parametrize("layout", [*LAYOUTS, *BLOCKS, uncompressed.Layout(5, 3, (8, 8), row_align=4), uncompressed.Layout(4, 2, (32,), kinds=("f",)), uncompressed.Layout(4, 2, (64,), kinds=("c",)), uncompressed.Layout(4, 2, (16, 16), little_endian=True), uncompressed.Layout(4, 2, (32,), kinds=("i",))])
def test_uncompressed_round_trip(layout):
    tw, th = layout.width // layout.tile_cols, layout.height // layout.tile_rows
    if layout.sampling != "none" and layout.tile_cols > 1:
        tw += tw % 2
    rng, planes = np.random.default_rng(1), []
    for c, d in enumerate(layout.depths):
        w, h = layout.plane(c, tw, th)
        shape = (h * layout.tile_rows, w * layout.tile_cols)
        planes.append((rng.normal(size=shape) if layout.kind(c) in "fc" else rng.integers(0, 1 << min(d, 31), shape)).astype(layout.dtype(c)))
    if layout.sampling != "none" and layout.tile_cols > 1 and layout.width // layout.tile_cols % 2 == 0:
        tw = layout.width // layout.tile_cols
    got = uncompressed.decode(layout, uncompressed.encode(layout, planes))
    assert all((a == b[: a.shape[0], : a.shape[1]]).all() for a, b in zip(got, planes, strict=True))


def test_words_golden(spark):
    one = lambda data, *a, **k: [p.item() for p in uncompressed.decode(uncompressed.Layout(1, 1, *a, **k), data)]
    word = 1 << 20 | 2 << 10 | 3
    assert one(word.to_bytes(4, "big"), (10, 10, 10), "pixel", pixel_size=4) == [1, 2, 3]
    assert one(word.to_bytes(4, "little"), (10, 10, 10), "pixel", pixel_size=4, block_little_endian=True, block_reversed=True) == [3, 2, 1]
    assert one((word << 2).to_bytes(4, "big"), (10, 10, 10), "pixel", pixel_size=4, pad_lsb=True) == [3, 2, 1]
    assert one((word << 2).to_bytes(4, "big"), (10, 10, 10), "pixel", pixel_size=4, pad_lsb=True, block_reversed=True) == [1, 2, 3]
    assert one(b"\x0a\xbc", (12,), "component", block_size=2) == [0xABC] == one(b"\xab\xc0", (12,), "component", block_size=2, pad_lsb=True) == one(b"\xbc\x0a", (12,), "component", block_size=2, block_little_endian=True)
    for bad in ({"interleave": "component", "block_size": 4}, {"interleave": "pixel", "pixel_size": 2, "block_size": 4}, {"interleave": "row", "block_size": 2}, {"interleave": "pixel", "pixel_size": 9}):
        with pytest.raises(ValueError):
            uncompressed.Layout(1, 1, (10,), **bad)
    layout = BLOCKS[2]
    planes = [[(7 * i + c) % (1 << d) for i in range(24)] for c, d in enumerate(layout.depths)]
    data = uncompressed.encoded(spark.createDataFrame([(1, planes), (2, planes[:2]), (3, None)], "id long, planes array<array<bigint>>"), layout, "id")
    got = uncompressed.decoded(data, layout, "id").collect()
    assert [(r.component, r.width, r.height, r.plane) for r in got if r.id == 1] == [(c, 6, 4, p) for c, p in enumerate(planes)]
    assert [r.error for r in got if r.id > 1] == ["end of data"] * 2


def test_uncompressed_golden_and_errors():
    rgb565 = uncompressed.Layout(1, 1, (5, 6, 5), "pixel")
    assert [p.item() for p in uncompressed.decode(rgb565, bytes([0b00001000, 0b11101101]))] == [1, 7, 13]
    with pytest.raises(ValueError):
        uncompressed.decode(rgb565, b"\0")
    with pytest.raises(ValueError):
        uncompressed.Layout(4, 4, (8,), "multi_y")


def test_y4m(spark):
    f = [[bytes(range(6)), b"ab", b"cd"], [bytes(6), b"ef", b"gh"]]
    data = y4m.compose(3, 2, f)
    assert [(n, w, h, p) for n, w, h, _, p in y4m.parse(data)] == [(0, 3, 2, f[0]), (1, 3, 2, f[1])]
    df = spark.createDataFrame([("a", data), ("cut", data[:-1]), ("other", b"x"), ("none", None)], "path string, content binary")
    assert sorted((r.path, r.frame) for r in y4m.frames(df).collect()) == [("a", 0), ("a", 1), ("cut", 0)]


def test_clean_aperture_golden(spark):
    box = geo.clean_aperture(F.lit(0), F.lit(0), *geo.centred_aperture(150, 250, 100, 200))
    assert tuple(ev(spark, box)) == (0, 0, 99, 199)
    box = geo.clean_aperture(F.lit(150), F.lit(250), *geo.centred_aperture(150, 250, 100, 200))
    assert tuple(ev(spark, box)) == (0, 0, 99, 199)


def test_fractions(spark):
    f = lambda n, d: geo.fraction(F.lit(n), F.lit(d))
    assert tuple(ev(spark, geo.add(f(1, 6), f(1, -3)))) == (-1, 6)
    assert tuple(ev(spark, geo.over(f(9, 6), 3))) == (1, 2)
    assert ev(spark, f(1, 0)) is None
    assert [ev(spark, geo.round_down(f(n, 2))) for n in (-3, 3)] == [-1, 1]
    assert [ev(spark, geo.round_near(f(n, 2))) for n in (3, 5, -4)] == [2, 3, -2]


def test_orientations_are_the_dihedral_group():
    c = geo.compose_orientations
    assert all(c(1, k) == c(k, 1) == k for k in range(1, 9))
    assert all(sorted(c(a, b) for b in range(1, 9)) == list(range(1, 9)) for a in range(1, 9))
    assert all(c(c(x, y), z) == c(x, c(y, z)) for x, y, z in itertools.product(range(1, 9), repeat=3))
    assert c(6, 6) == 3 and c(6, 8) == 1 and c(2, 2) == 1 and c(2, 3) == 4 and c(0, 3) == c(9, 1) == 1


def test_tai_packet_golden(spark):
    packet = geo.tai_bytes(F.lit(1234567890), F.lit(True), F.lit(False), F.lit(False))
    got = ev(spark, geo.tai_packet(packet))
    assert (int(got.ns), got.sync, got.failed, got.modified) == (1234567890, True, False, False)
    assert int(ev(spark, geo.tai_packet(F.lit(b"\xff" * 9))).ns) == 2**64 - 1


def test_codecs(spark):
    r = Registry()
    for name, p in (("low", 10), ("high", 150), ("mid", 100)):
        r.register(Codec(name, "AV1", p, lambda x, n=name: n.encode() + x))
    assert [c.name for c in r.listed("AV1", 2)] == ["high", "mid"]
    assert r.best("AV1", "low").name == "low" and r.best("AV1", "none").name == "high" and r.best("HEVC") is None
    df = spark.createDataFrame([(1, b"x")], "k long, data binary")
    assert bytes(decode(df, r, "AV1").first().decoded) == b"highx"
    assert decode(df, r, "HEVC").first().error == "unsupported codec: HEVC"


def test_limits():
    assert n_tiles([100, 50, 3], [30, 50, 1]) == 12
    assert LIMITS.allows("items", 1000) and not LIMITS.allows("items", 1001)
    for bad in ([10], [10, 10, 0], [1 << 20, 1 << 20]):
        with pytest.raises(ValueError):
            n_tiles(bad, [1] * len(bad))


REGIONS = [
    {"kind": "point", "x": 100, "y": 200},
    {"kind": "rectangle", "x": 150, "y": 250, "w": 30, "h": 50},
    {"kind": "polyline", "points": [{"x": 10, "y": 20}, {"x": 15, "y": 20}, {"x": 15, "y": 50}]},
    {"kind": "ellipse", "x": 350, "y": 450, "w": 60, "h": 80},
    {"kind": "polygon", "points": [{"x": 100, "y": 120}, {"x": 115, "y": 120}, {"x": 125, "y": 150}]},
    {"kind": "referenced_mask", "x": -5, "y": 6, "w": 7, "h": 8},
    {"kind": "inline_mask", "x": 1, "y": 2, "w": 5, "h": 3, "mask": b"\xaa\x80"},
]


@pytest.mark.parametrize("shift", [0, 100_000])
def test_regions_round_trip(spark, shift):
    from pixelloom.sources import regions

    own = [{**r, **({"x": r["x"] + shift} if "x" in r else {})} for r in REGIONS]
    data = regions.compose(1280, 1024, own)
    assert data[1] == (shift > 0)
    unknown = data[:2] + data[2:].replace(b"\x07", b"\x08\xff", 1)
    df = spark.createDataFrame([(1, data), (2, data[:-1]), (3, None), (4, unknown)], "item long, data binary")
    got = regions.regions(df, "item").collect()
    good = [r for r in got if r.item == 1]
    for r, want in zip(good, own, strict=True):
        assert (r.reference_w, r.reference_h, r.kind) == (1280, 1024, want["kind"])
        assert [r.x, r.y, r.w, r.h] == [want.get(k) for k in "xywh"]
        assert [p.asDict() for p in r.points or []] == want.get("points", [])
        assert (bytes(r.mask) if r.mask else None) == want.get("mask")
    assert [r.error is None for r in got if r.item == 2] == [True] * 6 + [False] and [r.error is None for r in got if r.item == 3] == [False]
    assert [r.kind for r in got if r.item == 4] == [r["kind"] for r in own]
    rows = [(1, n, 1280, 1024, r["kind"], *(r.get(k) for k in "xywh"), [(p["x"], p["y"]) for p in r["points"]] if "points" in r else None, r.get("mask")) for n, r in enumerate(own)]
    schema = "item long, ord int, reference_w long, reference_h long, kind string, x long, y long, w long, h long, points array<struct<x: long, y: long>>, mask binary"
    back = regions.region_items(spark.createDataFrame([*rows, (2, 0, -1, 0, "point", 1, 1, None, None, None, None)], schema), "item").collect()
    assert {r.item: r.data and bytes(r.data) for r in back} == {1: data, 2: None}


def test_exif_orientation():
    from pixelloom.sources import regions

    for order, mark in (("<", b"II"), (">", b"MM")):
        sub = struct.pack(order + "HHHIHHI", 1, regions.ORIENTATION, 3, 1, 6, 0, 0)
        main = struct.pack(order + "HHHIII", 1, regions.EXIF_DIRECTORY, 4, 1, 26, 0)
        exif = mark + struct.pack(order + "HI", 42, 8) + main + sub
        assert regions.orientation(exif) == 6
        assert regions.orientation(regions.with_orientation(exif, 3)) == 3
        loop = mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "HI", 0, 8)
        assert regions.orientation(loop) == 1
    assert regions.orientation(b"") == 1 and regions.with_orientation(b"xx", 3) == b"xx"


def test_exif_directories_that_follow_or_repeat(spark):
    from pixelloom.sources import regions

    d = lambda n, entries, after: struct.pack("<H", n) + entries + struct.pack("<I", after)
    entry = lambda tag, v: struct.pack("<HHIHH", tag, 3, 1, v, 0)
    chain = b"II*\0" + struct.pack("<I", 8) + d(0, b"", 14) + d(1, entry(1, 2), 32) + d(1, entry(regions.ORIENTATION, 8), 8)
    broken = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 500) + entry(regions.ORIENTATION, 5)
    df = spark.createDataFrame([(1, chain, 3), (2, broken, 9), (3, None, 2), (4, b"none", None)], "id long, exif binary, want int")
    got = {r.id: (r.orientation, regions.orientation(bytes(r.patched))) for r in regions.orientations(df, "id", "exif", "want").collect()}
    assert got == {1: (8, 3), 2: (5, 1), 3: (1, 1), 4: (1, 1)}


def test_cues_and_listing(spark, contents, tmp_path):
    from pixelloom.sources import regions

    (tmp_path / "a.vmt").write_text("HEADER\n\n00:01.500 --> 00:02.000\nYWJj\nZGVm\n\nnote\n\n01:00:00.000 --> 01:00:00.250\n!!!\n")
    got = [(r.cue, r.from_ms, r.to_ms, r.data and bytes(r.data)) for r in regions.cues(spark, str(tmp_path / "a.vmt")).orderBy("cue").collect()]
    assert got == [(0, 1500, 2000, b"abcdef"), (1, 3_600_000, 3_600_250, None)]
    lines = [r.text for r in regions.listing(isobmff.table(contents, "boxes")).where(F.col("path").endswith("a.heic")).orderBy("line").collect()]
    assert lines[0].startswith("Box: ftyp -----  size: ") and any(x.startswith("| | Box: ispe") or x.startswith("| | | Box: ispe") for x in lines)


@pytest.mark.parametrize("layout", [*LAYOUTS[::5], *BLOCKS])
def test_layout_property_round_trip(layout):
    from pixelloom.operators import derived

    full = uncompressed.Layout(**{**layout.__dict__, "kinds": layout.kinds or ("u",) * len(layout.depths)})
    assert derived.layout_of(derived.layout_payload(layout), layout.width, layout.height) == full


def test_layout_property_errors():
    from pixelloom.operators import derived

    assert derived.layout_of(bytes([1, 0, 0, 0]) + b"rgba", 4, 4).depths == (8, 8, 8, 8)
    good = derived.layout_payload(uncompressed.Layout(4, 4, (8,)))
    for bad in (bytes([1, 0, 0, 0]) + b"none", bytes([2]) + good[1:], good[:8] + bytes(4) + good[12:], good[:17] + b"\x07" + good[18:]):
        with pytest.raises(ValueError):
            derived.layout_of(bad, 4, 4)


def test_clean_aperture_equals_exact_fractions(spark):
    """Also where fractions aren't in lowest terms over the common denominator, and edges lie below zero."""
    import random
    from fractions import Fraction

    r = random.Random(1)
    rows = [tuple(r.randrange(*s) for s in ((0, 300), (0, 300), (1, 400), (1, 9), (1, 400), (1, 9), (-300, 300), (1, 9), (-300, 300), (1, 9))) for _ in range(400)]
    df = spark.createDataFrame(rows, "w int, h int, a int, b int, c int, d int, e int, f int, g int, i int")
    f = lambda n, d: geo.fraction(F.col(n), F.col(d))
    zero = lambda a, b: -(-a // b) if a < 0 else a // b
    near = lambda x: zero(x.numerator + x.denominator // 2, x.denominator)
    for q in df.select("*", geo.clean_aperture(F.col("w"), F.col("h"), f("a", "b"), f("c", "d"), f("e", "f"), f("g", "i")).alias("box")).collect():
        cw, ch = Fraction(q.a, q.b), Fraction(q.c, q.d)
        x, y = Fraction(q.e, q.f) + (q.w - cw) / 2, Fraction(q.g, q.i) + (q.h - ch) / 2
        left, top = (zero(x.numerator, x.denominator) if q.w else 0), (near(y) if q.h else 0)
        assert tuple(q.box) == (left, top, near(cw - 1 + left), near(ch - 1 + top))
