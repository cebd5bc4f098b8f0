"""Regions, clean aperture, orientation and cameras as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.operators.planes import let

# --- exact fractions: struct<num: bigint, den: bigint>, den > 0 ----------


def fraction(num: Column, den: Column) -> Column:
    """num / den in lowest terms; null for a denominator of 0."""

    def reduced(f: Column) -> Column:
        sign = F.when(f["den"] < 0, -1).otherwise(1)
        divisor = F.when(F.abs(f["den"]) == 1, F.lit(1).cast("long")).otherwise(gcd(F.abs(f["num"]), F.abs(f["den"])))
        return let(divisor, lambda g: F.when(f["den"] != 0, F.struct((sign * _quotient(f["num"], g)).alias("num"), _quotient(F.abs(f["den"]), g).alias("den"))))

    return let(F.struct(num.cast("long").alias("num"), den.cast("long").alias("den")), reduced)


def _both(p: Column, q: Column, f) -> Column:
    """f(p, q), each computed once."""
    return let(F.struct(p.alias("p"), q.alias("q")), lambda s: f(s["p"], s["q"]))


def _quotient(a: Column, b: Column) -> Column:
    """a / b where b divides a."""
    return (a.cast("decimal(20,0)") / F.when(b != 0, b).cast("decimal(20,0)")).cast("long")


def gcd(a: Column, b: Column) -> Column:
    """Of non-negative numbers, by the Euclidean algorithm: it ends after log2(smaller number) / log2(golden ratio) + 2 steps, and one that swaps."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
    steps = F.ceil(F.log2(F.least(a, b).cast("double") + 1) * 1.4405).cast("int") + 3
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["a"])


def add(p: Column, q: Column) -> Column:
    return _both(p, q, lambda p, q: fraction(p["num"] * q["den"] + q["num"] * p["den"], p["den"] * q["den"]))


def subtract(p: Column, q: Column) -> Column:
    return _both(p, q, lambda p, q: fraction(p["num"] * q["den"] - q["num"] * p["den"], p["den"] * q["den"]))


def over(p: Column, n: int) -> Column:
    return let(p, lambda p: fraction(p["num"], p["den"] * n))


def _floor_div(a: Column, b: Column) -> Column:
    """floor(a / b) for b > 0, in integers."""
    return ((a - F.pmod(a, b)).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")


def round_down(p: Column) -> Column:
    """Towards zero, as integer division does."""
    return let(p, lambda p: F.when(p["num"] < 0, -_floor_div(-p["num"], p["den"])).otherwise(_floor_div(p["num"], p["den"])))


def round_near(p: Column) -> Column:
    """(num + den / 2) / den with both divisions towards zero."""

    def near(p: Column) -> Column:
        n = p["num"] + _floor_div(p["den"], F.lit(2).cast("long"))
        return F.when(n < 0, -_floor_div(-n, p["den"])).otherwise(_floor_div(n, p["den"]))

    return let(p, near)


def clean_aperture(w: Column, h: Column, cw: Column, ch: Column, dx: Column, dy: Column) -> Column:
    """struct<left, top, right, bottom> of a clean aperture of size cw x ch (fractions) and offset dx, dy in an image of w x h.

    The left edge is rounded down, the top edge to the nearest; an empty
    image has its edges at 0.
    """
    pair = lambda num, den: F.struct(num.alias("num"), den.alias("den"))
    # offset + (size - aperture) / 2 over one denominator. Rounding down needs no lowest terms; rounding to the nearest only
    # below zero, where it is by halves of the denominator.
    edge = lambda size, offset, aperture: pair(offset["num"] * aperture["den"] * 2 + (size.cast("long") * aperture["den"] - aperture["num"]) * offset["den"], offset["den"] * aperture["den"] * 2)
    nearest = lambda f: let(f, lambda f: F.when(f["num"] >= 0, _floor_div(f["num"] + _floor_div(f["den"], F.lit(2).cast("long")), f["den"])).otherwise(round_near(fraction(f["num"], f["den"]))))
    far = lambda aperture, near: nearest(pair(aperture["num"] - aperture["den"] + near * aperture["den"], aperture["den"]))

    def corners(f: Column) -> Column:
        near = F.struct(
            F.when(w == 0, F.lit(0).cast("long")).otherwise(round_down(edge(w, f["dx"], f["cw"]))).alias("left"),
            F.when(h == 0, F.lit(0).cast("long")).otherwise(nearest(edge(h, f["dy"], f["ch"]))).alias("top"),
        )
        return let(near, lambda n: F.struct(n["left"].alias("left"), n["top"].alias("top"), far(f["cw"], n["left"]).alias("right"), far(f["ch"], n["top"]).alias("bottom")))

    return let(F.struct(cw.alias("cw"), ch.alias("ch"), dx.alias("dx"), dy.alias("dy")), corners)


def centred_aperture(w: int, h: int, cw: int, ch: int) -> tuple[Column, Column, Column, Column]:
    """The aperture of cw x ch that starts at the image's top left: sizes and offsets as fractions."""
    f = lambda n, d: fraction(F.lit(n), F.lit(d))
    return f(cw, 1), f(ch, 1), f(cw - w, 2), f(ch - h, 2)


# --- affine transforms: struct<a, b, c, d, tx, ty, w, h> -----------------


def identity(w: Column, h: Column, reference_w: Column, reference_h: Column) -> Column:
    """The scale from a region's reference size to an image of w x h."""
    one = lambda v: v.cast("double")
    zero = F.lit(0.0)
    return F.struct((one(w) / one(reference_w)).alias("a"), zero.alias("b"), zero.alias("c"), (one(h) / one(reference_h)).alias("d"), zero.alias("tx"), zero.alias("ty"), one(w).alias("w"), one(h).alias("h"))


def _struct(**v: Column) -> Column:
    return F.struct(*[x.alias(k) for k, x in v.items()])


def mirrored(t: Column, horizontal: bool) -> Column:
    if horizontal:
        return _struct(a=-t["a"], b=-t["b"], c=t["c"], d=t["d"], tx=t["w"] - 1 - t["tx"], ty=t["ty"], w=t["w"], h=t["h"])
    return _struct(a=t["a"], b=t["b"], c=-t["c"], d=-t["d"], tx=t["tx"], ty=t["h"] - 1 - t["ty"], w=t["w"], h=t["h"])


def rotated(t: Column, angle: int) -> Column:
    """Counter-clockwise."""
    if angle == 90:
        return _struct(a=t["c"], b=t["d"], c=-t["a"], d=-t["b"], tx=t["ty"], ty=t["w"] - 1 - t["tx"], w=t["h"], h=t["w"])
    if angle == 180:
        return mirrored(mirrored(t, True), False)
    if angle == 270:
        return _struct(a=-t["c"], b=-t["d"], c=t["a"], d=t["b"], tx=t["h"] - 1 - t["ty"], ty=t["tx"], w=t["h"], h=t["w"])
    return t


def cropped(t: Column, left: Column, top: Column, w: Column, h: Column) -> Column:
    return _struct(a=t["a"], b=t["b"], c=t["c"], d=t["d"], tx=t["tx"] - left, ty=t["ty"] - top, w=w.cast("double"), h=h.cast("double"))


def transformed(properties: Column, start: Column) -> Column:
    """properties, an ordered array<struct<kind, value>> (imir 0 vertical or 1 horizontal, irot an angle), folded over start."""

    def step(t: Column, p: Column) -> Column:
        out = F.when((p["kind"] == "imir") & (p["value"] == 1), mirrored(t, True)).when(p["kind"] == "imir", mirrored(t, False))
        for angle in (90, 180, 270):
            out = out.when((p["kind"] == "irot") & (p["value"] == angle), rotated(t, angle))
        return out.otherwise(t)

    return F.aggregate(properties, start, step)


def point(t: Column, x: Column, y: Column) -> Column:
    return F.struct((x * t["a"] + y * t["b"] + t["tx"]).alias("x"), (x * t["c"] + y * t["d"] + t["ty"]).alias("y"))


def extent(t: Column, w: Column, h: Column) -> Column:
    return F.struct((w * t["a"] + h * t["b"]).alias("w"), (w * t["c"] + h * t["d"]).alias("h"))


# --- orientation ---------------------------------------------------------
# An orientation 1 ... 8 is a mirroring (2, 4, 5, 7) and a number of clockwise quarter turns.


def _turns() -> list[tuple[int, int]]:
    """(mirrored first, clockwise quarter turns) of each orientation."""
    return [(0, 0), (1, 0), (0, 2), (1, 2), (1, 3), (0, 1), (1, 1), (0, 3)]


def compose_orientations(first: int, second: int) -> int:
    """The orientation of one followed by the other; 1 for numbers outside of 1 ... 8."""
    if not (1 <= first <= 8 and 1 <= second <= 8):
        return 1
    (m, t), (n, u) = _turns()[first - 1], _turns()[second - 1]
    # A mirroring that follows turns is one that comes before them, turned the other way round.
    return _turns().index(((m + n) % 2, ((-t if n else t) + u) % 4)) + 1


def concat_orientations(first: Column, second: Column) -> Column:
    pairs = [(F.lit(f * 10 + s), F.lit(compose_orientations(f, s))) for f in range(1, 9) for s in range(1, 9)]
    return F.coalesce(F.try_element_at(F.create_map(*[x for p in pairs for x in p]), first * 10 + second), F.lit(1))


# --- cameras and time ----------------------------------------------------


def absolute_intrinsics(focal_x: Column, focal_y: Column, centre_x: Column, centre_y: Column, w: Column, h: Column) -> Column:
    """struct<fx, fy, cx, cy> in pixels; focal_y null means square pixels."""
    fx = focal_x * w
    return F.struct(fx.alias("fx"), F.coalesce(focal_y * h, fx).alias("fy"), (centre_x * w).alias("cx"), (centre_y * h).alias("cy"))


def rotation_matrix(x: Column, y: Column, z: Column, w: Column) -> Column:
    """array<double> of 9, in rows, from a unit quaternion."""
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def unsigned(data: Column, start: int, size: int) -> Column:
    """A big-endian unsigned number of a binary column, as decimal(20,0); start counts from 0."""
    return F.conv(F.hex(F.substring(data, start + 1, size)), 16, 10).cast("decimal(20,0)")


def tai_packet(data: Column) -> Column:
    """struct<ns, sync, failed, modified> of a timestamp packet: 8 bytes and a byte of flags from the highest bit down."""
    flags = F.conv(F.hex(F.substring(data, 9, 1)), 16, 10).cast("int")
    return F.struct(unsigned(data, 0, 8).alias("ns"), (flags.bitwiseAND(128) != 0).alias("sync"), (flags.bitwiseAND(64) != 0).alias("failed"), (flags.bitwiseAND(32) != 0).alias("modified"))


def tai_bytes(ns: Column, sync: Column, failed: Column, modified: Column) -> Column:
    """The packet of a timestamp below 2**63."""
    flags = F.when(sync, 128).otherwise(0) + F.when(failed, 64).otherwise(0) + F.when(modified, 32).otherwise(0)
    return F.unhex(F.concat(F.lpad(F.hex(ns.cast("long")), 16, "0"), F.lpad(F.hex(flags), 2, "0")))


def cue_milliseconds(text: Column) -> Column:
    """Milliseconds of a cue time, hh:mm:ss.mmm or mm:ss.mmm; null for other text."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^(?:(\d+):)?(\d\d):(\d\d)\.(\d{3})$", i), F.lit("")).cast("long")
    return (F.coalesce(part(1), F.lit(0)) * 60 + part(2)) * 60_000 + part(3) * 1000 + part(4)


def fourcc(code: Column) -> Column:
    """The four letters of a 32-bit number."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "ISO-8859-1")
