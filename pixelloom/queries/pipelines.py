"""Colour pipelines that are planned and run: an embedding's plane is luma (or red), others follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.color import weights
from pixelloom.operators import planes as px
from pixelloom.plans.color_pipeline import allowed, converted
from pixelloom.plans.color_planner import STEPS, State
from pixelloom.queries.planes import P, images
from pixelloom.queries.registry import query


def to_plane(values: Column, size: int = 1) -> Column:
    """array<int> as a plane of bytes, or of two bytes a sample, lowest first."""
    if size == 1:
        return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return F.unhex(F.array_join(F.transform(values, lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.shiftright(v, 8)), 2, "0"))), ""))


def from_plane(plane: Column, size: int = 1) -> Column:
    digits = F.hex(plane)
    byte = lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    n = F.sequence(F.lit(0), (F.length(digits) / (2 * size) - 1).cast("int"))
    return F.transform(n, byte if size == 1 else lambda i: byte(2 * i) + 256 * byte(2 * i + 1))


def half(v: Column, down: bool = True) -> Column:
    """Every second sample of an 8 x 8 plane, and of its rows."""
    return F.filter(v, lambda x, i: (i % 2 == 0) & ((px.div(i, 8) % 2 == 0) if down else F.lit(True)))


def _register(name: str, oracle: str, source: State, target: State, planes, steps=None, sizes: tuple[int, int] = (1, 1), alpha: int | None = None) -> None:
    """A query of (vec_id, plane, at, v) of converted pictures; planes are functions of v, sizes the bytes of a sample before and after, alpha those of the last plane before, if it has others."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = images(spark, sf_dir).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.array(*[to_plane(p(F.col("v")), alpha or sizes[0] if p is planes[-1] else sizes[0]) for p in planes]).alias("planes"))
        out = converted(rows, source, target, "vec_id", steps).select("vec_id", F.posexplode("planes").alias("plane", "data"))
        return out.select("vec_id", "plane", F.posexplode(from_plane(F.col("data"), sizes[1])).alias("at", "v"))

    query(name, f"WITH {P}, q AS (SELECT vec_id, x, y, l, v, l[y // 2 * 16 + x // 2 * 2 + 1] AS n FROM p) {oracle}")(run)


def _packed(values: list[str], source: str = "q") -> str:
    """Interleaved channels of each pixel as rows."""
    n = len(values)
    return f"SELECT vec_id, 0 AS plane, CAST((y * 8 + x) * {n} + k AS INTEGER) AS at, CAST([{', '.join(values)}][k + 1] AS INTEGER) AS v FROM {source}, (SELECT unnest(range({n})) AS k)"


_inverse = lambda v: F.transform(v, lambda x: 255 - x)
_same = lambda v: v
_small = [_same, lambda v: half(_inverse(v)), lambda v: half(v)]
_c8 = "greatest(0, least(255, {}))"
_FIXED = [_c8.format(e) for e in ("v + ((359 * (n - 128) + 128) >> 8)", "v + ((-88 * (127 - n) - 183 * (n - 128) + 128) >> 8)", "v + ((454 * (127 - n) + 128) >> 8)")]

_register("color_pipeline_420_to_rgb24", _packed(_FIXED), State("ycbcr", "420"), State("rgb", "rgb24"), _small)
_register("color_pipeline_420_to_rgb32", _packed([*_FIXED, "255 - v"]), State("ycbcr", "420", alpha=True), State("rgb", "rgb32", alpha=True), [*_small, _inverse])
_register("color_pipeline_mono_to_rgb24", _packed(["v"] * 3), State("mono", "mono"), State("rgb", "rgb24"), [_same])
_register("color_pipeline_mono_to_rgb32", _packed(["v"] * 3 + ["255 - v"]), State("mono", "mono", alpha=True), State("rgb", "rgb32", alpha=True), [_same, _inverse])
_register("color_pipeline_drop_alpha", _packed(["v", "255 - v", "v"]), State("rgb", "planar", alpha=True), State("rgb", "rgb24"), [_same, _inverse, _same, _inverse])

_kr, _kb = weights(6)
_kg = 1 - _kr - _kb
_deep = "CAST(greatest(0, least(1023, floor({} + 0.5))) AS INTEGER)"
_REAL = [_deep.format(e) for e in (f"v * 4 + {2 * (1 - _kr)!r}::DOUBLE * (n * 4 - 512)", f"v * 4 - {2 * _kb * (1 - _kb) / _kg!r}::DOUBLE * (508 - n * 4) - {2 * _kr * (1 - _kr) / _kg!r}::DOUBLE * (n * 4 - 512)", f"v * 4 + {2 * (1 - _kb)!r}::DOUBLE * (508 - n * 4)")]
_ten = lambda f: lambda v: F.transform(f(v), lambda x: x * 4)
_register("color_pipeline_420_to_rrggbb", _packed(_REAL), State("ycbcr", "420", bits=10), State("rgb", "rrggbb_be", bits=10), [_ten(p) for p in _small], sizes=(2, 2))

#: Luma of each pixel, and chroma of a block's first pixel, of red v, green 255 - v and blue v, all times 4.
_FROM_RGB = " UNION ALL ".join(
    [
        f"SELECT vec_id, 0 AS plane, y * 8 + x AS place, {_deep.format(f'v * 4 * {_kr!r}::DOUBLE + (1020 - v * 4) * {_kg!r}::DOUBLE + v * 4 * {_kb!r}::DOUBLE')} AS v FROM q",
        *[
            f"SELECT vec_id, {k}, y // 2 * 4 + x // 2, {_deep.format(e + ' + 512')} FROM q WHERE x % 2 = 0 AND y % 2 = 0"
            for k, e in (
                (1, f"v * 4 * {-_kr / (1 - _kb) / 2!r}::DOUBLE + (1020 - v * 4) * {-_kg / (1 - _kb) / 2!r}::DOUBLE + v * 4 * 0.5::DOUBLE"),
                (2, f"v * 4 * 0.5::DOUBLE + (1020 - v * 4) * {-_kg / (1 - _kr) / 2!r}::DOUBLE + v * 4 * {-_kb / (1 - _kr) / 2!r}::DOUBLE"),
            )
        ],
    ]
)
_register(
    "color_pipeline_rrggbb_to_420",
    f"SELECT vec_id, CAST(plane AS INTEGER) AS plane, CAST(place AS INTEGER) AS at, v FROM ({_FROM_RGB})",
    State("rgb", "rrggbb_le", bits=10),
    State("ycbcr", "420", bits=10),
    [lambda v: F.flatten(F.transform(v, lambda x: F.array(x * 4, 1020 - x * 4, x * 4)))],
    allowed(STEPS, downsampling="nearest"),
    (2, 2),
)
_register(
    "color_pipeline_alpha_depth",
    "SELECT vec_id, CAST(k AS INTEGER) AS plane, CAST(y * 8 + x AS INTEGER) AS at, CAST(CASE k WHEN 1 THEN (((v << 2) | (v >> 6))) ELSE v * 4 END AS INTEGER) AS v FROM q, (SELECT unnest(range(2)) AS k)",
    State("mono", "mono", alpha=True, bits=10, alpha_bits=8),
    State("mono", "mono", alpha=True, bits=10, alpha_bits=10),
    [_ten(_same), lambda v: F.transform(v, lambda x: x)],
    sizes=(2, 2),
    alpha=1,
)
