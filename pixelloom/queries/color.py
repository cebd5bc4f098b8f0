"""Colour queries: an embedding's plane is Y (or R), its mirror Cb (or G), its inverse Cr (or B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import color
from pixelloom.operators import planes as px
from pixelloom.plans.color_planner import STEPS, State, plan
from pixelloom.queries.planes import P, images
from pixelloom.queries.registry import query

_THREE = f"WITH {P}, t AS (SELECT vec_id, x, y, v AS p, l[y * 8 + 8 - x] AS q, 255 - v AS r FROM p) "
_CLIP = "CAST(greatest(0, least(255, floor({} + 0.5))) AS INTEGER)"


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return images(spark, sf_dir).select("vec_id", v.alias("p"), px.mirror(v, 8, 8, True).alias("q"), F.transform(v, lambda x: 255 - x).alias("r"))


def long3(df: DataFrame, pixels: Column, names: tuple[str, str, str]) -> DataFrame:
    pos = F.col("pos")
    return df.select("vec_id", F.posexplode(pixels).alias("pos", "c")).select("vec_id", (pos % 8).cast("int").alias("x"), F.floor(pos / 8).cast("int").alias("y"), *[F.col(f"c.{n}").alias(n) for n in names])


def _rgb_sql(matrix: int, full: bool) -> str:
    kr, kb = color.weights(matrix)
    kg = 1 - kr - kb
    y, u, w = ("p * 1.0::DOUBLE", "(q - 128) * 1.0::DOUBLE", "(r - 128) * 1.0::DOUBLE") if full else (f"(p - 16.0::DOUBLE) * {color.LUMA_GAIN}::DOUBLE", f"(q - 128) * {color.CHROMA_GAIN}::DOUBLE", f"(r - 128) * {color.CHROMA_GAIN}::DOUBLE")
    r = f"{y} + {w} * {2 * (1 - kr)!r}::DOUBLE"
    g = f"{y} - {u} * {2 * kb * (1 - kb) / kg!r}::DOUBLE - {w} * {2 * kr * (1 - kr) / kg!r}::DOUBLE"
    b = f"{y} + {u} * {2 * (1 - kb)!r}::DOUBLE"
    return _THREE + f"SELECT vec_id, x, y, {_CLIP.format(r)} AS R, {_CLIP.format(g)} AS G, {_CLIP.format(b)} AS B FROM t"


for _matrix, _full in ((6, True), (1, False), (9, True)):
    query(f"color_ycbcr_to_rgb_m{_matrix}_{'full' if _full else 'limited'}", _rgb_sql(_matrix, _full))(
        lambda spark, sf_dir, m=_matrix, f=_full: long3(d := three(spark, sf_dir), color.ycbcr_to_rgb(d["p"], d["q"], d["r"], m, f), ("R", "G", "B"))
    )


def _ycbcr_sql(matrix: int, full: bool) -> str:
    kr, kb = color.weights(matrix)
    kg = 1 - kr - kb
    d = "{!r}::DOUBLE"
    y = f"p * {d.format(kr)} + q * {d.format(kg)} + r * {d.format(kb)}"
    u = f"p * {d.format(-kr / (1 - kb) / 2)} + q * {d.format(-kg / (1 - kb) / 2)} + r * 0.5::DOUBLE"
    v = f"p * 0.5::DOUBLE + q * {d.format(-kg / (1 - kr) / 2)} + r * {d.format(-kb / (1 - kr) / 2)}"
    if not full:
        y, u, v = f"({y}) * 219 / 256 + 16", f"({u}) * 224 / 256", f"({v}) * 224 / 256"
    return _THREE + f"SELECT vec_id, x, y, {_CLIP.format(y)} AS Y_, {_CLIP.format(u + ' + 128')} AS Cb, {_CLIP.format(v + ' + 128')} AS Cr FROM t"


for _matrix, _full in ((6, True), (1, False)):
    query(f"color_rgb_to_ycbcr_m{_matrix}_{'full' if _full else 'limited'}", _ycbcr_sql(_matrix, _full))(
        lambda spark, sf_dir, m=_matrix, f=_full: long3(d := three(spark, sf_dir), F.transform(color.rgb_to_ycbcr(d["p"], d["q"], d["r"], m, f), lambda c: F.struct(c["Y"].alias("Y_"), c["Cb"], c["Cr"])), ("Y_", "Cb", "Cr"))
    )

query("color_gbr_copy", _THREE + "SELECT vec_id, x, y, r AS R, p AS G, q AS B FROM t")(lambda spark, sf_dir: long3(d := three(spark, sf_dir), color.ycbcr_to_rgb(d["p"], d["q"], d["r"], 0), ("R", "G", "B")))

query(
    "color_ycgco_to_rgb",
    _THREE + "SELECT vec_id, x, y, " + ", ".join(f"CAST(greatest(0, least(255, {e})) AS INTEGER) AS {n}" for n, e in (("R", "p - (q - 128) + (r - 128)"), ("G", "p + (q - 128)"), ("B", "p - (q - 128) - (r - 128)"))) + " FROM t",
)(lambda spark, sf_dir: long3(d := three(spark, sf_dir), color.ycbcr_to_rgb(d["p"], d["q"], d["r"], 8), ("R", "G", "B")))

query(
    "color_rgb_to_ycgco",
    _THREE + "SELECT vec_id, x, y, CAST(q // 2 + (p + r) // 4 AS INTEGER) AS Y_, CAST(greatest(0, least(255, q // 2 - (p + r) // 4 + 128)) AS INTEGER) AS Cb, CAST(greatest(0, least(255, CASE WHEN p < r THEN -((r - p) // 2) ELSE (p - r) // 2 END + 128)) AS INTEGER) AS Cr FROM t",
)(lambda spark, sf_dir: long3(d := three(spark, sf_dir), F.transform(color.rgb_to_ycbcr(d["p"], d["q"], d["r"], 8), lambda c: F.struct(c["Y"].alias("Y_"), c["Cb"], c["Cr"])), ("Y_", "Cb", "Cr")))

query(
    "color_ycbcr_to_rgb_fixed",
    _THREE + "SELECT vec_id, x, y, CAST(greatest(0, least(255, p + ((359 * (r - 128) + 128) >> 8))) AS INTEGER) AS R, CAST(greatest(0, least(255, p + ((-88 * (q - 128) - 183 * (r - 128) + 128) >> 8))) AS INTEGER) AS G, CAST(greatest(0, least(255, p + ((454 * (q - 128) + 128) >> 8))) AS INTEGER) AS B FROM t",
)(lambda spark, sf_dir: long3(d := three(spark, sf_dir), color.ycbcr_to_rgb_fixed(d["p"], d["q"], d["r"]), ("R", "G", "B")))

query("color_mono_to_ycbcr", f"WITH {P} SELECT vec_id, x, y, v AS Y_, 128 AS Cb, 128 AS Cr FROM p")(lambda spark, sf_dir: long3(d := three(spark, sf_dir), F.transform(color.mono_to_ycbcr(d["p"]), lambda c: F.struct(c["Y"].alias("Y_"), c["Cb"], c["Cr"])), ("Y_", "Cb", "Cr")))

_FLAT = "SELECT vec_id, x, y, CAST((p * q + ({}) * (255 - q)) // 255 AS INTEGER) AS v FROM t"


def _flat(spark: SparkSession, sf_dir: str, background) -> DataFrame:
    from pixelloom.queries.planes import long

    d = three(spark, sf_dir)
    return long(d, px.flatten_alpha(d["p"], d["q"], background), 8)


query("color_flatten_alpha", _THREE + _FLAT.format("200"))(lambda spark, sf_dir: _flat(spark, sf_dir, 200))
query("color_flatten_checker", _THREE + _FLAT.format("CASE WHEN (x // 2 + y // 2) % 2 = 0 THEN 90 ELSE 160 END"))(lambda spark, sf_dir: _flat(spark, sf_dir, px.checkerboard(8, 2, 90, 160)))


@query("color_swap_endianness", f"WITH {P} SELECT vec_id, CAST(2 * (y * 8 + x) + k AS INTEGER) AS at, CAST(CASE WHEN k = 0 THEN (v * 4) & 255 ELSE (v * 4) >> 8 END AS INTEGER) AS byte FROM p, (SELECT unnest([0, 1]) AS k)")
def color_swap_endianness(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = color.swap_endianness(color.to_bytes(F.transform("v", lambda x: x * 4), 10))
    return images(spark, sf_dir).select("vec_id", F.posexplode(data).alias("at", "byte"))


@query("color_plan_costs", "SELECT * FROM (VALUES ('ycbcr420 to rgb24', 11, 'ycbcr420_to_rgb24'), ('mono to ycbcr444', 17, 'mono_to_ycbcr420 > bilinear_420_to_444'), ('rgb24 to itself', 0, ''), ('ycbcr420 limited to rgb24', 22, 'ycbcr_to_rgb > rgb_to_rgb24'), ('rgb with alpha to rgb24', 12, 'drop_alpha > rgb_to_rgb24')) AS t(conversion, cost, steps)")
def color_plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipelines that the planner chooses; no data are read."""
    rgb24 = State("rgb", "rgb24")
    asked = [
        ("ycbcr420 to rgb24", State("ycbcr", "420"), rgb24),
        ("mono to ycbcr444", State("mono", "mono"), State("ycbcr", "444")),
        ("rgb24 to itself", rgb24, rgb24),
        ("ycbcr420 limited to rgb24", State("ycbcr", "420", full_range=False), State("rgb", "rgb24", full_range=False)),
        ("rgb with alpha to rgb24", State("rgb", "planar", alpha=True), rgb24),
    ]
    rows = [(name, cost, " > ".join(s for s, _ in path)) for name, a, b in asked for cost, path in [plan(a, b, STEPS)]]
    return spark.createDataFrame(rows, "conversion string, cost int, steps string")


