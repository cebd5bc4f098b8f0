"""Geometry and scalar queries: keys of suppliers, parts and orders make up sizes, angles and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import geometry as geo
from pixelloom.queries.registry import query, table

_BOXES = "r AS (SELECT s_suppkey, CAST(s_suppkey * 3 AS DOUBLE) AS x, CAST(s_suppkey * 7 % 500 AS DOUBLE) AS y, CAST(1 + s_suppkey % 40 AS DOUBLE) AS w, CAST(1 + s_suppkey % 25 AS DOUBLE) AS h FROM supplier)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (k * 3).cast("double").alias("x"), (k * 7 % 500).cast("double").alias("y"), (1 + k % 40).cast("double").alias("w"), (1 + k % 25).cast("double").alias("h"))


@query("region_transform", f"WITH {_BOXES} SELECT s_suppkey, y * 2 AS x, x * 2 AS y, h * 2 AS w, w * 2 AS h FROM r")
def region_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of a 400 x 300 reference on an image of 800 x 600, mirrored and then turned by 90 degrees."""
    start = geo.identity(F.lit(800), F.lit(600), F.lit(400), F.lit(300))
    steps = F.array(F.struct(F.lit("imir").alias("kind"), F.lit(1).alias("value")), F.struct(F.lit("irot").alias("kind"), F.lit(90).alias("value")))
    t = geo.transformed(steps, start)
    rows = boxes(spark, sf_dir).withColumn("t", t)
    p, e = geo.point(F.col("t"), F.col("x"), F.col("y")), geo.extent(F.col("t"), F.col("w"), F.col("h"))
    return rows.select("s_suppkey", p["x"].alias("px"), p["y"].alias("py"), e["w"].alias("pw"), e["h"].alias("ph")).select("s_suppkey", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pw").alias("w"), F.col("ph").alias("h"))


@query(
    "clean_aperture",
    """SELECT p_partkey, CAST(trunc(l) AS BIGINT) AS left_, CAST(trunc(t + 0.5) AS BIGINT) AS top_, CAST(trunc(l) AS BIGINT) + cw - 1 AS right_, CAST(trunc(t + 0.5) AS BIGINT) + ch - 1 AS bottom_
    FROM (SELECT *, (w - cw) / 2.0 + (p_size % 5) / 2.0 AS l, (h - ch) / 2.0 AS t FROM (SELECT p_partkey, p_size, 200 + p_size AS w, 300 + p_partkey % 50 AS h, 50 + p_partkey % 90 AS cw, 60 + p_size AS ch FROM part))""",
)
def clean_aperture(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s, one = F.col("p_partkey"), F.col("p_size"), F.lit(1)
    box = geo.clean_aperture(200 + s, 300 + k % 50, geo.fraction(50 + k % 90, one), geo.fraction(60 + s, one), geo.fraction(s % 5, F.lit(2)), geo.fraction(F.lit(0), one))
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", *[F.col(f"b.{x}").alias(f"{x}_") for x in ("left", "top", "right", "bottom")])


@query(
    "fraction_sum",
    "SELECT p_partkey, CAST(n // gcd(abs(n), d) AS BIGINT) AS num, CAST(d // gcd(abs(n), d) AS BIGINT) AS den FROM (SELECT p_partkey, CAST(p_partkey % 97 * (p_size + 6) - 5 * (p_size + 4) AS BIGINT) AS n, CAST((p_size + 4) * (p_size + 6) AS BIGINT) AS d FROM part)",
)
def fraction_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    out = geo.subtract(geo.fraction(k % 97, s + 4), geo.fraction(F.lit(5), s + 6))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("f")).select("p_partkey", "f.num", "f.den")


@query(
    "orientation_concat",
    """SELECT f AS first, s AS second, CASE WHEN f > 8 THEN 1 ELSE list_position([[0, 0], [1, 0], [0, 2], [1, 2], [1, 3], [0, 1], [1, 1], [0, 3]], [(m1 + m2) % 2, ((CASE WHEN m2 = 1 THEN 4 - t1 ELSE t1 END) + t2) % 4]) END AS both
    FROM (SELECT unnest(range(1, 10))::INTEGER AS f), (SELECT unnest(range(1, 9))::INTEGER AS s), LATERAL (SELECT ([0, 1, 0, 1, 1, 0, 1, 0])[f] AS m1, ([0, 0, 2, 2, 3, 1, 1, 3])[f] AS t1, ([0, 1, 0, 1, 1, 0, 1, 0])[s] AS m2, ([0, 0, 2, 2, 3, 1, 1, 3])[s] AS t2)""",
)
def orientation_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 10).select(F.col("id").cast("int").alias("first"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("second"))
    return rows.withColumn("both", geo.concat_orientations(F.col("first"), F.col("second")))


@query("camera_intrinsics", "SELECT p_partkey, p_size / 50.0::DOUBLE * 640 AS fx, CASE WHEN p_size % 2 = 0 THEN p_size / 25.0::DOUBLE * 480 ELSE p_size / 50.0::DOUBLE * 640 END AS fy, 320.0::DOUBLE AS cx, 240.0::DOUBLE AS cy FROM part")
def camera_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    m = geo.absolute_intrinsics(s / 50, F.when(s % 2 == 0, s / 25), F.lit(0.5), F.lit(0.5), F.lit(640), F.lit(480))
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.*")


@query(
    "camera_rotation",
    """SELECT p_partkey, CAST(i AS INTEGER) AS i, round(CASE i WHEN 0 THEN 1 - 2 * (y * y + z * z) WHEN 1 THEN 2 * (x * y - z * w) WHEN 2 THEN 2 * (x * z + y * w) WHEN 3 THEN 2 * (x * y + z * w) WHEN 4 THEN 1 - 2 * (x * x + z * z)
    WHEN 5 THEN 2 * (y * z - x * w) WHEN 6 THEN 2 * (x * z - y * w) WHEN 7 THEN 2 * (y * z + x * w) ELSE 1 - 2 * (x * x + y * y) END, 9) + 0.0::DOUBLE AS v
    FROM (SELECT p_partkey, a / n AS x, b / n AS y, c / n AS z, 1 / n AS w FROM (SELECT *, sqrt(a * a + b * b + c * c + 1) AS n FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 7 AS DOUBLE) AS b, CAST(p_partkey % 11 AS DOUBLE) AS c FROM part))), (SELECT unnest(range(9)) AS i)""",
)
def camera_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"), (F.col("p_partkey") % 11).cast("double")
    n = F.sqrt(a * a + b * b + c * c + 1)
    m = geo.rotation_matrix(a / n, b / n, c / n, 1 / n)
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(m).alias("i", "v")).select("p_partkey", "i", (F.round("v", 9) + F.lit(0.0)).alias("v"))


@query("tai_decode", "SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ns, event_id % 2 = 0 AS sync, event_id % 3 = 0 AS failed, event_id % 5 = 0 AS modified FROM events")
def tai_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + k % 1000
    packet = geo.tai_packet(geo.tai_bytes(ns, k % 2 == 0, k % 3 == 0, k % 5 == 0))
    return table(spark, sf_dir, "events").select("event_id", packet.alias("p")).select("event_id", F.col("p.ns").cast("long").alias("ns"), "p.sync", "p.failed", "p.modified")


@query("cue_times", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey * 977 % 500000000 END AS ms FROM orders")
def cue_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("o_orderkey") * 977 % 500_000_000
    pad = lambda v, n: F.lpad(F.floor(v).cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000)
    text = F.concat(F.when(hours > 0, F.concat(F.format_string("%02d", hours), F.lit(":"))).otherwise(F.lit("")), pad(ms / 60_000 % 60, 2), F.lit(":"), pad(ms / 1000 % 60, 2), F.lit("."), pad(ms % 1000, 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", geo.cue_milliseconds(F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(text)).alias("ms"))


@query("fourcc_text", "SELECT p_partkey, chr(97 + CAST(p_partkey % 26 AS INTEGER)) || 'eic' AS code FROM part")
def fourcc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (97 + F.col("p_partkey") % 26) * 16_777_216 + F.lit(0x656963)
    return table(spark, sf_dir, "part").select("p_partkey", geo.fourcc(code).alias("code"))
