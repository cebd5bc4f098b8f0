"""Plane queries: the 64 components of an embedding, quantised, are an 8 x 8 plane of 8 bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import planes as px
from pixelloom.queries.registry import query, table

#: The planes as lists l, and in long form, for oracles. A pixel of a plane is l[y * 8 + x + 1], so oracles need no join of pixels.
P = """e AS (SELECT vec_id, label, list_transform(embedding, lambda u: CAST(greatest(0, least(255, CAST(floor(CAST(u AS DOUBLE) * 224) AS BIGINT) + 128)) AS INTEGER)) AS l FROM embeddings),
 p AS (SELECT vec_id, label, l, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, l[i + 1] AS v FROM (SELECT *, unnest(range(64)) AS i FROM e))"""


def quantised(embedding: str = "embedding") -> Column:
    return F.transform(embedding, lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 224) + 128)).cast("int"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", quantised().alias("v"))


def long(df: DataFrame, plane: Column, w: int, key: str = "vec_id") -> DataFrame:
    """(key, x, y, v), for comparison by rows."""
    pos = F.col("pos")
    return df.select(key, F.posexplode(plane).alias("pos", "v")).select(key, (pos % w).cast("int").alias("x"), F.floor(pos / w).cast("int").alias("y"), F.col("v").cast("int").alias("v"))


def unary(name: str, w2: int, f, oracle: str):
    """A query that maps each plane by f to one of width w2."""
    query(name, f"WITH {P} {oracle}")(lambda spark, sf_dir: long(images(spark, sf_dir), f(F.col("v")), w2))


unary("plane_crop", 4, lambda v: px.crop(v, 8, 2, 1, 5, 6), "SELECT vec_id, x - 2 AS x, y - 1 AS y, v FROM p WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
unary("plane_rotate90", 8, lambda v: px.rotate_ccw(v, 8, 8, 90), "SELECT vec_id, y AS x, 7 - x AS y, v FROM p")
unary("plane_rotate180", 8, lambda v: px.rotate_ccw(v, 8, 8, 180), "SELECT vec_id, 7 - x AS x, 7 - y AS y, v FROM p")
unary("plane_rotate270", 8, lambda v: px.rotate_ccw(v, 8, 8, 270), "SELECT vec_id, 7 - y AS x, x AS y, v FROM p")
unary("plane_rotate90_wide", 4, lambda v: px.rotate_ccw(px.crop(v, 8, 0, 0, 7, 3), 8, 4, 90), "SELECT vec_id, y AS x, 7 - x AS y, v FROM p WHERE y < 4")
unary("plane_mirror_h", 8, lambda v: px.mirror(v, 8, 8, True), "SELECT vec_id, 7 - x AS x, y, v FROM p")
unary("plane_mirror_v", 8, lambda v: px.mirror(v, 8, 8, False), "SELECT vec_id, x, 7 - y AS y, v FROM p")
unary(
    "plane_scale_nn",
    5,
    lambda v: px.scale_nearest(v, 8, 8, 5, 3),
    "SELECT vec_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, v FROM p, (SELECT unnest(range(5)) AS gx) AS a, (SELECT unnest(range(3)) AS gy) AS b WHERE x = gx * 8 // 5 AND y = gy * 8 // 3",
)
unary(
    "plane_pad_edge",
    10,
    lambda v: px.pad_edge(v, 8, 8, 10, 9),
    "SELECT vec_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, v FROM p, (SELECT unnest(range(10)) AS gx) AS a, (SELECT unnest(range(9)) AS gy) AS b WHERE x = least(gx, 7) AND y = least(gy, 7)",
)
unary(
    "plane_pad_zero",
    10,
    lambda v: px.pad_value(v, 8, 8, 10, 9),
    "SELECT e.vec_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, coalesce(v, 0) AS v FROM embeddings AS e, (SELECT unnest(range(10)) AS gx) AS a, (SELECT unnest(range(9)) AS gy) AS b LEFT JOIN p ON p.vec_id = e.vec_id AND x = gx AND y = gy",
)
unary(
    "plane_extract_area",
    6,
    lambda v: px.clamped_area(v, 8, 8, 5, -2, 6, 5),
    "SELECT vec_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, v FROM p, (SELECT unnest(range(6)) AS gx) AS a, (SELECT unnest(range(5)) AS gy) AS b WHERE x = greatest(0, least(7, gx + 5)) AND y = greatest(0, least(7, gy - 2))",
)
unary(
    "plane_block_avg_420",
    4,
    lambda v: px.average_420(px.crop(v, 8, 0, 0, 6, 6), 7, 7),
    "SELECT vec_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, CAST((sum(v) + count(*) // 2) // count(*) AS INTEGER) AS v FROM p WHERE x < 7 AND y < 7 GROUP BY vec_id, x // 2, y // 2",
)
unary(
    "plane_block_avg_422",
    4,
    lambda v: px.average_422(px.crop(v, 8, 0, 0, 6, 7), 7, 8),
    "SELECT vec_id, CAST(x // 2 AS INTEGER) AS x, y, CAST((sum(v) + count(*) // 2) // count(*) AS INTEGER) AS v FROM p WHERE x < 7 GROUP BY vec_id, x // 2, y",
)
unary(
    "plane_bilinear_420",
    15,
    lambda v: px.bilinear_420(v, 15, 16),
    """, g AS (SELECT vec_id, l, CAST(k % 15 AS INTEGER) AS gx, CAST(k // 15 AS INTEGER) AS gy FROM (SELECT *, unnest(range(240)) AS k FROM e)),
    n AS (SELECT *, gx // 2 AS nx, gy // 2 AS ny, greatest(0, least(7, gx // 2 + CASE WHEN gx % 2 = 1 THEN 1 ELSE -1 END)) AS ox, greatest(0, least(7, gy // 2 + CASE WHEN gy % 2 = 1 THEN 1 ELSE -1 END)) AS oy FROM g),
    f AS (SELECT *, l[ny * 8 + nx + 1] AS a, l[ny * 8 + ox + 1] AS b, l[oy * 8 + nx + 1] AS c, l[oy * 8 + ox + 1] AS d FROM n)
    SELECT vec_id, gx AS x, gy AS y, CAST(CASE WHEN ox = nx AND oy = ny THEN a WHEN oy = ny THEN (3 * a + b + 2) // 4 WHEN ox = nx THEN (3 * a + c + 2) // 4
       ELSE (9 * a + 3 * b + 3 * c + d + 8) // 16 END AS INTEGER) AS v FROM f""",
)
unary(
    "plane_bilinear_422",
    16,
    lambda v: px.bilinear_422(v, 16, 8),
    """, g AS (SELECT vec_id, l, CAST(k % 16 AS INTEGER) AS gx, CAST(k // 16 AS INTEGER) AS gy FROM (SELECT *, unnest(range(128)) AS k FROM e)),
    f AS (SELECT *, gx // 2 AS nx, greatest(0, least(7, gx // 2 + CASE WHEN gx % 2 = 1 THEN 1 ELSE -1 END)) AS ox FROM g)
    SELECT vec_id, gx AS x, gy AS y, CAST(CASE WHEN ox = nx THEN l[gy * 8 + nx + 1] ELSE (3 * l[gy * 8 + nx + 1] + l[gy * 8 + ox + 1] + 2) // 4 END AS INTEGER) AS v FROM f""",
)
unary("plane_bitdepth_up", 8, lambda v: px.deeper(v, 8, 10), "SELECT vec_id, x, y, CAST((v << 2) | (v >> 6) AS INTEGER) AS v FROM p")
unary("plane_bitdepth_down", 8, lambda v: px.to_8_bits(F.transform(v, lambda x: x * 4 + 3), 10), "SELECT vec_id, x, y, CAST((v * 4 + 3) >> 2 AS INTEGER) AS v FROM p")
unary("plane_bitdepth_spread", 8, lambda v: px.to_8_bits(F.transform(v, lambda x: F.shiftright(x, 3)), 5), "SELECT vec_id, x, y, CAST(((v >> 3) * 33) >> 2 AS INTEGER) AS v FROM p")
unary("plane_interleaved_channel", 8, lambda v: px.channel_of(px.interleave([v, F.transform(v, lambda x: 255 - x), F.transform(v, lambda x: F.floor(x / 2).cast("int")), v]), 4, 1), "SELECT vec_id, x, y, 255 - v AS v FROM p")
unary("plane_mask_bits", 8, lambda v: px.unpack_bits(px.pack_bits(F.transform(v, lambda x: (x > 128).cast("int"))), 64), "SELECT vec_id, x, y, CAST(CASE WHEN v > 128 THEN 255 ELSE 0 END AS INTEGER) AS v FROM p")

_RGGB = [["R", "G"], ["G", "B"]]

query(
    "plane_demosaic_bayer",
    f"""WITH {P}, c AS (SELECT *, CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 'R' WHEN x % 2 = 1 AND y % 2 = 1 THEN 'B' ELSE 'G' END AS c FROM p), k AS (SELECT unnest(['R', 'G', 'B']) AS channel)
    SELECT a.vec_id, channel, a.x, a.y, CAST(CASE WHEN a.c = channel THEN any_value(a.v) ELSE (sum(b.v) + count(*) // 2) // count(*) END AS INTEGER) AS v
    FROM c AS a, k JOIN c AS b ON b.vec_id = a.vec_id AND b.c = channel AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.vec_id, channel, a.x, a.y, a.c""",
)(lambda spark, sf_dir: _demosaic(spark, sf_dir))


def _demosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir)
    parts = [long(rows, px.demosaic(F.col("v"), 8, 8, _RGGB, c), 8).withColumn("channel", F.lit(c)) for c in "RGB"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plane of an even id with that of the next id."""
    rows = images(spark, sf_dir)
    return rows.where("vec_id % 2 = 0").join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")


@query(
    "plane_overlay_alpha",
    f"""WITH {P} SELECT d.vec_id, d.x, d.y, CAST(CASE WHEN s.v IS NULL THEN d.v ELSE (s.v * (255 - s.v) + d.v * (255 - (255 - s.v))) // 255 END AS INTEGER) AS v
    FROM (SELECT p.* FROM p WHERE vec_id % 2 = 0 AND EXISTS (SELECT 1 FROM embeddings AS e WHERE e.vec_id = p.vec_id + 1)) AS d LEFT JOIN p AS s ON s.vec_id = d.vec_id + 1 AND s.x = d.x - 3 AND s.y = d.y + 2""",
)
def plane_overlay_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = F.transform("u", lambda x: 255 - x)
    return long(pairs(spark, sf_dir), px.overlay(F.col("v"), 8, 8, F.col("u"), alpha, 8, 8, 3, -2), 8)


@query(
    "plane_paste",
    f"""WITH {P} SELECT d.vec_id, d.x, d.y, coalesce(s.v, d.v) AS v
    FROM (SELECT p.* FROM p WHERE vec_id % 2 = 0 AND EXISTS (SELECT 1 FROM embeddings AS e WHERE e.vec_id = p.vec_id + 1)) AS d LEFT JOIN p AS s ON s.vec_id = d.vec_id + 1 AND s.x = d.x + 4 AND s.y = d.y - 5""",
)
def plane_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(pairs(spark, sf_dir), px.paste(F.col("v"), 8, 8, F.col("u"), 8, 8, -4, 5), 8)


@query(
    "plane_compose_grid",
    f"""WITH {P}, t AS (SELECT vec_id, vec_id // 4 AS grid, vec_id % 4 AS k FROM embeddings), g AS (SELECT DISTINCT grid FROM t)
    SELECT g.grid, CAST(cx AS INTEGER) AS x, CAST(cy AS INTEGER) AS y, coalesce(v, 0) AS v
    FROM g, (SELECT unnest(range(15)) AS cx) AS a, (SELECT unnest(range(13)) AS cy) AS b LEFT JOIN (SELECT grid, k, x, y, v FROM t JOIN p USING (vec_id)) AS q
    ON q.grid = g.grid AND q.k = cy // 8 * 2 + cx // 8 AND q.x = cx % 8 AND q.y = cy % 8""",
)
def plane_compose_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 4).alias("grid")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("vec_id") % 4).alias("k"), "v"))).alias("m"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda k: F.try_element_at("m", k))
    return long(rows, px.compose_grid(tiles, 2, 2, 8, 8, 15, 13), 15, "grid")


@query(
    "plane_mse",
    f"""WITH {P} SELECT a.vec_id, CAST(sum((a.v - b.v) * (a.v - b.v)) AS BIGINT) AS squares, CASE WHEN sum((a.v - b.v) * (a.v - b.v)) = 0 THEN 100.0
    ELSE round(least(100.0, greatest(0.0, 10 * log10(65025.0 / (sum((a.v - b.v) * (a.v - b.v)) / 64.0)))), 6) END AS psnr FROM p AS a JOIN p AS b ON b.vec_id = a.vec_id + 1 AND a.x = b.x AND a.y = b.y WHERE a.vec_id % 2 = 0 GROUP BY a.vec_id""",
)
def plane_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    mse = px.mean_squared_error(F.col("v"), F.col("u"))
    return pairs(spark, sf_dir).select("vec_id", (mse * 64).cast("long").alias("squares"), F.round(px.psnr(mse), 6).alias("psnr"))


@query("plane_depth", f"WITH {P} SELECT vec_id, CAST(max(CASE WHEN v < 2 THEN 1 ELSE floor(log2(v)) + 1 END) AS INTEGER) AS bits FROM p GROUP BY vec_id")
def plane_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("vec_id", F.greatest(F.lit(1), F.length(F.bin(F.array_max("v")))).alias("bits"))


@query(
    "plane_overlay_stack",
    f"""WITH {P}, g AS (SELECT vec_id, l, CAST(k % 10 AS INTEGER) AS gx, CAST(k // 10 AS INTEGER) AS gy FROM (SELECT *, unnest(range(90)) AS k FROM e)),
    f AS (SELECT *, CASE WHEN gx BETWEEN 1 AND 8 AND gy BETWEEN 1 AND 8 THEN l[(gy - 1) * 8 + gx] ELSE 50 END AS c, CASE WHEN gx <= 5 AND gy BETWEEN 3 AND 10 THEN l[(gy - 3) * 8 + 6 - gx] END AS s FROM g)
    SELECT vec_id, gx AS x, gy AS y, CAST(CASE WHEN s IS NULL THEN c ELSE (s * (255 - s) + c * (255 - (255 - s))) // 255 END AS INTEGER) AS v FROM f""",
)
def plane_overlay_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An opaque layer and a mirrored one with alpha on a canvas of 10 x 9."""
    none = F.lit(None).cast("array<int>")
    rows = images(spark, sf_dir).withColumn("m", px.mirror(F.col("v"), 8, 8, True))
    layers = F.array(
        F.struct(F.lit(1).alias("x"), F.lit(1).alias("y"), F.col("v").alias("v"), none.alias("a")),
        F.struct(F.lit(-2).alias("x"), F.lit(3).alias("y"), F.col("m").alias("v"), F.transform("m", lambda x: 255 - x).alias("a")),
    )
    return long(rows, px.overlay_stack(px.filled(10, 9, 50), 10, 9, layers, 8, 8), 10)


@query("plane_attach_alpha", f"WITH {P} SELECT vec_id, x, y, v, l[y // 2 * 8 + x // 2 + 1] AS a FROM p")
def plane_attach_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alpha plane of half the size, the upper left quarter, brought to the size of its image."""
    both = px.with_alpha(F.col("v"), 8, 8, px.crop(F.col("v"), 8, 0, 0, 3, 3), 4, 4)
    return images(spark, sf_dir).select("vec_id", F.posexplode(both).alias("pos", "b")).select("vec_id", (F.col("pos") % 8).cast("int").alias("x"), px.div(F.col("pos"), 8).cast("int").alias("y"), "b.v", "b.a")
