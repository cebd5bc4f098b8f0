"""Decoding by items: four embeddings are the uncompressed tiles of a file, which also holds a grid, a turned identity, an overlay and a clean aperture of them."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.derived import grid_payload, layout_payload, overlay_payload, pictures
from pixelloom.queries.pipelines import from_plane, to_plane
from pixelloom.queries.planes import P, images
from pixelloom.queries.registry import query
from pixelloom.sources import isobmff
from pixelloom.sources.uncompressed import Layout

#: Whole files of four embeddings, for oracles: t holds the lists of their tiles.
_TILES = f"WITH {P}, t AS (SELECT vec_id // 4 AS file, list(l ORDER BY vec_id) AS t FROM e GROUP BY 1 HAVING count(*) = 4)"
#: Items of a file that follow from its tiles 1 to 4, by their number.
GRID, IDENTITY, OVERLAY, APERTURE, BROKEN, CIRCLE = 5, 6, 7, 8, 9, 10


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prop = lambda kind, payload: F.struct(F.lit(kind).alias("type"), F.lit(payload).alias("payload"), F.lit(True).alias("essential"))
    ref = lambda *to: F.array(F.struct(F.lit("dimg").alias("type"), F.array(*[F.lit(x).cast("long") for x in to]).alias("to")))
    size = struct.pack(">III", 0, 8, 8)
    none = F.array().cast("array<struct<type: string, payload: binary, essential: boolean>>")
    item = lambda n, kind, data, properties, refs: F.struct(F.lit(n).cast("long").alias("item_id"), F.lit(kind).alias("type"), data.alias("data"), properties.alias("properties"), refs.alias("refs"))
    tiles = [item(k + 1, "unci", to_plane(F.get("tiles", F.lit(k))["v"]), F.array(prop("ispe", size), prop("uncC", layout_payload(Layout(8, 8, (8,))))), ref()) for k in range(4)]
    clap = struct.pack(">IIIIiIiI", 4, 1, 3, 1, 1, 1, -1, 2)
    derived = [
        item(GRID, "grid", F.lit(grid_payload(2, 2, 15, 13)), none, ref(1, 2, 3, 4)),
        item(IDENTITY, "iden", F.lit(b""), F.array(prop("irot", b"\x01"), prop("imir", b"\x01")), ref(2)),
        item(OVERLAY, "iovl", F.lit(overlay_payload((0x1000, 0x2000, 0x3000, 0xFFFF), 12, 10, [(1, 2), (-3, 4)])), none, ref(1, 4)),
        item(APERTURE, "iden", F.lit(b""), F.array(prop("clap", clap)), ref(3)),
        item(BROKEN, "grid", F.lit(grid_payload(2, 2, 15, 13)), none, ref(1, 2, 3)),
        item(CIRCLE, "iden", F.lit(b""), none, ref(CIRCLE)),
    ]
    rows = images(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 4).alias("file")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("tiles")).where("size(tiles) = 4")
    rows = rows.select(F.col("file").cast("string").alias("path"), F.explode(F.array(*tiles, *derived)).alias("i")).select("path", "i.*").withColumn("name", F.lit(""))
    return isobmff.containers(rows)


def _item(name: str, item: int, oracle: str):
    """A query of (file, plane, at, v) of one item of every file."""

    @query(name, _TILES + oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = pictures(files(spark, sf_dir)).where(F.col("item_id") == item).select(F.col("path").cast("long").alias("file"), F.posexplode("planes").alias("plane", "data"))
        return rows.select("file", "plane", F.posexplode(from_plane(F.col("data"))).alias("at", "v"))

    return run


def _pixels(w: int, h: int, value: str, planes: int = 1) -> str:
    """Rows of a picture whose value at (x, y) of plane c is an expression of them and t, one-based lists of pixels in row order."""
    return f" SELECT file, CAST(c AS INTEGER) AS plane, CAST(y * {w} + x AS INTEGER) AS at, CAST({value} AS INTEGER) AS v FROM t, (SELECT unnest(range({planes})) AS c), (SELECT unnest(range({w})) AS x), (SELECT unnest(range({h})) AS y)"


_item("item_grid", GRID, _pixels(15, 13, "t[y // 8 * 2 + x // 8 + 1][y % 8 * 8 + x % 8 + 1]"))
# Turned by 90 degrees counter-clockwise, then mirrored: the transposed tile is upside down and its columns are swapped.
_item("item_identity_turned", IDENTITY, _pixels(8, 8, "t[2][(7 - x) * 8 + (7 - y) + 1]"))
_item(
    "item_overlay",
    OVERLAY,
    _pixels(12, 10, "CASE WHEN x - -3 BETWEEN 0 AND 7 AND y - 4 BETWEEN 0 AND 7 THEN t[4][(y - 4) * 8 + x + 3 + 1] WHEN x - 1 BETWEEN 0 AND 7 AND y - 2 BETWEEN 0 AND 7 THEN t[1][(y - 2) * 8 + x - 1 + 1] ELSE [16, 32, 48][c + 1] END", 3),
)
# A width of 4 centred at 1 to the right starts at 2 + 1, a height of 3 centred at half a row up at round(2.5 - 0.5).
_item("item_clean_aperture", APERTURE, _pixels(4, 3, "t[3][(y + 2) * 8 + x + 3 + 1]"))


@query(
    "item_errors",
    _TILES
    + """ SELECT file, CAST(i AS BIGINT) AS item_id, CASE WHEN i <= 8 THEN 'picture' ELSE ['a grid of 2 x 2 has 3 tiles', 'an item is derived from itself'][i - 8] END AS outcome,
    CAST(CASE WHEN i IN (5) THEN 15 WHEN i = 7 THEN 12 WHEN i = 8 THEN 4 WHEN i < 9 THEN 8 END AS INTEGER) AS width FROM t, (SELECT unnest(range(1, 11)) AS i)""",
)
def item_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image item with its width or what is wrong with it."""
    return pictures(files(spark, sf_dir)).select(F.col("path").cast("long").alias("file"), "item_id", F.coalesce("error", F.lit("picture")).alias("outcome"), "width")
