"""Container queries: eight documents are the items of a file, events of a user the samples of a movie, embeddings are pictures; all are written to bytes and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.operators import metadata as meta
from pixelloom.operators import sequence as seq
from pixelloom.queries.planes import P, images
from pixelloom.queries.registry import query, table
from pixelloom.queries.sequence import _RUNS, _SAMPLES, samples
from pixelloom.sources import isobmff, regions, uncompressed

#: Items for oracles: doc_id // 8 names the file, the rest is the item's number; types and properties follow from the id.
_ITEMS = """
i AS (SELECT 'f' || (doc_id // 8) AS path, doc_id % 8 + 1 AS item_id, doc_id, ['hvc1', 'av01', 'grid', 'mime', 'Exif'][doc_id % 5 + 1] AS type, coalesce(lang, '') AS name,
      doc_id % 7 = 0 AS hidden, doc_id % 3 = 0 AS wanted, coalesce(text, '') AS text FROM documents),
props AS (SELECT path, item_id, 0 AS ord, 'ispe' AS type, lpad(to_hex(doc_id % 4), 24, '0') AS payload, false AS essential FROM i
 UNION ALL SELECT path, item_id, 1, 'irot', lpad(to_hex(doc_id % 3), 2, '0'), true FROM i WHERE doc_id % 2 = 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY place) AS prop_idx FROM (SELECT path, type, payload, min(item_id * 10 + ord) AS place FROM props GROUP BY path, type, payload))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("hvc1", "av01", "grid", "mime", "Exif")))
    prop = lambda kind, n, digits, essential: F.struct(F.lit(kind).alias("type"), F.unhex(F.lpad(F.hex(k % n), digits, "0")).alias("payload"), F.lit(essential).alias("essential"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("f"), F.floor(k / 8)).alias("path"),
        (k % 8 + 1).alias("item_id"),
        F.get(kinds, (k % 5).cast("int")).alias("type"),
        F.coalesce("lang", F.lit("")).alias("name"),
        F.coalesce("text", F.lit("")).cast("binary").alias("data"),
        (k % 7 == 0).alias("hidden"),
        (k % 3 == 0).alias("is_primary"),
        F.when(k % 2 == 0, F.array(prop("ispe", 4, 24, False), prop("irot", 3, 2, True))).otherwise(F.array(prop("ispe", 4, 24, False))).alias("properties"),
        F.when(k % 8 > 0, F.array(F.struct(F.when(k % 5 == 4, "cdsc").otherwise("thmb").alias("type"), F.array((k % 8).cast("long"), F.lit(1).cast("long")).alias("to")))).alias("refs"),
        F.when(k % 2 == 1, F.array(F.struct(F.lit("altr").alias("type"), (100 + k % 4).cast("long").alias("group_id")))).alias("groups"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.containers(items(spark, sf_dir))


@query(
    "container_items",
    f"""WITH {_ITEMS}, p AS (SELECT path, coalesce(min(CASE WHEN wanted THEN item_id END), min(item_id)) AS main FROM i GROUP BY path)
    SELECT path, item_id, type, name, hidden, item_id = main AS is_primary, type IN ('hvc1', 'av01', 'grid') AS is_image FROM i JOIN p USING (path)""",
)
def container_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.table(files(spark, sf_dir), "items").drop("content_type")


@query("container_item_bytes", f"WITH {_ITEMS} SELECT path, item_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size FROM i")
def container_item_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.item_bytes(files(spark, sf_dir)).select("path", "item_id", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("size"))


@query(
    "container_extents",
    f"""WITH {_ITEMS} SELECT path, item_id, 0 AS ord, 0 AS method, CAST(sum(strlen(text)) OVER (PARTITION BY path ORDER BY item_id) - strlen(text) AS BIGINT) AS after_first, CAST(strlen(text) AS BIGINT) AS length FROM i""",
)
def container_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each item's bytes lie behind those of its file's first item."""
    rows = isobmff.table(files(spark, sf_dir), "extents")
    return rows.select("path", "item_id", "ord", "method", (F.col("offset") - F.min("offset").over(W.partitionBy("path"))).alias("after_first"), "length")


@query("container_brands", f"WITH {_ITEMS} SELECT DISTINCT path, 'mif1' AS major, CAST(0 AS BIGINT) AS minor, CAST(k AS INTEGER) AS ord, ['mif1', 'heic'][k + 1] AS brand FROM i, (SELECT unnest(range(2)) AS k)")
def container_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.table(files(spark, sf_dir), "brands")


@query("container_properties", f"WITH {_ITEMS} SELECT path, CAST(prop_idx AS INTEGER) AS prop_idx, type, upper(payload) AS payload FROM firsts")
def container_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal properties of a file's items are stored once."""
    return isobmff.table(files(spark, sf_dir), "properties").select("path", "prop_idx", "type", F.hex("payload").alias("payload"))


@query("container_item_properties", f"WITH {_ITEMS} SELECT path, item_id, ord, CAST(prop_idx AS INTEGER) AS prop_idx, essential FROM props JOIN firsts USING (path, type, payload)")
def container_item_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.table(files(spark, sf_dir), "item_properties")


@query(
    "container_props_in_order",
    f"WITH {_ITEMS} SELECT path || '#' || item_id AS item, type, upper(payload) AS payload, essential, false AS dangling, CAST(row_number() OVER (PARTITION BY path, item_id ORDER BY ord) AS INTEGER) AS pos FROM props",
)
def container_props_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's properties through its links: the tables of a file, joined again."""
    content = files(spark, sf_dir)
    links = isobmff.table(content, "item_properties").withColumn("item", F.concat_ws("#", "path", "item_id")).withColumn("prop", F.concat_ws("#", "path", "prop_idx"))
    props = isobmff.table(content, "properties").select(F.concat_ws("#", "path", "prop_idx").alias("prop"), "type", F.hex("payload").alias("payload"))
    return meta.properties_in_order(links, props, "item", "prop", "ord").select("item", "type", "payload", "essential", "dangling", "pos")


@query(
    "container_refs",
    f"""WITH {_ITEMS} SELECT path, item_id AS from_id, CASE WHEN doc_id % 5 = 4 THEN 'cdsc' ELSE 'thmb' END AS type, CAST(k AS INTEGER) AS to_ord, CASE k WHEN 0 THEN item_id - 1 ELSE 1 END AS to_id
    FROM i, (SELECT unnest(range(2)) AS k) WHERE item_id > 1""",
)
def container_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.table(files(spark, sf_dir), "item_refs").select("path", "from_id", "type", "to_ord", "to_id")


@query("container_groups", f"WITH {_ITEMS} SELECT path, 100 + doc_id % 4 AS group_id, 'altr' AS type, CAST(row_number() OVER (PARTITION BY path, doc_id % 4 ORDER BY item_id) - 1 AS INTEGER) AS ord, item_id AS entity_id FROM i WHERE doc_id % 2 = 1")
def container_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.table(files(spark, sf_dir), "entity_groups")


@query(
    "container_boxes",
    f"""WITH {_ITEMS}, n AS (SELECT path, count(*) AS n, sum(strlen(text)) AS bytes FROM i GROUP BY path)
    SELECT path, type, CAST(CASE type WHEN 'ftyp' THEN 24 WHEN 'mdat' THEN 8 + bytes END AS BIGINT) AS size FROM n, (SELECT unnest(['ftyp', 'mdat']) AS type)""",
)
def container_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.table(files(spark, sf_dir), "boxes").where("depth = 0 and type <> 'meta' and error is null").select("path", "type", "size")


@query("container_truncated", f"WITH {_ITEMS} SELECT path, item_id, CASE WHEN item_id < max(item_id) OVER (PARTITION BY path) OR text = '' THEN sha256(text) END AS digest FROM i")
def container_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without their last byte: items that it belonged to have no bytes, all others have theirs."""
    cut = files(spark, sf_dir).withColumn("content", F.expr("substring(content, 1, octet_length(content) - 1)"))
    rows = isobmff.item_bytes(cut.withColumn("content", cut["content"]))
    last = F.max("item_id").over(W.partitionBy("path"))
    return rows.select("path", "item_id", F.when((F.col("item_id") < last) | (F.octet_length("data") == 0) | F.col("data").isNull(), F.sha2("data", 256)).alias("digest"))


@query(
    "container_metadata_blocks",
    f"""WITH {_ITEMS}, r AS (SELECT path, item_id AS block, type, unnest([item_id - 1, 1]) AS image FROM i WHERE doc_id % 5 = 4 AND item_id > 1)
    SELECT DISTINCT r.path, image, block, r.type FROM r JOIN i ON i.path = r.path AND i.item_id = image WHERE i.type IN ('hvc1', 'av01', 'grid')""",
)
def container_metadata_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF blocks of images."""
    content = files(spark, sf_dir)
    return meta.metadata_blocks(isobmff.table(content, "items"), isobmff.table(content, "item_refs"), "path", "item_id", "type", "from_id", "type", "to_id", ["Exif"])


@query(
    "container_alternatives",
    f"""WITH {_ITEMS}, p AS (SELECT path, coalesce(min(CASE WHEN wanted THEN item_id END), min(item_id)) AS main FROM i GROUP BY path),
    g AS (SELECT path, 100 + doc_id % 4 AS gid, item_id, row_number() OVER (PARTITION BY path, doc_id % 4 ORDER BY item_id) - 1 AS ord FROM i WHERE doc_id % 2 = 1),
    own AS (SELECT p.path, min(gid) AS gid FROM p JOIN g ON g.path = p.path AND g.item_id = main GROUP BY p.path)
    SELECT path, CAST(ord AS INTEGER) AS ord, item_id AS item FROM g JOIN own USING (path, gid) UNION ALL SELECT path, 0, main FROM p WHERE path NOT IN (SELECT path FROM own)""",
)
def container_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = files(spark, sf_dir)
    return meta.alternatives(isobmff.table(content, "entity_groups"), isobmff.table(content, "items").where("is_primary"), "path", "group_id", "type", "ord", "entity_id", "item_id")


@query(
    "container_tile_items",
    f"WITH {_ITEMS} SELECT path, item_id AS from_id, CAST(x AS INTEGER) AS x, 0 AS y, CASE WHEN x = 0 THEN item_id - 1 WHEN x = 1 THEN 1 END AS tile FROM i, (SELECT unnest([-1, 0, 1, 2]) AS x) WHERE item_id > 1",
)
def container_tile_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' references as a row of two tiles, asked for at four places."""
    links = isobmff.table(files(spark, sf_dir), "item_refs").select("path", "from_id", "to_ord", "to_id")
    wanted = links.select("path", "from_id").distinct().select("path", "from_id", F.explode(F.array(*map(F.lit, (-1, 0, 1, 2)))).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("cols"))
    return meta.tile_items(wanted, links, ["path", "from_id"], "x", "y", "cols", "to_ord", "to_id").drop("cols")


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select(F.concat(F.lit("m"), F.floor(F.col("user_id") / 4)).alias("path"), F.col("user_id").alias("track_id"), F.lit(600).cast("long").alias("timescale"), F.col("sample_idx").alias("ord"), F.col("delta").alias("duration"), (F.col("event_id") % 1000).alias("size"))
    return isobmff.movies(rows)


@query("movie_tracks", f"WITH {_SAMPLES} SELECT 'm' || (user_id // 4) AS path, user_id AS track_id, 'pict' AS handler, CAST(600 AS BIGINT) AS timescale, CAST(sum(delta) AS BIGINT) AS duration FROM samples GROUP BY user_id")
def movie_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.table(movies(spark, sf_dir), "tracks")


@query("movie_time_runs", f"WITH {_RUNS} SELECT 'm' || (user_id // 4) AS path, user_id AS track_id, CAST(run AS INTEGER) AS ord, count, delta AS value FROM runs")
def movie_time_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations as the file's run lengths."""
    return isobmff.table(movies(spark, sf_dir), "sample_runs").where("box = 'stts'").select("path", "track_id", "ord", "count", "value")


@query("movie_decode_times", f"WITH {_SAMPLES} SELECT user_id AS track_id, sample_idx, delta AS value, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY sample_idx) - delta AS BIGINT) AS decode_time FROM samples")
def movie_decode_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = isobmff.table(movies(spark, sf_dir), "sample_runs").where("box = 'stts'")
    return seq.decode_times(seq.rle_decode(runs, "track_id", "ord", "count", "value"), "track_id", "sample_idx", "value")


@query("movie_sample_sizes", f"WITH {_SAMPLES} SELECT user_id AS track_id, CAST(sample_idx AS INTEGER) AS ord, event_id % 1000 AS size FROM samples")
def movie_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.table(movies(spark, sf_dir), "sample_runs").where("box = 'stsz'").select("track_id", "ord", F.col("value").alias("size"))


#: A layout of each kind for pictures of 8 x 8; the second and third components are the first one's inverse and half.
LAYOUTS = {
    "component": uncompressed.Layout(8, 8, (8, 8, 8), tile_cols=2, tile_rows=2),
    "pixel": uncompressed.Layout(8, 8, (8, 9, 7), "pixel", row_align=4),
    "row": uncompressed.Layout(8, 8, (10, 8, 7), "row"),
    "tile_component": uncompressed.Layout(8, 8, (16, 8, 8), "tile_component", tile_cols=4),
    "mixed": uncompressed.Layout(8, 8, (8, 8, 8), "mixed"),
    "block_component": uncompressed.Layout(8, 8, (10, 9, 9), block_size=2, pad_lsb=True, block_little_endian=True),
    "block_pixel": uncompressed.Layout(8, 8, (8, 8, 7), "pixel", pixel_size=3, block_reversed=True),
}


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v").cast("array<bigint>")
    return images(spark, sf_dir).select("vec_id", F.array(v, F.transform(v, lambda x: 255 - x), F.transform(v, lambda x: F.shiftright(x, 1))).alias("planes"))


def _picture(layout: uncompressed.Layout):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = uncompressed.encoded(pictures(spark, sf_dir), layout, "vec_id")
        rows = uncompressed.decoded(data, layout, "vec_id")
        return rows.select("vec_id", "component", F.posexplode("plane").alias("at", "v"))

    return run


for _name, _layout in LAYOUTS.items():
    query(f"picture_{_name}", f"WITH {P} SELECT vec_id, CAST(c AS INTEGER) AS component, CAST(y * 8 + x AS INTEGER) AS at, CAST(CASE c WHEN 0 THEN v WHEN 1 THEN 255 - v ELSE v >> 1 END AS BIGINT) AS v FROM p, (SELECT unnest(range(3)) AS c)")(_picture(_layout))

query("picture_sizes", "SELECT vec_id, layout, CAST(size AS BIGINT) AS size FROM embeddings, (VALUES ('component', 192), ('pixel', 192), ('row', 8 * (10 + 8 + 7)), ('tile_component', 256), ('mixed', 192), ('block_component', 384), ('block_pixel', 192)) AS t(layout, size)")(
    lambda spark, sf_dir: _sizes(spark, sf_dir)
)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a picture in each layout."""
    out = None
    for name, layout in LAYOUTS.items():
        rows = uncompressed.encoded(pictures(spark, sf_dir), layout, "vec_id").select("vec_id", F.lit(name).alias("layout"), F.octet_length("data").cast("long").alias("size"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "region_items",
    """SELECT s_suppkey, CAST(k AS INTEGER) AS ord, ['point', 'rectangle', 'ellipse'][k + 1] AS kind, s_suppkey * 7 - 500 AS x, s_suppkey % 90 AS y, CASE WHEN k > 0 THEN 1 + s_suppkey * 100 END AS w, CASE WHEN k > 0 THEN 2 + s_suppkey % 9 END AS h
    FROM supplier, (SELECT unnest(range(3)) AS k)""",
)
def region_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three regions of an item, composed to bytes (of 16 or 32 bits, as the numbers need) and parsed."""
    k = F.col("s_suppkey")
    none = F.lit(None)
    kinds = F.array(*map(F.lit, ("point", "rectangle", "ellipse")))
    rows = table(spark, sf_dir, "supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"))
    size = lambda v: F.when(F.col("ord") > 0, v).cast("long")
    rows = rows.select(
        k, "ord", F.lit(1280).alias("reference_w"), F.lit(1024).alias("reference_h"), F.get(kinds, F.col("ord")).alias("kind"), (k * 7 - 500).alias("x"), (k % 90).alias("y"), size(1 + k * 100).alias("w"), size(2 + k % 9).alias("h"),
        none.cast("array<struct<x: bigint, y: bigint>>").alias("points"), none.cast("binary").alias("mask"),
    )
    return regions.regions(regions.region_items(rows, "s_suppkey"), "s_suppkey").select("s_suppkey", "ord", "kind", "x", "y", "w", "h")


def _exif(value: Column) -> Column:
    """A little-endian structure of one directory that holds the orientation."""
    return F.unhex(F.concat(F.lit("49492A000800000001001201030001000000"), F.lpad(F.hex(value), 2, "0"), F.lit("00000000000000")))


@query("exif_orientations", "SELECT p_partkey, CAST(1 + p_partkey % 8 AS INTEGER) AS orientation, CAST(1 + p_size % 8 AS INTEGER) AS patched FROM part")
def exif_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", _exif(1 + F.col("p_partkey") % 8).alias("exif"), (1 + F.col("p_size") % 8).alias("wanted"))
    once = regions.orientations(rows, "p_partkey", "exif", "wanted")
    twice = regions.orientations(once, "p_partkey", "patched")
    return once.select("p_partkey", "orientation").join(twice.select("p_partkey", F.col("orientation").alias("patched")), "p_partkey")
