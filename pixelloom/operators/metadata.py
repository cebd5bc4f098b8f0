"""Items, properties, references and groups of image containers, as tables.

Containers hold few items each, but a table holds many containers; so every
function works on (file, ...) keys and leaves join strategies to the planner.
Order that matters in a file is a column, never a row order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.session import ship

# Property and reference types with a meaning.
TRANSFORMATIVE = ("imir", "irot", "clap")
DERIVED, THUMBNAIL, AUXILIARY, DESCRIBES = "dimg", "thmb", "auxl", "cdsc"
# Item types that are images.
IMAGES = ("hvc1", "av01", "grid", "tili", "iden", "iovl", "avc1", "unci", "vvc1", "jpeg", "j2k1", "mski")


def properties_in_order(links: DataFrame, properties: DataFrame, item: str, prop: str, order: str) -> DataFrame:
    """links (item, order, prop, essential) with each property's columns; a link to no property is kept with dangling = true."""
    rows = properties.withColumn("__found", F.lit(True))
    return links.join(rows, prop, "left").withColumn("dangling", F.col("__found").isNull()).drop("__found").withColumn("pos", F.row_number().over(W.partitionBy(item).orderBy(order, prop)))


def first_property(links: DataFrame, item: str, kind: str, prop: str, order: str) -> DataFrame:
    """(item, kind, prop): the first property of each type; a property without an order is never first, and a type of only such ones has a null."""
    return links.groupBy(item, kind).agg(F.min(F.when(F.col(order).isNotNull(), F.struct(order, prop))).getField(prop).alias(prop))


def numbered(rows: DataFrame, item: str, order: list[str], wanted: Column | None = None) -> DataFrame:
    """Rows that are wanted, with id: their position from 1 among all rows of the item."""
    out = rows.withColumn("id", F.row_number().over(W.partitionBy(item).orderBy(*order)))
    return out if wanted is None else out.where(wanted)


def descriptive_first(links: DataFrame, item: str, order: list[str], kind: Column) -> DataFrame:
    """links with pos: descriptive properties before transformative ones, each in their order."""
    return links.withColumn("pos", F.row_number().over(W.partitionBy(item).orderBy(F.coalesce(kind.isin(*TRANSFORMATIVE), F.lit(False)).cast("int"), *order)))


def first_reference(refs: DataFrame, source: str, kind: str, box: str, position: str, target: str) -> DataFrame:
    """(source, kind, position, target): the list of the first reference box of each source and type only."""
    rank = F.dense_rank().over(W.partitionBy(source, kind).orderBy(box))
    return refs.withColumn("__rank", rank).where("__rank = 1").select(source, kind, position, target)


def top_level(items: DataFrame, refs: DataFrame, item: str, hidden: Column, source: str, kind: str) -> DataFrame:
    """Visible items that are neither a thumbnail nor an auxiliary image of another."""
    lesser = refs.where(F.col(kind).isin(THUMBNAIL, AUXILIARY)).select(F.col(source).alias(item))
    return items.where(~hidden).join(lesser, item, "left_anti")


def attached(items: DataFrame, refs: DataFrame, item: str, source: str, kind: str, target: str) -> DataFrame:
    """(source, kind, target, problem): references with what is wrong with each: 'self', 'dangling', 'thumbnail of a thumbnail', or null."""
    known = items.select(F.col(item).alias(target), F.lit(True).alias("__known"))
    lesser = refs.where(F.col(kind) == THUMBNAIL).select(F.col(source).alias(target), F.lit(True).alias("__thumb")).distinct()
    rows = refs.join(known, target, "left").join(lesser, target, "left")
    problem = (
        F.when(F.col(source) == F.col(target), "self")
        .when(F.col("__known").isNull(), "dangling")
        .when((F.col(kind) == THUMBNAIL) & F.col("__thumb"), "thumbnail of a thumbnail")
    )
    return rows.select(source, kind, target, problem.alias("problem"))


def duplicate_references(refs: DataFrame, source: str, kind: str, target: str) -> DataFrame:
    """(source, kind, target, n): references that occur more than once."""
    return refs.groupBy(source, kind, target).agg(F.count("*").alias("n")).where("n > 1")


def deduplicated(boxes: DataFrame, payload: str, order: str, key: list[str] | None = None) -> DataFrame:
    """(…, first): each box with the first one of equal content, itself if there is none before; by content hash."""
    digest = F.sha2(F.col(payload).cast("binary"), 256)
    firsts = boxes.groupBy(*(key or []), digest.alias("__digest")).agg(F.min(order).alias("first"))
    return boxes.withColumn("__digest", digest).join(firsts, [*(key or []), "__digest"]).drop("__digest")


def merged(tables: list[DataFrame]) -> DataFrame:
    """Several association tables as one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def with_brand(brands: Column, brand: Column) -> Column:
    """A list of compatible brands with one more, if it lacks; order of first occurrence."""
    return F.array_union(brands, F.array(brand))


def best_decoder(decoders: DataFrame, kind: str, priority: str, name: str, wanted: Column | None = None) -> DataFrame:
    """(kind, name, priority): the decoder wanted by name, else that of highest priority; ties go to the first name."""
    exact = F.coalesce(wanted, F.lit(False)) if wanted is not None else F.lit(False)
    rank = F.row_number().over(W.partitionBy(kind).orderBy(exact.desc(), F.col(priority).desc(), name))
    return decoders.withColumn("__rank", rank).where("__rank = 1").select(kind, name, priority)


def pyramid(layers: DataFrame, group: str, item: str, width: str, height: str) -> DataFrame:
    """(group, item, layer, binning, ok): layers by width, then id; ok says that heights grow as well; binning is the largest width by the layer's."""
    by = W.partitionBy(group).orderBy(width, item)
    every = W.partitionBy(group)
    ok = F.coalesce(F.col(height) >= F.max(height).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    return layers.select(group, item, (F.row_number().over(by) - 1).alias("layer"), F.floor(F.max(width).over(every) / F.col(width)).cast("long").alias("binning"), ok.alias("ok"))


def thumbnail_size(w: Column, h: Column, box: int) -> tuple[Column, Column]:
    """Width and height of a thumbnail in a square box: the longer side fits, both are even; null if the image fits already."""
    even = lambda v: (v - v % 2).cast("int")
    fits = (w <= box) & (h <= box)
    tw = F.when(~fits, F.when(w > h, F.lit(box)).otherwise(F.floor(w * box / h)))
    th = F.when(~fits, F.when(w > h, F.floor(h * box / w)).otherwise(F.lit(box)))
    return even(tw), even(th)


def referring(refs: DataFrame, file: list[str], source: str, kind: str, target: str) -> DataFrame:
    """(file.., target, kind, sources): who refers to each target, in ascending order; references may repeat."""
    return refs.groupBy(*file, target, kind).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def metadata_blocks(items: DataFrame, refs: DataFrame, file: str, item: str, type_: str, source: str, kind: str, target: str, wanted: list[str] | None = None) -> DataFrame:
    """(file, image, block, type): items that describe an image ('cdsc'), of the wanted types or all, once for each pair; a describing item that is itself an image is none."""
    links = refs.where(F.col(kind) == DESCRIBES).select(file, F.col(source).alias("block"), F.col(target).alias("image")).distinct()
    blocks = items.where(~F.col(type_).isin(*IMAGES)).select(file, F.col(item).alias("block"), F.col(type_).alias("type"))
    blocks = blocks if wanted is None else blocks.where(F.col("type").isin(*wanted))
    images = items.where(F.col(type_).isin(*IMAGES)).select(file, F.col(item).alias("image"))
    return links.join(blocks, [file, "block"]).join(images, [file, "image"]).select(file, "image", "block", "type")


def auxiliary_images(refs: DataFrame, roles: DataFrame, file: list[str], source: str, kind: str, target: str, role: str, without: list[str]) -> DataFrame:
    """(file.., image, auxiliary, role): auxiliary images of each image but those of the roles in `without`; an image that has no role keeps null."""
    links = refs.where(F.col(kind) == AUXILIARY).select(*file, F.col(source).alias("auxiliary"), F.col(target).alias("image")).distinct()
    known = roles.select(*file, F.col(source).alias("auxiliary"), F.col(role).alias("role"))
    return links.join(known, [*file, "auxiliary"], "left").where(~F.coalesce(F.col("role").isin(*without), F.lit(False))).select(*file, "image", "auxiliary", "role")


def with_references(refs: DataFrame, new: DataFrame, file: list[str], source: str, kind: str, position: str, target: str) -> DataFrame:
    """refs and new (file.., source, kind, target, order) behind what the same source refers to by the same type: positions go on from the last."""
    last = refs.groupBy(*file, source, kind).agg(F.max(position).alias("__last"))
    by = W.partitionBy(*file, source, kind).orderBy("order", target)
    rows = new.join(last, [*file, source, kind], "left").withColumn(position, (F.coalesce(F.col("__last") + 1, F.lit(0)) + F.row_number().over(by) - 1).cast(refs.schema[position].dataType))
    return refs.select(*file, source, kind, position, target).unionByName(rows.select(*file, source, kind, position, target))


def alternatives(groups: DataFrame, primary: DataFrame, file: str, group: str, kind: str, order: str, entity: str, item: str) -> DataFrame:
    """(file, ord, item): a file's primary item and those that may stand for it, from the first 'altr' group that holds it, in the group's order; the primary alone without one."""
    own = groups.where(F.col(kind) == "altr").join(primary.select(file, F.col(item).alias(entity)), [file, entity])
    first = own.groupBy(file).agg(F.min(group).alias(group))
    found = groups.where(F.col(kind) == "altr").join(first, [file, group]).select(file, F.col(order).cast("int").alias("ord"), F.col(entity).alias("item"))
    alone = primary.join(first, file, "left_anti").select(file, F.lit(0).alias("ord"), F.col(item).alias("item"))
    return found.unionByName(alone)


def tile_items(wanted: DataFrame, refs: DataFrame, grid: list[str], x: str, y: str, cols: str, position: str, target: str) -> DataFrame:
    """wanted (grid.., x, y, cols) with the item of the tile there, by its position among the grid's references; null outside of the grid."""
    at = F.when((F.col(x) >= 0) & (F.col(x) < F.col(cols)) & (F.col(y) >= 0), F.col(y) * F.col(cols) + F.col(x))
    return wanted.withColumn("__at", at.cast("long")).join(refs.select(*grid, F.col(position).cast("long").alias("__at"), F.col(target).alias("tile")), [*grid, "__at"], "left").drop("__at")


def walks(edges: DataFrame, file: str, source: str, target: str, position: str | None = None, flagged: DataFrame | None = None, node: str | None = None) -> DataFrame:
    """(file, start, cyclic, coded, flag): what walks from each source of each file come to, in time linear in the file's edges.

    cyclic says whether some walk meets itself; coded is where following first
    edges ends (by position, then target; by target without one), null in a
    cycle; flag, whether the source or anything that it leads to is in flagged
    (file, node). A file's items are limited in number, so each file is one
    group of one task, and no path is enumerated. Edges may repeat; null ends
    are left out; a file without edges gives no rows.
    """
    spark = edges.sparkSession
    ship(spark)
    place = F.col(position).cast("long") if position is not None else F.lit(0).cast("long")
    e = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(file).alias("file"), F.col(source).cast("long").alias("a"), F.col(target).cast("long").alias("b"), place.alias("at"))
    if flagged is not None:
        e = e.unionByName(flagged.where(F.col(node).isNotNull()).select(F.col(file).alias("file"), F.col(node).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("at")))
    kind = e.schema["file"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        rows = _walk(t.column("a").to_pylist(), t.column("b").to_pylist(), t.column("at").to_pylist())
        name = t.schema.field("file").type
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({"file": pa.array([t.column("file")[0].as_py()] * len(rows), name), "start": pa.array(cols[0], pa.int64()), "cyclic": pa.array(cols[1], pa.bool_()), "coded": pa.array(cols[2], pa.int64()), "flag": pa.array(cols[3], pa.bool_())})

    return e.groupBy("file").applyInArrow(run, f"file {kind}, start long, cyclic boolean, coded long, flag boolean").withColumnRenamed("file", file)


def _walk(a: list[int], b: list[int | None], at: list[int | None]) -> list[tuple]:
    """(start, cyclic, coded, flag) of one file's edges; an edge to None flags its source."""
    out: dict[int, set[int]] = {}
    into: dict[int, set[int]] = {}
    first: dict[int, tuple] = {}
    marked: set[int] = set()
    for x, y, p in zip(a, b, at, strict=True):
        if y is None:
            marked.add(x)
            continue
        out.setdefault(x, set()).add(y)
        into.setdefault(y, set()).add(x)
        key = (p is not None, p or 0, y)  # null positions come first, as in an ascending sort
        first[x] = min(first.get(x, key), key)

    def upstream(todo: list[int], enough) -> set[int]:
        seen = set(todo)
        while todo:
            for x in into.get(todo.pop(), ()):
                if x not in seen and enough(x):
                    seen.add(x)
                    todo.append(x)
        return seen

    left = {x: len(y) for x, y in out.items()}

    def ends(x: int) -> bool:
        left[x] -= 1
        return not left[x]

    acyclic = upstream([y for y in into if y not in out], ends)
    flagged = upstream(list(marked), lambda x: True)
    coded: dict[int, int | None] = {}
    for x in out:
        path = []
        on = set()
        while x in first and x not in coded and x not in on:
            on.add(x)
            path.append(x)
            x = first[x][2]
        end = None if x in on else coded.get(x, None) if x in coded else x
        for y in path:
            coded[y] = end
    return [(x, x not in acyclic, coded[x], x in flagged) for x in out]


def cyclic(edges: DataFrame, file: str, source: str, target: str) -> DataFrame:
    """(file, start, cyclic): whether a walk from the source meets itself."""
    return walks(edges, file, source, target).select(file, "start", "cyclic")


def first_coded(edges: DataFrame, file: str, source: str, target: str, position: str) -> DataFrame:
    """(file, start, node): where following first references from each source ends; null in a cycle."""
    return walks(edges, file, source, target, position).select(file, "start", F.col("coded").alias("node"))


def has_flag(edges: DataFrame, flagged: DataFrame, file: str, source: str, target: str, node: str) -> DataFrame:
    """(file, start, flag): whether the source or anything that it is derived from is flagged (an alpha plane, say)."""
    return walks(edges, file, source, target, None, flagged, node).select(file, "start", "flag")
