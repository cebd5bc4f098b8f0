"""Region items, EXIF tags, cue files and box listings: small payloads to rows and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions.geometry import cue_milliseconds
from pixelloom.plans.limits import LIMITS
from pixelloom.session import ship

# Geometry types of the region format, by number.
KINDS = ["point", "rectangle", "ellipse", "polygon", "referenced_mask", "inline_mask", "polyline"]
#: Of the geometries with fixed fields: how many are signed, how many unsigned follow.
_FIELDS = {"point": (2, 0), "rectangle": (2, 2), "ellipse": (2, 2), "referenced_mask": (2, 2), "inline_mask": (2, 2)}

REGION_SCHEMA = "reference_w long, reference_h long, ord int, kind string, x long, y long, w long, h long, points array<struct<x: long, y: long>>, mask binary"


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of REGION_SCHEMA; w and h are the radii of an ellipse, unknown geometries are left out. ValueError for broken or unsupported data, after the rows before it."""

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError(f"a region's fields end beyond byte {len(data)}")
        at += n
        return data[at - n : at]

    at = 0
    size = 4 if take(2)[1] & 1 else 2
    number = lambda signed: int.from_bytes(take(size), "big", signed=signed)
    reference = number(False), number(False)
    for n in range(take(1)[0]):
        code = take(1)[0]
        if code >= len(KINDS):
            continue  # its number is all that is known of it
        kind, values, points, mask = KINDS[code], [None] * 4, None, None
        if kind in _FIELDS:
            signed, unsigned = _FIELDS[kind]
            got = [number(True) for _ in range(signed)] + [number(False) for _ in range(unsigned)]
            values[: len(got)] = got
        else:
            points = [{"x": number(True), "y": number(True)} for _ in range(number(False))]
        if kind == "inline_mask":
            if take(1)[0]:
                raise ValueError("compressed masks are not supported")
            _, _, w, h = values
            if not w or not h or not LIMITS.allows("pixels", w * h):
                raise ValueError("mask size out of range")
            mask = take(-(-w * h // 8))
        yield (*reference, n, kind, *values, points, mask)


def compose(reference_w: int, reference_h: int, regions: list[dict]) -> bytes:
    """The payload of regions (kind, x, y, w, h, points, mask); 16-bit fields unless a value needs more."""
    signed = [r[k] for r in regions for k in ("x", "y") if r.get(k) is not None] + [p[k] for r in regions for p in r.get("points") or [] for k in ("x", "y")]
    unsigned = [reference_w, reference_h, *(r[k] for r in regions for k in ("w", "h") if r.get(k) is not None), *(len(r.get("points") or []) for r in regions)]
    size = 4 if any(not -32768 <= v <= 32767 for v in signed) or any(v > 65535 for v in unsigned) else 2
    number = lambda v, s: v.to_bytes(size, "big", signed=s)
    out = [bytes([0, size == 4]), number(reference_w, False), number(reference_h, False), bytes([len(regions)])]
    for r in regions:
        out.append(bytes([KINDS.index(r["kind"])]))
        if r["kind"] in _FIELDS:
            s, u = _FIELDS[r["kind"]]
            out += [number(r[k], k in "xy") for k in ("x", "y", "w", "h")[: s + u]]
        else:
            out.append(number(len(r["points"]), False))
            out += [number(p[k], True) for p in r["points"] for k in ("x", "y")]
        if r["kind"] == "inline_mask":
            out += [b"\0", r["mask"]]
    return b"".join(out)


def regions(items: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, ..REGION_SCHEMA, error) of region items; a broken item gives the rows before the break and one with an error."""
    ship(items.sparkSession)
    names = [c.split(" ")[0] for c in REGION_SCHEMA.split(", ") if not c.startswith("y: ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            for i, d in enumerate(b.column(1).to_pylist()):
                got = []
                try:
                    for r in parse(d or b""):
                        got.append((*r, None))
                except ValueError as e:
                    got.append((*[None] * len(kinds), str(e)))
                take += [i] * len(got)
                rows += got
            cols = list(zip(*rows, strict=True)) or [[]] * (len(kinds) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, [*kinds, pa.string()], strict=True))], [key, *names, "error"])

    return items.select(key, data).mapInArrow(run, f"`{key}` {items.schema[key].dataType.simpleString()}, {REGION_SCHEMA}, error string")


def region_items(rows: DataFrame, key: str) -> DataFrame:
    """(key, data): the payloads of regions (key, ..REGION_SCHEMA), in the order of ord; null where a value has no place in the format. An item's regions, 255 at most, meet in one task."""
    ship(rows.sparkSession)
    names = ["ord", "reference_w", "reference_h", "kind", "x", "y", "w", "h", "points", "mask"]
    one = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("regions"))

    def payload(own: list[dict]) -> bytes | None:
        try:
            return compose(own[0]["reference_w"], own[0]["reference_h"], own)
        except (ValueError, TypeError, OverflowError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([payload(x.as_py()) for x in b.column(1)], pa.binary())], [key, "data"])

    return one.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, data binary")


# --- EXIF ----------------------------------------------------------------

# Tag numbers.
ORIENTATION, EXIF_DIRECTORY = 0x0112, 0x8769
#: Bytes of an entry.
_ENTRY = 12


def find_tag(exif: bytes, tag: int) -> tuple[int, str] | None:
    """(position of the tag's entry, struct prefix of the byte order) in a TIFF structure, or None.

    Directories are visited once each: the first, its sub-directories, then
    those that follow; entries beyond the data are left out.
    """
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(exif[:4])
    if order is None or len(exif) < 8:
        return None
    todo, seen = [struct.unpack_from(order + "I", exif, 4)[0]], set()
    while todo:
        at = todo.pop(0)
        if at in seen or not 8 <= at <= len(exif) - 2:
            continue
        seen.add(at)
        count = struct.unpack_from(order + "H", exif, at)[0]
        entries = [e for e in range(at + 2, at + 2 + _ENTRY * count, _ENTRY) if e + _ENTRY <= len(exif)]
        numbers = [struct.unpack_from(order + "H", exif, e)[0] for e in entries]
        if tag in numbers:
            return entries[numbers.index(tag)], order
        todo[:0] = [struct.unpack_from(order + "I", exif, e + 8)[0] for e, n in zip(entries, numbers, strict=True) if n == EXIF_DIRECTORY]
        after = at + 2 + _ENTRY * count
        if after + 4 <= len(exif):
            todo.append(struct.unpack_from(order + "I", exif, after)[0])
    return None


def orientation(exif: bytes) -> int:
    """1 ... 8; 1 if there is none."""
    found = find_tag(exif, ORIENTATION)
    value = struct.unpack_from(found[1] + "H", exif, found[0] + 8)[0] if found else 1
    return value if 1 <= value <= 8 else 1


def with_orientation(exif: bytes, value: int) -> bytes:
    """The same data with another orientation, where it has one."""
    found = find_tag(exif, ORIENTATION)
    if not found:
        return exif
    at = found[0] + 8
    return exif[:at] + struct.pack(found[1] + "H", value) + exif[at + 2 :]


def orientations(rows: DataFrame, key: str, exif: str, wanted: str | None = None) -> DataFrame:
    """(key, orientation, patched): the orientation of EXIF data, and the data with the one in the column `wanted` (as they are without it or where it is null); null data have orientation 1."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x or b"" for x in b.column(1).to_pylist()]
            values = b.column(2).to_pylist()
            new = [x if v is None else with_orientation(x, v) for x, v in zip(data, values, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([orientation(x) for x in data], pa.int32()), pa.array(new, pa.binary())], [key, "orientation", "patched"])

    value = F.col(wanted).cast("int") if wanted else F.lit(None).cast("int")
    return rows.select(key, exif, value.alias("__wanted")).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, orientation int, patched binary")


# --- text ----------------------------------------------------------------


def cues(spark: SparkSession, path: str) -> DataFrame:
    """(path, cue, from_ms, to_ms, text, data) of cue files: a line 'from --> to', then lines of base64 until a blank one."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n\n+")).alias("block", "body"))
    head = r"(?m)^([0-9:.]+)\s+-->\s+([0-9:.]+)[^\n]*$"
    rows = rows.where(F.col("body").rlike(head)).withColumn("after", F.substring_index("body", "-->", -1))
    rows = rows.withColumn("text", F.translate(F.expr("substring(after, instr(after, '\n') + 1)"), " \t\n", ""))
    times = [cue_milliseconds(F.regexp_extract("body", head, i)) for i in (1, 2)]
    return rows.select("path", (F.row_number().over(W.partitionBy("path").orderBy("block")) - 1).alias("cue"), times[0].alias("from_ms"), times[1].alias("to_ms"), "text", F.try_to_binary("text", F.lit("base64")).alias("data"))


def listing(boxes: DataFrame) -> DataFrame:
    """(path, line, text): a box table as indented text, in file order."""
    text = F.concat(F.repeat(F.lit("| "), F.col("depth")), F.lit("Box: "), F.coalesce("type", F.lit("")), F.lit(" -----  size: "), F.col("size").cast("string"), F.when(F.col("error").isNotNull(), F.concat(F.lit("  ("), "error", F.lit(")"))).otherwise(F.lit("")))
    return boxes.select("path", F.col("box_id").alias("line"), text.alias("text"))
