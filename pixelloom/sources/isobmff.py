"""Container files as tables, and tables as container files.

Files are read with Spark's binaryFile source, so any store that Spark
reaches works, and parsed inside Arrow batches: one pass, no shuffle, one row
for each box, item, extent, property, reference or sample-table entry. A box
that can't be parsed becomes a row with an error instead of failing the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.operators.metadata import IMAGES
from pixelloom.plans.limits import LIMITS
from pixelloom.session import ship

# Boxes that hold boxes, and the bytes before the first of those.
CONTAINERS = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "edts": 0, "dinf": 0, "iprp": 0, "ipco": 0, "meta": 4, "grpl": 0, "mvex": 0, "moof": 0, "traf": 0}
#: Columns of each table; path comes first in all.
TABLES = {
    "boxes": "box_id int, parent_id int, depth int, ord int, type string, uuid string, offset long, size long, header_size int, error string",
    "brands": "major string, minor long, ord int, brand string",
    "items": "item_id long, type string, name string, content_type string, hidden boolean, is_primary boolean, is_image boolean",
    "extents": "item_id long, ord int, method int, offset long, length long",
    "properties": "prop_idx int, type string, payload binary",
    "item_properties": "item_id long, ord int, prop_idx int, essential boolean",
    "item_refs": "box int, from_id long, type string, to_ord int, to_id long",
    "entity_groups": "group_id long, type string, ord int, entity_id long",
    "tracks": "track_id long, handler string, timescale long, duration long",
    "sample_runs": "track_id long, box string, ord int, count long, value long",
}


@dataclass
class Box:
    type: str
    start: int
    size: int
    header: int
    depth: int
    parent: int | None
    ord: int
    uuid: str | None = None
    error: str | None = None
    children: list[int] = field(default_factory=list)

    @property
    def body(self) -> int:
        return self.start + self.header

    @property
    def end(self) -> int:
        return self.start + self.size


def scan(data: bytes) -> list[Box]:
    """All boxes, parents before children."""
    out: list[Box] = []

    def level(at: int, end: int, depth: int, parent: int | None) -> None:
        n = 0
        while at < end:
            if end - at < 8:
                out.append(Box("", at, end - at, 0, depth, parent, n, error="truncated header"))
                return
            size, kind = struct.unpack_from(">I4s", data, at)
            header, uuid, error = 8, None, None
            if size == 1 and end - at >= 16:
                size, header = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = end - at
            if kind == b"uuid" and end - at >= header + 16:
                uuid, header = data[at + header : at + header + 16].hex(), header + 16
            if size < header or at + size > end:
                error, size = "size out of range", end - at
            box = Box(kind.decode("latin-1"), at, size, header, depth, parent, n, uuid, error)
            me = len(out)
            out.append(box)
            if parent is not None:
                out[parent].children.append(me)
            if parent is not None and n >= LIMITS.children_per_box:
                box.error = "too many children"
                return
            if not error and box.type in CONTAINERS and depth < 32:
                level(box.body + CONTAINERS[box.type], box.end, depth + 1, me)
            at, n = box.end, n + 1

    level(0, len(data), 0, None)
    return out


class _Fields:
    """Big-endian fields of a box's body."""

    def __init__(self, data: bytes, box: Box):
        self.data, self.at, self.end = data, box.body, box.end

    def u(self, size: int) -> int:
        if self.at + size > self.end:
            raise ValueError("end of box")
        v = int.from_bytes(self.data[self.at : self.at + size], "big")
        self.at += size
        return v

    def full(self) -> tuple[int, int]:
        v = self.u(4)
        return v >> 24, v & 0xFFFFFF

    def code(self) -> str:
        return self.u(4).to_bytes(4, "big").decode("latin-1")

    def text(self) -> str:
        stop = self.data.find(b"\0", self.at, self.end)
        stop = self.end if stop < 0 else stop
        out = self.data[self.at : stop].decode("utf-8", "replace")
        self.at = min(self.end, stop + 1)
        return out


def _boxes(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    for i, b in enumerate(all_boxes):
        yield i, b.parent, b.depth, b.ord, b.type, b.uuid, b.start, b.size, b.header, b.error


def _brands(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    for b in all_boxes:
        if b.type in ("ftyp", "styp") and not b.error:
            f = _Fields(data, b)
            major, minor, n = f.code(), f.u(4), 0
            while f.at + 4 <= f.end and n < LIMITS.brands:
                yield major, minor, n, f.code()
                n += 1


def _items(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    primary = None
    for b in all_boxes:
        if b.type == "pitm" and not b.error:
            f = _Fields(data, b)
            primary = f.u(4 if f.full()[0] else 2)
    for b in all_boxes:
        if b.type == "iinf" and not b.error:
            f = _Fields(data, b)
            version, _ = f.full()
            count = f.u(4 if version else 2)
            at = f.at
            for _ in range(count):
                if at + 8 > b.end:
                    return
                size = int.from_bytes(data[at : at + 4], "big")
                e = _Fields(data, Box("infe", at, size, 8, 0, None, 0))
                e.end = min(e.end, b.end)
                v, flags = e.full()
                item = e.u(4 if v >= 3 else 2)
                e.u(2)
                kind = e.code() if v >= 2 else ""
                name = e.text()
                content = e.text() if kind in ("", "mime", "uri ") else None
                yield item, kind, name, content, bool(flags & 1), item == primary, kind in IMAGES
                at += max(8, size)


def _extents(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    for *row, _ in _places(data, all_boxes):
        yield row


def _places(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    """Rows of "extents", and each one's extent index (0 without one)."""
    for b in all_boxes:
        if b.type != "iloc" or b.error:
            continue
        f = _Fields(data, b)
        version, _ = f.full()
        sizes = f.u(2)
        offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15
        for _ in range(f.u(4 if version == 2 else 2)):
            item = f.u(4 if version == 2 else 2)
            method = f.u(2) & 15 if version else 0
            f.u(2)
            base = f.u(base_size) if base_size else 0
            n = f.u(2)
            if n > LIMITS.extents_per_item:
                raise ValueError("too many extents")
            for k in range(n):
                index = f.u(index_size) if version and index_size else 0
                offset = f.u(offset_size) if offset_size else 0
                yield item, k, method, base + offset, f.u(length_size) if length_size else 0, index


def _properties(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    for b in all_boxes:
        if b.type == "ipco":
            for n, k in enumerate(b.children):
                p = all_boxes[k]
                yield n + 1, p.type, data[p.body : p.end]


def _item_properties(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    seen: dict[int, int] = {}
    for b in all_boxes:
        if b.type != "ipma" or b.error:
            continue
        f = _Fields(data, b)
        version, flags = f.full()
        for _ in range(f.u(4)):
            item = f.u(4 if version else 2)
            for _ in range(f.u(1)):
                v = f.u(2 if flags & 1 else 1)
                top = 15 if flags & 1 else 7
                yield item, seen.get(item, 0), v & ((1 << top) - 1), bool(v >> top)
                seen[item] = seen.get(item, 0) + 1


def _item_refs(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    for b in all_boxes:
        if b.type != "iref" or b.error:
            continue
        version, _ = _Fields(data, b).full()
        at, n, wide = b.body + 4, 0, 4 if version else 2
        while at + 8 <= b.end:
            size, kind = struct.unpack_from(">I4s", data, at)
            f = _Fields(data, Box("", at, max(8, size), 8, 0, None, 0))
            f.end = min(f.end, b.end)
            source = f.u(wide)
            for k in range(f.u(2)):
                yield n, source, kind.decode("latin-1"), k, f.u(wide)
            at, n = at + max(8, size), n + 1


def _entity_groups(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    for b in all_boxes:
        if b.parent is not None and all_boxes[b.parent].type == "grpl" and not b.error:
            f = _Fields(data, b)
            f.full()
            group, n = f.u(4), f.u(4)
            if n > LIMITS.entities_per_group:
                raise ValueError("too many entities")
            for k in range(n):
                yield group, b.type, k, f.u(4)


def _children(all_boxes: list[Box], i: int) -> Iterator[Box]:
    for k in all_boxes[i].children:
        yield all_boxes[k]
        yield from _children(all_boxes, k)


def _track(data: bytes, all_boxes: list[Box], i: int) -> tuple:
    track, handler, scale, duration = 0, "", 0, 0
    for b in _children(all_boxes, i):
        f = _Fields(data, b)
        if b.type == "tkhd":
            wide = f.full()[0]
            f.at += 16 if wide else 8
            track = f.u(4)
        elif b.type == "mdhd":
            wide = f.full()[0]
            f.at += 16 if wide else 8
            scale, duration = f.u(4), f.u(8 if wide else 4)
        elif b.type == "hdlr":
            f.full()
            f.u(4)
            handler = f.code()
    return track, handler, scale, duration


def _tracks(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    for i, b in enumerate(all_boxes):
        if b.type == "trak":
            yield _track(data, all_boxes, i)


def _sample_runs(data: bytes, all_boxes: list[Box]) -> Iterator[tuple]:
    """stts, ctts: count and delta; stsc: first chunk and samples in a chunk; stsz: 1 and size (or all and the constant size); stco, co64: 1 and offset; stss: 1 and sample."""
    for i, t in enumerate(all_boxes):
        if t.type != "trak":
            continue
        track = _track(data, all_boxes, i)[0]
        for b in _children(all_boxes, i):
            if b.type not in ("stts", "ctts", "stsc", "stsz", "stco", "co64", "stss") or b.error:
                continue
            f = _Fields(data, b)
            version, _ = f.full()
            if b.type == "stsz" and (size := f.u(4)):
                yield track, b.type, 0, f.u(4), size
                continue
            for k in range(f.u(4)):
                first = f.u(4) if b.type in ("stts", "ctts", "stsc") else 1
                value = f.u(8 if b.type == "co64" else 4)
                if b.type == "stsc":
                    f.u(4)
                if b.type == "ctts" and version:
                    value = value - (1 << 32) if value >> 31 else value
                yield track, b.type, k, first, value


_READERS = {
    "boxes": _boxes,
    "brands": _brands,
    "items": _items,
    "extents": _extents,
    "properties": _properties,
    "item_properties": _item_properties,
    "item_refs": _item_refs,
    "entity_groups": _entity_groups,
    "tracks": _tracks,
    "sample_runs": _sample_runs,
}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of files; content is read only where a query uses it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def table(contents: DataFrame, name: str, with_errors: bool = False) -> DataFrame:
    """(path, ...) of one of TABLES for contents (path, content). A file whose table is broken gives the rows before the break, and with_errors one more row with what is wrong in a last column `broken`."""
    _prepare(contents.sparkSession)
    reader, cols = _READERS[name], [c.split() for c in TABLES[name].split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    cols = [["path", "string"], *cols, *([["broken", "string"]] if with_errors else [])]
    tail = (None,) * with_errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                try:
                    for row in reader(data, scan(data)):
                        rows.append((path, *row, *tail))
                except (ValueError, struct.error) as e:
                    if with_errors:
                        rows.append((path, *[None] * (len(cols) - 2), str(e)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(cols)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, cols, strict=True)], [n for n, _ in cols])

    return contents.select("path", "content").mapInArrow(run, ", ".join(" ".join(c) for c in cols))


def _prepare(spark: SparkSession) -> None:
    """Ships this package, and bounds the session's Arrow batches by bytes: contents are whole files."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def item_values(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(item_id, its extents' bytes) of a file: from the file (method 0), its idat box (1) or other items that it refers to by 'iloc' (2). None for extents outside of those, items in a circle and unknown methods; a length of 0 means to the end."""
    boxes = scan(data)
    idat = next(((b.body, b.end) for b in boxes if b.type == "idat"), None)
    places: dict[int, list[tuple]] = {}
    for item, _, method, offset, length, index in _places(data, boxes):
        places.setdefault(item, []).append((method, offset, length, index))
    sources: dict[int, list[int]] = {}
    for _, source, kind, _, target in _item_refs(data, boxes):
        if kind == "iloc":
            sources.setdefault(source, []).append(target)
    known: dict[int, bytes | None] = {}

    def value(item: int, users: frozenset[int]) -> bytes | None:
        if item in known or item in users or item not in places or len(users) > LIMITS.children_per_box:
            return known.get(item)
        parts = []
        for method, offset, length, index in places[item]:
            whole, begin, end = data, 0, len(data)
            if method == 1 and idat:
                begin, end = idat
            elif method == 2 and 0 < max(index, 1) <= len(sources.get(item, [])):
                whole = value(sources[item][max(index, 1) - 1], users | {item})
                end = len(whole or b"")
            elif method:
                whole = None
            at = begin + offset
            stop = at + length if length else end
            if whole is None or at > stop or stop > end:
                return None
            parts.append(whole[at:stop])
        return b"".join(parts)

    for item in places:
        known[item] = value(item, frozenset())
        yield item, known[item]


def item_bytes(contents: DataFrame) -> DataFrame:
    """(path, item_id, data): each item's extents, concatenated (see item_values); null where they can't be read, no rows for a file whose places are broken. Files are cut where they are read: no content is shuffled."""
    _prepare(contents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    got = list(item_values(content.as_py() or b""))
                except (ValueError, struct.error):
                    got = []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(got), pa.string()), pa.array([i for i, _ in got], pa.int64()), pa.array([d for _, d in got], pa.binary())], ["path", "item_id", "data"])

    return contents.select("path", "content").mapInArrow(run, "path string, item_id long, data binary")


def inflated(rows: DataFrame, data: str, method: str) -> DataFrame:
    """rows with data decompressed: method is a column of 'zlib', 'defl' (raw) or null (as it is); null where that fails."""
    ship(rows.sparkSession)
    names = rows.columns
    d, m = names.index(data), names.index(method)

    def one(x: bytes | None, how: str | None) -> bytes | None:
        try:
            return x if x is None or how is None else zlib.decompress(x, -15 if how == "defl" else 15)
        except zlib.error:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            cols[d] = pa.array([one(x, y) for x, y in zip(b.column(d).to_pylist(), b.column(m).to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, rows.schema)


# --- writing -------------------------------------------------------------


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode("latin-1")) + body


def full_box(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


@dataclass
class Item:
    id: int
    type: str
    data: bytes
    name: str = ""
    hidden: bool = False
    properties: list[tuple[str, bytes, bool]] = field(default_factory=list)
    refs: list[tuple[str, list[int]]] = field(default_factory=list)
    groups: list[tuple[str, int]] = field(default_factory=list)


def container(items: list[Item], major: str = "mif1", brands: tuple[str, ...] = ("mif1", "heic"), primary: int | None = None) -> bytes:
    """A file of items: equal properties are stored once, data follow in one mdat whose offsets are running sums."""
    store: list[tuple[str, bytes]] = []
    links = []
    for it in items:
        own = []
        for kind, payload, essential in it.properties:
            if (kind, payload) not in store:
                store.append((kind, payload))
            own.append(0x8000 * essential | store.index((kind, payload)) + 1)
        links.append(struct.pack(">IB", it.id, len(own)) + b"".join(struct.pack(">H", v) for v in own))
    infe = [full_box("infe", 3, int(it.hidden), struct.pack(">IH", it.id, 0), it.type.encode("latin-1"), it.name.encode() + b"\0") for it in items]
    refs = [box(kind, struct.pack(">IH", it.id, len(to)), *(struct.pack(">I", x) for x in to)) for it in items for kind, to in it.refs]
    members: dict[tuple[str, int], list[int]] = {}
    for it in items:
        for g in it.groups:
            members.setdefault(g, []).append(it.id)
    groups = [full_box(kind, 0, 0, struct.pack(">II", n, len(own)), *(struct.pack(">I", x) for x in own)) for (kind, n), own in members.items()]
    start = box("ftyp", major.encode(), bytes(4), *(b.encode() for b in brands))

    def meta(base: int) -> bytes:
        places, at = [], base
        for it in items:
            places.append(struct.pack(">IHHHQQ", it.id, 0, 0, 1, at, len(it.data)))
            at += len(it.data)
        return full_box(
            "meta", 0, 0,
            full_box("hdlr", 0, 0, bytes(4), b"pict", bytes(13)),
            full_box("pitm", 1, 0, struct.pack(">I", primary if primary is not None else items[0].id if items else 0)),
            full_box("iinf", 1, 0, struct.pack(">I", len(infe)), *infe),
            full_box("iloc", 2, 0, struct.pack(">HI", 0x8800, len(items)), *places),
            box("iprp", box("ipco", *(box(k, p) for k, p in store)), full_box("ipma", 1, 1, struct.pack(">I", len(links)), *links)),
            full_box("iref", 1, 0, *refs),
            *([box("grpl", *groups)] if groups else []),
        )

    # Offsets have a fixed width, so the length of meta doesn't depend on them.
    first = len(start) + len(meta(0)) + 8
    return start + meta(first) + box("mdat", *(it.data for it in items))


#: Columns that items of containers() may have beside path, item_id, type, name and data.
OPTIONAL = {
    "hidden": "boolean",
    "is_primary": "boolean",
    "properties": "array<struct<type: string, payload: binary, essential: boolean>>",
    "refs": "array<struct<type: string, to: array<bigint>>>",
    "groups": "array<struct<type: string, group_id: bigint>>",
}


def containers(items: DataFrame) -> DataFrame:
    """(path, content): files from items (path, item_id, type, name, data) and any of OPTIONAL, in the order of item_id.

    A file's items meet in one task, as a file is one value; the item marked
    primary that comes first is the primary one, else the first item.
    """
    ship(items.sparkSession)
    cols = [F.col(c) if c in items.columns else F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items()]
    one = F.collect_list(F.struct("item_id", "type", "name", "data", *cols))
    rows = items.groupBy("path").agg(F.sort_array(one).alias("items"))

    def item(x: dict) -> Item:
        properties = [(p["type"], p["payload"] or b"", bool(p["essential"])) for p in x["properties"] or []]
        refs, groups = [(r["type"], r["to"]) for r in x["refs"] or []], [(g["type"], g["group_id"]) for g in x["groups"] or []]
        return Item(x["item_id"], x["type"], x["data"] or b"", x["name"] or "", bool(x["hidden"]), properties, refs, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = own.as_py()
                content = container([item(x) for x in own], primary=next((x["item_id"] for x in own if x["is_primary"]), None))
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def track(track_id: int, timescale: int, durations: list[int], sizes: list[int], handler: str = "pict") -> bytes:
    """A trak box of samples that lie in one chunk at the file's start: run lengths of durations, sizes, every sample a sync sample."""
    runs: list[list[int]] = []
    for d in durations:
        if runs and runs[-1][1] == d:
            runs[-1][0] += 1
        else:
            runs.append([1, d])
    u = lambda *v: struct.pack(f">{len(v)}I", *v)
    table = box(
        "stbl",
        full_box("stts", 0, 0, u(len(runs)), *(u(*r) for r in runs)),
        full_box("stsc", 0, 0, u(1, 1, len(sizes), 1) if sizes else u(0)),
        full_box("stsz", 0, 0, u(0, len(sizes), *sizes)),
        full_box("stco", 0, 0, u(1, 0) if sizes else u(0)),
    )
    media = box("mdia", full_box("mdhd", 0, 0, u(0, 0, timescale, sum(durations)), bytes(4)), full_box("hdlr", 0, 0, bytes(4), handler.encode(), bytes(13)), box("minf", table))
    return box("trak", full_box("tkhd", 0, 3, u(0, 0, track_id, 0, sum(durations)), bytes(60)), media)


def movies(samples: DataFrame) -> DataFrame:
    """(path, content): header files of tracks from samples (path, track_id, timescale, ord, duration, size). A file's samples meet in one task."""
    ship(samples.sparkSession)
    rows = samples.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("track_id", "timescale", "ord", "duration", "size"))).alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tracks: dict[tuple[int, int], list[dict]] = {}
                for x in own.as_py():
                    tracks.setdefault((x["track_id"], x["timescale"]), []).append(x)
                content = box("ftyp", b"msf1", bytes(4), b"msf1") + box("moov", *(track(t, scale, [x["duration"] for x in s], [x["size"] for x in s]) for (t, scale), s in tracks.items()))
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def chunk_places(samples: DataFrame, file: str, track: str, chunk: str, order: list[str], size: str, start: int = 0) -> DataFrame:
    """samples with offset: where each lies in its file if tracks' chunks are written one after another, by chunk and then track.

    Samples of a chunk lie in the order of the columns `order`; those equal in
    all of them may swap places, so `order` should end with size or a key.
    """
    by = W.partitionBy(file).orderBy(chunk, track).rowsBetween(W.unboundedPreceding, -1)
    sums = samples.groupBy(file, chunk, track).agg(F.sum(size).alias("__bytes"))
    begin = sums.withColumn("__begin", F.coalesce(F.sum("__bytes").over(by), F.lit(0)) + start)
    inside = F.coalesce(F.sum(size).over(W.partitionBy(file, chunk, track).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return samples.withColumn("__in", inside).join(begin.drop("__bytes"), [file, chunk, track]).withColumn("offset", (F.col("__begin") + F.col("__in")).cast("long")).drop("__in", "__begin")
