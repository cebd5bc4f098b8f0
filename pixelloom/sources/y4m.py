"""YUV4MPEG2 streams: frames of planes with a text header. Read by binaryFile, so any store works."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.session import ship

# Chroma divisors (x, y) of the format's tags; 0 is no chroma.
CHROMA = {"420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": (0, 0)}


def parse(data: bytes) -> Iterator[tuple[int, int, int, str, list[bytes]]]:
    """(frame, width, height, chroma, planes) of 8-bit frames; ValueError for anything else."""
    stop = data.find(b"\n")
    head = data[:stop].decode("latin-1").split(" ") if stop >= 0 else [""]
    if head[0] != "YUV4MPEG2":
        raise ValueError("no YUV4MPEG2 stream")
    tags = {t[0]: t[1:] for t in head[1:] if t}
    w, h, chroma = int(tags["W"]), int(tags["H"]), tags.get("C", "420")
    if chroma not in CHROMA:
        raise ValueError(f"unsupported chroma {chroma}")
    dx, dy = CHROMA[chroma]
    sizes = [w * h] + ([-(-w // dx) * -(-h // dy)] * 2 if dx else [])
    at, n = stop + 1, 0
    while at < len(data):
        stop = data.find(b"\n", at)
        if not data.startswith(b"FRAME", at) or stop < 0 or stop + 1 + sum(sizes) > len(data):
            raise ValueError("broken frame")
        at, planes = stop + 1, []
        for s in sizes:
            planes.append(data[at : at + s])
            at += s
        yield n, w, h, chroma, planes
        n += 1


def compose(w: int, h: int, frames: list[list[bytes]], chroma: str = "420jpeg", rate: tuple[int, int] = (25, 1)) -> bytes:
    head = f"YUV4MPEG2 W{w} H{h} F{rate[0]}:{rate[1]} Ip A1:1 C{chroma}\n".encode()
    return head + b"".join(b"FRAME\n" + b"".join(f) for f in frames)


def frames(contents: DataFrame) -> DataFrame:
    """(path, frame, width, height, chroma, planes) for contents (path, content); a broken file gives the frames before the break."""
    ship(contents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                try:
                    for row in parse(content.as_py() or b""):
                        rows.append(row)
                except (ValueError, KeyError):
                    pass
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["path", "frame", "width", "height", "chroma", "planes"])

    return contents.select("path", "content").mapInArrow(run, "path string, frame int, width int, height int, chroma string, planes array<binary>")
