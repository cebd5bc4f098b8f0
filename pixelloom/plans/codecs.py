"""Codecs from outside, by format and priority, and running them over a table.

No codec for compressed bit streams ships with this package; callers
register functions for those they have. Without one, decode() gives an error
as data for every row, the way a file with an unknown codec would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.session import ship


@dataclass(frozen=True)
class Codec:
    name: str
    format: str
    priority: int
    run: Callable[[bytes], bytes]


@dataclass
class Registry:
    """Decoders or encoders. Higher priorities come first, then names."""

    codecs: list[Codec] = field(default_factory=list)

    def register(self, codec: Codec) -> None:
        self.codecs = sorted([c for c in self.codecs if (c.name, c.format) != (codec.name, codec.format)] + [codec], key=lambda c: (-c.priority, c.name))

    def listed(self, format: str | None = None, limit: int | None = None) -> list[Codec]:
        return [c for c in self.codecs if format in (None, c.format)][:limit]

    def best(self, format: str, name: str | None = None) -> Codec | None:
        """The codec of that name, else that of highest priority."""
        found = self.listed(format)
        return next((c for c in found if c.name == name), found[0] if found else None)


def decode(rows: DataFrame, registry: Registry, format: str, data: str = "data", name: str | None = None) -> DataFrame:
    """rows with decoded (binary) and error (string): one of both is null."""
    ship(rows.sparkSession)
    codec = registry.best(format, name)
    names = [c for c in rows.columns if c not in ("decoded", "error")]
    at = names.index(data)

    def one(x: bytes | None) -> tuple[bytes | None, str | None]:
        if codec is None:
            return None, f"unsupported codec: {format}"
        try:
            return codec.run(x or b""), None
        except Exception as e:  # a broken item must not fail the others
            return None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], [*names, "decoded", "error"])

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema.fields)
    return rows.select(names).mapInArrow(run, f"{cols}, decoded binary, error string")
