"""Limits that are part of the semantics of reading untrusted files; 0 means no limit."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # The defaults of the format's readers.
    pixels: int = 32768 * 32768
    tiles: int = 4096 * 4096
    bayer_cells: int = 16 * 16
    items: int = 1000
    colour_profile_bytes: int = 100_000_000
    memory_block: int = 4 << 30
    components: int = 256
    extents_per_item: int = 32
    entities_per_group: int = 64
    children_per_box: int = 100
    sample_descriptions: int = 1024
    sample_groups: int = 1024
    frames: int = 18_000_000
    brands: int = 1000
    bad_pixels: int = 1000
    pixel_bytes: int = 256

    def allows(self, name: str, value: int) -> bool:
        most = getattr(self, name)
        return most == 0 or value <= most


LIMITS = Limits()


def n_tiles(size: list[int], tile: list[int], limits: Limits = LIMITS) -> int:
    """Tiles of an image of two or more dimensions, 8 at most; ValueError beyond the limit."""
    if not 2 <= len(size) <= 8 or len(size) != len(tile) or min(*tile, *size) < 1:
        raise ValueError("unsupported dimensions")
    n = 1
    for a, b in zip(size, tile, strict=True):
        n *= -(-a // b)
    if not limits.allows("tiles", n):
        raise ValueError("too many tiles")
    return n
