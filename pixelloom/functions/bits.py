"""Bit-level reading for container and codec headers. Used inside Arrow batches; SQL has no bit streams."""

from __future__ import annotations

from collections.abc import Iterator


class BitReader:
    """Reads a byte string from its highest bit on. Reading past the end raises ValueError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bits(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("end of data")
        first, last = self.at // 8, -(-end // 8)
        word = int.from_bytes(self.data[first:last], "big") >> (8 * last - end)
        self.at = end
        return word & ((1 << n) - 1)

    def flag(self) -> bool:
        return bool(self.bits(1))

    def skip(self, n: int) -> None:
        self.bits(n)

    def unsigned(self) -> int:
        """Exp-Golomb ue(v): as many zeros as bits that follow the first one."""
        zeros = 0
        while not self.bits(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("code too long")
        return (1 << zeros) - 1 + self.bits(zeros)

    def signed(self) -> int:
        """Exp-Golomb se(v): 0, 1, -1, 2, -2 ..."""
        v = self.unsigned()
        return (v + 1) // 2 if v % 2 else -(v // 2)


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def bits(self, value: int, n: int) -> BitWriter:
        self.value, self.n = self.value << n | value & ((1 << n) - 1), self.n + n
        return self

    def unsigned(self, v: int) -> BitWriter:
        n = (v + 1).bit_length()
        return self.bits(0, n - 1).bits(v + 1, n)

    def signed(self, v: int) -> BitWriter:
        return self.unsigned(2 * v - 1 if v > 0 else -2 * v)

    def bytes(self) -> bytes:
        """What was written, filled up with zeros."""
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


def nal_units(data: bytes, length_size: int = 4) -> Iterator[bytes]:
    """Units of a stream in which each is preceded by its length."""
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + length_size], "big")
        if at + length_size + n > len(data):
            raise ValueError("unit exceeds the data")
        yield data[at + length_size : at + length_size + n]
        at += length_size + n


def start_code_units(data: bytes) -> Iterator[bytes]:
    """Units of a stream in which each is preceded by 00 00 01, with zeros before it dropped."""
    for part in data.split(b"\0\0\1")[1:]:
        yield part.rstrip(b"\0")


def unescaped(unit: bytes) -> bytes:
    """A unit without emulation prevention: 00 00 03 stands for 00 00."""
    return unit.replace(b"\0\0\3", b"\0\0")
