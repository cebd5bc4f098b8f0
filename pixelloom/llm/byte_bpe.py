"""Operator 10: byte-level BPE encoding and decoding by monoid tree reduction.

A segment of text is an element (text, ids); joining two neighbours is
associative. encode() halves a text until a leaf is short, encodes leaves
with the rank table, and joins neighbours on the way up. Two facts make
each join exact:

* Cuts of the split pattern. Where the character class (letter, number,
  white space, other) changes, except from white space to anything or from
  an apostrophe to a letter, no match of the pattern can hold both sides,
  and no look-ahead sees across; so such a position is a match boundary in
  any context. A join re-encodes the text between the last such cut of the
  left side and the first of the right, growing its window until it has
  both; ids outside stay.
* Adjacent pairs. Ids are the BPE encoding of a match if and only if every
  two neighbours are the encoding of their own bytes. Inside one long run
  of letters, numbers or other marks a join re-encodes a window of few ids
  around the seam and doubles it until the pairs at its edges hold; then
  all ids outside provably stay.

Decoding maps ids to bytes in halves and concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from pixelloom.llm.common import prepare

#: Characters, and ids, of a leaf: a few matches.
LEAF_CHARS = 96
#: Runs of one class longer than this are joined id by id, shorter ones by re-encoding their text.
RUN_CHARS = 2048
#: A position between classes that is a match boundary whatever stands around it.
CUT = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\p{White_Space}\p{L}\p{N}'])(?=[\p{White_Space}\p{L}\p{N}])|(?<=')(?=[\p{White_Space}\p{N}])")
#: A blank after one of these letters is the commonest such position, and is found without the pattern.
_ASCII = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS, _NUMBERS, _OTHERS = (regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\p{White_Space}\p{L}\p{N}']+"))


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank table of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeCodec:
    """Encodes and decodes whole texts by tree reduction over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, run_chars: int = RUN_CHARS):
        self.encoding = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.run = max(2, leaf_chars), run_chars
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length_of = {i: len(b) for b, i in ranks.items()}
        self.decimal = {i: b"%d" % i for i in self.bytes_of}
        self.plain = self.encoding.encode_ordinary
        self._holds: dict[tuple[int, int], bool] = {}

    # -- encoding ---------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.plain(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The ids of left + right from those of both sides."""
        i, j = left.rfind(" ", max(0, len(left) - 64)), right.find(" ", 1, 64)
        if i <= 0 or left[i - 1] not in _ASCII:
            i = self._last_cut(left)
        if j <= 0 or right[j - 1] not in _ASCII:
            j = self._first_cut(right)
        tail, head = left[i:], right[:j]
        keep, drop = len(a) - self._ids_of(reversed(a), len(tail.encode())), self._ids_of(b, len(head.encode()))
        if len(tail) + len(head) > self.run and (seam := self._one_run(left, tail, right, head)):
            return a[: len(a) - self._ids_of(reversed(a), seam)] + self._join_ids(a[len(a) - self._ids_of(reversed(a), seam) :], b[:drop]) + b[drop:]
        out = a[:keep]
        out += self.plain(tail + head)
        out += b[drop:]
        return out

    def _last_cut(self, text: str) -> int:
        """The last cut of text, sought in a window that doubles; 0 if it has none."""
        n, w = len(text), 64
        while True:
            at = max(0, n - w)
            found = [m.start() for m in CUT.finditer(text, at) if at < m.start() < n]
            if found:
                return found[-1]
            if not at:
                return 0
            w *= 2

    def _first_cut(self, text: str) -> int:
        """The first cut of text; its length if it has none."""
        m = CUT.search(text, 1)
        return m.start() if m and m.start() < len(text) else len(text)

    def _ids_of(self, ids, size: int) -> int:
        """How many ids, in the order given, make up size bytes; the cut is one of matches, so they come out even."""
        n = 0
        for i in ids:
            if size <= 0:
                break
            size -= self.length_of[i]
            n += 1
        return n

    def _one_run(self, left: str, tail: str, right: str, head: str) -> int:
        """Bytes of the run of one class that ends the tail, if the head continues it to the head's end within one match; else 0."""
        for kind in (_LETTERS, _NUMBERS, _OTHERS):
            if kind.fullmatch(head):
                back = kind.match(tail[::-1])
                n = back.end() if back else 0
                if n < 4 or tail[len(tail) - n - 3 : len(tail) - n].find("'") >= 0:
                    return 0
                n += tail[len(tail) - n - 1 : len(tail) - n] == " "
                return len(tail[len(tail) - n :].encode())
        return 0

    def _valid(self, x: int, y: int) -> bool:
        """Whether x, y is the encoding of the bytes of both."""
        if (got := self._holds.get((x, y))) is None:
            if len(self._holds) > 200_000:
                self._holds.clear()
            got = self._holds[x, y] = self._bpe(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
        return got

    def _bpe(self, data: bytes) -> list[int]:
        """The merges of one match, whatever its characters."""
        return self.encoding._core_bpe.encode_single_piece(data)

    def _join_ids(self, a: list[int], b: list[int]) -> list[int]:
        """Joins the ids of two parts of one match."""
        if not a or not b or self._valid(a[-1], b[0]):
            return a + b
        k = 2
        while True:
            x, y = max(0, len(a) - k), min(len(b), k)
            mid = self._bpe(b"".join(self.bytes_of[i] for i in [*a[x:], *b[:y]]))
            if (not x or self._valid(a[x - 1], mid[0])) and (y == len(b) or self._valid(mid[-1], b[y])):
                return a[:x] + mid + b[y:]
            k *= 2

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def decimals(self, ids: list[int]) -> bytes:
        return b",".join(map(self.decimal.__getitem__, ids))


_codecs: dict[tuple, TreeCodec] = {}


def codec(path: str, pattern: str) -> TreeCodec:
    """This worker's codec for a rank file, read once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = TreeCodec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text; null text is the empty text.

    Repeated rows give repeated results, an empty table none, a null id stays
    null; other columns are not read. No shuffle: one pass over the rows.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(c.decimals(ids)).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of docs and ids_col, array<int>: the ids of the whole text (empty for null). A column of that name is replaced."""
    prepare(docs.sparkSession)
    rest = docs.drop(ids_col)
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            ids = pa.array([c.encode(t.as_py() or "") for t in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, ids_col])

    return rest.mapInArrow(run, f"{_ddl(rest)}, `{ids_col}` array<int>")


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns of rows and bytes_col, binary: the bytes of ids (empty for null). A column of that name is replaced."""
    prepare(rows.sparkSession)
    rest = rows.drop(bytes_col)
    at = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            out = pa.array([c.decode(x.as_py() or []) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, bytes_col])

    return rest.mapInArrow(run, f"{_ddl(rest)}, `{bytes_col}` binary")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
