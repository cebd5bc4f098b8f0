"""Operator 7: mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents in a fixed pseudo-random order. In each
round a source earns its share of a window's tokens as credit and sends the
documents that its credit covers; what it can't spend is its deficit and
stays for the next round. As a source's credit after r rounds is r times its
quantum, the round of a document follows from its end position in its queue
alone:

    round = ceil(end / quantum) - 1

So no state passes through the windows one by one: deficits carry across
windows and partitions by this closed form. What it needs is a running
token count in each queue, which is taken in two levels (a queue is dealt
into SUB_QUEUES by hash, so a source with a third of all rows is spread out
as evenly as any other), and likewise over the rounds. The stream of all
rounds is then cut every `length` tokens; what is left at the very end
becomes sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.llm.common import give_back, prepare, spans, written

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import WhitespaceSplit  # noqa: E402

#: Parts into which each source's queue is dealt by hash for its running count.
SUB_QUEUES = 1024
#: Groups of rounds for the running count over the whole stream; bounds the one small table that is broadcast.
ROUND_GROUPS = 4096
#: Pieces whose ids a task remembers, and characters of text whose new pieces are encoded at a time.
MEMO_PIECES, SPAN_CHARS = 200_000, 1 << 22

#: The split pattern and word end of word-ended BPE files, for which chunks between white space are encoded one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: Lower-cased Latin-1 letters and numbers, for a split of such texts by the faster standard library.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \n\t\r{_LETTERS}{_NUMBERS}]+").findall
#: Texts that are composed already, are lower-cased letter by letter, and whose only white space is that of _SPLIT.
_SIMPLE = re.compile(r"[\n\t\r\x20-\x7e\xa1-\xac\xae-\xff]*").fullmatch


def _byte_letters() -> dict[int, str]:
    """For str.translate: the letter that stands for each byte in byte-level vocabularies; printable Latin-1 is itself, the rest follow from U+0100. Blanks stay."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)} | {32: " "}


class Pieces(dict):
    """Ids of texts from a tokenizer file. self[piece] is the row of a piece, which the split pattern can give, in a table of ids.

    An unknown piece gets the next row at once, and its ids at the end of
    the group of texts: all new pieces are encoded as one text of words, by
    the tokenizer's model without the normalizing and splitting that they
    have behind them; their ids part again at the tokens that end a word.
    The first MEMO_PIECES stay known, others are forgotten after their group.
    """

    def __init__(self, path: str, end_id: int):
        super().__init__()
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocab = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        steps = [(spec.get("normalizer") or {}).get("normalizers", []), (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        names = [[x["type"] for x in s] for s in steps]
        #: White space parts words, and each word's ids depend on it alone.
        self.by_words = names == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and steps[1][0]["pattern"] == {"Regex": WORD_PATTERN} and not steps[1][1]["add_prefix_space"] and spec["model"].get("end_of_word_suffix") == WORD_END
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        """Frees what is remembered: workers outlive tasks, and other operators need their memory."""
        self.clear()
        self["\n"] = 0  # stands for the end of a text
        self.store, self.at, self.size = np.array([self.end_id], self.kind), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        row = self[piece] = len(self)
        return row

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; a chunk between white space that needs the library's own normalization is one piece, marked by a blank."""
        if not self.by_words:
            return [" " + text]
        if _SIMPLE(text) and "<|" not in text:
            return _SPLIT(text.lower())
        out: list[str] = []
        for chunk in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if _SIMPLE(chunk) and "<|" not in chunk:
                out += _SPLIT(chunk.lower())
            else:
                out.append(" " + chunk)
        return out

    def _learn(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The table of ids, with the new pieces': ids, and each row's place and number."""
        if not self.new:
            return self.store, self.at, self.size
        marked = np.array([p[0] == " " for p in self.new])
        words = [p for p in self.new if p[0] != " "]
        others = [self.plain(p[1:]) for p in self.new if p[0] == " "]
        line = " ".join(words).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer doesn't end each piece with a token of its own")
        size = np.empty(len(self.new), np.int64)
        size[~marked] = np.diff(ends, prepend=0)
        size[marked] = [len(x) for x in others]
        at = np.empty(len(self.new), np.int64)
        at[~marked] = ends - size[~marked]
        at[marked] = len(ids) + np.cumsum(size[marked]) - size[marked]
        return np.concatenate([self.store, ids.astype(self.kind), *others]), np.concatenate([self.at, at + len(self.store)]), np.concatenate([self.size, size])

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with end_id behind it, and how many each has. Groups of at most about SPAN_CHARS are worked on at a time, so memory for pieces doesn't grow with a text."""
        flat, counts = [np.empty(0, self.kind)], np.zeros(len(texts), np.int64)
        codes: list[np.ndarray] = []
        owner: list[int] = []
        size, end = 0, np.zeros(1, np.int32)

        def flush() -> None:
            store, at, number = self._learn()
            rows = np.concatenate(codes)
            n = number[rows]
            upto = np.cumsum(n)
            flat.append(store[np.repeat(at[rows] - upto + n, n) + np.arange(n.sum())])
            np.add.at(counts, np.repeat(owner, [len(c) for c in codes]), n)
            if len(self) > MEMO_PIECES + 1:
                for p in self.new[max(0, MEMO_PIECES + 1 - len(self.at)) :]:
                    del self[p]
                at, number = at[: len(self)], number[: len(self)]
            if len(at) > len(self.at):
                upto = np.cumsum(number)
                self.store, self.at, self.size = store[np.repeat(at - upto + number, number) + np.arange(number.sum())], upto - number, number
            self.new = []
            codes.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for span in spans(text, SPAN_CHARS) if self.by_words else (text,):
                p = self.pieces(span)
                codes.append(np.fromiter(map(self.__getitem__, p), np.int32, len(p)))
                owner.append(i)
                size += len(span)
                if size >= SPAN_CHARS:
                    flush()
                    size = 0
            codes.append(end)
            owner.append(i)
        if codes:
            flush()
        return np.concatenate(flat), counts


_known: dict[tuple[str, int], Pieces] = {}


def tokenizer(path: str, end_id: int) -> Pieces:
    """This worker's tokenizer for a file, with an empty memo."""
    if (path, end_id) not in _known:
        _known[path, end_id] = Pieces(path, end_id)
    _known[path, end_id].forget()
    return _known[path, end_id]


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row_key, id, source, n, ids): every row's ids and end_id, little-endian; null text is empty, null source the source ''."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = tokenizer(tokenizer_path, end_id)
        for batch in batches:
            ids, n = c.encoded([t or "" for t in batch.column(3).to_pylist()])
            ends = np.concatenate([[0], np.cumsum(n * c.kind.itemsize)]).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), lists], ["row_key", "id", "source", "n", "ids"])
        c.forget()
        give_back()

    return rows.mapInArrow(run, f"row_key long, id {kind}, source string, n long, ids binary")


def scheduled(rows: DataFrame, window_tokens: int, weights: Mapping[str, float] | None = None) -> tuple[DataFrame, int]:
    """rows (row_key, id, source, n) -> (row_key, first: tokens before it in the stream of all rounds), and the number of all tokens.

    weights are target proportions by source (those without one get the
    least of them); None means each source's own share, so that all queues
    end together. A queue that has ended earns nothing, the others go on in
    proportion.
    """
    rows = rows.select("row_key", "source", "n", F.xxhash64("id").alias("h")).withColumn("sub", F.expr(f"pmod(h, {SUB_QUEUES})"))
    own = W.partitionBy("source", "sub").orderBy("h", "row_key").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.groupBy("source", "sub").agg(F.sum("n").alias("tokens"))
    before = sums.select("source", "sub", (F.sum("tokens").over(W.partitionBy("source").orderBy("sub")) - F.col("tokens")).alias("before"), F.sum("tokens").over(W.partitionBy("source")).alias("queue"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    if weights:
        least = min(weights.values())
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(float(least)))
    else:
        share = F.col("queue") / F.lit(float(max(total, 1)))
    before = written(before.withColumn("quantum", share * F.lit(float(window_tokens))))
    last = before.agg(F.max(F.ceil(F.col("queue") / F.col("quantum")))).first()[0] or 1
    placed = (
        rows.withColumn("end", F.sum("n").over(own))
        .join(before, ["source", "sub"])
        .withColumn("end", F.col("end") + F.col("before"))
        .withColumn("round", F.greatest(F.ceil(F.col("end") / F.col("quantum")) - 1, F.lit(0)))
        .withColumn("group", F.floor(F.col("round") * F.lit(ROUND_GROUPS / max(last, ROUND_GROUPS))))
        .select("row_key", "n", "source", "end", "round", "group")
    )
    sums = placed.groupBy("group").agg(F.sum("n").alias("tokens"))
    start = written(sums.select("group", (F.sum("tokens").over(W.orderBy("group")) - F.col("tokens")).alias("start")))
    run = F.sum("n").over(W.partitionBy("group").orderBy("round", "source", "end", "row_key").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("upto", run).join(F.broadcast(start), "group").select("row_key", (F.col("start") + F.col("upto") - F.col("n")).alias("first")), total


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, window_sequences: int = 64, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of all documents: (id, start, length, ids, doc_tokens, sequence_id, offset), ids as little-endian unsigned 32-bit numbers.

    A sequence holds exactly `length` tokens; the last few hold powers of
    two. Null text is one end_id; null sources form one queue with ''; a
    null id is kept as null; rows that repeat are documents of their own;
    no rows give no pieces; other columns are not read.
    """
    rows = written(tokenized(docs, tokenizer_path, end_id, id_col, text_col, source_col))
    places, total = scheduled(rows.select("row_key", "id", "source", "n"), length * window_sequences, weights)
    whole = total // length
    tail, at = [], whole * length  # ends of the sequences after the whole ones
    for bit in reversed(range(length.bit_length())):
        if (total - whole * length) >> bit & 1:
            at += 1 << bit
            tail.append(at)
    kind = rows.schema["id"].dataType.simpleString()
    width = tokenizer(tokenizer_path, end_id).kind.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], {k: [] for k in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for row, (first, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                ids = np.frombuffer(ids.as_buffer(), width).astype("<u4")
                done = 0
                while done < len(ids):
                    p = first + done
                    if p < whole * length:
                        seq, begin, end = p // length, p // length * length, p // length * length + length
                    else:
                        k = next(i for i, e in enumerate(tail) if p < e)
                        seq, begin, end = whole + k, ([whole * length, *tail])[k], tail[k]
                    n = min(len(ids) - done, end - p)
                    take.append(row)
                    for key, x in zip(out, (done, n, ids[done : done + n].tobytes(), len(ids), seq, p - begin), strict=True):
                        out[key].append(x)
                    done += n
            cols = [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *cols], [id_col, *out])

    both = rows.select("row_key", "id", "ids").join(places.hint("merge"), "row_key").select("id", "first", "ids")
    return both.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences of pack(), each at most `length` tokens, so no group is large."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.expr("aggregate(parts.ids, cast('' as binary), (a, b) -> concat(a, b))").alias("ids"))


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pack()'s pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
