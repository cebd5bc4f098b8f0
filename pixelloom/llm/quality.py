"""Operator 6: quality classifier, a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. FILTERS
learned filters of WIDTH bytes slide over each chunk; their rectified maxima
are its features. The mean of all chunks' features, weighted, is the log-odds of
one probability. Filters over one-hot bytes are sums of table rows; for
scoring, the tables of neighbouring bytes are folded into tables of byte
pairs.

The network is fitted on the whole texts of a bounded sample of labelled
rows; scoring covers whole texts in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import give_back, prepare
from pixelloom.llm.sampling import bounded_ids, held_out

#: Labelled rows that the network is fitted on, at most.
TRAIN_ROWS = 3000
#: Bytes of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1024, 128
#: Bytes that a filter spans (even), and number of filters.
WIDTH, FILTERS = 6, 16
EPOCHS, BATCH, RATE = 6, 32, 0.02
#: Chunks that are convolved at a time in scoring, and in training.
GROUP, TRAIN_GROUP = 32, 128


@dataclass
class Network:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: float


def chunked(data: bytes) -> np.ndarray:
    """(chunks, CHUNK) bytes that cover data, neighbours sharing OVERLAP bytes or more; a short text is padded with zeros."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= CHUNK:
        out = np.zeros((1, CHUNK), np.uint8)
        out[0, : len(a)] = a
        return out
    starts = np.arange(0, len(a) - OVERLAP, CHUNK - OVERLAP)
    starts = np.minimum(starts, len(a) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(a, CHUNK)[starts]


class Scoring:
    """A network with byte-pair tables."""

    def __init__(self, net: Network):
        self.net = net
        t = net.tables
        self.pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for k in range(0, WIDTH, 2)]

    def maxima(self, chunks: np.ndarray) -> np.ndarray:
        out = np.empty((len(chunks), FILTERS), np.float32)
        n = CHUNK - WIDTH + 1
        for i in range(0, len(chunks), GROUP):
            c = chunks[i : i + GROUP].astype(np.intp)
            pair = c[:, :-1] << 8 | c[:, 1:]
            s = self.pairs[0].take(pair[:, :n], 0)
            for k in range(1, WIDTH // 2):
                s += self.pairs[k].take(pair[:, 2 * k : 2 * k + n], 0)
            out[i : i + GROUP] = s.max(1)
        return np.maximum(out + self.net.bias, 0)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Texts are convolved one group of chunks at a time, so a very long one needs no more memory than others."""
        out = []
        parts, owner = [], []
        for t in texts:
            parts.append(chunked((t or "").encode()))
            owner.append(len(parts[-1]))
            if sum(owner) >= 4 * GROUP:
                out += self._flush(parts, owner)
                parts, owner = [], []
        return out + (self._flush(parts, owner) if parts else [])

    def _flush(self, parts: list[np.ndarray], owner: list[int]) -> list[float]:
        m = self.maxima(np.concatenate(parts))
        at = np.concatenate([[0], np.cumsum(owner)[:-1]])
        mean = np.add.reduceat(m, at, axis=0, dtype=np.float64) / np.array(owner)[:, None]
        return (1 / (1 + np.exp(-np.clip(mean @ self.net.weights + self.net.offset, -30, 30)))).tolist()


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Fits a network on all chunks of the texts by Adam on cross-entropy; without both labels it always answers the only one, or 0.5 without any."""
    r = np.random.default_rng(seed)
    p = {"t": r.normal(0, 0.1, (WIDTH, 256, FILTERS)), "b": np.zeros(FILTERS), "w": r.normal(0, 0.3, FILTERS), "o": np.zeros(1)}
    if len({*labels.tolist()}) < 2:
        known = labels.mean() if len(labels) else 0.5
        return Network(p["t"] * 0, p["b"], p["w"] * 0, float(np.clip(known * 40 - 20, -20, 20)))
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            bags = [chunked(texts[j]) for j in pick]
            c = np.concatenate(bags)
            owner = np.repeat(np.arange(len(pick)), [len(x) for x in bags])
            size = np.bincount(owner)
            at, top = strongest(p["t"].astype(np.float32), c)
            top = top + p["b"]
            f = np.maximum(top, 0)
            mean = np.zeros((len(pick), FILTERS))
            np.add.at(mean, owner, f)
            mean /= size[:, None]
            z = 1 / (1 + np.exp(-np.clip(mean @ p["w"] + p["o"], -30, 30)))
            dz = (z - labels[pick]) / len(pick)
            df = (dz[:, None] * p["w"] / size[:, None])[owner] * (top > 0)
            g = {"t": np.zeros_like(p["t"]), "b": df.sum(0), "w": mean.T @ dz + 1e-4 * p["w"], "o": np.array([dz.sum()])}
            rows, cols = np.arange(len(c))[:, None], np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                np.add.at(g["t"][k], (c[rows, at + k], cols), df)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Network(p["t"], p["b"], p["w"], float(p["o"][0]))


def strongest(tables: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and filter where its response is highest, and that response; TRAIN_GROUP chunks at a time."""
    n = CHUNK - WIDTH + 1
    at, top = np.empty((len(c), FILTERS), np.intp), np.empty((len(c), FILTERS), np.float32)
    for i in range(0, len(c), TRAIN_GROUP):
        part = c[i : i + TRAIN_GROUP]
        s = tables[0].take(part[:, :n], 0)
        for k in range(1, WIDTH):
            s += tables[k].take(part[:, k : k + n], 0)
        at[i : i + TRAIN_GROUP] = s.argmax(1)
        top[i : i + TRAIN_GROUP] = np.take_along_axis(s, at[i : i + TRAIN_GROUP, None, :], 1)[:, 0]
    return at, top


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Network:
    """A network from the whole texts of at most train_rows labelled documents that aren't held out.

    A document with several labels has their mean, rounded; of rows that
    repeat an id the one with the smallest text is taken; null text is empty;
    no labels give a network that always answers 0.5. The driver reads the
    sample partition by partition and holds its bytes.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.round(F.avg(label_col)).alias("y"))
    few = F.broadcast(known.join(F.broadcast(bounded_ids(known, id_col, train_rows)), id_col, "left_semi"))
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("x")).join(few, id_col)
    sample = rows.groupBy(id_col).agg(F.min("y").alias("y"), F.min("x").cast("binary").alias("x")).orderBy(id_col)
    texts, marks = [], []
    for r in sample.select("y", "x").toLocalIterator():
        texts.append(bytes(r.x))
        marks.append(r.y)
    return train(texts, np.array(marks, float))


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """All columns of docs, and score (0 to 1) of the whole text; null is the empty text, which has a score too.

    A column named score is replaced; repeated rows get equal scores; an
    empty table gives none.
    """
    prepare(docs.sparkSession)
    rest = docs.drop("score")
    at = rest.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scoring(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.scores(batch.column(at).to_pylist()), pa.float64())], [*batch.schema.names, "score"])
        del s
        give_back()

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{cols}, score double")
