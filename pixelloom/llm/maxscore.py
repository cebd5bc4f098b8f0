"""Operator 8: exact top-k inner products by MaxScore.

Every dimension is a term. Rows are dealt into shards, a shard into parts;
within a part, a term's postings for a query are the rows to which it adds a
positive amount, and its score bound is the largest amount it adds to any
row of the part. For each query terms are ordered by bound. Those at the
low end whose bounds together stay below the query's threshold are
non-essential: a row that is in no essential list can't reach the threshold.
Rows of essential lists are scored on essential terms, then probed in the
others from the largest bound down while what they have plus what is left
can still reach the threshold. What remains has its exact score.

A query's threshold starts as its k-th best score in one shard. In each
further shard parts are traversed from the highest bound down; the threshold
rises with the k best found there, and ends the traversal at the first part
whose bound is below it. Bounds are compared so that ties stay. Each shard
gives at most k rows for a query; the merge ranks those.

Vectors are dense, so a term's postings are about half of all rows, and it
is the probing that prunes: most rows are scored on part of the terms only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.llm.common import prepare, written

#: Rows of a shard, and queries of a block, on average; rows of a part.
SHARD, QUERIES, PART = 2048, 256, 512
#: Terms that are probed between two looks at the bounds.
STEP = 8


class Shard:
    """Rows of integers, sums in float64 (exact below 2**53) or, beyond, in Python's integers."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.keys, self.v = ids[order], keys[order], v[order]
        self.parts = [slice(i, i + PART) for i in range(0, len(v), PART)]
        self.high, self.low = (np.stack([f(self.v[p], axis=0) for p in self.parts]) for f in (np.max, np.min))
        self.most = np.abs(self.v).max()
        self.exact = np.ascontiguousarray(self.v, dtype=np.float64)
        self.probed = 0  # (row, term) pairs that top() has multiplied

    def top(self, q: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """Up to k (score, id) of rows other than own, best first, ties to smaller ids; rows below least may lack."""
        d = min(len(q), self.v.shape[1])
        if float(self.most) * float(np.abs(q[:d]).sum()) >= 2**53:
            scores = (self.v[:, :d].astype(object) * q[None, :d].astype(object)).sum(1)
            return self._best(np.arange(len(scores)), scores, own, k)
        q = q[:d].astype(np.float64)
        if least is None:
            self.probed += self.exact.size
            return self._best(np.arange(len(self.ids)), self.exact[:, :d] @ q, own, k)
        bounds = np.maximum(q * self.high[:, :d], q * self.low[:, :d])
        most = bounds.sum(1)
        rows, scores = np.empty(0, np.int64), np.empty(0)
        for i in np.argsort(-most, kind="stable"):
            if most[i] < least:
                break
            r, s = self._part(self.parts[i], q, bounds[i], least)
            other = self.keys[r] != own
            rows, scores = np.concatenate([rows, r[other]]), np.concatenate([scores, s[other]])
            if len(rows) >= k:
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
                rows, scores = rows[scores >= least], scores[scores >= least]
        return self._best(rows, scores, own, k)

    def _part(self, part: slice, q: np.ndarray, bound: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a part that reach least, and their scores."""
        terms = np.argsort(bound, kind="stable")
        upto = np.cumsum(bound[terms])  # of the terms so far, all non-essential
        split = int(np.searchsorted(np.maximum.accumulate(upto), least, side="left"))
        if split == len(q):
            return np.empty(0, np.int64), np.empty(0)
        essential = terms[split:]
        adds = self.exact[part][:, essential] * q[essential]
        self.probed += adds.size
        rows = np.nonzero((adds > 0).any(1))[0] if least > 0 else np.arange(len(adds))
        have = adds[rows].sum(1)
        left = upto[split - 1] if split else 0.0
        rows += part.start
        at = split
        while True:
            keep = have + left >= least
            rows, have = rows[keep], have[keep]
            if not at or not len(rows):
                return rows, have
            lo = max(0, at - STEP)
            probe = terms[lo:at]
            have = have + self.exact[np.ix_(rows, probe)] @ q[probe]
            self.probed += len(rows) * len(probe)
            at, left = lo, upto[lo - 1] if lo else 0.0

    def _best(self, rows: np.ndarray, scores: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        other = self.keys[rows] != own
        rows, scores = rows[other], scores[other]
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k] if len(rows) <= 4 * k or scores.dtype == object else np.lexsort((self.ids[rows], -scores))[:k]
        return [(int(scores[i]), int(self.ids[rows[i]])) for i in order]


def _arrays(m: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, row keys and vectors of a block; shorter vectors are filled with zeros."""
    v = m.values
    lists = v.field("v")
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy()
    if (size == size[0]).all():
        x = flat.reshape(len(size), -1)
    else:
        x = np.zeros((len(size), size.max()), np.int64)
        x[np.arange(size.max())[None, :] < size[:, None]] = flat
    return v.field("id").to_numpy(), v.field("row_key").to_numpy(), x


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): for each query row the k other rows of highest integer inner product, ties to smaller ids.

    Components become floor(scale * x). Rows with a null id, a null or empty
    vector or null or non-finite components take no part; a shorter vector
    counts as filled with zeros; rows that repeat an id are rows of their
    own, and only a query's own row is left out of its candidates. Scores
    beyond 64 bits are ranked exactly and given as the nearest long. No rows,
    or no queries, give no rows; other columns are not read.
    """
    prepare(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), v.alias("v"))
    sound = rows.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    ints = written(sound.withColumn("v", F.expr(f"transform(v, x -> cast(floor({scale} * x) as long))")))
    n, asking = ints.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asking // QUERIES))

    def dealt(df: DataFrame, parts: int, name: str) -> DataFrame:
        return df.withColumn(name, F.expr(f"pmod(xxhash64(row_key), {parts}L)")).groupBy(name).agg(F.collect_list(F.struct("id", "row_key", "v", "least")).alias("m"))

    stored = written(dealt(ints.withColumn("least", F.lit(None).cast("long")), shards, "shard"))
    queries = ints.where("asks")

    def searched(asked: DataFrame) -> DataFrame:
        """asked (shard, q): blocks of queries, each with a shard it is to be run on -> (row_key, query_id, id, score)."""
        pairs = asked.join(stored.hint("merge"), "shard").select("q", "m")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, shard = None, None
            for batch in batches:
                out: list[tuple] = []
                for q, m in zip(batch.column(0), batch.column(1), strict=True):
                    ids, keys, x = _arrays(m)
                    if shard is None or not np.array_equal(keys, last):
                        last, shard = keys, Shard(ids, keys, x)
                    qi, qk, qx = _arrays(q)
                    for i, least in enumerate(q.values.field("least").to_pylist()):
                        out += [(qk[i], qi[i], r, s) for s, r in shard.top(qx[i], qk[i], k, least)]
                cols = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([max(-(2**63), min(2**63 - 1, int(y))) for y in x], pa.int64()) for x in cols], ["row_key", "query_id", "id", "score"])

        return pairs.mapInArrow(run, "row_key long, query_id long, id long, score long")

    first = dealt(queries.withColumn("least", F.lit(None).cast("long")), blocks, "block")
    seeds = searched(first.select((F.col("block") % shards).alias("shard"), F.col("m").alias("q")))
    least = seeds.groupBy("row_key").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(f"n >= {k}").drop("n")
    asked = written(dealt(queries.join(least, "row_key", "left"), blocks, "block"))
    found = searched(asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("m").alias("q")))
    rank = F.row_number().over(W.partitionBy("row_key").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
