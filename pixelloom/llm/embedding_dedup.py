"""Operator 1: near-duplicate vectors by cross-polytope hashing.

A unit vector is turned by random signs and fast Hadamard transforms, three
times; its cross-polytope hash is the index and sign of its largest
component. HASHES such hashes make a code, TABLES independent codes a
vector's keys. A vector is put into the PROBES buckets of each table that
lie nearest (multiprobe), so two close vectors that fall on either side of
a border still meet.

Equal vectors of a label are one class with a weight. Buckets are dealt
into blocks and compared block against block by matrix products in double
precision; no pair leaves a block. A pair that meets in several buckets is
counted in the first that both share, which both ends can tell from their
keys alone. So what a comparison gives back is a number of links for each
class and a spanning forest of the links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import block_pairs, broadcast_if_small, looked_up, prepare, written
from pixelloom.llm.components import components

#: At a cosine of 0.98 and 64 dimensions, four probes of two hashes meet with probability 0.98 in one table, and miss each other in all with 1.3e-7.
TABLES, HASHES, PROBES = 4, 2, 4
#: Rows of a block.
BLOCK = 512
#: Buckets of more than one block that a broadcast may list (about 60 bytes each); beyond, the join shuffles.
LARGE_BUCKETS = 100_000
#: Classes with links or copies that a broadcast may list (32 bytes each).
LINKED_CLASSES = 500_000
#: Least threshold for which the tables' numbers hold what they are documented to find.
LEAST_THRESHOLD = 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Hasher:
    """The probed bucket codes of unit vectors."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, seed: int = 11):
        self.d = 1 << max(0, dim - 1).bit_length()
        self.tables, self.hashes, self.probes = tables, hashes, probes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.d))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables * probes) int64, sorted in each table: the nearest buckets' codes, table number included."""
        x = np.pad(x, ((0, 0), (0, self.d - x.shape[1])))
        out = np.empty((len(x), self.tables, self.probes), np.int64)
        most = min(self.probes, self.d)
        for t in range(self.tables):
            code, loss = np.full((len(x), 1), t, np.int64), np.zeros((len(x), 1))
            for signs in self.signs[t]:
                y = x
                for s in signs:
                    y = hadamard(y * s)
                near = np.argpartition(-np.abs(y), most - 1, axis=1)[:, :most]
                value = np.take_along_axis(y, near, 1)
                gap = np.abs(value).max(1, keepdims=True) - np.abs(value)
                code = (code[:, :, None] * (2 * self.d) + (2 * near + (value < 0))[:, None, :]).reshape(len(x), -1)
                loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
                best = np.argsort(loss, axis=1, kind="stable")[:, : self.probes]
                code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
            if code.shape[1] < self.probes:  # fewer buckets than probes: the last stands for the rest
                code = np.concatenate([code, np.repeat(code[:, -1:], self.probes - code.shape[1], 1)], 1)
            out[:, t] = np.sort(code, 1)
        return out.reshape(len(x), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, k1, k2) of all rows, keys null for those that link with nothing; and one row (k1, k2, rep, label, v, weight) for each class of equal vectors, by 128 bits of hashes."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    sound = F.expr("coalesce(label is not null and id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0), false)")
    rows = rows.withColumn("v", F.expr("transform(v, x -> x + 0.0D)")).withColumn("k1", F.when(sound, F.xxhash64("label", "v"))).withColumn("k2", F.when(sound, F.xxhash64(F.lit("second"), "v", "label")))
    groups = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.min("label").alias("label"), F.first("v").alias("v"))
    return rows.select("id", "k1", "k2"), groups


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each vector.

    Vectors of one label, not null, link if their cosine in double precision
    reaches the threshold. Null, zero or empty vectors and those with null or
    non-finite components have no links and are their own component; vectors
    of different lengths never link. Rows that repeat an id count as vectors
    of their own; a null id has no links, no component and is kept. Other
    columns are not read; an empty table gives no rows. A threshold below
    LEAST_THRESHOLD needs tables, hashes and probes of its own.
    """
    if threshold < LEAST_THRESHOLD and (tables, hashes, probes) == (TABLES, HASHES, PROBES):
        raise ValueError(f"the default tables find pairs from a cosine of {LEAST_THRESHOLD} on; a threshold of {threshold} needs more")
    spark = vectors.sparkSession
    prepare(spark)
    rows, groups = _classes(vectors, id_col, vector_col, label_col)
    classes = written(groups.withColumn("id", F.monotonically_increasing_id()))
    hashers: dict[int, Hasher] = {}
    #: Single precision is kept as such on its way, and widened for every product.
    kind = np.dtype("f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(3)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = v.flatten().to_numpy(), np.cumsum(sizes)
            for dim in np.unique(sizes):
                pick = np.nonzero(sizes == dim)[0]
                x = np.stack([flat[ends[i] - dim : ends[i]] for i in pick]).astype(kind)
                h = hashers.setdefault(int(dim), Hasher(int(dim), tables, hashes, probes))
                codes = h.codes(_unit(x))
                part = batch.take(pa.array(pick))
                width = codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.full(len(pick), dim), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1) * width, pa.int32()), pa.array(codes.ravel()))],
                    ["id", "weight", "label", "x", "dim", "codes"],
                )

    points = written(classes.select("id", "weight", "label", "v").mapInArrow(coded, "id long, weight long, label string, x binary, dim long, codes array<long>"))
    entries = points.select("id", "weight", "label", "dim", F.explode(F.array_distinct("codes")).alias("code"), "x", "codes")
    keys = ["label", "dim", "code"]
    size = entries.groupBy(*keys).agg(F.count("*").alias("size")).where(f"size > {BLOCK}")
    large = written(size.select(*keys, F.expr(f"cast(ceil(size / {BLOCK}) as long)").alias("parts")))
    blocks = written(
        entries.join(broadcast_if_small(large, LARGE_BUCKETS), keys, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("block", F.expr("pmod(xxhash64(id), parts)"))
        .groupBy(*keys, "parts", "block")
        .agg(F.collect_list(F.struct("id", "weight", "x", "codes")).alias("m"))
        .where("parts > 1 or size(m) > 1")
    )
    one = blocks.select("code", F.col("m").alias("p"), F.lit(None).cast(blocks.schema["m"].dataType).alias("q"))
    many = blocks.where("parts > 1")
    two = one.unionByName(block_pairs(many, keys, "m", "parts", same=False).select("code", "p", "q"))

    def arrays(m: pa.Scalar) -> tuple[np.ndarray, ...]:
        v = m.values
        x = np.frombuffer(b"".join(v.field("x").to_pylist()), kind).reshape(len(v), -1)
        return v.field("id").to_numpy(), v.field("weight").to_numpy(), _unit(x), v.field("codes").flatten().to_numpy().reshape(len(v), -1)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, n): n more links of a; b is a neighbour of a in a spanning forest, or null."""
        for batch in batches:
            a, b, n = [], [], []
            for code, p, q in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                same = not q.is_valid
                ip, wp, xp, cp = arrays(p)
                iq, wq, xq, cq = (ip, wp, xp, cp) if same else arrays(q)
                i, j = np.nonzero(xp @ xq.T >= threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                first = np.ones(len(i), bool)  # no bucket before this one holds both
                for lo in range(0, len(i), 65536):
                    x, y = cp[i[lo : lo + 65536]], cq[j[lo : lo + 65536]]
                    # codes grow with the table's number, and are sorted in each table
                    x, y = np.where(x < code, x, -1), np.where(y < code, y, -2)
                    first[lo : lo + 65536] = ~(x[:, :, None] == y[:, None, :]).any((1, 2))
                i, j = i[first], j[first]
                left = np.bincount(i, wq[j], len(ip)).astype(np.int64)
                right = np.bincount(j, wp[i], len(iq)).astype(np.int64)
                forest = _forest(ip[i], iq[j])
                for ids, k in ((ip, left), (iq, right)):
                    some = np.nonzero(k)[0]
                    a += ids[some].tolist()
                    n += k[some].tolist()
                    b += [None] * len(some)
                a += [x for x, _ in forest]
                b += [y for _, y in forest]
                n += [0] * len(forest)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    found = written(two.mapInArrow(compared, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comps = components(found.where("b is not null").select("a", "b"))
    comps = written(comps)
    every = comps.union(comps.select(F.col("component").alias("id"), "component")).distinct()
    least = every.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    comps = every.join(least, "component").select("id", "least")
    known = classes.select("id", "k1", "k2", "rep", "weight").join(counts, "id", "left").join(comps, "id", "left").where("weight > 1 or n is not null")
    known = written(known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component")))
    out = looked_up(rows, known, ["k1", "k2"], LINKED_CLASSES)
    comp = F.coalesce("component", F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the edges (a[i], b[i])."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] if y in up else y
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        r, s = root(x), root(y)
        if r != s:
            up[max(r, s)] = min(r, s)
            out.append((x, y))
    return out
