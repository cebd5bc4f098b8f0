"""Operator 9: near-duplicate documents by MinHash bands and odd sketches.

Texts become sets of word shingles (64-bit hashes). Some MinHash samples are
cut into bands; equal bands make buckets. Sets that share a bucket get an odd
sketch: many more samples, folded into a bitmap of the parity of hits. The
population count of the XOR of two sketches is at most twice the number of
samples that differ, so a pair above the bound that a pair at the threshold
keeps with probability 1 - LOSS is no candidate; with SKETCH_SAMPLES samples
that is a similarity little below the threshold. All others are confirmed on
their full sets.

No bucket is expanded into pairs. Sets that are equal are one class, with a
number of its own. Every bucket then compares its classes with one centre,
the class that shares most buckets with others; a centre of many pairs is
sent to several tasks, each with a part of them. Buckets whose classes are not yet connected are
compared block against block on sketches alone, only across components,
and the survivors are confirmed too; so each link that bands can find ends
up within one component, whatever a bucket's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import block_pairs, broadcast_if_small, forget, give_back, looked_up, prepare, written
from pixelloom.llm.components import components

#: MinHash samples of an odd sketch, and its bits. Samples make the estimate precise, bits keep hits from cancelling
#: each other: with these, a pair whose similarity is 0.06 below a threshold of 0.85 is no candidate.
SKETCH_SAMPLES, SKETCH_BITS = 2048, 8192
#: Probability with which the sketch bound may reject a pair that lies at the threshold.
LOSS = 1e-7
#: Rows of a block in the comparison of buckets that are not yet connected.
BLOCK = 256
#: Words whose hash a task remembers.
MEMO = 150_000
#: Probability with which a pair at the threshold shares no band: sets the number of bands.
MISS = 5e-7
#: Rows of ids, class numbers or hashes that a broadcast may hold (up to 32 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Blocks up to which a bucket stays in one row, and is compared with itself there; the blocks of larger ones are copied and dealt as pairs.
WHOLE = 4
#: Members of a block.
_MEMBERS = "array<struct<id:long,comp:long,keys:array<long>,sketch:array<long>>>"
#: Pairs that one copy of a set serves; the set of a class with more pairs is copied.
PAIRS_A_COPY = 1024

_MIX = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """word -> 64-bit hash; keeps the first MEMO words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, A-Z lower-cased; fewer words are one shingle, none the empty set."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = _mixed(x * _MIX + h[i : len(h) - k + 1 + i])
    return np.unique(x)


def sketch_bound(samples: int, percent: int) -> int:
    """Largest XOR population count of a candidate: twice the number of differing samples that a pair at the threshold exceeds with probability LOSS at most."""
    if percent >= 100:
        return 0
    p, tail = 1 - percent / 100, 0.0
    for d in range(samples, -1, -1):
        ways = math.lgamma(samples + 1) - math.lgamma(d + 1) - math.lgamma(samples - d + 1)
        tail += math.exp(ways + d * math.log(p) + (samples - d) * math.log(1 - p))
        if tail > LOSS:
            return 2 * d
    return 0


class Samples:
    """MinHash samples of shingle sets, by multiply-add on 32 bits."""

    def __init__(self, n: int, seed: int):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.b = r.integers(0, 1 << 32, n, dtype=np.uint32)
        self.step = max(16, (1 << 17) // n)  # stays in a core's cache

    def of(self, s: np.ndarray) -> np.ndarray:
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        low = None
        for i in range(0, len(x), self.step):
            part = (self.a[:, None] * x[None, i : i + self.step] + self.b[:, None]).min(1)
            low = part if low is None else np.minimum(low, part)
        return low


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """m: samples, one row per set -> int64 keys of its bands."""
    key = np.arange(bands, dtype=np.uint64)[None, :].repeat(len(m), 0)
    for i in range(rows):
        key = _mixed(key * _MIX + m[:, i :: rows].astype(np.uint64))
    return key.view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """The samples of one set -> SKETCH_BITS // 64 int64 words of parities (to be counted as unsigned)."""
    at = _mixed(m.astype(np.uint64) + np.arange(len(m), dtype=np.uint64) * _MIX) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def bands_for(percent: int, rows: int) -> int:
    """Bands of `rows` samples with which a pair at the threshold shares none with probability MISS at most."""
    share = (percent / 100) ** rows
    return 1 if share >= 1 else math.ceil(math.log(MISS) / math.log(1 - share))


def features(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, h1, h2, keys): set size, 128-bit hash of the set and band keys; the last three null for an empty set."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = Samples(bands * rows, 1)
        for batch in batches:
            n, h, m, full = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), shingle)
                n.append(len(s))
                full.append(len(s) > 0)
                if len(s):
                    h.append(_hashes(s))
                    m.append(samples.of(s))
                else:
                    h.append(np.zeros(2, np.int64))
                    m.append(np.zeros(bands * rows, np.uint32))
            if not n:
                continue
            keys = band_keys(np.array(m), bands, rows)
            none = ~np.array(full)
            h = np.array(h)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.ravel()), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(h[:, i], pa.int64(), mask=none) for i in (0, 1)), lists], ["id", "n_shingles", "h1", "h2", "keys"])
        _words.clear()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n_shingles long, h1 long, h2 long, keys array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """wanted (id: a class number, rep, h1, h2) -> (id, s, sketch): the full sets of the classes, as bytes, and their odd sketches, from texts of their representatives. An id that repeats with other texts gives sets of other hashes, which are left out."""
    few = broadcast_if_small(wanted.select(F.col("rep").alias("id")).distinct(), BROADCAST_IDS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(few, "id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = Samples(SKETCH_SAMPLES, 2)
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(0)]
            h = np.array([_hashes(s) for s in sets], np.int64).reshape(-1, 2)
            sketches = pa.array([odd_sketch(samples.of(s)) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(h[:, i]) for i in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary()), sketches], ["h1", "h2", "s", "sketch"])
        _words.clear()
        give_back()

    got = rows.mapInArrow(run, "h1 long, h2 long, s binary, sketch array<long>").groupBy("h1", "h2").agg(F.first("s").alias("s"), F.first("sketch").alias("sketch"))
    return got.join(wanted.select("id", "h1", "h2"), ["h1", "h2"]).select("id", "s", "sketch")


def _hashes(s: np.ndarray) -> np.ndarray:
    """128 bits of a set as two numbers."""
    return np.frombuffer(xxhash.xxh3_128_digest(s.data), np.int64)


def _beside(pairs: DataFrame, sets: DataFrame, column: str, x: str, y: str) -> DataFrame:
    """pairs (a, b), a written table, with a column of both sets, as x and y; the pairs of a class that has many are parted by the other end, and its set is copied for each part."""
    out = pairs
    for end, other, name in (("a", "b", x), ("b", "a", y)):
        counts = pairs.groupBy(end).agg(F.count("*").alias("n")).where(f"n > {PAIRS_A_COPY}")
        hot = written(counts.select(end, F.expr(f"cast(ceil(n / {PAIRS_A_COPY}) as long)").alias("parts")))
        small = broadcast_if_small(hot, BROADCAST_IDS)
        dealt = out.join(small, end, "left").withColumn("part", F.expr(f"pmod(xxhash64({other}), coalesce(parts, 1L))")).drop("parts")
        copies = sets.select(F.col("id").alias(end), F.col(column).alias(name)).join(small, end, "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(parts, 1L) - 1)"))).drop("parts")
        out = dealt.join(copies, [end, "part"]).drop("part")
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = _beside(pairs, sets, "s", "sa", "sb").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                inter = int((z[1:] == z[:-1]).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return both.mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, sets: DataFrame, bound: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than the bound."""
    both = _beside(pairs, sets, "sketch", "x", "y")
    differing = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return both.where(differing <= bound).select("a", "b")


def _across(members: DataFrame, known: DataFrame, bound: int) -> DataFrame:
    """members (key, id, comp) and known (id, keys, sketch) -> a written table of candidate pairs (a, b) of different components that share a key, block against block; each from the first key of both. A key of at most WHOLE blocks is compared with itself where it is put together; only larger ones are dealt as pairs of blocks."""
    size = members.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    apart = written(members.join(size.select("key", F.expr(f"if(size <= {WHOLE * BLOCK}, 1L, cast(ceil(size / {BLOCK}) as long))").alias("parts")), "key"))

    def blocks(rows: DataFrame) -> DataFrame:
        dealt = rows.join(known, "id").withColumn("block", F.expr("pmod(xxhash64(id), parts)"))
        return dealt.groupBy("key", "parts", "block").agg(F.collect_list(F.struct("id", "comp", "keys", "sketch")).alias("m"))

    two = blocks(apart.where("parts = 1")).select("key", F.col("m").alias("p"), F.lit(None).cast(_MEMBERS).alias("q"))
    many, done = apart.where("parts > 1"), [apart]
    if not many.isEmpty():
        done.append(written(blocks(many)))
        two = two.unionByName(block_pairs(done[1], ["key"], "m", "parts", same=True))

    def arrays(m: pa.Scalar) -> tuple[np.ndarray, ...]:
        v = m.values
        return v.field("id").to_numpy(), v.field("comp").to_numpy(), v.field("keys").flatten().to_numpy().reshape(len(v), -1), v.field("sketch").flatten().to_numpy().view(np.uint64).reshape(len(v), -1)

    def tiles(m: pa.Scalar) -> list[tuple[np.ndarray, ...]]:
        own = arrays(m)
        return [tuple(v[lo : lo + BLOCK] for v in own) for lo in range(0, len(own[0]), BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for key, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                p, q = tiles(x), tiles(y) if y.is_valid else None
                for n, (ia, ca, ka, sa) in enumerate(p):
                    for ib, cb, kb, sb in q or p[n:]:
                        i, j = np.nonzero(ca[:, None] != cb[None, :])
                        for lo in range(0, len(i), 16384):
                            near = np.bitwise_count(sa[i[lo : lo + 16384]] ^ sb[j[lo : lo + 16384]]).sum(1, dtype=np.int32) <= bound
                            i[lo : lo + 16384][~near] = -1
                        i, j = i[i >= 0], j[i >= 0]
                        both = ka[i][:, :, None] == kb[j][:, None, :]
                        first = np.where(both.any(2), ka[i], np.iinfo(np.int64).max).min(1) == key
                        i, j = i[first], j[first]
                        a.append(np.maximum(ia[i], ib[j]))
                        b.append(np.minimum(ia[i], ib[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
        give_back()

    more = written(two.mapInArrow(run, "a long, b long").distinct())
    forget(*done)
    return more


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int | None = None, rows: int = 4) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs, linked where 100 * intersection >= percent * union.

    component_id is the smallest id reachable by links, kept says whether it
    is the row's own. Null or wordless texts have an empty set and link with
    nothing; a null id is kept and has no component; rows that repeat an id
    all take part, with equal texts or different ones, and share its
    component; other columns are not read; an empty table gives no rows.
    Without bands, their number follows from percent and MISS.
    """
    feats = written(features(docs, id_col, text_col, shingle, bands or bands_for(percent, rows), rows))
    full = feats.where("h1 is not null and id is not null")
    classes = full.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    entries = classes.select("id", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = entries.join(shared, "key")
    central = members.groupBy("id").agg(F.sum("size").alias("score"))
    members = written(members.select("key", "id").join(central, "id"))
    wanted = written(classes.join(broadcast_if_small(written(members.select("id").distinct()), BROADCAST_IDS), "id", "left_semi").select("id", "rep", "h1", "h2", "keys"))
    sets = written(_sets(docs, id_col, text_col, wanted, shingle))

    bound = sketch_bound(SKETCH_SAMPLES, percent)
    centre = members.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("c")).select("key", (-F.col("c.neg")).alias("b"))
    pairs = written(members.join(centre, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    alike = written(_alike(pairs, sets, bound))
    links = written(_confirmed(alike, sets, percent))
    forget(pairs, alike)
    first = written(components(links))
    labelled = members.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    more = _across(labelled, wanted.select("id", "keys").join(sets.select("id", "sketch"), "id"), bound)
    forget(members, wanted, first)
    edges = links.union(_confirmed(more, sets, percent))

    # From classes to ids: a class is its smallest id, and an id of several classes links them.
    names = classes.select("id", "rep")
    ends = edges.join(names.toDF("a", "ra"), "a").join(names.toDF("b", "rb"), "b").select("ra", "rb")
    several = written(full.groupBy("id").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.min("h2").alias("z"), F.max("h2").alias("w")).where("x <> y or z <> w").select("id"))
    if not several.isEmpty():
        own = full.join(broadcast_if_small(several, BROADCAST_IDS), "id", "left_semi").select("id", "h1", "h2").distinct()
        ends = ends.union(own.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep"))
    comps = written(components(ends))
    forget(sets, links, more)
    known = classes.select("h1", "h2", "rep", "n").join(comps.toDF("rep", "component"), "rep", "left").where("n > 1 or component is not null")
    known = written(known.select("h1", "h2", F.coalesce("component", "rep").alias("comp")))
    forget(classes, comps)
    out = feats.select("id", "n_shingles", "h1", "h2")
    out = looked_up(out, known, ["h1", "h2"], BROADCAST_IDS)
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))
