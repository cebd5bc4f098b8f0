import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import common, embedding_dedup, maxscore, minhash_dedup
from pixelloom.llm.components import components


def classes(ids, links):
    """id -> least id reachable."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        r, s = root(a), root(b)
        up[max(r, s)] = min(r, s)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    if seed == 0:
        edges = [(i, i + 1) for i in range(150)]
    if seed == 1:
        edges = [(0, i) for i in range(1, 200)] + [(500 - i, 500) for i in range(100)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*edges, (3, None), (7, 7)], "a long, b long")).collect()}
    want = classes({x for e in edges for x in e}, edges)
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_sets(rows, n):
    out = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        k = min(n, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def near_copies(rng, n_groups, copies):
    vocabulary = [f"w{i}" for i in range(3000)] + ["Über", "ÉT"]
    rows, i = [], 0
    for _ in range(n_groups):
        base = rng.choices(vocabulary, k=rng.randrange(1, 160))
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 20)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((i, rng.choice([" ", "\n", "\t  "]).join(t)))
            i += 1
    return rows


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(spark, shingle, percent):
    rng = random.Random(shingle)
    rows = near_copies(rng, 60, 12)
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "one two"), (n + 6, "x " * 100_000), (n + 7, "A B C D E F"), (n + 8, "a b c d e f"), (n + 8, "a b c d e f")]
    rng.shuffle(rows)
    sets = word_sets(rows, shingle)
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = classes(sets, links)
    df = spark.createDataFrame([*((*r, 1, True) for r in rows), (None, "one", 1, True)], "doc_id long, text string, n_shingles int, kept boolean")
    got = minhash_dedup.near_duplicates(df, shingle=shingle, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted((i, len(sets[i]), want[i], want[i] == i) for i, _ in rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_minhash_ids_that_repeat_with_other_texts(spark, monkeypatch):
    """Such an id links all that any of its texts links; sets come from the right text; hot centres are copied."""
    monkeypatch.setattr(minhash_dedup, "PAIRS_A_COPY", 2)
    a, b = [[f"{x}{i}" for i in range(40)] for x in "ab"]
    near = lambda t, k: " ".join([*t[:-1], f"z{k}"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), *((10 + k, near(a, k)) for k in range(6)), *((20 + k, near(b, k)) for k in range(6)), (1, near(b, 9)), (30, "other"), (31, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df, shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 30 if i >= 30 else 1 for i, _ in rows} and len(got) == len(rows)
    monkeypatch.setattr(minhash_dedup, "BROADCAST_IDS", 0)
    again = minhash_dedup.near_duplicates(df.union(spark.createDataFrame([(40, None), (None, "x")], df.schema)), shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in again if r.doc_id} == {i: 30 if i >= 30 else 1 for i, _ in rows} | {40: 40}


def test_bands_follow_the_threshold():
    for percent in (50, 80, 85, 100):
        n = minhash_dedup.bands_for(percent, 4)
        assert (1 - (percent / 100) ** 4) ** n <= minhash_dedup.MISS
    assert minhash_dedup.bands_for(85, 4) == 20


def test_minhash_block_against_block(spark, monkeypatch):
    """Buckets of many blocks, whose members link with each other but rarely with the centre."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        t = list(base)
        for j in rng.sample(range(0, 100, 4), 4):
            t[j] = f"v{rng.randrange(3)}"
        rows.append((i, " ".join(t)))
    sets = word_sets(rows, 3)
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == classes(sets, links)


def test_odd_sketch_bound_keeps_pairs_at_the_threshold():
    rng, n, samples = np.random.default_rng(1), 2000, minhash_dedup.Samples(minhash_dedup.SKETCH_SAMPLES, 2)
    worst = 0
    for _ in range(150):
        x = rng.integers(0, 1 << 63, n + n * 3 // 17, dtype=np.uint64)  # 85 % of the union are shared
        a, b = x[: n + n * 3 // 34], np.concatenate([x[: n], x[n + n * 3 // 34 :]])
        d = np.bitwise_count((minhash_dedup.odd_sketch(samples.of(a)) ^ minhash_dedup.odd_sketch(samples.of(b))).view(np.uint64)).sum()
        worst = max(worst, d)
    assert worst <= minhash_dedup.sketch_bound(minhash_dedup.SKETCH_SAMPLES, 85)


def brute_links(rows, threshold=0.98):
    links = []
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None for x in v):
            continue
        a = np.array(v, float)
        if len(a) and np.isfinite(a).all() and a.any():
            ok[k] = (a / np.linalg.norm(a), label)
    for i, j in itertools.combinations(ok, 2):
        (a, x), (b, y) = ok[i], ok[j]
        if x == y and len(a) == len(b) and a @ b >= threshold:
            links.append((i, j))
    return links


@pytest.mark.parametrize("dim,block", [(64, 512), (10, 16)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng, rows = np.random.default_rng(dim), []
    for label in (0, 1):
        for c in rng.normal(size=(12, dim)):
            for _ in range(8):
                rows.append((len(rows), (c + rng.normal(size=dim) * 0.13 * rng.random()).astype(np.float32).tolist(), label))
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)] + [(2000, rows[0][1], None), (2001, [0.0] * dim, 0), (2002, None, 0), (2003, [float("nan")] * dim, 0), (2004, [float("inf")] + [1.0] * (dim - 1), 0), (2005, [None] * dim, 0), (2006, [], 0), (2007, [x * 7 for x in rows[0][1]], 0), (2008, [1.0, 2.0], 0), (2009, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    links = brute_links(rows)
    near = [abs(np.dot(np.array(rows[i][1], float), np.array(rows[j][1], float)) / np.linalg.norm(np.array(rows[i][1], float)) / np.linalg.norm(np.array(rows[j][1], float)) - 0.98) for i, j in links]
    assert len(links) > 500 and min(near) > 1e-12
    n, comp = [0] * len(rows), classes(range(len(rows)), links)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    want = sorted((rows[i][0], n[i], rows[comp[i]][0], comp[i] == i) for i in range(len(rows)))
    assert sorted(tuple(r) for r in embedding_dedup.linked(df).collect()) == want
    assert embedding_dedup.linked(df.limit(0)).count() == 0


def test_embedding_ids_that_repeat_with_other_vectors(spark, monkeypatch):
    rows = [(4, [1.0, 0.0], 0), (4, [0.0, 1.0], 0), (5, [1.0, 0.001], 0), (6, [0.001, 1.0], 0), (3, [0.002, 1.0], 0), (9, None, 0)]
    want = [(3, 2, 3, True), (4, 1, 4, True), (4, 2, 3, False), (5, 1, 4, False), (6, 2, 3, False), (9, 0, 9, True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in embedding_dedup.linked(df).collect()) == want
    monkeypatch.setattr(embedding_dedup, "LINKED_CLASSES", 0)
    assert sorted(tuple(r) for r in embedding_dedup.linked(df).collect()) == want
    with pytest.raises(ValueError):
        embedding_dedup.linked(df, threshold=0.9)


def test_embedding_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.001], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in embedding_dedup.linked(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)]


@pytest.mark.parametrize("shard,k", [(2048, 10), (16, 3), (5, 10)])
def test_maxscore_equals_brute_force(spark, monkeypatch, shard, k):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "QUERIES", 2)
    monkeypatch.setattr(maxscore, "PART", 7)
    rng = np.random.default_rng(shard)
    v = rng.normal(size=(150, 12)) * rng.choice([0.1, 1, 5], size=(150, 1))
    v[40:60] = v[0]
    v[60:70] = np.round(v[60:70])
    rows = [(i * 10, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9100, [float("nan")] * 12), (9200, [None] * 12), (9300, [1.0] * 5), (9400, []), (None, [1.0] * 12)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 100 == 0, k=k).collect())
    sound = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q, x in sound:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in sound if i != q)[:k]  # noqa: B905
            want += [(q, r + 1, i, -z) for r, (z, i) in enumerate(s)]
    assert got == sorted(want)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_maxscore_prunes_and_survives_large_numbers():
    rng = np.random.default_rng(3)
    v = rng.integers(-1000, 1000, (500, 16))
    s = maxscore.Shard(np.arange(500), np.arange(500), v)
    for q in range(20):
        full = s.top(v[q], q, 10, None)
        assert s.top(v[q], q, 10, full[-1][0]) == full
        assert [x for x in s.top(v[q], q, 10, full[4][0]) if x[0] >= full[4][0]] == [x for x in full if x[0] >= full[4][0]]
    # One strong row in the part with the highest bound raises the threshold for the others.
    v = rng.integers(-10, 10, (4 * maxscore.PART, 16))
    v[5] = 1000
    s = maxscore.Shard(np.arange(len(v)), np.arange(len(v)), v)
    assert s.top(np.ones(16, int), -1, 1, 0) == [(16000, 5)] and s.probed <= maxscore.PART * 16
    big = maxscore.Shard(np.arange(3), np.arange(3), np.array([[2**40, 1], [2**40, 2], [2**40, 3]]))
    assert big.top(np.array([2**20, 1]), 9, 2, None) == [(2**60 + 3, 2), (2**60 + 2, 1)]


@pytest.mark.parametrize(("block", "whole", "copied"), [(256, 4, 0), (8, 4, 1), (16, 1, 1)])
def test_minhash_buckets_in_one_row_are_not_copied(spark, monkeypatch, block, whole, copied):
    """Chains of near copies around texts that are near none of them: components equal brute force, and only buckets of more than `whole` blocks are dealt as pairs of blocks."""
    rng, rows = random.Random(5), []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(60):
            t = list(base)
            for at in rng.sample(range(120), rng.randrange(1, 5)):
                t[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    dealt, plain, before = [], minhash_dedup.block_pairs, set(common._scratch)
    monkeypatch.setattr(minhash_dedup, "block_pairs", lambda *a, **k: dealt.append(1) or plain(*a, **k))
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "WHOLE", whole)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    sets = word_sets(rows, 3)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert links and got == classes(sets, links)
    assert len(dealt) == copied
    left = [p.removeprefix("file://") for p in common._scratch if p not in before]
    assert sum(os.path.exists(f"{p}/_SUCCESS") for p in left) == len(left) < 16
