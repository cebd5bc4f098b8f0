import collections
import hashlib
import random

import duckdb
import pytest

from pixelloom.llm import chat, line_dedup, sharding


def brute_shards(rows, limit):
    """Splits on the next bit while a bucket is too large and holds several hashes."""
    h = [int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) for k, _ in rows]
    size = [len((t or "").encode()) for _, t in rows]
    out = [None] * len(rows)
    todo = [(0, list(range(len(rows))))]
    while todo:
        d, own = todo.pop()
        if sum(size[i] for i in own) <= limit or len({h[i] for i in own}) <= 1:
            for i in own:
                out[i] = (f"{d}-{h[i] >> (60 - d)}", d)
        else:
            for bit in (0, 1):
                todo.append((d + 1, [i for i in own if (h[i] >> (59 - d)) & 1 == bit]))
    return out


@pytest.mark.parametrize("limit", [1, 300, 2000, 10**9])
def test_shards_equal_brute_force(spark, limit):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(0, 120)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "z" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    got = {r.doc_id: (r.shard, r.shard_depth, r.n_bytes) for r in sharding.shards(df, limit=limit).collect()}
    want = {r[0]: (*w, len((r[1] or "").encode())) for r, w in zip(rows, brute_shards(rows, limit), strict=True)}
    assert got == want


def test_shards_deeper_than_the_bits_of_the_oracle(spark):
    """The MD5 of 4982 and 10760 have 24 bits in common: each document has its shard all the same."""
    rows = [(4982, "a" * 200), (10760, "b" * 200), (4400, "c"), (15208, "d")]
    got = {r.doc_id: (r.shard, r.shard_depth) for r in sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=300).collect()}
    assert list(map(got.get, (r[0] for r in rows))) == brute_shards(rows, 300)
    assert got[4982][1] == got[10760][1] > 24


def test_shard_limit_and_hot_key(spark):
    rows = [(7, "a" * 100)] * 300 + [(7, "d" * n) for n in (1400, 1500, 1501, 2999, 3000, 3001, 9000)] + [(i, "b" * 50) for i in range(100, 200)] + [(None, "c" * 10)] * 2 + [(7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shards(df, limit=3000).collect()
    assert len(got) == len(rows)
    size, n = collections.Counter(), collections.Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        n[r.shard] += 1
    assert len({r.shard for r in got if r.doc_id == 7}) > 5
    assert all(b <= 3000 or n[s] == 1 for s, b in size.items())
    again = collections.Counter((r.doc_id, r.text, r.shard) for r in sharding.shards(df.repartition(7), limit=3000).collect())
    assert again == collections.Counter((r.doc_id, r.text, r.shard) for r in got)
    assert sharding.shards(df.limit(0)).count() == 0


def brute_chat(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: tuple((r, t) for _, _, r, t in sorted(v)) for c, v in by.items()}
    first = {}
    for c in sorted(convs, key=lambda c: (c is not None, c or 0)):
        first.setdefault(convs[c], c) if c is not None else first.__setitem__(convs[c], None)
    inner = {v[:i] for v in convs.values() for i in range(1, len(v))}
    return {c: (len(v), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in v)) for v, c in first.items() if v not in inner}


def test_chat_equals_brute_force(spark):
    rng, rows = random.Random(5), []
    for c in range(150):
        words = rng.choices("ab", k=rng.randrange(1, 6))
        rows += [(c, i * 2, "user" if i % 2 == 0 else "assistant", w) for i, w in enumerate(words)]
    rows += [(900, 0, None, "a"), (900, 1, "user", None), (901, 0, "user", "x"), (901, 0, "user", "x"), (902, 5, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.render(df).collect()}
    assert got == brute_chat(rows)
    assert chat.render(df.limit(0)).count() == 0


def test_chat_collapses_snapshots_of_a_null_id(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (5, 0, "user", "a"), (5, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat.render(df).collect()] == [(4, 2)]


def brute_lines(rows, ratio, least, spare=False):
    total, holding = collections.Counter(), collections.Counter()
    for host, text in rows:
        total[host or ""] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""} if text is not None else set():
            holding[host or "", line] += 1
    bad = {k for k, n in holding.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for host, text in rows:
        kept = None if text is None else [x for x in text.split("\n") if (host or "", x.strip(" ")) not in bad]
        new = None if text is None else "\n".join(kept)
        copy = spare and text is not None and not any(x.strip(" ") for x in kept) and sum(t == text and (h or "") == (host or "") for h, t in rows) > 1
        if text is None or len(new) == len(text) or copy:
            out.append((host, text, 0))
        else:
            out.append((host, new, len(text.split("\n")) - len(kept)))
    return out


def test_lines_equal_brute_force(spark):
    rng, rows = random.Random(9), []
    for i in range(300):
        lines = [f"own line {i} {j} " + "w" * 40 for j in range(rng.randrange(0, 4))]
        lines += rng.sample(["menu", " login ", "", "imprint", "rare"], rng.randrange(0, 5))
        rng.shuffle(lines)
        rows.append((rng.choice(["a", "b", None, ""]), "\n".join(lines)))
    rows += [("a", None), ("c", "menu"), ("b", "menu\nmenu\n" + "x" * 50_000), ("b", "menu"), ("b", "menu")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "source string, text string, n_dropped int")
    key = lambda r: tuple(str(x) for x in r)
    for options in ({}, {"min_pages": 5}, {"ratio": 0.3}, {"spare_copies": True}, {"min_pages": 5, "spare_copies": True}):
        got = sorted((tuple(r) for r in line_dedup.drop_boilerplate(df, **options).select("source", "text", "n_dropped").collect()), key=key)
        assert got == sorted(brute_lines(rows, options.get("ratio", 0.1), options.get("min_pages", 2), options.get("spare_copies", False)), key=key)
        assert any(r[2] for r in got)
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_chat_oracle(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    want = sorted(con.execute(chat.ORACLE).fetchall())
    assert sorted(tuple(r) for r in chat.render(spark.read.parquet(path)).collect()) == want


def test_sharding_oracle(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.execute(sharding.oracle(20_000)).fetchall())
    got = sharding.shards(spark.read.parquet(path), limit=20_000).select("doc_id", "shard", "shard_depth", "n_bytes")
    assert sorted(tuple(r) for r in got.collect()) == want
