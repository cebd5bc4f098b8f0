import hashlib
import random

import public_tokenizers as P
import pytest

from pixelloom.llm.byte_bpe import TreeCodec, decode, encode, encode_digests, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
PARTS = ["the", "Straße", "don't", "'", "'s", "'re", " ", "  ", "\n", "\t", "　", " ", "\x1c", "123", "٣", "&&&", "é", "é", "日本語", "🙂", "x" * 30, "9" * 25, "!" * 40, " a", "thhehesh"]


@pytest.mark.parametrize("leaf,run", [(2, 4), (3, 1), (7, 8), (50, 16), (16384, 2048)])
def test_tree_equals_library(leaf, run):
    c, rng = TreeCodec(RANKS, P.PATTERN, leaf, run), random.Random(leaf)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40)))
        ids = c.encode(text)
        assert ids == c.encoding.encode_ordinary(text), repr(text)
        assert c.decode(ids) == text.encode()


def test_long_runs_join_id_by_id():
    c, rng = TreeCodec(RANKS, P.PATTERN, 64, 32), random.Random(1)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "the", "日本語中文", "0123456789", "!#-", "a", " ", "\n ", "'s"):
        text = "".join(rng.choice(alphabet) for _ in range(5000))
        assert c.encode(text) == c.encoding.encode_ordinary(text)


def test_ordinary_documents_come_through_joins(spark):
    """Every text of more than a leaf is halved down to leaves and joined on the way up, and so are its ids in decoding."""
    c, n = TreeCodec(RANKS, P.PATTERN), {"join": 0, "leaf": 0}
    join, plain = c.join, c.plain

    def counted(*args):
        n["join"] += 1
        return join(*args)

    c.join = counted
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        n["join"] = 0
        ids = c.encode(t)
        leaves = lambda k: 1 if k <= c.leaf else leaves(k // 2) + leaves(k - k // 2)  # noqa: E731, B023
        assert n["join"] == leaves(len(t)) - 1 and ids == plain(t) and c.decode(ids) == t.encode()
    assert sum(len(t) > c.leaf for t in texts) > 0.9 * len(texts)


def test_every_token_is_reachable():
    c = TreeCodec(RANKS, P.PATTERN)
    assert all(c._bpe(b) == [i] for b, i in RANKS.items())


def test_query_edge_cases(spark):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, "word " * 9000 + "x" * 50_000), (5, "Hello  world"), (5, "Hello  world"), (None, "a")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    c = TreeCodec(RANKS, P.PATTERN)
    got = sorted((tuple(r) for r in encode_digests(df, PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = c.encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_digests(df.limit(0), PATH, P.PATTERN).count() == 0
    back = decode(encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.n_tokens == 7 for r in back)
