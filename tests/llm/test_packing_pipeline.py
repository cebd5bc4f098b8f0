import collections
import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pixelloom.llm import packing

PATH = P.path("word_bpe_49k.json")


def test_ids_by_pieces_equal_library(monkeypatch):
    t, c, rng = Tokenizer.from_file(PATH), packing.Pieces(PATH, 1), random.Random(1)
    assert c.by_words
    parts = ["the", "Thhehesh&&&", "don't", "'S", "Straße", "É", "é", "İ", "ﬁ", "日本", "🙂", "a1b22", "<|endoftext|>", " ", "\n", "\t", " ", "\x1c", "\x85", "²", "ǅ", "ﾞ", "´", "­", "\x00", "-"]
    for size, memo in ((1 << 20, 100_000), (1 << 20, 3), (5, 100), (1, 0)):
        monkeypatch.setattr(packing, "SPAN_CHARS", size)
        monkeypatch.setattr(packing, "MEMO_PIECES", memo)
        c.forget()
        texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 12))) for _ in range(1500)]
        for i in range(0, len(texts), 50):
            own = texts[i : i + 50]
            ids, n = c.encoded(own)
            for text, got in zip(own, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                assert got.tolist() == t.encode(text, add_special_tokens=False).ids + [1], repr(text)
            assert len(c) <= memo + 1 == len(c.at) or len(c) == len(c.at)
    assert [x.tolist() for x in c.encoded([])] == [[], []] and [x.tolist() for x in c.encoded([""])] == [[1], [1]]


def check_pieces(rows, pieces, length):
    t = Tokenizer.from_file(PATH)
    want = collections.Counter(tuple(t.encode(x or "", add_special_tokens=False).ids + [1]) for _, x, _ in rows)
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length
    got = collections.Counter()
    for own in by.values():
        ids = np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in sorted(own, key=lambda p: p.start)])
        if len({p.start for p in own}) == len(own):
            assert [p.start for p in sorted(own, key=lambda p: p.start)] == np.cumsum([0] + [p.length for p in sorted(own, key=lambda p: p.start)])[:-1].tolist()
            got[tuple(ids.tolist())] += 1
        else:  # a repeated id
            got += collections.Counter({k: v for k, v in want.items() if len(k) == own[0].doc_tokens and v > 1})
    assert got == want
    sizes = []
    for s in sorted(seqs):
        at = 0
        for p in sorted(seqs[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert sorted(seqs) == list(range(len(seqs)))
    assert all(n == length or n & (n - 1) == 0 for n in sizes) and sum(n != length for n in sizes) <= length.bit_length()


@pytest.mark.parametrize("length", [8, 64, 2048])
def test_pack_whole_documents(spark, length):
    rng = random.Random(length)
    rows = [(i, " ".join(rng.choices(["the", "house", "thhehesh&&&", "É!"], k=rng.randrange(0, 60))), rng.choice(["s0", "s0", "s0", "s1", None])) for i in range(200)]
    rows += [(500, None, "s1"), (501, "", "s2"), (502, "word " * 20_000, "s3"), (503, "same row", "s1"), (503, "same row", "s1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, start int")
    pieces = packing.pack(df, PATH, length=length)
    check_pieces(rows, pieces.collect(), length)
    packed = packing.sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.length for r in packed)
    assert packing.pack(df.limit(0), PATH, length=length).count() == 0


def test_windows_hold_target_proportions(spark):
    rng = random.Random(5)
    rows = [(i, i, "hot" if i % 3 else f"s{i % 4}", rng.randrange(20, 80)) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_key long, id long, source string, n long")
    places, total = packing.scheduled(df, 10_000)
    first = {r.row_key: r.first for r in places.collect()}
    order = sorted(rows, key=lambda r: first[r[0]])
    at = 0
    for r in order:
        assert first[r[0]] == at
        at += r[3]
    assert at == total
    share = collections.Counter()
    for r in rows:
        share[r[2]] += r[3]
    for w in range(total // 10_000):
        got = collections.Counter()
        for r in rows:
            if w * 10_000 <= first[r[0]] < (w + 1) * 10_000:
                got[r[2]] += r[3]
        assert all(abs(got[s] - 10_000 * n / total) <= 400 for s, n in share.items())


def test_weights_set_proportions_until_a_queue_ends(spark):
    rows = [(i, i, "a" if i % 2 else "b", 10) for i in range(4000)]
    places, _ = packing.scheduled(spark.createDataFrame(rows, "row_key long, id long, source string, n long"), 1000, {"a": 0.75, "b": 0.25})
    first = {r.row_key: r.first for r in places.collect()}
    early = [r for r in rows if first[r[0]] < 20_000]
    assert abs(sum(r[2] == "a" for r in early) / len(early) - 0.75) < 0.02


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, d))
        got = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        assert got and got <= ids
        if name in ("lines", "packing"):
            assert got == ids
        if name != "packing":
            assert out.columns == docs.columns
        docs, ids = out, got
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert {i for i, _, _ in rows} >= ids
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_lines_stage_drops_boilerplate_by_the_ratio_alone(spark):
    """Short pages of mostly shared lines lose them too; only pages without a line of their own that are whole copies stay."""
    menu, page, note = "menu " * 20, "one page\nof two lines", "all rights reserved"
    rows = [(i, f"{menu}\nown {i}", "s") for i in range(30)]
    rows += [(i, page, "s") for i in range(100, 110)] + [(200, note, "s"), (201, f" {menu}\n", "s")]
    rows += [(i, f"{note}\nown {i}", "s") for i in range(300, 310)]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, df, "").collect()}
    want = {i: f"own {i}" for i in [*range(30), *range(300, 310)]} | dict.fromkeys(range(100, 110), page) | {200: "", 201: ""}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, "en", "s", 0), (4, "other text", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect() if r.doc_id != 3)
    assert got == [(1, text), (4, "other text")]


def test_library_works_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    os.system(f"cp -r {root}/pixelloom {root}/__spark_entry__.py {tmp_path} && rm -rf {tmp_path}/pixelloom/llm")
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
