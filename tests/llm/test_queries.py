"""Every registered query of the training-data operators, on a whole small table, against SQL or a plain version."""

import collections
import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_models import brute_language
from test_packing_pipeline import check_pieces
from test_pairs import classes, word_sets
from test_sharding_chat_lines import brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from pixelloom.llm import byte_bpe, langid, packing, quality
from pixelloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def components(sets, percent):
    full = {i: s for i, s in sets.items() if s}
    links = [(a, b) for a, b in itertools.combinations(full, 2) if 100 * len(full[a] & full[b]) >= percent * len(full[a] | full[b])]
    return classes(sets, links)


def plain_quality(net, text):
    """Filter by filter over one-hot bytes, without tables of pairs."""
    c = quality.chunked((text or "").encode())
    n = quality.CHUNK - quality.WIDTH + 1
    s = sum(net.tables[k][c[:, k : k + n]] for k in range(quality.WIDTH))
    return 1 / (1 + np.exp(-np.clip(np.maximum(s.max(1) + net.bias, 0).mean(0) @ net.weights + net.offset, -30, 30)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    df = QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == sorted([plain(v) for v in r] for r in rel.fetchall())


def test_op2(spark):
    docs = read(spark, "documents")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        lang, score = brute_language(model, r.text)
        g = got[r.doc_id]
        assert g.held_out == is_held_out(r.doc_id) and g.score == pytest.approx(score, abs=1e-5) and (g.lang_pred == lang or abs(score - 0.5) < 1e-5)
    held = [r for r in rows if is_held_out(r.doc_id) and r.lang is not None and got[r.doc_id].lang_pred != "und"]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_op6(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    net = quality.fit(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op6_quality"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = plain_quality(net, r.text)
        g = got[r.doc_id]
        assert g.held_out == is_held_out(r.doc_id) and g.score == pytest.approx(want, abs=1e-4) and g.predicted == int(g.score >= 0.5)


def test_op6_held_out_accuracy(spark):
    """Texts of more than four chunks too."""
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r.predicted for r in QUERIES["op6_quality"](spark, d).where("held_out").collect()}
    known = [(r.quality == got[r.doc_id], r.n_chars) for r in spark.read.parquet(f"{d}/labels.parquet").where("quality is not null").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id").collect() if r.doc_id in got]
    assert np.mean([x for x, _ in known]) >= 0.95 and np.mean([x for x, n in known if n > 4096] or [1]) >= 0.9


def test_op6_gradient_follows_the_loss():
    """The first Adam step goes against a numeric gradient."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (50, 1500, 30, 4000)]
    y = np.array([1.0, 0.0, 1.0, 0.0])
    net = quality.train(texts, y)
    loss = lambda n: -np.mean([t * np.log(p) + (1 - t) * np.log(1 - p) for t, p in zip(y, (np.clip(plain_quality(n, x.decode()), 1e-9, 1 - 1e-9) for x in texts), strict=True)])
    r = np.random.default_rng(7)
    start = quality.Network(r.normal(0, 0.1, (quality.WIDTH, 256, quality.FILTERS)), np.zeros(quality.FILTERS), r.normal(0, 0.3, quality.FILTERS), 0.0)
    assert loss(net) < loss(start)


def test_op7(spark):
    rows = [(r.doc_id, r.text, r.source) for r in read(spark, "documents").collect()]
    pieces = packing.pack(read(spark, "documents"), P.path("word_bpe_49k.json")).collect()
    check_pieces(rows, pieces, 2048)
    want = sorted((p.doc_id, p.start, p.length, zlib.crc32(bytes(p.ids)), p.doc_tokens, p.sequence_id, p.offset) for p in pieces)
    assert sorted(tuple(r) for r in QUERIES["op7_packing"](spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()) == want


def test_op7_round_by_round(spark):
    """A queue earns its quantum every round, sends what its credit covers, and keeps the rest."""
    rng = np.random.default_rng(2)
    rows = [(i, i, ["a", "b", "c"][int(rng.choice(3, p=[0.6, 0.3, 0.1]))], int(rng.integers(1, 900))) for i in range(1500)]
    df = spark.createDataFrame(rows, "row_key long, id long, source string, n long")
    quantum = {"a": 512, "b": 384, "c": 128}
    places, total = packing.scheduled(df, 1024, {s: q / 1024 for s, q in quantum.items()})
    first = {r.row_key: r.first for r in places.collect()}
    h = {r.id: r.h for r in df.selectExpr("id", "xxhash64(id) AS h").collect()}
    queues = {s: collections.deque(sorted((r for r in rows if r[2] == s), key=lambda r: (h[r[1]] % packing.SUB_QUEUES, h[r[1]], r[0]))) for s in quantum}
    credit, order = dict.fromkeys(quantum, 0), []
    while any(queues.values()):
        for s in sorted(quantum):
            if queues[s]:
                credit[s] += quantum[s]
            while queues[s] and queues[s][0][3] <= credit[s]:
                credit[s] -= queues[s][0][3]
                order.append(queues[s].popleft())
    at = 0
    for r in order:
        assert first[r[0]] == at
        at += r[3]
    assert at == total


def test_op9(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    sets = word_sets(rows, 3)
    comp = components(sets, 85)
    got = QUERIES["op9_minhash_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(sets[i]), comp[i], comp[i] == i) for i, _ in rows)


def test_op10(spark):
    library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = {}
    for r in read(spark, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want


def test_pipeline_equals_brute_force(spark):
    """Stage by stage with plain versions of the operators, on what the plain stage before kept."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    frame = lambda: spark.createDataFrame([tuple(r.values()) for r in rows.values()], docs.schema)

    net = quality.fit(docs, labels)
    rows = {i: r for i, r in rows.items() if plain_quality(net, r["text"]) >= corpus_pipeline.MIN_QUALITY}
    model = langid.fit(frame())
    told = {i: brute_language(model, r["text"]) for i, r in rows.items()}
    rows = {i: {**r, "lang": r["lang"] or told[i][0]} for i, r in rows.items() if told[i][0] != "und" and told[i][1] >= corpus_pipeline.MIN_LANGUAGE}
    for r, (_, text, n) in zip(rows.values(), brute_lines([(r["source"], r["text"]) for r in rows.values()], 0.1, 5, True), strict=True):
        r.update(text=text, n_chars=len(text) if n else r["n_chars"])
    comp = components(word_sets([(i, r["text"]) for i, r in rows.items()], 5), 80)
    rows = {i: r for i, r in rows.items() if comp[i] == i}
    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: np.array(tokens.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for i, r in rows.items()}

    by = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).collect():
        by[p.doc_id].append(p)
    assert by.keys() == want.keys() and 0 < len(want) < docs.count()
    for i, own in by.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i]) // 4 and p.ids_crc32 == zlib.crc32(want[i][4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(want[i]) // 4
    size = collections.Counter()
    for p in itertools.chain(*by.values()):
        size[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in size.values())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_edge_cases(spark, stage):
    """Null in any column, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    clash = ["start", "offset", "score", "lang_pred", "n_dropped", "component_id", "kept", "id", "h1", "source_"]
    words = "the house is green and stands by a river "
    rows = [(None, "null id " + words, "en", "s", 1), (1, None, "en", "s", None), (2, "", None, "s", 0), (38, words * 20_000, "en", None, 9), (4, words, None, None, None), (4, words, None, None, None), (34, "Das Haus steht am Fluss und ist grün", "de", "t", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    df = spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], schema)
    out = stage(spark, df, SF)
    got = out.collect()
    if stage is not corpus_pipeline.pack:
        assert out.columns == df.columns
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and any(r.doc_id == 38 and len(r.text) == len(words) * 20_000 for r in got)
        assert all(r[c] == "x" for r in got for c in clash)
    else:
        assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert stage(spark, df.limit(0), SF).count() == 0
    if stage is corpus_pipeline.keep_language:
        assert [r.doc_id is not None for r in got].count(False) == 1 and not {1, 2} & {r.doc_id for r in got}
        assert stage(spark, df.withColumn("lang", df["lang"].substr(100, 1)).where("lang is null"), SF).count() == 3
