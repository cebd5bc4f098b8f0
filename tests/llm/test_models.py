import random

import numpy as np
import pytest
import regex

from pixelloom.llm import langid, quality
from pixelloom.llm.sampling import bounded_ids

WORDS = {"aa": ["the", "house", "river", "walks", "green"], "bb": ["das", "haus", "flüsse", "geht", "grün"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=30)), lang, 1.0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_language_by_words_and_backoff(spark, docs):
    model = langid.fit(docs)
    asked = [(1, "the green house"), (2, "das haus"), (3, "hausflüsse gehtgrün"), (4, "riverhouse walksgreen"), (5, None), (6, ""), (7, "123 --- !"), (8, "the " * 50_000), (None, "the"), (1, "the green house")]
    df = spark.createDataFrame([(*r, 0.0, "x") for r in asked], "doc_id long, text string, score double, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, model).collect()]
    assert [g[1] for g in got] == ["aa", "bb", "bb", "aa", "und", "und", "und", "aa", "aa", "aa"]
    assert all(0 <= s <= 1 for _, _, s in got) and got[0][2] == got[-1][2]
    assert langid.predict(df.limit(0), model).count() == 0


def test_language_counts_are_true_in_every_language(spark):
    """An entry that one language's list holds has its counts of the other languages too, below their own lists."""
    seen = {"aa": {"w": 9, "x": 8, "y": 1}, "bb": {"p": 9, "q": 8, "w": 7, "x": 1}}
    ids = spark.range(50).where("crc32(cast(cast(id as string) as binary)) % 3 <> 1").limit(2).collect()
    rows = [(i.id, " ".join(" ".join([w] * n) for w, n in c.items()), lang) for i, (lang, c) in zip(ids, seen.items(), strict=True)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), entries=4)
    assert set(model.words) == {"w", "x", "p", "q"}
    for w, row in model.words.items():
        p = [np.log((c.get(w, 0) + 0.5) / (sum(c.values()) + 1 + 0.5 * 4)) for c in seen.values()]
        assert model.word_scores[row] == pytest.approx(np.array(p) - np.mean(p), abs=1e-5)


def test_language_without_labels(spark, docs):
    model = langid.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()} == {("und", 0.0)}


def brute_language(model, text):
    """Word by word, n-gram by n-gram."""
    words = regex.findall(r"\p{L}+", (text or "").lower())
    if not words:
        return "und", 0.0
    total = np.zeros(len(model.languages))
    for w in words:
        if w in model.words:
            total += model.word_scores[model.words[w]]
            continue
        s = f"^{w}$"
        while s:
            n = next((n for n in range(min(langid.MAX_N, len(s)), 0, -1) if s[:n] in model.grams), 0)
            total += model.gram_scores[model.grams[s[:n]]] if n else 0
            s = s[n or 1 :]
    p = np.exp((total - total.max()) / len(words) ** 0.5)
    return model.languages[int(np.argmax(total))], p.max() / p.sum()


def test_language_equals_brute_force(spark, docs, monkeypatch):
    """Also with memos that overflow, and with texts longer than a span."""
    rng = random.Random(6)
    parts = ["The", "haus", "GRÜN", "riverhouse", "flüssegehen", "qqq", "日本", "ОДОС", "İx", "ŒUVRE", "x1y", "---", "\n", "\x85", "a b"]
    texts = [None, "", "12 --"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    model = langid.fit(docs)
    want = [brute_language(model, t) for t in texts]
    for memo, size in ((100_000, 1 << 21), (5, 1 << 21), (0, 200), (7, 20)):
        monkeypatch.setattr(langid, "MEMO_WORDS", memo)
        monkeypatch.setattr(langid, "SPAN_CHARS", size)
        scorer = langid.Scorer(model)
        for lo in range(0, len(texts), 100):
            got = list(zip(*scorer.predict(texts[lo : lo + 100]), strict=True))
            for (x, p), (y, q) in zip(got, want[lo : lo + 100], strict=True):
                assert p == pytest.approx(q, abs=1e-5) and (x == y or abs(p - 0.5) < 1e-5)
            assert len(scorer) == len(scorer.rows) <= len(model.words) + memo


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_chunks_cover_all_bytes():
    for n in (0, 1, 1023, 1024, 1025, 1920, 5000, 100_001):
        data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
        c = quality.chunked(data.tobytes())
        if n > quality.CHUNK:
            starts = np.minimum(np.arange(len(c)) * (quality.CHUNK - quality.OVERLAP), n - quality.CHUNK)
            seen = np.zeros(n, bool)
            for s, row in zip(starts, c, strict=True):
                assert (row == data[s : s + quality.CHUNK]).all()
                seen[s : s + quality.CHUNK] = True
            assert seen.all()
        else:
            assert (c[0, :n] == data).all() and not c[0, n:].any()


def test_pair_tables_equal_plain_convolution():
    net = quality.Network(np.random.default_rng(1).normal(size=(quality.WIDTH, 256, quality.FILTERS)), np.full(quality.FILTERS, 0.1), np.random.default_rng(2).normal(size=quality.FILTERS), 0.2)
    texts = ["abc", "", None, "Straße " * 900, "x" * 3000]
    got = quality.Scoring(net).scores(texts)
    for t, g in zip(texts, got, strict=True):
        c = quality.chunked((t or "").encode())
        n = quality.CHUNK - quality.WIDTH + 1
        s = sum(net.tables[k][c[:, k : k + n]] for k in range(quality.WIDTH))
        f = np.maximum(s.max(1) + net.bias, 0).mean(0)
        assert g == pytest.approx(1 / (1 + np.exp(-np.clip(f @ net.weights + net.offset, -30, 30))), abs=1e-4)


def test_quality_learns_and_handles_edges(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(240):
        good = i % 2 == 0
        rows.append((i, " ".join(rng.choice(WORDS["aa"]) + ("" if good else rng.choice(["!!", "%%%"])) for _ in range(rng.randrange(20, 400)))))
        labels += [(i, int(good), 0)] * (1 + (i == 3)) + ([(i, None, 0)] if i == 5 else [])
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = quality.fit(docs, known)
    asked = spark.createDataFrame([(1, "the house", 9.0), (2, None, 9.0), (3, "", 9.0), (4, "river!! the!! house%%% " * 20_000, 9.0), (None, "the house", 9.0)], "doc_id long, text string, score double")
    got = [r.score for r in quality.score(asked, net).collect()]
    assert got[1] == got[2] and got[0] == got[4] and got[3] < 0.5 and all(0 <= s <= 1 for s in got)
    scored = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert sum((scored[i] >= 0.5) == (i % 2 == 0) for i in range(240)) >= 228
    assert quality.score(asked.limit(0), net).count() == 0
    assert {r.score for r in quality.score(asked, quality.fit(docs, known.limit(0))).collect()} == {0.5}
    assert quality.score(asked, quality.fit(docs, known.where("quality = 1"))).first().score > 0.99


def test_bounded_ids_are_bounded_and_stable(spark, docs):
    ids = sorted(r.doc_id for r in bounded_ids(docs, "doc_id", 17).collect())
    assert len(ids) == 17 and ids == sorted(r.doc_id for r in bounded_ids(docs.repartition(5), "doc_id", 17).collect())
