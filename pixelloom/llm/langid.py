"""Operator 2: language ID by word-first backoff.

A word that training has seen scores by its log frequency in each language.
An unseen word is covered from left to right by the longest known character
n-grams (MAX_N down to 1, with marks for the word's ends), which score
likewise. The scores of all words of the whole text add up; the language
with the highest sum wins, ties go to the first name.

The model is fitted on a bounded sample of labelled rows; its tables hold
MODEL_ENTRIES words and as many n-grams at most, whatever the input, so it
can be sent to every worker. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.llm.common import give_back, prepare, spans, written
from pixelloom.llm.sampling import bounded_ids, held_out

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 5000
#: Longest n-gram.
MAX_N = 4
#: Words, and n-grams, that the model holds at most, over all languages.
MODEL_ENTRIES = 120_000
#: Words beyond the model's whose scores a task remembers, and characters of text that are scored at a time.
MEMO_WORDS, SPAN_CHARS = 100_000, 1 << 21
#: Lower-cased letters of Latin-1, for such texts, by the faster standard library; and letters of any text.
_LATIN, _LATIN_WORDS, _WORDS = re.compile("[\x00-\xff]*").fullmatch, re.compile("[a-zªµºß-öø-ÿ]+").findall, regex.compile(r"\p{L}+").findall

#: What is predicted for a text that is null or has no letter.
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # rows of word_scores: log frequency in each language
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


class Scorer(dict):
    """self[word] is the word's row in a table of scores: the model's words first, then others as they come.

    A new word gets its scores by back-off when its group of texts is
    scored; the first MEMO_WORDS of those stay known, the rest for their
    group only.
    """

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.k = model, len(model.languages)
        self.rows, self.new = model.word_scores, []
        #: A word without any known n-gram has the last row.
        self.gram_scores = np.concatenate([model.gram_scores, np.zeros((1, self.k), np.float32)])

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        row = self[word] = len(self)
        return row

    def backoff(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: the sums of those of the n-grams that cover it."""
        grams, flat, starts = self.model.grams, [], []
        for word in words:
            starts.append(len(flat))
            s, i = f"^{word}$", 0
            end = len(s)
            while i < end:
                for n in range(min(MAX_N, end - i), 0, -1):
                    if (got := grams.get(s[i : i + n])) is not None:
                        flat.append(got)
                        break
                i += n
            if len(flat) == starts[-1]:
                flat.append(len(grams))
        return np.add.reduceat(self.gram_scores[flat], starts, axis=0)

    def words(self, text: str) -> list[str]:
        return _LATIN_WORDS(text.lower()) if _LATIN(text) else _WORDS(text.lower())

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed scores of each text in each language, and its number of words. A text's sum doesn't depend on its neighbours."""
        total, count = np.zeros((len(texts), self.k)), np.zeros(len(texts), np.int64)
        codes: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            rows = np.concatenate([self.rows, self.backoff(self.new)]) if self.new else self.rows
            n = [len(c) for c in codes]
            if codes:
                total[owner] += np.add.reduceat(rows[np.concatenate(codes)].astype(np.float64), np.cumsum([0, *n[:-1]]), axis=0)
                count[owner] += n
            room = len(self.model.words) + MEMO_WORDS
            if len(self) > room:
                for w in self.new[max(0, room - len(self.rows)) :]:
                    del self[w]
            self.rows, self.new = rows[: len(self)], []
            codes.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if size + len(text) > SPAN_CHARS:
                flush()
            for span in spans(text, SPAN_CHARS):
                if owner and owner[-1] == i:
                    flush()
                if words := self.words(span):
                    codes.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
                    owner.append(i)
                size += len(span)
        flush()
        return total, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text, and its share of the likelihood."""
        if not self.k:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        total, count = self.sums(texts)
        s = (total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(count, 1))[:, None]
        best, score = s.argmax(1), 1 / np.exp(s).sum(1)
        some = count > 0
        return [self.model.languages[b] if x else UNDETERMINED for b, x in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0).tolist()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, entries: int = MODEL_ENTRIES) -> Model:
    """A model from at most train_rows rows of docs with text and language that aren't held out."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    few = F.broadcast(bounded_ids(usable, id_col, train_rows))
    sample = usable.join(few, id_col, "left_semi").select(F.col(lang_col).alias("lang"), F.explode(F.expr(f"regexp_extract_all(lower(`{text_col}`), '\\\\p{{L}}+', 0)")).alias("gram"))
    words = written(sample.groupBy("lang", "gram").agg(F.count("*").alias("n")))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    each = max(1, entries // max(1, len(languages)))
    parts = words.withColumn("gram", F.concat(F.lit("^"), "gram", F.lit("$"))).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("gram")))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(MAX_N))))
    grams = written(parts.where("i + k <= length(gram) + 1").select("lang", F.col("k").alias("kind"), F.expr("substring(gram, i, k)").alias("gram"), "n").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))

    def table(rows: DataFrame, keep: int) -> tuple[dict[str, int], np.ndarray]:
        """gram -> row, and rows of the log of its smoothed share among those of its kind, less the mean of all languages.

        An entry is one of the `keep` most frequent of its kind in some language; its counts are those of every language.
        """
        top = rows.withColumn("r", F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= keep)
        sums = {(r.lang, r.kind): r.n for r in rows.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
        counts: dict[tuple[int, str], np.ndarray] = {}
        for r in rows.join(top.select("kind", "gram").distinct(), ["kind", "gram"], "left_semi").select("lang", "kind", "gram", "n").toLocalIterator():
            counts.setdefault((r.kind, r.gram), np.zeros(len(languages)))[languages.index(r.lang)] = r.n
        size = {kind: np.array([sums.get((x, kind), 0) for x in languages]) + 1.0 for _, kind in sums}
        out, scores = {}, np.zeros((len(counts), len(languages)), np.float32)
        for i, ((kind, gram), c) in enumerate(counts.items()):
            p = np.log((c + 0.5) / (size[kind] + 0.5 * len(counts)))
            out[gram], scores[i] = i, p - p.mean()
        return out, scores

    return Model(languages, *table(words.withColumn("kind", F.lit(0)), each), *table(grams, max(1, each // MAX_N)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, lang_pred and score (0 to 1) of the whole text.

    lang_pred is `und` with score 0 if text is null or has no letter, or no
    language was learned. Columns of these names are replaced; repeated rows
    get equal results; an empty table gives none.
    """
    prepare(docs.sparkSession)
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            lang, score = scorer.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])
        del scorer
        give_back()

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{cols}, lang_pred string, score double")
