"""Language identification: words first, then ever shorter character n-grams.

A word that the model knows is scored by its log frequency in every language. Any other
word is cut, from the left, into the longest known n-grams of it (with marks for its
start and end), from ``LONGEST`` characters down to one, and their mean log frequency is
its score; characters that are unknown too say nothing. The language with the highest sum
over all words of a text is predicted, and its share of the posterior is the score.

Words and n-grams are counted by Spark over a bounded sample: per language the ``SAMPLE``
learnable rows with the smallest hash of their id. The driver gets the ``WORDS`` most
frequent words and ``NGRAMS`` n-grams that occur at least twice. These three numbers and
the number of languages bound the sample and the model; they are parameters. Texts are
scored in one pass; a worker remembers the scores of words it has met.

Defined cases: null text, and text without letters, is ``und`` with score 0; ties go to
the first language by name; rows with null language are not learned from; without rows to
learn from every text is ``und`` with score 0; null and repeated ids are rows like any
other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, column_type, lowest_hashes, stored

SAMPLE = 3_000
WORDS = 100_000
NGRAMS = 100_000
LONGEST = 5
#: Words whose scores a worker remembers.
REMEMBERED = 200_000
UNDECIDED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case. The pattern also lets other numerals through (fractions, circled and Roman ones); they separate words."""
    words = _WORD.findall(text.lower()) if text else []
    if "".join(words).isalpha():
        return words
    return [part for w in words for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


class Model:
    def __init__(self, langs: list[str], words: dict[str, np.ndarray], ngrams: dict[str, np.ndarray], longest: int):
        self.langs, self.words, self.ngrams, self.longest = langs, words, ngrams, longest

    def backed_off(self, word: str) -> np.ndarray:
        """Mean score of the longest known n-grams that cover the word."""
        word, at, sums, count = f"^{word}$", 0, np.zeros(len(self.langs)), 0
        while at < len(word):
            for n in range(min(self.longest, len(word) - at), 0, -1):
                if (found := self.ngrams.get(word[at:at + n])) is not None:
                    sums, count = sums + found, count + 1
                    break
            at += n
        return sums / max(1, count)

    def scorer(self):
        """A function from a text to (language, score) that remembers words."""
        place: dict[str, int] = {}
        rows = np.empty((1024, len(self.langs)))

        def learn(word: str) -> int:
            nonlocal rows
            if len(place) == len(rows):
                rows = np.concatenate([rows, np.empty_like(rows)])
            known = self.words.get(word)
            rows[len(place)] = self.backed_off(word) if known is None else known
            place[word] = at = len(place)
            return at

        def score(text: str | None) -> tuple[str, float]:
            words = words_of(text)
            if not words or not self.langs:
                return UNDECIDED, 0.0
            total = np.zeros(len(self.langs))
            for at in range(0, len(words), REMEMBERED // 4):
                part = words[at:at + REMEMBERED // 4]
                if len(place) + len(part) > REMEMBERED:
                    place.clear()
                index = [learn(w) if (i := place.get(w)) is None else i for w in part]
                total += rows[index].sum(0)
            best = int(total.argmax())
            return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())

        return score


def _table(counts: DataFrame, langs: list[str], limit: int) -> dict[str, np.ndarray]:
    """Centred log frequencies of the ``limit`` most frequent keys that occur twice at least."""
    sums = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"_{i}") for i, x in enumerate(langs)]
    kept = counts.groupBy("key").agg(F.sum("n").alias("_n"), *sums).where("_n > 1")
    totals = np.array(kept.agg(*[F.sum(f"_{i}") for i in range(len(langs))]).first(), np.float64) if langs else np.empty(0)
    out = {}
    for r in kept.orderBy(F.desc("_n"), "key").limit(limit).collect():
        logs = np.log((np.array(r[2:], np.float64) + 0.5) / (np.nan_to_num(totals) + 0.5 * limit))
        out[r[0]] = logs - logs.mean()
    return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
        words: int = WORDS, ngrams: int = NGRAMS, longest: int = LONGEST) -> Model:
    """``learn`` is a condition on ``docs`` that says which rows may be learned from."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = lowest_hashes(rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")), "_lang", "_id", sample)
    # At most `sample` ids per language: the bound of this broadcast.
    texts = (rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
             .join(F.broadcast(chosen), (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi").select("lang", "text"))

    def run(batches):
        from collections import Counter

        for batch in batches:
            found = Counter((lang, w) for lang, text in zip(batch[0].to_pylist(), batch[1].to_pylist()) for w in words_of(text))
            grams: Counter = Counter()
            for (lang, w), n in found.items():
                marked = f"^{w}$"
                for size in range(1, longest + 1):
                    for at in range(len(marked) - size + 1):
                        grams[lang, marked[at:at + size]] += n
            for kind, counted in ((0, found), (1, grams)):
                yield {"kind": [kind] * len(counted), "lang": [k[0] for k in counted], "key": [k[1] for k in counted], "n": list(counted.values())}

    schema = T.StructType().add("kind", T.IntegerType()).add("lang", T.StringType()).add("key", T.StringType()).add("n", T.LongType())
    counts = stored(arrow_map(texts, run, schema).groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")), "counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    return Model(langs, _table(counts.where("kind = 0"), langs, words), _table(counts.where("kind = 1"), langs, ngrams), longest)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred and score. Reads the id and the text only."""
    schema = T.StructType().add(id_col, column_type(docs, id_col)).add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def run(batches):
        score = model.scorer()
        for batch in batches:
            for at in range(0, len(batch), 1024):
                piece = batch.slice(at, 1024)
                found = [score(t) for t in piece[1].to_pylist()]
                yield {"id": piece[0], "lang": [x[0] for x in found], "score": [x[1] for x in found]}

    return arrow_map(docs.select(id_col, text_col), run, schema)
