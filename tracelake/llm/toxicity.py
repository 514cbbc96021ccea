"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. From a bounded sample of labelled rows (``SAMPLE`` per class, those with the smallest
   hash of their id) Spark counts in how many documents of each class every word occurs,
   and then the starts and ends of all words that are not in the lexicon yet. Copies of one
   text, near ones too, count once, as what they share says nothing about toxicity. Terms
   far more frequent in toxic documents than chance explains, given how many terms there
   are, make the lexicon.
2. Voters look at a text and vote toxic, clean or nothing: parts of the lexicon (dealt by
   hash, words, starts and ends apart), counts and density of lexicon hits, words written
   with gaps or digits in place of letters, insults to "you", shouting.
3. The generative label model sees only the votes. It estimates by expectation
   maximisation how often each voter votes what in each hidden class, and from what is left
   of the votes' covariance given the class how far voters repeat each other; a voter's
   evidence is divided by the number of voters it moves with.
4. A logistic regression is trained on the posterior labels, with votes and hit rates as
   its inputs, and scores every whole text in one pass over the table.

The sample bounds what the driver holds: ``2 * SAMPLE`` rows of votes and at most
``2 * LEXICON`` terms; both are parameters. Nothing but the label of sampled rows is learned
from, and neither ids, languages, sources nor labels enter a score.

Defined cases: null and empty texts are scored like texts without any hit; labels that are
null, or rows without a label, are not learned from; a document with several labels counts
once for each; without labelled rows of both classes every score is the share of toxic
labels (0 if there is none); ids and other columns may be null, repeated or clash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, column_type, lowest_hashes, stored

SAMPLE = 6_000
LEXICON = 4_000
#: A term's least odds ratio (natural logarithm) and documents; see ``_lexicon`` for its least likelihood ratio.
LEAST_ODDS, LEAST_DOCS = 2.5, 4
PARTS = 8
ROUNDS = 40
_WORD = re.compile(r"[^\W_]+")
_GAPPED = re.compile(r"\b(?:[^\W\d_][.\-*_ ]){3,}[^\W\d_]\b")
_SHOUT = re.compile(r"\b[^\W\d_a-z]{4,}\b|[!?]{3,}")
_PLAIN = str.maketrans("013457@$", "oieastas")


def terms(word: str) -> list[str]:
    """A word, its starts and its ends; the mark tells them apart."""
    out = ["w" + word]
    if len(word) > 4:
        out += ["s" + word[:n] for n in range(4, min(9, len(word)))] + ["e" + word[-5:]]
    return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Voters:
    """All voters over one lexicon of terms and their log odds ratios."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.part = {t: "wse".index(t[0]) * PARTS + zlib.crc32(t.encode()) % PARTS for t in lexicon}
        self.known: dict[str, tuple] = {}

    def _hits(self, word: str) -> tuple:
        if (found := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            own = terms(word)
            found = self.known[word] = tuple((self.part[t], self.lexicon[t]) for t in (own[:1] if own[0] in self.part else own) if t in self.part)
        return found

    def votes(self, text: str | None) -> list[float]:
        """Votes (1 toxic, -1 clean, 0 none), then real-valued features."""
        words = words_of(text)
        parts, whole, weight, different = [0] * (3 * PARTS), 0, 0.0, set()
        for w in words:
            if hits := self._hits(w):
                whole += 1
                different.add(w)
                weight += max(h[1] for h in hits)
                for part, _ in hits:
                    parts[part] = 1
        hidden = 0
        for m in _GAPPED.finditer(text or ""):
            hidden += bool(self._hits(re.sub(r"[^\w]|_", "", m[0].lower())))
        hidden += sum(bool(self._hits(w.translate(_PLAIN))) for w in set(words) if w.isalnum() and not w.isalpha() and not w.isdigit())
        rate = whole / max(1, len(words))
        votes = [
            *parts,
            1 if whole >= 2 else -1,
            1 if whole >= 3 else -1 if whole <= 1 else 0,
            1 if rate >= 0.02 and whole >= 2 else -1 if rate < 0.002 else 0,
            1 if weight >= 9 and whole >= 2 else -1 if weight < 4.5 else 0,
            1 if hidden else 0,
            1 if whole and _SHOUT.search(text or "") else 0,
        ]
        return [*votes, min(whole, 10) / 10, min(len(different), 10) / 10, min(rate * 20, 1.0), min(weight, 40.0) / 40, float(hidden > 0)]


N_VOTERS = 3 * PARTS + 6
N_REAL = 5


def label_model(votes: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of the toxic class per row, from the votes alone; ``toxic`` is the class share to start from."""
    values = np.stack([votes == v for v in (-1, 0, 1)])  # value, row, voter
    share = float(np.clip(toxic, 0.01, 0.99))
    score = (votes == 1).sum(1) - (votes == -1).sum(1)
    cut = np.quantile(score, 1 - share)
    p = np.clip(0.5 + 0.45 * np.sign(score - max(cut, -0.5)), 0.05, 0.95)
    for _ in range(rounds):
        on = np.stack([(values * q[None, :, None]).sum(1) + 0.5 for q in (1 - p, p)])  # class, value, voter
        rate = on / on.sum(1, keepdims=True)
        expected = [(r * np.array([-1, 0, 1])[:, None]).sum(0) for r in rate]
        rest = votes - (1 - p)[:, None] * expected[0] - p[:, None] * expected[1]
        cov = rest.T @ rest / len(rest)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        alike = np.maximum(cov / spread[:, None] / spread[None, :], 0.0)
        weight = 1.0 / np.maximum(alike.sum(1), 1.0)
        evidence = (values * (np.log(rate[1]) - np.log(rate[0]))[:, None, :]).sum(0)
        logit = evidence @ weight + np.log(share / (1 - share))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Coefficients (constant last) of a ridge regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * b
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ x + np.diag(penalty), grad)
        b -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return b


def _sample(labels: DataFrame, id_col: str, label_col: str, learn: Column, size: int) -> DataFrame:
    """At most ``size`` labelled ids per class: those with the smallest hash."""
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    return lowest_hashes(known, "_label", "_id", size)


def _origin(words: list[str]) -> int:
    """Equal for copies and nearly always for near copies of a text: the smallest hash of its longer words, or of three in a row where those are few."""
    long = {w for w in words if len(w) >= 8}
    if len(long) < 8:
        long = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
    return min(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in long)


def _lexicon(sample: DataFrame, toxic: int, clean: int, size: int, known: dict[str, float] | None = None) -> dict[str, float]:
    """Terms counted per document of the sample, by class; the strongest ``size`` of those that pass the limits.

    Words alone without ``known``; else the starts and ends of words that are not known. The
    likelihood ratio statistic has to exceed twice the logarithm of the number of terms.
    """
    def run(batches):
        for batch in batches:
            labels, texts = batch[0].to_pylist(), batch[1].to_pylist()
            for label, text in zip(labels, texts):
                origin, words = _origin(words_of(text)), set(words_of(text))
                found = ["w" + w for w in words] if known is None else list({t for w in words if "w" + w not in known for t in terms(w)[1:]})
                yield {"term": found, "toxic": [label] * len(found), "origin": [origin] * len(found)}

    schema = T.StructType().add("term", T.StringType()).add("toxic", T.IntegerType()).add("origin", T.LongType())
    counts = arrow_map(sample.select("_label", "_text"), run, schema).distinct()
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= LEAST_DOCS)
    counts = stored(counts, "terms")
    least = 2 * np.log(max(1, counts.count()))
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    part = lambda k, n, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    n, share = F.col("a") + F.col("b"), toxic / (toxic + clean)
    g = 2 * (part(F.col("a"), n, share) + part(F.col("b"), n, 1 - share))
    kept = counts.select("term", odds.alias("odds"), g.alias("g")).where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= least))
    return {r["term"]: r["odds"] for r in kept.orderBy(F.desc("g"), "term").limit(size).collect()}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        label_id_col: str = "doc_id", sample: int = SAMPLE, lexicon: int = LEXICON) -> tuple[Voters, np.ndarray]:
    """Voters and the classifier's coefficients. ``learn`` is a condition on ``labels``."""
    chosen = _sample(labels, label_id_col, label_col, learn, sample)
    # At most 2 * sample rows of two numbers: the bound of this broadcast.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    sizes = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    all_sizes = {r[0]: r[1] for r in labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    share = all_sizes.get(1, 0) / max(1, sum(all_sizes.values()))
    constant = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    flat = np.concatenate([np.zeros(N_VOTERS + N_REAL), [constant]])
    if not sizes.get(1) or not sizes.get(0):
        return Voters({}), flat
    known = _lexicon(rows, sizes[1], sizes[0], lexicon)
    voters = Voters(known | _lexicon(rows, sizes[1], sizes[0], lexicon, known))
    if not voters.lexicon:
        return voters, flat

    def run(batches):
        for batch in batches:
            yield {"label": batch[0], "votes": [voters.votes(t) for t in batch[1].to_pylist()]}

    votes = arrow_map(rows.select("_label", "_text"), run, T.StructType().add("label", T.IntegerType()).add("votes", T.ArrayType(T.FloatType()))).collect()
    x = np.array([r["votes"] for r in sorted(votes, key=lambda r: tuple(r["votes"]))], np.float64)
    posterior = label_model(x[:, :N_VOTERS], sizes[1] / (sizes[0] + sizes[1]))
    back = np.where(posterior > 0.5, share / (sizes[1] / len(x)), (1 - share) / (sizes[0] / len(x)))  # the sample's classes to their shares
    return voters, logistic(x, posterior, back)


def score(docs: DataFrame, voters: Voters, coefficients: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score (0 to 1). Reads the id and the text only."""
    schema = T.StructType().add(id_col, column_type(docs, id_col)).add("score", T.DoubleType())

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                piece = batch.slice(at, 1024)
                x = np.array([voters.votes(t) for t in piece[1].to_pylist()])
                yield {"id": piece[0], "score": 1 / (1 + np.exp(-np.clip(x @ coefficients[:-1] + coefficients[-1], -30, 30)))}

    return arrow_map(docs.select(id_col, text_col), run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``limit``; columns as before."""
    voters, coefficients = fit(docs, labels, learn, id_col, text_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([voters.votes(t) for t in batch[at].to_pylist()]).reshape(len(batch), -1)
            good = x @ coefficients[:-1] + coefficients[-1] < np.log(limit / (1 - limit)) if len(batch) else np.empty(0, bool)
            yield dict(enumerate(batch.filter(pa.array(good)).columns))

    return arrow_map(docs, run, docs.schema)
