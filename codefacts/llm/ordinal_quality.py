"""Quality by ordinal cumulative-link regression on graded ratings.

A text is the mean of its tokens' hashed features (the word, its shape, its end) and a few hashed
marks of the whole text (length, share of distinct tokens, repeats in a row). One weight vector is shared
by all grades; ordered thresholds cut its score into grades: P(grade > k) = sigmoid(w.x - threshold_k).
A text gets its expected grade and the tail probability P(grade >= 1) by which texts are selected.

Only the fit works on a bounded sample: EXAMPLES rated rows, those with the smallest hash of their id.
Every text is scored whole; as features add up by token, a token's share of the score is looked up,
and scoring needs no shuffle.

Defined cases: null and empty texts have the marks of an empty text only; several ratings of one id
count as the smallest; ratings without an id or a value are left out; grades that no rating has are left
out; with fewer than two grades every text gets the one grade, and without ratings every text is kept;
repeated rows get equal rows; texts of any length are scored whole; an empty table gives an empty result; other columns
take no part, and ``selected`` carries them as they are.
"""

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import BATCH_ROWS, arrow_batches, mapped, saved, text_of

#: Rated rows that are fitted at most, hashed weights, the least tail probability of a kept text.
EXAMPLES, WEIGHTS, KEEP = 3000, 1 << 16, 0.5
#: Penalty of squared weights; the fit ends when the penalised likelihood has gained less than this in PATIENCE rounds, after ROUNDS at most.
PENALTY, GAIN, PATIENCE, ROUNDS = 1e-4, 1e-4, 20, 400
SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"\d+"), "0"))


def hashed(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % WEIGHTS


def token_features(token: str) -> tuple[int, ...]:
    shape = token
    for pattern, sign in SHAPES:
        shape = pattern.sub(sign, shape)
    return hashed("w" + token.lower()), hashed("s" + shape), hashed("e" + token[-3:])


def marks(tokens: list[str]) -> tuple[int, ...]:
    """Features of the whole text."""
    n = len(tokens)
    repeats = sum(map(operator.eq, tokens, tokens[1:]))
    return hashed(f"n{int(math.log2(n + 1))}"), hashed(f"d{10 * len(set(tokens)) // max(1, n)}"), hashed(f"r{min(20, 40 * repeats // max(1, n))}")


#: What a mark weighs against a token's share.
MARK = 0.5


def features(text: str) -> dict[int, float]:
    tokens = text.split()
    out: Counter = Counter()
    for token, n in Counter(tokens).items():
        for f in token_features(token):
            out[f] += n / len(tokens)
    for f in marks(tokens):
        out[f] += MARK
    return out


class Model:
    """Shared weights and ordered thresholds; grades: those that the thresholds part."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]) -> None:
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, score: float) -> list[float]:
        """P(grade > k) for each grade but the last."""
        return [1 / (1 + math.exp(-min(30.0, max(-30.0, score - t)))) for t in self.thresholds.tolist()]

    def judge(self, score: float) -> tuple[float, float]:
        """Expected grade and P(grade >= 1)."""
        tails, g = self.tails(score), self.grades
        expected = g[0] + sum((b - a) * p for a, b, p in zip(g, g[1:], tails))
        low = sum(x < 1 for x in g)
        return expected, 1.0 if low == 0 else 0.0 if low == len(g) else tails[low - 1]


def fit_model(rows: list[dict[int, float]], grades: list[int]) -> Model:
    """Maximum likelihood with a small penalty, by full-batch adaptive steps until it gains no more."""
    present = sorted(set(grades))
    if len(present) < 2:
        return Model(np.zeros(WEIGHTS), np.zeros(0), present or [1])
    at = np.array([present.index(g) for g in grades])
    sizes = np.array([len(r) for r in rows])
    row, idx = np.repeat(np.arange(len(rows)), sizes), np.fromiter((f for r in rows for f in r), np.int64, sizes.sum())
    val = np.fromiter((v for r in rows for v in r.values()), np.float64, sizes.sum())
    cuts = len(present) - 1
    above = (at[:, None] > np.arange(cuts)).mean(axis=0)
    start = -np.log(above / (1 - above))
    # thresholds = base, base + exp(gap), ...: ordered whatever the steps are.
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    p = np.concatenate([np.zeros(WEIGHTS), start[:1], gaps])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    least, best, mark, since = np.inf, p, np.inf, 0
    for step in range(1, ROUNDS + 1):
        t = np.concatenate([p[WEIGHTS : WEIGHTS + 1], p[WEIGHTS : WEIGHTS + 1] + np.cumsum(np.exp(p[WEIGHTS + 1 :]))])
        s = np.bincount(row, val * p[idx], len(rows))
        cum = np.concatenate([np.ones((len(rows), 1)), 1 / (1 + np.exp(-np.clip(s[:, None] - t, -30, 30))), np.zeros((len(rows), 1))], axis=1)
        r = np.arange(len(rows))
        hi, lo = cum[r, at], cum[r, at + 1]
        like = np.maximum(hi - lo, 1e-9)
        loss = -np.log(like).mean() + PENALTY / 2 * float(p[:WEIGHTS] @ p[:WEIGHTS])
        mark, since = (loss, 0) if loss < mark - GAIN else (mark, since + 1)
        if loss < least:
            least, best = loss, p
        if since >= PATIENCE:
            break
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
        ds = -(dhi - dlo) / len(rows)
        dt = np.zeros((len(rows), cuts + 2))
        dt[r, at] += dhi / len(rows)
        dt[r, at + 1] -= dlo / len(rows)
        dt = dt.sum(axis=0)[1:-1]
        grad = np.concatenate([np.bincount(idx, val * ds[row], WEIGHTS) + PENALTY * p[:WEIGHTS], [dt.sum()], np.exp(p[WEIGHTS + 1 :]) * np.cumsum(dt[::-1])[::-1][1:]])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        p = p - 0.3 * 0.99**step * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    p = best
    t = np.concatenate([p[WEIGHTS : WEIGHTS + 1], p[WEIGHTS : WEIGHTS + 1] + np.cumsum(np.exp(p[WEIGHTS + 1 :]))])
    return Model(p[:WEIGHTS], t, present)


class Scorer:
    """Scores of texts; a token's share is looked up."""

    TOKENS = 150_000

    def __init__(self, model: Model) -> None:
        self.model, self.weights, self.shares = model, model.weights, {}

    def score(self, text: str) -> float:
        tokens, shares, weights = text.split(), self.shares, self.weights
        total = 0.0
        for token, n in Counter(tokens).items():
            if (share := shares.get(token)) is None:
                share = float(sum(weights[f] for f in token_features(token)))
                if len(shares) >= self.TOKENS:
                    shares.clear()
                if len(token) <= 64:
                    shares[token] = share
            total += n * share
        return total / max(1, len(tokens)) + MARK * float(sum(weights[f] for f in marks(tokens)))

    def __call__(self, text: str) -> tuple[float, float]:
        return self.model.judge(self.score(text))


def rated(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 well formed but toxic, 2 well formed and civil."""
    quality, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labels.select("doc_id", F.when(quality > 0, 2 - F.least(toxic, F.lit(1))).otherwise(quality).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, where: Column | None = None) -> Model:
    """docs: doc_id, text; ratings: doc_id, grade. where: which ratings may be learnt from."""
    known = ratings.where("doc_id is not null and grade is not null")
    known = (known if where is None else known.where(where)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    # The sample's ids, EXAMPLES at most, are broadcast.
    sample = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES), "rated")
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade"))

    def make():
        def run(ids, texts):
            found = [features(t) for t in texts]
            return [[list(f) for f in found], [list(f.values()) for f in found]]

        return run

    rows = mapped(texts.select("doc_id", "text"), make, "at array<int>, value array<float>").join(F.broadcast(sample), "doc_id").orderBy("doc_id").toArrow()  # EXAMPLES at most
    return fit_model([dict(zip(a, v)) for a, v in zip(rows["at"].to_pylist(), rows["value"].to_pylist())], rows["grade"].to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade and tail of each row's whole text."""

    def make():
        scorer = Scorer(model)
        return lambda ids, texts: [list(c) for c in zip(*map(scorer, texts), strict=True)]

    return mapped(docs.select("doc_id", "text"), make, "expected_grade double, tail double")


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, rated(labels)))
    return found.select("doc_id", "expected_grade", F.col("tail").alias("tail_probability"), (F.col("tail") >= KEEP).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose tail probability reaches KEEP, with their columns as they were."""
    model = fit(docs, rated(labels))

    @F.pandas_udf("double")
    def tail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer(t or "")[1] for t in texts], dtype="float64")

    # Written at once, as the bound of the Arrow batches holds for that job alone.
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return saved(docs.where(tail(F.col("text")) >= KEEP), "selected")
