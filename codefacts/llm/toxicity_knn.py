"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their prefixes of four and five letters (inflections of a stem share them). All
terms of the labelled examples are indexed: an example or a text is its TF-IDF vector over them. Common terms, those with the
least IDF, which more than COMMON of the examples have, are left out of all vectors; a text that has no others is compared
by them. Terms whose presence
depends on the label (likelihood-ratio statistic G2 above what chance gives one of so many terms) weigh 1 / PLAIN
times as much as the others, which decide between examples that have the same of these or none. The index
holds each term's postings over the examples in blocks, with the largest value in each block. A search
bounds every block by the sum of its terms' largest values, opens blocks from the highest bound on, and
stops when no bound reaches the K-th cosine found: the K nearest are exact. Where no term has more than HEAVY of a
text's squared length, bounds are sums of many small values and rule out next to nothing: all blocks are opened at once.

The neighbours vote with the square of their cosine; a logistic curve fitted on the examples' own
leave-one-out votes turns vote and largest cosine into a probability. The neighbours are the evidence.

Only the fit works on a bounded sample: EXAMPLES labelled rows, those with the smallest hash of their
id, with all their terms. Every text is scored whole. The index goes out in the closure; scoring needs no shuffle.

Defined cases: null and empty texts, and those without a term that some example has, have no neighbours and get the share of
toxic examples among such; terms that no example has do not count for a text's length; several labels of one id count
as the largest, several texts of one id as the smallest (to learn from; each row is scored by its own); labels
without an id or a value are left out; without any label, or with one class only, every score is that class's share (0 without
labels); repeated rows get equal rows; an empty table gives an empty result; other columns take no part, and ``civil``
carries them as they are.
"""

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import BATCH_ROWS, arrow_batches, mapped, saved, text_of

#: Labelled rows that are fitted at most; neighbours; examples in a block.
EXAMPLES, K, BLOCK = 4000, 15, 128
#: Blocks that are opened before the others are ruled out; the share of a squared length from which on bounds are made.
FIRST, HEAVY = 4, 0.1
#: Characters of the texts whose terms are looked up together (a longer text comes alone).
LOT = 1 << 20
#: Share of the examples beyond which a term is common.
COMMON = 0.05
#: What a term that does not depend on the label weighs against one that does.
PLAIN = 0.03
THRESHOLD = 0.3
WORD = re.compile(r"[^\W_]+")


def terms_of(chunk: str) -> list[str]:
    """The terms of a stretch of text without white space."""
    out = []
    for word in WORD.findall(chunk.lower()):
        out.append(word)
        out += [f"{word[:n]}~" for n in (4, 5) if len(word) > n]
    return out


def counted(text: str) -> Counter:
    out: Counter = Counter()
    for chunk, n in Counter(text.split()).items():
        for term in terms_of(chunk):
            out[term] += n
    return out


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """WORD's matches in the lower-cased texts, and the text of each: the runs of letters and numbers between the places where these begin and end."""
    lower = [t.lower() for t in texts]
    whole = "\n".join(lower)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    present = np.flatnonzero(np.bincount(points))
    inside = np.zeros(int(present[-1]) + 1 if len(present) else 0, bool)
    inside[present] = [chr(c).isalnum() for c in present.tolist()]
    edges = np.flatnonzero(np.diff(inside[points], prepend=False, append=False))
    # As Arrow strings: each run and, behind it, what lies between it and the next.
    at = np.zeros(len(points) + 1, np.int32)
    np.cumsum(np.ones(len(points), np.int8) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
    runs = pa.StringArray.from_buffers(max(0, len(edges) - 1), pa.py_buffer(at[edges]), pa.py_buffer(whole.encode()))
    starts = np.cumsum([0] + [len(t) + 1 for t in lower])
    return runs.take(pa.array(np.arange(0, len(edges), 2))), np.searchsorted(starts, edges[::2], side="right") - 1


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and of each the number of its range."""
    lengths = end - start
    of = np.repeat(np.arange(len(start)), lengths)
    return np.arange(len(of)) + np.repeat(start - np.cumsum(lengths) + lengths, lengths), of


class Index:
    """Postings of labelled examples by term, in blocks with their largest values.

    terms, weights, common: of each term. term, example, count: one of each posting. A text's vector has
    (1 + log count) * weight for each of its terms that some example has.
    """

    def __init__(self, terms: list[str], weights: np.ndarray, common: np.ndarray, term: np.ndarray, example: np.ndarray, count: np.ndarray, labels: np.ndarray, ids: list) -> None:
        self.terms, self.weights, self.common, n = terms, weights, common, len(ids)
        value = (1 + np.log(count)) * weights[term]
        square = value * value
        norms = np.sqrt(np.stack([np.bincount(example, square * ~common[term], n), np.bincount(example, square, n)]))
        # Examples with the same heaviest term lie together, so that few blocks hold a term's large values.
        heaviest = np.full(n, -1)
        by_value = np.argsort(value, kind="stable")
        heaviest[example[by_value]] = term[by_value]
        order = np.argsort(heaviest, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.labels, self.ids, self.norms = labels[order], [ids[i] for i in order], norms[:, order]
        self.blocks = -(-n // BLOCK)
        at = place[example]
        by_term = np.lexsort((at, term))
        term, at, count = term[by_term], at[by_term], count[by_term]
        self.at, self.count, self.whole = at.astype(np.uint32), count.astype(np.uint32), common[term]
        # Blocks of postings: their first posting, block and largest value.
        block = at // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.first = np.append(first, len(term)).astype(np.uint32)
        self.block = block[first].astype(np.uint16)
        largest = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.largest = np.nextafter(largest.astype(np.float32), np.float32(np.inf))
        self.of_term = np.searchsorted(term[first], np.arange(len(terms) + 1)).astype(np.uint32)
        self.opened = 0

    @cached_property
    def value(self) -> np.ndarray:
        """A posting's share in its example's vector but for the term's weight; made where it is needed.

        The vector is the one that a text with such a term is compared with: without common terms, or with all.
        """
        return (1 + np.log(self.count)) / self.norms[self.whole.astype(np.int8), self.at]

    @cached_property
    def start(self) -> np.ndarray:
        """The first posting of each term."""
        return self.first[self.of_term].astype(np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("value", "start")}

    def unit(self, tf: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and values of a text's vector, of length 1: without common terms, or of these alone."""
        tf = dict(sorted(tf.items()))
        t = np.fromiter(tf, np.int64, len(tf))
        n = np.fromiter(tf.values(), np.float64, len(tf))
        if not (common := self.common[t]).all():
            t, n = t[~common], n[~common]
        v = (1 + np.log(n)) * self.weights[t]
        return t, v / max(1e-300, math.sqrt(float(v @ v)))

    def nearest(self, q: tuple[np.ndarray, np.ndarray], k: int, but: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest of cosine above 0, by cosine, then place. but: an example left out."""
        t, v = q
        heavy = len(v) and float(v.max()) ** 2 > HEAVY
        v = v * self.weights[t]
        if not heavy:
            start = self.start[t]
            posting, own = spread(start, self.start[t + 1])
            self.opened += self.blocks
            return [(-s, i) for s, i in self.best(posting, v[own], k, but)]
        entry, of = spread(self.of_term[t].astype(np.int64), self.of_term[t + 1].astype(np.int64))
        blocks = self.block[entry].astype(np.int64)
        bound = np.bincount(blocks, v[of] * self.largest[entry], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best: list[tuple[float, int]] = []
        # The most promising blocks first; then all that the k-th cosine of these leaves possible.
        for some in (order[:FIRST], order[FIRST:]):
            if len(best) >= k:
                some = some[bound[some] >= -best[k - 1][0] - 1e-9]
            if not len(some):
                break
            wanted = np.zeros(self.blocks, bool)
            wanted[some] = True
            open_ = np.flatnonzero(wanted[blocks])
            posting, own = spread(self.first[entry[open_]].astype(np.int64), self.first[entry[open_] + 1].astype(np.int64))
            best = sorted(best + self.best(posting, v[of[open_]][own], k, but))[:k]
            self.opened += len(some)
        return [(-s, i) for s, i in best]

    def best(self, posting: np.ndarray, v: np.ndarray, k: int, but: int) -> list[tuple[float, int]]:
        """(-cosine, example) of the k first by these postings, given what each is multiplied with."""
        sums = np.bincount(self.at[posting], v * self.value[posting], len(self.labels))
        if but >= 0:
            sums[but] = 0
        # All that tie with the k-th stay until they are sorted.
        kth = np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) > k else 0.0
        found = np.flatnonzero(sums >= kth - 1e-11 if kth > 1e-11 else sums > 0)
        return sorted([(-round(s, 12), i) for s, i in zip(sums[found].tolist(), found.tolist())])[:k]

    def vote(self, near: list[tuple[float, int]]) -> tuple[float, float] | None:
        """Share of the squared cosines that toxic neighbours have, and the largest cosine."""
        if not near:
            return None
        total = sum(s * s for s, _ in near)
        return float(sum(s * s * self.labels[i] for s, i in near) / total), near[0][0]


class Curve:
    """What a vote means: a logistic curve, and the score of a text without neighbours."""

    def __init__(self, votes: list[tuple[float, float] | None], labels: list[float]) -> None:
        """Fitted on the examples' leave-one-out votes (None: no neighbour), its targets drawn in by one case of each class."""
        without = [y for v, y in zip(votes, labels) if v is None]
        prior = (sum(labels) + 0.5) / (len(labels) + 1)
        self.empty = (sum(without) + prior) / (len(without) + 1)
        x, y = np.array([(1, *v) for v in votes if v is not None]).reshape(-1, 3), np.array([y for v, y in zip(votes, labels) if v is not None], float)
        y = (y * max(1, y.sum()) + 1) / (max(1, y.sum()) + 2) if len(y) else y
        w = np.array([-2.0, 4.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
            w = w - np.linalg.solve(h, x.T @ (p - y) + 0.05 * (w - np.array([-2.0, 4.0, 0.0])))
        self.weights = w

    def score(self, vote: tuple[float, float] | None) -> float:
        return float(self.empty) if vote is None else float(1 / (1 + np.exp(-np.clip(self.weights @ (1, *vote), -30, 30))))


class Fitted:
    """An index, pickled and compressed, and its curve. It goes to the workers as it is; they unpack it."""

    def __init__(self, pages: bytes, curve: Curve | None = None) -> None:
        self.pages, self.curve = pages, curve

    def index(self) -> Index:
        return pickle.loads(zstandard.decompress(self.pages))

    def scorer(self) -> Callable[[list[str]], list[tuple[float, list]]]:
        return Scorer(self.index(), self.curve)


class Scorer:
    """Scores texts, many together; the answers to texts seen before are looked up."""

    def __init__(self, index: Index, curve: Curve | None = None) -> None:
        self.index, self.curve, self.answers = index, curve, {}
        self.terms = pa.array(index.terms, pa.string())

    def places(self, words: pa.Array) -> np.ndarray:
        """The places of each word's terms (the word, its prefixes), -1 where no example has one."""
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        cut = [pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), "~", "") for n in (4, 5)]
        # The index's terms come first and are distinct, so that their codes are their places. (index_in takes six times as long to hash them.)
        coded = pa.concat_arrays([self.terms, words, *cut]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        found = coded[len(self.terms) :].reshape(3, -1).astype(np.int64)
        return np.where((found < len(self.terms)) & np.stack([lengths >= 0, lengths > 4, lengths > 5]), found, -1)

    def vectors(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Each text's vector; None: no example has any of its terms. White space is no part of words, so that whole texts are cut as their chunks are."""
        index, size = self.index, max(1, len(self.index.terms))
        words, of = words_of(texts)
        coded = words.dictionary_encode()
        places, code = self.places(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        plain = np.where(places >= 0, ~index.common[places], False) if len(index.terms) else places >= 0
        key, count = np.unique((of * size + places[:, code])[plain[:, code]], return_counts=True)
        ends = np.searchsorted(key, np.arange(len(texts) + 1) * size)
        of_key = np.repeat(np.arange(len(texts)), np.diff(ends))
        term = key - of_key * size
        value = (1 + np.log(count)) * index.weights[term]
        value /= np.maximum(1e-300, np.sqrt(np.bincount(of_key, value * value, len(texts))))[of_key]
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if a < b:
                yield term[a:b], value[a:b]
            else:
                own = places[:, code[of == i]]
                tf = Counter(own[own >= 0].tolist())
                yield index.unit(tf) if tf else None

    def near(self, texts: list[str], but: list[int] | None = None) -> Iterator[list[tuple[float, int]]]:
        """The neighbours of each text, but for one example."""
        at = 0
        while at < len(texts):
            end, chars = at + 1, len(texts[at])
            while end < len(texts) and chars + len(texts[end]) <= LOT:
                chars, end = chars + len(texts[end]), end + 1
            for i, q in enumerate(self.vectors(texts[at:end]), at):
                yield self.index.nearest(q, K, -1 if but is None else but[i]) if q is not None else []
            at = end

    def __call__(self, texts: list[str]) -> list[tuple[float, list]]:
        keys = [xxhash.xxh3_128_digest(t) for t in texts]
        known = {k: self.answers[k] for k in keys if k in self.answers}
        new = {k: t for k, t in zip(keys, texts) if k not in known}
        for k, near in zip(new, self.near(list(new.values())), strict=True):
            known[k] = self.curve.score(self.index.vote(near)), [self.index.ids[i] for _, i in near[:3]]
        if len(self.answers) + len(new) > 10_000:
            self.answers.clear()
        self.answers.update(known)
        return [known[k] for k in keys]


class Constant:
    """What is left to say without two classes."""

    def __init__(self, share: float) -> None:
        self.share = share

    def __call__(self, texts: list[str]) -> list[tuple[float, list]]:
        return [(self.share, [])] * len(texts)

    def scorer(self) -> Callable[[list[str]], list[tuple[float, list]]]:
        return self


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Fitted | Constant:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows that are not held out are learnt from."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # The sample's ids, EXAMPLES at most, are broadcast.
    sample = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES), "sample")
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    texts = saved(texts, "examples")

    def make():
        def run(ids, texts):
            found = [counted(t) for t in texts]
            return [[list(c) for c in found], [list(c.values()) for c in found]]

        return run

    rows = mapped(texts.select("doc_id", "text"), make, "terms array<string>, counts array<int>").join(F.broadcast(sample), "doc_id")

    def build(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One task has all examples, EXAMPLES at most, and leaves the index in parts.
        rows = pa.Table.from_batches(group).sort_by("doc_id")
        toxic = np.array(rows["toxic"].to_pylist(), float)
        pages = zstandard.compress(pickle.dumps(built(rows["terms"].combine_chunks(), rows["counts"].combine_chunks(), toxic, rows["doc_id"].to_pylist()), 5))
        # The worker lives on: what the index was made of goes back.
        del rows
        pa.default_memory_pool().release_unused()
        for at in range(0, len(pages), 1 << 22):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pages[at : at + (1 << 22)]], pa.binary())], names=["at", "page"])

    known = {r["doc_id"]: float(r["toxic"]) for r in texts.select("doc_id", "toxic").collect()}  # EXAMPLES at most
    if len(set(known.values())) < 2:
        return Constant(sum(known.values()) / max(1, len(known)))
    pages = saved(rows.groupBy(F.lit(0).alias("all")).applyInArrow(build, "at long, page binary"), "index")
    fitted = Fitted(b"".join(r["page"] for r in pages.orderBy("at").collect()))

    def leave_one_out():
        scorer = Scorer(fitted.index())
        place = {i: k for k, i in enumerate(scorer.index.ids)}

        def run(ids, texts):
            votes = [scorer.index.vote(near) or (None, None) for near in scorer.near(texts, [place[i] for i in ids])]
            return [list(c) for c in zip(*votes, strict=True)]

        return run

    spread_out = texts.select("doc_id", "text").repartition(max(2, min(64, len(known) // 256)))
    votes = mapped(spread_out, leave_one_out, "share double, top double").collect()  # EXAMPLES at most
    votes = sorted((r["doc_id"], None if r["share"] is None else (r["share"], r["top"])) for r in votes)
    fitted.curve = Curve([v for _, v in votes], [known[i] for i, _ in votes])
    return fitted


def built(terms: pa.ListArray, counts: pa.ListArray, toxic: np.ndarray, ids: list) -> Index:
    """The index of the examples' terms; what depends on the label weighs more."""
    n, positive = len(ids), toxic.sum()
    words = pc.unique(terms.flatten()).sort()
    term = pc.index_in(terms.flatten(), words).to_numpy(zero_copy_only=False).astype(np.int32)
    count = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    example = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    df = np.bincount(term, minlength=len(words)).astype(float)
    a = np.bincount(term, toxic[example], len(words))
    cell = lambda seen, of, all_: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) * n / np.maximum(of * all_, 1)), 0.0)
    g2 = 2 * (cell(a, df, positive) + cell(df - a, df, n - positive) + cell(positive - a, n - df, positive) + cell(n - positive - df + a, n - df, n - positive))
    # Twice the logarithm of the number of terms tested: under one of them is expected above it by chance.
    telling = (df > 2) & (g2 >= 2 * math.log(max(2, int((df > 2).sum()))))
    weights = (np.log((1 + n) / (1 + df)) + 1) * np.where(telling, 1.0, PLAIN)
    common = ~telling & (df > max(2.0, COMMON * n))
    return Index(words.to_pylist(), weights, common, term, example, count, toxic, ids)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and evidence (ids of the three nearest examples) of each row's whole text."""
    fitted = fit(docs, labels)

    def make():
        scorer = fitted.scorer()
        return lambda ids, texts: [list(c) for c in zip(*scorer(texts), strict=True)]

    return mapped(docs.select("doc_id", "text"), make, "score double, evidence array<long>")


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, labels)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they were."""
    fitted = fit(docs, labels)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = fitted.scorer()
        for texts in batches:
            yield pd.Series([s for s, _ in scorer([t or "" for t in texts])], dtype="float64")

    # Written at once, as the bound of the Arrow batches holds for that job alone.
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return saved(docs.where(scored(F.col("text")) < THRESHOLD), "civil")
