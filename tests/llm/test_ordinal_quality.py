import collections
import math
import random
import re

import numpy as np
import xxhash

from codefacts.llm import ordinal_quality as oq


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ha", "re", "ti", "on", "en", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        kind = rng.randrange(4)
        if kind == 0:
            text = [t.upper() + "!!" if rng.random() < 0.8 else t for t in text] if i % 2 else [text[0]] * 40
        if kind == 1:
            text.insert(rng.randrange(len(text)), "idiot")
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return rows, labels


def test_held_out_accuracy(spark, frame, odd_rows):
    rows, labels = corpus(700)
    known = spark.createDataFrame(labels[:450] + [(None, 1, 0), (3, None, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    docs = frame(rows + [(i + 5000 if i is not None else None, t) for i, t in odd_rows])
    found = oq.op6(docs, known).collect()
    assert len(found) == len(rows) + len(odd_rows)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 and r.kept == (r.tail_probability >= oq.KEEP) for r in found)
    own = {r.doc_id: r for r in found}
    test = labels[450:]
    assert sum(own[i].kept == bool(q) for i, q, _ in test) >= 0.95 * len(test)
    clean = [own[i].expected_grade for i, q, t in test if q and not t]
    assert np.mean(clean) > np.mean([own[i].expected_grade for i, q, _ in test if not q]) + 1
    kept = oq.selected(docs, known)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in found if r.kept), key=repr)


def test_thresholds_are_ordered_and_the_fit_is_a_maximum():
    rng = random.Random(1)
    grades = [rng.choice([0, 1, 2, 4]) for _ in range(400)]
    rows = [{g * 7 % 5 + 10: 0.5, 99: 0.5, 100 + rng.randrange(30): 0.5} for g in grades]
    model = oq.fit_model(rows, grades)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    score = [sum(model.weights[f] * v for f, v in r.items()) for r in rows]
    expected = [model.judge(s)[0] for s in score]
    assert np.corrcoef(expected, grades)[0, 1] > 0.9
    tails = model.tails(0.3)
    assert tails == sorted(tails, reverse=True)


def penalised(rows, grades, weights, thresholds):
    """The fit's aim computed row by row."""
    cuts = [-math.inf, *thresholds, math.inf]
    total = 0.0
    for r, g in zip(rows, grades):
        score = sum(weights.get(f, 0.0) * v for f, v in r.items())
        upper, lower = (1 / (1 + math.exp(-(score - c))) if math.isfinite(c) else float(c < 0) for c in (cuts[g], cuts[g + 1]))
        total -= math.log(max(upper - lower, 1e-9))
    return total / len(rows) + oq.PENALTY / 2 * sum(w * w for w in weights.values())


def test_no_step_from_the_fit_gains_much():
    rng = random.Random(2)
    grades = [rng.choice([0, 1, 2]) for _ in range(300)]
    rows = [{10 + (g + (rng.random() < 0.3)) % 3: 0.7, 20 + rng.randrange(8): 0.3} for g in grades]
    model = oq.fit_model(rows, grades)
    used = sorted({f for r in rows for f in r})
    weights, cuts = {f: float(model.weights[f]) for f in used}, model.thresholds.tolist()
    least = penalised(rows, grades, weights, cuts)
    assert np.count_nonzero(model.weights) == len(used)
    for f in used:
        for by in (-0.2, 0.2):
            assert penalised(rows, grades, weights | {f: weights[f] + by}, cuts) > least - 2e-3
    for k in range(len(cuts)):
        for by in (-0.1, 0.1):
            assert penalised(rows, grades, weights, [c + by * (i == k) for i, c in enumerate(cuts)]) > least - 2e-3


def slow_features(text):
    """Word, shape and end of every token, each token by itself, and three marks."""
    tokens = re.findall(r"\S+", text)
    out = collections.Counter()
    for t in tokens:
        shape = re.sub(r"\d+", "0", re.sub(r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]+", "A", t)))
        for f in ("w" + t.lower(), "s" + shape, "e" + t[-3:]):
            out[xxhash.xxh32_intdigest(f) % oq.WEIGHTS] += 1 / len(tokens)
    n = max(1, len(tokens))
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:]))
    for f in (f"n{int(math.log2(len(tokens) + 1))}", f"d{10 * len(set(tokens)) // n}", f"r{min(20, 40 * repeats // n)}"):
        out[xxhash.xxh32_intdigest(f) % oq.WEIGHTS] += oq.MARK
    return out


def test_the_whole_query_against_brute_force(spark, frame, odd_rows):
    rows, labels = corpus(200, 4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(rows + odd_rows[60:])
    texts = dict(rows)
    rated = [(i, 0 if not q else 2 - t) for i, q, t in labels if i in texts]
    # Repeated ids learn from their smallest text.
    for i, t in odd_rows[60:]:
        if i in texts:
            texts[i] = min(texts[i], t or "")
    model = oq.fit_model([{f: float(np.float32(v)) for f, v in slow_features(texts[i]).items()} for i, _ in rated], [g for _, g in rated])
    slow = []
    for i, t in rows + odd_rows[60:]:
        score = sum(model.weights[f] * v for f, v in slow_features(t or "").items())
        tails = [1 / (1 + math.exp(-(score - c))) for c in model.thresholds]
        slow.append((i, sum(tails), tails[0]))
    found = [(r.doc_id, r.expected_grade, r.tail_probability) for r in oq.op6(docs, known).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, round(r[1], 3))
    for a, b in zip(sorted(found, key=order), sorted(slow, key=order), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 and abs(a[2] - b[2]) < 2e-3


def test_shares_add_up():
    rng = np.random.default_rng(1)
    model = oq.Model(rng.normal(size=oq.WEIGHTS), np.array([0.0]), [0, 1])
    for text in ("", "One two two\tTHREE!! 4x é", "a " * 1000):
        assert abs(oq.Scorer(model).score(text) - sum(model.weights[f] * v for f, v in oq.features(text).items())) < 1e-9


def test_without_ratings(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in oq.op6(frame([(1, "a")]), none).collect()] == [True]
    one = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r.kept for r in oq.op6(frame([(1, "a")]), one).collect()] == [False]
    assert oq.op6(frame([]), none).collect() == []
