import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codefacts.llm import toxicity_knn as tk

BAD = ["idiot", "scum", "moron", "loweient", "loweisch", "loweick"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ha", "re", "ti", "on", "en", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return rows, labels, {i for i, t in rows if set(t.split()) & set(BAD)}


def test_held_out_accuracy(spark, frame, odd_rows):
    rows, labels, toxic = corpus(800)
    rows += [(i + 5000 if i is not None else None, t) for i, t in odd_rows]
    frame_of = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    found = tk.op5(frame(rows), frame_of).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    own = [r for r in found if r.doc_id is not None and r.doc_id < 800 and r.held_out]
    assert sum((r.doc_id in toxic) == bool(r.predicted) for r in own) >= 0.97 * len(own)
    assert all(len(r.evidence) for r in own if r.predicted)
    kept = tk.civil(frame(rows), frame_of)
    assert kept.columns == frame(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in found if not r.predicted), key=repr)


def test_without_classes(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in tk.op5(frame([(1, "a")]), labels).collect()] == [0.0]
    assert tk.op5(frame([]), labels).collect() == []


def slow_terms(text):
    """Words and their beginnings of four and five letters, counted one by one."""
    out = Counter()
    for word in re.findall(r"[^\W_]+", text.lower()):
        for term in [word, *(word[:n] + "~" for n in (4, 5) if len(word) > n)]:
            out[term] += 1
    return out


def slow_cosine(a, b, weight, common):
    """Without common terms, unless the first text has no others."""
    left = set(weight) - common if any(t in weight and t not in common for t in a) else set(weight)
    a = {t: n for t, n in a.items() if t in left and (left != set(weight) or t in common or not common)}
    weight = {t: weight[t] for t in left}
    va, vb = ({t: (1 + math.log(n)) * weight[t] for t, n in x.items() if t in weight} for x in (a, b))
    size = math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))
    return sum(x * vb.get(t, 0.0) for t, x in va.items()) / size if size else 0.0


def test_the_whole_query_against_brute_force(spark, frame, odd_rows):
    rows, labels, _ = corpus(260, 5)
    docs = frame(rows + odd_rows[60:])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = tk.fit(docs.select("doc_id", "text"), known)
    index = fitted.index()
    toxic = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    assert sorted(index.ids) == sorted(toxic)
    texts = dict(rows)
    for i, t in odd_rows[60:]:
        if i in texts:
            texts[i] = min(texts[i], t or "")
    own = {i: slow_terms(texts[i]) for i in toxic}
    df = Counter(t for c in own.values() for t in c)
    weight = {t: (math.log((1 + len(own)) / (1 + n)) + 1) * (1.0 if index.weights[index.terms.index(t)] > 0.9 else tk.PLAIN) for t, n in df.items()}
    assert index.terms == sorted(df)
    telling = {t for t, w in zip(index.terms, index.weights) if w > 0.9}
    common = {t for t, n in df.items() if n > max(2, tk.COMMON * len(own)) and t not in telling}
    assert common and len(common) < len(df)
    found = sorted(tk.op5(docs, known).collect(), key=lambda r: repr(tuple(r)[:3]))
    slow = []
    for i, t in rows + odd_rows[60:]:
        cosines = {j: slow_cosine(slow_terms(t or ""), own[j], weight, common) for j in own}
        near = sorted((-round(c, 9), index.ids.index(j)) for j, c in cosines.items() if c > 0)[: tk.K]
        if near:
            share = sum(c * c * toxic[index.ids[k]] for c, k in near) / sum(c * c for c, _ in near)
            score = 1 / (1 + math.exp(-(fitted.curve.weights @ (1, share, -near[0][0]))))
        else:
            score = fitted.curve.empty
        slow.append((i, score, len(near)))
    # A text has neighbours where any example has one of its terms.
    order = lambda r: (r[0] is None, r[0] or 0, round(r[1], 4))
    for a, b in zip(sorted(((r.doc_id, r.score, len(r.evidence)) for r in found), key=order), sorted(slow, key=order), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 and a[2] == min(3, b[2])
    assert sum(not b[2] for b in slow) <= 12


@pytest.mark.parametrize("seed", [1, 2])
def test_block_max_search_is_exact(seed):
    rng = random.Random(seed)
    vectors = [{t: rng.randint(1, 5) for t in rng.sample(range(40), rng.randint(0, 6))} for _ in range(2000)]
    weights = np.array([1 + rng.random() * 4 for _ in range(40)])
    weights[:5] *= 20
    posted = [(t, i, n) for i, v in enumerate(vectors) for t, n in v.items()]
    index = tk.Index([str(t) for t in range(40)], weights, np.zeros(40, bool), *(np.array(c) for c in zip(*posted)), np.array([rng.random() < 0.3 for _ in vectors], float), list(range(2000)))
    own = [{t: (1 + math.log(n)) * weights[t] for t, n in vectors[i].items()} for i in index.ids]
    size = [math.sqrt(sum(x * x for x in v.values())) for v in own]
    for _ in range(60):
        q = index.unit({t: rng.randint(1, 5) for t in rng.sample(range(40), rng.randint(1, 6))})
        cosines = [sum(x * v.get(t, 0) for t, x in zip(q[0].tolist(), q[1].tolist())) / n if n else 0.0 for v, n in zip(own, size)]
        brute = sorted((-round(c, 9), i) for i, c in enumerate(cosines) if c > 0)[: tk.K]
        near = index.nearest(q, tk.K)
        assert len(near) == len(brute) and all(abs(a[0] + b[0]) < 1e-8 for a, b in zip(near, brute))
        assert all(abs(c - cosines[i]) < 1e-9 for c, i in near)
        left = index.nearest(q, tk.K, near[0][1])
        assert near[0][1] not in {i for _, i in left} and len(left) == min(tk.K, sum(c > 0 for c in cosines) - 1)
    assert index.opened < 100 * index.blocks


def test_texts_are_cut_and_looked_up_together(monkeypatch):
    """No text is cut or looked up by itself, and each gets what it gets alone."""
    rows, labels, _ = corpus(300, 7)
    texts = dict(rows)
    own = [tk.counted(texts[i]) for i, _, _ in labels]
    index = tk.built(pa.array([list(c) for c in own]), pa.array([list(c.values()) for c in own], pa.list_(pa.int32())), np.array([t for _, _, t in labels], float), [i for i, _, _ in labels])
    odd = ["", " \n", "a_b \u0391\u03a3 \u0391\u03a3\u0391_\u03a3. \u0130x \u01c5 \u00b2\u00b3 \u2167\u4e2d\u6587\U00012606 \u00df", "\x1c\x85_", "\u00e9" * 9, "scum_SCUM\x1cScum\u3000idiot", *BAD]
    texts = [t for _, t in rows[::3]] + odd
    scorer, place = tk.Scorer(index, tk.Curve([(0.2, 0.3), (0.9, 0.8)], [0.0, 1.0])), {t: i for i, t in enumerate(index.terms)}
    alone = []
    for text in texts:
        tf = {place[t]: n for t, n in slow_terms(text).items() if t in place}
        alone.append(index.nearest(index.unit(tf), tk.K) if tf else [])
    calls = []
    monkeypatch.setattr(tk, "terms_of", lambda chunk: calls.append(chunk))
    for lot in (tk.LOT, 500):
        monkeypatch.setattr(tk, "LOT", lot)
        for a, b in zip(scorer.near(texts), alone, strict=True):
            assert len(a) == len(b) and all(abs(x[0] - y[0]) < 1e-9 for x, y in zip(a, b))
    words, of = tk.words_of(odd)
    assert list(zip(words.to_pylist(), of.tolist())) == [(w, i) for i, t in enumerate(odd) for w in tk.WORD.findall(t.lower())]
    assert scorer(texts + texts) == scorer(texts) * 2 and scorer([]) == [] and not calls


def test_flat_vectors_open_all_blocks_at_once():
    """Where no term is heavy, bounds would rule out nothing and are not made; what is found is the same."""
    rng = random.Random(3)
    vectors = [rng.sample(range(300), 60) for _ in range(700)]
    posted = [(t, i, 1) for i, v in enumerate(vectors) for t in v]
    index = tk.Index([str(t) for t in range(300)], np.ones(300), np.zeros(300, bool), *(np.array(c) for c in zip(*posted)), np.zeros(700), list(range(700)))
    query = rng.sample(range(300), 50)
    index.largest = None
    near = index.nearest(index.unit(dict.fromkeys(query, 1)), tk.K)
    cosines = sorted((-round(len(set(query) & set(vectors[i])) / math.sqrt(50 * 60), 12), k) for k, i in enumerate(index.ids))
    assert [i for _, i in near] == [i for _, i in cosines[: tk.K]] and index.opened == index.blocks
