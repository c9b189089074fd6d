import math
import random
import re

from codefacts.llm import license_scan as ls


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in ls.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_against_brute_force(frame, odd_rows):
    rows = odd_rows + [
        (200, "MIT License. mit-license mit mit license; the GNU General Public\nLicense, Apache\tLicense CC BY CC-BY-NC 4.0"),
        (201, "gnu general public license gnu general public license mit"),
        (202, "MITLicense ÀMIT License mit licenseé"),
    ]
    found = ls.op3(frame(rows)).collect()
    assert sorted((tuple(r[:6]) for r in found), key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in found)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)


def test_notices_need_their_key_phrases_and_bear_edits():
    index = ls.Index()
    labels = lambda text: index.report(text)[5]
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    assert labels("x y " + full) == "mit-notice"
    assert labels(full.replace("hereby ", "now ").replace("granted", "given")) == "mit-notice"
    assert labels(full.replace("free of charge", "for a fee")) == ""
    assert labels("Released under the MIT License.") == "mit,mit-released"
    assert labels("Licensed under the Apache License, Version 2.0") == "apache,apache-2.0"
    assert labels("permission granted copy software license public") == ""


def test_empty_table(frame):
    assert ls.op3(frame([])).collect() == []


def slow_labels(text):
    """Every template at every start: share of its IDF mass in place, and key phrases word for word."""
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    held = {w: sum(w in t.words for t in ls.TEMPLATES) for t in ls.TEMPLATES for w in t.words}
    idf = {w: math.log((1 + len(ls.TEMPLATES)) / n) for w, n in held.items()}
    found, score = set(), 0.0
    for t in ls.TEMPLATES:
        total = sum(idf[w] for w in t.words)
        for start in range(-len(t.words), len(words)):
            at = lambda p: words[start + p] if 0 <= start + p < len(words) else None  # noqa: B023, E731
            share = sum(idf[w] for p, w in enumerate(t.words) if at(p) == w) / total
            keys = all(all(at(p + i) == w for i, w in enumerate(key)) for p, key in t.mandatory)
            if keys and share >= t.share - 1e-9:
                found.add(t.label)
                score = max(score, min(1.0, share) * (1 - 0.5 ** len(t.words)))
    return ",".join(sorted(found)), score


def test_the_whole_query_against_every_template_at_every_start(frame, odd_rows):
    rng = random.Random(6)
    vocabulary = sorted({w.decode() for t in ls.TEMPLATES for w in t.words}) + ["x", "über"]
    rows = odd_rows[:69]
    for i in range(250):
        text = rng.choices(vocabulary, k=rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            own = [w.decode() for w in rng.choice(ls.TEMPLATES).words]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text[rng.randint(0, len(text)) : 0] = own
        rows.append((1000 + i, " ".join(text)))
    found = sorted(((r.doc_id, r.labels, round(r.score, 9)) for r in ls.op3(frame(rows)).collect()), key=repr)
    slow = sorted(((i, *slow_labels(t)) for i, t in rows), key=repr)
    assert found == sorted(((i, labels, round(score, 9)) for i, labels, score in slow), key=repr)
    assert sum(bool(labels) for _, labels, _ in slow) > 100
