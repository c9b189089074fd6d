"""The pipeline's near-copy stage against five-word Jaccard similarities computed pair by pair from the words."""

import random
import re

import corpus_pipeline
from codefacts.llm import simhash_copies as sc


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def slow_kept(rows):
    """The rows that stay: of each group linked by pairs of at least 0.8 that with the smallest id."""
    own = [five_words(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            if 5 * min(len(a), len(own[j])) >= 4 * max(len(a), len(own[j])) and jaccard(a, own[j]) >= 0.8:
                parent[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), (True, 0, 0)), (i is None, i or 0, k)) if find(k) in best else (i is None, i or 0, k)
    return sorted((rows[k] for _, _, k in best.values()), key=repr)


def kept(frame, rows):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(None, frame(rows), "").collect()), key=repr)


def block_copies(seed, n):
    """Texts, and of each a copy with a paragraph appended, one with its end cut off and one with its beginning cut off."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(20_000)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(100, 600))
        part = len(text) // 8
        rows += [(i, " ".join(text)), (1000 + i, " ".join(text + rng.choices(words, k=part))), (2000 + i, " ".join(text[:-part])), (3000 + i, " ".join(text[part:]))]
    return rows


def test_block_edits_go(frame):
    rows = block_copies(5, 60)
    sets = {i: five_words(t) for i, t in rows}
    assert all(jaccard(sets[i % 1000], s) >= 0.8 for i, s in sets.items())
    assert kept(frame, rows) == sorted((r for r in rows if r[0] < 60), key=repr)


def test_texts_of_one_vocabulary_stay(frame):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=4000))) for i in range(30)]
    permuted = rows[0][1].split()
    rng.shuffle(permuted)
    rows += [(100, " ".join(permuted)), (101, " ".join(sorted(permuted)))]
    assert kept(frame, rows) == sorted(rows, key=repr)


def test_against_jaccard_of_all_pairs(frame, odd_rows):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows = odd_rows + [(1000 + i, t) for i, t in block_copies(7, 15)]
    # Chains, one large group of near copies, texts about a common passage, and similarities on both sides of 0.8.
    passage, chain = rng.choices(words, k=30), rng.choices(words, k=200)
    for i in range(40):
        chain = chain[8:] + rng.choices(words, k=8)
        rows.append((10_000 + i, " ".join(chain)))
    for i in range(80):
        copy = list(chain)
        copy[rng.randrange(200)] = "new"
        rows.append((11_000 + i, " ".join(copy)))
        rows.append((12_000 + i, " ".join(passage + rng.choices(words, k=rng.randint(1, 12)))))
        some = rows[rng.randrange(60)][1].split() + rng.choices(words, k=20)
        rows.append((13_000 + i, " ".join(some[: rng.randint(5, len(some))])))
    assert kept(frame, rows) == slow_kept(rows)
    assert kept(frame, []) == []


def test_rows_of_one_id_with_different_texts(frame):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    a, b, c = (" ".join(rng.choices(words, k=200)) for _ in range(3))
    rows = [(3, a), (5, a + " end"), (5, b), (None, c), (None, c + " end"), (7, c + " more")]
    assert kept(frame, rows) == sorted([(3, a), (5, b), (7, c + " more")], key=repr)


def family(seed, n, words, edits):
    """Copies of one text with edits of single words: their similarities lie around 0.8, on both sides."""
    rng = random.Random(seed)
    base = rng.choices([f"w{k}" for k in range(3000)], k=words)
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_a_large_family(frame, monkeypatch):
    monkeypatch.setattr(sc, "LOOK", 16)
    monkeypatch.setattr(sc, "BUCKET", 16)
    rows = family(13, 400, 120, 9)
    assert kept(frame, rows) == slow_kept(rows)


def test_chance_of_a_pair_to_meet():
    # A bit differs with a probability of (1 - s) / 2: measured on sets of similarity 0.8.
    import numpy as np

    rng = np.random.default_rng(3)
    apart, missed = [], 0
    for _ in range(400):
        sets = rng.integers(0, 2**63, 450, dtype=np.int64).astype(np.uint64)
        a, b = (np.frombuffer(sc.fingerprints(np.unique(x)), ">u4").astype(np.uint64) for x in (sets[:405], sets[45:]))
        own = np.bitwise_count(a ^ b)
        apart.append(own.sum())
        missed += not ((own <= sc.RADIUS) & (np.roll(own, -1) <= sc.FAR)).any()
    assert abs(np.mean(apart) / (sc.TABLES * sc.BITS) - 0.1) < 0.005
    assert max(apart) <= sc.FAR_IN_ALL and missed <= 3


def test_copies_of_texts_on_disk_are_packed(frame, monkeypatch):
    written, saved = {}, sc.saved

    def kept_names(df, name, **options):
        out = saved(df, name, **options)
        written.setdefault(name, []).extend(out.inputFiles())
        return out

    monkeypatch.setattr(sc, "saved", kept_names)
    rows = block_copies(9, 4)
    assert kept(frame, rows) == sorted((r for r in rows if r[0] < 4), key=repr)
    assert written["rows"] and written["texts"] and all(".zstd." in f for n in ("rows", "texts") for f in written[n])


def pulled_apart(seed, n, words, edits):
    """A family in which most pairs are similar by a little less than 0.8."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(words), edits if i % 10 else 1):
            copy[at] = f"x{rng.randrange(100_000)}"
        rows.append((i, " ".join(copy)))
    return rows


def rows_written(monkeypatch):
    counts, saved = {}, sc.saved

    def counted(df, name, **options):
        out = saved(df, name, **options)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(sc, "saved", counted)
    return counts


def test_pairs_of_a_family_grow_with_its_texts(frame, monkeypatch):
    # The pairs that meet: about a third of the square.
    rows = pulled_apart(21, 300, 150, 3)
    counts = rows_written(monkeypatch)
    assert kept(frame, rows) == slow_kept(rows)
    assert counts["candidates"] < 10 * len(rows) and counts["close"] < 4 * len(rows)


def test_a_family_beyond_a_task(frame, monkeypatch):
    rows = family(23, 200, 120, 9) + [(1000 + i, t) for i, t in pulled_apart(22, 150, 150, 4)]
    monkeypatch.setattr(sc, "IN_TASK", 500)
    counts = rows_written(monkeypatch)
    assert kept(frame, rows) == slow_kept(rows)
    assert counts["apart"] > 100


def components_of(n, pairs):
    import numpy as np

    a, b = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    return sc.united(np.arange(n), a, b).tolist()


def test_all_links_of_a_family():
    import numpy as np

    rng = random.Random(31)
    several = [family(s, 90, 60 + 20 * s, s + 1) for s in range(8)] + [pulled_apart(9, 90, 150, k) for k in (2, 3, 4)]
    # Two families as one, no common text at all, chains, copies, and texts of a shingle or none.
    several += [several[1] + several[2], block_copies(4, 12), [(0, ""), (1, None), (2, "a b"), (3, "A B"), (4, "a b c d e f"), (5, "a b c d e g")], [(0, "a"), (1, "b")]]
    chain = [f"c{k}" for k in range(100)]
    several.append([(i, " ".join(chain[i:] + [f"e{k}" for k in range(i)])) for i in range(60)])
    for rows in several:
        sets, n = [sc.shingles(t or "") for _, t in rows], len(rows)
        # Exactly as by the words.
        words = [five_words(t) for _, t in rows]
        links = [(i, j) for i in range(n) for j in range(i) if jaccard(words[i], words[j]) >= 0.8]
        size, alone = np.array([len(s) for s in sets]), np.arange(n)
        for some in (sets, sets[:2], sets[-1:]):
            center = sc.Center(some)
            differences = [center.difference(s) for s in sets]
            assert all(set(d.tolist()) == set(s.tolist()) ^ set(center.shingles.tolist()) for d, s in zip(differences, sets, strict=True))
            assert sc.settled(differences, size, alone).tolist() == components_of(n, links)
            # Links known before, by any names; parts, each by itself, that the next goes on from.
            before = sc.places(np.array([rng.randrange(3) if k % 4 == 0 else 100 + k for k in range(n)]))
            known = components_of(n, links + [(i, int(r)) for i, r in enumerate(before)])
            assert sc.settled(differences, size, before).tolist() == known
            of_parts = [sc.settled(differences, size, alone, part, 3) for part in range(3)]
            assert components_of(n, [(i, int(r)) for found in of_parts for i, r in enumerate(found)]) == components_of(n, links)


def test_who_meets_is_of_one_family(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    entries = np.empty(400, sc.ENTRY)
    entries["print"] = base[rng.integers(0, 12, 400)]
    for _ in range(3):
        entries["print"] ^= np.uint64(1) << rng.integers(0, 59, 400, dtype=np.uint64)
    entries["print"] &= np.uint64(2**59 - 1)
    entries["node"], entries["size"] = np.arange(400), rng.integers(80, 140, 400)
    entries["root"] = entries["node"] // 2 * 2
    fps, check, size, root = entries["print"] >> np.uint64(32), entries["print"] & np.uint64(2**32 - 1), entries["size"], entries["root"]
    # Within half the radius of one variant.
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    ok = (apart <= sc.RADIUS) & (np.bitwise_count(check[:, None] ^ check[None, :]) <= sc.FAR) & (5 * np.minimum(size[:, None], size) >= 4 * np.maximum(size[:, None], size)) & (root[:, None] != root)
    links = [(int(root[i]), int(root[j])) for i, j in zip(*np.nonzero(ok), strict=True)]

    def families():
        a, b, _ = sc.met(entries, 5, 0, False)
        assert len(a) < 200 and set(a.tolist()) | set(b.tolist()) <= set(root.tolist())
        return components_of(400, list(zip(a.tolist(), b.tolist(), strict=True)))

    assert families() == components_of(400, links)
    monkeypatch.setattr(sc, "LOOK", 2)
    coarse = families()
    assert all(coarse[a] == coarse[b] for a, b in links)
