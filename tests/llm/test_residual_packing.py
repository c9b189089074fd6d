import random
import zlib
from collections import Counter

import numpy as np
import pytest

from codefacts.llm import residual_packing as rp

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def checked(found, rows, library, length=2048):
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    expected = []
    for i, many in ids.items():
        for one in many:
            cuts = [0, *range(len(one) % length or length, len(one) + 1, length)]
            expected += [(i, k, a, b - a, zlib.crc32(np.array(one[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in found), key=repr) == sorted(expected, key=repr)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_documents(frame, odd_rows, library):
    rows = odd_rows + [(300, "a <|endoftext|> b"), (301, "two  spaces \n\n and  end "), (302, "中文 text ひら"), (303, "x\x1c y")]
    found = rp.op7(frame(rows).repartition(3)).collect()
    n = checked(found, rows, library)
    assert n <= -(-sum(r.length for r in found) // 2048) + 1
    assert rp.op7(frame([])).collect() == []


def test_tree_of_many_partitions(frame, library, monkeypatch):
    monkeypatch.setattr(rp, "FAN_IN", 3)
    rows = [(i, "the answer " * (20 + i * 37 % 700)) for i in range(120)]
    found = rp.pack(frame(rows).repartition(20), PATH).collect()
    n = checked(found, rows, library)
    assert n <= 1.1 * sum(r.length for r in found) / 2048 + 1


def test_best_fit():
    assert rp.best_fit([5, 5, 3, 7], 10) in ([[3, 2], [0, 1]], [[3, 2], [1, 0]])
    assert rp.best_fit([], 10) == []
    assert sorted(map(len, rp.best_fit([10] * 3 + [1] * 20, 10))) == [1, 1, 1, 10, 10]


def test_best_fit_by_counts_makes_as_many_bins():
    rng = random.Random(4)
    for _ in range(60):
        most = rng.choice([3, 10, 50])
        items = [rng.randint(1, most) for _ in range(rng.randint(1, 300))]
        counted = rp.best_fit_counts(Counter(items), 50)
        assert all(sum(fills) <= 50 and many > 0 for fills, many in counted)
        placed = Counter()
        for fills, many in counted:
            for f in fills:
                placed[f] += many
        assert placed == Counter(items)
        one_by_one = Counter(tuple(sorted(items[i] for i in b)) for b in rp.best_fit(items, 50))
        by_counts = Counter()
        for fills, many in counted:
            by_counts[tuple(sorted(fills))] += many
        assert sum(by_counts.values()) == sum(one_by_one.values())


def test_bins_that_were_passed_over_are_packed(frame, library, monkeypatch):
    """Partitions of one length each, more bins than a node carries, and a short text that keeps them all underfull."""
    monkeypatch.setattr(rp, "CARRY", 2)
    monkeypatch.setattr(rp, "PART", 8)
    monkeypatch.setattr(rp, "FAN_IN", 2)
    rows = [(i, " the" * (130 if i < 40 else 110)) for i in range(80)] + [(200, ""), (None, " the" * 110), (None, " the" * 110)]
    found = rp.pack(frame(rows).repartitionByRange(10, "doc_id"), PATH, 256).collect()
    n = checked(found, rows, library, 256)
    fills = Counter()
    for r in found:
        fills[r.sequence_id] += r.length
    # No two sequences are left that fit one another, whichever nodes they came from.
    assert len(rp.best_fit(list(fills.values()), 256)) == n <= 50
