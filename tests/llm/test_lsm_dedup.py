import re
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from codefacts.llm import common, lsm_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for body, members in groups.items():
        members.sort(key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, members[0][0], len(members), k == 0, sha256(body.encode()).hexdigest()) for k, (i, _) in enumerate(members)]
    return sorted(out, key=repr)


def test_against_brute_force(frame, odd_rows):
    found = lsm_dedup.op8(frame(odd_rows)).collect()
    assert sorted(map(tuple, found), key=repr) == brute(odd_rows)


def test_colliding_digests_are_told_apart_by_bytes(frame, odd_rows):
    weak = lsm_dedup.Index(frame(odd_rows).select("doc_id", "text"), digest=lambda body: F.encode((F.length(body) % 3).cast("string"), "UTF-8"))
    found = weak.classes().select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, found), key=repr) == sorted((r[:4] for r in brute(odd_rows)), key=repr)


def test_kept_rows_keep_their_columns(frame, odd_rows):
    docs = frame(odd_rows)
    kept = lsm_dedup.Index(docs).kept_rows()
    assert kept.columns == docs.columns
    assert sorted((tuple(r[:2]) for r in kept.collect()), key=repr) == sorted({(i, t) for i, t in odd_rows if any(b[0] == i and b[3] and b[4] == sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest() for b in brute(odd_rows))}, key=repr)


def test_empty_table(frame):
    assert lsm_dedup.op8(frame([])).collect() == []


def test_filter_passes_repeated_digests_and_few_others(frame):
    rows = [(i, f"text {i}") for i in range(4000)] + [(10_000 + i, f"text {i}") for i in range(300)]
    index = lsm_dedup.Index(frame(rows).select("doc_id", "text"))
    # Every row of a group passes; of the others hardly any.
    passed = {r.tag for r in index.members.select("tag").collect()}
    assert index.members.where("size > 1").count() == 600
    assert 600 <= len(passed) <= 640
    assert index.single.count() == len(rows) - len(passed)
    assert index.filter.count() <= 300
    assert sorted(map(tuple, index.classes().select("doc_id", "keep_id", "group_size", "kept").collect())) == sorted(r[:4] for r in brute(rows))


def test_a_filter_that_is_full_changes_no_result(frame, odd_rows, monkeypatch):
    monkeypatch.setattr(common, "FILTER", 1)
    assert sorted(map(tuple, lsm_dedup.op8(frame(odd_rows)).collect()), key=repr) == brute(odd_rows)
    assert lsm_dedup.Index(frame(odd_rows)).kept_rows().count() == sum(r[3] for r in brute(odd_rows))
