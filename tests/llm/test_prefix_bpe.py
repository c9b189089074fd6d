import hashlib
import random

import pytest

from codefacts.llm import prefix_bpe

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return prefix_bpe.Vocabulary(prefix_bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.fixture(scope="module")
def whole(vocabulary):
    return tiktoken.Encoding("w", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_every_prefix_has_its_own_encoding(vocabulary, whole):
    text = "Ertion thereñ über 1234 中文字ひらがな"
    p = prefix_bpe.Prefixes(vocabulary, text.encode())
    for n in range(len(text) + 1):
        end = len(text[:n].encode())
        q = prefix_bpe.Prefixes(vocabulary, text[:n].encode())
        assert q.last == p.last[:end]
        assert q.ids() == whole.encode_ordinary(text[:n])


def test_against_the_library(vocabulary, library):
    rng, coder = random.Random(5), prefix_bpe.Coder(vocabulary, tokenizers.PATTERN)
    letters = "aetionhsé ñß .,'\n\t\x1c\xa0 1234中文ひらабв%$*𝒜\U000323af\U00012606"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        ids = library.encode_ordinary(text)
        assert coder.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), repr(text)


def test_edits_meet_the_old_table(vocabulary):
    rng = random.Random(2)
    text = bytes(rng.choice(b"the answer is not here ") for _ in range(3000))
    for _ in range(20):
        p = prefix_bpe.Prefixes(vocabulary, text)
        a = rng.randrange(len(text))
        b, new = a + rng.randint(0, 9), bytes(rng.choice(b"aeth ") for _ in range(rng.randint(0, 9)))
        anew = p.edit(a, b, new)
        assert p.last == prefix_bpe.Prefixes(vocabulary, text[:a] + new + text[b:]).last
        assert anew < 400


def test_documents(frame, odd_rows, library):
    found = prefix_bpe.op10(frame(odd_rows)).collect()
    expected = []
    for i, t in odd_rows:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert prefix_bpe.op10(frame([])).collect() == []


def test_one_vocabulary_for_all_tasks_of_a_worker(vocabulary, library):
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = prefix_bpe.kept_coder(path, tokenizers.PATTERN)
    assert prefix_bpe.kept_coder(path, tokenizers.PATTERN) is coder
    # Odd spaces are seen whether words are known or not, and leave nothing behind.
    for text in ["", " ", "a", " a", "a ", "a  b", "a b", "a \nb", "a \x1cb", "a \x85b", "a \u3000b", "a\n b", "a b", "a b "]:
        ids = library.encode_ordinary(text)
        assert coder.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), repr(text)
    assert "" not in coder.words and all(not w[0].isspace() for w in coder.words)


def test_common_words_need_no_pattern(vocabulary):
    """A space, letters and at most one other sign are cut without the pattern, as it would cut them."""
    coder = prefix_bpe.Coder(vocabulary, tokenizers.PATTERN)
    for c in map(chr, range(0x250)):
        for text in (" ab" + c, " a" + c + "b", " " + c + "b", c + "ab", " " + c, c, " a" + c + c, " a'" + c):
            assert coder.split(text) == coder.pattern.findall(text), repr(text)
    for c in map(chr, range(0x110000)):
        assert c.isspace() == (prefix_bpe.ODD_SPACE.match(" " + c) is not None), repr(c)
    calls, whole = [], coder.pattern

    class Counted:
        pattern = whole.pattern

        def findall(self, text):
            calls.append(text)
            return whole.findall(text)

    coder.pattern = Counted()
    coder.digest("The answer, here: über señor. isn't 12 b4")
    assert sorted(calls) == sorted(["The", " isn't", " 12", " b4"])


def test_one_look_for_a_byte_that_ends_no_other_token(vocabulary):
    """Tokens that end at a byte are known from the state: none is sought by its bytes again."""
    data = "Ertion thereñ über 1234 中文字".encode()
    known = prefix_bpe.Prefixes(vocabulary, data)
    expected = {n: [(i, vocabulary.usable[data[n - i : n]]) for i in range(min(n, vocabulary.longest), 0, -1) if data[n - i : n] in vocabulary.usable] for n in range(1, len(data) + 1)}
    state = vocabulary.root
    for n, byte in enumerate(data, 1):
        state = state.get(byte) or vocabulary.step(state, byte)
        assert list(state[-1]) == expected[n]
    usable, vocabulary.usable = vocabulary.usable, None
    try:
        assert prefix_bpe.Prefixes(vocabulary, data).last == known.last
    finally:
        vocabulary.usable = usable
    for n in (0, 1, 5, 9, len(data)):
        assert prefix_bpe.Prefixes(vocabulary, data, known.last[:n]).last == known.last
