"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has one BPE encoding, and that encoding is the encoding of a shorter
prefix and one last token. The last token of the prefix that ends at i is the longest vocabulary
entry t ending there for which (last token of the prefix before t, t) stay apart when BPE encodes
their bytes together; at most one entry passes. ``Prefixes`` stores the last token of every prefix:
bytes are appended without touching what is stored, and after an edit only the prefixes from
the edit on are found again, until the new table meets the old one.

Tokens that BPE never makes (whose own bytes encode otherwise) take no part. Whether two tokens stay
apart is found by undoing merges from both sides of their border and is cached.

Defined cases: null and empty texts have no tokens; texts of any length and any bytes are encoded in
time proportional to their length times the longest token; ids out of the vocabulary raise KeyError; repeated
rows get equal rows; other columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame

from codefacts.llm.common import mapped


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Vocabulary:
    """Tokens, the merge that makes each, and the test whether two tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.usable: dict[bytes, int] = {t: r for t, r in ranks.items() if len(t) == 1}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and len(pair := self.merged(token, rank)) == 2:
                self.parts[rank] = (pair[0], pair[1])
                self.usable[token] = rank
        self.starts = {token[:n] for token in self.usable for n in range(1, len(token) + 1)}
        #: An automaton, made as it is used. A state is the longest beginning of a usable token that the bytes so far end in: the next
        #: states by byte, the usable tokens that end here (their lengths, ids) under -1, longest first, and its bytes under -2.
        self.states: dict[bytes, dict] = {}
        self.root = self.state(b"")

    def state(self, data: bytes) -> dict:
        if (found := self.states.get(data)) is None:
            ends = tuple((len(data) - i, self.usable[data[i:]]) for i in range(len(data)) if data[i:] in self.usable)
            found = self.states[data] = {-1: ends, -2: data}
        return found

    def step(self, state: dict, byte: int) -> dict:
        """The state behind one more byte, kept with the state before: beginnings of tokens, times bytes that follow them, at most."""
        data = state[-2] + bytes([byte])
        while data and data not in self.starts:
            data = data[1:]
        found = state[byte] = self.state(data)
        return found

    def merged(self, data: bytes, below: int) -> list[int]:
        """Plain BPE by the merges that come before a rank."""
        ids = [self.ranks[data[i : i + 1]] for i in range(len(data))]
        words = [data[i : i + 1] for i in range(len(data))]
        while len(words) > 1:
            rank, at = min((self.ranks.get(words[i] + words[i + 1], below), i) for i in range(len(words) - 1))
            if rank >= below:
                break
            words[at : at + 2] = [words[at] + words[at + 1]]
            ids[at : at + 2] = [rank]
        return ids

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' joined bytes is these two tokens."""
        if (known := self.apart.get((a, b))) is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            known = self.apart[a, b] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        # Walk back in merge order. At each step the later of the two merges next to the border is undone;
        # what then touches the border was there before, and a merge across it of a lower rank than the
        # undone one would have come first. On equal ranks the one further left comes first.
        limit = len(self.tokens)
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < limit:
                return False
            if left > right:
                limit = left
                if left not in self.parts:
                    return self._bytes_apart(left, right, limit)
                left = self.parts[left][1]
            else:
                limit = right + 1
                if right not in self.parts:
                    return self._bytes_apart(left, right, limit)
                right = self.parts[right][0]

    def _bytes_apart(self, left: int, right: int, limit: int) -> bool:
        """The same once the side of the later rank is a single byte."""
        while left in self.parts or right in self.parts:
            if left in self.parts:
                limit, left = min(limit, left), self.parts[left][1]
            else:
                limit, right = min(limit, right + 1), self.parts[right][0]
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < limit:
                return False
        return True


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", known: list[int] | None = None) -> None:
        """known: the last tokens of the data's first prefixes, which another table has."""
        self.vocabulary, self.data, self.last = vocabulary, data, known or []
        self._extend(len(self.last))

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self._extend(start)

    def _extend(self, start: int, stop: int | None = None) -> None:
        """Find the last tokens of the prefixes that end behind start, up to stop."""
        v, data, last = self.vocabulary, self.data, self.last
        apart, stay_apart, step = v.apart.get, v.stay_apart, v.step
        state = v.root
        # A state is no longer than the longest token.
        for byte in data[max(0, start - v.longest) : start]:
            state = state.get(byte) or step(state, byte)
        for end, byte in enumerate(data[start:stop], start + 1):
            state = state.get(byte) or step(state, byte)
            for n, token in state[-1]:
                if n == end:
                    break
                before = last[end - n - 1]
                known = apart((before, token))
                if known or known is None and stay_apart(before, token):
                    break
            else:
                raise ValueError(f"a byte outside the vocabulary: {data[end - 1 : end]!r}")
            last.append(token)

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace bytes start to stop; returns how many prefixes were found anew.

        Behind the new bytes, once as many prefixes in a row as the longest token has bytes end in
        the same token as before, all that follow do too.
        """
        old, shift = self.last[stop:], len(data) - (stop - start)
        rest = self.data[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(data)
        self.data += rest
        anew, equal = len(data), 0
        for i in range(len(rest)):
            if equal >= self.vocabulary.longest:
                self.last += old[i:]
                break
            end = start + len(data) + i
            self._extend(end, end + 1)
            anew, equal = anew + 1, equal + 1 if self.last[end] == old[i] else 0
        assert len(self.last) == len(self.data), shift
        return anew

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(token := self.last[end - 1])
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Coder:
    """Encodes texts piece by piece; pieces seen before are looked up."""

    #: Chunks and pieces kept, and the longest that are: the memory of a worker stays bounded.
    CHUNKS, LONGEST = 500_000, 48
    #: Lengths of the beginnings whose tables are kept.
    STEMS = (9, 7, 5)
    #: The pattern whose matches in a space, letters and a sign are known without it.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.words = Words(self)
        self.decimal = {i: str(i) for i in vocabulary.tokens}
        self.pieces: dict[str, list[int]] = {}
        self.stems: dict[bytes, list[int]] = {}

    def split(self, text: str) -> list[str]:
        """The pattern's matches, letters and numbers being what tiktoken's own tables say."""
        if text.isascii() or max(text) < "\u0250":
            # A space, letters and at most one other sign: the most frequent words.
            if text[:1] == " " and text[1:-1].isalpha() and self.pattern.pattern == self.WORDS:
                if text[-1].isalpha():
                    return [text]
                if not text[-1].isalnum() and not text[-1].isspace():
                    return [text[:-1], text[-1]]
            return self.pattern.findall(text)
        alike = "".join([c if c < "\u0250" else stand_in(c) for c in text])
        return [text[m.start() : m.end()] for m in self.pattern.finditer(alike)]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            if (ids := self.pieces.get(piece)) is None:
                data = piece.encode()
                whole = self.vocabulary.usable.get(data)
                ids = [whole] if whole is not None else self.prefixes(data).ids()
                if len(piece) <= self.LONGEST:
                    if len(self.pieces) >= self.CHUNKS:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.vocabulary.tokens[i] for i in ids])

    def prefixes(self, data: bytes) -> Prefixes:
        """The table of a piece, appended to the table of a beginning that other pieces share."""
        size, n, known = len(data), 0, None
        for n in self.STEMS:
            if n < size and (known := self.stems.get(data[:n])) is not None:
                break
        else:
            n = 0
        p = Prefixes(self.vocabulary, data, known and known[:])
        for stem in self.STEMS:
            if n < stem < size:
                if len(self.stems) >= self.CHUNKS:
                    self.stems.clear()
                self.stems[data[:stem]] = p.last[:stem]
        return p

    def both(self, text: str) -> tuple[str, bytes]:
        """The ids of a text in decimal, joined by commas, and the bytes that they decode to."""
        ids = self.encode(text)
        return ",".join([self.decimal[i] for i in ids]), self.decode(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the comma-joined ids, SHA-256 of the bytes that they decode to."""
        first, *rest = text.split(" ")
        try:
            found = list(map(self.words.__getitem__, rest))
            if first:
                found.insert(0, self.both(first))
        except OddSpaceError:
            found = [self.both(c) for c in chunks(text)]
        ids = ",".join([f[0] for f in found])
        decoded = b"".join([f[1] for f in found])
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


class OddSpaceError(Exception):
    """A space that another white space follows, or the end: pieces cross it."""


class Words(dict):
    """A word without spaces to the ids of a space and the word, and their bytes; no word that begins with white space, nor an empty one, is kept."""

    def __init__(self, coder: Coder) -> None:
        self.coder = coder

    def __missing__(self, word: str) -> tuple[str, bytes]:
        if not word or word[0].isspace():
            raise OddSpaceError
        found = self.coder.both(" " + word)
        if len(word) <= Coder.LONGEST:
            if len(self) >= Coder.CHUNKS:
                self.clear()
            self[word] = found
        return found


@functools.cache
def _class(pattern: str):
    import tiktoken

    return tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})


@functools.lru_cache(1 << 16)
def stand_in(char: str) -> str:
    """A character of the class that tiktoken's tables put this one in: a letter, a number, a space or none of them."""
    for pattern, like in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\u2003")):
        if _class(pattern).encode_ordinary(char):
            return like
    return "!"


ODD_SPACE = regex.compile(r" (?=[\s\x1c-\x1f]|\Z)")


def chunks(text: str) -> list[str]:
    """The text cut before each space that a non-space follows: no piece of the pattern crosses such a place.

    Spaces before another white space, or at the end, stay inside a chunk.
    """
    words = text.split(" ")
    if ODD_SPACE.search(text) is None:
        return words[:1] * bool(words[0]) + [" " + w for w in words[1:]]
    out = [words[0]]
    for w in words[1:]:
        if w and not w[0].isspace():
            out.append(" " + w)
        else:
            out[-1] += " " + w
    return [x for x in out if x]


@functools.lru_cache(1)
def kept_coder(ranks_path: str, pattern: str) -> Coder:
    """One coder for all tasks of a worker: the vocabulary is built once, and pieces stay known (CHUNKS of each kind at most)."""
    return Coder(Vocabulary(read_ranks(ranks_path)), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each row's whole text. ranks_path: a local file that every executor has."""

    def make():
        coder = kept_coder(ranks_path, pattern)
        return lambda ids, texts: [list(c) for c in zip(*map(coder.digest, texts), strict=True)]

    return mapped(docs.select(id_col, text_col), make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
