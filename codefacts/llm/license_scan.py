"""Licence detection by a positional rare-token index.

Templates (full notices and short phrases) are cut into words. The index holds, for each word, its
postings (template, position) and its IDF over the templates. A file's licence words are looked up
rarest first: each template is anchored at its highest-IDF word; every place of that word in the file
gives a relative position (place in the file minus place in the template) at which the template may
start, and the postings of the template's other words are intersected there: words that stand at the
same relative position count. A template is found where its covered IDF mass reaches its share and
all its mandatory key phrases stand word for word at their place.

Short phrases are templates whose every word is mandatory, so that each of their places is found:
any place holds the anchor word. Long notices use all their words above RARE of the largest IDF as
anchors, so that an edited anchor is not a miss.

Defined cases: null and empty texts have no words, no labels and score 0; texts are read whole; only
the id and the text column are read; repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from codefacts.llm.common import mapped

#: Words of a text whose A-Z are lower-cased: runs of digits, letters a-z and all that is not ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The phrases asked for and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass
class Template:
    label: str
    words: tuple[bytes, ...]
    #: (position, words) that must stand there.
    mandatory: list[tuple[int, tuple[bytes, ...]]] = field(default_factory=list)
    share: float = 1.0
    base: bool = False


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def notice(label: str, text: str, *key_phrases: str, share: float = 0.8) -> Template:
    """A template that needs a share of its IDF mass, and its key phrases whole."""
    words = tuple(words_of(text))
    found = []
    for phrase in key_phrases:
        key = tuple(words_of(phrase))
        found.append((next(i for i in range(len(words)) if words[i : i + len(key)] == key), key))
    return Template(label, words, found, share)


TEMPLATES = [
    *(Template(label, tuple(words_of(phrase)), base=True) for phrase, label in PHRASES.items()),
    notice("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "general public license version 3"),
    notice("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    notice("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    notice("mit-released", "Released under the MIT License", "the mit license"),
    notice("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "free of charge", "obtaining a copy of this software"),
    notice("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "source and binary forms", "following conditions are met"),
    notice("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    notice("isc-notice", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    notice("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    notice("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    notice("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", "cc0 1 0 universal"),
]


class Index:
    """Postings and IDF of the templates' words, and each template's anchors."""

    #: Words of at least this share of a notice's largest IDF are anchors.
    RARE = 0.75

    def __init__(self, templates: list[Template] = TEMPLATES) -> None:
        self.templates = templates
        held = Counter(w for t in templates for w in set(t.words))
        self.idf = {w: math.log((1 + len(templates)) / n) for w, n in held.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.mass = [sum(self.idf[w] for w in t.words) for t in templates]
        for k, t in enumerate(templates):
            top = max(self.idf[w] for w in t.words)
            rare = [i for i, w in enumerate(t.words) if self.idf[w] >= self.RARE * top]
            for i, w in enumerate(t.words):
                self.postings[w].append((k, i))
            for i in rare[:1] if t.share >= 1 else rare:
                self.anchors[t.words[i]].append((k, i))
        self.vocabulary = frozenset(self.idf)
        self.rare = frozenset(self.anchors)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and (template, start in words, covered share) of each place found."""
        words = words_of(text)
        known = set(words) & self.vocabulary
        if not known & self.rare:
            return len(words), []
        at = [i for i, w in enumerate(words) if w in known]
        starts = {(k, i - p) for i in at for k, p in self.anchors.get(words[i], ())}
        if not starts:
            return len(words), []
        covered: Counter = Counter()
        for i in at:
            for k, p in self.postings[words[i]]:
                if (k, i - p) in starts:
                    covered[k, i - p] += self.idf[words[i]]
        found = []
        for (k, start), mass in covered.items():
            t = self.templates[k]
            share = mass / self.mass[k]
            whole = all(start + p >= 0 and tuple(words[start + p : start + p + len(key)]) == key for p, key in t.mandatory)
            if whole and share >= t.share - 1e-9:
                found.append((k, max(0, start), min(1.0, share)))
        return len(words), sorted(found)

    def report(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        n, found = self.scan(text)
        base = [start for k, start, _ in found if self.templates[k].base]
        labels = lambda only: ",".join(sorted({self.templates[k].label for k, _, _ in found if self.templates[k].base or not only}))
        #: The more of a template's mass lies in one place and the longer the template, the surer.
        score = max((share * (1 - 0.5 ** len(self.templates[k].words)) for k, _, share in found), default=0.0)
        return n, len(base), min(base, default=None), max(base, default=None), labels(True), labels(False), score


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of each row's whole text."""

    def make():
        index = Index(templates)
        return lambda ids, texts: [list(c) for c in zip(*map(index.report, texts), strict=True)]

    return mapped(docs.select(id_col, text_col), make, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3(docs: DataFrame) -> DataFrame:
    return scan(docs)
