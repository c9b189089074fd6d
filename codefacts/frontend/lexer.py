"""Tokens of TypeScript source, one at a time: the parser says what may follow."""

from __future__ import annotations

import re
from typing import NamedTuple

#: The reserved and contextual words of the language.
RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
CONTEXTUAL = frozenset("abstract accessor any as asserts async await bigint boolean constructor declare defer from get global implements infer interface intrinsic is keyof let meta module namespace never number object of out override package private protected public readonly require satisfies set source static string symbol target type undefined unique unknown using yield".split())

WORD = re.compile(r"[^\W\d][\w$‌‍]*|\$[\w$‌‍]*|#[\w$‌‍]+")
NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
SPACE = re.compile(r"(?:\s|﻿|//[^\n]*|/\*.*?\*/)*", re.S)
PUNCTUATION = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)


class Token(NamedTuple):
    kind: str  # word, keyword, number, string, regex, template, punct, private, text, eof
    text: str
    start: int
    end: int
    newline: bool


def token_at(source: str, pos: int, operand: bool) -> Token:
    """The token at or behind a place. operand: an operand may begin there, so that a slash begins a regular expression."""
    start = SPACE.match(source, pos).end()
    newline = "\n" in source[pos:start]
    if start >= len(source):
        return Token("eof", "", len(source), len(source), newline)
    c = source[start]
    make = lambda kind, end: Token(kind, source[start:end], start, end, newline)
    if c.isdigit() or c == "." and source[start + 1 : start + 2].isdigit():
        return make("number", NUMBER.match(source, start).end())
    if m := WORD.match(source, start):
        text = m.group()
        return make("private" if c == "#" else "keyword" if text in RESERVED else "word", m.end())
    if c in "'\"":
        m = STRING.match(source, start)
        return make("string", m.end() if m else (source.find("\n", start) + 1 or len(source)))
    if c == "`":
        return template_at(source, start, newline)
    if c == "/" and operand and (m := REGEX.match(source, start)):
        return make("regex", m.end())
    if m := PUNCTUATION.match(source, start):
        return make("punct", m.end())
    return make("punct", start + 1)


def template_at(source: str, start: int, newline: bool = False) -> Token:
    """A piece of a template, from its backtick or the brace that closes a substitution."""
    end = TEMPLATE.match(source, start + 1).end()
    end += 2 if source.startswith("${", end) else 1
    return Token("template", source[start : min(end, len(source))], start, min(end, len(source)), newline)


def normalised(token: Token) -> str:
    """$ID, $LIT or the text itself."""
    if token.kind in ("number", "string", "regex", "template") or token.kind == "keyword" and token.text in ("true", "false", "null"):
        return "$LIT"
    return "$ID" if token.kind == "word" and token.text not in CONTEXTUAL else token.text
