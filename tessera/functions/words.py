"""Texts as tokens of word classes, and sequences of classes in them.

A lexicon says which words belong to a class.  Everything else is told by its characters, so rules are written over classes instead of patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import SPACES

NUMERALS = "一二三四五六七八九十"


class Token(NamedTuple):
    """A piece of a text: its class, and where it begins and ends."""

    kind: str
    start: int
    end: int


def _letter(c: str) -> bool:
    """A Latin letter, narrow or wide."""
    return "a" <= c <= "z" or "ａ" <= c <= "ｚ"


def _run(s: str, at: int, inside: Callable[[str], bool]) -> int:
    while at < len(s) and inside(s[at]):
        at += 1
    return at


def lexicon(classes: Mapping[str, Sequence[str]]) -> Callable[[str], list[Token]]:
    """A scanner: the longest word at each place in any case, else a number, a run of numerals or letters, or one other character.

    White space only separates.  A word that begins or ends with a letter begins or ends a run of letters.
    """
    known: dict[str, list[tuple[str, str]]] = {}
    for kind, words in classes.items():
        for w in words:
            known.setdefault(w[0].lower(), []).append((w.lower(), kind))
    for words in known.values():
        words.sort(key=lambda x: -len(x[0]))

    def scan(value: str) -> list[Token]:
        low, at, out = value.lower(), 0, []
        if len(low) != len(value):  # a letter whose lower case is longer
            low = value
        while at < len(low):
            c = low[at]
            if c in SPACES:
                at += 1
                continue
            word = next(((w, k) for w, k in known.get(c, ()) if low.startswith(w, at) and not (_letter(w[-1]) and _letter(low[at + len(w) : at + len(w) + 1] or " "))), None)
            if word:
                kind, end = word[1], at + len(word[0])
            elif "0" <= c <= "9":
                kind, end = "number", _run(low, at, lambda x: "0" <= x <= "9")
                if low[end : end + 1] == "." and "0" <= (low[end + 1 : end + 2] or " ") <= "9":
                    end = _run(low, end + 1, lambda x: "0" <= x <= "9")
            elif c in NUMERALS:
                kind, end = "numeral", _run(low, at, lambda x: x in NUMERALS)
            elif _letter(c):
                kind, end = "letters", _run(low, at, _letter)
            else:
                kind, end = "other", at + 1
            out.append(Token(kind, at, end))
            at = end
        return out

    return scan


def match_at(tokens: Sequence[Token], at: int, steps: Sequence[str]) -> int:
    """Where a sequence of classes that begins at a token ends, or -1; 'a|b' is either class, 'a?' may be absent, 'a+' may repeat."""
    for step in steps:
        kinds = step.rstrip("?+").split("|")
        if at < len(tokens) and tokens[at].kind in kinds:
            at += 1
            while step.endswith("+") and at < len(tokens) and tokens[at].kind in kinds:
                at += 1
        elif not step.endswith("?"):
            return -1
    return at


def find(tokens: Sequence[Token], steps: Sequence[str]) -> tuple[int, int] | None:
    """The first place of a sequence of classes: its first token and the one after its last."""
    return next(((i, end) for i in range(len(tokens)) if (end := match_at(tokens, i, steps)) > i), None)


def column(f: Callable, kind: str) -> Callable[..., Column]:
    """A function of texts (of a module, with a cache, as values repeat) as one of Columns."""

    def of(*columns: Column) -> Column:
        @F.pandas_udf(kind)
        def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
            return pd.Series([f(*[None if pd.isna(v) else v for v in row]) for row in zip(first, *rest)], dtype=object)

        return run(*columns)

    return of
