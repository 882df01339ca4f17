"""Query strings to query plans, on the driver."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from datetime import datetime

from folioscan import schema as S
from folioscan.functions.analysis import tokenize

#: Characters that escape_wildcards() guards.
SPECIAL = set('\\+-!():^[]"{}~*?|&/')


@dataclass(frozen=True)
class Infix:
    """A pattern anywhere within one term; * and ? are wildcards."""

    pattern: str

    @property
    def plain(self) -> bool:
        return not set("*?") & set(self.pattern)


@dataclass(frozen=True)
class Phrase:
    """Terms in order, out of place by one in all."""

    terms: tuple[str, ...]


@dataclass(frozen=True)
class Word:
    """A user's word: it matches a document by its content or by its file name."""

    content: Infix | Phrase
    name: Infix


@dataclass(frozen=True)
class QueryPlan:
    """All words must match. No words match every document, unless the query was blank."""

    words: tuple[Word, ...]
    blank: bool = False


@dataclass(frozen=True)
class SearchOptions:
    max_results: int = S.DEFAULT_RESULTS
    file_types: list[str] = field(default_factory=list)
    date_from: datetime | None = None
    date_to: datetime | None = None
    folder: str | None = None
    skip_highlights: bool = False


def normalize_query(query: str | None) -> str:
    """The query without white space at its ends, wide spaces as spaces."""
    return (query or "").strip().replace("　", " ")


def split_words(query: str) -> list[str]:
    """The words between spaces and wide spaces; tabs stay inside a word."""
    return [w for w in normalize_query(query).replace("　", " ").split(" ") if w][: S.MAX_QUERY_WORDS]


def is_plain_word(word: str) -> bool:
    """Whether a word has only letters, digits and underscores. Characters beyond
    U+FFFF count as symbols."""
    return all(c == "_" or (ord(c) < 0x10000 and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")) for c in word)


def escape_wildcards(text: str) -> str:
    """``text`` with a backslash before each special character."""
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def parse_query(query: str | None, analyser: str = "unicode", lenient: bool = False) -> QueryPlan:
    """The plan of a query. ``lenient`` also lower-cases file-name patterns of words
    with symbols, which otherwise keep their case and so never match capitals."""
    if not query or not query.strip().strip("　"):
        return QueryPlan((), blank=True)
    words = []
    for word in split_words(query):
        plain = is_plain_word(word)
        shown = word.lower() if plain or lenient else word
        terms = [] if plain else tokenize(word, analyser)
        if plain:
            content: Infix | Phrase = Infix(word.lower())
        elif not terms:
            content = Infix(word)
        elif len(terms) == 1 or set("*?") & set(word):
            # a pattern with wildcards is one term; its symbols aren't split off
            content = Infix(terms[0] if len(terms) == 1 else word.lower())
        else:
            content = Phrase(tuple(terms))
        words.append(Word(content, Infix(shown)))
    return QueryPlan(tuple(words))
