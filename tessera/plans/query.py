"""The query language: words, "phrases", + for must and - for must not."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from tessera.functions.analysis import Analyzer


class QueryError(ValueError):
    pass


class Occur(Enum):
    SHOULD = "should"
    MUST = "must"
    MUST_NOT = "must_not"


@dataclass(frozen=True)
class Clause:
    """``terms``: (term, offset from the first); one of them is a plain term."""

    occur: Occur
    terms: tuple[tuple[str, int], ...]

    @property
    def is_phrase(self) -> bool:
        return len(self.terms) > 1


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...]

    def positive_terms(self) -> list[str]:
        return [t for c in self.clauses if c.occur is not Occur.MUST_NOT for t, _ in c.terms]

    @property
    def is_prunable(self) -> bool:
        return all(c.occur is Occur.SHOULD and not c.is_phrase for c in self.clauses)

    @property
    def has_phrase(self) -> bool:
        return any(c.is_phrase for c in self.clauses)


def split_fragments(text: str) -> list[tuple[Occur, str, bool]]:
    """(occur, text, quoted). One sign may stand before a fragment; a quote counts only at its start."""
    out, i = [], 0
    signs = {"+": Occur.MUST, "-": Occur.MUST_NOT}
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        occur = Occur.SHOULD
        if text[i] in signs:
            occur = signs[text[i]]
            i += 1
        if i < len(text) and text[i] == '"':
            close = text.find('"', i + 1)
            if close < 0:
                raise QueryError("unterminated quote")
            out.append((occur, text[i + 1 : close], True))
            i = close + 1
            continue
        j = i
        while j < len(text) and not text[j].isspace():
            j += 1
        if j > i:
            out.append((occur, text[i:j], False))
        i = j
    return out


def parse(text: str, analyzer: Analyzer) -> Query:
    """Fragments without a term are dropped; a bare fragment keeps its first term only."""
    clauses = []
    for occur, fragment, quoted in split_fragments(text):
        tokens = analyzer.analyze(fragment)
        if not tokens:
            continue
        if not quoted:
            tokens = tokens[:1]
        first = tokens[0].position
        clauses.append(Clause(occur, tuple((t.term, t.position - first) for t in tokens)))
    if not clauses:
        raise QueryError("no searchable term")
    if all(c.occur is Occur.MUST_NOT for c in clauses):
        raise QueryError("a query of exclusions alone matches nothing")
    return Query(tuple(clauses))
