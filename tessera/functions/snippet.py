"""Highlighted excerpts of the texts of hits. Lengths are in bytes of UTF-8, cut at characters."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from tessera.functions.analysis import Analyzer


def collapse(text: str) -> str:
    return " ".join(text.split())


def floor_boundary(data: bytes, at: int) -> int:
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def ceil_boundary(data: bytes, at: int) -> int:
    at = min(at, len(data))
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


@dataclass(frozen=True)
class Highlighter:
    max_chars: int = 200
    before: str = "**"
    after: str = "**"

    def with_max_chars(self, n: int) -> Highlighter:
        return replace(self, max_chars=max(16, n))

    def with_markers(self, before: str, after: str) -> Highlighter:
        return replace(self, before=before, after=after)

    def head(self, text: str) -> str:
        data = text.encode()
        end = ceil_boundary(data, self.max_chars)
        return collapse(data[:end].decode()) + ("…" if end < len(data) else "")

    def window(self, data: bytes, hits: list) -> tuple[int, int]:
        """Begins at the hit from which most distinct terms are within reach, the earliest such; a quarter
        of the room is left before it."""
        most, anchor = 0, hits[0].start
        near: Counter[str] = Counter()
        after = 0  # the first hit out of reach
        for i, hit in enumerate(hits):
            if after <= i:  # a hit wider than the room is out of reach even of itself
                near.clear()
                after = i
            while after < len(hits) and hits[after].end <= hit.start + self.max_chars:
                near[hits[after].term] += 1
                after += 1
            if len(near) > most:
                most, anchor = len(near), hit.start
            near[hit.term] -= 1
            near += Counter()  # drops what is not above 0
        start = floor_boundary(data, max(0, anchor - self.max_chars // 4))
        return start, ceil_boundary(data, start + self.max_chars)

    def snippet(self, text: str, analyzer: Analyzer, terms: set[str] | frozenset[str]) -> tuple[str, int]:
        """(excerpt, highlighted occurrences)."""
        hits = [t for t in analyzer.analyze(text) if t.term in terms]
        if not hits:
            return self.head(text), 0
        data = text.encode()
        start, end = self.window(data, hits)
        out, at, marked = ["…"] if start > 0 else [], start, 0
        body = []
        for h in hits:
            if start <= h.start and h.end <= end:
                body += [data[at : h.start].decode(), self.before, data[h.start : h.end].decode(), self.after]
                at, marked = h.end, marked + 1
        body.append(data[at:end].decode())
        return "".join(out) + collapse("".join(body)) + ("…" if end < len(data) else ""), marked


def snippet_udf(highlighter: Highlighter, analyzer: Analyzer, terms: set[str]):
    wanted = frozenset(terms)

    @F.udf("struct<text:string,matched:int>", useArrow=True)
    def run(text):
        return highlighter.snippet(text or "", analyzer, wanted)

    return run
