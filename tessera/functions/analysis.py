"""Text analysis: words, accents, stopwords, suffixes.

A word is a maximal run of alphabetic or numeric characters of the raw text. It is decomposed, loses its
combining marks and is lower-cased character by character; stopwords and short words are dropped, and
what is left loses at most two suffixes. Positions count every raw word, offsets are UTF-8 bytes.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")
#: The same where all characters are below U+0300, faster.
_NEAR, _FAR = re.compile(r"[^\W_]+"), re.compile("[\u0300-\U0010ffff]")
#: The same for Spark's regular expressions.
WORD_PATTERN = r"[\p{IsAlphabetic}\p{N}]+"

#: suffix>replacement/characters that must remain; first match wins.
_RULES = (
    "oes>ao/3 aes>ao/3 ais>al/3 eis>el/3 ois>ol/3 ns>m/3 mente>/4 amento>/4 imento>/4 idade>/4 ancia>/4 encia>/4 avel>/4 ivel>/4 ista>/4 ismo>/4 "
    "acao>/4 icao>/4 ador>/4 adora>/4 ational>ate/4 iveness>ive/4 fulness>ful/4 tional>tion/4 ization>ize/4 ness>/4 ing>/4 edly>/4 ies>y/4 ed>/4 ly>/4 es>/4 s>/4"
)


def _rule(text: str) -> tuple[str, str, int]:
    ending, rest = text.split(">")
    put, least = rest.split("/")
    return ending, put, int(least)


SUFFIX_RULES = tuple(_rule(r) for r in _RULES.split())
#: The rules that a word can meet, by its last letter, in the same order.
_BY_LAST = {c: tuple(r for r in SUFFIX_RULES if r[0][-1] == c) for c in {r[0][-1] for r in SUFFIX_RULES}}

STOPWORDS = frozenset(
    "a an and ao aos aquela aquele aquilo are as at ate be been being but by com como cuja cujo da das de do dos e em entre era essa esse esta estar este foi for from ha he her "
    "his i if in is isso isto it its mas me my na nas no nos not o of on onde or os ou our para pela pelo por quais qual quando que quem sao se sem ser seu seus she sob sobre sua "
    "suas tem that the their them these they this those to um uma umas uns was we were with without you your".split()
)

TOKEN = T.StructType([T.StructField("term", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def is_combining_mark(c: str) -> bool:
    return "̀" <= c <= "ͯ" or "᪰" <= c <= "᫿" or "⃐" <= c <= "⃿"


def normalize(word: str) -> str:
    if word.isascii():
        return word.lower()
    return "".join(c.lower() for c in unicodedata.normalize("NFD", word) if not is_combining_mark(c))


def strip_suffix(word: str) -> str:
    for ending, put, least in _BY_LAST.get(word[-1:], ()):
        if word.endswith(ending) and len(word) - len(ending) >= least:
            return word[: len(word) - len(ending)] + put
    return word


def stem(word: str) -> str:
    return strip_suffix(strip_suffix(word))


def split(text: str) -> list[str]:
    """The raw words of a text."""
    return (WORD if _FAR.search(text) else _NEAR).findall(text)


@dataclass(frozen=True)
class Token:
    term: str
    position: int
    start: int
    end: int


@dataclass(frozen=True)
class Analyzer:
    stopwords: frozenset[str] = STOPWORDS
    min_token_len: int = 2
    stemming: bool = True

    @classmethod
    def raw(cls) -> Analyzer:
        return cls(frozenset(), 1, False)

    def with_stopwords(self, words: Iterable[str]) -> Analyzer:
        return replace(self, stopwords=frozenset(normalize(w) for w in words))

    def with_stemming(self, on: bool) -> Analyzer:
        return replace(self, stemming=on)

    def with_min_token_len(self, n: int) -> Analyzer:
        return replace(self, min_token_len=n)

    def term(self, word: str) -> str | None:
        """The term of a raw word, or None where it is dropped."""
        w = normalize(word)
        if len(w) < self.min_token_len or w in self.stopwords:
            return None
        return stem(w) if self.stemming else w

    def analyze(self, text: str) -> list[Token]:
        term = remembered(self)
        out, at, seen = [], 0, 0
        plain = text.isascii()
        for position, m in enumerate(WORD.finditer(text)):
            t = term(m.group())
            if t is not None:
                start = m.start() if plain else at + len(text[seen : m.start()].encode())
                end = m.end() if plain else start + len(m.group().encode())
                if not plain:
                    at, seen = end, m.end()
                out.append(Token(t, position, start, end))
        return out

    def terms(self, text: str) -> list[str]:
        return [t.term for t in self.analyze(text)]

    def positions(self, text: str) -> dict[str, list[int]]:
        """Ascending positions by term."""
        term, out = remembered(self), {}
        for position, word in enumerate(split(text)):
            t = term(word)
            if t is not None:
                out.setdefault(t, []).append(position)
        return out

    def to_json(self) -> str:
        return json.dumps({"stopwords": sorted(self.stopwords), "min_token_len": self.min_token_len, "stemming": self.stemming})

    @classmethod
    def from_json(cls, text: str) -> Analyzer:
        d = json.loads(text)
        return cls(frozenset(d["stopwords"]), d["min_token_len"], d["stemming"])


@lru_cache(maxsize=8)
def remembered(analyzer: Analyzer):
    """``analyzer.term`` with a bounded memory, one a process."""
    return lru_cache(maxsize=1 << 19)(analyzer.term)


def analyze_udf(analyzer: Analyzer):
    """Arrow UDF: text to an array of tokens."""

    @F.udf(T.ArrayType(TOKEN), useArrow=True)
    def run(text):
        return [(t.term, t.position, t.start, t.end) for t in analyzer.analyze(text or "")]

    return run


def words(text: Column) -> Column:
    """Raw words, by built-in expressions."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), 0)


#: Lists of words that are normalized at a time; what they take in Python is all that a task holds there, but for its batch.
SLICE = 256


def normalize_arrow(words: pa.Array) -> pa.Array:
    """``normalize`` of each word of an Arrow array; only distinct words that are not ASCII become Python's."""
    lower, far = pc.ascii_lower(words), pc.invert(pc.string_is_ascii(words))
    if not pc.any(far).as_py():
        return lower
    coded = words.filter(far).dictionary_encode()
    done = pa.array([normalize(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    return pc.replace_with_mask(lower, far.fill_null(False), done)


def normalize_lists(lists: pa.Array) -> pa.Array:
    """The same for an array of lists of words, ``SLICE`` lists at a time."""
    done = []
    for lo in range(0, len(lists), SLICE):
        part = lists.slice(lo, SLICE)
        ends = np.cumsum(np.append(0, pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)))
        done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), normalize_arrow(part.flatten())))
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))


def normalize_udf():
    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return normalize_lists(lists)

    return run


def normalize_word_udf():
    @F.arrow_udf("string")
    def run(words: pa.Array) -> pa.Array:
        return normalize_arrow(words)

    return run


def strip_suffix_expr(word: Column) -> Column:
    """One pass of the suffix rules as an expression; nest through ``transform`` to apply it twice."""
    out = None
    for ending, put, least in SUFFIX_RULES:
        hit = word.endswith(ending) & (F.length(word) >= len(ending) + least)
        cut = F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(put))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(word)


def stem_all(array: Column) -> Column:
    """Both passes over an array of words."""
    once = lambda a: F.transform(a, strip_suffix_expr)
    return once(once(array))


def keep_words(array: Column, analyzer: Analyzer) -> Column:
    """The stopword and length filters over an array of normalized words."""
    return F.filter(array, lambda w: (F.length(w) >= analyzer.min_token_len) & ~w.isin(sorted(analyzer.stopwords)))


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")
