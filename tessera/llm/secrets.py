"""Secrets in texts: fixed patterns, and values in credential contexts that would be costly to guess.

The guess cost of a value is the least, over its segmentations, of the product of each span's guesses:
a common word (with capitals and look-alike digits; by its rank in a public vocabulary), a date, a repeat, a keyboard or alphabet walk, or
brute force. It is found by shortest paths over the value's end places. Values behind a word for
a credential that no pattern takes whole, and that cost at least ``MIN_LOG10`` to guess, are added.

Spans are (kind, start, end) in code points, end exclusive. ``assign`` spans cover the whole match.
Nulls and edges: a null or empty text has no spans. Repeated rows are scanned each on its own. Whole
texts are scanned and whole values priced, however long; pricing stops early only once no segmentation
can stay below the threshold. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import releasing

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 8.0
MIN_LENGTH = 8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A word for a credential (after a sign, an underscore or a camel-case edge), some joining words or
#: signs, and a value of any characters but spaces.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key|client[_-]?secret)\b"""
    r"""["']?\s{0,3}(?:(?:is|was)\s{1,3}|[:=]{1,2}>?\s{0,3}(?:bearer\s{1,3})?)["'`]?((?u:\S){8,})""",
    re.I | re.A,
)
_HINT = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential", re.I | re.A)

WORDS = (
    "password pass passwd secret token admin administrator root user guest login welcome letmein master monkey dragon shadow sunshine princess football baseball "
    "superman batman trustno love hello freedom whatever ninja mustang access flower summer winter spring autumn monday tuesday wednesday thursday friday saturday "
    "sunday january february march april june july august september october november december test testing demo example sample changeme default public private "
    "server database mysql postgres oracle redis google apple amazon azure windows linux ubuntu computer internet network system service account manager company "
    "the and for you are with this that have from not null none true false value string token key bearer basic your here insert enter replace foo bar baz qux "
    "red green blue black white orange purple silver golden tiger eagle wolf lion bear horse house money secure security safe login temp john michael david james "
    "robert daniel thomas jennifer jessica maria anna"
).split()


@lru_cache(maxsize=4)
def ranks(path: str = "") -> dict[str, int]:
    """Common words by rank: those of ``WORDS``, then of a byte-level vocabulary's file the tokens that begin a
    word and are letters, in its order, which is that of how often they are met."""
    tokens: list[str] = []
    if path:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        tokens = [t[1:].lower() for t in sorted(vocabulary, key=vocabulary.get) if t[:1] == "\u0120" and len(t) > 3 and t[1:].isascii() and t[1:].isalpha()]
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *tokens]))}


_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_NEXT = {a + b for row in _ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:])}
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d")


def _log(x: float) -> float:
    return math.log10(x)


def _variants(part: str) -> float:
    """Ways to write a word with these capitals and look-alikes."""
    upper = sum(c.isupper() for c in part)
    n = 1.0 if upper == 0 else 2.0 if upper in (1, len(part)) and (part[0].isupper() or upper > 1) else float(math.comb(len(part), min(upper, len(part) - upper)) + 1)
    return n * 2 ** sum(c in "@4301!5$7" for c in part)


@lru_cache(maxsize=1 << 12)
def guess_cost(value: str, enough: float = math.inf, words: str = "") -> float:
    """log10 of the guesses that the cheapest segmentation needs; of a costlier one than ``enough``, a
    lower bound that is at least ``enough``. ``words``: see ``ranks``."""
    n, rank_of = len(value), ranks(words)
    lower = "".join(low if len(low := c.lower()) == 1 else c for c in value)
    plain = lower.translate(_LEET)
    kinds = (str.islower, 26), (str.isupper, 26), (str.isdigit, 10)
    alphabet = sum(size for test, size in kinds if any(map(test, value))) + 33 * any(not any(test(c) for test, _ in kinds) for c in value)
    alone = _log(max(alphabet, 10))
    best, settled, heap = {0: 0.0}, set(), [(0.0, 0)]
    origin: dict[tuple[int, int], int] = {}  # (width, place): where its run of repeats or its walk began

    def begun(width: int, i: int) -> int:
        """The first place of the repeats of this width that i continues; of the walk, for width 0."""
        at, passed = i, []
        while (width, at) not in origin:
            passed.append(at)
            back = at - (width or 1)
            if back < 0 or (value[back:at] != value[at : at + width] if width else lower[back : at + 1] not in _NEXT):
                break
            at = back
        first = origin.get((width, at), at)
        origin.update(((width, k), first) for k in passed)
        return first

    def dominated(width: int, i: int, least: int) -> bool:
        """Whether a span from where the run began to any end costs no more than one from i."""
        r = begun(width, i)
        return r < i and r in settled and best[r] + _log((i - r + least) / least) <= best[i]

    while heap:
        cost, i = heapq.heappop(heap)
        if i in settled:
            continue
        # whatever is still to come goes through a place that costs as much
        if i == n or cost >= enough:
            return cost
        settled.add(i)
        # a boundary between spans is itself to be guessed
        joint = 0.3 if i else 0.0

        def reach(j: int, more: float) -> None:
            if cost + more < best.get(j, math.inf):
                best[j] = cost + more
                heapq.heappush(heap, (best[j], j))

        reach(i + 1, alone)
        for j in range(i + 3, min(n, i + 14) + 1):
            for text in {lower[i:j], plain[i:j]}:
                if rank := rank_of.get(text):
                    reach(j, joint + _log(rank * _variants(value[i:j]) + 1))
        if m := _DATE.match(value, i):
            reach(m.end(), joint + _log(365.0 * 120 * (4 if m.group(1) or m.group(2) else 1) if m.end() - i > 4 else 120))
        if lower[i : i + 2] in _NEXT and not dominated(0, i, 3):
            j = i + 1
            while j < n and lower[j - 1 : j + 1] in _NEXT:
                j += 1
                if j - i >= 3:
                    reach(j, joint + _log(40.0 * (j - i)))
        for width in (1, 2, 3, 4):
            j = i + width
            # a part that itself repeats a shorter one is cheaper as repeats of that
            if value[i:j] != value[j : j + width] or value[i] * width == value[i:j] and width > 1 or width == 4 and value[i : i + 2] == value[i + 2 : j] or dominated(width, i, max(3, 2 * width)):
                continue
            while value[i : i + width] == value[j : j + width] and j + width <= n:
                j += width
                if j - i >= 3:
                    reach(j, joint + alone * width + _log((j - i) / width))
    return 0.0


_TRIM = "\"'`,;)]}>."


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, taken: list[tuple[int, int, int]], least: float = MIN_LOG10, words: str = "") -> list[tuple[int, int, int]]:
    """Values in credential contexts, not within one of the spans taken (in order), that are costly to guess."""
    out = []
    begins, ends = [x for x, _, _ in taken], list(accumulate((y for *_, y in taken), max))
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(_TRIM)
        a, b = m.start(1), m.start(1) + len(value)
        before = bisect_right(begins, a)
        if len(value) < MIN_LENGTH or before and b <= ends[before - 1]:
            continue
        # plain words are prose that follows the context word, not a value
        if value.isalpha() and (value == value.lower() or value.istitle()):
            continue
        if guess_cost(value, least, words) >= least:
            out.append((a, 3, b))
    return out


def find(text: str | None, least: float = MIN_LOG10, words: str = "") -> tuple[list, list]:
    """Base spans and all spans, each by start, then kind."""
    if not text or not (_HINT.search(text) or "AKIA" in text or HEX.search(text)):
        return [], []
    base = base_spans(text)
    return base, sorted(base + guessed_spans(text, base, least, words))


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(least: float, words: str):
    def run(batches):
        for batch in batches:
            keys, cols = batch.column(0), ([], [], [], [], [])
            for text in batch.column(1).to_pylist():
                base, every = find(text, least, words)
                for k in range(3):
                    cols[k].append(sum(x[1] == k for x in base))
                cols[3].append(hashlib.sha256(render(base).encode()).hexdigest())
                cols[4].append(render(every))
            longs = [pa.array(c, pa.int64()) for c in cols[:3]]
            yield pa.RecordBatch.from_arrays([keys, *longs, pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = MIN_LOG10, words: str = "") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans; a row a document."""
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(releasing(_scan(least, words), guess_cost.cache_clear), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out.append(text[at:a] + f"[{KINDS[k]}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", least: float = MIN_LOG10, words: str = "") -> DataFrame:
    """``docs`` with every span masked; a column ``n_chars`` follows the text. All rows stay."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            old = batch.column(at).to_pylist()
            new = [mask(t, s) if t and (s := find(t, least, words)[1]) else t for t in old]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                sizes = [size if a is b or a == b else len(b) for a, b, size in zip(old, new, batch.column(n).to_pylist())]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(sizes, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(releasing(run, guess_cost.cache_clear), docs.schema)
