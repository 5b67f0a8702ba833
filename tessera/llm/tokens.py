"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memory of encoded pieces.

Both vocabularies treat the text from a space to the next one apart from its neighbours, where no white space
follows the space: there, texts are cut into chunks. In a chunk of plain Latin words, punctuation and single line
ends, either vocabulary's pattern takes runs of letters and runs of signs as pre-tokens, so these are its pieces, and
go to the library's own BPE model; any other chunk is one piece, and goes through the library whole. The texts of a
few megabytes are cut at once, as bytes in numpy, and each distinct piece among them is looked up once. The memory
holds two generations of pieces and drops the older.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa

GENERATION = 400_000
LONGEST = 64
#: Bytes of texts that are cut at once.
GROUP = 4 << 20
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r'.,;:!?()|"#*$%&>@/+=_\[\]{}~^`\\\-'
#: Such a piece is one pre-token under either vocabulary's pattern.
_PIECE = re.compile(rf" ?[{_LETTERS}]+| ?[{_MARKS}]+")
_LETTER, _MARK, _LINE, _SPACE, _ODD = 1, 2, 3, 4, 0


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By byte of UTF-8: its class (of the letters beyond ASCII, the first byte is C3; a later byte of another
    character follows an odd one), and whether a character that begins with it is surely not white space."""
    kind, dark = np.full(256, _ODD, np.uint8), np.zeros(256, bool)
    for b in range(128):
        kind[b] = _LETTER if re.fullmatch(f"[{_LETTERS}]", chr(b)) else _MARK if re.fullmatch(f"[{_MARKS}]", chr(b)) else _ODD
    kind[0x80:0xC0] = kind[0xC3] = _LETTER
    kind[10], kind[32] = _LINE, _SPACE
    dark[33:127] = dark[0xC3:0xE1] = dark[0xE4:0xF5] = True
    return kind, dark


_KIND, _DARK = _tables()
_CUT = re.compile(b" (?=[" + b"".join(b"\\x%02x" % b for b in np.flatnonzero(_DARK)) + b"])")


def _parts(raw: bytes) -> list[bytes]:
    """A text of over two groups, cut where chunks begin."""
    at = [0]
    while len(raw) - at[-1] > 2 * GROUP and (cut := _CUT.search(raw, at[-1] + GROUP)):
        at.append(cut.start())
    return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]


class ChunkTokenizer:
    """``lead``: a piece's own leading space takes part in its ids (byte-level vocabularies). Without, letters are
    lower-cased."""

    def __init__(self, path: str, lead: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.lead = Tokenizer.from_file(path), lead
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def forget(self) -> None:
        """Empties the memory of pieces."""
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, piece: bytes) -> bytes:
        """The ids of a piece that the memory doesn't hold."""
        text = piece.decode()
        if not _PIECE.fullmatch(text):
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return array(self.width.char, ids).tobytes()
        if text.isascii():
            shown = text.replace(" ", self.alphabet[32])
        else:
            shown = piece.decode("latin-1").translate(self.alphabet)
        return array(self.width.char, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _cut(self, raw: bytes, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of texts that stand one after the other and begin at ``first`` (none is empty), and the number of
        each text's first piece."""
        b = np.frombuffer(raw, np.uint8)
        after = np.empty_like(b)
        after[:-1], after[first[1:] - 1], after[-1] = b[1:], 32, 32
        kind = _KIND[b]
        space = kind == _SPACE
        cut = space & _DARK[after]
        odd = (kind == _ODD) | (space & ~cut) | ((b == 10) & (after == 10)) | ((b == 0xC3) & ((after == 0x97) | (after == 0xB7)))
        begins = cut.copy()  # of chunks
        begins[first] = True
        chunks = np.flatnonzero(begins)
        strange = np.zeros(len(chunks), bool)
        strange[np.searchsorted(chunks, np.flatnonzero(odd), "right") - 1] = True
        edge = begins
        edge[1:] |= (kind[1:] != kind[:-1]) & ~space[:-1]
        starts = np.flatnonzero(edge)
        if strange.any():  # one piece each
            of = np.searchsorted(chunks, starts, "right") - 1
            starts = starts[~strange[of] | (chunks[of] == starts)]
        heads = np.searchsorted(starts, first)
        if not self.lead:
            upper = np.flatnonzero(((b >= 65) & (b <= 90)) | ((b >= 0x80) & (b <= 0x9E)))
            upper = upper[~strange[np.searchsorted(chunks, upper, "right") - 1]]
            b = b.copy()
            b[upper] += 32
            starts = starts - np.searchsorted(np.flatnonzero(cut), starts)
            b = b[~cut]
        at = np.append(starts, len(b)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(b)]), heads

    def _group(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) for t in texts])
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        if not len(first):
            return [b""] * len(texts)
        pieces, heads = self._cut(b"".join(texts), first)
        coded = pieces.dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.young.get, distinct)]
        for i in [i for i, ids in enumerate(found) if ids is None]:
            p = distinct[i]
            ids = self.old.get(p)
            found[i] = ids = self.learn(p) if ids is None else ids
            if len(p) <= LONGEST:
                self.young[p] = ids
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        # each piece's ids in the place of the piece
        n = np.array([len(x) for x in found]) // self.width.itemsize
        take = n[which]
        ends = np.cumsum(take)
        ids = np.frombuffer(b"".join(found), self.width)
        ids = ids[np.repeat((np.cumsum(n) - n)[which] - ends + take, take) + np.arange(ends[-1])]
        raw, ends = ids.tobytes(), np.append((ends - take)[heads], len(ids)) * self.width.itemsize
        full = iter([raw[lo:hi] for lo, hi in zip(ends.tolist(), ends[1:].tolist())])
        return [next(full) if t else b"" for t in texts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none), packed little-endian in ``self.width``."""
        out, group, held, parts = [], [], 0, []
        for t in texts:
            own = _parts((t or "").encode())
            parts.append(len(own))
            for p in own:
                group.append(p)
                held += len(p)
                if held >= GROUP:
                    out += self._group(group)
                    group, held = [], 0
        left = iter(out + self._group(group))
        return [b"".join(islice(left, n)) for n in parts]


@lru_cache(maxsize=4)
def tokenizer(path: str, lead: bool) -> ChunkTokenizer:
    """One a Python worker; tasks end with ``forget``, which costs the next one little."""
    return ChunkTokenizer(path, lead)


def forgetting(path: str, lead: bool) -> Callable[[], None]:
    """What ends a task that used the tokenizer."""
    return lambda: tokenizer(path, lead).forget()
