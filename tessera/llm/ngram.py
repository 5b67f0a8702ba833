"""A trigram language model in a memory-mapped Elias-Fano trie, and the scores of texts under it.

Words are counted over all training texts, then pairs of words, then words after pairs, all in the shared
folder's shards. The first level is the vocabulary: 64-bit word hashes in order and running counts, each
an Elias-Fano sequence; a word's id is its rank. The second holds each word's successors, the third each
pair's: pointers are an Elias-Fano sequence, and so are the successors' ids, each context's made to go on
from the last of the context before it. An n-gram is found by its context's pointers and a successor search
relative to the context's base; a pair's place in its shard is its id as a context of the third level.

Probabilities are smoothed (Dirichlet priors: ``MU`` words on the unigram model, ``NU`` on the bigram
model) and quantised to 256 levels a shard: of a pair its probability and the weight of the bigram model
after it, of a triple its share of what follows its pair. Scores add the two up.

A text is its lower-cased (A-Z) words and an end, which also stands before the first word; the first word
has no more context than that. The unigram model discounts every count by ``d``; what that frees is the
probability of unknown words as one class. Shards of pairs are cut by probability mass, so a frequent
context is spread over several; triples lie in the shard of their context.

Nulls and edges: a null or empty text is its end alone. Repeated rows count, and are scored, each on its
own. A null id is scored with its text. Without training texts every token is unknown, with probability
1. An empty table gives no rows. Other columns are not looked at. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import mmap
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes
from tessera.llm.eliasfano import EliasFano
from tessera.llm.shared import cut, releasing, shared_path

#: Chosen on a tenth of the training rows of sf0.1, left out of training for that.
MU = 1000.0
NU = 10.0
#: Pairs and words held before they are handed on.
HELD = 4_000_000
SHARD = 3_000_000
END = np.uint64(0xE4D0E4D0E4D0E4D1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are looked at together: each look goes through every shard, of which a large corpus has many.
_SLICE = 8 << 20


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's word hashes and its end; and where texts begin (one more than texts)."""
    data, at = textbytes.spaced(column)
    data = _LOWER[data]
    starts, ends, first = textbytes.words(data, at)
    h = textbytes.hashes(data, starts, ends)
    docs = len(at) - 1
    begin = first + np.arange(docs + 1)
    out = np.full(len(h) + docs, END)
    out[np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(first))] = h
    return out, begin


def _slices(batches, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        nth = np.cumsum(sizes) // _SLICE
        edges = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo < hi:
                part = batch.slice(lo, hi - lo)
                yield part, *token_hashes(part.column(column))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray], shards: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Keys in order and their counts; with shards, by shard and key, and the shards."""
    k, c = np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(counts or [np.zeros(0, np.int64)])
    s = np.concatenate(shards or [np.zeros(0, np.int64)]) if shards is not None else np.zeros(len(k), np.int64)
    order = np.argsort(k) if shards is None else _by_shard(s, k)
    k, c, s = k[order], c[order], s[order]
    first = np.nonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))[0] if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c, s[first]


def _by_shard(shard: np.ndarray, key: np.ndarray) -> np.ndarray:
    width = max(1, int(key.max()).bit_length()) if len(key) else 1
    if not len(key) or width + int(shard.max()).bit_length() > 64:
        return np.lexsort((key, shard))
    return np.argsort(shard.astype(np.uint64) << np.uint64(width) | key if width < 64 else key)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte-plane by byte-plane, compressed."""
    planes = lambda x, w: np.ascontiguousarray(x.view(np.uint8).reshape(-1, w).T).tobytes()
    steps = np.diff(keys, prepend=np.uint64(0))
    return struct.pack("<Q", len(keys)) + zstandard.ZstdCompressor(level=1).compress(planes(steps, 8) + planes(counts.astype(np.uint32), 4))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<Q", blob)[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=max(1, 12 * n)), np.uint8)
    back = lambda x, w, kind: np.ascontiguousarray(x.reshape(w, -1).T).view(kind).ravel()
    return np.cumsum(back(raw[: 8 * n], 8, np.uint64), dtype=np.uint64), back(raw[8 * n :], 4, np.uint32).astype(np.int64)


def _parcels(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """A row a shard; ``shard`` never falls."""
    edge = np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)]]) if len(shard) else np.zeros(1, int)
    spans = list(zip(edge, edge[1:]))
    return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in spans], pa.int32()), pa.array([pack(keys[a:b], counts[a:b]) for a, b in spans], pa.binary())], ["shard", "parcel"])


def _counted(batches, keys_of, shard_of=None):
    """Parcels of the keys that ``keys_of`` makes of each slice; it names their shards where ``shard_of``, a
    function of the key that never falls, doesn't."""
    keys, counts, shards, held = [], [], [], 0

    def parcels():
        k, c, s = _merge(keys, counts, None if shard_of else shards)
        return _parcels(k, c, shard_of(k) if shard_of else s)

    for _, h, begin in _slices(batches):
        if shard_of:
            k, c = np.unique(keys_of(h, begin), return_counts=True)
        else:
            k, s = keys_of(h, begin)
            k, c, s = _merge([k], [np.ones(len(k), np.int64)], [s])
            shards.append(s)
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held >= HELD:
            yield parcels()
            keys, counts, shards, held = [], [], [], 0
    if keys:
        yield parcels()


def _gathered(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, keys and counts of a partition's parcels."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for shard, parcel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(shard, []).append(parcel)
    for shard in sorted(held):
        got = [unpack(x) for x in held.pop(shard)]
        yield shard, *_merge([k for k, _ in got], [c for _, c in got])[:2]


def _save(path: str, *arrays: np.ndarray) -> None:
    """Arrays one after another behind their kinds and sizes, each on 8 bytes; renamed when whole."""
    scratch = f"{path}.{uuid.uuid4().hex}"
    with open(scratch, "wb") as f:
        f.write(struct.pack("<Q", len(arrays)))
        for x in arrays:
            f.write(struct.pack("<8sQ", x.dtype.str.encode(), len(x)))
        for x in arrays:
            raw = np.ascontiguousarray(x).tobytes()
            f.write(raw + bytes(-len(raw) % 8))
    os.replace(scratch, path)


def _load(path: str) -> list[np.ndarray]:
    with open(path, "rb") as f:  # mapped without an open file each, as plain arrays: memmap's own indexing is slow
        raw = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    at, out = 8 + 16 * n, []
    for i in range(n):
        kind, size = struct.unpack("<8sQ", raw[8 + 16 * i : 24 + 16 * i].tobytes())
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        out.append(raw[at : at + size * dtype.itemsize].view(dtype))
        at += size * dtype.itemsize + -size * dtype.itemsize % 8
    return out


class _Shards:
    """Shards that are mapped when first asked for and let go with their owner: a task unpickles its own."""

    def __init__(self):
        self.mapped = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mapped": {}}

    def _mapped(self, folder: str, name: str, shard: int, of):
        if (key := (name, shard)) not in self.mapped:
            path = os.path.join(folder, f"{name}-{shard:08d}")
            self.mapped[key] = of(_load(path)) if os.path.exists(path) else None
        return self.mapped[key]


class Vocabulary(_Shards):
    """The first level. ``bits``: a shard is the upper bits of the hash; ``width``: bits of an id."""

    def __init__(self, folder: str, bits: int, sizes: np.ndarray, masses: np.ndarray, shards: int, discount: float):
        super().__init__()
        self.folder, self.bits, self.shards = folder, bits, shards
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.mass = np.concatenate([[0], np.cumsum(masses)]).astype(np.int64)
        self.v, self.n, self.discount = int(self.first[-1]), int(self.mass[-1]), discount
        self.width = max(1, self.v.bit_length())

    @staticmethod
    def arrays(words: np.ndarray, counts: np.ndarray, base: int) -> list[np.ndarray]:
        w, run = EliasFano.of(words - np.uint64(base)), EliasFano.of(np.concatenate([[0], np.cumsum(counts)]))
        return [np.array([w.n, w.bits, run.n, run.bits], np.int64), *w.arrays(), *run.arrays()]

    @staticmethod
    def _sequences(arrays: list[np.ndarray]) -> tuple[EliasFano, EliasFano]:
        head, *rest = arrays
        n, bits, run_n, run_bits = (int(x) for x in head)
        return EliasFano(n, bits, *rest[:4]), EliasFano(run_n, run_bits, *rest[4:])

    def shard(self, i: int) -> tuple[EliasFano, EliasFano] | None:
        """Hashes, less the shard's first, and running counts."""
        return self._mapped(self.folder, "words", i, self._sequences)

    def base(self, i: int) -> int:
        return i << (64 - self.bits) if self.bits else 0

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted hashes: id (or -1), count and the counts of all words before."""
        ids, count, before = np.full(len(h), -1), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for a, b in _spans(shard):
            i = int(shard[a])
            if (got := self.shard(i)) is None:
                continue
            words, run = got
            x = h[a:b] - np.uint64(self.base(i))
            at = words.find_equal(x)
            there = np.flatnonzero(at >= 0)
            at, to = at[there], a + there
            low, high = run.access(at).astype(np.int64), run.access(at + 1).astype(np.int64)
            ids[to], count[to], before[to] = self.first[i] + at, high - low, self.mass[i] + low
        return ids, count, before

    def of_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts of all words before, count) of sorted ids."""
        before, count = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.first, ids, "right") - 1
        for a, b in _spans(shard):
            i = int(shard[a])
            run, at = self.shard(i)[1], ids[a:b] - self.first[i]
            low = run.access(at).astype(np.int64)
            before[a:b], count[a:b] = self.mass[i] + low, run.access(at + 1).astype(np.int64) - low
        return before, count

    def place(self, before: np.ndarray, count: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """The shard of a pair: where it lies in the mass of all pairs, in order."""
        at = (before + count * (follower / max(self.v, 1))) / max(self.n, 1)
        return np.minimum((at * self.shards).astype(np.int64), self.shards - 1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """log10 of the probability of a word with this count; 0: of all unknown words."""
        unknown = self.discount * self.v / self.n if self.n else 1.0
        return np.log10(np.where(count > 0, (count - self.discount) / max(self.n, 1), max(unknown, 1e-12)))


def _spans(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Where each value stands."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1, [len(sorted_)]]) if len(sorted_) else np.zeros(1, int)
    return [(int(a), int(b)) for a, b in zip(edge, edge[1:])]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values in order, a place of each, and which of them stands at each place."""
    order = np.argsort(x)
    x = x[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[new], order[new], back


def _tokens(vocabulary: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unique, _, back = _distinct(h)
    return tuple(x[back] for x in vocabulary.look(unique))


def _previous(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each token's predecessor; before a text's first token stands its end."""
    out = np.roll(x, 1)
    out[begin[:-1]] = x[begin[1:] - 1]
    return out


def _pair_keys(vocabulary: Vocabulary):
    def run(h, begin):
        ids = _tokens(vocabulary, h)[0].astype(np.uint64)
        return _previous(ids, begin) << np.uint64(32) | ids

    def shard(keys):
        heads = (keys >> np.uint64(32)).astype(np.int64)
        unique, back = np.unique(heads, return_inverse=True)
        before, count = vocabulary.of_ids(unique)
        return vocabulary.place(before[back], count[back], (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))

    return run, shard


def _write_words(folder: str, bits: int):
    def run(batches):
        for shard, words, counts in _gathered(batches):
            _save(os.path.join(folder, f"words-{shard:08d}"), *Vocabulary.arrays(words, counts, shard << (64 - bits) if bits else 0))
            sums = [shard, len(words), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in sums], ["shard", "size", "mass", "ones", "twos"])

    return run


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 256 even steps, and the mean of the values at each."""
    low, wide = float(x.min()), max(float(np.ptp(x)), 1e-9)
    code = np.minimum((x - low) * (256 / wide), 255).astype(np.int64)
    book = np.bincount(code, x, 256) / np.maximum(np.bincount(code, minlength=256), 1)
    return code.astype(np.uint8), book.astype(np.float32)


class Successors:
    """A shard of the second or third level; ``values``: the quantised logs of each n-gram."""

    def __init__(self, arrays: list[np.ndarray]):
        head, *rest = arrays
        self.first, ptr_n, ptr_bits, succ_n, succ_bits = (int(x) for x in head)
        self.pointers = EliasFano(ptr_n, ptr_bits, *rest[:4])
        self.ids = EliasFano(succ_n, succ_bits, *rest[4:8])
        self.values = list(zip(rest[8::2], rest[9::2]))

    @staticmethod
    def arrays(heads: np.ndarray, tails: np.ndarray, *logs: np.ndarray) -> list[np.ndarray]:
        """Of n-grams sorted by context and successor."""
        first = int(heads[0])
        pointer = np.searchsorted(heads, np.arange(first, int(heads[-1]) + 2))
        last = pointer[1:][np.diff(pointer) > 0] - 1
        step = np.zeros(len(heads), np.int64)
        step[last[:-1] + 1] = tails[last[:-1]] + 1  # each context goes on from the last of the one before
        ids = np.cumsum(step) + tails
        p, s = EliasFano.of(pointer), EliasFano.of(ids)
        return [np.array([first, p.n, p.bits, s.n, s.bits], np.int64), *p.arrays(), *s.arrays(), *[x for log in logs for x in quantised(log)]]

    def value(self, k: int, at: np.ndarray) -> np.ndarray:
        codes, book = self.values[k]
        return book[codes[at]]

    def look(self, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Places of sorted (context, successor) pairs; -1 where one was not seen."""
        out = np.full(len(heads), -1)
        new = np.diff(heads, prepend=-1) != 0
        unique, back = heads[new] - self.first, np.cumsum(new) - 1
        inside = (unique >= 0) & (unique < self.pointers.n - 1)
        c = np.where(inside, unique, 0)
        lo, hi = self.pointers.access(c).astype(np.int64), self.pointers.access(c + 1).astype(np.int64)
        # the base is where the sequence stood before the context, and one more
        base = np.where(lo > 0, self.ids.access(np.maximum(lo - 1, 0)).astype(np.int64) + 1, 0)
        some = (inside & (lo < hi))[back]
        lo, hi, base = lo[back], hi[back], base[back]
        target = (base + tails)[some]
        at = self.ids.find_equal(target)
        valid = (at >= lo[some]) & (at < hi[some])
        out[some] = np.where(valid, at, -1)
        return out


def _write_pairs(vocabulary: Vocabulary, folder: str, mu: float, nu: float):
    def run(batches):
        for shard, keys, counts in _gathered(batches):
            heads, tails = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            unique, back = np.unique(heads, return_inverse=True)
            context = vocabulary.of_ids(unique)[1][back]
            other, there = np.unique(tails, return_inverse=True)
            alone = 10 ** vocabulary.unigram(vocabulary.of_ids(other)[1])[there]
            logs = np.log10((counts + mu * alone) / (context + mu))
            _save(os.path.join(folder, f"pairs-{shard:08d}"), *Successors.arrays(heads, tails, logs, np.log10(nu / (counts + nu))))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(keys)], pa.int64())], ["shard", "size"])

    return run


def _write_triples(vocabulary: Vocabulary, folder: str, nu: float):
    def run(batches):
        for shard, keys, counts in _gathered(batches):
            heads = (keys >> np.uint64(vocabulary.width)).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(heads)) + 1])
            context = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(heads))))
            tails = (keys & np.uint64((1 << vocabulary.width) - 1)).astype(np.int64)
            _save(os.path.join(folder, f"triples-{shard:08d}"), *Successors.arrays(heads, tails, np.log10(counts / (context + nu))))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(keys)], pa.int64())], ["shard", "size"])

    return run


class Model(_Shards):
    def __init__(self, vocabulary: Vocabulary, folder: str, mu: float):
        super().__init__()
        self.vocabulary, self.folder, self.mu = vocabulary, folder, mu

    def level(self, name: str, shard: int) -> Successors | None:
        return self._mapped(self.folder, name, shard, Successors)

    def pairs(self, ids: np.ndarray, count: np.ndarray, before: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each token after its predecessor: shard, place there (-1: not seen), log10 of its probability and of
        the bigram model's weight after the pair."""
        head, context, mass = (_previous(x, begin) for x in (ids, count, before))
        shard, place, log, weight = np.zeros(len(ids), np.int64), np.full(len(ids), -1), np.zeros(len(ids)), np.zeros(len(ids))
        both = np.nonzero((ids >= 0) & (head >= 0))[0]
        if not len(both):
            return shard, place, log, weight
        _, some, back = _distinct(head[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64))
        at = both[some]
        found = self.vocabulary.place(mass[at], context[at], ids[at])
        places, logs, weights = np.full(len(at), -1), np.zeros(len(at)), np.zeros(len(at))
        for a, b in _spans(found):
            if (s := self.level("pairs", int(found[a]))) is not None:
                p = s.look(head[at[a:b]], ids[at[a:b]])
                hit = np.flatnonzero(p >= 0)
                places[a:b], logs[a + hit], weights[a + hit] = p, s.value(0, p[hit]), s.value(1, p[hit])
        shard[both], place[both], log[both], weight[both] = found[back], places[back], logs[back], weights[back]
        return shard, place, log, weight

    def score(self, h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base score and score."""
        v = self.vocabulary
        ids, count, before = _tokens(v, h)
        docs = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        total = lambda x: np.bincount(docs, x, len(begin) - 1)
        base = np.log10((count + 0.1) / (v.n + 0.1 * (v.v + 1)))
        head, context = (_previous(x, begin) for x in (ids, count))
        shard, place, seen, weight = self.pairs(ids, count, before, begin)
        log = v.unigram(count) + np.where(head >= 0, np.log10(self.mu / (context + self.mu)), 0)
        log = np.where(place >= 0, seen, log)
        # what follows a pair that was seen
        after = _followers(place, begin)
        if len(after):
            share, known = np.zeros(len(after)), np.flatnonzero(ids[after] >= 0)
            key = place[after - 1].astype(np.uint64) << np.uint64(v.width) | np.maximum(ids[after], 0).astype(np.uint64)
            order = known[_by_shard(shard[after - 1][known], key[known])]
            for a, b in _spans(shard[after - 1][order]):
                rows = order[a:b]
                if (s := self.level("triples", int(shard[after[rows[0]] - 1]))) is not None:
                    keys, back = np.unique(key[rows], return_inverse=True)
                    p = s.look((keys >> np.uint64(v.width)).astype(np.int64), (keys & np.uint64((1 << v.width) - 1)).astype(np.int64))
                    got = np.where(p >= 0, 10.0 ** s.value(0, np.maximum(p, 0)), 0.0)
                    share[rows] = got[back]
            log[after] = np.log10(share + 10.0 ** (log[after] + weight[after - 1]))
        return np.diff(begin), total(count > 0).astype(np.int64), total(base), total(log)


def _followers(place: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Tokens, but for a text's first, whose predecessor ends a pair that was seen."""
    inner = np.ones(len(place), bool)
    inner[begin[:-1]] = False
    return np.flatnonzero(inner & (np.concatenate([[-1], place[:-1]]) >= 0)) if len(place) else np.zeros(0, np.int64)


def fit(docs: DataFrame, learn: Column, text: str = "text", mu: float = MU, nu: float = NU) -> Model:
    """Counts the texts of the rows for which ``learn`` holds, all of them, and writes the trie."""
    spark = docs.sparkSession
    folder = shared_path(spark, "ngrams")
    rows = docs.where(learn)
    texts = rows.select(F.col(text).alias("text"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"])
    bits = max(0, (size // (24 << 20)).bit_length())
    top = lambda k: (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64)
    written = "shard long, size long"

    def gathered(count, write, parts: int, schema: str = written) -> DataFrame:
        """A task a shard."""
        parcels = texts.mapInArrow(releasing(count), "shard int, parcel binary")
        return cut(parcels.repartitionById(parts, "shard").mapInArrow(releasing(write), schema))

    made = gathered(lambda it: _counted(it, lambda h, begin: h, top), _write_words(folder, bits), 1 << bits, f"{written}, mass long, ones long, twos long").collect()  # a row a shard
    sizes, masses = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for r in made:
        sizes[r["shard"]], masses[r["shard"]] = r["size"], r["mass"]
    if sizes.sum() >= 1 << 32:
        raise ValueError("a vocabulary of more than 2^32 words needs wider pair keys")
    ones, twos = (sum(r[k] for r in made) for k in ("ones", "twos"))
    discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
    shards = max(1, -(-int(masses.sum()) // SHARD))
    vocabulary = Vocabulary(folder, bits, sizes, masses, shards, discount)

    def pairs(batches):
        keys, place = _pair_keys(vocabulary)
        yield from _counted(batches, keys, place)

    gathered(pairs, _write_pairs(vocabulary, folder, mu, nu), shards)
    model = Model(vocabulary, folder, mu)

    def triples(batches):
        def keys(h, begin):
            ids, count, before = _tokens(vocabulary, h)
            shard, place, *_ = model.pairs(ids, count, before, begin)
            after = _followers(place, begin)
            return place[after - 1].astype(np.uint64) << np.uint64(vocabulary.width) | ids[after].astype(np.uint64), shard[after - 1]

        yield from _counted(batches, keys)

    gathered(triples, _write_triples(vocabulary, folder, nu), shards)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; a row a document."""

    def run(batches):
        for part, h, begin in _slices(batches, 1):
            n, known, base, log = model.score(h, begin)
            cols = [part.column(0), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), model.vocabulary.n)), pa.array(base), pa.array(log)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(releasing(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
