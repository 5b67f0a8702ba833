"""Token ids in wavelet-matrix files, one a shard.

A shard's ids have codes of at most ``LONGEST_CODE`` bits, shorter for more frequent ids (Huffman's, with
limited lengths), and are held as bit-planes, first bit first. Each plane is stored in the order that the
planes before it leave (zeros before ones, both stable), without the ids whose codes have ended: codes are
assigned so that those come first in the order, so dropping them is a subtraction. The planes thus take
the entropy of the ids and a little more, with the running count of ones every 1024 bits. Rank on the
planes gives the token at a place, the count of an id in a range and, by select, the places at which an
id occurs, all from the file, which is memory-mapped and never decoded for that. Reading a whole shard
back undoes the planes from the last to the first.

File: magic, lengths, then document ids and their null flags, documents' token numbers, the ids that occur
with their code lengths and counts, and planes with their counts, each zero-padded to 8 bytes. A file is
written under another name and renamed, so a task that is run again leaves the same shard.

Nulls and edges: a null or empty text is its end id alone. Null document ids come first and are kept.
Repeated rows are documents of their own, next to each other. An empty table gives no rows and at most
empty shards. Other input columns are not looked at.
"""

from __future__ import annotations

import heapq
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.eliasfano import select_in_word
from tessera.llm.shared import cut, releasing, shared_path
from tessera.llm.tokens import forgetting, tokenizer

MAGIC = b"TESSWM02"
BLOCK = 1024
LONGEST_CODE = 16
STEP = 1 << 16
#: Bytes of text a shard is meant to hold, and shards a task is to write where there are tasks enough: each task
#: learns its chunks anew.
SHARD_BYTES = 16 << 20
TASK_SHARDS = 3
_HEAD = struct.Struct("<8sQQQ")


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of a prefix code for these counts; ``longest`` grows where there are too many symbols for it."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.uint8)
    longest = max(longest, (n - 1).bit_length())
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, np.int64)
    for node in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        heapq.heappush(heap, (a + b, node))
    depth = np.zeros(2 * n - 1, np.int64)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    length = np.minimum(depth[:n], longest)
    # what cutting took too much of is given back by the rarest symbols that can be longer
    room = (1 << longest) - int((1 << (longest - length)).sum())
    for i in np.argsort(counts, kind="stable"):
        while room < 0 and length[i] < longest:
            length[i] += 1
            room += 1 << int(longest - length[i])
    # and what is left over goes to the most frequent ones that can be shorter
    for i in np.argsort(-counts, kind="stable"):
        while length[i] > 1 and 1 << int(longest - length[i]) <= room:
            room -= 1 << int(longest - length[i])
            length[i] -= 1
    return length.astype(np.uint8)


def assign(length: np.ndarray) -> np.ndarray:
    """A code for each symbol, first bit lowest: at each length, those that come first in the order that
    the planes leave, so that no code begins another."""
    codes, nodes = np.zeros(len(length), np.uint32), np.zeros(1, np.uint32)
    order = np.argsort(length, kind="stable")
    at = 0
    for k in range(1, int(length.max()) + 1 if len(length) else 0):
        nodes = np.concatenate([nodes, nodes | np.uint32(1 << (k - 1))])
        n = int(np.count_nonzero(length == k))
        codes[order[at : at + n]], nodes = nodes[:n], nodes[n:]
        at += n
    return codes


def _split(order: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A plane's bits, padded to whole blocks and a word, and the order that it leaves: in steps that stay in cache."""
    n, mask = len(order), order.dtype.type(1 << level)
    packed, ones = np.zeros(-(-n // BLOCK) * BLOCK // 8 + 8, np.uint8), []
    out, at = np.empty_like(order), 0
    for lo in range(0, n, STEP):
        x = order[lo : lo + STEP]
        bit = (x & mask) != 0
        packed[lo // 8 : lo // 8 + -(-len(x) // 8)] = np.packbits(bit, bitorder="little")
        ones.append(x.take(np.flatnonzero(bit)))
        zero = x.take(np.flatnonzero(~bit))
        out[at : at + len(zero)] = zero
        at += len(zero)
    for x in ones:
        out[at : at + len(x)] = x
        at += len(x)
    return packed, out


def write(path: str, ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray) -> None:
    """``starts``: one more than documents."""
    times = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(times)
    counts = times[symbols]
    length = code_lengths(counts)
    levels = int(length.max()) if len(length) else 0
    table = np.zeros(len(times), np.uint16 if levels <= 16 else np.uint32)
    table[symbols] = assign(length)
    order, planes = table[ids] if len(ids) else table, []
    for k in range(levels):
        packed, order = _split(order, k)
        ones = np.bitwise_count(packed[:-8].view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        planes += [packed, np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype(np.uint32)]
        order = order[int(counts[length == k + 1].sum()) :]
    parts = [doc_ids.astype("<i8"), known.astype(np.uint8), np.diff(starts).astype("<u4"), symbols.astype("<u4"), length, counts.astype("<u4"), *planes]
    scratch = f"{path}.{uuid.uuid4().hex}"
    with open(scratch, "wb") as f:
        f.write(_HEAD.pack(MAGIC, len(ids), len(symbols), len(doc_ids)))
        for x in parts:
            raw = np.ascontiguousarray(x).tobytes()
            f.write(raw + bytes(-len(raw) % 8))
    os.replace(scratch, path)


class WaveletMatrix:
    """A shard's file, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        magic, self.n, symbols, docs = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{path}: not a token file")
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            size = np.dtype(kind).itemsize * n
            out = raw[at : at + size].view(kind)
            at += size + -size % 8
            return out

        self.doc_ids, self.known, sizes = take("<i8", docs), take(np.uint8, docs), take("<u4", docs)
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.symbols, self.length, counts = take("<u4", symbols), take(np.uint8, symbols), take("<u4", symbols)
        self.codes = assign(self.length)
        self.levels = int(self.length.max()) if symbols else 0
        # of the codes that end at each level: ids, times and running times, in the order that the planes leave
        self.leaves, self.sizes, self.planes, self.zeros = [], [], [], []
        size = self.n
        for k in range(self.levels):
            here = np.flatnonzero(self.length == k + 1)
            here = here[np.argsort(self.codes[here])]
            ended = np.concatenate([[0], np.cumsum(counts[here], dtype=np.int64)])
            self.leaves.append((self.symbols[here].astype(np.int64), ended))
            blocks = -(-size // BLOCK)
            plane, ones = take(np.uint8, blocks * BLOCK // 8 + 8), take("<u4", blocks + 1)
            self.planes.append((plane.view(np.uint64), ones))
            self.sizes.append(size)
            self.zeros.append(size - int(ones[-1]))
            size -= int(ended[-1])

    def _rank(self, level: int, at: np.ndarray | int) -> np.ndarray:
        """Ones before ``at``: a count, at most 15 words and a part of one."""
        words, counts = self.planes[level]
        at = np.atleast_1d(np.asarray(at, np.int64))
        block, inside = at // BLOCK, at // 64 % (BLOCK // 64)
        out = counts[block].astype(np.int64)
        for j in range(BLOCK // 64 - 1):
            more = inside > j
            if not more.any():
                break
            out[more] += np.bitwise_count(words[block[more] * (BLOCK // 64) + j])
        rest = (at % 64).astype(np.uint64)
        return out + np.bitwise_count(words[at // 64] & ((np.uint64(1) << rest) - np.uint64(1)))

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        out, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(self.levels):
            here = at[open_]
            ones = self._rank(k, here)
            bit = self._rank(k, here + 1) > ones
            here = np.where(bit, self.zeros[k] + ones, here - ones)
            ids, ended = self.leaves[k]
            done = here < ended[-1]
            if done.any():
                out[open_[done]] = ids[np.searchsorted(ended, here[done], "right") - 1]
            open_, here = open_[~done], here[~done] - int(ended[-1])
            at[open_] = here
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int, int, int]:
        """Where the order after the code's last plane holds ``token`` of [lo, hi), its code and its length."""
        i = int(np.searchsorted(self.symbols, token))
        if i == len(self.symbols) or self.symbols[i] != token:
            return 0, 0, 0, 0
        code, length = int(self.codes[i]), int(self.length[i])
        for k in range(length):
            if k:
                lo, hi = (x - int(self.leaves[k - 1][1][-1]) for x in (lo, hi))
            a, b = (int(x) for x in self._rank(k, [lo, hi]))
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if code >> k & 1 else (lo - a, hi - b)
        return lo, hi, code, length

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b, *_ = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Place of the nth (from 0) such bit: the block by its count, then the word, then the bit."""
        words, counts = self.planes[level]
        before = counts.astype(np.int64) if bit else np.arange(len(counts)) * BLOCK - counts.astype(np.int64)
        block = np.searchsorted(before, nth, "right") - 1
        left, at = nth - before[block], block * (BLOCK // 64)
        for _ in range(BLOCK // 64 - 1):
            held = np.bitwise_count(words[at] if bit else ~words[at]).astype(np.int64)
            on = left >= held
            if not on.any():
                break
            left, at = np.where(on, left - held, left), np.where(on, at + 1, at)
        return at * 64 + select_in_word(words[at] if bit else ~words[at], left)

    def locate(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places in [lo, hi) that hold ``token``."""
        a, b, code, length = self._range(token, lo, self.n if hi is None else hi)
        at = np.arange(a, b)
        for k in reversed(range(length)):
            bit = code >> k & 1
            at = self._select(k, bit, at - self.zeros[k] * bit)
            if k:
                at = at + int(self.leaves[k - 1][1][-1])
        return np.sort(at)

    def decode(self) -> np.ndarray:
        """Every id, in order."""
        kind = np.uint16 if not len(self.symbols) or int(self.symbols[-1]) < 1 << 16 else np.uint32
        out = np.zeros(0, kind)
        for k in reversed(range(self.levels)):
            ids, ended = self.leaves[k]
            out = np.concatenate([np.repeat(ids.astype(kind), np.diff(ended)), out])
            size, plane = self.sizes[k], self.planes[k][0].view(np.uint8)
            up, a, b = np.empty(size, kind), 0, self.zeros[k]
            for lo in range(0, size, STEP):
                n = min(STEP, size - lo)
                bit = np.unpackbits(plane[lo // 8 : lo // 8 + -(-n // 8)], bitorder="little", count=n).view(bool)
                one, zero, x = np.flatnonzero(bit), np.flatnonzero(~bit), up[lo : lo + n]
                x[zero] = out[a : a + len(zero)]
                x[one] = out[b : b + len(one)]
                a, b = a + len(zero), b + len(one)
            out = up
        return out


def _write_shards(folder: str, path: str, lead: bool, end: int, shard_bytes: int):
    """Encodes a partition's documents, in order, into as many shards as its text needs."""

    def run(batches):
        from pyspark import TaskContext

        tok, part = tokenizer(path, lead), TaskContext.get().partitionId()
        last = np.array([end], tok.width).tobytes()
        ids, keys, sizes, held, made = [], [], [], 0, 0

        def flush():
            nonlocal ids, keys, sizes, held, made
            name = f"{part:08d}-{made:06d}.twm"
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            write(os.path.join(folder, name), np.frombuffer(b"".join(ids), tok.width), np.array([k or 0 for k in keys], np.int64), np.array([k is not None for k in keys]), starts)
            row = ([name], [part], [made], [int(starts[-1])])
            ids, keys, sizes, held, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.int32()), pa.array(row[2], pa.int32()), pa.array(row[3], pa.int64())], ["name", "part", "nth", "tokens"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for key, text, packed in zip(batch.column(0).to_pylist(), texts, tok.encode(texts)):
                ids.append(packed + last)
                keys.append(key)
                sizes.append(len(packed) // tok.width.itemsize + 1)
                held += len(text or "") + 1
                if held >= shard_bytes:
                    yield flush()
        if keys:
            yield flush()

    return run


def encode(docs: DataFrame, path: str, lead: bool = False, end: int = 1, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Writes the shards; the folder and a row a shard: name, tokens and ``before``, the tokens of all
    shards before it. Shards follow one another in ascending order of the key."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sized = chosen.select(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-int(sized) // shard_bytes))
    parts = max(-(-shards // TASK_SHARDS), min(shards, spark.sparkContext.defaultParallelism))
    ranged = chosen.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = cut(ranged.mapInArrow(releasing(_write_shards(folder, path, lead, end, shard_bytes), forgetting(path, lead)), "name string, part int, nth int, tokens long"))
    order = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)  # a row a shard
    return folder, made.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))


def _read_shards(folder: str):
    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = WaveletMatrix(os.path.join(folder, name))
                wide, starts = m.decode().astype("<u4"), np.asarray(m.starts)
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.doc_ids, mask=m.known == 0), pa.array(before + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read(folder: str, shards: DataFrame) -> DataFrame:
    """A row a document, from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, shards.count())
    listed = shards.select("name", "before").repartition(n, "name")
    return listed.mapInArrow(releasing(_read_shards(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")
