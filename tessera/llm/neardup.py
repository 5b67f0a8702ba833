"""Near-duplicates by SimHash in an LSH forest, verified on word shingles.

Texts are the same word-shingle sets (five words) when their Jaccard similarity is 0.8 or more. Exact
copies are one text from the start (by digest). Each text has a 128-bit SimHash of its shingles; every
trie of the forest holds all texts under an own random order of the bits. A trie's node is split while
it holds more than ``NODE`` texts, but never below the depth at which the forest as a whole still
finds the target share of pairs at the threshold; sparse regions thus climb to shorter prefixes. Pairs
in a node whose SimHashes are near enough are verified on their shingle sets, and classes are the
connected components of the verified pairs.

Nodes are first read as a sorted stream in bounded buffers. In a node of more than ``BLOCK`` texts at
full depth, deeper prefixes separate blocks; successive blocks overlap. Pairs inside a node whose
SimHashes nearly agree are represented by a spanning forest. A second pass then does without these
cuts: it takes the texts of nodes that were split below full depth or at a buffer's end, and those of
both sides of each edge that verification broke, and tries every near pair in a node that verified
pairs have not joined yet. It holds a node's sketches whole; in a node of many texts that nothing
joins, its work grows with the square of their number.

Nulls and edges: null and empty texts are each other's copies; a text without words has no shingles and
only its exact copies as class; one of fewer than five words has them all as its one shingle. A null id
never names a class that has another id. Repeated rows are copies. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes
from tessera.llm.graph import components
from tessera.llm.shared import cut, releasing

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
RECALL = 0.97
NODE = 32
BLOCK = 2048
OVERLAP = 128
BUFFER = 1 << 16
#: Bits by which the SimHashes of a pair at the threshold differ are 19 of 128 with a deviation of 4.
FAR = 34
SURE = 8
#: Texts of a group of candidates that are verified in one place, where each one's set is sent once.
TOGETHER = 1024
FILTER_BITS = 22
PLANTED = "node long, key long, rest long, d0 long, d1 long"


def agreement(similarity: float) -> float:
    """Probability that a SimHash bit agrees at this Jaccard similarity (sets of like size)."""
    return 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def forest_shape(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(depth, tries): the depth at which random texts fill a node halfway, and the tries that find
    ``recall`` of the pairs at the threshold there."""
    depth = max(13, math.ceil(math.log2(max(n, 2) / (2 * NODE))))
    hit = agreement(similarity) ** depth
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def simhash(h: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Two 64-bit words a text, from its distinct shingles; zeros for a text without any."""
    out = np.zeros((len(where) - 1, BITS // 64), np.uint64)
    for i, (a, b) in enumerate(zip(where, where[1:])):
        if a < b:
            own = np.unique(h[a:b])
            wide = np.stack([own, textbytes.mix(own + np.uint64(0x632BE59BD9B4E019))], axis=1)
            total = np.zeros(BITS, np.int64)
            for lo in range(0, len(own), 4096):
                bits = np.unpackbits(np.ascontiguousarray(wide[lo : lo + 4096]).view(np.uint8), axis=1, bitorder="little")
                total += bits.sum(axis=0, dtype=np.uint16 if len(bits) < 60000 else np.int64)
            out[i] = np.packbits(2 * total > len(own), bitorder="little").view(np.uint64)
    return out


def _shingled(batches, step: int = 512):
    """(digests, shingle hashes, where) for slices of batches of (digest, text)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            data, at = textbytes.spaced(part.column(1))
            starts, ends, first = textbytes.words(data, at)
            yield part.column(0), *textbytes.shingles(textbytes.hashes(data, starts, ends), first, SHINGLE)


def _sketch(batches):
    for digest, h, where in _shingled(batches):
        words = simhash(h, where)
        keep = pa.array(np.diff(where) > 0)
        cols = [digest, pa.array(words[:, 0].view(np.int64)), pa.array(words[:, 1].view(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, ["digest", "s0", "s1"]).filter(keep)


def orders(tries: int, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS)[:64] for _ in range(tries)])


def _plant(tries: int, prefix: int):
    """A row a text and trie: the node it is sent to, 64 bits in the trie's order, the other 64 bits of the SimHash
    (distances are those of all 128, in any order) and the digest as two longs: 48 bytes."""
    perm = orders(tries)
    others = np.stack([np.setdiff1d(np.arange(BITS), p) for p in perm])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                words = np.stack([part.column(k).to_numpy() for k in (1, 2)], axis=1)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                digest = np.frombuffer(b"".join(part.column(0).to_pylist()), np.int64).reshape(-1, 2)
                more = part.columns[3:]
                for t in range(tries):
                    rest = np.ascontiguousarray(np.packbits(bits[:, others[t]], axis=1)).view(np.int64).ravel()
                    key = np.ascontiguousarray(np.packbits(bits[:, perm[t]], axis=1)).view(">u8").astype(np.uint64).ravel()
                    node = (key >> np.uint64(64 - prefix)).astype(np.int64) * tries + t
                    # signed, so that Spark sorts as unsigned would
                    cols = [pa.array(node), pa.array((key ^ np.uint64(1 << 63)).view(np.int64)), pa.array(rest), pa.array(digest[:, 0]), pa.array(digest[:, 1]), *more]
                    yield pa.RecordBatch.from_arrays(cols, ["node", "key", "rest", "d0", "d1", *part.schema.names[3:]])

    return run


def _common(key: np.ndarray) -> np.ndarray:
    """Leading bits that each key shares with the one before it."""
    x = key[1:] ^ key[:-1]
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return 64 - np.bitwise_count(x).astype(np.int64)


def runs(common: np.ndarray, prefix: int, depth: int, deepest: int = 64) -> np.ndarray:
    """First rows of the nodes to compare in, for sorted keys with ``common`` bits between neighbours."""
    cut_at = common < prefix
    for d in range(prefix + 1, deepest + 1):
        most = NODE if d <= depth else BLOCK
        run = np.concatenate([[0], np.cumsum(cut_at)])
        big = np.bincount(run)[run] > most
        if not big.any():
            break
        cut_at |= (common < d) & big[1:] & big[:-1]
    return np.concatenate([[0], np.nonzero(cut_at)[0] + 1])


def _forest_edges(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Places of a minimum spanning forest's edges (Boruvka)."""
    root, taken = np.arange(n), np.zeros(len(a), bool)
    rank = np.argsort(np.argsort(weight, kind="stable"))
    while True:
        ra, rb = root[a], root[b]
        out = np.nonzero(ra != rb)[0]
        if not len(out):
            return np.nonzero(taken)[0]
        best = np.full(n, len(a))
        np.minimum.at(best, ra[out], rank[out])
        np.minimum.at(best, rb[out], rank[out])
        by_rank = np.empty(len(a), np.int64)
        by_rank[rank] = np.arange(len(a))
        chosen = by_rank[np.unique(best[best < len(a)])]
        taken[chosen] = True
        while True:
            low = np.minimum(root[a[chosen]], root[b[chosen]])
            new = root.copy()
            np.minimum.at(new, root[a[chosen]], low)
            np.minimum.at(new, root[b[chosen]], low)
            new = new[new]
            new = new[root]
            if (new == root).all():
                break
            root = new


def near_pairs(s: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) in the runs that begin at ``begins`` whose SimHashes are near: those that nearly
    agree as a spanning forest, the others where they lead from one of its trees to another."""
    n = len(s)
    ends = np.append(begins[1:], n)
    pieces = []  # blocks of at most BLOCK rows
    for x, y in zip(begins, ends):
        if y - x > BLOCK:
            pieces += [(k, min(k + BLOCK, y)) for k in range(x, y - OVERLAP, BLOCK - OVERLAP)]
        elif y - x > 1:
            pieces.append((x, y))
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.concatenate([np.arange(x, y) for x, y in pieces])
    stop = np.repeat([y for _, y in pieces], [y - x for x, y in pieces])
    found = []
    delta = 1
    while len(lo):
        keep = lo + delta < stop
        lo, stop = lo[keep], stop[keep]
        if len(lo):
            x = s[lo] ^ s[lo + delta]
            far = np.bitwise_count(x[:, 0]) + np.bitwise_count(x[:, 1])
            hit = np.nonzero(far <= FAR)[0]
            found.append((lo[hit], lo[hit] + delta, far[hit]))
        delta += 1
    a, b, far = (np.concatenate(x) for x in zip(*found))
    sure = far <= SURE
    tree = _forest_edges(a[sure], b[sure], far[sure], n)
    ta, tb = a[sure][tree], b[sure][tree]
    root = np.arange(n)
    while len(ta):
        new = root.copy()
        low = np.minimum(root[ta], root[tb])
        np.minimum.at(new, root[ta], low)
        np.minimum.at(new, root[tb], low)
        new = new[new][root]
        if (new == root).all():
            break
        root = new
    other = ~sure & (root[a] != root[b])
    return np.concatenate([ta, a[other]]), np.concatenate([tb, b[other]])


def near_across(s: np.ndarray, begins: np.ndarray, label: np.ndarray):
    """Places (a, b), piece by piece, of every pair in the runs that begin at ``begins`` whose SimHashes
    are near and whose labels differ."""
    n = len(s)
    run = np.zeros(n, np.int64)
    run[begins[1:]] = 1
    run = np.cumsum(run)
    order = np.lexsort((label, run))
    s, label = s[order], label[order]
    first = np.concatenate([[0], np.nonzero((np.diff(label) != 0) | (np.diff(run) != 0))[0] + 1])
    after = np.append(first[1:], n)
    lo, hi, stop = np.arange(n), np.repeat(after, after - first), np.append(begins[1:], n)[run]
    while True:
        keep = hi < stop
        lo, hi, stop = lo[keep], hi[keep], stop[keep]
        if not len(lo):
            return
        x = s[lo] ^ s[hi]
        hit = np.bitwise_count(x[:, 0]) + np.bitwise_count(x[:, 1]) <= FAR
        yield order[lo[hit]], order[hi[hit]]
        hi = hi + 1


def _sorted_keys(t) -> tuple[np.ndarray, np.ndarray]:
    """Leading bits in common between neighbours (none between nodes), and the SimHashes."""
    common = _common(t["key"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63))
    common[np.diff(t["node"].to_numpy()) != 0] = 0
    return common, np.stack([t["key"].to_numpy(), t["rest"].to_numpy()], axis=1).view(np.uint64)


def _digests(t) -> np.ndarray:
    return np.stack([t["d0"].to_numpy(), t["d1"].to_numpy()], axis=1)


def _binary(digests: np.ndarray) -> pa.Array:
    ends = pa.py_buffer(np.arange(0, 16 * len(digests) + 1, 16, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, ends, pa.py_buffer(np.ascontiguousarray(digests))])


def _climb(prefix: int, depth: int, buffer: int = BUFFER):

    def run(batches):
        held = parted = None  # parted: the node that the last buffer ended in
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= buffer:
                node = held["node"].to_numpy()[:buffer]
                last = np.nonzero(np.diff(node))[0]
                # up to the last whole node; inside one node, with an overlap
                stop = int(last[-1]) + 1 if len(last) else buffer
                if not len(last):
                    parted = node[0]
                yield emit(held.slice(0, stop), parted)
                held = held.slice(stop if len(last) else stop - OVERLAP)
        if held is not None and held.num_rows:
            yield emit(held, parted)

    def emit(t, parted):
        t = t.combine_chunks()
        common, s = _sorted_keys(t)
        a, b = near_pairs(s, runs(common, prefix, depth))
        # a text of a node that is not compared whole is a pair with itself
        begins = runs(common, prefix, depth, depth)
        sizes = np.diff(np.append(begins, len(s)))
        alone = np.nonzero((np.repeat(sizes, sizes) > BLOCK) | (t["node"].to_numpy() == parted if parted is not None else False))[0]
        a, b = np.concatenate([a, alone]), np.concatenate([b, alone])
        sure = (np.bitwise_count(s[a] ^ s[b]).sum(axis=1) <= SURE) & (a != b)
        digest = _digests(t)
        return pa.RecordBatch.from_arrays([_binary(digest[a]), _binary(digest[b]), pa.array(sure)], ["a", "b", "sure"])

    return run


def _across(prefix: int, depth: int):
    """Near pairs of different labels; a node is held whole (its sketches, not its texts)."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUFFER:
                t = pa.Table.from_batches(held)
                last = np.nonzero(np.diff(t["node"].to_numpy()))[0]
                stop = int(last[-1]) + 1 if len(last) else 0
                if stop:
                    yield from emit(t.slice(0, stop))
                held = t.slice(stop).to_batches()
                # a node beyond the buffer is looked at again when it has doubled
                rows = 0 if not stop else t.num_rows - stop
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows:
                yield from emit(t)

    def emit(t):
        t = t.combine_chunks()
        common, s = _sorted_keys(t)
        digest, label = _digests(t), t["label"].chunk(0).dictionary_encode().indices.to_numpy()
        found, size = [], 0
        for piece in near_across(s, runs(common, prefix, depth, depth), label):
            found.append(piece)
            size += len(piece[0])
            if size >= BUFFER:
                yield taken(digest, found)
                found, size = [], 0
        if size:
            yield taken(digest, found)

    def taken(digest, found):
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([_binary(digest[a]), _binary(digest[b])], ["a", "b"])

    return run


def _sets(words: np.ndarray):
    """Shingle sets of the texts whose digests may be among those asked for."""

    def run(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, 4)[:, 0].astype(np.int64) & ((1 << FILTER_BITS) - 1)
            asked = (words[raw >> 5] >> (raw & 31)) & 1 != 0
            for digest, h, where in _shingled([batch.filter(pa.array(asked))]):
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(where, where[1:])]
                yield pa.RecordBatch.from_arrays([digest, pa.array(sets, pa.binary())], ["digest", "shingles"])

    return run


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            sure = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sure.append(both > 0 and both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(sure, pa.bool_()))

    return run


def _verify_together(similarity: float):
    """Of rows sorted by group, its sets first: the pairs (a, b) that reach the similarity."""

    def run(batches):
        group, sets = None, {}
        for batch in batches:
            found = []
            for g, a, b, x in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if g != group:
                    group, sets = g, {}
                if b is None:
                    sets[a] = np.frombuffer(x, np.uint64)
                    continue
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both > 0 and both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def verified_pairs(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests that reach the similarity.

    Texts are read again where they lie; a bit table of fixed size lets only those asked for through
    (and a few more, which the join then drops).
    """
    place = F.conv(F.concat(*[F.substring(F.hex("d"), 7 - 2 * i, 2) for i in range(4)]), 16, 10).cast("long").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("d")).select(place.alias("p"))
    table = asked.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits"))
    got = table.toArrow()  # at most 2^17 rows
    words = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    words[got["w"].to_numpy()] = got["bits"].to_numpy()
    sets = texts.mapInArrow(releasing(_sets(words)), "digest binary, shingles binary").dropDuplicates(["digest"])
    # pairs that hang together meet in one place; of larger groups, each pair takes its two sets along
    of = components(pairs)
    small = of.join(of.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= TOGETHER), "root", "left_semi")
    grouped = cut(pairs.join(of.withColumnsRenamed({"node": "a"}), "a").join(small.select("root").distinct().withColumn("small", F.lit(True)), "root", "left"))
    large = grouped.where(F.col("small").isNull()).select("a", "b")
    held = sets.join(small.withColumnsRenamed({"node": "digest"}), "digest").select("root", F.col("digest").alias("a"), F.lit(None).cast("binary").alias("b"), F.col("shingles").alias("x"))
    rows = held.unionByName(grouped.where("small").select("root", "a", "b", F.lit(None).cast("binary").alias("x")))
    together = rows.repartition("root").sortWithinPartitions("root", F.col("b").asc_nulls_first()).mapInArrow(releasing(_verify_together(similarity)), "a binary, b binary")
    if not large.limit(1).count():
        return together
    left = large.join(sets.withColumnsRenamed({"digest": "a", "shingles": "x"}), "a")
    both = left.join(sets.withColumnsRenamed({"digest": "b", "shingles": "y"}), "b").select("a", "b", "x", "y")
    return together.unionByName(both.mapInArrow(releasing(_verify(similarity)), "a binary, b binary"))


def _unsettled(sketches: DataFrame, pairs: DataFrame, links: DataFrame, of: DataFrame) -> DataFrame:
    """Sketches, each with the class so far as ``label``, of the texts in nodes that were not compared
    whole (pairs with themselves), and of those whose pairs a spanning tree has stood for although one
    of its edges failed. Each part of such a tree ends at a failed edge, so these are the classes on
    both sides of all failed edges."""
    failed = pairs.where("sure").join(links, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        failed = failed.join(of.withColumnsRenamed({"digest": side, "root": f"{side}_root"}), side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    broken = failed.where(F.col("a_root") != F.col("b_root")).select(F.explode(F.array("a_root", "b_root")).alias("label")).distinct()
    labelled = sketches.join(of, "digest", "left").select("digest", "s0", "s1", F.coalesce("root", "digest").alias("label"))
    parted = labelled.join(pairs.where(F.col("a") == F.col("b")).select(F.col("a").alias("digest")), "digest", "left_semi")
    return labelled.join(broken, "label", "left_semi").select(parted.columns).unionByName(parted).distinct()


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.md5(body)).alias("digest"), body.alias("text"))


def _named(rows: DataFrame, similarity: float, recall: float) -> DataFrame:
    """A row a distinct text: digest, its least doc_id, n (rows) and root, which names its class."""
    texts = rows.select("digest", "text")
    sketched = texts.mapInArrow(releasing(_sketch), "digest binary, s0 long, s1 long")
    sketches = cut(sketched.groupBy("digest").agg(F.first("s0").alias("s0"), F.first("s1").alias("s1")))
    depth, tries = forest_shape(sketches.count(), similarity, recall)
    prefix = depth - 4
    planted = sketches.mapInArrow(releasing(_plant(tries, prefix)), PLANTED)
    near = planted.repartition("node").sortWithinPartitions("node", "key", "d0", "d1").mapInArrow(releasing(_climb(prefix, depth)), "a binary, b binary, sure boolean")
    pairs = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").distinct())
    links = cut(verified_pairs(texts, pairs.where(F.col("a") != F.col("b")).select("a", "b"), similarity))
    of = components(links).select(F.col("node").alias("digest"), "root")
    again = cut(_unsettled(sketches, pairs, links, of))
    if again.limit(1).count():
        planted = again.mapInArrow(releasing(_plant(tries, prefix)), f"{PLANTED}, label binary")
        near = planted.repartition("node").sortWithinPartitions("node", "key", "d0", "d1").mapInArrow(releasing(_across(prefix, depth)), "a binary, b binary")
        more = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
        links = links.unionByName(verified_pairs(texts, more, similarity))
        of = components(links).select(F.col("node").alias("digest"), "root")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return copies.join(of, "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row a document: doc_id, class_id (the least id in its class), class_size, n_texts (distinct
    texts in the class)."""
    rows = _rows(docs, key, text)
    named = _named(rows, similarity, recall)
    sized = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts"))
    by_text = named.select("digest", "root").join(sized, "root").drop("root")
    return rows.select("doc_id", "digest").join(by_text, "digest").drop("digest")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: that of the least id, among several of the least digest."""
    named = _named(_rows(docs, key, text), similarity, RECALL)
    # nulls last: a null id stands for its class only where there is no other
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    kept = named.groupBy("root").agg(F.min(first).alias("k"), F.min_by("n", first).alias("n"))
    kept = cut(kept.select(F.col("k.doc_id").alias("_kept"), F.col("k.digest").alias("_digest"), (F.col("n") > 1).alias("_copies")))
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))

    def of(keep: DataFrame) -> DataFrame:
        return docs.join(keep, F.col(key).cast("long").eqNullSafe(F.col("_kept")) & (digest == F.col("_digest")), "left_semi")

    # a text that stands in one row needs no more; of one in several rows, the id may be repeated too
    copies = of(kept.where("_copies")).withColumn("_digest", digest)
    return of(kept.where(~F.col("_copies"))).unionByName(copies.dropDuplicates(["_digest"]).drop("_digest"))
