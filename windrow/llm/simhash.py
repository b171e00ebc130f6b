"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries.

Fingerprints that can be near are dealt into one group; a group's distinct fingerprints make a binary trie, kept as a
sorted array with paths compressed, and the trie is joined with itself: a pair of nodes is followed to the pairs of their
children, differing bits add up along both paths, and the pair is dropped once they exceed the budget, or where all that
lies below both is linked already.  Neighbours in the sorted order are tried first, so a large cluster of copies costs a
walk along its leaves and not along their pairs.  Of what one task finds linked, only a spanning tree leaves it, so a group
of n copies gives fewer than n links.

How fingerprints are dealt depends on the budget.  Of 64 bits with a small budget, two within it agree on one of
``budget + 1`` blocks of bits, so each is dealt out once per block and no link is lost.  A budget that Jaccard similarities
of 0.8 need is far too large for that: there fingerprints have 512 bits and are dealt by bands of MinHash values of the
same shingles, which brings nearly all pairs of that similarity together.  A group of more than ``split`` fingerprints is
cut into parts, and pairs of parts are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, free, lean, partitions, settled
from .textblocks import BASES, U64, mix

SEED = 42
SPLIT = 1 << 18
#: Bits that may differ of 64, and of the 512 that near copies of a Jaccard similarity of 0.8 or more are looked for with.
BUDGET, WIDE_BUDGET, WIDE = 4, 88, 8
#: MinHash bands and the values in each: a pair of similarity 0.8 shares a band with a probability of 0.997.
BANDS, ROWS = 8, 3
_FRONT = 1 << 17
#: So many rows of whole groups are joined at once.
_CHUNK = 1 << 18
_TOP = np.array([((1 << k) - 1) << (64 - k) for k in range(65)], U64)


def hashes(text: bytes, width: int = 4) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence where there are fewer words; none without words."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, and the six ASCII spaces alone separate
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if words else [], U64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    f = xxhash.xxh64_intdigest
    return np.fromiter((f(line[s:e], SEED) for s, e in zip(start.tolist(), end[width - 1 :].tolist())), U64, len(words) - width + 1)  # noqa: B905


def bits_of(h: np.ndarray) -> int:
    """Bit b is set where over half of the hashes have it set; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(np.ascontiguousarray(h[a : a + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(U64)[0])


def fingerprint(text: bytes, width: int = 4) -> int:
    return bits_of(hashes(text, width))


def bands(h: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key of each band: the least values of the hashes under ``rows`` hash functions."""
    turns = mix(np.arange(1, n * rows + 1, dtype=U64) * U64(BASES[2])) | U64(1)
    x, least = h ^ (h >> U64(31)), np.full(n * rows, U64(2**64 - 1))
    for a in range(0, len(x), 1 << 12):
        least = np.minimum(least, (x[a : a + (1 << 12), None] * turns).min(0))
    key = np.arange(1, n + 1, dtype=U64)
    for row in least.reshape(n, rows).T:
        key = mix(key * U64(BASES[1]) + row)
    return key.view(np.int64)


def wide(h: np.ndarray, words: int = WIDE) -> np.ndarray:
    """The words of a fingerprint of more than 64 bits, the first of which is that of 64."""
    return np.array([bits_of(mix(h + U64(k * BASES[0] % 2**64)) if k else h) for k in range(words)], U64)


def fingerprints(docs: DataFrame, width: int = 4, *also: str, words: int = 1) -> DataFrame:
    """(doc_id, fp long) of every text, and the columns ``also``, long integers; a null text counts as empty.  Of more words than
    one, fp is an array of them, and ``bands`` the keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in b.column(1).cast(pa.large_binary())]
            if words == 1:
                cols, names = [pa.array(np.array([bits_of(h) for h in of], U64).view(np.int64))], ["fp"]
            else:
                cols, names = [pa.array([x.view(np.int64) for x in y], pa.list_(pa.int64())) for y in ([wide(h, words) for h in of], [bands(h) for h in of])], ["fp", "bands"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *b.columns[2:]], ["doc_id", *names, *also])

    own = "fp long" if words == 1 else "fp array<long>, bands array<long>"
    return lean(docs.select("doc_id", "text", *also)).mapInArrow(run, ", ".join(["doc_id long", own, *(f"{c} long" for c in also)]))


def blocks_of(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of budget + 1 blocks that cover 64 bits."""
    cuts = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Trie:
    """The tries of some groups, each a stretch of rows that are sorted by (group, key) and distinct; a key is a row of words.

    A node is a range of rows; the bits that all of them share end at its depth."""

    def __init__(self, group: np.ndarray, keys: np.ndarray):
        self.group, self.keys, self.bits = group, keys, 64 * keys.shape[1]
        self.root = np.arange(len(keys))
        #: Pairs of nodes that a join has followed.
        self.walked = 0

    def depth(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        x = self.keys[lo] ^ self.keys[hi - 1]
        word = np.argmax(x != 0, 1)
        v = x[np.arange(len(x)), word]
        for k in (1, 2, 4, 8, 16, 32):
            v = v | (v >> U64(k))
        return np.where(hi - lo == 1, self.bits, 64 * word + 64 - np.bitwise_count(v).astype(np.int64))

    def cut(self, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The first row with that bit, before which all have shared bits."""
        lo, hi, word, shift = lo.copy(), hi.copy(), bit >> 6, (63 - (bit & 63)).astype(U64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            one = (self.keys[np.minimum(mid, len(self.keys) - 1), word] >> shift) & U64(1) == 1
            hi = np.where(open_ & one, mid, hi)
            lo = np.where(open_ & ~one, mid + 1, lo)
        return lo

    def differ(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many bits of two rows differ from one place to another."""
        out, x = np.zeros(len(a), np.int64), self.keys[a] ^ self.keys[b]
        for w in range(x.shape[1]):
            inside = _TOP[np.clip(end - 64 * w, 0, 64)] & ~_TOP[np.clip(begin - 64 * w, 0, 64)]
            out += np.bitwise_count(x[:, w] & inside)
        return out

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                return
            np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    def join(self, budget: int) -> np.ndarray:
        """The least row that each row is linked with."""
        n = len(self.keys)
        if n < 2:
            return self.root
        i = np.flatnonzero(self.group[1:] == self.group[:-1])
        whole = np.full(len(i), self.bits)
        near = self.differ(i, i + 1, 0 * whole, whole) <= budget
        self.link(i[near], i[near] + 1)
        begin = np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1])))
        lo, hi = begin, np.append(begin[1:], n)
        found = []
        while True:  # every node with two children is a pair of nodes to follow
            flat = self.flat()
            two = (hi - lo > 1) & ~flat(lo, hi)
            lo, hi = lo[two], hi[two]
            if not len(lo):
                break
            bit = self.depth(lo, hi)
            mid = self.cut(lo, hi, bit)
            found.append(np.stack([lo, mid, mid, hi, bit, 0 * bit]))
            lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
        if not found:
            return self.root
        pairs = np.concatenate(found, 1)
        pairs = pairs[:, np.argsort(pairs[4], kind="stable")]  # the deepest are followed first: they are on top of the stack
        stack = [x for x in np.array_split(pairs, max(4, pairs.shape[1] // _FRONT), 1) if x.shape[1]]
        while stack:
            front = stack.pop()
            if front.shape[1] > 2 * _FRONT:
                stack += np.array_split(front, front.shape[1] // _FRONT + 1, 1)
                continue
            self.walked += front.shape[1]
            a0, a1, b0, b1, bit, err = front
            flat = self.flat()
            live = ~(flat(a0, a1) & flat(b0, b1) & (self.root[a0] == self.root[b0]))
            a0, a1, b0, b1, bit, err = (x[live] for x in (a0, a1, b0, b1, bit, err))
            da, db = self.depth(a0, a1), self.depth(b0, b1)
            end = np.minimum(da, db)
            err = err + self.differ(a0, b0, bit, end)
            live = err <= budget
            leaf = live & (end == self.bits)
            self.link(a0[leaf], b0[leaf])
            live &= ~leaf
            if not live.any():
                continue
            a0, a1, b0, b1, da, db, end, err = (x[live] for x in (a0, a1, b0, b1, da, db, end, err))
            sa, sb = da == end, db == end
            # a node that does not branch here goes on whole
            am, bm = a1.copy(), b1.copy()
            am[sa] = self.cut(a0[sa], a1[sa], end[sa])
            bm[sb] = self.cut(b0[sb], b1[sb], end[sb])
            both = sa & sb
            stack.append(np.concatenate([np.stack(x) for x in (
                (a0, am, b0, bm, end, err), (am[sa], a1[sa], b0[sa], bm[sa], end[sa], err[sa]),
                (a0[sb], am[sb], bm[sb], b1[sb], end[sb], err[sb]), (am[both], a1[both], bm[both], b1[both], end[both], err[both]),
            )], 1))
        return self.root

    def flat(self):  # noqa: ANN201
        """Whether all rows of a range are linked."""
        steps = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))
        return lambda lo, hi: steps[hi - 1] == steps[lo]


def trie_of(group: np.ndarray, keys: np.ndarray) -> Trie:
    """The tries of rows in any order; rows that repeat count once."""
    order = np.lexsort((*keys.T[::-1], group))
    group, keys = group[order], keys[order]
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (keys[1:] != keys[:-1]).any(1))) if len(group) else np.empty(0, bool)
    return Trie(group[new], keys[new])


def _joined(tasks: DataFrame, words: int, budget: int) -> DataFrame:
    """Edges (a, b), arrays of words, of a table (key, turn, w0, w1, ...): each key's rows are a trie; turn is by how many bits to the left
    they are rotated."""
    names = [f"w{k}" for k in range(words)]

    def join(rows: pa.Table) -> pa.RecordBatch:
        key, turn = (rows[c].to_numpy() for c in ("key", "turn"))
        t = trie_of(key, np.stack([rows[c].to_numpy().view(U64) for c in names], 1))
        root = t.join(budget)
        own = np.flatnonzero(root != np.arange(len(root)))
        # rows of one key have one rotation
        back = turn[np.unique(key, return_index=True)[1]][np.searchsorted(np.unique(key), t.group[own])].astype(U64)
        out = []
        for at in (own, root[own]):
            w = t.keys[at]
            if words == 1:
                w = (w >> back[:, None]) | np.where(back[:, None] > 0, w << ((U64(64) - back[:, None]) & U64(63)), U64(0))
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * words), pa.array(w.reshape(-1).view(np.int64))))
        return pa.RecordBatch.from_arrays(out, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            count += len(b)
            if count < _CHUNK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if last:
                yield join(rows.slice(0, last))
                held = rows.slice(last).to_batches()
                count = len(rows) - last
        if held:
            yield join(pa.Table.from_batches(held).combine_chunks())

    dealt = tasks.select("key", "turn", *names).repartition(partitions(tasks.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a array<long>, b array<long>")


def links(prints: DataFrame, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` of 64 bits that connect whatever is within ``budget`` bits."""
    blocks = blocks_of(budget)
    turn = lambda at: F.col("fp") if at == 0 else F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at))
    dealt = F.array(*(F.struct(F.lit(at).alias("turn"), F.lit(n).alias("width"), turn(at).alias("w0"), F.shiftrightunsigned(turn(at), 64 - n).alias("value")) for at, n in blocks))
    tries = prints.select(F.explode(dealt).alias("t")).select("t.*")
    # There are at most (budget + 1) * 2**bits values, however many documents: bounded tables, and the driver gets the few depths.
    full = tries.groupBy("turn", "value").count().where(F.col("count") > split).select("turn", "value", (F.ceil(F.log2(F.col("count") / split)) + 1).cast("int").alias("deep"))
    full = settled(full)
    depths = {r["deep"] for r in full.select("deep").distinct().collect()}
    # what a sub-trie's prefix may differ by from that of one near it
    masks = {d: [0, *(sum(1 << i for i in c) for k in range(1, min(budget, d) + 1) for c in combinations(range(d), k))] for d in depths}
    near = F.array(F.lit(0))
    for d, ms in masks.items():
        near = F.when(F.col("deep") == d, F.transform(F.array(*map(F.lit, ms)), lambda m: m)).otherwise(near)
    tries = tries.join(F.broadcast(full), ["turn", "value"], "left").withColumn("deep", F.coalesce("deep", F.lit(0)))
    child = F.when(F.col("deep") == 0, F.lit(0)).otherwise(F.expr("cast(shiftrightunsigned(shiftleft(w0, width), 64 - deep) as int)"))
    each = tries.withColumn("child", child).withColumn("mask", F.explode(near)).withColumn("other", F.col("child").bitwiseXOR(F.col("mask")))
    tasks = each.select(F.xxhash64("turn", "value", F.least("child", "other"), F.greatest("child", "other")).alias("key"), "turn", "w0")
    return _joined(tasks, 1, budget).select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b"))


def wide_links(prints: DataFrame, budget: int = WIDE_BUDGET, split: int = SPLIT, words: int = WIDE) -> DataFrame:
    """Edges (a, b), arrays of words, between distinct fingerprints ``fp`` that share one of ``bands`` and are within ``budget`` bits."""
    each = prints.select("fp", F.explode("bands").alias("band"))
    # of n fingerprints at most BANDS * n / split groups are that large, and those are tasks of hours: a table of few rows
    full = settled(each.groupBy("band").count().where(F.col("count") > split).select("band", F.ceil(F.col("count") / split).cast("int").alias("parts")))
    cut = each.join(F.broadcast(full), "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = cut.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.when(F.col("parts") == 1, F.col("band")).otherwise(F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")))
    return _joined(pairs.select(key.alias("key"), F.lit(0).alias("turn"), *(F.col("fp")[k].alias(f"w{k}") for k in range(words))), words, budget)


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links of at most ``budget`` differing bits.  Texts without words, null
    ones too, have fingerprint 0 and are linked like any other; a very long text is read whole; rows that repeat a doc_id are
    rows of their own; a null doc_id never is a component_id unless no other is reachable.  An empty table gives an empty
    one; other columns are not looked at.
    """
    prints = settled(fingerprints(docs, width))
    classes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), budget, split))
    linked = roots.join(classes, F.col("fp") == F.col("node")).select("fp", "root", "least")
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = settled(linked.join(first, "root").select("fp", "component_id"))
    named = classes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _name(words: Column) -> Column:
    """128 bits that stand for a fingerprint of several words."""
    return F.md5(F.array_join(F.transform(words, lambda w: w.cast("string")), ",").cast("binary"))


def keep_first(docs: DataFrame, width: int = 5, budget: int = WIDE_BUDGET, split: int = SPLIT) -> DataFrame:
    """Of each component the row of least doc_id (null last), and of those the one whose text's hash is least; of rows that are
    equal in both, one.  So rows that share a doc_id, or have none, stay where nothing links them.  Columns stay as they are.

    Components are those of 512-bit fingerprints of ``width``-word shingles, ``budget`` bits apart at most.  Documents without
    words, null texts too, are linked with one another, so one of those stays; a very long text is read whole; an empty
    table gives an empty one."""
    # null as a number, told from a real one by the mark, so that join and distinct deal the texts out once, by one key
    name, mark = free(docs, "id", "mark")
    marked = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(mark, F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    prints = settled(fingerprints(marked, width, mark, words=WIDE))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", mark)).alias("least")
    classes = settled(prints.groupBy("fp").agg(least, F.min("bands").alias("bands")).withColumn("node", _name(F.col("fp"))))
    edges = wide_links(classes.select("fp", "bands"), budget, split)
    roots = components(edges.select(_name(F.col("a")).alias("a"), _name(F.col("b")).alias("b")))
    first = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("component")).agg(F.min("least").alias("least"))
    keep = first.select(F.coalesce("least.doc_id", F.lit(-(1 << 63))).alias(name), F.col(f"least.{mark}").alias(mark))
    return marked.join(keep, [name, mark], "left_semi").dropDuplicates([name, mark]).select(*(F.col(f"`{c}`") for c in docs.columns))
