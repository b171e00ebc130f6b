"""Substring deduplication with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words; its fingerprint is the hash of the ``GRAM``-word gram that it elects, that of the
least hash, the last of equals.  Equal windows elect the same gram, and neighbours share elections: about one word in
fifteen is elected.

1.  ``WindowIndex`` keeps the fingerprints of earlier batches, with how often each was elected, as sorted immutable runs in
    buckets of the hash.  A new batch becomes a run of its own and is merge-joined with the earlier ones, bucket by bucket,
    which moves none of them; fingerprints that have now been met twice are what the batch answers with.  Runs of one level
    are compacted into one of the next.
2.  Windows with such a fingerprint are verified: they are hashed over their words, 64 bits by a polynomial and 64 bits by
    BLAKE2, and written, per task and range, as sorted runs.  The range is that of the elected gram's hash, so that a passage's
    windows stay together; for grams that many windows elect it is that of the window's own hash, which spreads them.  The
    runs of a range are merged; a hash in two runs, or twice in one, repeats.  What repeats within a run is found where the run
    is made and enters the merge as one entry, so a passage in a third of all documents sends one entry a run.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete, folder, lean, partitions, pieces, release, settled
from .textblocks import BASES, U64, Block, blocks, grams, mix, whole

WINDOW, GRAM = 35, 6
#: A run is closed when it holds so many windows.
RUN = 1 << 18
#: The query adds its documents to the index in so many batches; runs of one level are compacted from FAN on.
BATCHES, FAN = 4, 3
#: Ranges of window hashes that each task works through, one at a time.
PER_TASK = 4
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<u4"), ("at", "<u4")])
_ALONE = np.uint32(2**32 - 1)


def elected(b: Block, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its elected gram's first word, its hash) of the windows in a block."""
    at, _ = whole(b.first, window)
    if not len(at):
        return at, at, np.empty(0, U64)
    g = grams(b.word_hashes(), gram)
    # 42 bits of hash to compare, then the place from the end, so the last of equals wins; a block has far fewer than 2**22 words, or they are numbered anew
    spread = window - gram + 1
    low = U64((1 << 22) - 1)
    key = (g & ~low) | (low - (np.arange(len(g), dtype=np.uint64) & low))
    span, best = 1, key
    while span * 2 <= spread:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    best = np.minimum(best[: len(key) - spread + 1], best[spread - span : spread - span + len(key) - spread + 1]) if spread > span else best
    place = ((low - (best[at] & low)) & low).astype(np.int64)
    # the place is known modulo 2**22
    place += (at - place + (1 << 22) - 1) >> 22 << 22
    return at, place, g[place]


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value per stretch of the array."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.dtype.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def digests(text: bytes, at: list[int], window: int) -> np.ndarray:
    """64 bits of BLAKE2 of the words, joined by one space, of the windows that start at these words of a text."""
    words = text.split()
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    f = hashlib.blake2b
    cut = zip(start[at].tolist(), end[np.array(at) + window - 1].tolist(), strict=True)
    return np.frombuffer(b"".join(f(line[s:e], digest_size=8).digest() for s, e in cut), U64)


def _elections(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, gram) of each gram that a document's windows elect, once per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(batch.column(1)):
                at, place, h = elected(b, window, gram)
                one = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(at) else at
                owner = np.searchsorted(b.first, at[one], "right") - 1
                keys = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys[owner].astype(np.int64)), pa.array(h[one].view(np.int64))], ["key", "gram"])

    return lean(docs.select("key", "text")).mapInArrow(run, "key long, gram long")


def _runs(held: DataFrame, n: int, hot: np.ndarray, window: int, gram: int) -> DataFrame:
    """(range, docs, entries, key): a task's windows that can repeat, as a run per range: the keys of its documents, and its
    entries sorted by hash.  Where ``key`` is set the entries are places of windows that repeat within the run, found at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[np.ndarray] = []
        ranges: list[np.ndarray] = []
        keys: list[int] = []
        count = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal entries, ranges, keys, count
            e = np.concatenate(entries) if entries else np.empty(0, _ENTRY)
            part = np.concatenate(ranges) if ranges else np.empty(0, np.int64)
            order = np.lexsort((e["b"], e["a"], part))
            e, part = e[order], part[order]
            new = np.concatenate(([True], (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1]))) if len(e) else np.empty(0, bool)
            group = np.cumsum(new) - 1
            twice = np.bincount(group, minlength=1)[group] > 1 if len(e) else new
            first = e[new].copy()
            first["doc"][twice[new]] = _ALONE
            cuts = np.searchsorted(part[new], np.arange(n + 1))
            some = np.flatnonzero(np.diff(cuts))
            edges = np.append(cuts[some], len(first))
            ids = np.array(keys, np.int64)
            doc_lists = []
            for i in range(len(some)):  # documents are numbered within each entry list, so only theirs are sent
                cut = first[edges[i] : edges[i + 1]]
                known = cut["doc"] != _ALONE
                u, back = np.unique(cut["doc"][known], return_inverse=True)
                cut["doc"][known] = back
                doc_lists.append(ids[u])
            off = np.concatenate(([0], np.cumsum([len(x) for x in doc_lists]))).astype(np.int64)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _binary(np.concatenate(doc_lists), off), _binary(first, edges), pa.nulls(len(some), pa.int64())], ["range", "docs", "entries", "key"])
            own = e[twice]
            own = own[np.lexsort((own["at"], own["doc"]))]
            if len(own):
                doc, at = np.unique(own["doc"], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array((doc % n).astype(np.int32)), pa.nulls(len(doc), pa.binary()), _binary(own["at"], np.append(at, len(own))), pa.array(ids[doc])], ["range", "docs", "entries", "key"])
            entries, ranges, keys, count = [], [], [], 0

        for whole_batch in batches:
            for batch in pieces(whole_batch, 1):
                sought = batch.column(2)
                values = sought.values.to_numpy().view(np.uint64)
                off = sought.offsets.to_numpy()
                for lo, hi, b in blocks(batch.column(1)):
                    at, _, h = elected(b, window, gram)
                    owner = np.searchsorted(b.first, at, "right") - 1
                    # one sorted list of (document, gram) for the block: grams are looked up by document
                    held_grams = np.concatenate([np.sort(values[off[i] : off[i + 1]]) for i in range(lo, hi)]) if hi > lo else values[:0]
                    top = np.repeat(np.arange(hi - lo), off[lo + 1 : hi + 1] - off[lo:hi])
                    code = np.unique(_code(held_grams, top))
                    ask = _code(h, owner)
                    hit = np.searchsorted(code, ask)
                    may = (hit < len(code)) & (code[np.minimum(hit, len(code) - 1)] == ask) if len(code) else np.zeros(len(ask), bool)
                    w = at[may]
                    if len(w):
                        e = np.empty(len(w), _ENTRY)
                        e["a"] = grams(b.word_hashes(BASES[0]), window, BASES[1])[w]
                        mine = owner[may]
                        edge = np.searchsorted(mine, np.arange(len(b) + 1))
                        e["b"] = np.concatenate([digests(b.text(i), (w[edge[i] : edge[i + 1]] - b.first[i]).tolist(), window) for i in np.unique(mine).tolist()])
                        e["doc"] = len(keys) + mine
                        e["at"] = w - b.first[mine]
                        entries.append(e)
                        g = h[may]
                        at_hot = np.minimum(np.searchsorted(hot, g), max(0, len(hot) - 1))
                        many = hot[at_hot] == g if len(hot) else np.zeros(len(g), bool)
                        # elected grams are minima, so their hashes are small: mixed once more they cover all ranges alike
                        ranges.append(((np.where(many, e["a"], mix(g)) >> U64(32)) * U64(n) >> U64(32)).astype(np.int64))
                        count += len(e)
                    keys += batch.column(0).slice(lo, hi - lo).to_pylist()
                    if count >= RUN:
                        yield from close()
        yield from close()

    return lean(held).mapInArrow(run, "range int, docs binary, entries binary, key long")


def _code(gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return gram ^ ((doc.astype(np.uint64) + U64(1)) * U64(BASES[2]))


def _merged(runs: DataFrame, n: int) -> DataFrame:
    """(key, places): where windows of a document start that repeat, from the runs of each hash range."""

    def merge(runs_: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x for x, _ in runs_])
        base = np.concatenate(([0], np.cumsum([len(x) for x, _ in runs_])))
        e = np.concatenate([x for _, x in runs_])
        doc = e["doc"].astype(np.int64) + np.repeat(base[:-1], [len(x) for _, x in runs_])
        alone = e["doc"] == _ALONE
        order = np.lexsort((e["b"], e["a"]))
        a, b = e["a"][order], e["b"][order]
        same = np.zeros(len(e) + 1, bool)
        same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        again = np.empty(len(e), bool)
        again[order] = same[:-1] | same[1:]
        pick = again & ~alone
        d, at = doc[pick], e["at"][pick]
        o = np.lexsort((at, d))
        d, at = d[o], at[o]
        u, start = np.unique(d, return_index=True)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(ids[u]), _binary(at, np.append(start, len(at)))], ["key", "places"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = -1
        for batch in batches:
            for r, docs, entries, key in zip(*(c for c in batch.columns), strict=True):
                if key.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), pa.array([entries.as_py()], pa.binary())], ["key", "places"])
                    continue
                if r.as_py() != now and held:
                    yield from merge(held)
                    held = []
                now = r.as_py()
                held.append((np.frombuffer(docs.as_py(), np.int64), np.frombuffer(entries.as_py(), _ENTRY)))
        if held:
            yield from merge(held)

    return runs.repartitionById(n, F.col("range") % n).sortWithinPartitions("range").mapInArrow(join, "key long, places binary")


class WindowIndex:
    """Fingerprints of the windows of earlier batches, as sorted immutable runs in a folder that all machines share.

    A run is a table (gram, c), bucketed and sorted by gram, in a folder named for the batches that it covers.  A folder counts
    from when it has been written whole (its _SUCCESS); what a lost driver leaves behind is passed over, and so are runs that
    a compacted one covers.  With ``keep``, each batch's places (key, gram) are kept too, which later batches need to find
    the earlier documents that they repeat."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, keep: bool = True):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        known = [int(m[3]) for m in self._folders() if m[3]]
        self.buckets = known[0] if known else buckets or partitions(spark)

    def _folders(self) -> list[re.Match]:
        """The folders written whole: run-<first batch>-<last batch>-<buckets>-<name>, or places-<batch>-<batch>--<name>."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [x.getPath() for x in fs.listStatus(where)] if fs.exists(where) else []
        done = [str(p.getName()) for p in paths if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return [m for name in sorted(done) if (m := re.fullmatch(r"(?:run|places)-(\d+)-(\d+)-(\d*)-\w+", name))]

    def runs(self) -> list[tuple[int, int, str]]:
        """(first batch, last batch, folder) of the runs that count: of those that cover a batch, the longest, once."""
        found: list[tuple[int, int, str]] = []
        for lo, hi, name in sorted(((int(m[1]), int(m[2]), m[0]) for m in self._folders() if m[3]), key=lambda x: (x[0], -x[1], x[2])):
            if not found or hi > found[-1][1]:
                found.append((lo, hi, name))
        return found

    def _table(self, name: str) -> DataFrame:
        """A run as a table that knows its buckets."""
        table = "windrow_" + name.replace("-", "_")
        self.spark.sql(f"create table if not exists {table} (gram bigint, c bigint) using parquet clustered by (gram) sorted by (gram) into {self.buckets} buckets location '{self.path}/{name}'")
        return self.spark.table(table)

    def _write(self, rows: DataFrame, lo: int, hi: int) -> str:
        name = f"run-{lo:06d}-{hi:06d}-{self.buckets}-{uuid.uuid4().hex[:12]}"
        dealt = rows.select("gram", "c").repartition(self.buckets, "gram")
        dealt.write.bucketBy(self.buckets, "gram").sortBy("gram").option("path", f"{self.path}/{name}").saveAsTable("windrow_" + name.replace("-", "_"))
        return name

    def places(self) -> DataFrame:
        """(key, gram) of all batches, each once."""
        names = {(m[1], m[2]): m[0] for m in self._folders() if not m[3]}
        return self.spark.read.schema("key long, gram long").parquet(*(f"{self.path}/{x}" for x in names.values()))

    def add(self, elections: DataFrame) -> DataFrame:
        """(gram, c): the fingerprints of a batch (key, gram) that have been met twice or more by now, and how often."""
        earlier = self.runs()
        batch = earlier[-1][1] + 1 if earlier else 0
        if self.keep:
            elections.select("key", "gram").write.parquet(f"{self.path}/places-{batch:06d}-{batch:06d}--{uuid.uuid4().hex[:12]}")
        met = self._table(self._write(elections.groupBy("gram").agg(F.count("*").alias("c")), batch, batch))
        for k, (_, _, name) in enumerate(earlier):
            met = met.join(self._table(name).withColumnRenamed("c", f"c{k}").hint("merge"), "gram", "left")
        total = reduce(lambda x, k: x + F.coalesce(F.col(f"c{k}"), F.lit(0)), range(len(earlier)), F.col("c"))
        found = settled(met.select("gram", total.alias("c")).where("c > 1"))
        self.compact()
        return found

    def compact(self, fan: int = FAN) -> None:
        """Merge the last runs into one, while ``fan`` of them are of like length; a run covers at least as many batches as the next."""
        while True:
            runs = self.runs()
            tail = [r for r in runs if r[1] - r[0] <= runs[-1][1] - runs[-1][0]] if runs else []
            if len(tail) < fan:
                return
            rows = reduce(DataFrame.unionByName, (self._table(name) for _, _, name in tail))
            self._write(rows.groupBy("gram").agg(F.sum("c").alias("c")), tail[0][0], tail[-1][1])
            for _, _, name in tail:
                self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists windrow_{name.replace('-', '_')}")
        delete(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        """Delete the index."""
        for m in self._folders():
            self._drop(m[0])
        delete(self.spark, self.path)


def _verified(docs: DataFrame, places: DataFrame, twice: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, places array<binary>) of a table (doc_id, text, key): the starts, as 32-bit numbers, of windows that repeat, given
    the documents' elections and the grams (gram, c) elected twice or more."""
    n = partitions(docs.sparkSession)
    all_ = twice.agg(F.sum("c").alias("c")).first()["c"] or 0
    # no more than 4 * n grams have more than that share
    hot = np.sort(np.array([r["gram"] for r in twice.where(F.col("c") > max(1000, all_ / (4 * n))).select("gram").collect()], np.int64).view(np.uint64))
    sought = places.join(twice.select("gram"), "gram", "left_semi").groupBy("key").agg(F.collect_set("gram").alias("grams"))
    # doc_id goes along unused: with it, the texts are dealt out as the caller deals them out, once for both
    held = docs.join(sought, "key").select("key", "text", "grams", "doc_id")
    return _merged(_runs(held, PER_TASK * n, hot, window, gram), n).groupBy("key").agg(F.collect_list("places").alias("places"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key); rows equal in doc_id and text have one key."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(key, places array<binary>) of a table (doc_id, text, key), which goes through an index of its own, batch by batch."""
    spark = docs.sparkSession
    found = settled(_elections(docs, window, gram))
    index = WindowIndex(spark, f"{folder(spark)}/windrow-index-{uuid.uuid4().hex}", keep=False)
    met = [index.add(found.where(F.pmod("key", F.lit(batches)) == k)) for k in range(batches)]
    index.drop()
    # a gram's last batch has its whole count; a table of its own, so that both sides of the join to come are dealt out afresh
    twice = settled(reduce(DataFrame.unionByName, met).groupBy("gram").agg(F.max("c").alias("c")))
    for m in met:
        release(m)
    return _verified(docs, found, twice, window, gram)


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    A word goes if a window that covers it has a word sequence that also starts anywhere else, in the same document too.
    A null text has no words; a very long one is read whole; rows that repeat a document repeat its windows, so those go from
    each; an empty table gives an empty one; other columns are not looked at."""
    rows = keyed(docs)
    return _kept(rows.join(repeats(rows, window, gram, batches), "key", "left"), window)


def incremental(index: WindowIndex, history: DataFrame, batch: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The same of a new batch alone, whose windows are judged on it and on the ``history`` of documents that the index has; the
    batch is added to the index.  Of the history only documents with a fingerprint that the batch repeats are read again."""
    rows = keyed(batch)
    twice = index.add(settled(_elections(rows, window, gram)))
    return _kept(rows.join(_verified(keyed(history).unionByName(rows), index.places(), twice, window, gram), "key", "left"), window)


def _kept(rows: DataFrame, window: int) -> DataFrame:
    joined = rows.select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in pieces(whole_batch, 1):
                out: list[tuple[int, int, str]] = []
                for text, places in zip(batch.column(1), batch.column(2), strict=True):
                    words = text.as_py().encode().split() if text.is_valid else []
                    total = len(words)
                    if places.is_valid and total:
                        at = np.frombuffer(b"".join(places.as_py()), np.uint32)
                        cover = np.zeros(total + window + 1, np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        stay = np.cumsum(cover)[:total] == 0
                        words = [words[i] for i in np.flatnonzero(stay)]
                    out.append((total, total - len(words), b" ".join(words).decode()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))], ["doc_id", "n_words", "n_removed", "kept"])

    return lean(joined).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
