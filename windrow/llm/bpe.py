"""BPE encoding and decoding by speculation and verification.

Of each new word, greedy longest match proposes the tokens.  A sequence of tokens is the one that the merges make if
and only if the merges leave each two neighbours (and each token alone) as they are, so one vectorised look-up tests
all neighbours of all proposals at once; pairs not met before are merged exactly, once.  Only words with a pair that
fails undergo exact merging.  Encoded words are kept per worker, up to a bound.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .shared import lean, pieces

END = "</w>"
_KEEP_WORDS = 150_000
_KEEP_CHUNKS = 200_000
_KEEP_PAIRS = 1_000_000
#: Words of up to this many letters are merged all together, longer ones each with a heap of its own.
_TOGETHER = 64
#: The rank of two neighbours that no merge joins.
_NONE = 1 << 30


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Below this code point every character was assigned long ago, so that all versions of Unicode agree on it.
_SETTLED = "\u0530"


def lowered(text: str) -> str:
    """NFC, then each code point's own lower case (str.lower would look at a sigma's neighbours)."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


#: Python's str.split also cuts at these four, which are not white space to the pattern.
_SEPARATORS = regex.compile("[\\x1c-\\x1f]")
_STRETCH = regex.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def split(text: str) -> list[str]:
    return _STRETCH.findall(text) if _SEPARATORS.search(text) else text.split()


def cuts(raw: bytes, bounds: np.ndarray) -> list[bytes]:
    at = bounds.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def slices(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The ids between neighbouring bounds, four bytes each."""
    return cuts(ids.astype(np.int32).tobytes(), bounds * 4)


class Codec:
    """The vocabulary, merges, special tokens and split pattern of a tokenizers file of this kind."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in steps]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError("a BPE with word ends, NFC, lower case, a split pattern and byte letters is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.size = max(self.text_of) + 1
        self.table = [self.text_of.get(i, "") for i in range(self.size)]
        #: Letters and word ends as one symbol each: the end mark is one private letter here.
        self.mark = "\ue000"
        self.marked = [self.inner(s) for s in self.table]
        self.whole = {self.inner(s): i for s, i in self.vocab.items()}
        #: Of two neighbours (20 bits each): the merge's rank and, in the low 20 bits, the token that it makes.
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: r << 20 | self.vocab[a + b] for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        order = sorted(self.rank)
        self.merge_codes = np.array(order, np.int64)
        self.merge_ranks = np.array([self.rank[x] >> 20 for x in order], np.int64)
        self.merge_makes = np.empty(len(order), np.int64)
        self.merge_makes[self.merge_ranks] = [self.rank[x] & (1 << 20) - 1 for x in order]
        self.letters = byte_letters()
        #: The id of each letter by code point, and of each letter that ends a word.
        self.inside, self.final = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for c in self.letters:
            self.inside[ord(c)], self.final[ord(c)] = self.whole[c], self.whole[c + self.mark]
        self.letter_map = {b: c for b, c in enumerate(self.letters)}
        self.byte_of = {ord(c): b for b, c in enumerate(self.letters)}
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        #: The library's own tables of characters, for stretches with a character that Python's may not know.
        self.library = Tokenizer.from_str(definition)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.matcher = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.matcher.add_word(t, i)
        self.matcher.add_word(self.mark, -1)  # a token has taken all but the mark: no proposal
        self.matcher.make_automaton()
        self.pairs_known = np.empty(0, np.int64)
        self.pairs_good = np.empty(0, bool)

    def pieces(self, stretch: str) -> list[str]:
        """The words of a stretch without white space, by the library's tables."""
        return [w.translate(self.byte_of).encode("latin-1").decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(stretch))]

    def spelled(self, word: str) -> str:
        """The word in byte letters."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letter_map)

    def inner(self, token: str) -> str:
        return token[: -len(END)] + self.mark if token.endswith(END) and token != END else token

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words' letters, a letter before a mark with the word's end, and how many letters each word has."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        mark = code == ord(self.mark)
        ends, code = np.append(mark[1:], False), np.minimum(code, 511)
        count = np.fromiter((len(w) - (w[-1] == self.mark) for w in words), np.int64, len(words))
        return np.where(ends, self.final[code], self.inside[code])[~mark], count

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging: the pair of least rank, leftmost first, until none can be merged.

        Neighbours are linked and pairs wait in a heap, so a word of n letters takes n log n steps; a pair whose letters have
        been merged away since is passed over."""
        get, ids, low = self.rank.get, list(ids), (1 << 20) - 1
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j] = r & low, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := get(ids[i] << 20 | ids[k])) is not None:
                    heappush(heap, (r, i))
            if (h := left[i]) >= 0 and (r := get(ids[h] << 20 | ids[i])) is not None:
                heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.merge_codes, code), len(self.merge_codes) - 1)
        return np.where(self.merge_codes[at] == code, self.merge_ranks[at], _NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): exact merging of many words at once, word k's tokens between bounds k and k + 1.

        Each round merges in every word that still can the pair of least rank, the leftmost of equal ones, and looks up
        only the two pairs that this changes; words without a pair to merge leave the arrays."""
        ids, count = self.symbols(words)
        word, long = np.repeat(np.arange(len(words)), count), count > _TOGETHER
        done_ids, done_word = [], []
        for k in np.flatnonzero(long).tolist():
            done_ids.append(np.array(self.merged(ids[word == k].tolist()), np.int64))
            done_word.append(np.full(len(done_ids[-1]), k))
        short = ~long[word]
        ids, word = ids[short], word[short]
        rank = np.full(len(ids), _NONE)
        if len(ids):
            rank[:-1] = np.where(word[1:] == word[:-1], self.ranks(ids[:-1], ids[1:]), _NONE)
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            live = best >> 32 < _NONE
            if not live.all():
                stay = np.repeat(live, np.diff(np.append(starts, len(ids))))
                done_ids.append(ids[~stay])
                done_word.append(word[~stay])
                ids, word, rank = ids[stay], word[stay], rank[stay]
                continue
            at = best & (1 << 32) - 1
            ids[at] = self.merge_makes[best >> 32]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, word, rank = ids[stay], word[stay], rank[stay]
            at -= np.arange(len(at))
            rank[at] = _NONE
            before, behind = at[(at > 0) & (word[at - 1] == word[at])], at[(at < len(ids) - 1) & (word[np.minimum(at + 1, len(ids) - 1)] == word[at])]
            rank[before - 1] = self.ranks(ids[before - 1], ids[before])
            rank[behind] = self.ranks(ids[behind], ids[behind + 1])
        word = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
        ids = np.concatenate(done_ids) if done_ids else np.empty(0, np.int64)
        return ids[np.argsort(word, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))

    def fits(self, codes: np.ndarray) -> np.ndarray:
        """For each code left * size + right (a token alone: left = size) whether the merges leave it as it is."""
        unique, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.pairs_known, unique)
        new = (at == len(self.pairs_known)) | (self.pairs_known[np.minimum(at, len(self.pairs_known) - 1)] != unique) if len(self.pairs_known) else np.ones(len(unique), bool)
        if new.any():
            fresh = unique[new]
            if len(self.pairs_known) > _KEEP_PAIRS:
                self.pairs_known, self.pairs_good = np.empty(0, np.int64), np.empty(0, bool)
                return self.fits(codes)
            known, self_good = np.concatenate((self.pairs_known, fresh)), np.concatenate((self.pairs_good, self.kept(fresh // self.size, fresh % self.size)))
            order = np.argsort(known)
            self.pairs_known, self.pairs_good = known[order], self_good[order]
        return self.pairs_good[np.searchsorted(self.pairs_known, unique)][back]

    def kept(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges make exactly these two tokens (the right one alone: left = size) of their letters."""
        two = left < self.size
        ids, bounds = self.merge([self.marked[a] + self.marked[b] if a < self.size else self.marked[b] for a, b in zip(left.tolist(), right.tolist(), strict=True)])
        same = (np.diff(bounds) == 1 + two) & (ids[bounds[1:] - 1] == right)
        return same & (~two | (ids[bounds[:-1]] == left))

    def learn(self, words: set[str]) -> None:
        """Encode words into self.words."""
        todo = list(words)
        marked = [self.spelled(w) + self.mark for w in todo]
        found = np.fromiter(chain.from_iterable(self.matcher.iter_long("".join(marked))), np.int64).reshape(-1, 2)
        last = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked))) - 1
        ids, first = found[:, 1], np.concatenate(([0], np.searchsorted(found[:, 0], last, "right")))
        stuck = np.concatenate(([0], np.cumsum(ids < 0)))
        ids = np.maximum(ids, 0)
        left = np.concatenate(([self.size], ids[:-1])) if len(ids) else ids
        left[first[:-1]] = self.size
        alone = np.full(len(ids), self.size)
        good = self.fits(np.concatenate((left * self.size + ids, alone * self.size + ids)))
        bad = np.concatenate(([0], np.cumsum(~(good[: len(ids)] & good[len(ids) :]))))
        ok = ((bad[first[1:]] - bad[first[:-1]]) == 0) & (stuck[first[1:]] == stuck[first[:-1]])
        self.words.update(zip(todo, slices(ids, first), strict=True))
        if wrong := np.flatnonzero(~ok).tolist():
            self.words.update(zip([todo[k] for k in wrong], slices(*self.merge([marked[k] for k in wrong])), strict=True))

    def cut_all(self, stretches: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of stretches without white space, and how many each has: all in one go, but for those with newer characters."""
        settled = [w.isascii() or max(w) < _SETTLED for w in stretches]
        text = lowered(" ".join([w for w, s in zip(stretches, settled, strict=True) if s]))
        words, count = self.split.findall(text), np.zeros(len(stretches), np.int64)
        length = lambda parts: np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        ends, upto = length(words), length(text.split(" ") if any(settled) else [])
        if len(upto) and (not len(ends) or ends[-1] != upto[-1]):  # the pattern leaves characters out
            cut = list(map(self.split.findall, text.split(" ")))
            words, count[settled] = list(chain.from_iterable(cut)), np.fromiter(map(len, cut), np.int64, len(cut))
        else:
            count[settled] = np.diff(np.searchsorted(ends, upto, "right"), prepend=0)
        if all(settled):
            return words, count
        out, at = [], 0
        for k, (w, s, n) in enumerate(zip(stretches, settled, count.tolist(), strict=True)):
            mine = words[at : at + n] if s else self.pieces(w)
            at, count[k] = at + n, len(mine)
            out += mine
        return out, count

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text.  No match of the pattern holds white space, so a stretch without it is encoded once and kept."""
        parts: list[list[list[str] | int]] = []
        for t in texts:
            row: list[list[str] | int] = []
            if t and self.cut and "<" in t:
                at = 0
                for m in self.cut.finditer(t):
                    row += [split(t[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                t = t[at:]
            row.append(split(t) if t else [])
            parts.append(row)
        seen = set().union(*(p for row in parts for p in row if not isinstance(p, int)))
        if len(self.chunks) > _KEEP_CHUNKS:
            self.chunks = {w: self.chunks[w] for w in seen if w in self.chunks}
        if fresh := [w for w in seen if w not in self.chunks]:
            words, count = self.cut_all(fresh)
            needed = set(words)
            if len(self.words) > _KEEP_WORDS:
                self.words = {w: self.words[w] for w in needed if w in self.words}
            if unseen := needed.difference(self.words):
                self.learn(unseen)
            raw = list(map(self.words.__getitem__, words))
            upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
            self.chunks.update(zip(fresh, cuts(b"".join(raw), upto[np.concatenate(([0], np.cumsum(count)))]), strict=True))
        get = self.chunks.__getitem__
        return [np.frombuffer(b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in row), np.int32) for row in parts]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.table.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(definition: str) -> Codec:
    return Codec(definition)


def encoded(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the tokens of each whole text and what they decode to.

    ``path`` is a tokenizers file, read on the driver and sent along (a few MB whatever the input).  A null text counts
    as empty and has no tokens; special tokens written in a text are those tokens.  Of merges of one rank the leftmost is made
    first.  A very long text or word is encoded whole, in time that grows with its length times the logarithm of it.  Rows
    that repeat are rows of their own; an empty table gives an empty one; other columns are not looked at."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for whole in batches:
            for b in pieces(whole, 1):
                ids = c.encode(b.column(1).to_pylist())
                off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                text = pa.array([c.decode(x) for x in ids] if decode else [None] * len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), lists, text], ["doc_id", "ids", "decoded"])

    return lean(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
