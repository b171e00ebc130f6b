"""Secret scans: fixed patterns, and password guess costs of values in a credential's context.

A value that stands behind a credential word is a secret where guessing it is costly.  Its cost, as a power of ten, is
that of the cheapest way to compose it, left to right, of dictionary words (with capitals and look-alike signs), dates,
repeats, keyboard walks, ascending or descending runs, and stretches of brute force; dynamic programming over the
positions finds it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import lean, pieces

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Words before a value that make it a credential, and what may stand between; the value itself is group 1.
_CONTEXT = re.compile(
    r"""(?ai:(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|auth|bearer|credentials?|(?:(?:api|access|private|secret)[_ -]?)+key)(?:[_-](?:access|secret|private|api|key|token|value))*)["']?(?:\x20+is\x20+|\x20*(?::=|=>|[:=])\x20*|\x20+)["'`]?([^\s"'`,;<>|]{6,})"""
)
#: A bearer or pass word followed by a blank alone is mostly prose: there a value needs a digit and a letter.
_SIGN = re.compile(r"[:=]|\bis\b")
#: Guesses, as a power of ten, from which a value counts as a secret.
COSTLY = 10.0
#: Signs of a long value that are composed at a time, as repeats make the time grow with the square.
WINDOW = 256

# Words often used in passwords, by rank.
WORDS = """password pass admin root user login welcome secret master letmein dragon monkey shadow sunshine princess
football baseball superman batman trustno hello freedom whatever qwerty iloveyou love baby angel michael jordan
summer winter spring autumn monday friday sunday january april june july august december test guest default changeme
server system service database access private public token key example sample demo dummy placeholder company office
money flower cookie orange purple silver golden hunter killer tiger lion eagle falcon mustang ferrari computer internet
google apple samsung chocolate chicken pepper ginger cheese banana starwars pokemon matrix""".split()
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
# Look-alike signs of letters.
ALIKE = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

RANKS = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)


def dictionary(path: str) -> dict[str, int]:
    """Words by rank: WORDS, then the words of three letters or more of a tokenizers file with word ends, in order of their ids,
    which is that of how early they were merged.  Some ten thousands whatever the input."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    more = (t.removesuffix("</w>") for t, _ in sorted(vocab.items(), key=lambda x: x[1]) if t.endswith("</w>"))
    return {w: i + 1 for i, w in enumerate(dict.fromkeys((*WORDS, *(w for w in more if len(w) > 2 and w.isascii() and w.isalpha()))))}


@lru_cache(maxsize=1)
def _near() -> set[str]:
    """Pairs of neighbouring keys, in both directions and between rows."""
    at = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {a + b for a, (x, y) in at.items() for b, (u, v) in at.items() if a != b and abs(y - v) <= 1 and abs(x - u) <= 1}


def _base(part: str) -> int:
    """How many signs brute force has to try at each place."""
    kinds = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    size = sum(n for f, n in kinds if any(f(c) for c in part))
    return size + (33 if any(not (c.isalnum() and c.isascii()) for c in part) else 0)


def guess_cost(value: str, ranks: Mapping[str, int] = RANKS, _known: dict[str, float] | None = None) -> float:
    """The least logarithm to base 10 of the guesses that reach the value."""
    known = {} if _known is None else _known
    if value in known:
        return known[value]
    n, near, longest = len(value), _near(), max(map(len, ranks), default=0)
    low = value.lower()
    plain = "".join(ALIKE.get(c, c) for c in low)
    size = math.log10(max(2, _base(value)))
    best = [0.0] + [math.inf] * n
    ends: dict[int, list[int]] = {}
    for m in (x for i in range(n) if value[i].isdigit() for x in [_DATE.match(value, i)] if x):
        ends.setdefault(m.start(), []).append(m.end())

    def reach(i: int, j: int, cost: float) -> None:
        best[j] = min(best[j], best[i] + cost)

    join = math.log10(2)  # each part more doubles the ways to order parts
    for i in range(n):
        c = join if i else 0.0
        reach(i, i + 1, size)  # brute force, a sign at a time
        for j in range(i + 3, min(n, i + longest) + 1):
            for form in {low[i:j], plain[i:j]}:
                if form in ranks:
                    capitals = sum(map(str.isupper, value[i:j]))
                    signs = sum(a != b for a, b in zip(low[i:j], form, strict=True))
                    reach(i, j, c + math.log10(ranks[form] + 1) + (0 if not capitals else join if capitals in (1, j - i) else math.log10(math.comb(j - i, capitals) + 1)) + signs * join)
        for j in ends.get(i, ()):
            reach(i, j, c + math.log10(365 * 120) if j - i > 4 else c + math.log10(120))
        j = i + 1
        while j < n and low[j - 1] + low[j] in near:
            j += 1
            if j - i >= 4:
                reach(i, j, c + math.log10(47 * 4) + (j - i - 2) * join)
        for step in (1, -1):
            j = i + 1
            while j < n and ord(value[j]) - ord(value[j - 1]) == step and value[i].isalnum():
                j += 1
                if j - i >= 3:
                    reach(i, j, c + math.log10(26 * 2 * (j - i)))
        units: list[int] = []
        for width in range(1, (n - i) // 2 + 1):
            # a unit that is itself a repeat tells nothing more
            if value[i] != value[i + width] or any(width % u == 0 for u in units) or not value.startswith(value[i : i + width], i + width):
                continue
            units.append(width)
            unit, j = value[i : i + width], i + width
            each = min(width * size, guess_cost(unit, ranks, known))
            while value.startswith(unit, j):
                j += width
                reach(i, j, c + each + math.log10((j - i) // width))
    known[value] = best[n]
    return best[n]


def costly(value: str, ranks: Mapping[str, int] = RANKS) -> bool:
    """Whether the value, or a window of it where it is long, takes COSTLY guesses; half of a window overlaps the next."""
    known: dict[str, float] = {}
    return any(guess_cost(value[i : i + WINDOW], ranks, known) >= COSTLY for i in range(0, max(1, len(value) - WINDOW // 2), WINDOW // 2))


def spans(text: str, ranks: Mapping[str, int] = RANKS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """((start, kind, end) of the fixed patterns, of the costly values), each by start and kind; code points, end exclusive."""
    base: list[tuple[int, int, int]] = []
    lower = text.lower() if text else ""
    if "pass" in lower or "secret" in lower or "token" in lower or "api" in lower:
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    more = []
    if any(k in lower for k in ("pass", "pwd", "pin", "secret", "token", "auth", "bearer", "credential", "key")):
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".):]}!?")
            if len(value) < 6 or not (_SIGN.search(text[m.start() : m.start(1)]) or (any(map(str.isdigit, value)) and any(map(str.isalpha, value)))):
                continue
            if costly(value, ranks):
                more.append((m.start(1), 3, m.start(1) + len(value)))
    return sorted(base), more


def scanned(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ``found``, an array of (kind, start, end, base) by start and kind, of each whole text.

    ``base`` tells the fixed patterns from what the guess costs add.  ``vocabulary`` is a tokenizers file with word ends, read on
    the driver, whose words count as guessable; without it, WORDS alone do.  A null or empty text has none; a very long text is
    scanned whole, and so is a very long value, by windows; spans that start at one place stand in the order of KINDS; rows that
    repeat are rows of their own; an empty table gives an empty one; other columns are not looked at."""
    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary) if vocabulary else RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            for piece in pieces(batch, 1):
                out, off = [], [0]
                for t in piece.column(1).to_pylist():
                    base, more = spans(t or "", ranks.value)
                    out += [{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, k, e in sorted(base + more)]
                    off.append(len(out))
                lists = pa.ListArray.from_arrays(pa.array(np.array(off, np.int32)), pa.array(out, kind))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["doc_id", "found"])

    return lean(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,base:boolean>>")
