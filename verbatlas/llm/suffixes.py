"""Exact removal of repeated strings by a distributed merge sort of suffixes.

Every string of ``LENGTH`` bytes that starts anywhere else too is removed, at each of its places.
To sort the suffix at each byte would cost many times the text, so suffixes start at anchors: of
the grams of ``GRAM`` bytes in a string of ``LENGTH`` bytes, the anchor is where the one of least
hash starts. Equal strings have their anchors at the same place, so two places of a string show as
two anchors, whose texts to the right and to the left agree far enough. An anchor that serves the
strings starting at ``low`` to ``high`` stands for the bytes low to high + LENGTH.

1. Anchors are written once. Their grams are counted; where a gram has one anchor only, its strings
   are not repeated.
2. The other anchors' suffixes (the text to the right, ``STOP``, then the text to the left read
   backwards) form sorted runs, a task's own. A run is front-coded: of each suffix the prefix known
   from the one before is left out. Runs are cut by the bytes that a group shares, and exchanged.
   Suffixes that a run has more than once are settled there and go on once.
3. A task combines its pieces of all runs with a loser tree that holds, for each loser, the prefix
   it shares with the winner; prefixes known to be equal are not compared again. Neighbours in the
   merged order that share enough are a group. Within it the prefixes from the merge say how far
   members agree to the right; members are joined from the longest prefix down, each time in order
   of the text to the left, where the neighbours agree the longest. If right and left together reach
   LENGTH, that is removed. Bytes decide, in groups of any size.
4. No task gets a group without bound. A group of one gram (level 0) has up to ``CROWD`` anchors; an
   anchor of a more frequent gram is dealt as blocks of strings instead, each a suffix from a later
   or earlier byte whose group shares more bytes (level 1), so that the groups of one gram part. Where
   a task has over ``LOCAL`` members of such a group, or the merge over ``CROWD``, its members are dealt
   once more, as single strings (level 2). Members of that group are equal, and a run has them once.
   A marker in the runs tells the merge that a task has dealt a group on, so that others follow.
"""

from __future__ import annotations

import zlib
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded, partitions, small_batches, tidied, unfolded, utf8, written

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1
#: How many strings a member of a group stands for at each level, and the bytes that its group shares.
WIDTHS = (SPAN, 28, 1)
CORES = tuple(LENGTH - w + 1 for w in WIDTHS)
#: Anchors of a gram, or members of a group in the merge, from which they are dealt to the next level.
CROWD = 4096
#: The same for members of a group in one run.
LOCAL = 64
#: Parts the text to the right from the text to the left; UTF-8 does not have it.
STOP = b"\xff"
#: Bytes of text that are hashed at a time, and bytes of suffixes after which a run ends.
PIECE, RUN = 1 << 21, 1 << 25
LOW24 = np.uint64((1 << 24) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def byte_codes() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def gram_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of the n bytes from each place; longer ones are made from two that overlap in none."""
    h, m, out, done = byte_codes()[raw], 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & m:
                keep = len(raw) - done - m + 1
                if keep <= 0:
                    return np.zeros(0, np.uint64)
                out, done = h[:keep] if out is None else out[:keep] * power(m) + h[done : done + keep], done + m
            if 2 * m > n:
                return out
            if len(h) <= m:
                return np.zeros(0, np.uint64)
            h = h[:-m] * power(m) + h[m:]
            m *= 2


def blended(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def least(a: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    m = 1
    while 2 * m <= n:
        a, m = np.minimum(a[:-m], a[m:]), 2 * m
    return np.minimum(a[: len(a) - (n - m)], a[n - m :]) if n > m else a


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of the texts: which text, anchor, low and high in it, hash of the gram."""
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            raw = t if len(t) <= PIECE + LENGTH else t[at : at + PIECE + LENGTH - 1]
            part.append((k, at, raw))
            size += len(raw)
            if size >= PIECE:
                yield _anchored(part)
                part, size = [], 0
            if raw is t:
                break
    if part:
        yield _anchored(part)


def _anchored(part: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
    sizes = np.array([len(p[2]) for p in part])
    begins = np.cumsum(sizes) - sizes
    h = gram_hashes(raw, GRAM)
    key = blended(h) & ~LOW24 | np.arange(len(h), dtype=np.uint64)
    at = (least(key, SPAN) & LOW24).astype(np.int64)
    valid = np.zeros(len(at), bool)
    for s, n in zip(begins.tolist(), sizes.tolist(), strict=True):
        valid[s : s + n - LENGTH + 1] = True
    starts = np.flatnonzero(valid)
    at = at[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    low, high, x = starts[new], starts[np.r_[new[1:], len(starts)] - 1], at[new]
    which = np.searchsorted(begins, low, "right") - 1
    shift = np.array([p[1] for p in part])[which] - begins[which]
    return np.array([p[0] for p in part])[which], x + shift, low + shift, high + shift, h[x]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


class Run:
    """A sorted run: ``strings`` front-coded as (prefix kept, rest), and what belongs to each."""

    def __init__(self, strings: list[bytes], right: list[int], doc: list[int], low: list[int], docs: list[tuple[int, int]]):
        self.strings, self.right, self.doc, self.low, self.docs = strings, right, doc, low, docs

    def coded(self) -> bytes:
        prefix, rest, before = [], [], b""
        for s in self.strings:
            k = common(before, s)
            prefix.append(k)
            rest.append(s[k:])
            before = s
        head = np.array([len(self.strings), len(self.docs)], "<u4").tobytes()
        numbers = [np.array(x, t).tobytes() for x, t in ((prefix, "<u2"), (list(map(len, rest)), "<u2"), (self.right, "<u2"), (self.doc, "<u4"), (self.low, "<i8"), (self.docs, "<i8"))]
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(numbers) + b"".join(rest))


class Coded:
    """A run as it comes: one suffix at a time, with the prefix it shares with the one before."""

    def __init__(self, blob: bytes):
        raw, at = zstandard.ZstdDecompressor().decompress(blob), 8
        n, m = np.frombuffer(raw[:8], "<u4").tolist()
        fields = []
        for t, k in (("<u2", n), ("<u2", n), ("<u2", n), ("<u4", n), ("<i8", n), ("<i8", 2 * m)):
            width = np.dtype(t).itemsize * k
            fields.append(np.frombuffer(raw[at : at + width], t).tolist())
            at += width
        self.prefix, self.size, self.right, self.doc, self.low, docs = fields
        self.docs = list(zip(docs[::2], docs[1::2], strict=True))
        self.raw, self.at, self.k, self.n, self.string, self.shared = raw, at, -1, n, b"", 0

    def next(self) -> bool:
        self.k += 1
        if self.k == self.n:
            self.string = None
            return False
        self.shared, end = self.prefix[self.k], self.at + self.size[self.k]
        self.string = self.string[: self.shared] + self.raw[self.at : end]
        self.at = end
        return True


def merged(runs: list[Coded]) -> Iterator[tuple[bytes, int, int, tuple[int, int], int]]:
    """All suffixes in order: string, prefix shared with the one before, bytes to the right, document, low.

    A loser tree over the runs. A node holds the run that lost there and the prefix it shares with
    the one that won, which is the string last given out when the node is next asked. Of two
    contenders the one that shares more with that string is the smaller, unseen; only if both share
    the same are they compared, from there on.
    """
    runs = [r for r in runs if r.next()]
    size = 1
    while size < len(runs):
        size *= 2
    loser, shared = [-1] * size, [0] * size

    def beats(a: int, b: int, known: int) -> tuple[bool, int]:
        x, y = runs[a].string, runs[b].string
        k = common(x, y, known)
        if k == len(x) or k == len(y):
            return (len(x), runs[a].right[runs[a].k]) <= (len(y), runs[b].right[runs[b].k]), k
        return x[k] < y[k], k

    def played(node: int) -> int:
        if node >= size:
            return node - size if node - size < len(runs) else -1
        a, b = played(2 * node), played(2 * node + 1)
        if a < 0 or b < 0:
            loser[node] = -1
            return max(a, b)
        first, k = beats(a, b, 0)
        loser[node], shared[node] = (b, k) if first else (a, k)
        return a if first else b

    if not runs:
        return
    winner, prefix = played(1), 0
    while winner >= 0:
        r = runs[winner]
        yield r.string, prefix, r.right[r.k], r.docs[r.doc[r.k]], r.low[r.k]
        leaf = winner
        if r.next():
            prefix = r.shared
        else:
            winner, prefix = -1, -1
        node = (leaf + size) // 2
        while node:
            other = loser[node]
            if other >= 0:
                k = shared[node]
                if winner < 0 or k > prefix:
                    loser[node], shared[node] = winner, max(prefix, 0)
                    winner, prefix = other, k
                elif k == prefix:
                    first, both = beats(winner, other, k)
                    if first:
                        shared[node] = both
                    else:
                        loser[node], shared[node] = winner, both
                        winner = other
            node //= 2


def windows(string: bytes, right: int, low: int, level: int) -> Iterator[tuple[bytes, int, int]]:
    """The strings that a suffix stands for, dealt in blocks of a level: suffix, bytes to the right, low of each."""
    left, width = len(string) - 1 - right, WIDTHS[level]
    text = string[right + 1 :][::-1] + string[:right]
    high = len(text) - LENGTH
    for k in range((left - high) // width, left // width + 1):
        at = left - k * width
        first, last = max(0, at - width + 1), min(high, at)
        yield text[at : last + LENGTH] + STOP + text[first:at][::-1], last + LENGTH - at, low + first


class Held:
    """Suffixes of a task until they go on as runs, and the spans that it has settled."""

    def __init__(self, parts: int, limits: tuple[int, int, int]):
        self.parts = parts
        self.most, self.most_here, self.full = limits
        self.known: list[dict[tuple[bytes, int], list]] = [{} for _ in CORES]
        self.crowd: dict[tuple[bytes, int], list] = {}
        self.size = [0] * len(CORES)
        self.spans: dict[tuple[int, int], list] = defaultdict(list)
        self.settled = 0

    def settle(self, doc: tuple[int, int], low: int, end: int) -> None:
        self.spans[doc].append((low, end))
        self.settled += 1

    def put(self, level: int, string: bytes, right: int, doc: tuple[int, int], low: int, crowd: bool = False) -> None:
        """One that is there already, from another place, is settled with it."""
        held = self.crowd if crowd else self.known[level]
        known = held.get((string, right))
        if known is None:
            held[string, right] = [doc, low, False]
            self.size[level] += len(string)
        elif (known[0], known[1]) != (doc, low):
            self.settle(doc, low, low + len(string) - 1)
            if not known[2]:
                known[2] = True
                self.settle(known[0], known[1], known[1] + len(string) - 1)

    def run(self, level: int) -> Iterator[pa.RecordBatch]:
        held, self.known[level], self.size[level] = self.known[level], {}, 0
        by_part: dict[int, list] = defaultdict(list)
        for key in held:
            by_part[zlib.crc32(key[0][: CORES[level]]) % self.parts].append(key)
        for part, keys in by_part.items():
            keys.sort()
            own: dict[tuple[int, int], int] = {}
            doc = [own.setdefault(held[k][0], len(own)) for k in keys]
            blob = Run([k[0] for k in keys], [k[1] for k in keys], doc, [held[k][1] for k in keys], list(own)).coded()
            yield _rows([part], [level], [blob], [0], [0], [None])

    def dealt_on(self, string: bytes, right: int, doc: tuple[int, int], low: int) -> None:
        for s, r, first in windows(string, right, low, 2):
            self.put(2, s, r, doc, first)

    def runs(self) -> Iterator[pa.RecordBatch]:
        """All that is held. Crowded anchors are dealt in blocks, and where their blocks crowd, in strings."""
        crowd, self.crowd = self.crowd, {}
        for (string, right), (doc, low, _) in crowd.items():
            for s, r, first in windows(string, right, low, 1):
                self.put(1, s, r, doc, first)
        del crowd
        blocks = self.known[1]
        hot = {c for c, n in Counter(s[: CORES[1]] for s, _ in blocks).items() if n > self.most_here}
        for key in [k for k in blocks if k[0][: CORES[1]] in hot]:
            doc, low, _ = blocks.pop(key)
            self.dealt_on(*key, doc, low)
            if self.size[2] >= self.full:
                yield from self.run(2)
        for c in hot:
            blocks[c, len(c)] = [(0, 0), -1, False]
        for level in range(len(CORES)):
            yield from self.run(level)
        yield from self.found()

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.spans:
            spans, self.spans, self.settled = self.spans, defaultdict(list), 0
            lists = [united(x) for x in spans.values()]
            yield _rows([d[0] % self.parts for d in spans], [-1] * len(lists), [None] * len(lists), [d[0] for d in spans], [d[1] for d in spans], lists)


def united(spans: list[tuple[int, int]]) -> list[int]:
    """The union of spans, as from, to, from, to."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


#: What is exchanged: pieces of runs, and spans of documents (level -1).
ROWS = "part int, level int, blob binary, k1 long, k2 long, spans array<long>"


def _rows(*columns: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "level", "blob", "k1", "k2", "spans"])


class Group:
    """Members of a group in order, as [suffix, prefix shared with the one before, bytes to the right, document, low, settled]."""

    def __init__(self, held: Held, level: int):
        self.held, self.level, self.rows, self.crowded = held, level, [], False

    def add(self, string: bytes, shared: int, right: int, doc: tuple[int, int], low: int) -> None:
        if low < 0:
            self.crowded = True
            return
        if self.rows:
            last = self.rows[-1]
            if shared == len(string) == len(last[0]) and last[2] == right:
                if (last[3], last[4]) != (doc, low):
                    self.held.settle(doc, low, low + len(string) - 1)
                    if not last[5]:
                        last[5] = True
                        self.held.settle(last[3], last[4], last[4] + len(string) - 1)
                return
        self.rows.append([string, shared, right, doc, low, False])
        if self.level == 1 and (self.crowded or len(self.rows) > self.held.most):
            # the last one stays, for the next to be compared with it
            self.crowded = True
            for r in self.rows[:-1]:
                self.held.dealt_on(r[0], r[2], r[3], r[4])
            del self.rows[:-1]

    def done(self) -> None:
        rows, self.rows = self.rows, []
        if self.crowded:
            self.crowded = False
            for r in rows:
                self.held.dealt_on(r[0], r[2], r[3], r[4])
        elif len(rows) == 2:
            self.compared(*rows, rows[1][1])
        elif len(rows) > 2:
            self._joined(rows)

    def _joined(self, rows: list) -> None:
        """Neighbours join from the longest shared prefix down; what joins meets its neighbours by the text to the left."""
        n = len(rows)
        lefts = [r[0][r[2] + 1 :] for r in rows]
        order = sorted(range(n), key=lefts.__getitem__)
        sets: list[list[int]] = [[] for _ in rows]
        for rank, i in enumerate(order):
            sets[i] = [rank]
        # a set of joined rows is known at both its ends, as they are in a row
        other = list(range(n))
        for i in sorted(range(1, n), key=lambda i: -rows[i][1]):
            first, last, shared = other[i - 1], other[i], rows[i][1]
            small, large = sets[i - 1], sets[i]
            if len(small) > len(large):
                small, large = large, small
            for rank in small:
                at = bisect(large, rank)
                for near in large[max(at - 1, 0) : at + 1]:
                    self.compared(rows[order[rank]], rows[order[near]], shared)
                large.insert(at, rank)
            other[first], other[last] = last, first
            sets[first] = sets[last] = large

    def compared(self, a: list, b: list, shared: int) -> None:
        right = min(shared, a[2], b[2])
        if a[5] and b[5] or right + min(len(a[0]) - a[2], len(b[0]) - b[2]) <= LENGTH:
            return
        left = common(a[0][a[2] + 1 :], b[0][b[2] + 1 :])
        if right + left >= LENGTH:
            at = [(r[3], r[4] + len(r[0]) - 1 - r[2]) for r in (a, b)]
            if at[0] != at[1]:
                for doc, x in at:
                    self.held.settle(doc, x - left, x + right)


ANCHORS = "k1 long, k2 long, grams array<long>, places array<long>"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text (or piece of a long one) the anchors: gram, and place with the strings before it that the anchor serves."""
    for b in batches:
        texts, k1, k2 = [utf8(t) for t in b.column("text").to_pylist()], b.column("k1").to_numpy(), b.column("k2").to_numpy()
        for which, x, low, high, gram in anchors(texts):
            if not len(which):
                continue
            cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True])
            own = which[cuts[:-1]]
            place = x << 17 | (x - low) << 9 | (x - high) << 1
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v)) for v in (gram.view(np.int64), place)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), *lists], ["k1", "k2", "grams", "places"])


def _run_rows(parts: int, limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(parts, limits)
        for b in batches:
            for text, k1, k2, places in zip(*(b.column(c).to_pylist() for c in ("text", "k1", "k2", "places")), strict=True):
                raw, doc = utf8(text), (k1, k2)
                for place in sorted(set(places)):
                    x = place >> 17
                    low, end = x - (place >> 9 & 255), x - (place >> 1 & 255) + LENGTH
                    held.put(place & 1, raw[x:end] + STOP + raw[low:x][::-1], end - x, doc, low, crowd=bool(place & 1))
                # what crowds is dealt as seven blocks
                if held.size[0] + 8 * held.size[1] >= held.full:
                    yield from held.runs()
        yield from held.runs()

    return run


def _merged_rows(parts: int, levels: tuple[int, ...], limits: tuple[int, int, int]):
    """Merges the runs of these levels; other rows pass on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(parts, limits)
        runs: dict[int, list[Coded]] = {k: [] for k in levels}
        for b in batches:
            mine = pc.is_in(b.column("level"), pa.array(levels, pa.int32()))
            if (rest := b.filter(pc.invert(mine))).num_rows:
                yield rest
            own = b.filter(mine)
            for level, blob in zip(own.column("level").to_pylist(), own.column("blob").to_pylist(), strict=True):
                runs[level].append(Coded(blob))
        for level in levels:
            group = Group(held, level)
            for string, shared, right, doc, low in merged(runs.pop(level)):
                if shared < CORES[level]:
                    group.done()
                    if held.settled > 50_000:
                        yield from held.found()
                group.add(string, shared, right, doc, low)
                if held.size[2] >= held.full:
                    yield from held.run(2)
            group.done()
        yield from held.runs()

    return run


def keyed(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a key of 128 bits of hash of id and text: rows that repeat both share it, and their fate."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), *extra, F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("k2"))


def spans(rows: DataFrame) -> DataFrame:
    """``(k1, k2, spans)`` of keyed rows: what is repeated, as lists of from, to, from, to; or -1, -1 for the whole row."""
    parts, limits = partitions(rows.sparkSession), (CROWD, LOCAL, RUN)
    anchored = written(rows.select("text", "k1", "k2").mapInArrow(tidied(_anchor_rows), ANCHORS), "anchors")
    found = anchored.select("k1", "k2", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("x.grams", "k1", "k2", "x.places")
    grams = written(found.groupBy("grams").agg(F.count("*").alias("n")).where("n > 1").select("grams", (F.col("n") > CROWD).cast("long").alias("crowd")), "grams")
    # a place's lowest bit tells whether its gram is crowded
    lists = found.join(grams, "grams").groupBy("k1", "k2").agg(F.collect_list(F.col("places").bitwiseOR(F.col("crowd"))).alias("places"))
    # rows with all their columns, so that the last join can use this exchange again
    out = rows.join(lists, ["k1", "k2"]).mapInArrow(tidied(_run_rows(parts, limits)), ROWS)
    for levels in ((0, 1), (2,)):
        out = out.repartitionById(parts, "part").mapInArrow(tidied(_merged_rows(parts, levels, limits)), ROWS)
    again = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where(f"n > 1 and size >= {LENGTH}")
    whole = F.array(F.lit(-1), F.lit(-1)).cast("array<long>")
    out = out.select("k1", "k2", "spans").union(again.select("k1", "k2", whole.alias("spans")))
    return out.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_bytes(raw: bytes, found: list[int] | None) -> tuple[bytes, int, int]:
    """What is left, how many bytes are removed and in how many runs."""
    if not found:
        return raw, 0, 0
    if -1 in found:
        return b"", len(raw), 1
    gone = united(list(zip(found[::2], found[1::2], strict=True)))
    left = b"".join([raw[a:b] for a, b in zip([0, *gone[1::2]], [*gone[::2], len(raw)], strict=True)])
    return left, len(raw) - len(left), len(gone) // 2


def removed(docs: DataFrame, extra: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, with ``extra`` columns and the ``kept`` text if asked
    (without what a cut leaves of a character).

    A null or empty text has no bytes. Texts under 200 bytes lose nothing. Matches never cross
    documents; a row that repeats another's id and text is another place of all its strings, as is
    any copy. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows, kinds = keyed(docs, extra), dict(docs.dtypes)
    found = spans(rows)
    names = ["doc_id", *extra, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [utf8(t) for t in b.column("text").to_pylist()]
            out = [kept_bytes(r, s) for r, s in zip(raw, b.column("spans").to_pylist(), strict=True)]
            columns = [pa.array(list(map(len, raw)), pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([sha256(x[0]).hexdigest() for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in extra], *columns, *([pa.array([x[0].decode("utf-8", "ignore") for x in out], pa.string())] if texts else [])], names)

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *extra)] + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + ["kept string"] * texts)
    return rows.join(found, ["k1", "k2"], "left").drop("k1", "k2").mapInArrow(tidied(cut), schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of ``text``, and ``n_chars``, where it is there, counted anew. A null text stays null."""
    own = folded(docs, "doc_id", "text").withColumn("_null", F.col("text").isNull())
    x = removed(own, ("_row", "_null"), texts=True).withColumn("text", F.when(~F.col("_null"), F.col("kept")))
    out = unfolded(x, docs.columns, "doc_id", "text")
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), "n_chars")) if "n_chars" in docs.columns else out
