"""Language-model scores by a weighted backoff automaton learnt from the corpus.

States are the contexts met in training of up to ``order`` - 1 words (a text's start counts as one),
arcs are the n-grams met in training, and each state has a failure arc to the state of its context
without the first word, down to the empty context, whose arcs are all words. With c the counts in
training, N tokens, V distinct tokens and K the weight of what a shorter context says:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K)        h' is h without its first word

An arc (h, w) bears log p(w | h). Where there is none, the failure arc bears log(K / (c(h) + K))
and leads to h', which is the same formula with c(h w) = 0; so the probabilities of a state sum to
one, a share for words never seen included. The automaton reads a text once from left to right,
carries its state, follows failure arcs until an arc has the word, and adds up what the arcs bear.
Texts of a block are read side by side, long ones in stretches: a state is the longest known end of
the words before, so a stretch knows the state it begins in.

Counts meet by hash: tasks read a block of text at a time and send its distinct n-grams, packed,
with their counts in training texts, to the buckets of their hashes; a bucket adds them up and
answers each block, which then has the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_kind, packed, partitions, small_batches, unpacked, utf8, written_cleanly

#: Bytes of text after which a block ends; a longer text is a block of its own.
BLOCK = 6_000_000
#: Tokens that are read side by side with others.
STRETCH = 512
#: K for contexts of one word, two words; the order of the model is one more than there are.
WEIGHTS = (64.0, 16.0)
#: Hashes of a text's start and end, which no word has but by chance. The lowest bit of a hash is free.
START, END, BUT_LOWEST = np.uint64(0x5354415254000000), np.uint64(0x454E440000000002), np.uint64(2**64 - 2)


@cache
def zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(a: np.ndarray) -> bytes:
    """64-bit numbers as byte planes, compressed; small numbers cost little."""
    return zstd()[0].compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def spread(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstd()[1].decompress(blob), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes; the order counts."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15F39CC060)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & BUT_LOWEST


class Block:
    """Texts as words numbered in the block: 1 is the end."""

    def __init__(self):
        self.known: dict[bytes, int] = defaultdict(count(2).__next__)
        self.ids, self.sequences, self.size, self.digest = [], [], 0, xxhash.xxh3_64()

    def add(self, doc_id, text: str | None) -> None:
        raw = utf8(text)
        words = raw.lower().split()
        self.ids.append(doc_id)
        own = np.ones(len(words) + 1, np.uint32)
        own[:-1] = np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words))
        self.sequences.append(own)
        self.size += len(raw)
        self.digest.update(b"%d %d " % (len(str(doc_id)), len(raw)) + str(doc_id).encode())
        self.digest.update(raw)

    def check(self) -> int:
        return self.digest.intdigest() >> 1

    def hashes(self) -> np.ndarray:
        h = xxhash.xxh64_intdigest
        return np.array([int(START), int(END), *[h(w, 0) for w in self.known]], np.uint64) & BUT_LOWEST


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    block, n = Block(), TaskContext.get().partitionId() << 32
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            block.add(doc_id, text)
            if block.size >= BLOCK:
                yield n, block
                block, n = Block(), n + 1
    if block.ids:
        yield n, block


def is_held_out(doc_id, fold: int, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def grams(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``order``: the hash of the n-gram that ends at each token, and whether there is one; the start is a word before the first."""
    begin = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, int)
    at = np.arange(len(tokens)) - np.repeat(begin, lengths)
    out = [(tokens, at >= 0)]
    for k in range(2, order + 1):
        before = np.r_[START, out[-1][0][:-1]][: len(tokens)]
        before[begin] = START
        out.append((mixed(before, tokens), at >= k - 2))
    return out


def in_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket begins in sorted keys, and the differences of neighbours in a bucket; buckets are ranges of hashes."""
    width = np.uint64(-(-(1 << 64) // buckets))
    cuts = np.searchsorted(keys // width, np.arange(buckets + 1, dtype=np.uint64))
    steps = np.diff(keys, prepend=np.uint64(0))
    firsts = np.unique(cuts[:-1][cuts[:-1] < cuts[1:]])
    steps[firsts] = keys[firsts] - keys[firsts] // width * width
    return cuts, steps


class Automaton:
    """What a block's texts can reach of the backoff automaton.

    ``keys`` are the hashes of n-grams by length, sorted, and ``counts`` theirs in training: an
    n-gram with a count is an arc from the state of its words but the last, and the state that its words lead to.
    """

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, n: int, v: int, weights: Sequence[float]):
        self.order, self.lengths, self.counts = len(keys), lengths, counts
        self.begin = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, int)
        self.start = int(np.searchsorted(keys[0], START))
        self.at = [np.where(there, np.searchsorted(k, h), -1) for k, (h, there) in zip(keys, found, strict=True)]
        p = (counts[0][self.at[0]] + 1.0) / (n + v + 1.0)
        self.arcs, self.fails = [np.zeros(len(k)) for k in keys], []
        self.arcs[0][self.at[0]] = np.log10(p)
        for k in range(1, self.order):
            there = self.at[k] >= 0
            context = np.r_[-1, self.at[k - 1][:-1]]
            if k == 1:
                context[self.begin] = self.start
            own, weight = self.at[k][there], weights[k - 1]
            p = p.copy()
            p[there] = (counts[k][own] + weight * p[there]) / (counts[k - 1][context[there]] + weight)
            self.arcs[k][own] = np.log10(p[there])
            self.fails.append(np.log10(weight / (counts[k - 1] + weight)))

    def states(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that the words up to these tokens lead to: length of the context and its number."""
        size, state = np.zeros(len(at), int), np.zeros(len(at), int)
        for k in range(1, self.order):
            own = self.at[k - 1][at]
            known = (own >= 0) & (self.counts[k - 1][own] > 0)
            size[known], state[known] = k, own[known]
        return size, state

    def traversed(self) -> np.ndarray:
        """What is added at each token."""
        out = np.zeros(int(self.lengths.sum()))
        parts = -(-self.lengths // STRETCH)
        doc = np.repeat(np.arange(len(parts)), parts)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
        sizes = np.minimum(STRETCH, self.lengths[doc] - first)
        order = np.argsort(-sizes, kind="stable")
        sizes, fresh, begin = sizes[order], first[order] == 0, (self.begin[doc] + first)[order]
        size, state = self.states(np.maximum(begin - 1, 0))
        known = bool(len(self.counts[0])) and self.counts[0][self.start] > 0
        size[fresh], state[fresh] = int(known), self.start
        for t in range(int(sizes.max(initial=0))):
            m = int(np.searchsorted(-sizes, -t))
            at, size, state, add = begin[:m] + t, size[:m], state[:m], np.zeros(m)
            for k in range(self.order - 1, 0, -1):
                here = np.flatnonzero(size == k)
                arc = self.at[k][at[here]]
                hit = self.counts[k][arc] > 0
                on, off = here[hit], here[~hit]
                add[on] += self.arcs[k][arc[hit]]
                add[off] += self.fails[k - 1][state[off]]
                size[on], size[off] = -1, k - 1
                if k > 1:
                    state[off] = self.at[k - 2][at[off] - 1]
            empty = np.flatnonzero(size == 0)
            add[empty] += self.arcs[0][self.at[0][at[empty]]]
            out[at] = add
            size, state = self.states(at)
        return out


def scored(docs: DataFrame, fold: int = 2, folds: int = 7, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Texts whose crc32(doc_id as text) mod ``folds`` is ``fold`` are held out from training. The
    model's order is one over the number of ``weights``, K by the length of the context. A null
    or empty text has one token, its end. Repeated rows count and score as rows of their own; a
    null doc_id counts as an empty text of an id. n-grams are told apart by 63 bits of
    hash. An empty table gives no rows. Ids may be of any type that Arrow has.

    ``docs`` is read twice and must then hold the same rows in the same partitions, as a table does
    that is read from storage; a block whose two readings differ is an error.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind, id_kind = docs.schema["doc_id"].dataType.simpleString(), arrow_kind(docs, "doc_id")
    buckets, order = 4 * partitions(spark), len(weights) + 1
    docs = docs.select("doc_id", "text")

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, block in blocks(batches):
            lengths = np.array([len(s) for s in block.sequences])
            trains = np.array([not is_held_out(x, fold, folds) for x in block.ids])
            train = np.repeat(trains, lengths).astype(np.uint64)
            found = grams(block.hashes()[np.concatenate(block.sequences)], lengths, order)
            cuts, steps, counts = [], [], []
            for k, (h, there) in enumerate(found):
                # the lowest bit says whether it counts
                x = h[there] | train[there] if k else np.r_[h | train, START | trains.astype(np.uint64)]
                x.sort()
                new = np.flatnonzero(np.r_[True, x[1:] >> np.uint64(1) != x[:-1] >> np.uint64(1)][: len(x)])
                counts.append(np.add.reduceat(x & np.uint64(1), new) if len(x) else x)
                c, s = in_buckets(x[new] & BUT_LOWEST, buckets)
                cuts.append(c), steps.append(s)
            del found
            rows = []
            for b in range(buckets):
                sizes = [int(c[b + 1] - c[b]) for c in cuts]
                if any(sizes):
                    rows.append((n, b, sizes, *(squeezed(np.concatenate([a[c[b] : c[b + 1]] for a, c in zip(x, cuts, strict=True)])) for x in (steps, counts)), block.check()))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "bucket", "sizes", "grams", "counts", "digest"])

    def added_up(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        sums: list[list[np.ndarray]] = [[] for _ in rows]
        total = distinct = 0
        base = np.uint64(rows[0]["bucket"] * -(-(1 << 64) // buckets))
        parts = [np.split(spread(r["grams"]), np.cumsum(r["sizes"])[:-1]) for r in rows]
        counts = [np.split(spread(r["counts"]), np.cumsum(r["sizes"])[:-1]) for r in rows]
        for k in range(order):
            keys = [np.cumsum(p[k], dtype=np.uint64) + base for p in parts]
            every, where = np.unique(np.concatenate(keys), return_inverse=True)
            added = np.bincount(where, np.concatenate([c[k] for c in counts]).astype(float), len(every)).astype(np.uint64)
            at = 0
            for own, key in zip(sums, keys, strict=True):
                own.append(added[where[at : at + len(key)]])
                at += len(key)
            if k == 0:
                tokens = added[every != START]
                total, distinct = int(tokens.sum()), int((tokens > 0).sum())
        return pa.table({
            "block": pa.array([r["block"] for r in rows] + [-1], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows] + [rows[0]["bucket"]], pa.int32()),
            "sizes": pa.array([r["sizes"] for r in rows] + [[]], pa.list_(pa.int64())), "counts": pa.array([squeezed(np.concatenate(x)) for x in sums] + [b""], pa.binary()),
            "digest": pa.array([r["digest"] for r in rows] + [0], pa.int64()), "total": pa.array([0] * len(rows) + [total], pa.int64()), "kinds": pa.array([0] * len(rows) + [distinct], pa.int64())})

    def sequence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, block in blocks(batches):
            own = pa.array(block.ids, id_kind)
            flat = np.concatenate(block.sequences)
            h = block.hashes()
            by_count = np.r_[0, 1, np.argsort(-np.bincount(flat, minlength=len(h))[2:], kind="stable") + 2]
            rank = np.empty(len(h), np.uint64)
            rank[by_count] = np.arange(len(h))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.ListArray.from_arrays([0, len(own)], own), pa.array([[len(s) for s in block.sequences]], pa.list_(pa.int64())), pa.array([squeezed(rank[flat])], pa.binary()), pa.array([packed(h[by_count])], pa.binary()), pa.array([block.check()], pa.int64())], ["block", "doc_ids", "lengths", "sequence", "hashes", "digest"])

    def traversed(left: pa.Table, right: pa.Table, n: int, v: int) -> pa.Table:
        answers = right.sort_by("bucket").select(["sizes", "counts", "digest"]).to_pylist()
        out = []
        for row in left.to_pylist():
            if any(a["digest"] != row["digest"] for a in answers):
                raise ValueError("the two readings of a block differ")
            parts = [np.split(spread(a["counts"]), np.cumsum(a["sizes"])[:-1]) for a in answers]
            counts = [np.concatenate([p[k] for p in parts]).astype(float) for k in range(order)]
            del parts
            h, flat, lengths = unpacked(row["hashes"], np.uint64), spread(row["sequence"]).astype(int), np.array(row["lengths"])
            found = grams(h[flat], lengths, order)
            keys = [np.unique(x[there] if k else np.r_[x, START]) for k, (x, there) in enumerate(found)]
            if [len(k) for k in keys] != [len(c) for c in counts]:
                raise ValueError("the two readings of a block differ")
            automaton = Automaton(keys, counts, found, lengths, n, v, weights)
            del found, keys
            at = np.r_[0, np.cumsum(lengths)[:-1]]
            c = counts[0][automaton.at[0]]
            base = np.log10((c + 1.0) / (n + 1 * (v + 1)))
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], id_kind), "held_out": pa.array([is_held_out(x, fold, folds) for x in row["doc_ids"]]), "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), at), pa.int64()), "train_tokens": pa.array([n] * len(lengths), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(automaton.traversed(), at))}))
        return pa.concat_tables(out) if out else empty

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    empty = pa.table({"doc_id": pa.array([], id_kind), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
    answer = "block long, bucket int, sizes array<long>, counts binary, digest long"
    counts = docs.mapInArrow(count_rows, "block long, bucket int, sizes array<long>, grams binary, counts binary, digest long")
    sums = written_cleanly(counts.groupBy("bucket").applyInArrow(added_up, answer + ", total long, kinds long"), "lm-counts")
    n, v = sums.where("block = -1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    sequences = docs.mapInArrow(sequence_rows, f"block long, doc_ids array<{kind}>, lengths array<long>, sequence binary, hashes binary, digest long")
    answers = sums.where("block >= 0").drop("total", "kinds")
    return sequences.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: traversed(left, right, n, v), schema)
