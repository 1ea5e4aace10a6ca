"""Links between fingerprints within a radius: block tables, bit planes, and midpoints or hubs for crowds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, written

RADIUS = 2
#: Planes after which pairs over the radius are let go.
STEP = 8
#: A bucket of more fingerprints is not compared in a task: its links are found through midpoints.
CROWD = 2048
LANES = 1 << 14


def bits_of(word: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(word, start).bitwiseAND(F.lit((1 << width) - 1))


def runs_of(words: list[Column], bits: list[int]) -> list[Column]:
    """The values of bits (numbered through the words, in order) as one column for each run of neighbours in a word."""
    out, start = [], 0
    for i in range(1, len(bits) + 1):
        if i == len(bits) or bits[i] != bits[i - 1] + 1 or bits[i] % 64 == 0:
            k, b, n = bits[start] // 64, bits[start] % 64, i - start
            out.append(words[k] if n == 64 else bits_of(words[k], b, n))
            start = i
    return out


def cut_in(bits: list[int], n: int) -> list[list[int]]:
    return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]


def block_keys(words: list[Column], radius: int = RADIUS) -> list[Column]:
    """Keys, of which any two fingerprints within ``radius`` bits share one at least.

    Up to two bits: the bits are cut into three blocks; two bits that differ leave one block alone.
    The rest of the bits is cut into three again, and again one part is left alone. A key is a block
    and a part, so its table is the fingerprints with these bits put first. Beyond, the bits are cut
    into radius + 2 blocks, of which two at least are left alone; a key is two blocks.
    """
    bits = list(range(64 * len(words)))
    if radius <= 2:
        pairs = [(block, part) for block in cut_in(bits, 3) for part in cut_in([x for x in bits if x not in block], 3)]
    else:
        pairs = list(combinations(cut_in(bits, radius + 2), 2))
    return [F.xxhash64(F.lit(t), *runs_of(words, a), *runs_of(words, b)) for t, (a, b) in enumerate(pairs)]


def planes_of(fp: np.ndarray) -> list[int]:
    """The bit planes of fingerprints (n x words): plane b has bit b of all of them, one lane each."""
    bits = np.unpackbits(np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(p, bitorder="little").tobytes(), "little") for p in bits.T]


def lanes_of(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n])


def over(counters: list[int], radius: int, lanes: int) -> int:
    """The lanes whose count, which the counters hold bit by bit, is over ``radius``."""
    more, same = 0, lanes
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def sliced_links(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of lanes of one bucket within ``radius``; lanes are sorted by bucket.

    Lane i meets lane i + s for each shift s: plane XOR shifted plane has the differing bits of
    all such pairs at once, and carry-save counters add the planes up. Pairs over the radius are
    let go after every ``STEP`` planes, and a shift is abandoned when all are. Buckets no larger
    than a shift leave the planes.
    """
    n, width = len(fp), (radius + STEP).bit_length()
    new = np.r_[True, bucket[1:] != bucket[:-1]] if n else np.zeros(0, bool)
    size = np.diff(np.r_[np.flatnonzero(new), n])
    size = np.repeat(size, size)
    a, b, lanes, low = [], [], np.arange(n), 1
    while len(lanes := lanes[size[lanes] > low]):
        planes, own = planes_of(fp[lanes]), bucket[lanes]
        for s in range(low, min(2 * low, len(lanes))):
            alive = int.from_bytes(np.packbits(own[:-s] == own[s:], bitorder="little").tobytes(), "little")
            counters = [0] * width
            for at in range(0, len(planes), STEP):
                for p in planes[at : at + STEP]:
                    carry = (p ^ (p >> s)) & alive
                    for k in range(width):
                        if not carry:
                            break
                        counters[k], carry = counters[k] ^ carry, counters[k] & carry
                alive &= ~over(counters, radius, alive)
                if not alive:
                    break
                counters = [c & alive for c in counters]
            if alive:
                i = lanes_of(alive, len(lanes) - s)
                a.append(lanes[i]), b.append(lanes[i + s])
        low *= 2
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _spanned(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: as many edges as nodes at most."""
    if not len(a):
        return nodes[:0], nodes[:0]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if (old == label).all():
            break
    i = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[i], nodes[label[i]]


def _bucket_links(words: int, radius: int, crowd: int):
    """Links of each bucket; of a bucket over ``crowd`` only its key ``h``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, skipped = None, None
        for f in _and_last(frames):
            if f is not None:
                f = f[f["h"] != skipped] if skipped is not None else f
                rest = f if rest is None or not len(rest) else pd.concat([rest, f], ignore_index=True)
                if len(rest) < LANES:
                    continue
            if rest is None or not len(rest):
                continue
            key = rest["h"].to_numpy()
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[new, len(key)])
            crowds = key[new[size > crowd]]
            if len(crowds):
                yield pd.DataFrame({"a": [None] * len(crowds), "b": [None] * len(crowds), "h": pd.array(crowds, "Int64")})
                skipped = key[-1] if size[-1] > crowd else skipped
                rest = rest[np.repeat(size <= crowd, size)].reset_index(drop=True)
                key = rest["h"].to_numpy()
            if not len(rest):
                continue
            end = len(rest) if f is None else int(np.flatnonzero(key == key[-1])[0])
            part, rest = rest.iloc[:end], rest.iloc[end:]
            if len(part):
                fp = part[[f"w{k}" for k in range(words)]].to_numpy().astype(np.int64).view(np.uint64)
                a, b = _spanned(part["node"].to_numpy(), *sliced_links(fp, part["h"].to_numpy(), radius))
                yield pd.DataFrame({"a": a, "b": b, "h": pd.array([None] * len(a), "Int64")})

    return run


def _and_last(frames: Iterator) -> Iterator:
    yield from frames
    yield None


def midpoint_links(crowded: DataFrame, words: list[str]) -> DataFrame:
    """Links within two bits: each fingerprint names its neighbours a bit away and itself; those that name the same one meet there as a star."""
    flips = [F.struct(*words)] + [F.struct(*[(F.col(w).bitwiseXOR(F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long")) if w == v else F.col(w)).alias(w) for w in words]) for v in words for b in range(64)]
    near = crowded.drop("h").distinct().select("node", F.explode(F.array(*flips)).alias("mid"))
    hubs = near.groupBy("mid").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.join(hubs, "mid").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def hub_links(crowded: DataFrame, words: list[str], radius: int, links: DataFrame) -> DataFrame:
    """``links`` and those of crowds that join their components.

    In each round some of a crowd's fingerprints, its hubs, are compared with all the others that no
    links join to them yet, and leave it; each time eight times as many, so rounds are few. A crowd that
    is joined is done. The join by crowd is a plain one, which Spark splits where it is skewed.
    """
    members, hubs = crowded, 4
    while True:
        found = cut(components(links).select(F.col("node"), F.col("component").alias("label")))
        x = members.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
        own = x.groupBy("h").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h", "n")
        x = cut(x.join(own, "h").withColumn("hub", F.pmod(F.xxhash64("h", "node", F.lit(hubs)), "n") < hubs))
        if x.isEmpty():
            return links
        heads = x.where("hub").select("h", F.col("node").alias("b"), F.col("label").alias("_label"), *[F.col(w).alias(f"_{w}") for w in words])
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"_{w}"))) for w in words[1:]), F.bit_count(F.col(words[0]).bitwiseXOR(F.col(f"_{words[0]}"))))
        now = x.join(heads, "h").where((F.col("label") != F.col("_label")) & (apart <= radius)).select(F.col("node").alias("a"), "b").distinct()
        links = cut(links.union(now))
        members, hubs = x.where("not hub").select(*crowded.columns), 8 * hubs


def near_components(prints: DataFrame, words: list[str], radius: int = RADIUS) -> DataFrame:
    """``prints`` (the words of a fingerprint and an id ``node``) as ``(words..., node, component)``, a row per fingerprint.

    Fingerprints link at ``radius`` bits or fewer; ``node`` is the least id with the fingerprint and
    ``component`` the least id that links reach; both are null where all its ids are. Equal
    fingerprints are one row before anything is compared. A crowd, a bucket of over ``CROWD``
    different fingerprints, is not compared in a task: up to a radius of two its links are
    found through midpoints, beyond through hubs.
    """
    one = prints.groupBy(*words).agg(F.min("node").alias("node")).where("node is not null")
    ws = [f"w{k}" for k in range(len(words))]
    rows = one.select("node", *[F.col(w).alias(k) for k, w in zip(ws, words, strict=True)])
    keys = F.array(*block_keys([F.col(w) for w in ws], radius))
    dealt = rows.select("node", *ws, F.explode(keys).alias("h"))
    kind = dict(one.dtypes)["node"]
    near = written(dealt.repartition("h").sortWithinPartitions("h").mapInPandas(_bucket_links(len(words), radius, CROWD), f"a {kind}, b {kind}, h long"), "near-links")
    crowds = near.where("h is not null").select("h").distinct()
    links = near.where("h is null").select("a", "b")
    if not crowds.isEmpty():
        crowded = cut(dealt.join(crowds, "h", "left_semi"))
        links = links.union(midpoint_links(crowded, ws)) if radius <= 2 else hub_links(crowded, ws, radius, links)
    found = components(links)
    return one.join(found, "node", "left").select(*words, "node", F.coalesce("component", "node").alias("component"))
