"""Near copies by SimHash: texts whose sets of five-word shingles are alike to 0.8 (Jaccard).

A set has a SimHash print of 128 bits. Tables bring prints together that may be near: the block
tables of ``hamming``, and bands of minima, as near copies differ in some 20 bits, for which blocks
would be too short. Prints of a bucket are compared by bit planes; pairs within ``WIDE`` bits are
then compared by their whole sets, which decide.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, small_batches, tidied, utf8, written
from .hamming import block_keys, sliced_links
from .simhash_dedup import majority

SHINGLE, SIMILARITY = 5, 0.8
#: Sets alike in 0.8 differ in 19 of 128 bits in the mean, with a deviation of 4; unlike ones in 64.
WIDE = 44
#: A pair meets if all minima of one band are equal: at 0.8 all but (1 - 0.8**5)**30 = 7 pairs of a million do, above it more.
BANDS, ROWS = 30, 5
#: Buckets of up to so many prints are compared by bit planes in a task; larger ones, crowds, go by hubs, eight times as many in each round.
SMALL = 32
LANES = 64
#: A sketch is the parities of a set's shingles by their last ten bits, in 16 words: two sets differ in as many shingles as their sketches in bits, or more.
SKETCH = 1 << 10
PLANE_LANES = 1 << 14
AT_ONCE = 1 << 12
PARITIES = [f"k{k}" for k in range(SKETCH // 64)]
_draws = np.random.default_rng(5)
FLIPS = _draws.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
FACTORS = _draws.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles; a shorter text is one shingle, a text without words none."""
    words = utf8(text).lower().split()
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = max(len(words) - width + 1, min(len(words), 1))
    x = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of minima; none for an empty set, whose equals have its id."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), AT_ONCE):
        np.minimum(low, ((short[k : k + AT_ONCE] ^ FLIPS) * FACTORS).min(1), out=low)
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(low.reshape(BANDS, ROWS))], np.int64)


def print_of(shingles: np.ndarray) -> tuple[int, int]:
    """The SimHash of a set, 128 bits."""
    more = shingles * np.uint64(0xC2B2AE3D27D4EB4F)
    return majority(shingles), majority(more ^ (more >> np.uint64(31)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys, prints = [], [], []
        for t in b.column("text").to_pylist():
            x = shingle_set(t)
            ids.append(set_id(x)), keys.append(band_keys(x)), prints.append(print_of(x))
        words = [pa.array(w, pa.int64()) for w in zip(*prints, strict=True)] or [pa.array([], pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *words], ["doc_id", "row", "set", "keys", "w0", "w1"])


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket whose prints are within ``WIDE``, by bit planes; rows are sorted by bucket."""
    rest = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if len(rest) < PLANE_LANES:
                continue
        if rest is None or not len(rest):
            continue
        key, node = rest["key"].to_numpy(), rest["set"].to_numpy()
        end = len(key) if b is None else int(np.flatnonzero(key == key[-1])[0])
        prints = np.stack([rest[w].to_numpy()[:end].view(np.uint64) for w in ("w0", "w1")], 1)
        rest = rest.slice(end)
        i, k = sliced_links(prints, key[:end], WIDE)
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[k])], ["hub", "node"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(x, np.int64) for x in b.column("shingles").to_pylist()]
        if sets:
            own = np.repeat(b.column("set").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(sets))], ["set", "shingle"])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles for each value of their last bits, as words of 64."""
    odd = np.bincount((shingles & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(x, np.uint64) for x in b.column("shingles").to_pylist()]
        words = np.stack([sketch(x) for x in sets]).T if sets else np.zeros((SKETCH // 64, 0), np.int64)
        yield pa.RecordBatch.from_arrays([b.column("set"), pa.array([len(x) for x in sets], pa.int64()), *[pa.array(w) for w in words]], ["set", "size", *PARITIES])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["set", "shingles"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of two sorted sets of SIMILARITY or more."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-9:
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hub = own = None
    for batch in batches:
        a, b = [], []
        for h, node, blob in zip(*(batch.column(c).to_pylist() for c in ("hub", "node", "shingles")), strict=True):
            x = np.frombuffer(blob, np.uint64)
            if h == node:
                hub, own = h, x
            elif h != hub:
                raise ValueError("a hub's set is not there")
            elif alike(own, x):
                a.append(h), b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The alike ones of ``pairs(hub, node)``; a hub of many nodes is dealt to ``LANES`` lanes."""
    p = pairs.withColumn("lane", F.pmod(F.xxhash64("node"), F.lit(LANES)))
    rows = p.select("hub", "lane", "node").union(p.select("hub", "lane", F.col("hub").alias("node")).distinct())
    rows = rows.join(sets.withColumnRenamed("set", "node"), "node").select("hub", "lane", "node", "shingles")
    return rows.repartition("hub", "lane").sortWithinPartitions("hub", "lane", F.col("hub") != F.col("node")).mapInArrow(tidied(_verified), "a long, b long")


def crowded(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``crowds`` that may have an alike set there, with their ``size``, ``common`` and the sketch of what is common.

    ``common`` counts the shingles that any other set of the crowds has too: no two sets share more
    than the lesser of theirs. A copy with many edits of its own thus meets nobody, whatever its crowd.
    """
    own = sets.join(crowds.select("set").distinct(), "set", "left_semi")
    alone = own.mapInArrow(tidied(_shingles), "set long, shingle long").groupBy("shingle").agg(F.min("set").alias("set"), F.count("*").alias("n")).where("n = 1")
    bit, word = F.expr("shiftleft(1L, cast(shingle & 63 as int))"), F.col("shingle").bitwiseAND(F.lit(SKETCH - 1))
    alone = alone.groupBy("set").agg(F.count("*").alias("alone"), *[F.bit_xor(F.when(word.between(64 * k, 64 * k + 63), bit)).alias(f"_{c}") for k, c in enumerate(PARITIES)])
    none = F.lit(0).cast("long")
    most = own.mapInArrow(tidied(_sketched), "set long, size long, " + ", ".join(f"{c} long" for c in PARITIES)).join(alone, "set", "left")
    most = most.select("set", "size", (F.col("size") - F.coalesce("alone", none)).alias("common"), *[F.col(c).bitwiseXOR(F.coalesce(f"_{c}", none)).alias(c) for c in PARITIES])
    return crowds.join(most.where(F.col("common") >= SIMILARITY * F.col("size") - 1e-6), "set")


def may_be_alike() -> Column:
    """Whether a row and a hub (its columns begin with _) may be alike, by prints, by what they have in common at most and by what differs at least.

    The shingles that one of two sets lacks are at most a ninth of both at a similarity of 0.8: all those that
    no other set has, and of the rest at least as many as bits of the sketches differ. Only the prints can err.
    """
    differ = lambda names: sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"_{w}"))) for w in names)
    both, shared = F.col("size") + F.col("_size"), F.least("common", "_common")
    apart = both - F.col("common") - F.col("_common") + differ(PARITIES)
    return (differ(("w0", "w1")) <= WIDE) & (shared >= SIMILARITY * (both - shared) - 1e-6) & (apart <= both * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6)


def set_components(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(set, component)`` of the sets that have an alike one, from ``members(key, set, w0, w1)`` of shared keys.

    Every two sets of a key meet, in small buckets by the bit planes of their prints, in crowds by
    hubs unless links found before join them already or bounds tell that they are not alike
    (``may_be_alike``); so a crowd of near copies, which its first hubs join, makes few pairs. Hubs are
    those that have least of their own.
    """
    members = written(members.withColumn("n", F.count("*").over(Window.partitionBy("key"))), "near-keys")
    small = members.where(F.col("n") <= SMALL).select("key", "set", "w0", "w1")
    pairs = small.repartition("key").sortWithinPartitions("key", "set").mapInArrow(tidied(_bucket_pairs), "hub long, node long").distinct()
    found = written(components(verified(pairs, sets)).select(F.col("node").alias("set"), "component"), "near-found")
    crowds = members.where(F.col("n") > SMALL).drop("n")
    if crowds.isEmpty():
        return found
    members = crowded(crowds, sets)
    hubs = 1
    while True:
        x = members.join(found, "set", "left").withColumn("label", F.coalesce("component", "set")).drop("component")
        own = Window.partitionBy("key")
        x = x.withColumns({"low": F.min("label").over(own), "high": F.max("label").over(own), "rank": F.row_number().over(own.orderBy(F.col("size") - F.col("common"), "set"))})
        x = written(x.where("low <> high").drop("low", "high"), "near-crowds")
        if x.isEmpty():
            return found
        heads = x.where(F.col("rank") <= hubs).select("key", F.col("set").alias("hub"), *[F.col(c).alias(f"_{c}") for c in ("label", "rank", "size", "common", "w0", "w1", *PARITIES)])
        pairs = x.join(heads, (x["key"] == heads["key"]) & (F.col("label") != F.col("_label")) & (F.col("rank") > F.col("_rank")) & may_be_alike()).select("hub", F.col("set").alias("node")).distinct()
        links = verified(pairs, sets).union(found.select("set", "component"))
        found = written(components(links).select(F.col("node").alias("set"), "component"), "near-found")
        members = x.where(F.col("rank") > hubs).drop("label", "rank")
        hubs *= 8


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that have a near copy of a smaller doc_id.

    Near copies are texts that chains of pairs link, each alike in ``SIMILARITY`` of their
    five-word shingles (A-Z lower-cased; told apart by 64 bits of hash). Candidates share a block
    of their SimHash prints or a band of minima, which miss 7 in a million pairs at the threshold and
    fewer above it; those with prints within ``WIDE`` bits are compared by their whole sets. Texts without words are copies of each other. Rows that repeat a
    doc_id are decided by their texts: of copies one stays, rows of different texts all stay; ties
    go by a hash of the row. Rows with a null doc_id stay and make no other row go.
    """
    small_batches(docs.sparkSession, 500)
    rows = docs.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    ided = rows.where("doc_id is not null")
    texts = ided.select("doc_id", F.col("_row").alias("row"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    own = written(texts.mapInArrow(tidied(_keyed), f"doc_id {kind}, row long, set long, keys array<long>, w0 long, w1 long"), "near-copies")
    keyed = own.where(F.size("keys") > 0).select("set", F.explode(F.concat("keys", F.array(*block_keys([F.col("w0")])))).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("key")
    members = written(keyed.join(shared, "key").select("key", "set").distinct(), "near-members")
    of_set = own.groupBy("set").agg(F.min(F.struct("doc_id", "row")).alias("x"))  # before any join, as many rows may share a set
    first = of_set.join(members.select("set").distinct(), "set").select("x.*")
    sets = written(texts.join(first, ["doc_id", "row"], "left_semi").mapInArrow(tidied(_sets), "set long, shingles binary").dropDuplicates(["set"]), "near-sets")
    prints = own.groupBy("set").agg(F.min("w0").alias("w0"), F.min("w1").alias("w1"))
    found = set_components(members.join(prints, "set"), sets)
    least = of_set.join(found, "set", "left").groupBy(F.coalesce("component", "set").alias("c")).agg(F.min("x").alias("x"))
    least = least.select("x.doc_id", F.col("x.row").alias("_row"))
    kept = ided.join(least, ["doc_id", "_row"], "left_semi").dropDuplicates(["doc_id", "_row"])
    return kept.select(*docs.columns).union(rows.where("doc_id is null").select(*docs.columns))
