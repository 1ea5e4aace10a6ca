"""Document fingerprints: SimHash of weighted terms, and their neighbours through block tables."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_kind, partitions, small_batches, utf8, written
from .hamming import near_components

BITS = 128
BYTES = BITS // 8
#: What a term's vote weighs. With heavier single words texts of one language come within the radius by chance; with lighter ones near copies leave it.
WORD, PAIR = 1, 2
#: Fingerprints link within so many bits.
NEAR = 7
AT_ONCE = 1 << 16
BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
BYTE_PLACES = 256 * np.arange(BYTES)


def hashed(terms) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), np.uint8).reshape(-1, BYTES)


class Terms:
    """The words of a text (A-Z lower-cased) and the hashes of its terms, words and pairs of neighbouring words."""

    def __init__(self, text: str):
        self.words = utf8(text).lower().split()
        self.word, self.pair = hashed(self.words), hashed(map(b" ".join, zip(self.words, self.words[1:], strict=False)))


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from a count of each byte at each place."""
    out = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), AT_ONCE):
        counts = np.bincount((hashes[k : k + AT_ONCE] + BYTE_PLACES).ravel(), minlength=256 * BYTES)
        out += (counts.reshape(BYTES, 256) @ BIT_TABLE).ravel()
    return out


def voted(*parts: tuple[int, np.ndarray]) -> tuple[int, int]:
    """Two words of 64 bits: each term's hash votes with its weight for and against each bit. Zero for no terms."""
    votes = sum(w * (2 * ones(h) - len(h)) for w, h in parts)
    words = np.packbits(votes > 0).view(">i8")
    return int(words[0]), int(words[1])


def fingerprint(terms: Terms) -> tuple[int, int]:
    return voted((WORD, terms.word), (PAIR, terms.pair))


def edited_fingerprint(own: Terms, following: Terms, changed: str, kept: str, added: str) -> tuple[int, int]:
    """The fingerprint of ``changed``, which is ``kept`` of one text and ``added`` of the next.

    All but the words at the cuts are words of the two texts, whose hashes are there already.
    """
    e = utf8(changed).lower().split()
    m, n = max(len(utf8(kept).split()) - 1, 0), len(utf8(added).split())
    if m < 2 or n < 4:
        return fingerprint(Terms(changed))
    rest = len(e) - (n - 1)  # e is own.words[:m], e[m:rest], following.words[1 : n - 1], e[-1]
    seam = e[m - 1 : rest + 1]
    pairs = [*map(b" ".join, zip(seam, seam[1:], strict=False)), b" ".join(e[-2:])]
    return voted((WORD, own.word[:m]), (WORD, following.word[1 : n - 1]), (WORD, hashed([*e[m:rest], e[-1]])), (PAIR, own.pair[: m - 1]), (PAIR, following.pair[1 : n - 2]), (PAIR, hashed(pairs)))


def likeness(a: tuple[int, int], b: tuple[int, int]) -> float:
    """The cosine that the share of differing bits stands for, 0 at least; 1 for equal fingerprints."""
    d = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))
    return max(0.0, float(np.cos(np.pi * d / BITS)))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


KEPT = "doc_id, n_chars long, edited_sha256 string, f0 long, f1 long, e0 long, e1 long, near_edited double, near_next double"
FIELDS = KEPT.removeprefix("doc_id, ") + ", part int, role string, blob binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts go through the exchange compressed, with a hash that orders those of equal ids."""
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = [utf8(t) for t in b.column("text").to_pylist()]
        order = [xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(order, pa.int64()), pa.array([z.compress(r) for r in raw], pa.binary())], ["doc_id", "digest", "blob"])


def printed(text: str, own: Terms, following: str, after: Terms) -> tuple:
    changed, k = edited(text, following), len(text) // 3
    prints = fingerprint(own), edited_fingerprint(own, after, changed, text[: len(text) - k], following[:k]), fingerprint(after)
    return len(text), sha256(utf8(changed)).hexdigest(), *prints[0], *prints[1], likeness(prints[0], prints[1]), likeness(prints[0], prints[2])


NONE = (None,) * 8


def _batch(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = [id_kind, pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.binary()]
    names = ["doc_id", *[f.split()[0] for f in FIELDS.split(", ")]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _in_order(id_kind: pa.DataType):
    """Rows of a partition in order: each is printed when its next has come. The first text and the last go on to others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, z, held = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), None
        for b in batches:
            rows = []
            for doc_id, blob in zip(b.column("doc_id").to_pylist(), b.column("blob").to_pylist(), strict=True):
                text = z.decompress(blob).decode("utf-8", "surrogatepass")
                if held is None:
                    rows.append((doc_id, *NONE, part, "first", blob))
                    terms = Terms(text)
                else:
                    terms = held[2] if held[1] == text else Terms(text)
                    rows.append((held[0], *printed(held[1], held[2], text, terms), part, None, None))
                held = doc_id, text, terms, blob
            if rows:
                yield _batch(rows, id_kind)
        if held is not None:
            yield _batch([(held[0], *NONE, part, "last", held[3])], id_kind)

    return run


def _last(id_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, *blobs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "blob", "next")), strict=True):
                text, following = (z.decompress(x).decode("utf-8", "surrogatepass") for x in blobs)
                rows.append((doc_id, *printed(text, Terms(text), following, Terms(following)), None, None, None))
            if rows:
                yield _batch(rows, id_kind)

    return run


def with_next(docs: DataFrame) -> DataFrame:
    """Each document printed with the next one, as ``KEPT`` says: that of the next smaller id, after the last the first.

    Ids may be of any type that can be sorted; repeated ids stand in the order of a hash of their
    texts, a null id last. Documents are put in order by one range exchange; a partition then lacks
    only the text after its last one, which is the first of the next partition with rows. Equal rows
    may part at any place, so that neither an id nor a text makes a partition large.
    """
    spark, id_kind, kind = docs.sparkSession, arrow_kind(docs, "doc_id"), dict(docs.dtypes)["doc_id"]
    x = docs.select("doc_id", "text").mapInArrow(_packed, f"doc_id {kind}, digest long, blob binary")
    order = [F.col("doc_id").desc_nulls_last(), F.col("digest"), F.col("_tie")]
    x = x.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    x = written(x.select("doc_id", "blob").mapInArrow(_in_order(id_kind), f"doc_id {kind}, {FIELDS}"), "fingerprints")
    # two rows a partition
    ends = x.where("role is not null")
    first = ends.where("role = 'first'").select("part", F.col("blob").alias("next"))
    parts = first.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("following"))
    lasts = ends.where("role = 'last'").select("doc_id", "part", "blob").join(parts, "part").join(first.withColumnRenamed("part", "following"), "following")
    lasts = lasts.select("doc_id", "blob", "next").mapInArrow(_last(id_kind), f"doc_id {kind}, {FIELDS}")
    kept = [f.split()[0] for f in KEPT.split(", ")]
    return x.where("role is null").select(*kept).union(lasts.select(*kept))


def fingerprinted(docs: DataFrame, neighbours: bool = True, radius: int = NEAR) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and ``near_id``.

    ``near_id`` is the least doc_id that links of at most ``radius`` differing bits reach, found through
    the permuted block tables of ``hamming``. A null text is empty; an empty text has the
    fingerprint zero. Equal texts, repeated rows and ties have equal fingerprints and a row each; a
    null doc_id comes last in the order. A single document is its own next. An empty table gives no rows.
    """
    small_batches(docs.sparkSession, 1000)
    x = with_next(docs)
    code = lambda k: F.lower(F.concat(F.lpad(F.hex(f"{k}0"), 16, "0"), F.lpad(F.hex(f"{k}1"), 16, "0")))
    out = ["doc_id", "n_chars", "edited_sha256", code("f").alias("fingerprint"), code("e").alias("edited_fingerprint"), "near_edited", "near_next"]
    if not neighbours:
        return x.select(*out)
    found = near_components(x.select("f0", "f1", F.col("doc_id").alias("node")), ["f0", "f1"], radius)
    return x.join(found, ["f0", "f1"], "left").select(*out, F.col("component").alias("near_id"))
