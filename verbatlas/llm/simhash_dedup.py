"""SimHash near-duplicates: fingerprints of word shingles, linked within two bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8
from .hamming import near_components

SHINGLE = 3
#: Hashes whose bits are unpacked at a time, which bounds the memory of a long text.
AT_ONCE = 1 << 15


def shingle_hashes(text: str | None, width: int = SHINGLE) -> list[int]:
    words = utf8(text).lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    h = xxhash.xxh64_intdigest
    return [h(s, 42) for s in map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))]


def majority(hashes: list[int]) -> int:
    """Each bit set in over half of the hashes; zero for none."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), AT_ONCE):
        part = np.array(hashes[k : k + AT_ONCE], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [majority(shingle_hashes(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "print"])


def prints(docs: DataFrame) -> DataFrame:
    """``(doc_id, print)``; lower-cases A-Z only, and texts without words have the print zero."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_printed, f"doc_id {dict(docs.dtypes)['doc_id']}, print long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Fingerprints within two bits link; component_id is the least doc_id that links reach. Null and
    empty texts have the print zero, which links like any other. Equal texts share a print.
    Repeated rows give a row each; a null doc_id takes part in no link and has the component of
    its print, if another row has that. An empty table gives no rows.
    """
    own = prints(docs)
    found = near_components(own.select("print", F.col("doc_id").alias("node")), ["print"])
    return own.join(found, "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that have a near-duplicate of a smaller doc_id.

    Of rows that repeat a doc_id one stays; rows with a null doc_id stay.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))
