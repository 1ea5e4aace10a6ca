"""BPE encoding and decoding through a table of distinct words.

Tasks split their documents into words, a block of text at a time. A block keeps its sequence of
words as numbers; its distinct words go, packed, to the bucket of their hash, where each distinct
word of the corpus is encoded once. The ids go back to the blocks and are joined by position; ids
become text again through the table of pieces, which is as long as the vocabulary.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_kind, partitions, small_batches, tidied
from .tokencount import byte_letters

#: Characters after which a block ends; a longer text is a block of its own.
BLOCK = 1 << 24
#: What the file at hand must say of texts; words are made by these rules.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The pattern for texts of Latin letters, where what re takes for letters, numbers and space is what the library does; else ODD finds something.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
ODD = re.compile("[^\0-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
#: Letters, numbers and white space are in these planes.
PLANES = [*range(0xD800), *range(0xE000, 0x40000)]
#: Words have no white space: it parts them in a blob, and this one marks an added token.
MARK = "\n"


def ranges(points: list[int]) -> str:
    """A character class of sorted code points."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@cache
def odd_pattern(path: str) -> str:
    """The pattern with the library's own letters, numbers and space, as its splitter shows them for each code point."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    kinds: dict[str, list[int]] = {"L": [], "N": [], "S": []}
    for k in range(0, len(PLANES), 1 << 15):
        own = PLANES[k : k + (1 << 15)]
        # a letter keeps the first group whole, a sign the second; a number is apart in both, and space is left out
        found = [0] * (10 * len(own))
        text = "".join(f"a{chr(c)}a  #{chr(c)}#  " for c in own)
        for _, (a, b) in split(text):
            found[a] = b - a
        for i, c in enumerate(own):
            if found[10 * i] == 3:
                kinds["L"].append(c)
            elif found[10 * i + 5] != 3:
                kinds["N" if found[10 * i + 1] else "S"].append(c)
    letters, numbers, space = map(ranges, kinds.values())
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"


class Vocabulary:
    """The model, pieces and added tokens of a word-level BPE file, whose normalizer and pattern must be the known ones."""

    def __init__(self, path: str, pattern: str | None = None):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model, self.normalized = whole.model, whole.normalizer.normalize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != NORMALIZER or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": PATTERN}:
            raise ValueError(f"{path} splits texts by other rules")
        self.odd = re.compile(pattern or odd_pattern(path))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        pieces = spec["model"]["vocab"] | self.added
        self.pieces = [""] * (max(pieces.values()) + 1)
        for piece, k in pieces.items():
            self.pieces[k] = piece
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = [letters[b] for b in range(256)]

    def words(self, text: str | None) -> list[str]:
        """The words of a text as the file's normalizer and pattern make them; added tokens are marked."""
        if not text:
            return []
        if self.cut is None or self.cut.search(text) is None:
            return self._split(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._split(text[at : m.start()])
            out.append(MARK + m[0])
            at = m.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        """The library's normalizer, which is slow, is asked where Python's may differ. It also makes one space of white space, which no word holds."""
        return self.odd.findall(self.normalized(text)) if ODD.search(text) else PLAIN.findall(text.lower())

    def encoded(self, word: str) -> list[int]:
        if word[0] == MARK:
            return [self.added[word[1:]]]
        return [t.id for t in self.model.tokenize(word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")]))]


@cache
def opened(path: str, pattern: str | None = None) -> Vocabulary:
    return Vocabulary(path, pattern)


def squeezed(a: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: the planes of high bytes are mostly zeros."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def spread(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Block:
    """Documents as sequences of numbers of distinct words."""

    def __init__(self):
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.sequences, self.chars = [], [], 0

    def add(self, doc_id, words: list[str], chars: int) -> None:
        self.ids.append(doc_id)
        self.sequences.append(np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words)))
        self.chars += chars

    def dealt(self, buckets: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words by (bucket, word), the bucket of each, and where the word numbered k stands among them."""
        words = list(self.known)
        bucket = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words], np.int64)
        order = sorted(range(len(words)), key=lambda k: (bucket[k], words[k]))
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        return [words[k] for k in order], bucket[order] if len(words) else bucket, place

    def ranked(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All sequences in one with words numbered by frequency, and the place of each number."""
        flat = np.concatenate(self.sequences) if self.sequences else np.zeros(0, np.uint32)
        rank_of = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
        rank = np.empty(len(place), np.uint32)
        rank[rank_of] = np.arange(len(place), dtype=np.uint32)
        return rank[flat] if len(flat) else flat, place[rank_of] if len(place) else place


class Words(Block):
    """The distinct words alone."""

    def add(self, doc_id, words: list[str], chars: int) -> None:
        self.ids.append(doc_id)
        self.known.update(dict.fromkeys(words, 0))
        self.chars += chars


def blocks(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, kind: type[Block]) -> Iterator[tuple[int, Block]]:
    """Blocks of a task, each with a number that is the same whenever the task runs again."""
    block, n = kind(), TaskContext.get().partitionId() << 32
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            block.add(doc_id, vocabulary.words(text), len(text or ""))
            if block.chars >= BLOCK:
                yield n, block
                block, n = kind(), n + 1
    if block.ids:
        yield n, block


def check_of(words: list[str]) -> bytes:
    return sha256(" ".join(words).encode("utf-8", "surrogatepass")).digest()[:16]


def encoded(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and if asked the ``ids`` and the text ``decoded`` from them.

    The digests are of the ids as little-endian 32-bit numbers and of the decoded text in UTF-8.

    As the library encodes with the vocabulary file at ``path``, without special tokens of its own,
    and decodes with special tokens kept. A null or empty text has no ids and decodes to an empty
    text. Repeated rows give a row each, a null doc_id is kept. An empty table gives no rows.

    ``docs`` is read twice and must then hold the same rows in the same partitions, as a table does
    that is read from storage; a block whose two readings differ is an error.
    """
    spark, with_ids, pattern = docs.sparkSession, ids, odd_pattern(path)
    small_batches(spark)
    kind, b_kind = dict(docs.dtypes)["doc_id"], arrow_kind(docs, "doc_id")
    buckets = 4 * partitions(spark)
    docs = docs.select("doc_id", "text")

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, block in blocks(batches, opened(path, pattern), Words):
            words, bucket, _ = block.dealt(buckets)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if words else []
            ends = [*starts[1:], len(words)] if words else []
            z = zstandard.ZstdCompressor(level=3)
            blobs = [z.compress(" ".join(words[i:j]).encode("utf-8", "surrogatepass")) for i, j in zip(starts, ends, strict=True)]
            check = check_of(words)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(blobs), pa.int64()), pa.array(bucket[starts] if words else [], pa.int32()), pa.array(blobs, pa.binary()), pa.array([check] * len(blobs), pa.binary())], ["block", "bucket", "words", "check"])

    def encode_bucket(f: pd.DataFrame) -> pd.DataFrame:
        vocabulary, known = opened(path, pattern), {}
        ids, z = [], zstandard.ZstdDecompressor()
        for blob in f["words"]:
            each = []
            for w in z.decompress(blob).decode("utf-8", "surrogatepass").split(" "):
                if w not in known:
                    known[w] = vocabulary.encoded(w)
                each.append(known[w])
            flat = np.array([k for x in each for k in x], np.uint32)
            ids.append(squeezed(np.r_[np.uint32(len(each)), np.array([len(x) for x in each], np.uint32), flat]))
        return pd.DataFrame({"block": f["block"], "bucket": f["bucket"], "ids": ids, "check": f["check"]})

    def sequence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, block in blocks(batches, opened(path, pattern), Block):
            words, _, place = block.dealt(buckets)
            flat, places = block.ranked(place)
            own = pa.array(block.ids, b_kind)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.ListArray.from_arrays([0, len(own)], own), pa.array([[len(s) for s in block.sequences]], pa.list_(pa.int64())), pa.array([squeezed(flat)], pa.binary()), pa.array([squeezed(places)], pa.binary()), pa.array([check_of(words)], pa.binary())], ["block", "doc_ids", "lengths", "sequence", "places", "check"])

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = opened(path, pattern).pieces
        ids_of, text_of = [], []
        right = right.sort_by("bucket")
        for blob in right.column("ids").to_pylist():
            x = spread(blob)
            n = int(x[0])
            ends = np.cumsum(x[1 : n + 1])
            flat = x[n + 1 :]
            own = flat.tobytes()
            names = [pieces[k] for k in flat.tolist()]
            for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                ids_of.append(own[4 * i : 4 * j])
                text_of.append(" ".join(names[i:j]))
        out: tuple[list, list, list] = ([], [], [])
        for row in left.to_pylist():
            if right.num_rows and set(right.column("check").to_pylist()) != {row["check"]}:
                raise ValueError("the two readings of a block differ")
            places = spread(row["places"])
            numbers, at = (places[spread(row["sequence"])] if len(places) else np.zeros(0, np.uint32)), 0
            for doc_id, n in zip(row["doc_ids"], row["lengths"], strict=True):
                own = numbers[at : at + n].tolist()
                at += n
                out[0].append(doc_id)
                out[1].append(b"".join([ids_of[k] for k in own]))
                out[2].append(" ".join([text_of[k] for k in own if text_of[k]]))
        return finish(out)

    def finish(out: tuple[list, list, list]) -> pa.Table:
        digest = lambda x: sha256(x).hexdigest()
        return pa.table({
            "doc_id": pa.array(out[0], b_kind), "n_tokens": pa.array([len(x) // 4 for x in out[1]], pa.int64()), "ids_sha256": pa.array(list(map(digest, out[1])), pa.string()),
            "decoded_sha256": pa.array([digest(x.encode("utf-8", "surrogatepass")) for x in out[2]], pa.string())} | (
            {"ids": pa.array([np.frombuffer(x, "<i4") for x in out[1]], pa.list_(pa.int32()))} if with_ids else {}) | ({"decoded": pa.array(out[2], pa.string())} if decoded else {}))

    answers = docs.mapInArrow(tidied(word_rows), "block long, bucket int, words binary, check binary").groupBy("bucket").applyInPandas(encode_bucket, "block long, bucket int, ids binary, check binary")
    sequences = docs.mapInArrow(tidied(sequence_rows), f"block long, doc_ids array<{kind}>, lengths array<long>, sequence binary, places binary, check binary")
    return sequences.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidied(joined), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * decoded)
