"""Token counts without tokens: a byte-level BPE compiled into two finite-state machines.

The first splits a text as the vocabulary's pattern does. Its alphabet are character classes with
two characters of lookahead folded in, its few states say in what kind of run a character stands,
and its transitions say whether a token's piece starts there. A text is cut into chunks; each
chunk becomes a map from states to states, and the maps are composed through a parallel prefix
scan, which gives the state at each chunk's start, so all chunks run side by side.

The second is a deterministic transducer over the bytes of a piece. Each transition is annotated
with the tokens it emits: the count for the piece up to this byte less the count up to the byte
before, which may be below one, as bytes that follow can join tokens. A state holds what can still
join: for each start from which some token of the vocabulary is under way, the node reached in the
vocabulary's trie, the token that ends where it starts, and the count there. Of the tokens that
end at a byte only one is compatible with the token before it. States are made when first needed.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

CHUNK = 128
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, LEAD, LONE, END = range(9)
BETWEEN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, LED, ONE_MORE, TWO_MORE = range(8)
#: Pieces and states kept at most; what is dropped is made anew when needed.
PIECES, STATES = 300_000, 250_000


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER (white space) of each code point; END past the last."""
    out = np.full(0x110001, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            out[c] = LETTER if kind[0] == "L" else NUMBER
        elif kind[0] == "Z":
            out[c] = INNER
    out[[*range(9, 14), 0x85]] = INNER
    out[0x110000] = END
    return out


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by (state, class)."""
    to, starts = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for s in range(8):
        for c, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            to[s, c], starts[s, c] = run, s not in (run, LED)
        for c, more in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):  # an apostrophe before 's or 're: a piece with it, unless it goes on with others
            on = s in (IN_OTHERS, LED)
            to[s, c], starts[s, c] = IN_OTHERS if on else more, not on
        to[s, INNER], starts[s, INNER] = IN_SPACES, s != IN_SPACES
        to[s, LEAD], to[s, LONE] = LED, BETWEEN
        to[s, END], starts[s, END] = BETWEEN, False
    to[ONE_MORE, LETTER], starts[ONE_MORE, LETTER] = BETWEEN, False
    to[TWO_MORE, LETTER], starts[TWO_MORE, LETTER] = ONE_MORE, False
    return to, starts


def looked_ahead(points: np.ndarray) -> np.ndarray:
    """Classes of code points (texts end with 0x110000), with what the pattern looks ahead for."""
    c = classes()[points]
    after = np.r_[c[1:], END]
    last = (c == INNER) & (after != INNER) & (after != END)
    c = np.where(last, np.where(points == 32, LEAD, LONE), c).astype(np.uint8)
    at = np.flatnonzero(points[:-1] == 39)
    if len(at):
        a, b = points[at + 1], np.r_[points, 0x110000][at + 2]
        c[at[np.isin(a, [115, 116, 109, 100])]] = SHORT
        c[at[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)]] = LONG
    return c


def piece_starts(c: np.ndarray) -> np.ndarray:
    """Where pieces start: chunk maps, their prefix scan, and then all chunks from their states."""
    to, starts = machine()
    n = len(c)
    c = np.r_[c, np.full(-n % CHUNK, END, np.uint8)].reshape(-1, CHUNK).T.copy()
    maps = np.repeat(np.arange(8, dtype=np.uint8)[None], c.shape[1], 0)
    flat = to.ravel()
    for row in c:
        maps = flat[maps * np.uint8(9) + row[:, None]]
    d = 1
    while d < len(maps):
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d], 1)  # the right side is read whole before it is written
        d *= 2
    state, out = np.r_[np.uint8(BETWEEN), maps[:-1, BETWEEN]], np.empty(c.shape, bool)
    for k, row in enumerate(c):
        at = state * np.uint8(9) + row
        out[k] = starts.ravel()[at]
        state = flat[at]
    return np.flatnonzero(out.T.ravel()[:n])


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PieceTransducer(dict):
    """Pieces to token counts; ``self[piece]`` runs the transducer over a piece not seen before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        self.text = {k: t for t, k in vocabulary.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, k in vocabulary.items():
            node = 0
            for b in map(letters.get, t):
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = k
        self.fits: dict[tuple[int, int], bool] = {}
        self._emptied()

    def _emptied(self) -> None:
        self.ids, self.states, self.moves = {((0, -1, 0),): 0}, [((0, -1, 0),)], {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the model leaves the two tokens apart where they meet."""
        if a < 0:
            return True
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > PIECES:
                self.fits.clear()
            known = self.fits[a, b] = [t.id for t in self.model.tokenize(self.text[a] + self.text[b])] == [a, b]
        return known

    def move(self, state: int, b: int) -> tuple[int, int]:
        """The next state and the annotation of the transition; made when first needed."""
        on, found = [], None
        for node, before, count in self.states[state]:
            nxt = self.children[node].get(b)
            if nxt is not None:
                on.append((nxt, before, count))
                if found is None and self.token[nxt] >= 0 and self.compatible(before, self.token[nxt]):
                    found = self.token[nxt], count + 1
        token, emitted = found
        to = tuple((node, before, count - emitted) for node, before, count in on if self.children[node]) + ((0, token, 0),)
        if to not in self.ids:
            self.ids[to] = len(self.states)
            self.states.append(to)
        made = self.moves[state << 8 | b] = self.ids[to], emitted
        return made

    def __missing__(self, piece: str) -> int:
        if len(self) > PIECES:
            self.clear()
        if len(self.states) > STATES:
            self._emptied()
        state = total = 0
        moves = self.moves
        for b in piece.encode("utf-8", "surrogatepass"):
            state, emitted = moves.get(state << 8 | b) or self.move(state, b)
            total += emitted
        self[piece] = total
        return total


@cache
def compiled(path: str) -> tuple[PieceTransducer, re.Pattern | None]:
    """The transducer, and a pattern of the added tokens, which the library cuts out of a text first."""
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    return PieceTransducer(path), re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None


def counts(texts: list[str | None], path: str) -> list[int]:
    """The number of tokens of each text."""
    transducer, added = compiled(path)
    out, parts, owner = [0] * len(texts), [], []
    for k, t in enumerate(texts):
        pieces = added.split(t) if t and added else [t or ""]
        out[k] += len(pieces) - 1
        for p in pieces:
            if p:
                parts.append(p)
                owner.append(k)
    at = 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end]) < 1 << 20):
            size += len(parts[end]) + 1
            end += 1
        some = parts[at:end]
        one = "\0".join(some) + "\0"
        points = np.frombuffer(one.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        ends = np.cumsum([len(p) + 1 for p in some]) - 1
        points[ends] = 0x110000
        starts = piece_starts(looked_ahead(points))
        stops = np.r_[starts[1:], len(one)]
        first = np.searchsorted(starts, np.r_[0, ends])
        stops[first[1:] - 1] = ends
        a, b = starts.tolist(), stops.tolist()
        for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            out[owner[at + k]] += sum(transducer[one[a[x] : b[x]]] for x in range(i, j))
        at = end
    return out


def counted(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, as the library counts for the vocabulary at ``path``.

    A null or empty text has no bytes and no tokens; repeated rows give a row each; a null doc_id
    is kept. Memory is bounded: about a million characters are split at a time (or one text), and
    the tables of pieces and states are emptied when full. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            n = np.array(counts(texts, path), np.int64)
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
