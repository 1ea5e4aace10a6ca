"""Quality rules: rule statistics of every document, and an isolation forest over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded, small_batches, tidied, unfolded, written

SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACES = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


def repeated_words(words: list[str], width: int = 3) -> int:
    """How many words stand in a window of ``width`` words that the text has twice or more."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    if not twice:
        return 0
    count, end = 0, 0
    for k, w in enumerate(windows):
        if w in twice:
            count += k + width - max(k, end)
            end = k + width
    return count


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of one text; a null has no words."""
    if not text:
        return (0, 0, 0, 0, 0)
    words = WORDS.findall(text)
    seen: set = set()
    dups = sum(1 for line in text.split("\n") if WORDS.search(line) and (line in seen or seen.add(line)))
    return len(words), len(text) - len(SPACES.findall(text)), len(SYMBOLS.findall(text)), dups, repeated_words(words)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED_PERCENT * counts[:, 0])


#: Statistics of what words are made of, and of what is repeated: a forest and a threshold each.
GROUPS = ((0, 1), (2, 3))


def features(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the statistics a word, so that a text's length alone is no anomaly."""
    return np.log10(counts[:, 1:].astype(float) / np.maximum(counts[:, :1], 1) + 0.01)


class IsolationForest:
    """Random axis-parallel trees (Liu, Ting and Zhou, 2008); a short path marks an anomaly.

    Splits are drawn over the box ``low`` to ``high``, which may reach beyond the rows, so that
    regions where no row lies are cut off early. As they don't depend on the rows, every tree counts
    all rows, task by task (``leaves_of``, ``settle``), and the counts are scaled to those of
    ``sample`` rows: what a sample of that size would have in a node in the mean, without drawing one.
    """

    def __init__(self, rows: np.ndarray | None, low: np.ndarray, high: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        self.sample, self.depth = sample, int(np.ceil(np.log2(sample)))
        self.trees = [self._drawn(low, high, np.random.default_rng([seed, k])) for k in range(trees)]
        if rows is not None:
            self.settle(np.array([np.bincount(x, minlength=1 << self.depth) for x in self.leaves_of(rows)]))

    @staticmethod
    def expected(n) -> np.ndarray:
        """The mean path of a failed search among n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _drawn(self, low: np.ndarray, high: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
        """feature and split of each inner node; the children of node k are 2 k + 1 and 2 k + 2."""
        inner = (1 << self.depth) - 1
        feature, split, box = np.zeros(inner, int), np.zeros(inner), [(low, high)]
        wide = np.flatnonzero(high > low)
        for k in range(inner):
            lo, hi = box[k]
            f = int(rng.choice(wide)) if len(wide) else 0
            feature[k], split[k] = f, rng.uniform(lo[f], hi[f])
            under, over = hi.copy(), lo.copy()
            under[f] = over[f] = split[k]
            box += [(lo, under), (over, hi)]
        return feature, split

    def leaves_of(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each row."""
        each = np.arange(len(rows))
        for feature, split in self.trees:
            node = np.zeros(len(rows), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[each, feature[node]] > split[node])
            yield node - len(feature)

    def settle(self, counts: np.ndarray) -> None:
        """Take the counts of all rows (trees x leaves): a leaf's path ends at the first node above it of less than two rows."""
        self.rows = int(counts[0].sum())
        self.size = min(self.sample, self.rows)
        self.paths = np.full(counts.shape, -1.0)
        for depth in range(self.depth + 1):
            width = 1 << self.depth - depth
            n = np.repeat(counts.reshape(len(counts), -1, width).sum(2), width, axis=1) * (self.size / max(self.rows, 1))
            ends = (self.paths < 0) & ((n < 2) | (depth == self.depth))
            self.paths[ends] = depth + self.expected(n[ends])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """In (0, 1); over about 0.5 for anomalies."""
        total = np.zeros(len(rows))
        for leaf, path in zip(self.leaves_of(rows), self.paths, strict=True):
            total += path[leaf]
        return 2.0 ** (-total / len(self.trees) / max(float(self.expected(self.size)), 1e-9))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = np.array([rule_counts(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, counts.T)], ["doc_id", *COUNTS])


def counted(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidied(_counted), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


class Model:
    """A forest and a threshold for each group of statistics."""

    def __init__(self, forests: list[IsolationForest], limits: list[float]):
        self.parts = list(zip(map(list, GROUPS), forests, limits, strict=True))

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """The largest excess of a score over its threshold: over zero for an anomaly."""
        return np.max([forest.score(rows[:, g]) - limit for g, forest, limit in self.parts], axis=0)


def _features_of(b: pa.RecordBatch) -> np.ndarray:
    return features(np.array([b.column(c).to_numpy(zero_copy_only=False) for c in COUNTS], np.int64).T)


def fitted(docs: DataFrame, labels: DataFrame, good_kept: float = 0.999, trees: int = 100) -> Model | None:
    """Forests and thresholds from all labelled documents.

    Half of the rows of quality 1 grow the trees, the other half calibrates: a threshold is the
    score under which ``good_kept`` of them stay. Rows of other quality widen the box of splits.
    Tasks count and score the rows; the driver gets the counts of the leaves and the highest scores.
    None if there is too little to learn from.
    """
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    x = counted(docs).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("x")).join(some, "doc_id")
    x = x.select(F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half"), (F.col("quality") == 1).alias("good"), "x.*")
    x = written(x.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEATED_PERCENT} * n_words"), "quality-rows")
    grow, rest = x.where("good and half = 0"), x.where("good and half = 1")
    shares = [F.col(c) / F.col("n_words") for c in COUNTS[1:]]
    n_grow, n_rest, *ends = x.agg(F.count_if(F.expr("good and half = 0")), F.count_if(F.expr("good and half = 1")), *map(F.min, shares), *map(F.max, shares)).first()
    if n_grow < 8 or n_rest < 8:
        return None
    low, high = np.log10(np.array(ends) + 0.01).reshape(2, -1)
    forests = [IsolationForest(None, low[list(g)], high[list(g)], trees) for g in GROUPS]
    leaves = 1 << forests[0].depth

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(GROUPS) * trees, leaves), np.int64)
        for b in batches:
            f = _features_of(b)
            for k, leaf in enumerate(leaf for g, forest in zip(GROUPS, forests, strict=True) for leaf in forest.leaves_of(f[:, list(g)])):
                counts[k] += np.bincount(leaf, minlength=leaves)
        tree, leaf = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(leaf), pa.array(counts[tree, leaf])], ["tree", "leaf", "n"])

    found = grow.mapInArrow(tidied(grown), "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(GROUPS), trees, leaves), np.int64)
    counts.reshape(-1, leaves)[found["tree"].to_numpy(), found["leaf"].to_numpy()] = found["n"].to_numpy()
    for forest, own in zip(forests, counts, strict=True):
        forest.settle(own)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _features_of(b)
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(f[:, list(g)])) for g, forest in zip(GROUPS, forests, strict=True)], names)

    names = [f"s{k}" for k in range(len(GROUPS))]
    scores = written(rest.mapInArrow(tidied(scored), ", ".join(f"{c} double" for c in names)), "quality-scores")
    above = n_rest - min(n_rest - 1, int(good_kept * n_rest))
    return Model(forests, [scores.select(c).orderBy(F.desc(c)).limit(above).agg(F.min(c)).first()[0] + 1e-9 for c in names])


def judged(docs: DataFrame, labels: DataFrame, extra: tuple[str, ...] = (), **how) -> DataFrame:
    """``doc_id``, ``COUNTS``, ``base_failed``, ``kept`` and ``anomaly``, and the columns ``extra`` of docs, of every row.

    The forests and their thresholds are a bounded object that goes to the tasks with the function. A
    null or empty text has no words and fails. Equal texts get equal verdicts, repeated rows a row
    each; labels with a null are left out, of repeated ones the worst counts. With fewer than 8
    usable labelled rows in either half there is no forest: only the base rules then decide, and
    anomaly is null. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = fitted(docs, labels, **how)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.array([rule_counts(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, 5)
            failed = base_failed(counts)
            score = model.anomaly(features(counts)) if model else np.zeros(len(counts))
            kept = ~failed & (score <= 0)
            own = [b.column(c) for c in ("doc_id", *extra)]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, counts.T), pa.array(failed), pa.array(kept), pa.array(score, mask=np.full(len(score), model is None))], names)

    names = ["doc_id", *extra, *COUNTS, "base_failed", "kept", "anomaly"]
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *extra)] + [f"{c} long" for c in COUNTS] + ["base_failed boolean", "kept boolean", "anomaly double"])
    return docs.select(*dict.fromkeys(["doc_id", "text", *extra])).mapInArrow(tidied(rated), schema)


def filtered(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    x = judged(folded(docs, "doc_id", "text"), labels, ("text", "_row"), **how).where("kept")
    return unfolded(x, docs.columns, "doc_id", "text")
