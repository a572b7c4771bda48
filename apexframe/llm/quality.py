"""Quality rules: an isolation forest over the rule statistics of a document.

Random splits of trees grown on documents labelled good isolate documents with
unusual statistics after few splits. Each tree splits on one group of related
statistics, so that an oddity in one group isn't averaged away by the others;
a group's score comes from the path lengths in its trees. The share of labelled
good documents that may be lost sets the thresholds. Two base rules reject on
their own.

Null and empty texts have no words: all counts are 0, and the word-count rule
rejects them. Repeated rows get equal verdicts. Without labelled good rows there
is no forest and only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import chunks, filtered, keep_only, segment_sums
from apexframe.llm.shingles import SPACE, Words
from apexframe.operators.groups import value_positions
from apexframe.session import stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_chars", "n_upper", "n_marks", "n_distinct")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS + EXTRA)


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL = _class(b"#*$%&|<>")
_UPPER = _class(bytes(range(65, 91)))
_MARK = _class(b"!?;")
_LEAD = (np.arange(256) & 0xC0) != 0x80


def statistics(texts: pa.StringArray) -> dict[str, np.ndarray]:
    """Rule statistics of each text, as whole numbers."""
    words = Words(texts)
    data, offsets, n = words.data, words.offsets, words.counts()

    def count(of: np.ndarray) -> np.ndarray:
        return segment_sums(of[data], offsets)

    # Lines: cut at every newline and at row ends.
    newline = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    start = start[start < len(data)]
    row = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(data)), offsets[row + 1])
    end = np.where((end > start) & (data[np.maximum(end - 1, 0)] == 10), end - 1, end)
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[filled], end[filled], row[filled]
    n_lines = np.bincount(row, minlength=len(n))
    repeats = _repeated(row, words.span_hashes(start, end), first=False)
    n_dup_lines = np.bincount(row[repeats], minlength=len(n))

    hashes, places = words.windows(3)
    of_row = np.repeat(np.arange(len(n)), np.diff(places))
    twice = _repeated(of_row, hashes, first=True)
    at = words.first[of_row] + np.arange(len(hashes)) - places[of_row]
    starts = np.zeros(len(words.start) + 2, bool)
    starts[at[twice]] = True
    covered = starts[:-2].copy()
    covered[1:] |= starts[:-3]
    covered[2:] |= starts[:-4]
    word_row = np.repeat(np.arange(len(n)), n)
    return {
        "n_words": n,
        "word_chars": count(_LEAD & ~SPACE),
        "n_symbols": count(_SYMBOL),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": segment_sums(covered, words.first),
        "n_lines": n_lines,
        "n_chars": count(_LEAD),
        "n_upper": count(_UPPER),
        "n_marks": count(_MARK),
        "n_distinct": n - np.bincount(word_row[_repeated(word_row, words.hash, first=False)], minlength=len(n)),
    }


def _repeated(row: np.ndarray, hashes: np.ndarray, first: bool) -> np.ndarray:
    """Which items occur twice or more in their row; without ``first`` the earliest isn't marked."""
    order = np.lexsort((np.arange(len(row)), hashes, row))
    same = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    marked = np.zeros(len(row), bool)
    marked[order[1:][same]] = True
    if first:
        marked[order[:-1][same]] = True
    return marked


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    n = stats["n_words"]
    return (n < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios that the forest splits on, one row a document."""
    words, chars, lines = (np.maximum(stats[c], 1).astype(float) for c in ("n_words", "n_chars", "n_lines"))
    return np.stack(
        [
            stats["n_symbols"] / words,
            stats["n_marks"] / words,
            stats["n_upper"] / chars,
            stats["n_dup_lines"] / lines,
            stats["n_repeat_words"] / words,
            np.sqrt(stats["n_distinct"] / np.sqrt(words)),
            stats["word_chars"] / words,
            np.minimum(words / lines, 200.0),
        ],
        1,
    )


# Columns of ``features`` by group: symbols, marks, capitals, repetition, variety, shape.
GROUPS = ((0,), (1,), (2,), (3, 4), (5,), (6, 7))


@dataclass
class Forest:
    """Isolation trees as arrays: split feature (-1 at a leaf), cut, children, path length.

    Tree k splits on the features of group k mod the number of groups.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    norm: float
    thresholds: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row and group, 0 to 1; near 1 means isolated after few splits."""
        total, rows = np.zeros((len(x), len(GROUPS))), np.arange(len(x))
        for k, (feature, cut, left, length) in enumerate(zip(self.feature, self.cut, self.left, self.length, strict=True)):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                value = x[rows, np.maximum(feature[node], 0)]
                node = np.where(inner, left[node] + (value >= cut[node]), node)
            total[:, k % len(GROUPS)] += length[node]
        return 2.0 ** (-total / (len(self.feature) / len(GROUPS) * self.norm))


def _expected(n: float) -> float:
    """Mean path length of a failed search among n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_forest(x: np.ndarray, trees: int = 32 * len(GROUPS), rows: int = 256, seed: int = 7) -> Forest:
    """Trees over random subsamples, split at random cuts of random features.

    The range a cut is drawn from exceeds the node's values by a quarter of their
    range and 0.02, so that
    values outside what the sample holds also meet splits.
    """
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    size = 2 ** (depth + 1)
    parts = [np.full((trees, size), v, t) for v, t in ((-1, np.int64), (0.0, float), (0, np.int64), (0.0, float))]
    for tree in range(trees):
        feature, cut, left, length = (p[tree] for p in parts)
        group = GROUPS[tree % len(GROUPS)]
        todo, free = [(0, rng.choice(len(x), rows, replace=False), 0)], 1
        while todo:
            node, ids, level = todo.pop()
            low, high = (f(x[ids], axis=0) for f in (np.min, np.max)) if len(ids) else (np.zeros(x.shape[1]),) * 2
            if level == depth or len(ids) <= 1:
                length[node] = level + _expected(len(ids))
                continue
            pick = group[rng.integers(len(group))]
            margin = 0.25 * (high[pick] - low[pick]) + 0.02
            feature[node], cut[node] = pick, rng.uniform(low[pick] - margin, high[pick] + margin)
            left[node], free = free, free + 2
            right = x[ids, pick] >= cut[node]
            todo += [(left[node], ids[~right], level + 1), (left[node] + 1, ids[right], level + 1)]
    return Forest(*parts, norm=_expected(rows) or 1.0, thresholds=np.full(len(GROUPS), 2.0))


def document_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and rule statistics of every document, in one pass over the texts."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch, texts in chunks(batches, "text"):
            stats = statistics(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(stats[c], pa.int64()) for c in COUNTS + EXTRA)], names=["id", *COUNTS, *EXTRA])

    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def fit(stats: DataFrame, labels: DataFrame, rows: int = 20_000, lost: float = 0.0005, id_col: str = "doc_id") -> Forest | None:
    """Forest over documents labelled good, and its thresholds.

    A hash of the id deals the good documents into two halves. The trees, each of
    which is grown on few rows by its method, draw these from at most ``rows``
    documents of the first half. A group's threshold is the score that a share
    ``lost`` of all documents of the second half exceeds, plus a small margin.
    """
    good = labels.where("quality = 1").select(id_col).distinct()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    known = stage(stats.join(good, id_col, "left_semi").where(~failed))
    half = F.pmod(F.xxhash64(F.lit("half"), id_col), F.lit(2))
    grown, others = known.where(half == 0), known.where(half == 1)
    if known.count() < 8:
        return None
    if grown.isEmpty() or others.isEmpty():
        grown = others = known
    drawn = grown.orderBy(F.xxhash64(id_col), *COUNTS, *EXTRA).limit(rows).toPandas()
    forest = grow_forest(features({c: drawn[c].to_numpy() for c in COUNTS + EXTRA}))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = forest.scores(features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS + EXTRA}))
            name = np.tile(np.arange(len(GROUPS), dtype=np.int32), len(scores))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(scores.reshape(-1))], names=["name", "score"])

    forest.thresholds = _quantiles(others.select(*COUNTS, *EXTRA).mapInArrow(scored, "name int, score double"), 1 - lost) + 0.01
    return forest


def _quantiles(scores: DataFrame, share: float) -> np.ndarray:
    """The interpolated quantile of each group's scores, by the positions of all of them."""
    place = F.lit(share) * (F.col("_group_rows") - 1)
    first, end = F.col("_rows_before"), F.col("_rows_before") + F.col("_own_rows")
    holds = [(first <= at) & (at < end) for at in (F.floor(place), F.ceil(place))]
    part = (place - F.floor(place)).alias("part")
    # At most two values a group.
    found = value_positions(scores, ["name"], "score").where(holds[0] | holds[1]).select("name", "score", part).collect()
    ends = [[r for r in found if r["name"] == k] for k in range(len(GROUPS))]
    ends = [(min(r["score"] for r in own), max(r["score"] for r in own), own[0]["part"]) for own in ends]
    return np.array([low + part * (high - low) for low, high, part in ends])


def verdicts(stats: dict[str, np.ndarray], forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base failure, anomaly score and whether the document is kept."""
    failed = base_failed(stats)
    if forest is None:
        return failed, np.zeros(len(failed)), ~failed
    scores = forest.scores(features(stats))
    return failed, scores.max(axis=1, initial=0.0), ~failed & (scores <= forest.thresholds).all(axis=1)


def quality_rules(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> DataFrame:
    """Statistics, base failure, anomaly score and verdict of every document.

    The texts are read once: the narrow statistics are staged, the forest is
    fitted on those of the documents labelled good and applied to all.
    """
    stats = stage(document_statistics(documents, id_col, text_col))
    forest = fit(stats, labels, sample_rows, id_col=id_col)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS + EXTRA}
            failed, score, kept = verdicts(table, forest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(score), pa.array(kept)], names=["id", *COUNTS, *EXTRA, "base_failed", "anomaly", "kept"])

    out = f"id {kind}, {SCHEMA}, base_failed boolean, anomaly double, kept boolean"
    return stats.withColumnRenamed(id_col, "id").mapInArrow(run, out).withColumnRenamed("id", id_col)


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> DataFrame:
    """Documents that pass, with all their columns.

    The texts are read twice: for the statistics that the fit needs, and for the
    verdicts, so that no text is moved or staged.
    """
    forest = fit(stage(document_statistics(documents, id_col, text_col)), labels, sample_rows, id_col=id_col)
    return filtered(documents, text_col, lambda texts: verdicts(statistics(texts), forest)[2])
