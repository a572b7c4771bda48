"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is five words in a row. A sketch keeps the k smallest distinct hashes
of a text's shingles. Sketches of parts merge into that of the whole by taking
the k smallest of their union. The k smallest hashes of the union of two
documents are a random sample of their shingles: the share held by both
estimates resemblance, and the k-th smallest hash tells how many there are.

Null and empty texts and texts without words have an empty sketch; a text of
fewer than five words has one shingle of all its words. Equal texts have equal
sketches and likeness 1, also if empty; an empty and another sketch have 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import CHUNK_BYTES, chunks, ranges
from apexframe.llm.shingles import Words, unique_per_row

SHINGLE = 5
K = 128


def sketches(texts: pa.StringArray, k: int = K, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending sketch hashes of all texts on end, and the n + 1 places of texts."""
    hashes, places = unique_per_row(*Words(texts).windows(shingle, whole_short=True))
    sizes = np.minimum(np.diff(places), k)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return hashes[np.repeat(places[:-1] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of two parts together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of either that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = merge(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), least, assume_unique=True).sum() / len(least))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has: common shingles over those of a."""
    if not len(a):
        return 1.0
    if not len(b):
        return 0.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def _resemblances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Row by row resemblance of two lists of sketches."""
    n = len(a[1]) - 1
    sizes = np.diff(a[1]), np.diff(b[1])
    row = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
    value = np.concatenate([a[0], b[0]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    both = np.zeros(len(row), bool)
    both[:-1] = ~new[1:]
    union_row = row[new]
    first = np.searchsorted(union_row, np.arange(n))
    rank = np.arange(len(union_row)) - first[union_row]
    least = rank < k
    common = np.bincount(union_row[least & both[new]], minlength=n)
    total = np.bincount(union_row[least], minlength=n)
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def _hex(sketch: tuple[np.ndarray, np.ndarray]) -> pa.StringArray:
    """Sketches as text, 16 hexadecimal digits a hash."""
    text = sketch[0].astype(">u8").tobytes().hex().encode()
    offsets = (sketch[1] * 16).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Id and sketch of every document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _hex(sketches(texts, k))], names=["id", "fingerprint"])

    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets_per_task: int = 8) -> DataFrame:
    """Rows by ascending id, dealt into buckets of neighbouring ids.

    Each bucket but the last also holds the row that follows it (``extra``), so
    that every row meets its successor in one task: one shuffle of the texts and
    no task that sees more than its buckets. The bounds are quantiles of the ids;
    the list of bucket heads on the driver is bounded by the number of buckets.
    The last bucket is followed by the table's first row.
    """
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    buckets = tasks * buckets_per_task
    steps = [i / buckets for i in range(1, buckets)]
    cuts = narrow.select(F.percentile_approx("id", steps, 10 * buckets).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    heads = np.array(_heads(narrow.select("id"), cuts), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            bucket = np.searchsorted(heads, ids, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int32)), pa.array(np.zeros(len(ids), bool))], names=["id", "text", "bucket", "extra"])
            is_head = (bucket >= 0) & (heads[bucket] == ids)
            if is_head.any():
                again = batch.filter(pa.array(is_head))
                before = ((bucket[is_head] - 1) % len(heads)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(before), pa.array(np.ones(len(before), bool))], names=["id", "text", "bucket", "extra"])

    dealt = narrow.mapInArrow(deal, "id long, text string, bucket int, extra boolean")
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "extra", "id", "text")


def _heads(ids: DataFrame, cuts: list[int]) -> list[int]:
    """Smallest id of each non-empty bucket between the cuts: one number a bucket."""
    cut = np.array(cuts, np.int64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.full(len(cut) + 1, np.iinfo(np.int64).max)
        for batch in batches:
            own = batch.column("id").to_numpy()
            np.minimum.at(found, np.searchsorted(cut, own, side="right"), own)
        there = np.flatnonzero(found != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(found[there])], names=["bucket", "id"])

    found = ids.mapInArrow(least, "bucket long, id long").groupBy("bucket").agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in found.collect())


def against_edited(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketches of each text and of its edited text, and how alike they and the next text's are.

    The edited text has its last half, rounded down, replaced by the first as
    many code points, or all, of the next document by ascending id; the first
    document follows the last. Rows with a null id take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, str, int, bool]] = []
        size = 0
        for batch, texts in chunks(batches, "text", CHUNK_BYTES // 2):
            rows = zip(batch.column("id").to_pylist(), texts.to_pylist(), batch.column("bucket").to_pylist(), batch.column("extra").to_pylist(), strict=True)
            waiting += rows
            size = sum(len(r[1]) for r in waiting)
            if size >= CHUNK_BYTES // 2:
                yield from _compared(waiting, k)
                waiting = waiting[-1:]
        yield from _compared(waiting, k)

    kind = documents.schema[id_col].dataType.simpleString()
    out = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    compared = with_next(documents, id_col, text_col).mapInArrow(run, out)
    return compared.select(F.col("id").cast(kind).alias(id_col), *compared.columns[1:])


def _compared(rows: list[tuple[int, str, int, bool]], k: int) -> Iterator[pa.RecordBatch]:
    """Comparison of each row with the one behind it in its bucket; the last row only serves."""
    pairs = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
    if not pairs:
        return
    edited = []
    for i in pairs:
        text = rows[i][1]
        half = len(text) // 2
        edited.append(text[: len(text) - half] + rows[i + 1][1][:half])
    own = sketches(pa.array([r[1] for r in rows], pa.string()), k)
    changed = sketches(pa.array(edited, pa.string()), k)
    here, behind = (_taken(own, np.array(pairs) + d) for d in (0, 1))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][0] for i in pairs], pa.int64()),
            pa.array([len(rows[i][1]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
            _hex(here),
            _hex(changed),
            pa.array(_resemblances(here, changed, k)),
            pa.array(_resemblances(here, behind, k)),
            pa.array([distinct(here[0][a:b], k) for a, b in zip(here[1][:-1], here[1][1:], strict=True)]),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"],
    )


def _taken(sketch: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(sketch[1])[rows]
    return sketch[0][ranges(sketch[1][rows], sizes)], np.concatenate([[0], np.cumsum(sizes)])
