"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every partition tokenises its texts, cuts documents longer than a sequence into
pieces, and packs the pieces best-fit into bins. Nearly full bins are final.
The others go on as items: a tree of merges gathers the underfull bins of
several partitions, packs them best-fit again as whole items, emits those that
are nearly full by then, and hands the rest to the next level. A level's tasks
hold a bounded number of items each; the tree ends when one task has seen all
that is left, or when a level merges nothing.

Null and empty texts are one piece that holds the end id. Repeated rows are
packed once each; pieces of equal length are placed in row order.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import Memo, chunks, ranges, worker_memo
from apexframe.session import scratch_dir

CAPACITY = 2048
FULL = 2032  # a bin with this many tokens is emitted at once
TASK_ITEMS = 40_000
MARKS = (".", ",")
WORDS = 800_000  # words a worker keeps the ids of, some 200 MB
ITEM = "struct<doc_id: {kind}, piece: int, start: long, length: long, ids_crc32: long, offset: long>"


class WordIds:
    """Token ids of whole texts, put together from the ids of their words.

    The tokenizer neither joins nor looks across blanks and newlines, so a text
    is split there and each distinct word is encoded once a worker. Text with
    other white space inside a word is encoded as it is.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.flat, self.size = np.zeros(1 << 16, np.uint32), 0
        self.seen, self.apart = set(map(chr, range(128))), {"Σ"}  # its small form depends on the word
        # Which ids end a word. A word has one such id if any byte may end it.
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix and all(letter + suffix in vocabulary for letter in ByteLevel.alphabet()):
            self.ends[[number for word, number in vocabulary.items() if word.endswith(suffix)]] = True
        self.memo = Memo(self._encode, WORDS)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """Places of the words' ids in ``flat``. Marks at a word's end are words of their own
        to the tokenizer, and it lowers letters, so plain words with and without marks, in
        capitals or not, share one encoding."""
        place, stems, marks, others = {}, [], [], []
        self._look_at(set("".join(words)))
        for word in words:
            stem, mark = word, 0
            plain = word.isalpha()
            if not plain and word[-1:] in MARKS:
                stem, mark = word[:-1], 1 + (word[-1] == ",")
                plain = stem.isalpha()
            if plain and (stem.isascii() or self.apart.isdisjoint(stem)):
                stems.append(place.setdefault(stem.lower(), len(place)))
            else:
                stems.append(-1)
                others.append(word)
            marks.append(mark)
        stem, mark = np.array(stems, np.int64), np.array(marks, np.int64)
        lengths, ids = self._joined(list(place))
        other = [x.ids for x in self.tokenizer.encode_batch(others, add_special_tokens=False)]
        mark_ids = [self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in (".", ",")]
        # One buffer: the stems' ids, the two marks, the other words' ids.
        lengths = np.concatenate([lengths, np.fromiter(map(len, other), np.int64, len(other))])
        buffer = np.concatenate([ids, np.array(mark_ids, np.uint32), np.array([i for x in other for i in x], np.uint32)])
        starts = np.cumsum(lengths) - lengths
        starts[len(place) :] += 2
        source = stem.copy()
        source[stem < 0] = len(place) + np.arange(len(others))
        tail = ((stem >= 0) & (mark > 0)).astype(np.int64)
        pairs = np.stack([starts[source], len(ids) + np.maximum(mark - 1, 0)], 1).ravel()
        found = buffer[ranges(pairs, np.stack([lengths[source], tail], 1).ravel())]
        sizes = lengths[source] + tail
        at = self.size + np.cumsum(sizes) - sizes
        need = self.size + len(found)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, np.uint32)])
        self.flat[self.size : need], self.size = found, need
        return [at, sizes]

    def _look_at(self, chars: set[str]) -> None:
        """Note the letters of which the normaliser doesn't leave letters only, and those
        that it lowers in another way. It takes some apart into a letter and a sign, and
        the sign joins a mark that follows."""
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer is not None else str
        for char in chars - self.seen:
            if char.isalpha() and not (normal(char).isalpha() and normal(char) == normal(char.lower())):
                self.apart.add(char)
        self.seen |= chars

    def _joined(self, words: list[str], size: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of words of letters, encoded many at a time."""
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for k in range(0, len(words), size):
            own = words[k : k + size]
            # Without offsets and word numbers; the last id of a word tells where it ends.
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            of_word = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
            if len(of_word) != len(own):  # a letter that the normaliser takes apart
                single = self.tokenizer.encode_batch(own, add_special_tokens=False)
                lengths.append(np.fromiter((len(x.ids) for x in single), np.int64, len(own)))
                ids.append(np.array([i for x in single for i in x.ids], np.uint32))
            else:
                lengths.append(of_word)
                ids.append(found)
        return np.concatenate(lengths), np.concatenate(ids)

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the n + 1 places where texts begin."""
        if self.memo.trim():
            kept = self.memo.columns or [np.zeros(0, np.int64)] * 2
            found = self.flat[ranges(*kept)]
            self.flat[: len(found)], self.size = found, len(found)
            kept[0][:] = np.cumsum(kept[1]) - kept[1]
        words, counts = [], []
        for text in texts.to_pylist():
            own = text.replace("\n", " ").split(" ")
            words += own
            counts.append(len(own))
        rows = self.memo.rows(words)
        starts, lengths = (x[rows] for x in self.memo.columns) if len(rows) else (np.zeros(0, np.int64),) * 2
        word_ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[ranges(starts, lengths)], word_ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]


def best_fit(lengths: np.ndarray, capacity: int, rest: Callable[[int], None] | None = None) -> list[list[int]]:
    """Bins of item numbers; largest items first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    spaces: list[int] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        at = bisect_left(spaces, length)
        if at < len(spaces):
            space = spaces[at]
            owner = by_space[space].pop()
            if not by_space[space]:
                del by_space[space]
                spaces.pop(at)
            bins[owner].append(item)
        else:
            space, owner = capacity, len(bins)
            bins.append([item])
        left = space - length
        if left:
            if left not in by_space:
                insort(spaces, left)
            by_space.setdefault(left, []).append(owner)
    return bins


def _bin_batch(bins: list[tuple[int, int, list[dict]]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bin": [b[0] for b in bins], "total": [b[1] for b in bins], "items": [b[2] for b in bins]}, schema=schema)


def _arrow_schema(kind: pa.DataType) -> pa.Schema:
    item = pa.struct([("doc_id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
    return pa.schema([("bin", pa.int64()), ("total", pa.int64()), ("items", pa.list_(item))])


def _packed(levels: np.ndarray, names: list[int], items: list[list[dict]], schema: pa.Schema, capacity: int) -> Iterator[pa.RecordBatch]:
    out = []
    for members in best_fit(levels, capacity):
        at = 0
        for m in members:
            for x in items[m]:
                x["offset"] += at  # from the place in its old bin to that in the new one
            at += int(levels[m])
        out.append((names[members[0]], int(levels[members].sum()), [x for m in members for x in items[m]]))
    for k in range(0, len(out), 5000):
        yield _bin_batch(out[k : k + 5000], schema)


def local_bins(documents: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Best-fit bins of each partition: bin, total, items."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_memo(("packing", tokenizer), lambda: WordIds(tokenizer))
        number = TaskContext.get().partitionId() << 33
        items, schema = [], None
        for batch, texts in chunks(batches, "text"):
            schema = schema or _arrow_schema(batch.schema.field("id").type)
            ids, places = words.ids(texts)
            for row, doc in enumerate(batch.column("id").to_pylist()):
                own = np.append(ids[places[row] : places[row + 1]], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    items.append({"doc_id": doc, "piece": piece, "start": start, "length": len(part), "ids_crc32": zlib.crc32(part.tobytes()), "offset": 0})
            if len(items) >= TASK_ITEMS:  # a partition of any size stays within memory
                yield from _packed(np.array([x["length"] for x in items]), list(range(number, number + len(items))), [[x] for x in items], schema, capacity)
                number, items = number + len(items), []
        if items:
            yield from _packed(np.array([x["length"] for x in items]), list(range(number, number + len(items))), [[x] for x in items], schema, capacity)

    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"bin long, total long, items array<{ITEM.format(kind=kind)}>")


def merged_bins(bins: DataFrame, capacity: int) -> DataFrame:
    """Best-fit over the whole bins of each partition of ``bins``."""
    schema = bins.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, totals, items, kind = [], [], [], None
        for batch in batches:
            kind = batch.schema
            names += batch.column("bin").to_pylist()
            totals += batch.column("total").to_pylist()
            items += batch.column("items").to_pylist()
        if names:
            order = np.argsort(names)
            yield from _packed(np.array(totals)[order], [names[k] for k in order], [items[k] for k in order], kind, capacity)

    return bins.mapInArrow(run, schema)


def pack(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, full: int = FULL, end_id: int = 0, task_items: int = TASK_ITEMS, fan_in: int = 16) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Each level of the tree is written to the shared folder, so a lost executor
    repeats one task of one level. Levels after the first hold narrow rows only.
    """
    spark = documents.sparkSession
    folder = scratch_dir(spark, "packing")
    local_bins(documents, tokenizer, id_col, text_col, capacity, end_id).write.parquet(f"{folder}/0")
    levels, level = [], 0
    while True:
        bins = spark.read.parquet(f"{folder}/{level}")
        levels.append(bins.where(F.col("total") >= full))
        under = bins.where(F.col("total") < full)
        # One row a partition: how many underfull bins it left.
        left = under.count()
        tasks = max(-(-left // task_items), 1)
        if level:
            tasks = max(tasks, min(previous_tasks // fan_in, left))
            if left >= before or previous_tasks == 1:
                levels.append(under)
                break
        else:
            tasks = max(tasks, 1 + bins.rdd.getNumPartitions() // fan_in)
        if left < 2:
            levels.append(under)
            break
        merged_bins(under.repartition(tasks, F.xxhash64("bin", F.lit(level))), capacity).write.parquet(f"{folder}/{level + 1}")
        before, previous_tasks, level = left, tasks, level + 1
    bins = levels[0]
    for more in levels[1:]:
        bins = bins.unionByName(more)
    placed = bins.select(F.col("bin").alias("sequence_id"), F.explode("items").alias("item"))
    return placed.select(F.col("item.doc_id").alias(id_col), "item.piece", "item.start", "item.length", "item.ids_crc32", "sequence_id", "item.offset")
