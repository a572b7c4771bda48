"""Arrow helpers shared by the operators: bounded chunks of text, memos of words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Slices of the batches with at most about ``limit`` bytes of ``column``.

    Yields each slice with its texts, null as empty. A slice has one row at
    least, so a single text may be longer than the limit.
    """
    for batch in batches:
        texts = batch.column(column).cast(pa.string()).fill_null("")
        n, start = len(texts), 0
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        while start < n:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(start, end - start), texts.slice(start, end - start)
            start = end


def raw_text(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text array and the n + 1 byte offsets of its rows."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each of the n ranges between n + 1 offsets."""
    sums = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


class _Index(dict):
    """Number of each word; a word met for the first time gets the next one."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Memo:
    """What ``compute`` says of each distinct word, kept between batches.

    ``compute`` takes a list of words and returns arrays with one row a word.
    When more than ``limit`` words are held, those met only once go, and all if
    that leaves too many, so memory is bounded; results don't depend on it.
    """

    def __init__(self, compute: Callable[[list[str]], Sequence[np.ndarray]], limit: int = 300_000) -> None:
        self.compute, self.limit = compute, limit
        self._reset()

    def _reset(self) -> None:
        self.index, self.columns, self.filled, self.met = _Index(), None, 0, np.zeros(0, np.int32)

    def trim(self) -> bool:
        """To be called between chunks. If true, row numbers handed out before are void."""
        if len(self.index) <= self.limit:
            return False
        kept = np.flatnonzero(self.met[: self.filled] > 1)
        if len(kept) > self.limit * 2 // 3:
            self._reset()
            return True
        words, columns = list(self.index), [x[kept] for x in self.columns]
        self._reset()
        for number, old in enumerate(kept.tolist()):
            self.index[words[old]] = number
        self.columns, self.filled, self.met = columns, len(kept), np.ones(len(kept), np.int32)
        return True

    def rows(self, words: Sequence[str]) -> np.ndarray:
        """Row numbers of the words in ``columns``."""
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        if self.index.new:
            new, self.index.new = self.index.new, []
            found = self.compute(new)
            if self.columns is None:
                self.columns = [np.zeros((0, *x.shape[1:]), x.dtype) for x in found]
            need = self.filled + len(new)
            if need > len(self.met):
                size = max(need, len(self.met) * 3 // 2, 1024)
                self.columns = [_grown(x, size) for x in self.columns]
                self.met = _grown(self.met, size)
            for column, x in zip(self.columns, found, strict=True):
                column[self.filled : need] = x
            self.filled = need
        if len(numbers):
            found = np.bincount(numbers)
            self.met[: len(found)] += found.astype(np.int32)
        return numbers


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


_MEMOS: dict[tuple, object] = {}


def keep_only(operator: str = "") -> None:
    """Drop what other operators keep in this Python worker; called as a task starts."""
    for key in [k for k in _MEMOS if k[0] != operator]:
        del _MEMOS[key]


def worker_memo(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task, one in all.

    ``key`` starts with the operator's name; a new key replaces the old object.
    """
    if key not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[key] = make()
    return _MEMOS[key]


def filtered(df: DataFrame, text_col: str, keep: Callable[[pa.StringArray], np.ndarray], operator: str = "") -> DataFrame:
    """Rows of ``df`` whose text ``keep`` marks; all columns pass unchanged."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(operator)
        for batch, texts in chunks(batches, batch_name(place)):
            yield batch.filter(pa.array(keep(texts)))

    return _positional(df, run, df.schema)


def replaced(df: DataFrame, text_col: str, change: Callable[[pa.StringArray], pa.StringArray]) -> DataFrame:
    """``df`` with its texts changed; null stays null, other columns pass unchanged."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch, texts in chunks(batches, batch_name(place)):
            new = pc.if_else(batch.column(place).is_valid(), change(texts), pa.scalar(None, pa.string()))
            columns = list(batch.columns)
            columns[place] = new.cast(batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return _positional(df, run, df.schema)


def batch_name(place: int) -> str:
    return f"c{place}"


def _positional(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """mapInArrow with columns named by place, so that names can't clash."""
    names = df.columns
    inner = df.toDF(*[batch_name(k) for k in range(len(names))])
    out = T.StructType([T.StructField(batch_name(k), f.dataType, True) for k, f in enumerate(schema.fields)])
    return inner.mapInArrow(run, out).toDF(*names)


def held_out(doc_id: str = "doc_id"):
    """Column that is true for the test fold: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
