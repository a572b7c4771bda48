"""Language identification with averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords (letter groups of two to
four characters with word edges, and whole words), hashed into a fixed number of
rows; a linear softmax on the mean gives the languages' probabilities. Both are
trained by stochastic gradient descent in numpy on snippets of labelled texts.
A temperature calibrates the probabilities and a threshold rejects predictions
that are less certain than nearly all right ones on snippets kept back.

As mean and softmax input are linear, each distinct word is reduced once a worker
to its sums of scores, and a text to the sums over its words.

Null texts and texts without a letter are ``und`` with score 0. Repeated rows are
predicted alike. Without labelled rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import Memo, chunks, held_out, segment_sums, worker_memo
from apexframe.llm.shingles import mix

ROWS, SIZE = 1 << 15, 16
UNKNOWN = "und"
_WORDS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the subwords of all words, and the n + 1 places of words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(points))  # characters from here to the word's end
    found, owners = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        moved = np.zeros(len(points), np.uint64)
        moved[: len(points) - n + 1] = points[n - 1 :]
        rolling = mix(rolling * np.uint64(0x100000001B3) + moved + np.uint64(n))
        if n > 1:
            fits = left >= n
            found.append(rolling[fits])
            owners.append(owner[fits])
    whole = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points + (lengths[owner] - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=whole[1:])
    found.append(mix(whole[ends] - whole[ends - lengths]))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    rows = (np.concatenate(found) % np.uint64(ROWS)).astype(np.int64)[order]
    return rows, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


@dataclass
class Model:
    """Scores of each embedding row by language, temperature included, and the threshold."""

    languages: list[str]
    scores: np.ndarray
    threshold: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = sums / np.maximum(counts, 1)[:, None]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


def snippets(texts: list[str], labels: list[int], rng: np.random.Generator, each: int = 4) -> tuple[list[np.ndarray], np.ndarray]:
    """Subword rows and labels of random runs of 1 to 40 words of each text."""
    rows, out = [], []
    for text, label in zip(texts, labels, strict=True):
        words = words_of(text)
        for _ in range(each if words else 0):
            size = int(rng.integers(1, 41))
            start = int(rng.integers(0, max(1, len(words) - size + 1)))
            rows.append(subwords(words[start : start + size])[0])
            out.append(label)
    return rows, np.array(out, np.int64)


def train(texts: list[str], languages: list[str], epochs: int = 4, rate: float = 1.0, batch: int = 32, seed: int = 11) -> Model | None:
    """Stochastic gradient descent over snippets; a tenth is kept back to calibrate."""
    names = sorted(set(languages))
    if not names:
        return None
    number = {n: k for k, n in enumerate(names)}
    rng = np.random.default_rng(seed)
    rows, labels = snippets(texts, [number[x] for x in languages], rng)
    if not rows:
        return None
    embed = rng.uniform(-1 / SIZE, 1 / SIZE, (ROWS, SIZE)).astype(np.float32)
    output = np.zeros((SIZE, len(names)), np.float32)
    order = rng.permutation(len(rows))
    back, use = order[: len(rows) // 10], order[len(rows) // 10 :]
    steps = max(1, epochs * -(-len(use) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(use)
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            sizes = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part])
            mean = np.add.reduceat(embed[flat], np.cumsum(sizes) - sizes) / sizes[:, None]
            z = mean @ output
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            speed = np.float32(rate * (1 - step / steps))
            back_mean = (p @ output.T) / sizes[:, None]
            output -= speed * (mean.T @ p).astype(np.float32)
            np.add.at(embed, flat, -speed * np.repeat(back_mean, sizes, 0).astype(np.float32))
            step += 1
    scores = (embed @ output).astype(np.float64)
    kept = back if len(back) else use
    z = np.stack([scores[rows[i]].mean(0) for i in kept])
    best, heat = np.inf, 1.0
    for t in np.geomspace(0.25, 16, 25):  # the temperature that makes the labels kept back likeliest
        own = z * t
        loss = float(np.mean(np.log(np.exp(own - own.max(1, keepdims=True)).sum(1)) + own.max(1) - own[np.arange(len(kept)), labels[kept]]))
        if loss < best:
            best, heat = loss, t
    p = np.exp((z - z.max(1, keepdims=True)) * heat)
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == labels[kept]
    threshold = float(np.quantile(p.max(1)[right], 0.01)) if right.any() else 1.0
    return Model(names, (scores * heat).astype(np.float32), threshold)


class Predictor:
    """Language sums of whole texts, from those of their distinct words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.memo = Memo(self._sums)

    def _sums(self, words: list[str]) -> list[np.ndarray]:
        rows, places = subwords(words)
        sums = np.add.reduceat(self.model.scores[rows], places[:-1])
        return [sums.astype(np.float32), np.diff(places).astype(np.float32)]

    def predict(self, texts: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and whether the prediction is rejected."""
        self.memo.trim()
        words, counts = [], []
        for text in texts.to_pylist():
            own = words_of(text)
            words += own
            counts.append(len(own))
        rows = self.memo.rows(words)
        places = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        n = len(counts)
        if not words:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        sums, sizes = (x[rows].astype(np.float64) for x in self.memo.columns)
        of_text = np.stack([segment_sums(sums[:, k], places) for k in range(sums.shape[1])], 1)
        p = self.model.probabilities(of_text, segment_sums(sizes, places))
        there = np.diff(places) > 0
        score = np.where(there, p.max(1), 0.0)
        names = [self.model.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1).tolist(), there.tolist(), strict=True)]
        return names, score, score < self.model.threshold


def fit(documents: DataFrame, rows: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = 500) -> Model | None:
    """Model from about ``rows`` labelled documents of each language (the documented bound of the fit).

    The held-out fold and null labels are left out. A document is taken if the
    hash of its id falls below the share that its language needs. At most
    ``languages`` are learned, the most frequent ones, so that what the driver holds
    is bounded whatever a dirty column says; ties are taken by name.
    """
    usable = documents.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    frequent = usable.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(languages)
    counts = {r[0]: r[1] for r in frequent.collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.where(place < share[F.col(lang_col)]).select(text_col, lang_col).orderBy(F.xxhash64(id_col), text_col).limit(2 * rows * len(counts)).toPandas()
    return train(sample[text_col].tolist(), sample[lang_col].tolist())


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1500) -> DataFrame:
    """Id, fold, predicted language, its probability and the rejection of every document."""
    model = fit(documents, sample_rows, id_col, text_col, lang_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, texts in chunks(batches, "text"):
            n = len(texts)
            if own is None:
                names, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            else:
                predictor = worker_memo(("language", own.scores.tobytes()), lambda: Predictor(own))
                names, score, rejected = predictor.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = narrow.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
