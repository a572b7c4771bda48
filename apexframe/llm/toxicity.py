"""Toxicity: a subsequence string kernel and a support vector machine.

Two character strings are alike under the kernel if they share subsequences of
three letters; a subsequence that spans more characters weighs less, so gaps and
inserted characters lower the likeness but don't break it. Landmarks (Nyström)
turn kernel values into vectors on which a linear machine is trained with
labelled sentences. A sentence scores as its highest window, a text as its
highest sentence, and a logistic curve turns that into a probability.

A window is a word with its edges, lower-cased and without accents; what isn't a
letter is a gap. Letters set apart by blanks ("a b c d") form one window. A text is also
scored on windows over neighbouring fragments of up to three letters, and on words
without the fillers between their letters. Windows of over 32 characters are cut into
overlapping ones.

Null and empty texts and texts without letters have the lowest score. Repeated
rows score alike. Without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import Memo, chunks, filtered, held_out, worker_memo
from apexframe.llm.fitting import platt, sampled_ids, sampled_rows

THRESHOLD = 0.3
DECAY = 0.6
# Places of the second and third letter behind the first: at most two gaps.
STEPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
FEATURES = 1 << 15
EDGE = "\x02"
_WINDOW, _STRIDE = 32, 20
_SENTENCE = re.compile(r"[.!?\n]+")
_APART = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")


def _letter_table() -> np.ndarray:
    """Number of each character: 1 to 26 for a to z whatever their accent, 27 to 30 for other
    letters, 31 for a word's edge, 0 for a gap."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            base = unicodedata.normalize("NFKD", char)[0].lower()
            table[point] = ord(base) - 96 if "a" <= base <= "z" else 27 + point % 4
    table[ord(EDGE)] = 31
    return table


_LETTERS: np.ndarray | None = None


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of the windows of all words, padded by gaps, and each window's word."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = _LETTERS[np.frombuffer("".join([EDGE + w + EDGE for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    counts = np.maximum(1, -(-(lengths - _WINDOW) // _STRIDE) + 1)
    owner = np.repeat(np.arange(len(words)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start, limit = (np.cumsum(lengths) - lengths)[owner] + nth * _STRIDE, np.cumsum(lengths)[owner]
    width = int(min(_WINDOW, lengths.max(initial=1))) + 4
    at = start[:, None] + np.arange(width)
    inside = (at < limit[:, None]) & (np.arange(width) < _WINDOW)
    table = np.where(inside, flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else 0, 0)
    return table.astype(np.int32), owner


def subsequences(table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Feature numbers of all three-letter subsequences by step, where they exist, and their weight."""
    n = table.shape[1] - 4
    first = table[:, :n]
    for second, third in STEPS:
        b, c = table[:, second : second + n], table[:, third : third + n]
        yield (first << 10) | (b << 5) | c, (first > 0) & (b > 0) & (c > 0), DECAY ** (third + 1)


def by_width(words: list[str]) -> list[np.ndarray]:
    """Word numbers in groups of like length, so that padding stays small."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    edges = (0, 6, 9, 13, 20, 1 << 40)
    return [g for a, b in zip(edges[:-1], edges[1:], strict=True) if len(g := np.flatnonzero((lengths >= a) & (lengths < b)))]


def dense_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised kernel features of each window, and each window's word. For few words."""
    table, owner = codes(words)
    out = np.zeros((len(table), FEATURES), np.float32)
    rows = np.arange(len(table))[:, None]
    for number, there, weight in subsequences(table):
        np.add.at(out, (np.broadcast_to(rows, number.shape)[there], number[there]), weight)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9), owner


def projections(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Products of each word's kernel features with the columns of ``weights``; the largest window counts.

    A kernel value against a landmark, or any weighted sum of such values, is a
    product with fixed weights per subsequence, so it is summed up from lookups.
    """
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    for group in by_width(words):
        for k in range(0, len(group), 4096):
            part = group[k : k + 4096]
            table, owner = codes([words[i] for i in part])
            total, norm = np.zeros((len(table), weights.shape[1]), np.float32), np.zeros(len(table), np.float32)
            for number, there, weight in subsequences(table):
                found = np.where(there, number, 0)  # number 0 holds a gap and has no weight
                for column in range(weights.shape[1]):
                    total[:, column] += weight * weights[found, column].sum(1)
                norm += weight**2 * there.sum(1)
            total /= np.sqrt(np.maximum(norm, 1e-9))[:, None]
            best = np.full((len(part), weights.shape[1]), -np.inf, np.float32)
            np.maximum.at(best, owner, total)
            out[part] = best
    return out


def windows(text: str) -> list[str]:
    """Words of a text, with letters set apart joined."""
    if " " in text and _APART.search(text):
        text = _APART.sub(lambda m: "".join(m[0].split()), text)
    return text.split()


# Neighbouring fragments of up to three letters, whatever stands between them, and
# fillers between the letters of a word.
_SHORT_RUN = re.compile(r"(?<![^\W\d_])[^\W\d_]{1,3}+(?:[\W\d_]++[^\W\d_]{1,3}+(?![^\W\d_]))+")
_FRAGMENT = re.compile(r"[^\W\d_]+")
_FILLED = re.compile(r"(?<!\S)[^\w\s]*+(?:[^\W\d_]++(?:(?!\s)[\W\d_])++)+[^\W\d_]++")
_JOINED = 16


def joined(text: str) -> list[str]:
    """Windows over neighbouring short fragments: any that follow one another, up to 16
    letters in all, and whole runs; and words without the fillers between their letters."""
    found = []
    for run in _SHORT_RUN.finditer(text):
        parts = _FRAGMENT.findall(run[0])
        for k in range(len(parts)):
            own = parts[k]
            for part in parts[k + 1 : k + _JOINED]:
                if len(own) + len(part) > _JOINED:
                    break
                own += part
                if len(own) > 2:
                    found.append(own)
        whole = "".join(parts)
        if len(whole) > _JOINED:
            found.append(whole)
    found += ["".join(_FRAGMENT.findall(word[0])) for word in _FILLED.finditer(text)]
    return found


@dataclass
class Model:
    """Weight of each subsequence, the machine's offset, and the logistic curve."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -35, 35)))


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last weight is the offset."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        margin = 1 - y * (x @ w)
        on = margin > 0
        xs, cs = x[on], cost[on]
        target = np.linalg.solve(ridge + 2 * (xs * cs[:, None]).T @ xs, 2 * xs.T @ (cs * y[on]))
        if np.abs(target - w).max() < 1e-6:
            break
        w = target
    return w


def train(sentences: Iterable[tuple[int, list[str], int]], landmarks: int = 256, rounds: int = 5, seed: int = 3) -> Model | None:
    """Fit on labelled sentences: (document, windows, label of its document).

    Which sentence and window makes a document toxic isn't labelled. Windows far
    more frequent in sentences of toxic documents than in others are taken as
    witnesses. For a
    toxic document without one, rounds alternate between picking the window that
    the machine scores highest and training against windows of the other
    documents, among them all that scored highest in any round. The logistic
    curve is fitted on documents that took no part in this.
    """
    words: dict[str, int] = {}
    labels, bags = [], []
    own_bag: set[int] = set()
    current = None
    # Sentences as flat numbers. One counts once, however many copies there are,
    # and is clean if any clean document has it.
    known: dict[int, int] = {}
    flat, ends, clean_of = array("i"), array("q", [0]), array("b")
    for document, own, label in sentences:
        if document != current:
            if current is not None:
                bags.append(np.fromiter(own_bag, np.int32, len(own_bag)))
            labels.append(label)
            current, own_bag = document, set()
        numbers = {words.setdefault(normal, len(words)) for w in own if (normal := _bare(w))}
        own_bag |= numbers
        if len(labels) % 4 == 0:
            continue  # kept back: every fourth document only calibrates
        at = known.setdefault(hash(frozenset(numbers)), len(clean_of))
        if at == len(clean_of):
            flat.extend(numbers)
            ends.append(len(flat))
            clean_of.append(label)
        else:
            clean_of[at] = min(clean_of[at], label)
    if current is not None:
        bags.append(np.fromiter(own_bag, np.int32, len(own_bag)))
    labels = np.array(labels)
    if not len(labels) or labels.min() == labels.max() or not words or len(set(clean_of)) < 2:
        return None
    names, label_of = list(words), np.array(clean_of)
    words.clear()
    known.clear()
    size = np.bincount(label_of, minlength=2)
    row_label = np.repeat(label_of, np.diff(ends))
    numbers = np.array(flat)
    count = np.stack([np.bincount(numbers[row_label == k], minlength=len(names)) for k in (0, 1)]).astype(float)
    share = (count + 0.5) / (size[:, None] + 1)
    lift = np.log(share[1] / share[0])
    sure = (count[1] >= 6) & (lift > 2.5) & (count[0] <= 0.02 * count[1])
    rng = np.random.default_rng(seed)
    # Landmarks: windows that set toxic documents apart, and others at random by their frequency.
    by_lift = np.argsort(-lift * np.sqrt(count[1]), kind="stable")
    marked = [i for i in by_lift.tolist() if lift[i] > 0][: landmarks // 2]
    odds = count.sum(0)
    others = rng.choice(len(names), min(len(names), landmarks - len(marked)), replace=False, p=odds / odds.sum())
    chosen = list(dict.fromkeys([*marked, *others.tolist()]))
    basis, owner = dense_features([names[i] for i in chosen])
    basis = basis[np.unique(owner, return_index=True)[1]]
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    good = values > 1e-3 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])  # kernel values to Nyström features

    def nystrom(own_words: list[str]) -> np.ndarray:
        kernel = np.zeros((len(own_words), len(chosen)), np.float32)
        for k in range(0, len(own_words), 128):
            part, own = dense_features(own_words[k : k + 128])
            kernel[k : k + 128] = part[np.unique(own, return_index=True)[1]] @ basis.T
        return kernel @ to_features

    back = np.arange(1, len(bags) + 1) % 4 == 0
    toxic = [own for own, label, out in zip(bags, labels, back, strict=True) if label == 1 and len(own) and not out]
    unclear = [own for own in toxic if not sure[own].any()]
    clean = np.flatnonzero((count[0] > 0) & ~sure)
    negative = rng.choice(clean, min(len(clean), 4000), replace=False) if len(clean) else clean
    score = np.where(sure, 1.0, -1.0)
    for turn in range(rounds):
        witness = np.array([own[np.argmax(score[own])] for own in unclear] if turn else [], np.int64)
        positive = np.unique(np.concatenate([np.flatnonzero(sure), witness[score[witness] > -0.5]]))
        if not len(positive):
            positive = np.unique([own[np.argmax(lift[own])] for own in toxic])
        if not len(positive):
            return None
        frequent = positive[np.argsort(-count[1][positive], kind="stable")[:60]]
        disguised = [v for i in frequent if len(names[i]) > 3 for v in _disguises(names[i], rng)]
        x = nystrom([names[i] for i in positive] + disguised + [names[i] for i in negative])
        y = np.repeat([1.0, -1.0], [len(positive) + len(disguised), len(negative)])
        weights_of = np.concatenate([np.sqrt(np.maximum(count[1][positive], 1)), np.full(len(disguised), 3.0), np.full(len(negative), 1.0)])
        w = _machine(x, y, 20 * weights_of)
        weights = (basis.T @ (to_features @ w[:-1]))[:, None].astype(np.float32)
        weights[0] = 0
        score = projections(names, weights)[:, 0].astype(np.float64) + w[-1]
        hard = clean[np.argsort(-score[clean], kind="stable")[:2000]]
        negative = np.union1d(negative, hard)
    raw = np.array([score[own].max(initial=LOWEST) for own in bags])
    use = back if len(set(labels[back])) == 2 else np.ones(len(raw), bool)
    slope, shift = platt(raw[use], labels[use])
    return Model(weights, float(w[-1]), slope, shift)


LOWEST = -3.0


def _disguises(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a gap or a letter put in at one place, and with gaps everywhere."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = [word[:k] + "*" + word[k:] for k in range(1, len(word))]
    found += [word[:k] + letters[rng.integers(26)] + word[k:] for k in range(1, len(word))]
    return [*found, "*".join(word)]


def _bare(word: str) -> str:
    """Lower case, without characters at the ends that aren't letters."""
    return word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”…—–0123456789")


def labelled_sentences(documents: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> Iterator[tuple[int, list[str], int]]:
    """Sentences of at most ``rows`` toxic and twice as many clean documents, the held-out fold left out."""
    here = documents.select(id_col)
    for label in (1, 0):
        most = rows * (2 - label)  # clean documents vary more
        known = labels.where((F.col("toxic") == label) & ~held_out(id_col)).select(id_col)
        ids = sampled_ids(known.join(here, id_col, "left_semi"), most, id_col)
        sample = sampled_rows(documents.where(F.col(text_col).isNotNull()).select(id_col, text_col), ids, id_col)
        # In the order of a hash of the text, so that the fit doesn't depend on the rows' places.
        texts = sample.select(text_col).orderBy(F.xxhash64(text_col), text_col).limit(2 * most).toPandas()[text_col].tolist()
        for number, text in enumerate(texts):
            for sentence in _sentences(windows(text)):
                yield 2 * number + label, sentence, label


def _sentences(own: list[str]) -> Iterator[list[str]]:
    sentence: list[str] = []
    for word in own:
        sentence.append(word)
        if word[-1] in ".!?":
            yield sentence
            sentence = []
    if sentence:
        yield sentence


class Scorer:
    """Scores of whole texts, from the scores of their distinct windows."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.memo = Memo(lambda words: [projections([_bare(w) for w in words], model.weights)[:, 0] + np.float32(model.offset)])

    def raw(self, texts: pa.StringArray) -> np.ndarray:
        self.memo.trim()
        words, counts = [], []
        for text in texts.to_pylist():
            own = windows(text) + joined(text)
            words += own
            counts.append(len(own))
        out = np.full(len(counts), LOWEST)
        if words:
            score = self.memo.columns[0][rows] if len(rows := self.memo.rows(words)) else np.zeros(0)
            counts = np.array(counts)
            filled = counts > 0
            out[filled] = np.maximum(np.maximum.reduceat(score, (np.cumsum(counts) - counts)[filled]), LOWEST)
        return out


def _scores(model: Model | None, texts: pa.StringArray) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    scorer = worker_memo(("toxicity", model.weights.tobytes(), model.offset), lambda: Scorer(model))
    return model.probability(scorer.raw(texts))


def fit(documents: DataFrame, labels: DataFrame, rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Model from at most ``rows`` toxic and twice as many clean documents (the documented bound of the fit)."""
    return train(labelled_sentences(documents, labels, rows, id_col, text_col))


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = 2000) -> DataFrame:
    """Id, fold, score and prediction of every document."""
    model = fit(documents, labels, sample_rows, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            score = _scores(shared.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = narrow.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def keep_civil(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = 2000) -> DataFrame:
    """Documents below the threshold, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample_rows, id_col, text_col))
    return filtered(documents, text_col, lambda texts: _scores(shared.value, texts) < threshold, "toxicity")
