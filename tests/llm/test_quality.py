import re
from collections import Counter

import pyarrow as pa
import pytest

from apexframe.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


ODD = ["", " ", "a", "a b c a b c", "x\n\nx\nx ", "\n\n \n", "é b\nb é\x0b c", "a b a", "w " * 120, "a b c", "q\r\nq\r\n"]


def test_statistics_equal_brute_force(texts):
    own = ODD + list(texts.values())
    stats = quality.statistics(pa.array(own, pa.string()))
    for k, text in enumerate(own):
        assert tuple(int(stats[c][k]) for c in quality.COUNTS) == brute(text), text[:60]
    part = quality.statistics(pa.array(own).slice(3, 50))
    assert all((part[c] == stats[c][3:53]).all() for c in part)


def test_query_equals_brute_force(documents, labels, texts):
    rows = quality.quality_rules(documents, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r.kept and r.base_failed)


def test_forest_keeps_good_and_finds_junk(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_rules(documents, labels).join(labels, "doc_id").filter("NOT base_failed")
    good, junk = (rows.filter(f"quality = {k}") for k in (1, 0))
    assert good.filter("kept").count() >= 0.97 * good.count()
    assert junk.count() and junk.filter("kept").count() <= 0.2 * junk.count()


def test_edges(edges, nothing, labels):
    rows = quality.quality_rules(edges, labels).collect()
    assert len(rows) == edges.count()
    assert all(not r.kept for r in rows if r.doc_id in (2, 3, 4, 5))
    assert quality.quality_rules(nothing, labels).count() == 0
    kept = quality.keep_good(edges, labels.limit(0))
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} <= {9, 1, 6, 7, 8, None}
    assert quality.keep_good(nothing, labels).count() == 0


def test_no_forest_without_labels(documents, labels):
    rows = quality.quality_rules(documents, labels.limit(0))
    assert rows.filter("kept = base_failed").count() == 0


@pytest.mark.parametrize("size", [1, 7, 300])
def test_grow_forest_of_any_size(size):
    import numpy as np

    x = np.random.default_rng(1).random((size, 8))
    assert ((0 <= (s := quality.grow_forest(x, trees=12).scores(x))) & (s <= 1)).all()


def test_thresholds_come_from_all_good_documents(spark):
    """Few documents grow the trees, but the calibrating half counts whole."""
    import numpy as np
    from pyspark.sql import functions as F

    names = quality.COUNTS + quality.EXTRA
    rng = np.random.default_rng(3)
    rows = [(k, 200 + k % 50, 1000 + int(rng.integers(50)), int(rng.integers(3)), 0, 0, 10 + k % 4, 1300, int(rng.integers(90)), int(rng.integers(9)), 120 + k % 7) for k in range(3000)]
    stats = spark.createDataFrame(rows, f"doc_id long, {', '.join(f'{c} long' for c in names)}")
    labels = stats.select("doc_id", F.lit(1).alias("quality"))
    forest = quality.fit(stats, labels, rows=60, lost=0.05)
    other = stats.where("pmod(xxhash64('half', doc_id), 2) = 1").toPandas()
    assert 1300 < len(other) < 1700
    scores = forest.scores(quality.features({c: other[c].to_numpy() for c in names}))
    assert forest.thresholds == pytest.approx(np.quantile(scores, 0.95, axis=0) + 0.01)
