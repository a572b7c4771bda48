import zlib

import pyarrow as pa
import pytest

from apexframe.llm import toxicity


@pytest.fixture(scope="module")
def larger(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    return read("documents"), read("labels")


@pytest.fixture(scope="module")
def model(larger):
    return toxicity.fit(*larger)


def test_held_out_accuracy(larger, model, spark):
    documents, labels = larger
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").filter("held_out").toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (bad.predicted == 1).mean() > 0.7 and (good.predicted == 1).mean() < 0.05
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all()


def test_gaps_and_insertions_score_above_clean_words(model):
    clean = model.probability(toxicity.Scorer(model).raw(pa.array(["the", "and of this", "", "123 !!"])))
    disguised = ["idiot", "i d i o t", "IDIOT!!", "idioot", "wor*thless", "stupiid"]
    found = model.probability(toxicity.Scorer(model).raw(pa.array([f"the {w} of" for w in disguised])))
    assert found.min() > clean.max()


def test_fragments_and_fillers_score_above_clean_words(model):
    clean = model.probability(toxicity.Scorer(model).raw(pa.array(["the", "and of this", "", "123 !!", "he is on it to go by", "a well-known man"])))
    disguised = ["i  d  i  o  t", "i - d - i - o - t", "i. d. i. o. t.", "id iot", "idi ot", "i--d--i--o--t", "id--iot", "wor...thless"]
    found = model.probability(toxicity.Scorer(model).raw(pa.array([f"the {w} of" for w in disguised])))
    assert found.min() > clean.max() and found.min() >= toxicity.THRESHOLD


def test_joined_windows_take_linear_time():
    for text in ("a " * 50_000, "ab-" * 50_000, "a" * 200_000 + "-", "a" + " " * 200_000, "-" * 200_000, "a" * 200_000 + " " + "a1" * 50_000):
        toxicity.joined(text)
    assert {"idiot", "theidiot"} <= set(toxicity.joined("the id iot of"))


def test_projection_equals_kernel():
    words = ["clown", "thing", "a", "", "x" * 70, "été"]
    basis, owner = toxicity.dense_features(["clown", "thing"])
    dense, own = toxicity.dense_features(words)
    kernel = dense @ basis.T
    # Without repeated subsequences both normalise alike.
    got = toxicity.projections(["clown", "thing"], basis.T.copy())
    assert got == pytest.approx(kernel[[0, 1]], abs=1e-5)
    assert len(set(own)) == len(words) and (own == 4).sum() > 1


def test_labels_of_the_held_out_fold_are_never_used(documents, labels):
    from pyspark.sql import functions as F

    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [dict(toxicity.toxicity(documents, x).select("doc_id", "score").collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]
    rows = toxicity.toxicity(documents, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_edges(edges, nothing, labels):
    assert toxicity.toxicity(nothing, labels).count() == 0
    rows = toxicity.toxicity(edges, labels.limit(0)).collect()
    assert len(rows) == edges.count() and {r.score for r in rows} == {0.0}
    kept = toxicity.keep_civil(edges, labels)
    assert kept.columns == edges.columns and kept.count() <= edges.count()


def test_empty_texts_have_the_lowest_score(model):
    scores = model.probability(toxicity.Scorer(model).raw(pa.array(["", " ", "the of and", "idiot"])))
    assert scores[0] == scores[1] == scores.min() and 0 <= scores.min() and scores.max() <= 1


def _plain_kernel(left: str, right: str) -> float:
    """The kernel of two words by definition: every triple of letters within five characters."""
    import math
    import unicodedata

    def letter(char: str):
        if char == "\x02":
            return "edge"
        if not char.isalpha():
            return None
        base = unicodedata.normalize("NFKD", char)[0].lower()
        return base if "a" <= base <= "z" else ord(char) % 4

    def triples(word: str):
        own = [letter(c) for c in f"\x02{word}\x02"]
        for i in range(len(own)):
            for j in range(i + 1, min(i + 5, len(own))):
                for k in range(j + 1, min(i + 5, len(own))):
                    if None not in (own[i], own[j], own[k]):
                        yield (own[i], own[j], own[k]), 0.6 ** (k - i + 1)

    ours, theirs = list(triples(left)), {}
    for triple, weight in triples(right):
        theirs[triple] = theirs.get(triple, 0) + weight
    norm = math.sqrt(sum(w * w for _, w in ours)) * math.sqrt(sum(w * w for w in theirs.values()))
    return sum(w * theirs.get(t, 0) for t, w in ours) / norm if norm else 0.0


def test_kernel_equals_its_definition(documents):
    landmarks = ["idiot", "worthless", "thing", "été"]
    texts = [r.text for r in documents.where("text is not null").orderBy("doc_id").limit(200).collect()]
    words = sorted({w for t in texts for w in [*toxicity.windows(t), *toxicity.joined(t)] if len(w) <= 30})
    words = [*words, "i*d*i*o*t", "id-iot", "ЖЖЖ", "a", "12", "été", "naïve"]
    basis, _ = toxicity.dense_features(landmarks)
    got = toxicity.projections(words, basis.T.copy())
    for k, landmark in enumerate(landmarks):
        want = [_plain_kernel(w, landmark) for w in words]
        assert got[:, k] == pytest.approx(want, abs=1e-4)
    assert (got > 0.2).any() and len(words) > 200
