import zlib

import numpy as np

from apexframe.llm import language


def test_held_out_accuracy(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = language.identify(documents).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_add_up():
    model = language.train(["the thing and that", "der die das und", "this then", "nicht ein"] * 30, ["en", "de", "en", "de"] * 30)
    text = "the und that"
    rows, _ = language.subwords(language.words_of(text))
    whole = model.scores[rows].mean(0)
    p = np.exp(whole - whole.max())
    import pyarrow as pa

    names, score, _ = language.Predictor(model).predict(pa.array([text, "", "12 3"]))
    assert abs(score[0] - (p / p.sum()).max()) < 1e-5
    assert names[1:] == ["und", "und"] and list(score[1:]) == [0, 0]


def test_rejection_is_calibrated(documents):
    rows = language.identify(documents).collect()
    assert np.mean([r.rejected for r in rows]) < 0.1
    assert {r.rejected for r in rows if r.score < 0.5} <= {True}


def test_edges(edges, nothing):
    rows = language.identify(edges).collect()
    assert len(rows) == edges.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert language.identify(nothing).count() == 0
    from pyspark.sql import functions as F

    unlabelled = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def _plain_rows(word: str) -> list[int]:
    """Embedding rows of a word by definition: its letter groups with edges, and the word itself."""
    mask = (1 << 64) - 1

    def mixed(x: int) -> int:
        return int(language.mix(np.array([x & mask], np.uint64))[0])

    marked, rows = f"<{word}>", []
    for n in (2, 3, 4):
        for k in range(len(marked) - n + 1):
            number = 0
            for size, char in enumerate(marked[k : k + n], 1):
                number = mixed(number * 0x100000001B3 + ord(char) + size)
            rows.append(number % language.ROWS)
    total = sum(mixed(ord(c) + k * 0x9E3779B97F4A7C15) for k, c in enumerate(marked))
    return [*rows, mixed(total) % language.ROWS]


def test_predictions_equal_a_plain_mean_of_subwords(documents):
    import pyarrow as pa
    import regex

    model = language.fit(documents)
    texts = [r.text for r in documents.where("text is not null").orderBy("doc_id").limit(200).collect()]
    texts += ["", "12 3", "é", "a-b c_d", "ЖЖ 漢字"]
    names, score, _ = language.Predictor(model).predict(pa.array(texts))
    known: dict[str, list[int]] = {}
    for text, name, value in zip(texts, names, score, strict=True):
        words = regex.findall(r"\p{L}+", text.lower())
        known |= {w: _plain_rows(w) for w in words if w not in known}
        rows = [r for w in words for r in known[w]]
        if not rows:
            assert (name, value) == ("und", 0)
            continue
        z = model.scores[rows].astype(np.float64).mean(0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(p.max() - value) < 1e-4 and p[model.languages.index(name)] > p.max() - 1e-4


def test_languages_are_bounded(documents):
    from apexframe.llm.arrow import held_out

    learned = documents.where(~held_out("doc_id")).where("lang is not null and text is not null")
    common = learned.groupBy("lang").count().orderBy("count", ascending=False).collect()
    model = language.fit(documents, languages=2)
    assert len(model.languages) == 2 and {r["count"] for r in common if r.lang in model.languages} == {r["count"] for r in common[:2]}
