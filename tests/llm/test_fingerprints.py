import hashlib

import numpy as np
import pyarrow as pa

from apexframe.llm import fingerprints as fp


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark, documents, texts):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in fp.against_edited(documents).collect()}
    assert sorted(rows) == ids
    errors, prints = [], {}
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(r.near_edited - jaccard(shingles(text), shingles(edited))), abs(r.near_next - jaccard(shingles(text), shingles(after)))]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert np.mean(errors) < 0.03 and max(errors) < 0.25


def test_sketches_merge(texts):
    own = sorted(texts.values(), key=len)[-2:]
    both = [fp.sketches(pa.array([t]))[0] for t in own]
    size = len(shingles(own[0]) | shingles(own[1]))
    assert abs(fp.distinct(fp.merge(*both)) / size - 1) < 0.4
    parts = fp.sketches(pa.array(["a b c d e f g h", "e f g h i j k", "a b c d e f g h\ne f g h i j k"]))
    assert fp.containment(parts[0][: parts[1][1]], parts[0][parts[1][1] : parts[1][2]]) == 0
    whole = parts[0][parts[1][2] :]
    assert fp.containment(parts[0][: parts[1][1]], whole) == 1.0 and fp.distinct(whole) == 11


def test_edges(edges, nothing):
    rows = fp.against_edited(edges).collect()
    assert len(rows) == edges.filter("doc_id IS NOT NULL").count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[6].fingerprint and by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == ""
    assert by[2].near_next == by[3].near_next == by[2].near_edited == 1.0 and by[4].near_next == 0.0
    assert fp.against_edited(nothing).count() == 0
    assert fp.fingerprints(edges).count() == edges.count() and fp.fingerprints(nothing).count() == 0


def test_bucket_borders(spark):
    rows = spark.createDataFrame([(i, f"t{i} " * 6) for i in range(-5, 40)], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in fp.against_edited(rows.repartition(5)).collect()}
    for i in range(-5, 40):
        text, after = f"t{i} " * 6, f"t{i + 1 if i < 39 else -5} " * 6
        half = len(text) // 2
        assert got[i] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
