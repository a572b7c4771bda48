import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from apexframe.llm import similarity


def grams(text):
    words = (text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """Group and number of links of each row number, by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    groups, links = list(range(len(rows))), defaultdict(int)

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 9 * common >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                groups[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for size, edits in ((30, 1), (12, 2), (8, 4), (5, 0), (60, 1)):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    passage = [rng.choice(words) for _ in range(50)]
    for _ in range(60):
        rows.append((n, " ".join(passage + [rng.choice(words) for _ in range(90)])))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("members", [4, 2048])
def test_planted_groups(spark, planted, members):
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(4)
    rows = similarity.jaccard_join(df, block_members=members).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in rows) == brute(planted)


def test_few_long_members_whose_blocks_are_partly_empty(spark):
    rng = random.Random(6)
    rows = []
    for group in range(20):
        base = [f"g{group}w{rng.randrange(3000)}" for _ in range(300)]
        for k in range(2 + group % 2):
            rows.append((len(rows), " ".join([*base, f"end{k}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    # Two blocks a group of two, and some groups have both members in one of them.
    found = similarity.jaccard_join(df, block_ngrams=300).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == brute(rows)
    assert all(r.n_texts == r.n_links for r in found)


def test_whole_table(documents, texts):
    rows = similarity.jaccard_join(documents).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in rows) == brute(sorted(texts.items()))


def test_keep_first(documents, texts):
    kept = similarity.keep_first(documents)
    assert kept.columns == documents.columns
    groups = {g for _, g, _ in brute(sorted(texts.items()))}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_frequent_and_rare_grams_agree():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 280, replace=False), rng.integers(0, 1 << 60, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(80)]
    links, texts, _ = similarity.verified(sets, np.zeros(80, int), np.ones(80, int), Fraction("0.8"))
    own = [set(s.tolist()) for s in sets]
    want = [sum(a is not b and 9 * len(a & b) >= 4 * (len(a) + len(b)) for b in own) for a in own]
    assert links.tolist() == texts.tolist() == want and len(set(want)) > 1


def test_banding_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = similarity.banding(threshold)
        assert bands * rows <= 240 and 1 - (1 - threshold**rows) ** bands >= similarity.RECALL


def test_ties_of_one_large_group_stay_below_two_a_class(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(1500):
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bands, per_band = similarity.banding()
    signed = similarity.signatures(df, bands, per_band)
    banded = signed.selectExpr("key", "explode(bands) band")
    leaders = banded.groupBy("band").agg({"key": "min"}).toDF("band", "leader")
    met = banded.join(leaders, "band").cache()
    ties = similarity.reduced_ties(met, "key", "leader").cache()
    assert 0 < ties.count() < 2 * signed.select("key").distinct().count() < met.where("key <> leader").distinct().count()
    plain = similarity.components(met.where("key <> leader").selectExpr("key a", "leader b"))
    assert sorted(similarity.components(ties).collect()) == sorted(plain.collect())


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (102, 100)], "a long, b long")
    roots = dict(similarity.components(edges).collect())
    assert roots == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_edges(edges, nothing):
    rows = similarity.jaccard_join(edges)
    assert rows.count() == edges.count()
    by = {r.doc_id: r for r in rows.collect()}
    assert by[1].n_links == by[6].n_links == 1 and by[6].class_id == 1
    assert by[2].n_links == by[3].n_links == by[4].n_links == 0 and by[9].n_links == 1
    kept = similarity.keep_first(edges)
    assert kept.columns == edges.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, 9, None]))
    assert similarity.jaccard_join(nothing).count() == 0 and similarity.keep_first(nothing).count() == 0
