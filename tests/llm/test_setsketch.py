import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from apexframe.llm import setsketch

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """Id, set size, component and whether it stays, of each row, from all pairs with a common shingle."""
    sets, groups, holders = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for k, own in enumerate(sets):
        for other, common in Counter(o for g in own for o in holders[g]).items():
            if 100 * common >= 85 * (len(own) + len(sets[other]) - common):
                groups[find(k)] = find(other)
        for g in own:
            holders[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def test_planted_chains_and_a_common_passage(spark):
    """Copies of copies, so that a group's ends aren't linked; copies linked only
    with members other than the hub; and many documents that share a passage."""
    rng = random.Random(5)
    words = [f"W{k}" for k in range(4000)]
    rows = []
    for start in range(3):
        own = [rng.choice(words) for _ in range(150)]
        for _ in range(25):
            rows.append((len(rows), " ".join(own)))
            for _ in range(1 + start):
                own[rng.randrange(150)] = rng.choice(words)
    passage = [rng.choice(words) for _ in range(110)]
    for _ in range(60):
        rows.append((len(rows), " ".join(passage + [rng.choice(words) for _ in range(rng.randint(15, 24))])))
    rows += [(len(rows) + k, t) for k, t in enumerate(["A b C", "a B c", "", None, "one", " \n", rows[0][1].upper()])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert len({r[2] for r in want}) < len(rows) - 30
    for members in (4, 256):
        found = setsketch.near_duplicates(df, block_members=members).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == want


def test_whole_table(documents, texts):
    found = setsketch.near_duplicates(documents).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute(sorted(texts.items()))


def test_edges(edges, nothing):
    rows = setsketch.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 1 and not by[6].kept and by[1].kept
    assert all(by[k].n_shingles == 0 and by[k].component_id == k and by[k].kept for k in (2, 3, 4))
    assert by[5].n_shingles == 1 and by[9].kept and by[None].component_id is None and by[None].kept
    assert setsketch.near_duplicates(nothing).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    count = 234
    for common, extra in ((900, 50), (500, 250), (50, 500)):
        a = rng.integers(0, 1 << 63, common + extra, dtype=np.uint64) * np.uint64(2)
        b = np.r_[a[:common], rng.integers(0, 1 << 63, extra, dtype=np.uint64) * np.uint64(2)]
        both = np.unique(np.r_[a, b])
        values = setsketch.registers(np.r_[a, b, both], np.array([0, len(a), len(a) + len(b), len(a) + len(b) + len(both)]), count)
        assert (setsketch.merged(values[0], values[1]) == values[2]).all()
        difference = values[0].astype(int) - values[1]
        up, down = np.array([(difference > 0).sum()]), np.array([(difference < 0).sum()])
        sizes = np.array([len(a)]), np.array([len(b)])
        likeness = common / (common + 2 * extra)
        assert abs(setsketch.estimated(up, down, count, *sizes)[0][0] - likeness) < 0.12
        assert abs((difference == 0).mean() - setsketch.equal_share(likeness)) < 0.12
        assert setsketch.plausible(up, down, count, *sizes, 0.85)[0] == (common == 900)


def test_the_likelihood_drops_no_linked_pair():
    """Of 3,000 pairs just above the threshold every one stays, also with unequal sizes."""
    rng = np.random.default_rng(3)
    up, down, sizes = [], [], []
    for _ in range(3000):
        alone_a = int(rng.integers(0, 30))
        common = 170
        alone_b = 30 - alone_a
        a = rng.integers(0, 1 << 63, common + alone_a, dtype=np.uint64) * np.uint64(2)
        b = np.r_[a[:common], rng.integers(0, 1 << 63, alone_b, dtype=np.uint64) * np.uint64(2)]
        values = setsketch.registers(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), 234).astype(int)
        up.append((values[0] > values[1]).sum())
        down.append((values[0] < values[1]).sum())
        sizes.append((len(a), len(b)))
    a, b = np.array(sizes).T
    assert setsketch.plausible(np.array(up), np.array(down), 234, a, b, 0.85).all()


def test_banding_and_exact_links():
    bands, rows = setsketch.banding()
    assert bands * rows <= setsketch.MOST_REGISTERS
    assert 1 - (1 - setsketch.equal_share(0.85) ** rows) ** bands >= setsketch.RECALL
    assert setsketch.linked(85, 85, 100, Fraction("0.85")) and not setsketch.linked(84, 84, 100, Fraction("0.85"))


@pytest.mark.parametrize("cross", [False, True])
def test_compared_against_all_pairs(cross):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 120, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 116, replace=False), rng.integers(0, 1 << 62, rng.integers(0, 9), dtype=np.uint64)]) for _ in range(40)]
    places = np.r_[0, np.cumsum([len(s) for s in sets])]
    bands, rows = setsketch.banding()
    values = setsketch.registers(np.concatenate(sets), places, bands * rows)
    side = np.arange(40) % 2
    found = setsketch.compared(sets, values, setsketch.band_hashes(values, bands, rows), list(range(40)), side, cross, 0.85, Fraction("0.85"))
    groups = list(range(40))
    for a in range(40):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if (not cross or side[a] != side[b]) and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                old, new = groups[a], groups[b]
                groups = [new if g == old else g for g in groups]
    assert len({(x, y) for x, y in zip(found.tolist(), groups, strict=True)}) == len(set(groups)) == len(set(found.tolist()))
