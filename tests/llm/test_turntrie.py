import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from apexframe.llm import turntrie


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [t[2:] for t in sorted(own)] for c, own in by.items()}
    members, ends, children, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(by.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        worth = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += worth
            leaves[node[:d]] += not children[node]
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, own in members.items()
    )


def found(df, **options):
    return sorted(tuple(-1 if v is None else v for v in r) for r in turntrie.prefix_trie(df, **options).collect())


@pytest.fixture(scope="module")
def rows():
    """Few different turns, so that conversations share and leave prefixes at any
    depth; one long conversation, one copied many times, turnless ones and gaps."""
    rng = random.Random(9)
    rows = []
    for c in range(0, 130):
        if c in (40, 41, 77):
            continue
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["a b", "c"]) if turn < 6 else "same words here"))
    rows += [(c, t, "user", f"copied {t}") for c in range(200, 260) for t in range(6)]
    rows += [(300, t, "user", f"turn {t}") for t in range(400)]
    rows += [(500, None, None, None), (500, None, "user", " x  y z "), (500, 1, "b", "a"), (500, 1, "ab", ""), (None, 1, "user", "lost")]
    rows += [(501, 0, "a", "b:c"), (521, 0, "a", "b:c"), (521, 0, "a", "b:c")]
    rng.shuffle(rows)
    return rows


def test_against_plain_python(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    want = brute(rows)
    assert any(w[3] > 1 and w[4] > 1 for w in want) and max(w[1] for w in want) > 300
    assert found(df) == want
    assert found(df, size=1) == found(df.coalesce(1), size=7) == want


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert found(spark.createDataFrame([], schema)) == []
    assert found(spark.createDataFrame([(None, 1, "user", "x")], schema)) == []
    only = [(7, None, None, None)]
    assert found(spark.createDataFrame(only, schema)) == brute(only)
    # Conversation 21 opens with the family's head, which is absent: it has no turns left.
    lone = [(c, 0, "user", "x") for c in (21, 22, 23)]
    assert found(spark.createDataFrame(lone, schema)) == brute(lone)


def test_sums_go_on_across_partitions():
    seams = [(0, 1, 3, (2,)), (1, 3, 3, (5,)), (3, 3, 4, (1,)), (4, 4, 4, (2**64 - 1,)), (5, 4, 9, (3,)), (6, 10, 10, (1,))]
    assert turntrie.carries(seams) == [(1, 3, (2,)), (3, 3, (7,)), (4, 4, (1,)), (5, 4, (0,))]


def test_long_paths_take_few_rounds(spark, monkeypatch):
    rounds, stage = [], turntrie.stage
    monkeypatch.setattr(turntrie, "stage", lambda df: rounds.append(1) or stage(df))
    nodes = spark.createDataFrame([(k, k - 1 if k else None, 1) for k in range(60)], "node int, parent int, v long")
    got = dict(turntrie.subtree_sums(nodes, ["v"]).collect())
    assert got == {k: 60 - k for k in range(60)} and len(rounds) == 7
