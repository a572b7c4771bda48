"""Prefix trie of conversations by fixed-length block hashing.

A prefix of turns is known by a 128-bit digest, the sum of its turns' digests each
mixed with its place. Sums run on across tasks, so one conversation may hold any
share of the turns. Turns are cut into blocks of four: conversations are grouped
by the digests at successive block ends first, which gives each distinct block
under each block-end prefix once, with the number of conversations that pass it.
Where a prefix is followed by a single block, the nodes inside it are a chain and
need no further grouping. Only where it is followed by several are their turn
boundaries grouped.

Sums over subtrees come by doubling: a node knows the sum over its descendants
fewer than 2^k levels below and its ancestor 2^k levels above, and a round doubles
both. The rounds grow with the logarithm of the depth.

Turns are ordered by turn, null first, ties by role and text. A null role or text
is empty. Rows without a conversation id take no part. Repeated rows are turns of
their own. Equal conversations share all nodes. An empty table gives no rows, not
even a root.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import keep_only
from apexframe.llm.shingles import mix
from apexframe.session import stage

BLOCK = 4
# Every conversation opens like that with the next lower id divisible by this one.
FAMILY = 20
LEAD = 4
WORD = r"[^\x20\x09-\x0D]+"
IDS_A_CHUNK = 4096


def _digest(depth: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """16 bytes of each prefix, from its depth and two running sums."""
    out = np.empty((len(depth), 2), np.uint64)
    for lane in (0, 1):
        out[:, lane] = mix(sums[:, lane] + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane))
    return out


ROOT = _digest(np.zeros(1, np.int64), np.zeros((1, 2), np.uint64)).tobytes()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


# ---- running counts and sums across tasks --------------------------------------


def carries(rows: Iterable[tuple[int, int, int, tuple[int, ...]]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """What the first run of a partition goes on from: partition, key, totals before it.

    ``rows`` holds, for each non-empty partition in order, its number, first and
    last key and the totals of its last run.
    """
    found, open_key, total = [], None, ()
    for part, first, last, own in sorted(rows):
        goes_on = open_key == first
        if goes_on:
            found.append((part, first, total))
        total = tuple((a + b) & (2**64 - 1) for a, b in zip(total, own, strict=True)) if goes_on and first == last else own
        open_key = last
    return found


def _run_starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _numbered(turns: DataFrame, tasks: int) -> DataFrame:
    """Own turns with their places (from 1) in their conversations: c, pos, hi, lo, words."""
    order = ["c", F.asc_nulls_first("turn"), "role", "text"]
    dealt = turns.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("c", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        part = TaskContext.get().partitionId()
        first = last = None
        count = 0
        names = ["part", "c", "place", "hi", "lo", "words", "first", "last", "count"]
        for batch in batches:
            keys = batch.column("c").to_numpy()
            if not len(keys):
                continue
            starts = _run_starts(keys)
            place = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
            if last == keys[0]:
                place[: starts[1] if len(starts) > 1 else len(keys)] += count
            first = int(keys[0]) if first is None else first
            last, count = int(keys[-1]), int(place[-1]) + 1
            lanes = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(-1, 2)
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), batch.column("c"), pa.array(place), _signed(lanes[:, 0]), _signed(lanes[:, 1]), batch.column("words"), none, none, none], names=names)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.nulls(1, pa.int64())] * 5, *[pa.array([x], pa.int64()) for x in (first, last, count)]], names=names)

    placed = stage(dealt.mapInArrow(run, "part int, c long, place long, hi long, lo long, words long, first long, last long, count long"))
    # One row a partition.
    seams = placed.where("first IS NOT NULL").select("part", "first", "last", "count").collect()
    on = [(part, key, total[0]) for part, key, total in carries((r["part"], r["first"], r["last"], (r["count"],)) for r in seams)]
    seam = turns.sparkSession.createDataFrame(on, "part int, seam long, before long")
    return placed.where("c IS NOT NULL").join(F.broadcast(seam), "part", "left").select("c", (F.col("place") + 1 + F.when(F.col("c") == F.col("seam"), F.col("before")).otherwise(0)).alias("pos"), "hi", "lo", "words")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rebuilt turns (c, d, hi, lo, words): the first h of the family's head, then the own ones after h.

    ``convs`` holds c, h, and ``lead``, the head's turns that open c.
    """
    opening = convs.select("c", F.posexplode("lead").alias("at", "t")).select("c", (F.col("at") + 1).cast("long").alias("d"), "t.hi", "t.lo", "t.words")
    # Own turns only move where the family's head is shorter than h, or absent.
    moved = convs.select("c", (F.col("h") - F.size("lead")).alias("shift")).where("shift > 0")
    own = turns.where(F.col("pos") > _h("c")).join(moved, "c", "left").select("c", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("d"), "hi", "lo", "words")
    return opening.unionByName(own)


def _h(c: str) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary")) % LEAD


def _blocks(turns: DataFrame, tasks: int, size: int) -> DataFrame:
    """Blocks of up to ``size`` rebuilt turns: c, k, the prefix digests at their start, end and each turn (ends), words."""
    keyed = turns.withColumn("k", F.expr(f"(d - 1) div {size}"))
    # A block's turns fall into one partition, a conversation's may fall into several.
    dealt = keyed.repartitionByRange(tasks, "c", "k").sortWithinPartitions("c", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        part = TaskContext.get().partitionId()
        names = ["part", "c", "k", "start_hi", "start_lo", "hi", "lo", "words", "last", "last_hi", "last_lo"]
        first = last = None
        total = np.zeros(2, np.uint64)
        waiting = None
        for batch in itertools.chain(batches, (None,)):
            table = waiting if batch is None else batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            if table is None or not len(table):
                continue
            c, k, d = (table.column(x).to_numpy() for x in ("c", "k", "d"))
            # The last block may go on in the next batch.
            end = len(c) if batch is None else int(np.flatnonzero((c == c[-1]) & (k == k[-1]))[0])
            waiting = None if batch is None else table.slice(end)
            if not end:
                continue
            c, k, d = c[:end], k[:end], d[:end]
            lanes = np.stack([table.column(x).to_numpy()[:end].view(np.uint64) for x in ("hi", "lo")], 1)
            for lane in (0, 1):
                lanes[:, lane] = mix(lanes[:, lane] ^ mix(d.astype(np.uint64) + np.uint64(1 + lane)))
            sums = np.cumsum(lanes, 0, dtype=np.uint64)
            starts = _run_starts(c)
            before = np.vstack([np.zeros((1, 2), np.uint64), sums])[starts]
            if last == c[0]:
                before[0] -= total
            sums -= np.repeat(before, np.diff(np.r_[starts, end]), 0)
            first = int(c[0]) if first is None else first
            last, total = int(c[-1]), sums[-1].copy()
            before = sums - lanes
            edge = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
            places = pa.array(np.r_[edge, end].astype(np.int32))
            lists = [pa.ListArray.from_arrays(places, x) for x in (_signed(sums[:, 0]), _signed(sums[:, 1]), pa.array(table.column("words").to_numpy()[:end]))]
            none = pa.nulls(len(edge), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), part, np.int32)), pa.array(c[edge]), pa.array(k[edge]), *[_signed(before[edge, lane]) for lane in (0, 1)], *lists, none, none, none], names=names)
        if first is not None:
            lists = [pa.nulls(1, pa.list_(pa.int64()))] * 3
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), *[pa.nulls(1, pa.int64())] * 3, *lists, pa.array([last]), *[_signed(total[k : k + 1]) for k in (0, 1)]], names=names)

    local = stage(dealt.mapInArrow(run, "part int, c long, k long, start_hi long, start_lo long, hi array<long>, lo array<long>, words array<long>, last long, last_hi long, last_lo long"))
    seams = local.where("last IS NOT NULL").select("part", "c", "last", "last_hi", "last_lo").collect()
    on = {part: (key, total) for part, key, total in carries((r["part"], r["c"], r["last"], (r["last_hi"] % 2**64, r["last_lo"] % 2**64)) for r in seams)}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of the whole prefixes: what earlier partitions hold is added."""
        keep_only()
        for batch in batches:
            if not len(batch):
                continue
            c, k, part = (batch.column(x).to_numpy() for x in ("c", "k", "part"))
            lists = batch.column("hi")
            offsets = np.asarray(lists.offsets).astype(np.int64)
            offsets -= offsets[0]
            sums = np.stack([batch.column(x).flatten().to_numpy().view(np.uint64) for x in ("hi", "lo")], 1)
            add = np.zeros((len(c), 2), np.uint64)
            for p in np.unique(part).tolist():
                if p in on:
                    add[(part == p) & (c == on[p][0])] = np.array(on[p][1], np.uint64)
            counts = np.diff(offsets)
            sums = sums + np.repeat(add, counts, 0)
            row = np.repeat(np.arange(len(c)), counts)
            depth = k[row] * size + np.arange(len(row)) - offsets[:-1][row] + 1
            start = np.stack([batch.column(x).to_numpy().view(np.uint64) for x in ("start_hi", "start_lo")], 1) + add
            ends = _digest(depth, sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("k"), _binary(_digest(k * size, start)), _binary(ends[offsets[1:] - 1]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _binary(ends)), batch.column("words")],
                names=["c", "k", "start", "end", "ends", "words"],
            )

    whole = local.where("last IS NULL").select("part", "c", "k", "start_hi", "start_lo", "hi", "lo", "words")
    return whole.mapInArrow(finish, "c long, k long, start binary, end binary, ends array<binary>, words array<long>")


def _binary(digests: np.ndarray) -> pa.Array:
    places = np.arange(len(digests) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(np.ascontiguousarray(digests).tobytes())])


# ---- nodes ---------------------------------------------------------------------


def _exploded(blocks: DataFrame, size: int) -> DataFrame:
    """A row for each turn of each distinct block: node, depth, parent, n_convs, conv, words."""
    one = blocks.select("start", "k", "ends", "words", "n_convs", "conv", F.posexplode("ends").alias("at", "node"))
    return one.select(
        "node",
        (F.col("k") * size + F.col("at") + 1).alias("depth"),
        F.when(F.col("at") == 0, F.col("start")).otherwise(F.get("ends", F.col("at") - 1)).alias("parent"),
        "n_convs",
        "conv",
        F.get("words", F.col("at")).alias("words"),
    )


def nodes_of(blocks: DataFrame, size: int) -> DataFrame:
    """All nodes but the root, from the blocks of all conversations."""
    distinct = blocks.groupBy("start", "end").agg(F.count("*").alias("n_convs"), F.min("c").alias("conv"), F.first("k").alias("k"), F.first("ends").alias("ends"), F.first("words").alias("words"))
    distinct = stage(distinct)
    only = F.first(F.struct("k", "ends", "words", "n_convs", "conv")).alias("b")
    following = stage(distinct.groupBy("start").agg(F.count("*").alias("blocks"), only))
    chains = _exploded(following.where("blocks = 1").select("start", "b.*"), size)
    forked = distinct.join(following.where("blocks > 1").select("start"), "start", "left_semi")
    refined = _exploded(forked, size).groupBy("node").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"), F.first("words").alias("words"))
    return chains.unionByName(refined)


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Node and the sums of ``values`` over its subtree, of a table (node, parent, values)."""
    state = stage(nodes.select("node", F.col("parent").alias("up"), *values))
    while state.where("up IS NOT NULL").limit(1).count():
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        above = state.where("up IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("higher"))
        summed = state.join(below, "node", "left").select("node", "up", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        state = stage(summed.join(above, "up", "left").select("node", F.col("higher").alias("up"), *values))
    return state.drop("up")


def _ends_digests(ends: DataFrame, tasks: int) -> DataFrame:
    """Node and SHA-256 of the ascending ids of the conversations that end there.

    A digest has to read its ids in order, so what one task reads of a node is
    packed before: thousands of ids a row, and never all in memory.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            nodes, ids = batch.column("node").to_pylist(), batch.column("c").to_pylist()
            rows, start = [], 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or nodes[k] != nodes[start] or k - start == IDS_A_CHUNK:
                    rows.append((nodes[start], ids[start], ",".join(map(str, ids[start:k]))))
                    start = k
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "c", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        node = state = None
        for batch in batches:
            done = []
            for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _named(done)
        yield _named([(node, state.hexdigest())] if node is not None else [])

    def _named(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

    packed = ends.repartitionByRange(tasks, "node", "c").sortWithinPartitions("node", "c").mapInArrow(pack, "node binary, c long, ids string")
    dealt = packed.repartition(tasks, "node").sortWithinPartitions("node", "c")
    return dealt.mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, size: int = BLOCK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    Columns: conv_id, the smallest member; depth; parent_conv_id; n_convs;
    n_children; n_leaves; saved_tokens; ends_sha256.
    """
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).where("c IS NOT NULL")
    # The role's length tells where it ends.
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    turns = turns.withColumns({"digest": digest, "words": F.regexp_count("text", F.lit(WORD)).cast("long")})
    placed = stage(_numbered(turns, tasks))

    head = F.array_sort(F.collect_list(F.struct("pos", "hi", "lo", "words"))).alias("head")
    heads = placed.where((F.col("pos") < LEAD) & (F.col("c") % FAMILY == 0)).groupBy(F.col("c").alias("base")).agg(head)
    own = placed.groupBy("c").agg(F.count("*").alias("n")).withColumns({"h": _h("c"), "base": F.col("c") - F.col("c") % FAMILY})
    lead = F.when(F.col("head").isNull() | (F.col("h") == 0), F.expr("slice(array(struct(0L pos, 0L hi, 0L lo, 0L words)), 1, 0)")).otherwise(F.slice("head", F.lit(1), F.greatest("h", F.lit(1)).cast("int")))
    convs = stage(own.join(heads, "base", "left").select("c", "n", "h", lead.alias("lead")))
    blocks = stage(_blocks(rebuilt(placed, convs), tasks, size))

    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", "conv", F.lit(0).cast("long").alias("words"))
    nodes = stage(nodes_of(blocks, size).unionByName(root))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    counted = stage(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    sums = subtree_sums(
        counted.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")),
        ["n_leaves", "saved_tokens"],
    )

    last = blocks.groupBy("c").agg(F.max(F.struct("k", "end")).alias("e")).select("c", F.col("e.end").alias("node"))
    turnless = convs.where((F.size("lead") == 0) & (F.col("n") <= F.col("h"))).select("c", F.lit(ROOT).alias("node"))
    ended = stage(_ends_digests(last.unionByName(turnless), tasks))
    above = counted.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return (
        counted.join(above, "parent", "left")
        .join(sums, "node")
        .join(ended, "node", "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("n_leaves").cast("long").alias("n_leaves"),
            F.col("saved_tokens").cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
