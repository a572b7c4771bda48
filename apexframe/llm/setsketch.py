"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct five-word shingles, letters A-Z lower-cased.
Register i of a set is the rank of the smallest of its elements' i-th exponential
variates on an exponentially spaced scale, cut off at both ends: one byte, and
the registers of a union are the maxima of the parts' registers. Registers of
like sets agree often, so bands of them are shuffled on to find candidates. For a
candidate pair the numbers of registers that are greater, smaller and equal
estimate the likeness by maximum likelihood, and what survives is verified on the
full sets.

Only connected groups are wanted, so a pair already connected is never compared:

1. Documents with equal sets form a class; only classes go on.
2. Each class is verified with one other, the most met of its buckets' hubs. That
   is one comparison a class, however large a group of near copies is.
3. In buckets whose members are still in several groups, members outside the
   group's main component are compared with all others and with each other, in
   blocks of bounded size, if they share a band and their registers allow it.

Null and empty texts and texts without words have an empty set: they are linked
with nothing, not even with each other. A text of fewer than five words has one
shingle of all its words. Repeated rows and ties: equal sets are linked. A null id
takes part; it is the least of a group only if there is no other, and then
``component_id`` is null.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import chunks, keep_only
from apexframe.llm.shingles import mix
from apexframe.llm.similarity import components, id_filter, may_contain, ngram_sets, reduced_ties, set_keys
from apexframe.session import stage

SHINGLE = 5
THRESHOLD = 0.85
RECALL = 0.9995
BASE = 1.2
RATE = 20.0
LAST = 254  # registers are 0 .. LAST + 1 and fit a byte
MOST_REGISTERS = 255
# A pair is dropped unverified if the likelihood at the threshold or above is
# less than exp(-SLACK) of the largest one: fewer than one linked pair in 10,000.
SLACK = 10.0
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 1_000_000


# ---- registers ---------------------------------------------------------------


def registers(hashes: np.ndarray, places: np.ndarray, count: int, base: float = BASE, seed: int = 29) -> np.ndarray:
    """Registers of every non-empty set, one row each.

    The smallest hash of a set is the smallest of its uniform variates, so the
    logarithms are only taken of one number a register.
    """
    there = places[:-1][np.diff(places) > 0]
    factors = np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.empty((len(there), count), np.uint64)
    product = np.empty_like(hashes)
    for k, factor in enumerate(factors):
        np.multiply(hashes, factor, out=product)
        least[:, k] = np.minimum.reduceat(product, there) if len(there) else 0
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    ranks = np.floor(1 - np.log(smallest) / math.log(base))
    return np.clip(ranks, 0, LAST + 1).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def greater_share(x: np.ndarray | float, base: float = BASE) -> np.ndarray | float:
    """Chance that a register of one set is greater, x being what it has alone of the sum of both sizes."""
    return -np.log1p(-x * (base - 1) / base) / math.log(base)


def equal_share(likeness: float, share: float = 0.5, base: float = BASE) -> float:
    """Chance that a register of two sets agrees; ``share`` is the first one's of the sum of their sizes."""
    u, v = share, 1 - share
    return float(1 - greater_share(max(u - v * likeness, 0.0), base) - greater_share(max(v - u * likeness, 0.0), base))


def estimated(greater: np.ndarray, smaller: np.ndarray, count: int, size_a: np.ndarray, size_b: np.ndarray, base: float = BASE, steps: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likeness of largest likelihood of each pair, the logarithm of that likelihood, and the grid's.

    ``greater`` and ``smaller`` are numbers of registers of ``count``; the sizes
    bound the likeness by that of nested sets, so they are estimated jointly.
    The third result has a row a pair: log-likelihoods at ``steps`` likenesses
    from 0 to the smaller size over the larger.
    """
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = most * (np.arange(steps)[None, :] / (steps - 1))
    p = np.clip(greater_share(np.maximum(u - v * grid, 0), base), 1e-12, 1)
    q = np.clip(greater_share(np.maximum(v - u * grid, 0), base), 1e-12, 1)
    logs = greater[:, None] * np.log(p) + smaller[:, None] * np.log(q) + (count - greater - smaller)[:, None] * np.log(np.clip(1 - p - q, 1e-12, 1))
    best = logs.argmax(1)
    rows = np.arange(len(logs))
    return grid[rows, best], logs[rows, best], logs


def plausible(greater: np.ndarray, smaller: np.ndarray, count: int, size_a: np.ndarray, size_b: np.ndarray, threshold: float, base: float = BASE) -> np.ndarray:
    """Pairs whose likeness may be the threshold or more."""
    if not len(greater):
        return np.zeros(0, bool)
    most = np.minimum(size_a / size_b, size_b / size_a)
    found, best, logs = estimated(greater, smaller, count, size_a, size_b, base)
    steps = logs.shape[1]
    from_step = np.minimum(np.floor(threshold / most * (steps - 1)), steps - 1)
    above = np.where(np.arange(steps)[None, :] >= from_step[:, None], logs, -np.inf).max(1)
    return (most >= threshold - 1e-9) & (above >= best - SLACK)


@functools.cache
def banding(threshold: float = THRESHOLD, recall: float = RECALL, base: float = BASE, most: int = MOST_REGISTERS) -> tuple[int, int]:
    """Bands and registers a band, the most selective that reach the recall at the threshold.

    The chance that a register agrees depends a little on the two sizes; the
    smallest counts.
    """
    lowest = min(equal_share(threshold, u / (1 + u), base) for u in np.linspace(threshold, 1, 50))
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - lowest**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Key of each band of every row of registers."""
    out = np.empty((len(values), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(values), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k].astype(np.uint64))
        out[:, band] = key
    return out.view(np.int64)


# ---- signatures and full sets ------------------------------------------------


def _lowered(texts: pa.StringArray) -> pa.StringArray:
    return pc.ascii_lower(texts)


def sketches(documents: DataFrame, bands: int, rows: int, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, set key, number of shingles, registers and band keys of every document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch, texts in chunks(batches, "text"):
            hashes, places = ngram_sets(_lowered(texts), n)
            counts = np.diff(places)
            values = registers(hashes, places, bands * rows)
            kept, data = iter(values), [None] * len(counts)
            for k in np.flatnonzero(counts).tolist():
                data[k] = next(kept).tobytes()
            ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_hashes(values, bands, rows).ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(set_keys(hashes, places), pa.binary()), pa.array(counts, pa.int64()), pa.array(data, pa.binary()), listed],
                names=["id", "key", "shingles", "registers", "bands"],
            )

    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, key binary, shingles long, registers binary, bands array<long>")


def full_sets(documents: DataFrame, classes: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Key and ascending shingle hashes of the listed classes (key, rep).

    The texts are read anew: only those of classes with candidates are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch, texts in chunks(batches, "text"):
            hashes, places = ngram_sets(_lowered(texts), n)
            wanted, keys = batch.column("key").to_pylist(), set_keys(hashes, places)
            # Another text under the same id isn't the class.
            own = [k for k in range(len(keys)) if keys[k] == wanted[k]]
            data = [hashes[places[k] : places[k + 1]].tobytes() for k in own]
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in own], pa.binary()), pa.array(data, pa.binary())], names=["key", "set"])

    texts = may_contain(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", id_filter(classes.select("rep")))
    joined = texts.join(classes.select("key", "rep"), F.col("id").eqNullSafe(F.col("rep")))
    return joined.select("key", "text").mapInArrow(run, "key binary, set binary").dropDuplicates(["key"])


# ---- links -------------------------------------------------------------------


def linked(common: np.ndarray | int, size_a: np.ndarray | int, size_b: np.ndarray | int, ratio: Fraction) -> np.ndarray | bool:
    """common / (a + b - common) >= ratio, in whole numbers."""
    return (ratio.numerator + ratio.denominator) * common >= ratio.numerator * (size_a + size_b)


def _register_rows(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)


def _star_links(members: DataFrame, threshold: float, ratio: Fraction) -> DataFrame:
    """Members (task, hub, key, registers, set) that are linked with the hub of their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        task = hub = None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            columns = (batch.column(c).to_pylist() for c in ("task", "is_hub", "key", "registers", "set"))
            for name, is_hub, key, values, data in zip(*columns, strict=True):
                own = np.frombuffer(data, np.uint64)
                if is_hub:
                    task, hub = name, (key, own, np.frombuffer(values, np.uint8).astype(np.int16))
                    continue
                if name != task:
                    continue  # the hub's text is not there: nothing can be linked with it
                difference = np.frombuffer(values, np.uint8).astype(np.int16) - hub[2]
                count = len(difference)
                sizes = np.array([len(own)]), np.array([len(hub[1])])
                if plausible(np.array([(difference > 0).sum()]), np.array([(difference < 0).sum()]), count, *sizes, threshold)[0]:
                    common = len(np.intersect1d(own, hub[1], assume_unique=True))
                    if linked(common, len(own), len(hub[1]), ratio):
                        found.append((key, hub[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["key", "root"])

    return members.mapInArrow(run, "key binary, root binary")


def compared(sets: list[np.ndarray], values: np.ndarray, bands: np.ndarray, component: list, side: np.ndarray, cross: bool, threshold: float, ratio: Fraction) -> np.ndarray:
    """Number of each member's component after verifying the pairs that may join two components.

    With ``cross`` only pairs of different sides count, else all pairs.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    numbers = {c: k for k, c in enumerate(dict.fromkeys(component))}
    roots = np.array([numbers[c] for c in component])
    wide = values.astype(np.int16)
    for a in range(n - 1):
        other = np.arange(a + 1, n)
        other = other[roots[other] != roots[a]]
        if cross:
            other = other[side[other] != side[a]]
        other = other[(bands[other] == bands[a]).any(1)] if len(other) else other
        if not len(other):
            continue
        difference = wide[other] - wide[a]
        keep = plausible((difference > 0).sum(1), (difference < 0).sum(1), values.shape[1], sizes[other], np.full(len(other), sizes[a]), threshold)
        for b in other[keep].tolist():
            if roots[a] != roots[b] and linked(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), sizes[a], sizes[b], ratio):
                roots[roots == roots[b]] = roots[a]
    return roots


def _block_links(members: DataFrame, threshold: float, ratio: Fraction) -> DataFrame:
    """Components found in each task of one or two blocks: key and a key of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        task, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["task"] != task:
                    yield from emit(held)
                    task, held = row["task"], {}
                held.setdefault(row["key"], row)
        yield from emit(held)

    def emit(held: dict[bytes, dict]) -> Iterator[pa.RecordBatch]:
        rows = [held[k] for k in sorted(held)]
        if len(rows) < 2:
            return
        roots = compared(
            [np.frombuffer(r["set"], np.uint64) for r in rows],
            _register_rows([r["registers"] for r in rows]),
            np.array([r["bands"] for r in rows], np.int64),
            [r["component"] for r in rows],
            np.array([r["side"] for r in rows]),
            rows[0]["low"] != rows[0]["high"],
            threshold,
            ratio,
        )
        first: dict[int, bytes] = {}
        for r, root in zip(rows, roots.tolist(), strict=True):
            first.setdefault(root, r["key"])
        pairs = [(r["key"], first[root]) for r, root in zip(rows, roots.tolist(), strict=True) if r["key"] != first[root]]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["key", "root"])

    return members.mapInArrow(run, "key binary, root binary")


def _parts(members, shingles, block_members: int, block_shingles: int):
    """Blocks that so many members with so many shingles need."""
    return F.greatest(F.ceil(members / block_members), F.ceil(shingles / block_shingles), F.lit(1)).cast("int")


def near_duplicates(
    documents: DataFrame,
    threshold: float = THRESHOLD,
    n: int = SHINGLE,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_members: int = BLOCK_MEMBERS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Id, size of its set, smallest id it is connected with, and whether that is its own, of every document."""
    bands, rows = banding(threshold, recall)
    ratio = Fraction(str(threshold))
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = stage(sketches(documents, bands, rows, n, id_col, text_col))
    facts = F.first(F.struct("shingles", "registers", "bands")).alias("f")
    classes = stage(signed.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), facts).select("key", "rep", "f.*"))

    # Hubs: the class that a bucket's members meet most often in all buckets.
    banded = classes.select("key", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    meets = stage(banded.join(sizes, "band"))
    met = meets.groupBy("key").agg(F.sum("n").alias("met"))
    ranked = stage(meets.join(met, "key").select("key", "band", "met"))
    hubs = stage(ranked.groupBy("band").agg(F.max(F.struct("met", "key")).alias("hub")).select("band", F.col("hub.key").alias("hub"), F.col("hub.met").alias("hub_met")))
    own = ranked.join(hubs, "band").groupBy("key").agg(F.max(F.struct("hub_met", "hub")).alias("best"))
    star = stage(own.select("key", F.col("best.hub").alias("hub")))
    sets = stage(full_sets(documents, classes.join(star.select("key"), "key", "left_semi"), n, id_col, text_col))
    known = classes.select("key", "shingles", "registers")

    # One comparison a class. A hub's set goes to as many tasks as its members need.
    edges = star.where("key <> hub")
    needed = _parts(F.count("*"), F.sum("shingles"), block_members, block_shingles)
    parts = stage(edges.join(known.select("key", "shingles"), "key").groupBy("hub").agg(needed.alias("parts")))
    dealt = edges.join(parts, "hub").select("key", F.concat_ws("-", F.hex("hub"), F.pmod(F.xxhash64("key"), F.col("parts"))).alias("task"), F.lit(False).alias("is_hub"))
    centres = parts.select(F.col("hub").alias("key"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.concat_ws("-", F.hex("hub"), k))).alias("task"), F.lit(True).alias("is_hub"))
    members = dealt.unionByName(centres).join(known.drop("shingles"), "key").join(sets, "key")
    members = members.repartition(tasks, "task").sortWithinPartitions("task", F.desc("is_hub"), "key")
    found = stage(_star_links(members, threshold, ratio))
    roots = components(reduced_ties(found, "key", "root"))

    # What is left: buckets with members of several components.
    rooted = stage(star.select("key").join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("component")))
    placed = ranked.select("key", "band").join(rooted, "key")
    open_buckets = placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("key").alias("leader")).where("a <> b").select("band", "leader")
    ties = stage(placed.join(stage(open_buckets), "band").select("key", "leader", "component"))
    groups = components(reduced_ties(ties, "key", "leader"))
    inside = stage(groups.select(F.col("node").alias("key"), F.col("root").alias("grp")).join(rooted, "key").join(known.select("key", "shingles"), "key"))
    held = inside.groupBy("grp", "component").agg(F.count("*").alias("n"))
    main = held.groupBy("grp").agg(F.max(F.struct("n", "component")).alias("m")).select("grp", F.col("m.component").alias("main"))
    sided = stage(inside.join(main, "grp").select("key", "grp", "component", "shingles", (F.col("component") == F.col("main")).alias("is_main")))
    # Blocks 0 .. rest - 1 are of the rest, the others of the main component. Tasks: each pair that holds a rest block.
    of_rest, of_main = (
        _parts(F.count(F.when(here, 1)), F.coalesce(F.sum(F.when(here, F.col("shingles"))), F.lit(0)), block_members, block_shingles)
        for here in (~F.col("is_main"), F.col("is_main"))
    )
    blocks = stage(sided.groupBy("grp").agg(of_rest.alias("rest_blocks"), of_main.alias("main_blocks")))
    code = F.xxhash64("key")
    block = F.when(F.col("is_main"), F.col("rest_blocks") + F.pmod(code, F.col("main_blocks"))).otherwise(F.pmod(code, F.col("rest_blocks")))
    blocked = sided.join(blocks, "grp").withColumn("block", block.cast("int"))
    last = F.when(F.col("is_main"), F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks")) - 1
    spread = blocked.select("key", "grp", "component", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    spread = spread.select("key", "component", F.col("block").alias("side"), low.alias("low"), high.alias("high"), F.concat_ws("-", F.hex("grp"), low, high).alias("task"))
    members = spread.join(classes.select("key", "registers", "bands"), "key").join(sets, "key")
    members = members.repartition(tasks, "task").sortWithinPartitions("task", "key")
    more = stage(_block_links(members, threshold, ratio))

    ties = reduced_ties(more, "key", "root").union(rooted.select("key", "component").where("key <> component"))
    roots = components(ties)
    ended = classes.select("key", "rep").join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = ended.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(ended.join(least, "root").select("key", "component_id"))
    return signed.select("id", "key", "shingles").join(named, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("shingles").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("key").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
