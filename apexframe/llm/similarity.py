"""N-gram Jaccard join by MinHash banding.

Documents with the same set of word n-grams form one class; only classes go on.
Min-hashes of a class's n-grams are cut into bands, and classes that agree in a
band are candidates. Row and band counts follow from the wanted recall at the
threshold. Candidates aren't paired within a bucket: each is tied to its bucket's
smallest member, and the connected groups of these ties hold all candidate pairs;
a class's leaders become one tie of its own and ties among leaders before anything
is joined. Within a group every pair of classes is verified on the full n-gram sets, in
blocks: a group is cut into blocks of bounded size, and each pair of blocks is a
task of its own. What leaves a task is one row a class, so no result holds pairs.

The result has one row per document: the smallest document id of its group of
linked documents, and how many documents and other texts it is linked to.

Null and empty texts and texts without words have no n-grams and no links. A text
of fewer words than n has one n-gram of all its words. Repeated rows count as
linked documents; documents with a null id take part like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import batch_name, chunks, keep_only
from apexframe.llm.shingles import Words, mix, unique_per_row
from apexframe.session import stage

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
# A task compares two blocks at most, with a few matrices of (2 x members) squared.
BLOCK_MEMBERS = 256
BLOCK_NGRAMS = 1_000_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 240) -> tuple[int, int]:
    """Bands and rows a band: the most selective rows for which enough bands are affordable.

    A pair at the threshold agrees in one of b bands of r rows with probability
    1 - (1 - threshold ** r) ** b, which has to reach the recall.
    """
    best = (1, 1)
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def ngram_sets(texts: pa.StringArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, ascending in each, and the places of texts."""
    return unique_per_row(*Words(texts).windows(n, whole_short=True))


def set_keys(hashes: np.ndarray, places: np.ndarray) -> list[bytes | None]:
    """128-bit key of each n-gram set, null for an empty one."""
    there = np.flatnonzero(np.diff(places))
    keys: list[bytes | None] = [None] * (len(places) - 1)
    if len(there):
        parts = [np.add.reduceat(mix(hashes ^ np.uint64(salt)), places[:-1][there]) for salt in (0x51ED270B, 0xA24BAED4963EE407)]
        data = np.stack(parts, 1).astype(">u8").tobytes()
        for k, row in enumerate(there.tolist()):
            keys[row] = data[16 * k : 16 * k + 16]
    return keys


def band_keys(hashes: np.ndarray, places: np.ndarray, bands: int, rows: int, seed: int = 17) -> np.ndarray:
    """Key of each band of every text with n-grams: equal keys mean equal rows in the same band."""
    there = places[:-1][np.diff(places) > 0]
    factors = np.random.default_rng(seed).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(there), bands), np.uint64)
    product = np.empty_like(hashes)
    for band in range(bands):
        key = np.full(len(there), band + 1, np.uint64)
        for factor in factors[band * rows : (band + 1) * rows]:
            np.multiply(hashes, factor, out=product)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(product, there))
        out[:, band] = key
    return out.view(np.int64)


def signatures(documents: DataFrame, bands: int, rows: int, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n-gram set key, number of n-grams and band keys of every document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch, texts in chunks(batches, "text"):
            hashes, places = ngram_sets(texts, n)
            keys = band_keys(hashes, places, bands, rows)
            counts = np.diff(places)
            ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(set_keys(hashes, places), pa.binary()), pa.array(counts, pa.int64()), listed], names=["id", "key", "ngrams", "bands"])

    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, key binary, ngrams long, bands array<long>")


def reduced_ties(met: DataFrame, node: str, hub: str) -> DataFrame:
    """Edges (a, b) that connect what the rows of ``met`` connect, about one a node.

    Each node is tied to the smallest hub it was met with, and that hub to the
    node's others. Hubs of many nodes repeat, so far fewer edges than rows are left.
    """
    hubs = met.where(F.col(node) != F.col(hub)).groupBy(F.col(node).alias("node")).agg(F.collect_set(hub).alias("hubs"))
    least = F.array_min("hubs")
    own = hubs.select(F.col("node").alias("a"), least.alias("b"))
    others = hubs.where(F.size("hubs") > 1).select(F.explode("hubs").alias("a"), least.alias("b")).where("a <> b")
    return own.union(others.distinct())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Node and root, the smallest node it is connected with, of the nodes on edges (a, b).

    Rounds take the smallest root among neighbours and then the root's root; each
    is staged. Minima are formed before the shuffle, so hot nodes do no harm.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(most_rounds):
        met = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("met"))
        nearer = roots.join(met, F.col("node") == F.col("a"), "left").select("node", F.least("root", "met").alias("near"), "root")
        above = roots.select(F.col("node").alias("parent"), F.col("root").alias("top"))
        jumped = nearer.join(above, F.col("near") == F.col("parent"), "left").select("node", F.least("near", "top").alias("root"), (F.least("near", "top") < F.col("root")).alias("moved"))
        new = stage(jumped)
        roots = new.select("node", "root")
        if new.where("moved").limit(1).count() == 0:
            return roots
    raise RuntimeError(f"components need over {most_rounds} rounds")


# Bits of an id filter: 8 MB in all, however many ids there are.
FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame) -> DataFrame:
    """Bitmap of the hashes of the ids in the one column of ``ids``, by piece of 4 KB.

    Its size is fixed, so it may be broadcast. With very many ids it lets
    everything through, which costs a shuffle and changes no result.
    """
    place = _filter_place(F.col(ids.columns[0]))
    return stage(
        ids.groupBy(F.bitmap_bucket_number(place).alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    )


def _filter_place(column):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1


def may_contain(documents: DataFrame, id_col: str, bitmap: DataFrame, there: bool = True) -> DataFrame:
    """Documents whose id may be in the filter, or with ``there`` false those whose id can't be."""
    place = _filter_place(F.col(id_col))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8 + 1).cast("int"))
    hit = F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))
    joined = documents.join(F.broadcast(bitmap), F.bitmap_bucket_number(place) == F.col("_piece"), "left")
    return joined.where(hit if there else ~hit).select(*[documents[c] for c in documents.columns])


def verified(hashes: list[np.ndarray], block: np.ndarray, rows: np.ndarray, ratio: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked documents, linked texts and component number of each member of a task.

    Members of the same block are only compared if all are of one block; else the
    blocks are compared with each other.
    """
    n = len(hashes)
    sizes = np.fromiter(map(len, hashes), np.int64, n)
    member = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(hashes), return_inverse=True)
    frequency = np.bincount(code)
    common = np.zeros((n, n), np.int32)
    # Rare n-grams: their pairs one by one. Frequent ones: products of dense 0/1 columns.
    rare = (frequency[code] > 1) & (frequency[code] <= 32)
    order = np.argsort(code[rare], kind="stable")
    of, who = code[rare][order], member[rare][order]
    for step in range(1, int(frequency[of].max(initial=1))):
        same = of[step:] == of[:-step]
        if not same.any():
            break
        np.add.at(common, (who[:-step][same], who[step:][same]), 1)
    common += common.T
    often = np.flatnonzero(frequency > 32)
    if len(often):
        place = np.full(len(frequency), -1, np.int64)
        place[often] = np.arange(len(often))
        at = place[code]
        for k in range(0, len(often), 2048):
            here = (at >= k) & (at < k + 2048)
            dense = np.zeros((n, min(2048, len(often) - k)), np.float32)
            dense[member[here], at[here] - k] = 1
            common += (dense @ dense.T).astype(np.int32)
    p, q = ratio.numerator, ratio.denominator
    # common / (a + b - common) >= p / q
    linked = (p + q) * common.astype(np.int64) >= p * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if (block != block[0]).any():
        linked &= block[:, None] != block[None, :]
    roots = np.arange(n)
    while True:
        least = np.minimum(roots, np.where(linked, roots[None, :], n).min(axis=1))
        least = least[least]
        if (least == roots).all():
            break
        roots = least
    return (linked * rows[None, :]).sum(1), linked.sum(1), roots


def _link_tasks(members: DataFrame, ratio: Fraction, n: int) -> DataFrame:
    """Links of the classes, task by task: key, linked documents, linked texts and a class of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        task, own, cross = None, {}, False
        for batch, texts in chunks(batches, "text"):
            hashes, places = ngram_sets(texts, n)
            keys = set_keys(hashes, places)
            columns = (batch.column(c).to_pylist() for c in ("task", "key", "low", "high", "block", "rows"))
            for k, (name, key, low, high, block, rows) in enumerate(zip(*columns, strict=True)):
                if name != task:
                    yield from _links(own, ratio, cross)
                    task, own, cross = name, {}, low != high
                # Another text under the same id, or a copy, isn't the class itself.
                if keys[k] == key and key not in own:
                    own[key] = (hashes[places[k] : places[k + 1]].copy(), block, rows)
        yield from _links(own, ratio, cross)

    return members.mapInArrow(run, "key binary, links long, texts long, root binary")


def _links(own: dict[bytes, tuple[np.ndarray, int, int]], ratio: Fraction, cross: bool) -> Iterator[pa.RecordBatch]:
    if not own:
        return
    keys = sorted(own)
    hashes, block, rows = zip(*(own[k] for k in keys), strict=True)
    if cross and len(set(block)) < 2:
        return  # the other block is empty, and a task of its own compares within this one
    links, texts, roots = verified(list(hashes), np.array(block), np.array(rows, np.int64), ratio)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(links, pa.int64()), pa.array(texts, pa.int64()), pa.array([keys[r] for r in roots], pa.binary())],
        names=["key", "links", "texts", "root"],
    )


def jaccard_join(documents: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", block_members: int = BLOCK_MEMBERS, block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """Id, group, number of linked documents and of other linked texts of every document."""
    bands, rows = banding(threshold, recall)
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = stage(signatures(documents, bands, rows, n, id_col, text_col))
    classes = stage(signed.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("ngrams").alias("ngrams"), F.first("bands").alias("bands")))

    banded = classes.select("key", F.explode("bands").alias("band"))
    buckets = stage(banded.groupBy("band").agg(F.min("key").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader"))
    grouped = components(reduced_ties(banded.join(buckets, "band"), "key", "leader"))

    # Blocks: how many a group needs, and every class in all pairs of its block with another.
    inside = classes.select("key", "rep", "rows", "ngrams").join(grouped, F.col("key") == F.col("node")).select("key", "rep", "rows", "ngrams", F.col("root").alias("grp"))
    inside = stage(inside)
    needed = F.greatest(F.ceil(F.count("*") / block_members), F.ceil(F.sum("ngrams") / block_ngrams)).cast("int")
    sized = stage(inside.groupBy("grp").agg(needed.alias("blocks")))
    blocked = inside.join(sized, "grp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # Only the texts of these classes are moved.
    bitmap = id_filter(inside.select("rep"))
    dealt = blocked.select("key", "rep", "rows", "grp", "block", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select("key", "rep", "rows", "block", low.alias("low"), high.alias("high"), F.concat_ws("-", F.hex("grp"), low, high).alias("task"))
    texts = may_contain(documents.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")), "rep", bitmap)
    members = texts.join(dealt.withColumnRenamed("rep", "class_rep"), F.col("rep").eqNullSafe(F.col("class_rep"))).select("task", "key", "low", "high", "block", "rows", "text")
    members = members.repartition(tasks, "task").sortWithinPartitions("task", "key")
    found = stage(_link_tasks(members, Fraction(str(threshold)), n))

    # Groups of verified links, and their smallest document.
    roots = components(reduced_ties(found, "key", "root"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    rooted = classes.select("key", "rep", "rows").join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", "rows", F.coalesce("root", "key").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("rep").alias("group_id"))
    known = stage(rooted.join(groups, "root").join(counts, "key", "left").select("key", "group_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts")))
    return signed.select("id", "key").join(known, "key", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("group_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )


def keep_first(documents: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of linked documents, the one with the smallest id, with all its columns.

    Of repeated rows with that id one stays.
    """
    joined = stage(jaccard_join(documents, threshold, n, id_col=id_col, text_col=text_col))
    stays = F.bool_or(F.col(id_col).eqNullSafe(F.col("class_id")))
    ids = joined.groupBy(id_col).agg(stays.alias("stays"), F.count("*").alias("n"))
    listed = stage(ids.where("NOT stays OR n > 1").select(F.col(id_col).alias("listed_id"), "stays"))
    # Documents that can't be on the list stay where they are. Columns go by
    # place, so that no name clashes.
    columns = documents.columns
    own = documents.toDF(*[batch_name(k) for k in range(len(columns))])
    own_id, own_text = (batch_name(columns.index(c)) for c in (id_col, text_col))
    bitmap = id_filter(listed.select("listed_id"))
    sure = may_contain(own, own_id, bitmap, there=False)
    asked = may_contain(own, own_id, bitmap).join(listed, F.col(own_id).eqNullSafe(F.col("listed_id")), "left")
    once = asked.where("stays IS NULL").select(*own.columns)
    more = asked.where("stays").select(*own.columns).dropDuplicates([own_id, own_text])
    return sure.unionByName(once).unionByName(more).toDF(*columns)
