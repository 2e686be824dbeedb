"""SimHash near-dedup: fingerprints, pairs within a few bits by the generalised pigeonhole principle, components.

If two fingerprints differ in at most k bits and the bits are dealt into partitions with thresholds t_i (-1
leaves a partition out) such that sum(t_i + 1) >= k + 1, they differ in at most t_i bits in some partition.
Correlated bits are put into the same partition, so that the partitions tell more from each other;
thresholds are chosen by dynamic programming over the estimated number of candidates and probes of each
partition and threshold. Fingerprints meet where a probe of one equals the partition of the other; all of a
meeting are verified, and only a spanning forest of the true links leaves the group. Groups that are too
large for a task are dealt anew by the bits that are left, by the same principle, which loses no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrain.llm.common import checkpoint, column, slices

BITS = 64
#: Distinct fingerprints, the first by hash, from which correlations and candidate counts are estimated.
SAMPLE = 4096
#: Members of a group that one task compares; larger groups are dealt anew by other bits.
GROUP = 100_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingle_hashes(text: bytes | None, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every run of size words, of the whole text if it has fewer, none if it has no word."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())]


def fingerprints(texts: list[bytes | None], size: int = 3) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its shingles' hashes."""
    hashes = [shingle_hashes(t, size) for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array([x for h in hashes for x in h], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        over = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > counts[full][:, None]
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(documents: DataFrame, size: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and fp (the fingerprint as a signed long) of every row."""
    kept = documents.select(*keep, F.col("text").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 2 << 20):
                fp = fingerprints(column(batch, "__text").to_pylist(), size)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return kept.mapInArrow(run, kept.select(*keep, F.lit(0).cast("long").alias("fp")).schema)


# --- partitions and thresholds


def group_bits(sample: np.ndarray, parts: int, bits: list[int]) -> list[list[int]]:
    """Deals bits into partitions of about equal size, each with the bits most correlated to those it has."""
    values = (sample[:, None] >> np.array(bits, np.uint64)) & np.uint64(1)
    centred = values.astype(float) - values.mean(axis=0) if len(sample) else np.zeros((1, len(bits)))
    spread = np.sqrt((centred**2).sum(axis=0))
    corr = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-12)
    left, out = [*range(len(bits))], []
    for p in range(parts):
        take = math.ceil(len(left) / (parts - p))
        mine = [left.pop(0)]
        while len(mine) < take:
            best = max(left, key=lambda b: corr[b, mine].sum())
            left.remove(best)
            mine.append(best)
        out.append(sorted(bits[i] for i in mine))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def probes_of(bits: list[int], within: int) -> list[int]:
    """Masks to flip: all sets of at most within bits."""
    return [sum(1 << b for b in c) for n in range(within + 1) for c in combinations(bits, n)]


def estimate(sample: np.ndarray, n: int, parts: list[list[int]], k: int) -> np.ndarray:
    """Cost of each partition and threshold -1, 0 .. k: estimated candidate pairs and the probes themselves."""
    cost = np.zeros((len(parts), k + 2))
    scale = (n / max(1, len(sample))) ** 2
    for i, bits in enumerate(parts):
        own = sample & np.uint64(mask_of(bits))
        within = np.zeros(k + 1)
        for at in range(0, len(own), 512):
            d = np.bitwise_count(own[at : at + 512, None] ^ own[None, :])
            within += [(d <= t).sum() for t in range(k + 1)]
        for t in range(k + 1):
            # a pair by chance is expected even where the sample shows none
            chance = sum(math.comb(len(bits), e) for e in range(t + 1)) / 2 ** len(bits)
            cost[i, t + 1] = max((within[t] - len(own)) / 2 * scale, chance * n * n / 2) + 50 * n * len(probes_of(bits, t))
    return cost


def allocate(cost: np.ndarray, k: int) -> tuple[float, list[int]]:
    """Thresholds of the lowest total cost with sum(t_i + 1) >= k + 1, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for have, (c, ts) in best.items():
            for t in range(-1, k + 1):
                now = min(k + 1, have + t + 1)
                if now not in after or c + row[t + 1] < after[now][0]:
                    after[now] = (c + row[t + 1], [*ts, t])
        best = after
    return best[k + 1]


def plan(sample: np.ndarray, n: int, k: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions that are probed, the cheapest over several numbers of partitions."""
    plans = []
    for parts in range(2, k + 4):
        dealt = group_bits(sample, parts, [*range(BITS)])
        cost, ts = allocate(estimate(sample, n, dealt, k), k)
        plans.append((cost, [(b, t) for b, t in zip(dealt, ts) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


# --- links within groups


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(fps: np.ndarray, bits: list[int], k: int, small: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, index) that join what is within k bits; beyond small members the bits left are dealt again."""
    n = len(fps)
    if n <= small or len(bits) <= k + 1:
        a, b = [], []
        for at in range(0, n, small):
            x, y = np.nonzero(np.bitwise_count(fps[at : at + small, None] ^ fps[None, :]) <= k)
            x = x + at
            a.append(x[x < y])
            b.append(y[x < y])
        a, b = np.concatenate(a), np.concatenate(b)
        label = _labels(n, a, b)
        own = np.flatnonzero(label != np.arange(n))
        return own, label[own]
    out_a, out_b = [], []
    for p in range(k + 1):
        part = bits[p :: k + 1]
        rest = [x for x in bits if x not in part]
        value = fps & np.uint64(mask_of(part))
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                a, b = _forest(fps[group], rest, k, small)
                out_a.append(group[a])
                out_b.append(group[b])
    a = np.concatenate([np.zeros(0, np.int64), *out_a])
    b = np.concatenate([np.zeros(0, np.int64), *out_b])
    label = _labels(n, a, b)
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _links(keys: np.ndarray, fps: np.ndarray, bits: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links of fingerprints sorted by key; pairs of small groups are compared all at once."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate(([0], cuts))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    out_a, out_b = [], []
    few = sizes <= 32
    for size in np.unique(sizes[few]):
        if size > 1:
            at = starts[few & (sizes == size)]
            for i, j in combinations(range(size), 2):
                near = at[np.bitwise_count(fps[at + i] ^ fps[at + j]) <= k]
                out_a.append(near + i)
                out_b.append(near + j)
    for s, size in zip(starts[~few].tolist(), sizes[~few].tolist()):
        a, b = _forest(fps[s : s + size], bits, k)
        out_a.append(a + s)
        out_b.append(b + s)
    a = np.concatenate([np.zeros(0, np.int64), *out_a])
    b = np.concatenate([np.zeros(0, np.int64), *out_b])
    label = _labels(len(fps), a, b)
    own = np.flatnonzero(label != np.arange(len(fps)))
    return fps[own], fps[label[own]]


def _linked(keyed: DataFrame, k: int) -> DataFrame:
    """Forest links (a, b) of rows (mask, key, fp), where key is a hash of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

        def done(masks, keys, fps):
            for m in np.unique(masks):
                one = masks == m
                fp, key = fps[one], keys[one]
                a, b = _links(key, fp, [i for i in range(BITS) if not int(m) & 0xFFFFFFFFFFFFFFFF & (1 << i)], k)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            masks, keys, fps = (column(batch, c).to_numpy() for c in ("mask", "key", "fp"))
            masks, keys, fps = (np.concatenate(x) for x in zip(held, (masks, keys, fps.view(np.uint64))))
            if not len(keys):
                continue
            last = np.flatnonzero((keys != keys[-1]) | (masks != masks[-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = (masks[cut:], keys[cut:], fps[cut:])
            if cut:
                yield from done(masks[:cut], keys[:cut], fps[:cut])
        if len(held[0]):
            yield from done(*held)

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(fps: DataFrame, splits: list[tuple[int, list[int]]], held: Column, centre: Column) -> DataFrame:
    """Rows (mask, key, fp): for each (mask of new bits, flips), key is a hash of the centre and of the new bits.

    The centre stands for the group so far; its members can differ in held bits, where probes flipped some.
    """
    rows = [
        F.struct(held.bitwiseOR(F.lit(_signed(mask))).alias("mask"), F.xxhash64(held.bitwiseOR(F.lit(_signed(mask))), centre, F.col("fp").bitwiseXOR(F.lit(_signed(flip))).bitwiseAND(F.lit(_signed(mask)))).alias("key"))
        for mask, flips in splits
        for flip in flips
    ]
    return fps.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.mask", "r.key", "fp").distinct()


def near_links(fps: DataFrame, k: int = 2, sample: int = SAMPLE, group: int = GROUP) -> DataFrame:
    """Links (a, b), a != b, that join all of the distinct fingerprints fp which are within k bits over any path."""
    seen = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    probed = plan(seen, fps.count(), k)
    rows = checkpoint(_keys(fps, [(mask_of(b), probes_of(b, t)) for b, t in probed], F.lit(0).cast("long"), F.lit(0).cast("long")))
    links = []
    while True:
        # with no bit left, members differ by the flips alone, so they are few
        hot = rows.where("mask != -1").groupBy("mask", "key").count().where(F.col("count") > group).select("mask", "key")
        hot = checkpoint(hot)
        if hot.isEmpty():
            return _union([*links, _linked(rows, k)]).where("a != b").distinct()
        links.append(_linked(rows.join(hot, ["mask", "key"], "left_anti"), k))
        again = rows.join(hot, ["mask", "key"])
        parts = []
        for (mask,) in hot.select("mask").distinct().collect():  # as many as there are sets of bits
            left = [i for i in range(BITS) if not mask & 0xFFFFFFFFFFFFFFFF & (1 << i)]
            splits = [(mask_of(left[p :: k + 1]), [0]) for p in range(k + 1)] if len(left) > k + 1 else [(mask_of(left), probes_of(left, k))]
            parts.append(_keys(again.where(F.col("mask") == mask), splits, F.lit(mask).cast("long"), F.col("key")))
        rows = checkpoint(_union(parts))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the smallest node of its component.

    Large-star and small-star steps alternate until the links are stars; each step is an aggregate and an
    equi-join, and lineage is cut after each round.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.where("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v != m")
        large = large.union(low.where("v != low").select("v", F.col("low").alias("m"))).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct("v", F.col("low").alias("m")))).alias("e")).select("e.v", "e.m")
        edges = checkpoint(small.where("v != m").distinct())
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "m")).alias("x"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("root"))
        state = now


def _rooted(first: DataFrame, k: int) -> DataFrame:
    """Rows (fp, low) of distinct fp with root, the smallest fingerprint of the component."""
    roots = components(near_links(first.select("fp"), k))
    return first.join(roots, first.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, k: int = 2, size: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that is reachable, for every row of documents.

    Cases: null and empty texts have fingerprint zero and link like any other; repeated rows and texts share
    a fingerprint and a component; a null doc_id is no component's name unless all of its ids are null (then
    null); an empty table gives none; other columns are not read.
    """
    marked = checkpoint(with_fingerprint(documents, size))
    first = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    rooted = _rooted(first, k)
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(checkpoint(rooted.join(named, "root").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def deduplicate(documents: DataFrame, k: int = 2, size: int = 3) -> DataFrame:
    """Of each component one document, the first by (doc_id, hash of text); all rows of null ids.

    An id whose rows hold texts of several components can stand for each of them, with the text of each.
    """
    named = documents.where("doc_id is not null").withColumn("__h", F.xxhash64("text"))
    marked = with_fingerprint(documents.select("doc_id", "text", F.xxhash64("text").alias("h")), size, ("doc_id", "h"))
    lowest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h")))
    rooted = _rooted(checkpoint(marked.groupBy("fp").agg(lowest.alias("low"))), k)
    found = rooted.groupBy("root").agg(F.min("low").alias("low")).where("low is not null").select("low.doc_id", F.col("low.h").alias("__h"))
    kept = named.join(found, ["doc_id", "__h"]).withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("doc_id"))).where("__n = 1")
    return kept.select(*documents.columns).unionByName(documents.where("doc_id is null"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
