"""Suffix-array dedup: bytes covered by a string of fixed length that also starts earlier are removed.

Suffixes are dealt out so that equal strings of the length meet. Each string of length L owns the smallest
k-gram hash in it (the leftmost of equal ones), its anchor; a run of strings with one anchor has one context,
the bytes they cover. Only anchors whose hash occurs twice can hold a repetition:

1. anchors of all texts go to buckets by hash; those seen once end here,
2. the others ask the texts for their contexts; of equal contexts only the earliest goes on, and all strings
   of the later ones are repetitions,
3. distinct contexts meet by hash again; where there are several, their suffix array is built by two-stage
   sorting, and strings whose adjacent common prefix reaches L are equal,
4. spans are gathered by text and cut out.

Two-stage sorting directly sorts only the suffixes that are smaller than their successors; the others are
induced by scanning the buckets of first bytes from the smallest on.

What is sent between the steps is packed, many anchors to a row. Anchors that occur very often are found first:
those that many places of some pack of texts have, and by sums too many in all. Their places go straight to the
texts, not to a common bucket, and of their contexts, once equal ones of a text bucket are one, the strings are
sent one by one by their own hashes, so that no bucket holds all contexts of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrain.llm.common import column

LENGTH = 100
GRAM = 50
#: Bytes of text for which there is one bucket.
BUCKET_BYTES = 8 << 20
#: Occurrences of an anchor beyond which its strings are sent one by one; more in a very large corpus, so that the list of
#: such anchors, which is broadcast, has at most some five million (40 MB).
HOT, _LISTED = 2000, 1 << 27
#: Occurrences in a pack from which on an anchor is counted for that list.
_OFTEN = 16
_CHUNK, _PACK = 1 << 19, 8 << 20
#: Buckets up to which keys are chosen.
_EVEN = 50_000
_LAST = (1 << 63) - 1


# --- suffix array


def loads(padded: np.ndarray, order: str = "<") -> np.ndarray:
    """Eight bytes from every position of a buffer that ends with eight bytes of padding."""
    return np.ndarray((len(padded) - 7,), order + "u8", padded, strides=(1,))


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later (the last one is not)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def sort_directly(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the depth bytes from there, eight at a time and only where all before are equal."""
    words = loads(padded, ">")
    last = len(words) - 1
    order, group = at, np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    for d in range(0, depth, 8):
        if not len(active):
            break
        key = words[np.minimum(order[active] + d, last)].astype(np.uint64)
        key[order[active] + d > last] = 0
        by = np.lexsort((key, group[active]))
        key, own = key[by], group[active]
        order[active] = order[active][by]
        new = np.ones(len(active), bool)
        new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        alone = new & np.concatenate((new[1:], [True]))
        active = active[~alone]
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All positions, ordered by at least the depth bytes of their suffixes, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    small = smaller_than_successor(text)
    direct = sort_directly(padded, np.flatnonzero(small), depth)
    counts = np.bincount(text, minlength=256)
    large = np.bincount(text[~small], minlength=256)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.empty(n, np.int64)
    byte = text[direct]
    cuts = np.searchsorted(byte, np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not small[n - 1]:
        queues[text[n - 1]].append(np.array([n - 1]))
    for c in np.flatnonzero(counts).tolist():
        at = starts[c]
        out[at + large[c] : ends[c]] = direct[cuts[c] : cuts[c + 1]]
        part = np.concatenate(queues[c]) if queues[c] else np.zeros(0, np.int64)
        while len(part):  # runs of one byte are placed a byte further each time
            out[at : at + len(part)] = part
            at += len(part)
            part = part[part > 0] - 1
            part = part[text[part] == c]
        before = out[starts[c] : ends[c]]
        before = before[before > 0] - 1
        before = before[~small[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            before = before[np.argsort(byte, kind="stable")]
            for b, run in zip(np.unique(byte).tolist(), np.split(before, np.cumsum(np.unique(byte, return_counts=True)[1])[:-1])):
                queues[b].append(run)
    return out


def common_prefixes(padded: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Equal bytes from positions a and b on, most at most, all within the buffer."""
    words = loads(padded)
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for d in range(0, most, 8):
        x = words[np.minimum(a[active] + d, len(words) - 1)] ^ words[np.minimum(b[active] + d, len(words) - 1)]
        out[active] = d + np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
        active = active[x == 0]
    return np.minimum(out, most)


# --- anchors


class Grams:
    """Hashes of all k-grams of a buffer, by sums of powers."""

    def __init__(self, k: int = GRAM):
        self.k = k
        self.table = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self._powers(_CHUNK)

    def _powers(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15
        self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))
        self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), np.uint64))))

    def hashes(self, text: np.ndarray) -> np.ndarray:
        n = len(text)
        if n >= len(self.up):
            self._powers(n)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.table[text] * self.up[:n])))
        h = (sums[self.k :] - sums[: -self.k]) * self.down[: n - self.k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    def anchors(self, texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
        """(text number, anchor hash, first string's start, number of further strings) of every run of strings."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"".join(texts), np.uint8)
        if len(text) < length:
            return none
        h = self.hashes(text)
        bits = np.uint64(max(24, int(len(text)).bit_length()))
        low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
        wide, w = 1, length - self.k + 1
        while 2 * wide <= w:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if w > wide:
            low = np.minimum(low[: len(low) - (w - wide)], low[w - wide :])
        owner = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        starts = np.arange(len(owner))
        of = np.searchsorted(ends, starts, "right")
        fits = starts + length <= ends[of]
        starts, owner, of = starts[fits], owner[fits], of[fits]
        if not len(starts):
            return none
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        more = np.diff(np.concatenate((first, [len(starts)]))) - 1
        return of[first], h[owner[first]], starts[first] - (ends - sizes)[of[first]], more


# --- packed rows


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length in one compressed string."""
    n = len(next(iter(arrays.values())))
    return zstandard.compress(np.int64(n).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()), 1)


def unpack(data: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    """The arrays and what follows them."""
    data = zstandard.decompress(data)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += out[-1].nbytes
    return out, data[at:]


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices in their order)."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


_ROW = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_ROW_SQL = "bucket int, data binary"


def _rows(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_ROW)


def _place(did: np.ndarray, th: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a text: a hash of its id and its own hash."""
    x = did.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ th.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def even_labels(spark: SparkSession, n: int) -> np.ndarray:
    """Keys of n buckets that Spark's hash deals evenly to its shuffle partitions; of very many buckets their numbers, which come even."""
    if n > _EVEN:
        return np.arange(n, dtype=np.int64)
    conf = spark.conf
    parts = int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions"))
    each = -(-n // parts)
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    # a few times as many numbers as buckets are tried
    tried = np.array([r[0] for r in spark.range((each + 8) * parts * 4).select(at).collect()])
    order = np.argsort(tried, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(tried[order], tried[order])
    # the first of every partition, then the second, and so on
    return order[np.lexsort((tried[order], place))][:n]


def _joined(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    parts = [unpack(b, *kinds)[0] for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def _spans(first: np.ndarray, repeated: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Covered spans of a run of strings that starts at first, given which of them are repetitions."""
    at = np.flatnonzero(repeated)
    if len(at):
        cuts = np.flatnonzero(np.diff(at) > length)
        for a, b in zip(at[np.concatenate(([0], cuts + 1))].tolist(), at[np.concatenate((cuts, [len(at) - 1]))].tolist()):
            yield first + a, first + b + length


def repeated_starts(contexts: list[bytes], order: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its strings also start in a context of smaller order, or earlier in itself."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(contexts)), sizes)
    inside = np.arange(len(text)) - (ends - sizes)[of]
    starts = inside + length <= sizes[of]
    sa = suffix_array(text, length)
    sa = sa[starts[sa]]
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    same = common_prefixes(padded, sa[:-1], sa[1:], length) >= length
    group = np.concatenate(([0], np.cumsum(~same)))
    rank = np.asarray(order, np.int64)[of[sa]] * (1 << 32) + inside[sa]
    low = np.minimum.reduceat(rank, np.flatnonzero(np.concatenate(([True], ~same))))
    flag = np.zeros(len(text), bool)
    flag[sa[rank > low[group]]] = True
    return [flag[e - s : e - length + 1] for e, s in zip(ends.tolist(), sizes.tolist())]


def _packs(batches: Iterator[pa.RecordBatch], grams: Grams, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, did, th, start, further strings) of all runs, for some texts at a time."""
    held, size, packed, total = [], 0, [], 0

    def meet():
        of, h, lo, more = grams.anchors([x[3] for x in held], length)
        did, th, base = (np.array([x[i] for x in held], np.int64) for i in (0, 1, 2))
        packed.append((h, did[of], th[of], (lo + base[of]).astype(np.uint32), more.astype(np.uint8)))

    for batch in batches:
        for did, th, text in zip(*(c.to_pylist() for c in batch.columns)):
            # a longer text comes in pieces that share length - 1 bytes, so that each string is in one of them
            for base in range(0, len(text) - length + 1, _CHUNK):
                held.append((did, th, base, text[base : base + _CHUNK + length - 1]))
                size += len(held[-1][3])
                if size >= _CHUNK:
                    meet()
                    total += size
                    held, size = [], 0
                if total >= _PACK:
                    yield tuple(np.concatenate(x) for x in zip(*packed))
                    packed.clear()
                    total = 0
    if held:
        meet()
    if packed:
        yield tuple(np.concatenate(x) for x in zip(*packed))


def often_anchors(texts: DataFrame, length: int, gram: int, hot: int, often: int = _OFTEN) -> np.ndarray:
    """Sorted anchors of more than hot places in packs that have often or more of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, *_ in _packs(batches, Grams(gram), length):
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n >= often].view(np.int64)), pa.array(n[n >= often])], names=["h", "n"])

    sums = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    return np.sort(sums.select("h").toArrow().column("h").to_numpy().view(np.uint64))


def spans_of_repeats(documents: DataFrame, placed: DataFrame, length: int, gram: int, labels: np.ndarray, hot: int, often: int) -> DataFrame:
    """Packed spans by text bucket, from rows (did, th, text as binary) and the same with compressed text and its bucket."""
    texts = documents.select("did", "th", "text")
    buckets = len(labels)
    known = documents.sparkSession.sparkContext.broadcast(often_anchors(texts, length, gram, hot, often))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hots = np.append(known.value, np.uint64(0))
        for h, did, th, lo, more in _packs(batches, Grams(gram), length):
            is_hot = hots[np.searchsorted(hots[:-1], h)] == h if len(hots) > 1 else np.zeros(len(h), bool)
            rows = []
            for b, i in _dealt(np.where(is_hot, -1 - labels[_place(did, th, buckets)], labels[(h % np.uint64(buckets)).astype(np.int64)])):
                if b < 0:  # known already: negative buckets pass the next step as they are
                    rows.append((b, pack(did=did[i], th=th[i], lo=lo[i], more=more[i], h=h[i], hot=np.ones(len(i), np.uint8))))
                else:
                    rows.append((b, pack(h=h[i], did=did[i], th=th[i], lo=lo[i], more=more[i])))
            yield from _rows(rows).to_batches()

    def requests(key, group):
        bucket = int(key[0].as_py())
        if bucket < 0:
            return _rows([(-1 - bucket, b) for b in group.column("data").to_pylist()])
        h, did, th, lo, more = _joined(group.column("data").to_pylist(), "<u8", "<i8", "<i8", "<u4", "<u1")
        order = np.argsort(h, kind="stable")
        own = h[order]
        new = np.concatenate(([True], own[1:] != own[:-1]))
        counts = np.diff(np.concatenate((np.flatnonzero(new), [len(own)])))
        often = np.repeat(counts, counts)
        order, often = order[often > 1], often[often > 1] > hot
        did, th, lo = did[order], th[order], lo[order]
        rows = []
        for b, i in _dealt(labels[_place(did, th, buckets)]):
            i = i[np.lexsort((lo[i], th[i], did[i]))]
            j = order[i]
            rows.append((b, pack(did=did[i], th=th[i], lo=lo[i], more=more[j], h=h[j], hot=often[i].astype(np.uint8))))
        return _rows(rows)

    def contexts(key, docs, asked):
        did, th, lo, more, h, often = _joined(asked.column("data").to_pylist(), "<i8", "<i8", "<u4", "<u1", "<u8", "<u1")
        by = np.lexsort((lo, th, did))
        once = np.ones(len(by), bool)  # rows equal in id and text ask for the same
        once[1:] = (did[by[1:]] != did[by[:-1]]) | (th[by[1:]] != th[by[:-1]]) | (lo[by[1:]] != lo[by[:-1]])
        did, th, lo, more, h, often = (x[by[once]] for x in (did, th, lo, more, h, often))
        text_of = dict(zip(zip(docs.column("did").to_pylist(), docs.column("th").to_pylist()), map(zstandard.decompress, docs.column("text").to_pylist())))
        seen: set[bytes] = set()
        out, done = [], []
        for row in zip(did.tolist(), th.tolist(), lo.tolist(), more.tolist(), h.tolist(), often.tolist()):
            d, t, a, m, x, one = row
            c = text_of[d, t][a : a + m + length]
            if c in seen:
                done.append((d, t, a, a + m + length))
                continue
            seen.add(c)
            if one:
                out += [(d, t, a + i, 0, xxhash.xxh64_intdigest(w), w) for i in range(m + 1) for w in (c[i : i + length],)]
            else:
                out.append((d, t, a, m, x, c))
        rows = []
        if out:
            d, t, a, m, x, c = zip(*out)
            d, t, a, m, x = np.array(d, "<i8"), np.array(t, "<i8"), np.array(a, "<u4"), np.array(m, "<u1"), np.array(x, "<u8")
            for b, i in _dealt(labels[(x % np.uint64(buckets)).astype(np.int64)]):
                body = np.int64(len(i)).tobytes() + b"".join(y[i].tobytes() for y in (d, t, a, m, x)) + b"".join([c[j] for j in i.tolist()])
                rows.append((b, zstandard.compress(body, 1)))
        if done:  # found already: negative buckets pass the next step as they are
            d, t, a, e = (np.array(y, k) for y, k in zip(zip(*done), ("<i8", "<i8", "<u4", "<u4")))
            rows.append((-1 - int(key[0].as_py()), pack(did=d, th=t, a=a, e=e)))
        return _rows(rows)

    def found(key, group):
        bucket = int(key[0].as_py())
        if bucket < 0:
            return _rows([(-1 - bucket, b) for b in group.column("data").to_pylist()])
        cols, bodies = [], []
        for data in group.column("data").to_pylist():
            arrays, body = unpack(data, "<i8", "<i8", "<u4", "<u1", "<u8")
            cuts = np.concatenate(([0], np.cumsum(arrays[3].astype(np.int64) + length))).tolist()
            cols.append(arrays)
            bodies += [body[a:b] for a, b in zip(cuts, cuts[1:])]
        did, th, lo, more, h = (np.concatenate([c[i] for c in cols]) for i in range(5))
        seen: set[bytes] = set()
        spans, first = [], []
        for i in np.lexsort((lo, th, did)).tolist():
            if bodies[i] in seen:
                spans.append((i, int(lo[i]), int(lo[i]) + len(bodies[i])))
            else:
                seen.add(bodies[i])
                first.append(i)
        del seen
        first = np.array(first, np.int64)  # in order of texts and places
        rank = np.empty(len(bodies), np.int64)
        rank[first] = np.arange(len(first))
        by = first[np.argsort(h[first], kind="stable")]
        own = h[by]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        chunk, size = [], 0
        groups = [g for g in np.split(by, cuts) if len(g) > 1]
        for k, g in enumerate(groups):
            chunk += g.tolist()
            size += sum(len(bodies[i]) for i in g.tolist())
            if size > 2 << 20 or k == len(groups) - 1:
                for i, flags in zip(chunk, repeated_starts([bodies[i] for i in chunk], rank[chunk].tolist(), length)):
                    spans += [(i, a, e) for a, e in _spans(int(lo[i]), flags, length)]
                chunk, size = [], 0
        if not spans:
            return _rows([])
        i, a, e = (np.array(x, np.int64) for x in zip(*spans))
        d, t = did[i], th[i]
        a, e = a.astype("<u4"), e.astype("<u4")
        return _rows([(b, pack(did=d[j], th=t[j], a=a[j], e=e[j])) for b, j in _dealt(labels[_place(d, t, buckets)])])

    asked = texts.mapInArrow(anchors, _ROW_SQL).groupBy("bucket").applyInArrow(requests, _ROW_SQL)
    sent = placed.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(contexts, _ROW_SQL)
    return sent.groupBy("bucket").applyInArrow(found, _ROW_SQL)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    if not spans:
        return text, 0, 0
    kept, end, runs = [], 0, 0
    for a, b in sorted(spans):
        if a > end or not runs:
            kept.append(text[end:a])
            runs += 1
        end = max(end, b)
    kept.append(text[end:])
    left = b"".join(kept)
    return left, len(text) - len(left), runs


def remove_repeats(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, often: int = _OFTEN) -> DataFrame:
    """keep columns, n_bytes, n_removed, n_spans, kept (binary) of every row of documents.

    A byte goes if a string of length bytes over it also starts earlier: in a text of smaller doc_id, or
    earlier in the same. Strings are judged on the input.

    Cases: a null text is an empty one; texts shorter than length lose nothing; texts of one id come by their
    hashes; of rows equal in id and text one is the first; null ids come last; an empty table gives none;
    columns outside of keep are not read, and keep columns may have any names but those of the results.
    """
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(24, -(-size // bucket_bytes))
    labels = even_labels(documents.sparkSession, buckets)
    keyed = documents.select(F.struct(*keep).alias("row"), F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("did"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # texts' hashes tell rows of one id apart; they are not sent where all ids differ
    repeated = not keyed.groupBy("did").count().where("count > 1").isEmpty()
    keyed = keyed.withColumn("th", F.xxhash64("text") if repeated else F.lit(0).cast("long"))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = labels[_place(column(b, "did").to_numpy(), column(b, "th").to_numpy(), buckets)]
            packed = [zstandard.compress(t, 1) for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary()), b.column(3), pa.array(place, pa.int32())], names=["row", "did", "text", "th", "bucket"])

    placed = keyed.mapInArrow(bucketed, keyed.withColumn("bucket", F.lit(0)).schema)
    spans = spans_of_repeats(keyed, placed, length, gram, labels, max(hot, size // _LISTED), often)

    def cut_out(key, docs, found):
        did, th, a, e = _joined(found.column("data").to_pylist(), "<i8", "<i8", "<u4", "<u4")
        of: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, t, x, y in zip(did.tolist(), th.tolist(), a.tolist(), e.tolist()):
            of.setdefault((d, t), []).append((x, y))
        seen: set[tuple[int, int]] = set()
        rows = []
        for d, t, z in zip(*(docs.column(c).to_pylist() for c in ("did", "th", "text"))):
            text = zstandard.decompress(z)
            again = (d, t) in seen and len(text) >= length
            seen.add((d, t))
            left, gone, runs = cut(text, [(0, len(text))] if again else of.get((d, t), []))
            rows.append((len(text), gone, runs, left))
        kinds = [pa.int64()] * 3 + [pa.binary()]
        new = [pa.array(c, k) for c, k in zip([*zip(*rows)] or [[]] * 4, kinds)]
        return pa.table([docs.column("row").combine_chunks(), *new], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = keyed.select("row", *(F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.lit(b"").alias("kept")).schema
    out = placed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(cut_out, schema)
    return out.select("row.*", "n_bytes", "n_removed", "n_spans", "kept")


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
