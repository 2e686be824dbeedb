"""Benchmark decontamination by Wu-Manber multi-pattern search.

The benchmark's word windows are the patterns, written as bytes with one blank before, between and after
the words, so that a hit is aligned with words. Patterns are dealt into classes of similar length, since
Wu-Manber's shifts are bounded by the shortest pattern. For each class

* a shift table over hashed blocks of bytes says how far the window may move without missing a pattern,
* where the shift is zero, a hash of the block that ends the window and of the bytes that begin it name a
  bucket of patterns,
* direct comparison of the whole pattern confirms an occurrence.

Patterns are places in one buffer of the benchmark's words, and tables are arrays, so that
a block of 8 MB takes some 250 MB of a worker. The more patterns there are, the longer the blocks. The scan advances many windows (lanes) of a buffer at once with numpy;
every lane follows the shift table on its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrain.llm.common import column, slices, utf8

WINDOW = 13
#: Bytes of benchmark text in one broadcast block; a larger benchmark becomes several blocks, each with a pass over the texts.
BLOCK_BYTES = 8 << 20
_LANE, _PIECE = 1024, 1 << 20
#: Digits, a-z and all bytes of non-ASCII characters stay, A-Z become a-z, anything else is a blank.
_WORDS = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))

RESULT = "n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"


def words(text: bytes | None) -> list[bytes]:
    """The words of a text; none for null."""
    return (text or b"").translate(_WORDS).split()


def _loads(padded: np.ndarray) -> np.ndarray:
    """Eight bytes from every position of a buffer that ends with eight bytes of padding."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def _low(loads: np.ndarray, size: int) -> np.ndarray:
    """The first bytes of loads, eight at most."""
    return loads & np.uint64((1 << 8 * min(8, size)) - 1)


class WuManber:
    """Search for byte patterns of at least two bytes, given as sorted places in a buffer."""

    def __init__(self, text: bytes, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts.astype(np.int32), ends.astype(np.int32)
        self.m = m = int((ends - starts).min())
        # with many patterns most short blocks of a text are somewhere in them
        self.block = block = min(m, 6) if len(starts) < 50_000 else max(min(m, 6), min(16, m // 2))
        loads = _loads(padded)
        # which places begin a block of the first m bytes of any pattern
        cover = np.zeros(len(padded) + 1, np.int16)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + m - block + 1, -1)
        cover = np.cumsum(cover, dtype=np.int16) > 0
        self.down = np.uint64(64 - max(16, min(26, int(3 * np.count_nonzero(cover)).bit_length())))
        self.shift = np.full(1 << (64 - int(self.down)), min(255, m - block + 1), np.uint8)
        for low in range(0, len(cover), _PIECE):
            at = low + np.flatnonzero(cover[low : low + _PIECE])
            # the pattern that ends soonest after a block leaves the least shift
            soonest = starts[np.searchsorted(starts, at + block - m)]
            np.minimum.at(self.shift, self._hash(loads, at), np.minimum(255, soonest + m - at - block).astype(np.uint8))
        del cover
        keys = self._key(loads, starts)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]

    def _mixed(self, loads: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for the block at each place."""
        first = _low(loads[at], self.block)
        if self.block > 8:
            first = first ^ (_low(loads[at + 8], self.block - 8) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return first * np.uint64(0x9E3779B97F4A7C15)

    def _hash(self, loads: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self._mixed(loads, at) >> self.down).astype(np.int64)

    def _key(self, loads: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The bucket of a window: its last block and first bytes."""
        return _low(loads[start], self.m) * np.uint64(0xD6E8FEB86659FD93) ^ self._mixed(loads, start + self.m - self.block)

    def candidates(self, loads: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Starts of windows where no shift is possible."""
        end = np.arange(self.m - 1, n, _LANE)
        stop = np.minimum(end + _LANE, n)
        while len(end):
            s = self.shift[self._hash(loads, end - self.block + 1)]
            zero = s == 0
            if zero.any():
                yield end[zero] - self.m + 1
            end = end + np.maximum(s, 1)
            keep = end < stop
            if not keep.all():
                end, stop = end[keep], stop[keep]

    def search(self, text: bytes, padded: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        loads = _loads(padded)
        for starts in self.candidates(loads, len(text)):
            keys = self._key(loads, starts)
            first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for i in np.flatnonzero(last > first).tolist():
                s = int(starts[i])
                for p in self.order[first[i] : last[i]].tolist():
                    if text.startswith(self.text[self.starts[p] : self.ends[p]], s):
                        yield s, p


class Matcher:
    """All windows of a block of items, in classes of length."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int = WINDOW):
        names, parts, counts, numbers, number = [], [], [], [], {}
        for item_id, text in items:
            if w := words(text):
                names.append(item_id)
                parts.append(b" " + b" ".join(w) + b" ")
                counts.append(len(w))
                numbers.append(np.array([number.setdefault(x, len(number)) for x in w], np.int32))
        self.names, self.text = names, b"".join(parts)
        del parts, number
        padded = np.frombuffer(self.text + bytes(16), np.uint8)
        blanks = np.flatnonzero(padded == 32)
        n = np.array(counts, np.int64)
        # runs of window words; a shorter item is one window
        each = np.maximum(1, n - window + 1)
        item = np.repeat(np.arange(len(n)), each)
        place = np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
        first = (np.cumsum(n + 1) - n - 1)[item] + place
        size = np.minimum(n, window)[item]
        starts, ends = blanks[first], blanks[first + size] + 1
        # windows of equal bytes are one pattern, with the items of all
        words_ = np.concatenate([*numbers, np.zeros(window, np.int32)])
        same = self._same(starts, ends, words_, (np.cumsum(n) - n)[item] + place, size)
        del words_, numbers, place, first
        one, of = np.unique(same, return_inverse=True)
        by = np.lexsort((item, of))
        self.items, self.cuts = item[by].astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(one)))))
        self.sizes = size[one].astype(np.int32)
        starts, ends = starts[one], ends[one]
        kind = np.minimum(np.frexp(ends - starts)[1], 6)
        self.classes = []
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(starts[own], kind="stable")]
            self.classes.append((own.astype(np.int32), WuManber(self.text, padded, starts[own], ends[own])))

    def _same(self, starts: np.ndarray, ends: np.ndarray, words_: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each window the first one of the same bytes; only windows of equal hashes of their words' numbers are compared."""
        out = np.arange(len(starts))
        h = size.astype(np.uint64)
        for i in range(int(size.max(initial=0))):
            h = np.where(i < size, (h + words_[first + np.minimum(i, size - 1)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), h)
            h ^= h >> np.uint64(29)
        _, of, count = np.unique(h, return_inverse=True, return_counts=True)
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(count[of] > 1).tolist():
            out[i] = seen.setdefault(self.text[starts[i] : ends[i]], i)
        return out

    def hits(self, text: bytes, padded: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence of any pattern."""
        for own, c in self.classes:
            for s, p in c.search(text, padded):
                yield s, int(own[p])

    def found(self, pattern: int) -> list[str]:
        """Ids of items that have a pattern."""
        return [x for i in self.items[self.cuts[pattern] : self.cuts[pattern + 1]].tolist() if (x := self.names[i]) is not None]


def _search(texts: list[bytes | None], matcher: Matcher | None) -> list[tuple[int, list[int], list[int], list[str]]]:
    """(n_words, starts and ends of runs of hit words, items found) of each text."""
    split = [words(t) for t in texts]
    joined = [b" " + b" ".join(w) + b" " if w else b"" for w in split]
    text = b"".join(joined)
    counts = [len(w) for w in split]
    out: list[tuple[int, list[int], list[int], list[str]]] = [(n, [], [], []) for n in counts]
    if not text or matcher is None:
        return out
    padded = np.frombuffer(text + bytes(16), np.uint8)
    found = list(matcher.hits(text, padded))
    if not found:
        return out
    blanks = np.flatnonzero(padded[: len(text)] == 32)
    starts, patterns = np.array(found, np.int64).T
    word = np.searchsorted(blanks, starts)
    marks = np.zeros(len(blanks) + 1, np.int64)
    np.add.at(marks, word, 1)
    np.add.at(marks, word + matcher.sizes[patterns], -1)
    # a text's words begin at its first blank; hits never reach its last one
    hit = np.concatenate(([0], (np.cumsum(marks)[:-1] > 0).view(np.int8), [0]))
    begin, end = np.flatnonzero(np.diff(hit) > 0), np.flatnonzero(np.diff(hit) < 0)
    slots = np.cumsum([0, *(n + (n > 0) for n in counts)])
    of = np.searchsorted(slots, word, "right") - 1
    pairs = np.unique(np.column_stack((of, patterns)), axis=0)
    names: dict[int, set[str]] = defaultdict(set)
    for d, p in pairs.tolist():
        names[d].update(matcher.found(p))
    owner = np.searchsorted(slots, begin, "right") - 1
    for d in names:
        run = slice(*np.searchsorted(owner, [d, d + 1]).tolist())
        out[d] = (counts[d], (begin[run] - slots[d]).tolist(), (end[run] - slots[d]).tolist(), sorted(names[d]))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Lists of (item_id, text) of about block_bytes; only one of them is held here at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8()).where("text is not null").toLocalIterator():
        text = bytes(r["text"])
        block.append((r["item_id"], text))
        held += len(text)
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _hits(texts: DataFrame, block, window: int, *keep: str, every: bool) -> DataFrame:
    """keep columns, n_words, starts, ends, items of each text (binary column __text), or only of those with hits."""
    new = [("n_words", pa.int64(), "bigint"), ("starts", pa.list_(pa.int64()), "array<bigint>"), ("ends", pa.list_(pa.int64()), "array<bigint>"), ("found", pa.list_(pa.string()), "array<string>")]
    schema = texts.select(*keep, *(F.lit(None).cast(t).alias(n) for n, _, t in new)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the tables are made once in a worker, which keeps what was sent until another job's tasks come
        held = block.value
        if "matcher" not in held:
            held["matcher"] = Matcher(held.pop("items"), window) if held["items"] else None
        for whole in batches:
            for batch in slices(whole, "__text"):
                rows = _search(column(batch, "__text").to_pylist(), held["matcher"])
                made = [pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), new)]
                out = pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), *made], names=[*keep, *(n for n, *_ in new)])
                yield out if every else out.filter(pa.array([bool(r[1]) for r in rows]))

    return texts.mapInArrow(run, schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of documents and n_words, n_hit, n_items, items (ids, sorted as strings), contaminated.

    A text is contaminated if it has hit words and share * n_hit >= n_words. The benchmark is sent to the
    executors in blocks of a fixed size, and a worker holds one of them. With several blocks each has a pass over
    the texts, of which those with hits, one of equal ones, give their runs of hit words by the text's SHA-256.

    Cases: null and empty texts have no words and are clean; items of null or empty text have no windows; a
    null item_id is not among the items, though its hits count; repeated rows are judged each on its own; items
    of one id count once; an empty benchmark leaves all texts clean; a text's words are in memory at once.
    Columns of documents with the names of new ones are replaced.
    """
    new = [f.split(" ")[0] for f in RESULT.split(", ")]
    documents = documents.drop(*new)
    columns = documents.columns
    context = documents.sparkSession.sparkContext
    blocks = [context.broadcast({"items": b}) for b in _blocks(benchmark, block_bytes)] or [context.broadcast({"items": []})]
    texts = documents.withColumn("__text", F.col("text").cast("binary"))
    if len(blocks) == 1:
        rows = _hits(texts, blocks[0], window, *columns, every=True)
        hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
        rows = rows.withColumn("__hit", hit).withColumn("__found", F.col("found"))
    else:
        named = texts.select("__text", F.sha2("__text", 256).alias("key"))
        parts = [_hits(named, b, window, "key", every=False).dropDuplicates(["key"]) for b in blocks]
        union = parts[0]
        for p in parts[1:]:
            union = union.union(p)
        runs = union.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("__found"))
        # runs in order: what of each lies beyond all before
        state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        merged = F.aggregate("runs", state, lambda a, x: F.struct(F.greatest(a["end"], x["ends"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(a["end"], x["starts"]))).alias("n")))
        runs = runs.select("key", merged["n"].alias("__hit"), "__found")
        count = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
        rows = texts.withColumn("__key", F.sha2("__text", 256)).join(runs.withColumnRenamed("key", "__key"), "__key", "left").withColumn("n_words", count)
        rows = rows.withColumn("__hit", F.coalesce("__hit", F.lit(0).cast("long"))).withColumn("__found", F.coalesce("__found", F.array().cast("array<string>")))
    return rows.select(*columns, "n_words", F.col("__hit").alias("n_hit"), F.size("__found").cast("long").alias("n_items"), F.col("__found").alias("items"), ((F.col("__hit") > 0) & (F.col("__hit") * share >= F.col("n_words"))).alias("contaminated"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
