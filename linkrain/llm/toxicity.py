"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

A text is a vector of all of its words that an example has: (1 + log of the count) by the inverse document
frequency, counted over all documents, by a factor that grows with how well the word tells the examples'
labels apart (likelihood ratio) and is never zero. No word of an example is left out.

Postings of rare words are short and read at once. Those of the most frequent words lie in blocks of examples
(alike in commonest word and size) with the largest weight of each word and block. What frequent words can
still add to the examples of a block is bounded by these largest weights, and by the lengths of both frequent
parts. Blocks are opened from the highest bound on, for a group of texts at once; those in which no bound
reaches the kth sum are skipped. What is left is compared in full: neighbours and their cosines are exact.

Votes are weighted by distance, and by how many labelled rows an example stands for. Scores are calibrated
by isotonic regression on labelled rows that are set aside from the examples.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrain.llm.common import column, slices

#: Labelled rows of each label, about, that serve as examples or for calibration (all if there are fewer; chosen by hash of the id).
EXAMPLES = 1500
#: One of so many of them is set aside for calibration.
ASIDE = 5
NEIGHBOURS = 24
#: What every word's factor has at least, and the likelihood ratio from which on it grows.
_FLOOR, _CHANCE = 0.2, 8.0
_BLOCK = 128
#: Words with the longest lists, whose postings lie in blocks; texts that are searched together; more than sums of float32 are off.
_FREQUENT, _GROUP, _SLACK = 384, 64, 2e-5
_WORD = re.compile(r"\w+")

EVIDENCE = "array<struct<doc_id: bigint, similarity: double, toxic: double>>"


def terms(text: bytes | None) -> list[str]:
    """Lower-case words."""
    return _WORD.findall((text or b"").decode(errors="replace").lower())


def likelihood_ratio(n1: float, n0: float, a1: float, a0: float) -> float:
    """How far a word that n1 of a1 and n0 of a0 examples have depends on the label."""
    n, a = n0 + n1, a0 + a1
    cells = ((n0, n * a0 / a), (n1, n * a1 / a), (a0 - n0, (a - n) * a0 / a), (a1 - n1, (a - n) * a1 / a))
    return sum(2 * o * math.log(o / e) for o, e in cells if o > 0)


def factor(ratio: float) -> float:
    return _FLOOR + math.sqrt(max(0.0, ratio - _CHANCE))


class Index:
    """Example vectors by word and by example; postings of frequent words in blocks with largest weights."""

    def __init__(self, weight: dict[str, float], examples: list[tuple[int, int, dict[str, int]]], stands_for: tuple[float, float] = (1.0, 1.0), prior: float = 0.5, block: int = _BLOCK):
        """weight of each word; examples: (doc_id, label, counts of words); stands_for: labelled rows of an example of label 0 and 1."""
        self.words = sorted(weight)
        self.weight = np.array([weight[w] for w in self.words])
        self.prior, self.curve, self.block = prior, None, block
        self._prepare()
        vectors = [(doc_id, label, *self.vector(counts)) for doc_id, label, counts in examples]
        vectors = [v for v in vectors if len(v[2])]
        common = [int(v[2][np.argmax(v[3] / self.weight[v[2]])]) for v in vectors]
        vectors = [vectors[i] for i in sorted(range(len(vectors)), key=lambda i: (common[i], len(vectors[i][2]), vectors[i][0], vectors[i][1]))]
        n, size = len(vectors), len(self.words)
        self.ids = [v[0] for v in vectors]
        self.labels = np.array([v[1] for v in vectors], np.int64)
        self.stands = np.array([stands_for[v[1]] for v in vectors])
        # of equal cosines the one of the smallest id is the first
        self.tie = np.empty(n, np.int64)
        self.tie[sorted(range(n), key=lambda i: (self.ids[i], self.labels[i], i))] = np.arange(n)
        self.lengths = np.array([len(v[2]) for v in vectors], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.own = np.concatenate([v[2] for v in vectors]).astype(np.int32) if n else np.zeros(0, np.int32)
        self.own_weight = np.concatenate([v[3] for v in vectors]) if n else np.zeros(0)
        of = np.repeat(np.arange(n), self.lengths)
        # the words of the longest lists
        lists = np.bincount(self.own, minlength=size)
        frequent = np.sort(np.argsort(-lists, kind="stable")[:_FREQUENT])
        self.row = np.full(size, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        rare = self.row[self.own] < 0
        by = np.flatnonzero(rare)[np.argsort(self.own[rare], kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self.own[by], minlength=size)))).astype(np.int32)
        self.posts, self.post_weight = of[by].astype(np.int32), self.own_weight[by]
        self.blocks = -(-n // block)
        self.block_of = np.arange(n) // block
        #: of each block the weights of frequent words by example
        self.dense = np.zeros((self.blocks, len(frequent), block), np.float32)
        self.dense[self.block_of[of[~rare]], self.row[self.own[~rare]], of[~rare] % block] = self.own_weight[~rare]
        #: the largest weight of each frequent word in each block, and the lengths of the vectors' frequent parts
        self.most = np.ascontiguousarray(self.dense.max(axis=2).T) if n else np.zeros((len(frequent), 0), np.float32)
        self.part = np.sqrt(np.bincount(of[~rare], self.own_weight[~rare] ** 2, n)).astype(np.float32)
        #: blocks opened for a group of texts, and all
        self.opened = [0, 0]

    def _prepare(self) -> None:
        self.number = {w: i for i, w in enumerate(self.words)}
        self.query = np.zeros(len(self.words))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "query")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known words and their weights, of unit length."""
        get = self.number.get
        ids = np.array([get(w, -1) for w in counts], np.int64)
        n = np.fromiter(counts.values(), float, len(counts))
        n, ids = n[ids >= 0], ids[ids >= 0]
        by = np.argsort(ids)
        ids = ids[by]
        raw = (1 + np.log(n[by])) * self.weight[ids]
        return ids, raw / math.sqrt((raw * raw).sum()) if len(ids) else raw

    def _cosines(self, rows: np.ndarray) -> np.ndarray:
        """Of examples with self.query, to nine places; sums are in the order of the example's words, so equal vectors have equal ones."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends, lengths)
        return np.round(np.add.reduceat(self.query[self.own[at]] * self.own_weight[at], ends - lengths), 9)

    def nearest(self, texts: list[dict[str, int]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """The k (cosine, example) of each text's highest cosines, of equal ones those of the smallest ids; cosine 0 is no neighbour."""
        out: list[list[tuple[float, int]]] = [[] for _ in texts]
        n = len(self.ids)
        vectors = [self.vector(t) for t in texts]
        there = [i for i, (ids, _) in enumerate(vectors) if len(ids) and n]
        if not there:
            return out
        query = np.zeros((len(there), len(self.most)), np.float32)
        for at, i in enumerate(there):
            ids, q = vectors[i]
            row = self.row[ids]
            query[at, row[row >= 0]] = q[row >= 0]
        bounds = query @ self.most
        # texts of like blocks together
        by = np.argsort(bounds.argmax(axis=1), kind="stable")
        for start in range(0, len(by), _GROUP):
            some = by[start : start + _GROUP]
            self._group([there[i] for i in some.tolist()], vectors, query[some], bounds[some], k, out)
        return out

    def _group(self, texts: list[int], vectors: list, query: np.ndarray, bounds: np.ndarray, k: int, out: list) -> None:
        n, cuts = len(self.ids), np.arange(0, len(self.ids), self.block)
        rare = np.zeros((len(texts), n))
        for at, i in enumerate(texts):
            ids, q = vectors[i]
            first, sizes = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
            places = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            if len(places):
                rare[at] = np.bincount(self.posts[places], self.post_weight[places] * np.repeat(q, sizes), n)
        # what the frequent words can add: their largest weights in the block, or both parts' lengths
        length = np.sqrt((query * query).sum(axis=1, keepdims=True))
        most = np.maximum.reduceat(rare + np.minimum(bounds[:, self.block_of], length * self.part), cuts, axis=1) + _SLACK
        order = np.argsort(-most.max(axis=0), kind="stable")
        half = max(-(-len(order) // 4), -(-2 * k // self.block))
        sums, kth = np.zeros((len(texts), n)), np.zeros((len(texts), 1))
        for blocks in (order[:half], order[half:]):
            for b in blocks.tolist():
                if (most[:, b : b + 1] >= kth).any():
                    at = slice(b * self.block, min(n, (b + 1) * self.block))
                    sums[:, at] = rare[:, at] + (query @ self.dense[b])[:, : at.stop - at.start]
                    self.opened[0] += 1
            kth = np.partition(sums, n - k, axis=1)[:, n - k : n - k + 1] if n > k else kth
        self.opened[1] += len(order)
        for i, s, least in zip(texts, sums, kth[:, 0].tolist()):
            ids, q = vectors[i]
            alive = np.flatnonzero((s >= least - _SLACK) & (s > 0))
            if len(alive):
                self.query[ids] = q
                found = zip(self._cosines(alive).tolist(), self.tie[alive].tolist(), alive.tolist())
                self.query[ids] = 0
                out[i] = [(x, e) for x, _, e in sorted(found, key=lambda f: (-f[0], f[1]))[:k]]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of the neighbours' votes for label 1, weighted by nearness."""
        votes = [0.05 * (1 - self.prior), 0.05 * self.prior]
        for s, i in near:
            votes[self.labels[i]] += self.stands[i] * s / (1.02 - s)
        return votes[1] / (votes[0] + votes[1])

    def calibrate(self, aside: list[tuple[int, int, dict[str, int]]], stands_for: tuple[float, float] = (1.0, 1.0)) -> None:
        """Isotonic regression (pooled adjacent violators) of labels on votes of rows that are no examples."""
        by: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for (_, label, _), near in zip(aside, self.nearest([e[2] for e in aside])):
            if near:
                vote = self.vote(near)
                by[vote][0] += label * stands_for[label]
                by[vote][1] += stands_for[label]
        pools: list[list[float]] = []  # sum of labels, weight, sum of votes
        for v in sorted(by):
            pools.append([by[v][0], by[v][1], v * by[v][1]])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        if pools:
            self.curve = (np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools]))

    def scores(self, texts: list[dict[str, int]]) -> list[tuple[float, list[tuple[float, int]]]]:
        """(score, neighbours) of each text."""
        found = self.nearest(texts)
        votes = [self.vote(near) for near in found]
        if self.curve:
            votes = np.interp(votes, *self.curve).tolist()
        return [(v if near else self.prior, near) for v, near in zip(votes, found)]


def learn(documents: DataFrame, labels: DataFrame, rows: int = EXAMPLES) -> Index:
    """The index of about rows labelled documents of each label; words' frequencies are counted over all documents.

    Rows held out (crc32 of the id leaves 1 by 3) are not learned from; nor are labels other than 0 and 1. An
    id with both labels counts as toxic. What comes to the driver is bounded by the words of the examples.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    there = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, rows / max(1, there.get(1, 0)))).otherwise(min(1.0, rows / max(1, there.get(0, 0))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # about 2 * rows ids of eight bytes
    chosen = known.where(place < share)
    found = documents.select("doc_id", F.col("text").cast("binary").alias("__text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "__text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms(x)) for x in column(batch, "__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[*c] for c in counts], pa.list_(pa.string())), pa.array([[*c.values()] for c in counts], pa.list_(pa.int32()))], names=["doc_id", "label", "terms", "counts"])

    own = found.mapInArrow(counted, "doc_id long, label int, terms array<string>, counts array<int>").toArrow().to_pylist()
    own = [(r["doc_id"], r["label"], dict(zip(r["terms"], r["counts"]))) for r in own]
    # in an order that tells nothing about the label, so what is set aside is a sample
    own.sort(key=lambda e: (e[0] * 0x9E3779B97F4A7C15 % (1 << 64), e[1], sorted(e[2].items())))
    aside = {id(e) for label in (0, 1) for e in [x for x in own if x[1] == label][ASIDE - 1 :: ASIDE]}
    examples, aside = [e for e in own if id(e) not in aside], [e for e in own if id(e) in aside]
    with_word: tuple[Counter, Counter] = (Counter(), Counter())
    for _, label, counts in examples:
        with_word[label].update(counts.keys())
    vocabulary = sorted({*with_word[0], *with_word[1]})
    words = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(words.value)}
        seen, rows_ = np.zeros(len(number) + 1, np.int64), 0
        for whole in batches:
            for batch in slices(whole, "__text"):
                held: list[int] = []
                for text in column(batch, "__text").to_pylist():
                    held += [number[w] for w in number.keys() & terms(text)]
                    rows_ += 1
                seen += np.bincount(np.array(held, np.int64), minlength=len(seen))
        seen[-1] = rows_
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["word", "n"])

    # a task sends a number for each word of the examples at most
    sums = documents.select(F.col("text").cast("binary").alias("__text")).mapInArrow(frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    words.unpersist()
    n = [sum(e[1] == label for e in examples) for label in (0, 1)]
    both = n[0] > 0 and n[1] > 0
    weight = {w: math.log((1 + df[-1]) / max(1, f)) * factor(likelihood_ratio(with_word[1][w], with_word[0][w], n[1], n[0]) if both else 0.0) for w, f in zip(vocabulary, df.tolist())}
    total = there.get(0, 0) + there.get(1, 0)
    stands = tuple(there.get(label, 0) / max(1, sum(e[1] == label for e in own)) for label in (0, 1))
    index = Index(weight, examples, stands, (there.get(1, 0) + 1) / (total + 2))
    if both:
        index.calibrate(aside, stands)
    return index


def score(documents: DataFrame, index: Index, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, evidence (up to three nearest examples) of every row of documents.

    Cases: a null or empty text, or one without a word of any example, has the smoothed share of label 1 and
    no evidence; without examples all scores are 0.5; of equal cosines the smaller ids are nearer; repeated
    rows are scored each; a text of any length is one vector, whose words are in memory once; other columns
    of documents are not read, whatever their names.
    """
    kept = documents.select("doc_id", F.col("text").cast("binary").alias("__text"))
    schema = kept.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast(EVIDENCE).alias("evidence")).schema
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.float64())]))
    # dumped by value, as executors may have no copy of this package; a worker reads it once
    sent = documents.sparkSession.sparkContext.broadcast({"dump": cloudpickle.dumps(index)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        if "index" not in held:
            held["index"] = cloudpickle.loads(held.pop("dump"))
        index = held["index"]
        for whole in batches:
            for batch in slices(whole, "__text"):
                out = []
                for s, near in index.scores([Counter(terms(text)) for text in column(batch, "__text").to_pylist()]):
                    out.append((s, int(s >= threshold), [{"doc_id": index.ids[i], "similarity": x, "toxic": float(index.labels[i])} for x, i in near[:3]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], kind)], names=schema.names)

    return kept.mapInArrow(run, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    documents = table(spark, sf_dir, "documents")
    out = score(documents, learn(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").alias("held_out"), "score", "predicted", "evidence")
