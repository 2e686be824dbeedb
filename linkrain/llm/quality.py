"""Quality classifier by co-training: two views of a document teach each other.

The text view counts what the text is made of and hashes its words; the metadata view sees source, language,
length and the shape of lines. Each is a logistic regression. In every round each view labels all documents
that are not among the labelled training rows, and those it is sure of become training rows of the other, of
each label together a fifth as heavy as the labelled rows of that label. The other view then takes a step by the
gradient and a bound of the curvature, which cannot overshoot; both are summed over all partitions. In the
end each view is calibrated on labelled rows that were set aside, the calibrated views are combined by a logistic regression on their
logits, and all documents are scored.

Features of all documents are computed once and written to the shared folder, from which rounds and scores
are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrain.llm.common import column, slices, stored

#: Labelled rows, about, that are trained on (all if there are fewer; chosen by hash of the id).
LABELLED = 6000
#: Rounds, the least share at which a view is sure, and the weight of what it teaches by that of the labelled rows.
ROUNDS, SURE, HEAVY = 3, 0.9, 0.2
HASHED = 256
_SIZES = (12 + HASHED, 8 + 64 + 16)
_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")


def text_features(text: str) -> np.ndarray:
    """Composition of a text and its words hashed, in shares."""
    out = np.zeros(12 + HASHED)
    words = _WORD.findall(text)
    n, m = len(text), len(words)
    if not n:
        return out
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, m) if m else np.zeros(1)
    upper = sum(map(str.isupper, words))
    out[:12] = (
        len(_SYMBOL.findall(text)) / n * 10,
        text.count("|") / n * 20,
        (text.count("!") + text.count("?")) / n * 20,
        (text.count(".") + text.count(",")) / n * 10,
        upper / max(1, m),
        sum(map(str.isdigit, text)) / n * 5,
        len(counts) / max(1, m),
        max(counts.values(), default=0) / max(1, m),
        lengths.mean() / 10,
        lengths.std() / 10,
        sum(c * c for c in counts.values()) / max(1, m * m) * 10,
        min(m, 200) / 200,
    )
    for w, c in counts.items():
        out[12 + zlib.crc32(w.lower().encode()) % HASHED] += c / m * 5
    return out


def meta_features(source: str | None, lang: str | None, text: str) -> np.ndarray:
    """Source and language hashed, length, and the shape of lines."""
    out = np.zeros(8 + 64 + 16)
    lines = text.split("\n")
    sizes = np.fromiter(map(len, lines), float, len(lines))
    counts = Counter(lines)
    out[:8] = (
        np.log1p(len(text)) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(sizes.mean()) / 8,
        np.log1p(sizes.std()) / 8,
        1 - len(counts) / len(lines),
        max(counts.values()) / len(lines),
        (sizes == 0).mean(),
        sum(n * len(x) for x, n in counts.items() if n > 1) / max(1, len(text)),
    )
    out[8 + zlib.crc32((source or "").encode()) % 64] = 1
    out[72 + zlib.crc32((lang or "").encode()) % 16] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression with a bias (last weight) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def shares(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    """Weights of both views, slope and bias that calibrate each one's logits, and their combination (text, metadata, bias)."""

    views: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]
    both: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of good quality: together, by text, by metadata; all are calibrated."""
        a, b = (np.clip(logits(x, w) * c[0] + c[1], -30, 30) for x, w, c in zip((text, meta), self.views, self.calibration))
        return shares(a * self.both[0] + b * self.both[1] + self.both[2]), shares(a), shares(b)


#: For a learner (0: text) and a label: rows, gradient and bound of the curvature of the logistic loss.
Sums = dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]


def taught(views: tuple[np.ndarray, np.ndarray], weights: tuple[np.ndarray, np.ndarray], sure: float) -> Sums:
    """The sums over rows that one view is sure of, at the weights of the other."""
    out = {}
    for learner in (0, 1):
        p = shares(logits(views[1 - learner], weights[1 - learner]))
        x, own = views[learner], shares(logits(views[learner], weights[learner]))
        x = np.hstack([x, np.ones((len(x), 1))])
        for label, by in ((0, 1 - p), (1, p)):
            at = by >= sure
            q = own[at]
            out[learner, label] = float(at.sum()), x[at].T @ (q - label), x[at].T @ x[at] / 4
    return out


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Callable[[tuple[np.ndarray, np.ndarray]], Sums], rounds: int = ROUNDS) -> Model:
    """views: text and metadata features of labelled rows (in a fixed order), pool: taught() of all other rows at some weights."""
    if not len(y) or y.min() == y.max():
        known = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        return Model(tuple(np.zeros(n + 1) for n in _SIZES), (np.array([1.0, 0.0]),) * 2, np.array([0.0, 0.0, known]))
    aside = np.arange(len(y)) % 5 == 4
    labelled, t = [np.hstack([v[~aside], np.ones((int((~aside).sum()), 1))]) for v in views], y[~aside]
    weights = [fit(v[~aside], t) for v in views]
    for _ in range(rounds):
        sums = pool((weights[0], weights[1]))
        for learner in (0, 1):
            x, w = labelled[learner], weights[learner]
            ridge = np.full(len(w), 1.0)
            ridge[-1] = 1e-3
            p = shares(np.clip(x @ w, -30, 30))
            grad, curve = x.T @ (p - t) + ridge * w, x.T @ x / 4 + np.diag(ridge)
            for label in (0, 1):
                rows, g, h = sums[learner, label]
                if rows:
                    by = HEAVY * (t == label).sum() / rows
                    grad, curve = grad + g * by, curve + h * by
            weights[learner] = w - np.linalg.solve(curve, grad)
    mixed = aside.any() and 0 < y[aside].mean() < 1
    calibration = tuple(fit(logits(v[aside], w)[:, None], y[aside], 0.01) if mixed else np.array([1.0, 0.0]) for v, w in zip(views, weights))
    z = np.column_stack([np.clip(logits(v[aside], w) * c[0] + c[1], -30, 30) for v, w, c in zip(views, weights, calibration)])
    both = fit(z, y[aside], 0.1) if mixed else np.array([0.5, 0.5, 0.0])
    return Model((weights[0], weights[1]), calibration, both)


def features(documents: DataFrame) -> DataFrame:
    """doc_id and both views (text_view, meta_view: float32 as bytes) of every row, computed once."""
    kept = documents.select("doc_id", "source", "lang", F.col("text").cast("binary").alias("__text"))
    schema = kept.select("doc_id", *(F.lit(b"").alias(c) for c in ("text_view", "meta_view"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = [(t or b"").decode(errors="replace") for t in column(batch, "__text").to_pylist()]
                a = [text_features(t).astype("<f4").tobytes() for t in texts]
                b = [meta_features(s, la, t).astype("<f4").tobytes() for s, la, t in zip(column(batch, "source").to_pylist(), column(batch, "lang").to_pylist(), texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=schema.names)

    return stored(kept.mapInArrow(run, schema))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    read = lambda name, n: np.frombuffer(b"".join(column(batch, name).to_pylist()), "<f4").reshape(-1, n).astype(float)
    return read("text_view", _SIZES[0]), read("meta_view", _SIZES[1])


def learn(table: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """Co-trains on features(): about so many labelled rows, whose features come to the driver, and all other rows.

    A null label, or one that is neither 0 nor 1, is none; an id with both counts as bad; all rows of a labelled
    id are labelled.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # about labelled ids of eight bytes
    known = F.broadcast(known.where(place < min(1.0, labelled / max(1, known.count()))))
    rows = table.join(known, "doc_id").select("doc_id", "label", "text_view", "meta_view").toArrow().combine_chunks().to_batches()
    if rows:
        (batch,) = rows
        views, y, ids = _views(batch), column(batch, "label").to_numpy().astype(float), column(batch, "doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], y[i], views[0][i].tolist(), views[1][i].tolist()))
        views, y = tuple(v[order] for v in views), y[order]
    else:
        views, y = tuple(np.zeros((0, n)) for n in _SIZES), np.zeros(0)
    others = table.join(known.select("doc_id"), "doc_id", "left_anti").select("text_view", "meta_view")

    def pool(weights: tuple[np.ndarray, np.ndarray]) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Sums = {}
            for batch in batches:
                for key, part in taught(_views(batch), weights, sure).items():
                    total[key] = tuple(x + y for x, y in zip(total[key], part)) if key in total else part
            for (learner, label), (n, g, h) in total.items():
                # a row for each row of the curvature, with the gradient's number; the first has the count
                lines = [np.concatenate(([n if i == 0 else 0.0, g[i]], h[i])).tobytes() for i in range(len(g))]
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(g), pa.int32()) for c in (learner, label)] + [pa.array(range(len(g)), pa.int32()), pa.array(lines, pa.binary())], names=["learner", "label", "line", "sums"])

        def add(key, group):
            total = sum(np.frombuffer(x) for x in group.column("sums").to_pylist())
            return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], names=["learner", "label", "line", "sums"])

        kind = "learner int, label int, line int, sums binary"
        got = others.mapInArrow(run, kind).groupBy("learner", "label", "line").applyInArrow(add, kind).collect()
        lines = {(r["learner"], r["label"], r["line"]): np.frombuffer(r["sums"]) for r in got}
        out: Sums = {}
        for learner in (0, 1):
            for label in (0, 1):
                own = [lines.get((learner, label, i), np.zeros(_SIZES[learner] + 3)) for i in range(_SIZES[learner] + 1)]
                out[learner, label] = float(own[0][0]), np.array([x[1] for x in own]), np.array([x[2:] for x in own])
        return out

    return co_train(views, y, pool, rounds)


def score(table: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, text_score, meta_score, predicted (1: good) of every row of features().

    Cases: a null text is an empty one, null source and lang are names of their own; without labelled rows of
    both kinds every score is their smoothed share; a score that ties with the threshold is good; repeated rows
    are scored each; of a text of any length the words and lines are in memory once; other columns are not
    read, whatever their names.
    """
    schema = table.select("doc_id", *(F.lit(0.0).alias(c) for c in ("score", "text_score", "meta_score"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in model.scores(*_views(batch)))], names=schema.names)

    return table.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    seen = features(table(spark, sf_dir, "documents"))
    return score(seen, learn(seen, table(spark, sf_dir, "labels")))
