"""Language identification: scripts narrow the candidates, Viterbi over words labels spans.

Every word (a run of letters) has a log-likelihood under the character n-grams of each learned language;
languages that are not written in the word's script are ruled out. The best sequence of languages, where a
switch costs a penalty, gives spans. A text of which no stretch can pay for its switches by another language
has no switch and is labelled without the dynamic program. Each end of a stretch inside of the text is charged
half a switch: a stretch must gain less than the penalty, and one at either end of the text less than half.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrain.llm.common import column, slices

#: Labelled rows of each language, about, that the n-gram counts are learned from (chosen by hash of the id).
TRAIN_ROWS = 600
PENALTY = 12.0
ORDERS = (2, 3)
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W\d_]+")

#: First code points of script ranges (Unicode blocks) and their names.
_SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Other"), (0x0E00, "Thai"),
    (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0x20000, "Han"), (0x33480, "Other"),
]
_STARTS = [s for s, _ in _SCRIPTS]


def script(word: str) -> str:
    """The script of a word's first letter."""
    return _SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    """Character n-grams with ends marked, and the whole word if it is short."""
    marked = f"_{word}_"
    out = [marked[i : i + n] for n in ORDERS for i in range(len(marked) - n + 1)]
    return out + ["=" + word] if len(word) <= 8 else out


def _known(documents: DataFrame) -> DataFrame:
    return documents.where("lang is not null and doc_id is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")


class Model:
    """languages, log-likelihoods of n-grams, scripts of each language."""

    def __init__(self, counts: dict[str, dict[str, int]], scripts: dict[str, Counter]):
        self.langs = sorted(counts)
        size = {g for c in counts.values() for g in c}
        totals = {la: defaultdict(int) for la in self.langs}
        for la, c in counts.items():
            for g, n in c.items():
                totals[la][self._kind(g)] += n
        kinds = Counter(map(self._kind, size))
        self.unseen = {k: [-float(np.log(totals[la][k] + kinds[k] + 1)) for la in self.langs] for k in kinds}
        #: rows of the n-grams, then of what is unseen of each kind
        self.row = {g: i for i, g in enumerate(sorted(size))} | {k: len(size) + i for i, k in enumerate(sorted(kinds))}
        self.logs = np.zeros((len(size) + len(kinds) + 1, len(self.langs)))
        for g, i in self.row.items():
            k = g if isinstance(g, int) else self._kind(g)
            self.logs[i] = [np.log(counts[la].get(g, 0) + 1) + u for la, u in zip(self.langs, self.unseen[k])]
        self.allowed = {s: [scripts[la][s] >= 0.01 * sum(scripts[la].values()) for la in self.langs] for s in {x for c in scripts.values() for x in c}}

    @staticmethod
    def _kind(gram: str) -> int:
        return 0 if gram[0] == "=" else len(gram)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each language, by order of n-grams; 50 off the best where the script is ruled out."""
        get, none, ids, sizes = self.row.get, len(self.logs) - 1, [], []
        for w in words:
            own = [get(g, -1) for g in grams(w)]
            if -1 in own:
                own = [get(self._kind(g), none) if i < 0 else i for i, g in zip(own, grams(w))]
            ids += own
            sizes.append(len(own))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        s = np.add.reduceat(self.logs[ids], starts, axis=0) / len(ORDERS)
        ruled = {x: np.array(ok) for x, ok in self.allowed.items() if any(ok) and not all(ok)}
        if ruled:
            for i, w in enumerate(words):
                if (ok := ruled.get(script(w))) is not None:
                    s[i] = np.where(ok, s[i], s[i].max() - 50)
        return s


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row where each change costs penalty; equal sums go to the smaller label."""
    n, k = scores.shape
    if k == 1:
        return np.zeros(n, np.int64)
    best = int(np.argmax(scores.sum(axis=0)))
    sums = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, k)), sums[:-1]]), axis=0)
    ends = max(sums.max(), (sums[-1] - low).max())
    if (sums - low).max() < penalty and ends < penalty / 2 and np.count_nonzero(scores.sum(axis=0) == scores.sum(axis=0)[best]) == 1:
        return np.full(n, best)
    back = np.zeros((n, k), np.int32)
    own = [*range(k)]
    v = scores[0].tolist()
    for t, row in enumerate(scores[1:].tolist(), 1):
        top = max(range(k), key=v.__getitem__)
        away = v[top] - penalty
        link = [i if v[i] >= away else top for i in own]
        v = [(v[i] if v[i] >= away else away) + row[i] for i in own]
        back[t] = link
    out = np.empty(n, np.int64)
    at = max(own, key=v.__getitem__)
    for t in range(n - 1, -1, -1):
        out[t] = at
        at = back[t, at]
    return out


class Labeller:
    """Labels texts; words' scores are remembered within a bound."""

    def __init__(self, model: Model, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)))

    def meet(self, texts: list[list[str]]) -> None:
        """Scores the words of several texts that are not yet known."""
        if len(self.row) > REMEMBERED:
            self._forget()
        new = sorted(set().union(*texts).difference(self.row))
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.table = np.vstack([self.table, self.model.scores(new)])

    def labels(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """label() of each text."""
        split = [_WORD.findall((t or "").lower()) for t in texts]
        self.meet(split)
        return [self.label(t or "", w) for t, w in zip(texts, split)]

    def label(self, text: str, words: list[str]) -> tuple[str, float, list[tuple[str, int, int]]]:
        """(language of most letters, its confidence, spans (language, first word, words))."""
        langs = self.model.langs
        if not langs or not words or not (any(map(str.isalpha, words)) or any(c.isalpha() for c in text)):
            return "und", 0.0, []
        scores = self.table[[*map(self.row.__getitem__, words)]]
        path = viterbi(scores, self.penalty)
        letters = np.bincount(path, np.fromiter(map(len, words), np.float64, len(words)), len(langs))
        best = int(np.argmax(letters))
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        sure = float((odds[:, best] / odds.sum(axis=1)).mean())
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return langs[best], min(1.0, max(0.0, sure)), [(langs[path[a]], a, b - a) for a, b in zip(cuts, cuts[1:])]


def learn(documents: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns n-gram counts from about rows labelled texts of each language, all of a language that has fewer.

    Rows whose lang or doc_id is null, and those held out (crc32 of the id divisible by 5), are not learned
    from. The counts are made on the executors; what comes to the driver is the model, whose size the sample bounds.
    """
    known = _known(documents)
    counts = known.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("count"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a number for each language, as the model has
    texts = known.join(F.broadcast(counts), "lang").where(place < share).select("lang", F.col("text").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for la, text in zip(column(batch, "lang").to_pylist(), column(batch, "__text").to_pylist()):
                words[la].update(_WORD.findall((text or b"").decode().lower()))
            for la, c in words.items():
                for w, n in c.items():
                    for g in grams(w):
                        found[la][g] += n
                    found[la]["#" + script(w)] += n * len(w)
        for la, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([la] * len(c)), pa.array([*c]), pa.array([*c.values()], pa.int64())], names=["lang", "gram", "n"])

    sums = texts.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by: dict[str, dict[str, int]] = defaultdict(dict)
    scripts: dict[str, Counter] = defaultdict(Counter)
    langs = [r["lang"] for r in counts.collect()]
    for r in sums.toLocalIterator():
        if r["gram"][0] == "#":
            scripts[r["lang"]][r["gram"][1:]] = r["n"]
        else:
            by[r["lang"]][r["gram"]] = r["n"]
    return Model({la: by[la] for la in langs}, scripts)


def identify(documents: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """All columns of documents and lang_pred, lang_score, lang_spans (array of lang, first word, number of words).

    Cases: a null or empty text, or one without a letter, is "und" with score 0 and no spans; with no language
    learned all texts are; equal letters go to the language first by name; repeated rows are labelled each;
    of a long text the words and their scores are in memory at once.
    Columns with the names of new ones are replaced.
    """
    spans = "array<struct<lang: string, first: int, words: int>>"
    documents = documents.drop("lang_pred", "lang_score", "lang_spans")
    kept = documents.withColumn("__text", F.col("text").cast("binary"))
    schema = documents.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(None).cast(spans).alias("lang_spans")).schema
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = labeller.labels([None if t is None else t.decode() for t in column(batch, "__text").to_pylist()])
                new = [
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([[{"lang": a, "first": b, "words": c} for a, b, c in f[2]] for f in found], kind),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return kept.mapInArrow(run, schema)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    documents = table(spark, sf_dir, "documents")
    out = identify(documents.select("doc_id", "text"), learn(documents))
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
