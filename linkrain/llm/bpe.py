"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Merges are applied by rank, the leftmost first. If text is appended, what is left of some place stays as it
was: a merge (u, v) across the end of the old text takes u away, which can only matter further left if a
later merge (u', v') wants a right part v' that begins with u, and so on. The ranks of such a chain rise, so
the longest sum of the u's over all chains, found by going once through the merge list backwards, is a
sufficient lookahead: a token that ends so many symbols before the end of what is known is final. The
encoder holds about twice the lookahead, whatever the length of a word.

The decoder is a state machine that keeps the bytes of an unfinished UTF-8 sequence between tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrain.llm.common import column, slices

#: Words whose tokens a task remembers; beyond it the memory starts anew, results are the same.
REMEMBERED = 250_000
#: A word of more symbols is streamed and not remembered.
REMEMBERED_SYMBOLS = 256
#: Characters of a text, or words of a longer one, that are handled at once.
AT_ONCE = 1 << 20
_END = 0xE000


_MAYBE_LATE = re.compile("[\u0530-\U0010ffff]")


#: Ranges with letters or digits of Unicode 16.0 that unicodedata of 15.1 takes for unassigned.
_UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113E2), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
)
#: Small letters of capitals that are newer than unicodedata.
_SMALL = {0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0x1C89: 0x1C8A} | {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}


#: Ranges of combining marks that vocabularies' normalisation does not know as such (they are newer), so it leaves
#: them and what is around them in order; and a vowel sign (11930) that it does not compose.
_PLAIN_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x11930, 0x11930), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97),
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
_SPLIT_MARKS = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _PLAIN_MARKS) + "])")


def composed(text: str) -> str:
    """NFC as vocabularies' normalisation has it."""
    if text.isascii():
        return text
    if _SPLIT_MARKS.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(_SPLIT_MARKS.split(text)))


_MAYBE_SMALL = re.compile("[" + "".join(map(chr, _SMALL)) + "]")


def late_characters() -> str:
    """A character class of what the regex module takes for letters or digits but vocabularies' Unicode (16.0) doesn't have."""
    unassigned = "".join(c for c in map(chr, range(0x530, 0x110000)) if unicodedata.category(c) == "Cn")
    late = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", unassigned)]
    runs: list[list[int]] = []
    for c in late:
        if any(a <= c <= b for a, b in _UNICODE_16):
            continue
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]" if runs else ""


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Model:
    """A vocabulary and merge list of the JSON form of public tokenizers (BPE, bytes as symbols)."""

    def __init__(self, text: str, late: str = ""):
        spec = json.loads(text)
        model = spec["model"]
        self.end_mark = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(self.symbols)}
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.pieces = {i: p for p, i in self.vocab.items()} | {i: p for p, i in self.added.items()}
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds not in ([], ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"normalizer {kinds} is not known")
        self.fold = bool(kinds)
        self.joined_by_blank = spec.get("decoder") is None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # \s as in Unicode's White_Space, without the separators U+001C to U+001F
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern, regex.V1)
        # letters and digits that the regex module knows but unicodedata doesn't are too new for the vocabulary
        self.late_words = regex.compile(pattern.replace(r"\p{L}", f"[\\p{{L}}--{late}]").replace(r"\p{N}", f"[\\p{{N}}--{late}]"), regex.V1) if late else self.words
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        ids = self.vocab
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks[ids[a], ids[b]] = (rank, ids[a + b])
        self.steps = {a << 20 | b: rank << 20 | ab for (a, b), (rank, ab) in self.ranks.items()}
        self.first = [ids[s] for s in self.symbols]
        self.last = [ids[s + self.end_mark] for s in self.symbols]
        self.lengths = {i: len(self._key(p)) for p, i in self.vocab.items()}
        self.lookahead = self._lookahead()

    def number(self, piece: str) -> int:
        """The token that is written so."""
        return self.vocab[piece] if piece in self.vocab else self.added[piece]

    def _key(self, piece: str) -> str:
        """One character per symbol: the last byte with the end mark is a symbol of its own."""
        if self.end_mark and piece.endswith(self.end_mark) and len(piece) > len(self.end_mark):
            piece = piece.removesuffix(self.end_mark)
            return piece[:-1] + chr(_END + ord(piece[-1]))
        return piece

    def _lookahead(self) -> int:
        """Longest sum of left parts over chains of rising rank, each right part beginning with the left part before.

        It needs a merge list in which parts are made before they are used; otherwise ValueError.
        """
        made: dict[int, int] = {}
        for (a, b), (rank, ab) in self.ranks.items():
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError("the merge list uses a token before it is made")
            made.setdefault(ab, rank)
        best: dict[str, int] = {}
        longest = 1
        for a, b in sorted(self.ranks, key=lambda m: -self.ranks[m][0]):
            u, v = self._key(self.pieces[a]), self._key(self.pieces[b])
            reach = len(u) + best.get(u, 0)
            longest = max(longest, reach)
            for i in range(1, len(v) + 1):
                if best.get(v[:i], 0) < reach:
                    best[v[:i]] = reach
        return longest + 1  # the last known symbol may yet get the end mark

    def merge(self, ids: list[int]) -> list[int]:
        """Merges by rank, the leftmost of equal ranks first."""
        n = len(ids)
        if n < 2:
            return ids
        if n <= 32:
            return self._merge_short(ids)
        ranks = self.ranks
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, ab = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = ab, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [t for t, a in zip(ids, alive) if a]


    def _merge_short(self, ids: list[int]) -> list[int]:
        """merge() of a few symbols, with the steps of all pairs in a list; a step is rank and result in one number."""
        get, none = self.steps.get, 1 << 62
        steps = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while steps:
            low = min(steps)
            if low == none:
                break
            i = steps.index(low)
            ids[i : i + 2] = [low & 0xFFFFF]
            del steps[i]
            if i < len(steps):
                steps[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                steps[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids


class WordEncoder:
    """Streaming encoder of one word: feed() bytes in any pieces, tokens come out once they are final."""

    def __init__(self, model: Model):
        self.model, self.held = model, bytearray()
        self.most = 2 * model.lookahead + 64

    def feed(self, part: bytes) -> Iterator[int]:
        m = self.model
        for at in range(0, len(part), m.lookahead):
            self.held += part[at : at + m.lookahead]
            if len(self.held) > self.most:
                sure, done = len(self.held) - m.lookahead, 0
                for t in m.merge([m.first[b] for b in self.held]):
                    if done + m.lengths[t] > sure:
                        break
                    done += m.lengths[t]
                    yield t
                del self.held[:done]

    def finish(self) -> Iterator[int]:
        if self.held:
            m = self.model
            yield from m.merge([*(m.first[b] for b in self.held[:-1]), m.last[self.held[-1]]])
            self.held.clear()


class Encoder:
    """Texts to tokens; words are remembered within a bound."""

    def __init__(self, model: Model):
        self.model, self.memory, self.stream = model, {}, WordEncoder(model)

    def _normal(self, text: str) -> str:
        if not self.model.fold:
            return text
        # one character at a time has no final form of sigma
        text = composed(text).replace("Σ", "σ").lower()
        return text.translate(_SMALL) if _MAYBE_SMALL.search(text) else text

    def word(self, word: str) -> tuple[int, str, str]:
        """(tokens, ids in decimal, their pieces), blanks between."""
        data = word.encode()
        ids = [*self.stream.feed(data), *self.stream.finish()]
        pieces = self.model.pieces
        out = len(ids), " ".join(map(str, ids)), " ".join([pieces[i] for i in ids])
        if len(data) <= REMEMBERED_SYMBOLS:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[word] = out
        return out

    def parts(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """word() of every word of a text, and added tokens as they are written, some at a time."""
        m, get, own = self.model, self.memory.get, self.word
        pieces = m.split_added.split(text) if m.split_added else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                yield [(1, str(m.added[piece]), piece)]
            elif len(piece) <= AT_ONCE:
                find = m.late_words if _MAYBE_LATE.search(piece) else m.words
                if found := [get(w) or own(w) for w in find.findall(self._normal(piece))]:
                    yield found
            else:
                find = m.late_words if _MAYBE_LATE.search(piece) else m.words
                found = find.finditer(self._normal(piece))
                while some := [get(w[0]) or own(w[0]) for w in islice(found, AT_ONCE)]:
                    yield some

    def digests(self, text: str, ids: bool) -> tuple[int, str, str, np.ndarray | None]:
        """(tokens, SHA-256 of the ids and of the decoded text, the ids if asked for)."""
        n, numbers = 0, []
        hashes = (hashlib.sha256(), hashlib.sha256())
        decoder = Decoder(self.model)
        for some in self.parts(text):
            counts, texts, pieces = zip(*some)
            if n:
                hashes[0].update(b" ")
            n += sum(counts)
            joined = " ".join(texts)
            hashes[0].update(joined.encode())
            hashes[1].update(decoder.feed(pieces).encode())
            if ids:
                numbers.append(np.array(joined.split(), np.int32))
        hashes[1].update(decoder.finish().encode())
        return n, hashes[0].hexdigest(), hashes[1].hexdigest(), np.concatenate([np.zeros(0, np.int32), *numbers]) if ids else None

    def encode(self, text: str) -> list[int]:
        return [int(i) for some in self.parts(text) for _, ids, _ in some for i in ids.split(" ")]


class Decoder:
    """Tokens to text, a few at a time.

    Without a decoder in its file a vocabulary's pieces are put together with blanks, as the public library
    does; text() gives the bytes that the pieces stand for, as far as they are whole characters. Between calls
    the machine keeps whether a piece came before, or the bytes of an unfinished character.
    """

    def __init__(self, model: Model):
        self.model, self.begun = model, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.byte_of = model.byte_of

    def feed(self, pieces: Iterable[str]) -> str:
        """Text of further tokens, given as strings of pieces with blanks between."""
        if not self.model.joined_by_blank:
            return self.text([i for p in pieces for i in map(self.model.number, p.split(" "))])
        out = " ".join(pieces)
        if out and self.begun:
            out = " " + out
        self.begun = self.begun or bool(out)
        return out

    def finish(self) -> str:
        """What an unfinished character at the end stands for."""
        return self.utf8.decode(b"", True)

    def text(self, ids: Iterable[int], last: bool = False) -> str:
        m, out = self.model, []
        special = {*m.added.values()}
        for i in ids:
            piece = m.pieces[i]
            if i in special:
                out.append(self.utf8.decode(b"", True) + piece)
                self.utf8.reset()
                continue
            ended = m.end_mark and piece.endswith(m.end_mark)
            data = bytes(self.byte_of[c] for c in (piece.removesuffix(m.end_mark) if ended else piece))
            out.append(self.utf8.decode(data + b" " if ended else data))
        return "".join(out) + (self.finish() if last else "")


def bpe_encode(documents: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """keep columns and n_tokens, ids_sha256, decoded_sha256, and with ids token_ids, for every row of documents.

    vocabulary is the path of a tokenizer file on the driver, which sends the file's text (1.7 MB) along.

    Cases: a null text is an empty one, which has no tokens; repeated rows stay; words of any length are
    encoded in constant memory, beside the text itself; strings of added tokens in a text are these tokens; other
    columns are not read, and keep columns with the names of results are left out.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = documents.sparkSession.sparkContext.broadcast((f.read(), late_characters()))
    new = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    new += [("token_ids", pa.list_(pa.int32()), "array<int>")] * ids
    keep = tuple(c for c in keep if c not in [n for n, *_ in new])
    kept = documents.select(*keep, F.col("text").cast("binary").alias("__text"))
    schema = kept.select(*keep, *(F.lit(None).cast(t).alias(n) for n, _, t in new)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Model(*spec.value))
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 20):
                rows = [encoder.digests((t or b"").decode(), ids) for t in column(batch, "__text").to_pylist()]
                made = [pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), new[:3])]
                if ids:
                    ends = np.cumsum([0, *(r[0] for r in rows)])
                    made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[3] for r in rows]))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*keep, *(n for n, *_ in new)])

    return kept.mapInArrow(run, schema)


def bpe_decode(tokens: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and text, the characters that token_ids stand for; null and empty lists give an empty text."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = tokens.sparkSession.sparkContext.broadcast(f.read())
    kept = tokens.select(*keep, F.col("token_ids").cast("array<int>").alias("__ids"))
    schema = kept.select(*keep, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(spec.value)
        for batch in batches:
            texts = [Decoder(model).text(x or (), last=True) for x in column(batch, "__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return kept.mapInArrow(run, schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    return bpe_encode(table(spark, sf_dir, "documents"), vocabulary_path(), ids=False)
