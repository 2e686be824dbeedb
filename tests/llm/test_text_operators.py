"""Operators over documents against plain versions, and their cases."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkrain.llm import bpe, decontaminate, langid, licenses, simhash, suffixes

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (None, "no id"), (5, "é ß " * 3), (6, "word " * 30_000)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, size=60):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(size)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]


# --- decontamination


def plain_hits(text, items, window):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = [False] * len(w), set()
    for item_id, t in items:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for i in range(max(1, len(x) - window + 1) if x else 0):
            part = x[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit[j : j + len(part)] = [True] * len(part)
                    found |= set() if item_id is None else {str(item_id)}
    return len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, block_bytes):
    rng = random.Random(1)
    texts = prose(rng, 60, 25)
    items = [(i, t[:80]) for i, t in enumerate(prose(rng, 12, 25))] + [(12, texts[5][:90]), (13, texts[5][20:110]), (50, "É"), (51, None), (52, "..."), (None, "abc d"), (10, texts[3][10:120])]
    docs = [*enumerate(t.upper() if i % 7 == 0 else t.replace(" ", " -- ", 2) for i, t in enumerate(texts)), *ODD]
    df = spark.createDataFrame(docs, DOCS).withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, bench, window=4, block_bytes=block_bytes).collect()
    want = sorted(repr((d, *plain_hits(t, items, 4))) for d, t in docs)
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == want
    assert any(r.contaminated for r in got) and all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_decontamination_without_rows(spark):
    docs, none = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


# --- BPE


@pytest.fixture(scope="module")
def model():
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        return bpe.Model(f.read(), bpe.late_characters())


def test_bpe_is_the_librarys(spark, model):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    rng = random.Random(2)
    chars = [chr(c) for c in [*range(32, 127), 0xE9, 0xDF, 0x130, 0x3A3, 0x301, 0x4E2D, 0x1F600, 0xA0, 0x2003, 0xFFFD, 0x1C]]
    texts = [None, "", " \n", "It's we'll <|endoftext|>don't<|startoftext|>", "Σ ΑΣ", *("".join(rng.choices(chars, k=rng.randint(1, 60))) for _ in range(150)), "thethe" * 2000, *prose(rng, 20)]
    docs = spark.createDataFrame([*enumerate(texts), (0, None)], DOCS).withColumn("n_tokens", F.lit("clash"))
    got = bpe.bpe_encode(docs, bpe.vocabulary_path(), keep=("doc_id", "n_tokens")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_encode(docs.limit(0), bpe.vocabulary_path()).count() == 0


def test_combining_marks_are_in_the_librarys_order(model):
    from tokenizers import normalizers

    library, encoder = normalizers.NFC(), bpe.Encoder(model)
    rng = random.Random(5)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))] + ["\U00011930"]
    for first in marks:
        for _ in range(12):
            t = rng.choice("aeéo\U00011935") + "".join(rng.choices([first, *rng.sample(marks, 2)], k=rng.randint(1, 4)))
            assert bpe.composed(t) == library.normalize_str(t)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.vocabulary_path())
    for t in ("\u0345\u08cd", "\u0345\u08d2", "\u0345\u1ac0", "\u0345\u1df9", "\u1ac7\u0332"):
        assert encoder.encode(t) == whole.encode(t, add_special_tokens=False).ids


def test_streamed_words_are_final_in_constant_memory(model):
    rng = random.Random(3)
    for _ in range(6):
        parts = [p for p in rng.sample(sorted(model.vocab), 40) if not p.endswith("</w>") and p.isascii() and p.isalpha()]
        word = "".join(rng.choice(parts) for _ in range(3000)).encode()
        e, got, most = bpe.WordEncoder(model), [], 0
        at = 0
        while at < len(word):
            step = rng.randint(1, 400)
            got += e.feed(word[at : at + step])
            at += step
            most = max(most, len(e.held))
        got += e.finish()
        assert got == model.merge([*(model.first[b] for b in word[:-1]), model.last[word[-1]]])
        assert most <= e.most + model.lookahead


def test_long_texts_are_encoded_in_pieces(spark, model, monkeypatch):
    texts = [*prose(random.Random(8), 10), "a<|endoftext|>b " * 9, "é" * 50]
    docs = spark.createDataFrame([*enumerate(texts)], DOCS)
    whole = sorted(map(repr, bpe.bpe_encode(docs, bpe.vocabulary_path()).collect()))
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    assert sorted(map(repr, bpe.bpe_encode(docs, bpe.vocabulary_path()).collect())) == whole


def test_lookahead_is_sufficient_for_a_small_list():
    vocab = {s: i for i, s in enumerate(bpe.byte_symbols())}
    merges = [("a", "b"), ("b", "c"), ("c", "a"), ("ab", "ab"), ("bc", "a"), ("a", "bc"), ("ca", "ca")]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec = {"model": {"vocab": vocab, "merges": [list(m) for m in merges]}, "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\S+"}}]}, "decoder": {"type": "ByteLevel"}}
    import json

    m = bpe.Model(json.dumps(spec))
    rng = random.Random(0)
    for _ in range(400):
        s = [m.first[ord(c)] for c in "".join(rng.choice("abc") for _ in range(30))]
        whole = m.merge(s.copy())
        for n in range(m.lookahead, 30):
            done, short = 0, m.merge(s[:n])
            for t, u in zip(short, whole):
                if done + m.lengths[t] > n - m.lookahead:
                    break
                assert t == u
                done += m.lengths[t]
    assert bpe.Decoder(m).text([vocab["Ã"]]) == "" and bpe.Decoder(m).text([vocab["Ã"], vocab["©"]]) == "é"


def test_decoding_gives_the_words_back(spark):
    docs = spark.createDataFrame([(1, "Hello, wörld don't"), (2, None)], DOCS)
    out = bpe.bpe_decode(bpe.bpe_encode(docs, bpe.vocabulary_path()), bpe.vocabulary_path())
    assert {r.doc_id: r.text for r in out.collect()} == {1: "hello , wörld don 't ", 2: ""}


# --- SimHash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def plain_components(fps, k):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = sorted(root)
    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= k:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = prose(rng, 40)
    texts += [t + " extra" for t in texts[:10]] + [t.replace(" a", " b", 1) for t in texts[:20]] + texts[5:8]
    docs = [*((i + 100, t) for i, t in enumerate(texts)), *ODD]
    got = simhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    fp = {repr((d, t)): plain_fingerprint(t) for d, t in docs}
    root = plain_components(list(fp.values()), 2)
    low = {}
    for d, t in docs:
        r = root[fp[repr((d, t))]]
        low[r] = min(x for x in (low.get(r), d) if x is not None) if (low.get(r) is not None or d is not None) else None
    want = sorted(repr((d, fp[repr((d, t))], low[root[fp[repr((d, t))]]])) for d, t in docs)
    assert sorted(repr((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = simhash.deduplicate(spark.createDataFrame(docs, DOCS)).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted({x for x in low.values() if x is not None}) and sum(r.doc_id is None for r in kept) == 1


def test_each_component_keeps_a_document_where_ids_repeat(spark):
    a, b, c, d = prose(random.Random(13), 4)
    rows = [(0, a), (1, a), (1, b), (1, b), (2, c), (2, d), (None, c)]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(0, a), (1, b), (2, c), (2, d), (None, c)]))


@pytest.mark.parametrize("group", [100_000, 6])
def test_links_lose_none(spark, group):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = simhash.near_links(df, 2, group=group)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(links).collect()}
    root = plain_components(list(fps), 2)
    classes = lambda of: sorted(sorted(x for x in fps if of(x) == r) for r in {of(x) for x in fps})
    assert classes(lambda x: got.get(x, x)) == classes(root.get)


def test_links_through_a_flip_outlive_dealing_anew(spark, monkeypatch):
    # the second pair of a massive half meets only by a flip in it, and every key within a bit is hot
    halves = [[*range(32)], [*range(32, 64)]]
    monkeypatch.setattr(simhash, "plan", lambda *_: [(halves[0], 1), (halves[1], 0)])
    rng = random.Random(12)
    fps = {x << 32 | low for low in (5, 4, 7) for x in rng.sample(range(1 << 32), 40)}
    pairs = [(x << 32 | 5, (x ^ 1 << 9) << 32 | 4) for x in rng.sample(range(1 << 32), 10)]
    fps |= {x for pair in pairs for x in pair}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.near_links(df, 2, group=20)).collect()}
    root = plain_components(list(fps), 2)
    classes = lambda of: sorted(sorted(x for x in fps if of(x) == r) for r in {of(x) for x in fps})
    assert classes(lambda x: got.get(x, x)) == classes(root.get)
    assert all(got.get(a, a) == got.get(b, b) for a, b in pairs)


def test_thresholds_cover_and_are_cheapest():
    rng = np.random.default_rng(0)
    cost = rng.uniform(0, 10, (4, 4))
    cost[:, 0] = 0
    best, ts = simhash.allocate(cost, 2)
    assert sum(t + 1 for t in ts) >= 3
    every = [(sum(cost[i, t + 1] for i, t in enumerate(c)), c) for c in np.ndindex(4, 4, 4, 4) for c in [[x - 1 for x in c]] if sum(x + 1 for x in c) >= 3]
    assert best == pytest.approx(min(e[0] for e in every))
    sample = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sample |= (sample & np.uint64(1)) << np.uint64(63)  # bits 0 and 63 agree
    assert any({0, 63} <= set(p) for p in simhash.group_bits(sample, 3, [*range(64)]))


# --- suffix arrays


def plain_removed(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(s)
        out[d] = (len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), bytes(x for x, c in zip(t, cover) if not c))
    return out


@pytest.mark.parametrize("alphabet, hot, often", [("ab", 100_000, 16), ("ab", 4, 100), ("ab", 3, 2), ("é€x", 100_000, 16), ("é€x", 2, 2)])
def test_repeats_are_removed(spark, alphabet, hot, often):
    rng = random.Random(len(alphabet) + hot + often)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 70))) for _ in range(10)]
    docs = {i: "".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for i in range(50)}
    got = suffixes.remove_repeats(spark.createDataFrame([*docs.items()], DOCS), length=20, gram=8, hot=hot, often=often).collect()
    want = plain_removed({d: t.encode() for d, t in docs.items()}, 20)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_a_line_of_all_texts_in_distinct_surroundings(spark):
    rng = random.Random(11)
    line = "".join(rng.choice("abcdefgh") for _ in range(18))
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    docs = {i: some(rng.randint(10, 40)) + line + rng.choice("ab") * rng.randint(1, 3) + some(30) for i in range(300)}
    df = spark.createDataFrame([*docs.items()], DOCS).repartition(4)
    texts = df.select(F.col("doc_id").alias("did"), F.lit(0).cast("long").alias("th"), F.col("text").cast("binary").alias("text"))
    assert len(suffixes.often_anchors(texts, 20, 8, 50, 4))
    got = suffixes.remove_repeats(df, length=20, gram=8, hot=50, often=4, bucket_bytes=500).collect()
    want = plain_removed({d: t.encode() for d, t in docs.items()}, 20)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    assert sum(r.n_removed > 0 for r in got) > 100


def test_buckets_are_dealt_evenly(spark):
    for n in (3, 4, 40, 203):
        labels = suffixes.even_labels(spark, n)
        assert len(set(labels.tolist())) == n
        held = spark.createDataFrame([(x,) for x in labels.tolist()], "bucket int").repartition(4, "bucket").rdd.glom().map(len).collect()
        assert max(held) <= -(-n // 4)


def test_repeats_over_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_CHUNK", 64)
    monkeypatch.setattr(suffixes, "_PACK", 300)
    rng = random.Random(9)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 90))) for _ in range(8)]
    docs = {i: "".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for i in range(30)}
    got = suffixes.remove_repeats(spark.createDataFrame([*docs.items()], DOCS), length=20, gram=8).collect()
    want = plain_removed({d: t.encode() for d, t in docs.items()}, 20)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_repeats_cases(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij") for _ in range(150))
    rows = [*ODD, (7, long), (7, long), (8, long), (None, long), (9, long[:99]), (10, "é" + long)]
    df = spark.createDataFrame(rows, DOCS).withColumn("bucket", F.lit("clash"))
    got = suffixes.remove_repeats(df, keep=("doc_id", "bucket")).collect()
    assert len(got) == len(rows) and {r.bucket for r in got} == {"clash"}
    of = lambda d: sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got if r.doc_id == d)
    assert of(7) == [(150, 0, 0), (150, 150, 1)] and of(8) == [(150, 150, 1)] and of(9) == [(99, 0, 0)] and of(10) == [(152, 150, 1)] and of(1) == [(0, 0, 0)]
    # a period of five: the first 100-byte strings of each phase stay
    assert of(6) == [(150_000, 150_000 - 5, 1)]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_two_stage_sorting():
    rng = np.random.default_rng(0)
    for _ in range(200):
        t = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 120)).astype(np.uint8)
        b = t.tobytes()
        assert suffixes.suffix_array(t, 200).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    small = suffixes.smaller_than_successor(np.frombuffer(b"banana", np.uint8))
    assert small.tolist() == [b"banana"[i:] < b"banana"[i + 1 :] for i in range(6)]
    padded = np.frombuffer(b"abcdefghijabcdefghix" + bytes(8), np.uint8)
    assert suffixes.common_prefixes(padded, np.array([0, 1]), np.array([10, 11]), 16).tolist() == [9, 8]


# --- languages


def test_languages(spark):
    rng = random.Random(6)
    makes = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "ein", "ung", "der"], "cc": ["при", "вет", "мир", "да"]}
    text = lambda la, n: " ".join("".join(rng.choice(makes[la]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(la, 40), la) for i, la in enumerate(["aa", "bb", "cc"] * 40)] + [(900, text("aa", 30) + ". " + text("bb", 30), None), (901, None, "aa"), (902, "12 ½ !", "aa"), (903, "", None), (None, text("bb", 20), "bb"), (5, "да", "cc"), (5, "да", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.langs == ["aa", "bb", "cc"]
    got = langid.identify(docs.withColumn("lang_pred", F.lit("clash")), model).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 900)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (901, 902, 903)] == ["und"] * 3 and by[None].lang_pred == "bb"
    assert [(s.lang, s.first, s.words) for s in by[900].lang_spans] == [("aa", 0, 30), ("bb", 30, 30)]
    assert all(0 <= r.lang_score <= 1 for r in got)
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s, p = rng.normal(size=(rng.integers(1, 30), 3)), rng.uniform(0, 5)
        v = s[0]
        for row in s[1:]:
            v = np.maximum(v, v.max() - p) + row
        path = langid.viterbi(s, p)
        assert s[np.arange(len(s)), path].sum() - p * np.count_nonzero(np.diff(path)) == pytest.approx(v.max())


def plain_languages(rows, penalty):
    """The query's rules without tables: counts, scripts, smoothed likelihoods, the best path by trying every change."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    parts = lambda w: [f"_{w}_"[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n)] + ["=" + w] * (len(w) <= 8)
    kind = lambda g: 0 if g[0] == "=" else len(g)
    known = [(t, la) for i, t, la in rows if la is not None and i is not None and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({la for _, la in known})
    counts = {la: Counter(g for t, x in known if x == la for w in words(t) for g in parts(w)) for la in langs}
    scripts = {la: Counter() for la in langs}
    for t, la in known:
        for w in words(t):
            scripts[la][langid.script(w)] += len(w)
    every = {g for c in counts.values() for g in c}
    kinds = Counter(map(kind, every))
    totals = {la: Counter() for la in langs}
    for la, c in counts.items():
        for g, n in c.items():
            totals[la][kind(g)] += n

    def likely(w):
        out = [sum(math.log(counts[la][g] + 1) - math.log(totals[la][kind(g)] + kinds[kind(g)] + 1) for g in parts(w) if kind(g) in kinds) / 2 for la in langs]
        ok = [scripts[la][langid.script(w)] >= 0.01 * sum(scripts[la].values()) for la in langs]
        seen = any(scripts[la][langid.script(w)] for la in langs)
        return [x if y or not any(ok) or not seen else max(out) - 50 for x, y in zip(out, ok)]

    found = []
    for i, t, _ in rows:
        w = words(t)
        if not langs or not any(c.isalpha() for c in t or "") or not w:
            found.append((i, "und", 0.0, []))
            continue
        s = [likely(x) for x in w]
        best, back = s[0], []
        for row in s[1:]:
            to = [max(range(len(langs)), key=lambda j: (best[j] - penalty * (j != k), j == k)) for k in range(len(langs))]
            best = [best[j] - penalty * (j != k) + row[k] for k, j in enumerate(to)]
            back.append(to)
        path = [max(range(len(langs)), key=lambda k: (best[k], -k))]
        for to in reversed(back):
            path.append(to[path[-1]])
        path.reverse()
        letters = [sum(len(x) for x, k in zip(w, path) if k == j) for j in range(len(langs))]
        top = max(range(len(langs)), key=lambda j: (letters[j], -j))
        sure = sum(math.exp(r[top]) / sum(map(math.exp, r)) if max(r) > -600 else math.exp(r[top] - max(r)) / sum(math.exp(x - max(r)) for x in r) for r in s) / len(s)
        cuts = [k for k in range(len(path)) if k == 0 or path[k] != path[k - 1]] + [len(path)]
        found.append((i, langs[top], sure, [(langs[path[x]], x, y - x) for x, y in zip(cuts, cuts[1:])]))
    return found


def test_languages_are_the_plain_ones(spark):
    rng = random.Random(16)
    makes = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "ein", "the", "er"], "cc": ["при", "вет", "мир"], "dd": ["мир", "ца", "sch"]}
    text = lambda la, n: " ".join("".join(rng.choice(makes[la]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(la, rng.randint(1, 12)), la) for i, la in enumerate([*makes] * 15)]
    rows += [(200 + i, " ".join(text(rng.choice([*makes]), rng.randint(1, 9)) for _ in range(rng.randint(1, 4))), None) for i in range(40)]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "4 ½", None), (303, "中文 ξένο", None), (None, text("cc", 4), "cc"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.learn(docs)).collect()
    key = lambda r: (repr(r[0]), repr(r[1:2]), round(r[2], 6))
    got = sorted(((r.doc_id, r.lang_pred, r.lang_score, [tuple(x) for x in r.lang_spans]) for r in got), key=key)
    for g, w in zip(got, sorted(plain_languages(rows, langid.PENALTY), key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-9) and g[3] == w[3]


def test_more_languages_than_a_thousand(spark):
    letters = "abcdefghijkl"
    rows = [(i, f"{letters[i % 12]}{letters[i // 12 % 12]}{letters[i // 144]} " * 5, f"l{i:04}") for i in range(1400)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    docs = spark.createDataFrame([*rows, (5000, "word " * 100_000, None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.langs) == len(rows) > 1000
    assert langid.identify(docs.where("doc_id = 5000"), model).first().lang_pred in model.langs


# --- licences


def test_viterbi_of_two_halves_without_the_best_total():
    s = np.array([[10.0, -15.0, 0.0], [-15.0, 10.0, 0.0]])
    assert langid.viterbi(s, 12.0).tolist() == [0, 1]
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, p = int(rng.integers(1, 6)), 12.0
        s = rng.integers(-9, 10, (n, 3)).astype(float)
        value = lambda path: sum(s[i, x] for i, x in enumerate(path)) - p * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        assert value(langid.viterbi(s, p).tolist()) == max(map(value, np.ndindex(*[3] * n)))


def plain_scan(text, templates, threshold):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", lower(t))
    lines = (text or "").split("\n")
    best, n = None, 0

    def compare(a, b, i, order, unit, name):
        nonlocal best, n
        dice = 2.0 * sum(min(a.count(g), b.count(g)) for g in set(b)) / (len(a) + len(b))
        if dice >= threshold:
            n += 1
            best = max(best or (0,), (dice, -i, order, unit, name))

    whole = words(text)
    whole = [*zip(whole, whole[1:])]
    for i, (name, t) in enumerate(sorted(templates.items())):
        b = words(t)
        b = [*zip(b, b[1:])]
        for unit, line in [*enumerate(lines, 1), *([(0, text)] if len(lines) > 1 else [])]:
            a = words(line)
            if len(a) > 1 and b:
                compare([*zip(a, a[1:])], b, i, -unit, unit, name)
        for p, g in enumerate(whole):
            if g in b:
                compare(whole[p : p + len(b)], b, i, -(1 << 30) - p, -p - 1, name)
    return (best[4], best[0], best[3], n) if best else (None, None, None, 0)


def test_wrapped_notices_are_found(spark):
    words = licenses.TEMPLATES["MIT-text"].split(" ")
    wrapped = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    code = "\n".join(f"x{i} = f(y{i}, {i})" for i in range(400))
    rows = [(1, wrapped + "\n" + code), (2, code), (3, "See below. " + licenses.TEMPLATES["MIT"] + " And so on, of the software. " * 40), (4, "the software " * 20_000), (5, (wrapped + "\n") * 30)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].license == "MIT-text" and got[1].dice == 1.0 and got[1].unit == -1
    assert got[3].license == "MIT" and got[3].unit == -3
    assert got[2].license is None and got[4].license is None and got[5].license == "MIT-text" and got[5].n_matches >= 30
    assert licenses.scan(spark.createDataFrame(rows, DOCS).limit(0)).count() == 0


def test_licence_scan(spark):
    rng = random.Random(7)
    texts = [None, "", "\n", "Released under the MIT License.", "x\nReleased under the MIT license, MIT License\ny", licenses.TEMPLATES["MIT-text"].replace(", ", ",\n")]
    for _ in range(80):
        t = rng.choice([*licenses.TEMPLATES.values()]).split(" ")
        for _ in range(rng.randint(0, 3)):
            t.insert(rng.randrange(len(t)), rng.choice(["foo", "é", t[0], "\n"]))
        texts.append(rng.choice(["", "Some line\n", "a b\n\n"]) + " ".join(t))
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[3])]
    got = licenses.scan(spark.createDataFrame(rows, DOCS).withColumn("dice", F.lit("clash"))).collect()
    want = sorted(repr((d, *plain_scan(t, licenses.TEMPLATES, 0.8))) for d, t in rows)
    assert sorted(repr((r.doc_id, r.license, r.dice, r.unit, r.n_matches)) for r in got) == want
    assert licenses.scan(spark.createDataFrame(rows, DOCS), {}).where("n_matches > 0").count() == 0
